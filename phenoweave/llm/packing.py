"""Best-fit packing of token pieces into sequences of fixed length."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoweave.session import ship_package, stored

#: Tokens that one bucket packs on its own: many more than its open bins hold, so that these are a small share of all.
BUCKET_TOKENS = 1 << 24
#: Bins that a bucket holds open at a time.
OPEN_BINS = 128

_PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space.

    Bit ``f`` is set while an open bin has ``f`` free tokens, so the best fit of a
    piece is the lowest set bit at or above its length. A new bin beyond the
    limit closes the fullest one, the lowest set bit of all.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.waiting, self.count, self.made = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        queue = self.waiting[free]
        number = queue.popleft()
        if not queue:
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.count == self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self._take(fullest)
            self.bits |= 1 << left
            self.waiting.setdefault(left, deque()).append(number)
            self.count += 1
        return number, self.capacity - free


def _encoder(ranks_path: str, pattern: str, specials: dict[str, int]):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)


def token_pieces(
    docs: DataFrame, ranks_path: str, pattern: str, specials: dict[str, int], end_id: int, capacity: int = 1024, with_ids: bool = False
) -> DataFrame:
    """Cut every text's ids, closed by ``end_id``, into pieces of at most ``capacity``.

    All pieces of a longer document are full but the first, which takes what the
    division leaves. A null or empty text is the closing id alone. Repeated rows
    give repeated pieces. ``with_ids`` adds the ids themselves. Special strings
    in a text become their special ids, as the vocabulary's own library does.
    """
    ship_package(docs.sparkSession)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(ranks_path, pattern, specials)
        known = set(specials)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.append(encoder.encode_to_numpy(text or "", allowed_special=known), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = 0 if piece == 0 else end - capacity
                    part = ids[start:end]
                    row = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            yield pd.DataFrame(rows, columns=names)

    # Ids travel as text, since a null among them would make pandas turn them into doubles.
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(cut, _PIECES + (", ids array<int>" if with_ids else "")).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = OPEN_BINS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Bounded-space online best-fit: every piece goes to the open bin that it fits
    best, and a new bin beyond ``open_bins`` closes the fullest one. Pieces are
    dealt by hash into as many buckets as their tokens ask for, and a bucket meets
    its pieces in the order of a hash, as they come by chance but the same however
    tasks are laid out or repeated. A bucket streams through its task: only the
    open bins are held. Offsets are gapless as a bin only grows. Repeated pieces
    are placed each, texts of any length are cut before; an empty table gives an
    empty one.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    names = pieces.columns
    held = stored(pieces, "pieces")
    total = held.agg(F.sum("length")).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_tokens))
    dealt = held.withColumn("_draw", F.xxhash64("doc_id", "piece")).withColumn("_bucket", F.pmod("_draw", F.lit(buckets)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, bins = None, None
        for batch in batches:
            numbers, offsets = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for k, (own, length) in enumerate(zip(batch["_bucket"].to_pylist(), batch["length"].to_pylist(), strict=True)):
                if own != bucket:
                    bucket, bins = own, OpenBins(capacity, open_bins)
                number, offsets[k] = bins.place(length)
                numbers[k] = (own << 32) | number
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(numbers), pa.array(offsets)], [*names, "sequence_id", "offset"])

    ordered = dealt.repartition("_bucket").sortWithinPartitions("_bucket", "_draw", "doc_id", "piece")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ordered.mapInArrow(place, f"{schema}, sequence_id long, offset long")
