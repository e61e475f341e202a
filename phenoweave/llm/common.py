"""What the text operators share: hashing rules, folds, sized joins, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoweave.session import stored

#: A side of a join is broadcast up to this size, counted at ROW_BYTES a row, and shuffled beyond it.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64

#: The bytes that separate words, space and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
WORD_SEPARATOR = "[\\x20\\x09-\\x0D]+"


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null where the id is null."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(folds)


def held_out(doc_id: str, folds: int, kept: int) -> Column:
    """Whether a row is kept from learning; a row without id is never learnt from."""
    return F.coalesce(fold(doc_id, folds) == F.lit(kept), F.lit(True))


def hash_sample(rows: DataFrame, key: str, limit: int, group: str | None = None) -> DataFrame:
    """About ``limit`` rows (of each value of ``group``, of which there may be any number) by hash of their key.

    The same on every run. Counts per group are joined and do not reach the
    driver; a row whose group is null is not taken.
    """
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    if group is None:
        return rows.where(draw < min(1 << 30, (limit << 30) // max(1, rows.count())))
    share = F.expr(f"least({1 << 30}L, {limit << 30}L div count(*))").alias("_share")
    shares = stored(rows.where(F.col(group).isNotNull()).groupBy(group).agg(share), "shares")
    return sized_join(rows, shares, group, "inner").where(draw < F.col("_share")).select(*rows.columns)


def fits(rows: DataFrame) -> bool:
    """Whether a narrow table is small enough to broadcast; counts no further than the bound."""
    most = BROADCAST_BYTES // ROW_BYTES
    return rows.limit(most + 1).count() <= most


def sized_join(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """Join that broadcasts a narrow ``right`` only where it has been counted to be small."""
    return left.join(F.broadcast(right) if fits(right) else right.hint("shuffle_merge"), on, how)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTE_VALUES = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers_to(length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < length:
        size = 1 << (length - 1).bit_length()
        for name, base in (("up", _STEP), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:length], _powers["down"]


def word_hashes(text: bytes, is_word: np.ndarray = _IS_WORD, first: int | None = None) -> np.ndarray:
    """A 64-bit hash of every word, in order, see :func:`hashes_of_words`."""
    return hashes_of_words(text, is_word, (first,))[0]


def hashes_of_words(text: bytes, is_word: np.ndarray, firsts: tuple[int | None, ...]) -> list[np.ndarray]:
    """64-bit hashes of every word, in order, one array for each of ``firsts``: a polynomial over its bytes, then mixed.

    Differences of running sums give all words of a text at once, without a
    Python object per word. ``is_word`` tells for each byte whether it belongs to words;
    a number in ``firsts`` hashes only that many leading bytes of each word.
    """
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return [np.empty(0, np.uint64) for _ in firsts]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = is_word[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers_to(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up, out=sums[1:])
    out = []
    for first in firsts:
        until = ends if first is None else np.minimum(ends, starts + first)
        out.append(_mixed((sums[until] - sums[starts]) * down[starts] + (until - starts).astype(np.uint64)))
    return out


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive hashes."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : k + count]
    return _mixed(out)


def slices(frames: Iterator, columns: tuple[str, ...], most_chars: int = 4 << 20) -> Iterator:
    """Arrow batches cut so that each part holds about ``most_chars`` of text or one long row."""
    for frame in frames:
        lengths = frame[columns[0]].str.len().fillna(0).to_numpy(dtype=np.int64) if len(frame) else np.empty(0, np.int64)
        part = np.cumsum(lengths) // most_chars
        for value in np.unique(part):
            yield frame[part == value].reset_index(drop=True)
