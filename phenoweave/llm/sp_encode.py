"""Exact encoding and decoding with a merge-type piece vocabulary."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoweave.llm.common import slices
from phenoweave.session import ship_package

#: Entries that a worker remembers of encoded segments and of tested token pairs.
REMEMBERED = 1 << 18

SPACE = "▁"
_SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_loaded: dict[str, "MergeCodec"] = {}


class MergeCodec:
    """Encodes by backtracking over longest matches instead of replaying merges.

    A token sequence is what merging gives exactly if each adjacent pair is, so
    the longest reachable match is taken at every place and shortened, or the
    token before it undone, until the pair fits; a bitfield keeps places from
    which no way led on. Whether two tokens fit is found by merging their joint
    text, once per pair. The vocabulary file is read through its library, which
    takes no part in encoding or decoding.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.texts = [model.id_to_piece(i) for i in range(size)]
        self.ids = {self.texts[i]: i for i in plain}
        self.scores = {self.texts[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(self.texts[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.surfaces = [b""] * size
        for i in plain:
            self.surfaces[i] = self.texts[i].replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.surfaces[i] = bytes([value])
        self.surfaces[model.unk_id()] = " ⁇ ".encode()
        self.letters = {p for p in self.ids if len(p) == 1}
        inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(c not in self.letters for pair in inner for c in pair):
            raise ValueError("a piece holds a character that is no piece")
        self.adjacent = inner
        #: Only a run of spaces has pieces of equal score, whose order a pair alone does not tell.
        self.reachable = {p for p in self.ids if len(p) == 1 or self._merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for piece in self.reachable:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reachable), None) for p in self.reachable}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _merged(self, text: str) -> list[str]:
        """Merge from characters: best score first, leftmost of equals."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        scores = self.scores
        waiting = []
        for k in range(len(parts) - 1):
            both = parts[k] + parts[k + 1]
            if both in scores:
                waiting.append((-scores[both], k, both))
        heapq.heapify(waiting)
        while waiting:
            _, k, both = heapq.heappop(waiting)
            left, j = parts[k], after[k]
            if left is None or j >= len(parts) or len(left) >= len(both) or left + parts[j] != both:
                continue
            parts[k], parts[j] = both, None
            after[k] = after[j]
            if after[j] < len(parts):
                before[after[j]] = k
                more = both + parts[after[j]]
                if more in scores:
                    heapq.heappush(waiting, (-scores[more], k, more))
            if before[k] >= 0:
                more = parts[before[k]] + both
                if more in scores:
                    heapq.heappush(waiting, (-scores[more], before[k], more))
        return [p for p in parts if p is not None]

    def _fit(self, left: str, right: str) -> bool:
        pair = (left, right)
        found = self.pairs.get(pair)
        if found is None:
            found = left[-1] + right[0] not in self.adjacent or self._merged(left + right) == [left, right]
            if len(self.pairs) < REMEMBERED:
                self.pairs[pair] = found
        return found

    def _backtracked(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        size = len(text)
        longest = [""] * size
        for end, piece in self.automaton.iter(text):  # later matches of a start are longer
            longest[end - len(piece) + 1] = piece
        open_places = (1 << (size + 1)) - 1
        out: list[str] = []
        place, piece = 0, longest[0]
        while place < size:
            last = out[-1] if out else None
            while piece is not None:
                end = place + len(piece)
                if open_places >> end & 1 and (last is None or self._fit(last, piece)):
                    break
                piece = self.shorter[piece]
            if piece is not None:
                out.append(piece)
                place = end
                piece = longest[place] if place < size else None
            else:
                open_places &= ~(1 << place)
                out.pop()
                place -= len(last)
                piece = self.shorter[last]
        return out

    def _unknown(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode()]

    def _segment(self, text: str) -> list[int]:
        """Ids of one segment: cut where no piece reaches across, then by stretches of known characters."""
        if text.startswith(SPACE * 2):
            ids = []
            for piece in self._merged(text):
                ids.extend([self.ids[piece]] if piece in self.ids else self._unknown(piece))
            return ids
        ids, start = [], 0
        for k in range(1, len(text) + 1):
            if k < len(text) and text[k - 1 : k + 1] in self.adjacent:
                continue
            part, start = text[start:k], k
            if len(part) == 1 and part not in self.letters:
                ids.extend(self._unknown(part))
                continue
            found = self.known.get(part)
            if found is None:
                found = tuple(self.ids[p] for p in self._backtracked(part))
                if len(self.known) < REMEMBERED:
                    self.known[part] = found
            ids.extend(found)
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for segment in _SEGMENTS.findall(SPACE + text.replace(" ", SPACE)):
            found = known.get(segment)
            if found is None:
                found = tuple(self._segment(segment))
                if len(known) < REMEMBERED:
                    known[segment] = found
            ids.extend(found)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space put before the first piece goes, as it was added when encoding."""
        out = b"".join([self.surfaces[i] for i in ids])
        if ids and self.texts[ids[0]].startswith(SPACE):
            out = out[1:]
        return out.decode("utf-8", "replace")


def codec(path: str) -> MergeCodec:
    if path not in _loaded:
        _loaded[path] = MergeCodec(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every row. A null or empty text has no ids; repeated rows stay; other columns are ignored.

    Texts of any length are encoded whole, an empty table stays empty.
    """
    ship_package(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merge = codec(path)
        for frame in slices(frames, ("text", "doc_id")):
            ids = [np.asarray(merge.encode(text or ""), np.int32) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": ids})

    # Ids travel as text, since a null among them would make pandas turn them into doubles.
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text of ``ids``; null or no ids give an empty text."""
    ship_package(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        merge = codec(path)
        return ids.map(lambda x: "" if x is None else merge.decode(x.tolist()))

    return encoded.withColumn("decoded", text("ids"))
