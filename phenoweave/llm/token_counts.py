"""Token counts of whole texts from the counts of their distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoweave.llm.common import slices
from phenoweave.session import ship_package, stored

#: Frequent pre-tokens whose counts are broadcast, and the longest of them in characters: a fixed bound.
FREQUENT = 1 << 17
FREQUENT_CHARS = 64
#: Documents, about, in which the frequent pre-tokens are looked up. Only the plan depends on them, no count does.
SAMPLE_DOCS = 8192

_loaded: dict[str, object] = {}


class PreTokens:
    """Pre-tokens as the vocabulary's own library splits a text.

    The pattern is run by ``regex``; a text with characters from U+0558 on, whose
    classes differ between Unicode versions, is split by the library itself.
    """

    _late = re.compile("[՘-\U0010ffff]")

    def __init__(self, path: str, pattern: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(pattern)

    def split(self, text: str) -> list[str]:
        if self._late.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _pre_tokens(path: str, pattern: str) -> PreTokens:
    if path not in _loaded:
        _loaded[path] = PreTokens(path, pattern)
    return _loaded[path]


def _frequent(docs: DataFrame, path: str, pattern: str, specials: tuple[str, ...]) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens: at most FREQUENT entries of bounded length."""
    total = docs.count()
    share = 1 << 20
    taken = F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) < F.lit(max(1, min(share, share * SAMPLE_DOCS // max(1, total))))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pre = _pre_tokens(path, pattern)
        for frame in slices(frames, ("text",)):
            found = Counter()
            for text in frame["text"]:
                for part in _parts(text or "", specials):
                    found.update(pre.split(part))
            if found:
                yield pd.DataFrame({"pre_token": list(found), "n": list(found.values())})

    top = (
        docs.where(taken)
        .select("text")
        .mapInPandas(split, "pre_token string, n long")
        .where(F.length("pre_token") <= FREQUENT_CHARS)
        .groupBy("pre_token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pre_token")
        .limit(FREQUENT)
    )
    names = [r[0] for r in top.select("pre_token").collect()]
    return dict(zip(names, _pre_tokens(path, pattern).counts(names), strict=True)) if names else {}


def _parts(text: str, specials: tuple[str, ...]) -> list[str]:
    parts = [text]
    for special in specials:
        parts = [p for part in parts for p in part.split(special)]
    return parts


def token_counts(docs: DataFrame, path: str, pattern: str, specials: tuple[str, ...] = (), limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    A text becomes the frequencies of its pre-tokens. Frequent pre-tokens, whose
    counts are broadcast, are summed where they are read; the others travel as
    (row, pre-token, frequency), are encoded once per distinct pre-token, and
    are joined back and summed. No ids are kept. Special strings count as one
    token each. A null text counts as empty; repeated rows are counted each on
    their own; other columns are ignored; texts of any length count whole, an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    # Ids travel as text, since a null among them would make pandas turn them into doubles.
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(plain, path, pattern, specials))

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pre, known = _pre_tokens(path, pattern), frequent.value
        for frame in slices(frames, ("text", "row", "doc_id")):
            rows = []
            for row, doc_id, text in zip(frame["row"], frame["doc_id"], frame["text"], strict=True):
                text = text or ""
                parts = _parts(text, specials)
                found, total = Counter(), len(parts) - 1
                for part in parts:
                    found.update(pre.split(part))
                for token, n in found.items():
                    count = known.get(token)
                    if count is None:
                        rows.append((row, doc_id, token, n, 0))
                    else:
                        total += n * count
                rows.append((row, doc_id, None, total, len(text.encode())))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "pre_token", "n", "n_bytes"])

    @F.pandas_udf("long")
    def count(tokens: pd.Series) -> pd.Series:
        return pd.Series(_pre_tokens(path, pattern).counts(tokens.tolist()), dtype="int64")

    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    held = stored(numbered.mapInPandas(frequencies, "row long, doc_id string, pre_token string, n long, n_bytes long"), "pre-tokens")
    rare = held.where(F.col("pre_token").isNotNull()).select("row", "pre_token", "n")
    counted = rare.select("pre_token").distinct().withColumn("pieces", count("pre_token"))
    added = rare.join(counted, "pre_token").select("row", (F.col("n") * F.col("pieces")).alias("n_tokens"))
    own = held.where(F.col("pre_token").isNull()).select("row", "doc_id", "n_bytes", F.col("n").alias("n_tokens"))
    return (
        own.unionByName(added, allowMissingColumns=True)
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
