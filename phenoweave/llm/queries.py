"""The text operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoweave.llm import jaccard, langid, lexical_search, line_dedup, oracles, packing, prefix_trie, quality_classifier, quality_rules, secrets, sp_encode, token_counts, topk, toxicity
from phenoweave.llm.common import held_out
from phenoweave.session import shared_folder

#: Special strings of the 50k byte vocabulary and the id that closes a document.
SPECIALS_50K = {"<|endoftext|>": 50256}
END_ID = 2
CAPACITY = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces_of(docs: DataFrame, **options) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.token_pieces(docs, path, public_tokenizers.PATTERN, SPECIALS_50K, END_ID, CAPACITY, **options)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(pieces_of(table(spark, sf_dir, "documents")), CAPACITY)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, public_tokenizers.path("piece_bpe_32k.model"), ~held_out("doc_id", 4, 2))
    return langid.identify(docs.select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out")), model).drop("text")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_topk(vectors.where(F.col("id") % 20 == 0), vectors, 20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, tuple(SPECIALS_50K))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sp_encode.decode(sp_encode.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ensemble = quality_classifier.learn(docs, table(spark, sf_dir, "labels"), "quality")
    rows = quality_classifier.quality(docs, ensemble)
    score = F.col("quality_score")
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", public_tokenizers.path("piece_bpe_32k.model"))
    rows = toxicity.toxicity(docs.select("doc_id", "text"), classifier)
    score = F.col("toxicity_score")
    return rows.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score.alias("score"), (score >= toxicity.DECISION).cast("int").alias("predicted"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark, shared_folder(spark, "ledger"))
    rows = secrets.find_secrets(table(spark, sf_dir, "documents"), ledger)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["place"] < len(secrets.BASE_RULES))
    return rows.select(
        "doc_id",
        *[count(rule.kind) for rule in secrets.BASE_RULES],
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("long")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie.prefix_trie(prefix_trie.paths(table(spark, sf_dir, "conversations"), conv - conv % 100, head))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_language_id": op2_language_id,
        "op3_exact_topk": op3_exact_topk,
        "op4_token_counts": op4_token_counts,
        "op5_piece_encoding": op5_piece_encoding,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_toxicity": op8_toxicity,
        "op9_secret_scans": op9_secret_scans,
        "op10_quality_rules": op10_quality_rules,
        "op11_lexical_search": op11_lexical_search,
        "op12_line_dedup": op12_line_dedup,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
