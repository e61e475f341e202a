"""From raw documents to packed token sequences, stage by stage.

Each stage gets what the one before it kept, as Parquet, and returns it with its
own decisions applied: rejected documents are gone, secrets are replaced. The
last stage returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoweave.llm import jaccard, langid, packing, quality_classifier, secrets
from phenoweave.llm.common import held_out, sized_join
from phenoweave.llm.queries import CAPACITY, pieces_of, table
from phenoweave.session import shared_folder, stored

#: Least score of label 1 with which a document stays.
LEAST_QUALITY = 0.7
#: Least share of the likeliest language among all, and least likeness to it.
LEAST_LANGUAGE, LEAST_LIKENESS = 0.5, 0.0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores LEAST_QUALITY or more; a null text is scored as an empty one."""
    ensemble = quality_classifier.learn(docs, table(spark, sf_dir, "labels"), "quality")
    scored = quality_classifier.quality(docs, ensemble)
    return scored.where(F.col("quality_score") >= LEAST_QUALITY).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; a text without letters, between languages or like none of them goes."""
    model = langid.learn(docs, public_tokenizers.path("piece_bpe_32k.model"), ~held_out("doc_id", 4, 2))
    named = langid.identify(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE) & (F.col("likeness") >= LEAST_LIKENESS)
    return named.where(kept).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar texts the row of least id, one without id last; all other rows stay.

    Rows are told apart by a number of their own, so rows that share an id are
    judged each by its text, and a row without text, which is similar to nothing,
    never stands for one with text.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = jaccard.similar_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    grouped = found.join(found.where("_row <> component_id").select("component_id").distinct(), "component_id", "left_semi")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    ids = sized_join(rows.select("_row", "doc_id"), stored(grouped, "grouped"), "_row", "inner")
    kept = ids.groupBy("component_id").agg(F.min(order).alias("least")).select("component_id", F.col("least._row").alias("_kept"))
    gone = stored(sized_join(ids, kept, "component_id", "inner").where("_row <> _kept").select("_row"), "gone")
    return sized_join(rows, gone, "_row", "left_anti").select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and ``n_chars`` counted anew where one was."""
    ledger = secrets.Ledger(spark, shared_folder(spark, "ledger"))
    clean = secrets.redacted(docs, ledger)
    if "n_chars" in docs.columns:
        changed = F.col("text").contains("[secret]")
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place in it."""
    return packing.pack(pieces_of(docs), CAPACITY)


STAGES = [
    ("quality_classifier", keep_quality),
    ("language_id", keep_languages),
    ("ngram_jaccard", keep_distinct),
    ("secret_scans", remove_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Classifiers, tokenizers and packing have no SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
