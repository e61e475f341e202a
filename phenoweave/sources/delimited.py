"""Delimited text with a header; every column stays a string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phenoweave.functions.names import BASELINE_MARK, PERSON, quoted, view_name_of


def load_table(spark: SparkSession, path: str, name: str | None = None, delimiter: str = ",") -> DataFrame:
    """Read a table and register it as a temporary view.

    Without ``name`` the view is called after the file. Lines may end in LF,
    CRLF or CR.
    """
    table = spark.read.option("header", True).option("sep", delimiter).csv(path)
    table.createOrReplaceTempView(name or view_name_of(path))
    return table


def baseline_columns(columns: list[str]) -> list[str]:
    """The person key and every column of the first assessment."""
    return [PERSON] + [c for c in columns if BASELINE_MARK in c and c != PERSON]


def select_baseline(raw: DataFrame) -> DataFrame:
    return raw.select(*[quoted(c) for c in baseline_columns(raw.columns)])


def load_raw(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Raw wide export, cut to its baseline columns."""
    return select_baseline(load_table(spark, path, name))
