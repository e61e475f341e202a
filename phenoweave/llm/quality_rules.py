"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoweave.llm.common import WORD_SEPARATOR

#: Repeated windows up to which membership is tested by scanning; beyond it positions are sorted with their windows.
FEW_REPEATS = 32

#: Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on was be as with at by this "
    "der die das und ist den von zu mit sich des auf für ein eine "
    "le la les de des et est en un une que pour dans qui sur du au pas "
    "el los las y es por con una del se no lo para"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` of it lies outside ``least`` to ``most``."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The rules that documents are held to. Ratios are per word or per line with a word.
RULES = (
    Rule("n_words", least=50),
    Rule("repeat_ratio", most=0.5),
    Rule("mean_word_chars", least=2, most=20),
    Rule("symbol_ratio", most=0.25),
    Rule("stop_words", least=2),
    Rule("dup_line_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.5),
)


def _count(text: Column, pattern: str) -> Column:
    """Characters that match a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measured(docs: DataFrame) -> DataFrame:
    """The rows with the counts that the rules use; built-in expressions only, no shuffle.

    Each step's columns are read more than once by the next, so that none is
    evaluated again per element. A null text has no words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "*",
        F.array_remove(F.split(text, WORD_SEPARATOR), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        _count(text, "[#*$%&|<>]+").cast("long").alias("n_symbols"),
    )
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    counted = split.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda line: line.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda line: line.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.array_intersect(F.transform(F.array_distinct("_words"), F.lower), stops)).cast("long").alias("n_stop_words"),
        F.when(
            F.size("_words") >= 3,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - 2),
                lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("_windows"),
    )
    sorted_windows = counted.select("*", F.sort_array("_windows").alias("_sorted"), (F.size("_windows") > F.size(F.array_distinct("_windows"))).alias("_repeats"))
    repeated = sorted_windows.select(
        "*",
        F.when(
            F.col("_repeats"),
            F.array_distinct(
                F.transform(
                    F.filter(F.sequence(F.lit(2), F.size("_sorted")), lambda i: F.element_at("_sorted", i) == F.element_at("_sorted", i - 1)),
                    lambda i: F.element_at("_sorted", i),
                )
            ),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("_again"),
    )
    few = F.filter(F.sequence(F.lit(1), F.size("_windows")), lambda i: F.array_contains("_again", F.element_at("_windows", i)))
    keyed = F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i"))))
    placed = repeated.select(
        "*",
        F.when(F.size("_again") == 0, F.array().cast("array<int>")).when(F.size("_again") <= FEW_REPEATS, few).alias("_few"),
        F.when(F.size("_again") > FEW_REPEATS, keyed).alias("_keyed"),
    )
    at = lambda i: F.element_at("_keyed", i)["w"]
    many = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.size("_keyed")),
            lambda i: ((i > 1) & (at(i) == at(F.greatest(i - 1, F.lit(1))))) | ((i < F.size("_keyed")) & (at(i) == at(F.least(i + 1, F.size("_keyed"))))),
        ),
        lambda i: F.element_at("_keyed", i)["i"],
    )
    starts = placed.select("*", F.when(F.size("_again") > FEW_REPEATS, many).otherwise(F.col("_few")).alias("_starts"))
    covered = F.array_union(
        F.array_union("_starts", F.transform("_starts", lambda i: i + 1)),
        F.transform("_starts", lambda i: i + 2),
    )
    own = [c for c in docs.columns if c not in MEASURES]
    # A condition on a measure would be pushed below these steps and grow with each of them; it stops at a
    # projection that is not deterministic, which this always true condition makes of it.
    kept = lambda value: F.when(F.monotonically_increasing_id() >= 0, value)
    last = F.size(covered).cast("long")
    return starts.select(*own, *[kept(F.col(c)).alias(c) for c in MEASURES[:-1]], kept(last).alias(MEASURES[-1]))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "n_repeat_words")


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measures() -> dict[str, Column]:
    """What a rule may name, over the columns of ``measured``."""
    return {
        "n_words": F.col("n_words"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_words": F.col("n_stop_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": _ratio("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": _ratio("n_ellipsis_lines", "n_lines"),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row fails, as one array column."""
    known, failed = measures(), []
    for rule in rules:
        value = known[rule.measure]
        if rule.least is not None:
            failed.append(F.when(value < rule.least, F.lit(f"{rule.measure} below {rule.least:g}")))
        if rule.most is not None:
            failed.append(F.when(value > rule.most, F.lit(f"{rule.measure} above {rule.most:g}")))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row with its measures, ``failed`` rule names, ``base_failed`` and ``kept``.

    Columns of the input whose names clash with the measures are replaced. The
    base is fewer than 50 words or more than half of the words in repeated
    three-word windows; a row is kept if it fails neither the base nor a rule.
    Rows repeat as they do in the input, texts of any length are measured whole,
    and an empty table stays empty.
    """
    plain = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = measured(plain).drop("text").withColumn("failed", compiled(rules)).withColumn("base_failed", base)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
