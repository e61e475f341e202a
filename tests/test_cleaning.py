import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from phenoweave.operators import cleaning, hierarchy, setops
from phenoweave.operators.cleaning import Field

ONE = Field("A", "1", "Categorical (single)")
TWO = Field("A", "2", "Integer")


def wide(spark, data, columns=("1-0.0", "1-0.1", "2-0.0")):
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in ("eid", *columns)))


def numbers(spark, data):
    return wide(spark, data, ("2-0.0",) if len(data[0]) == 2 else ("2-0.0", "2-0.1"))


@pytest.mark.parametrize("one_row", [False, True])
def test_melt(spark, rows, one_row):
    table = wide(spark, [("a", "7", None, "4"), ("b", "99999", "7", None)])
    out = cleaning.melt(table, [ONE, TWO], one_row)
    assert rows(out, "eid", "featureName", "featureValue") == [
        ("a", "1=7", 1.0),
        ("a", "2", 4.0),
        ("b", "1=7", 1.0),
        ("b", "2", None),
    ]


def test_melt_joins_repeated_persons(spark):
    table = wide(spark, [("a", "7", "7", "4"), ("a", "7", None, "4.0")])
    assert cleaning.melt(table, [ONE, TWO]).count() == 2


def test_subset_and_fields(spark):
    table = wide(spark, [("a", "7", None, "4")])
    assert cleaning.subset(table, ["2"]).columns == ["eid", "2-0.0"]
    categories = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", "3")], "category string, field string")
    types = spark.createDataFrame([("1", ONE.type), ("2", TWO.type), ("3", "x")], "field string, featureType string")
    assert cleaning.fields_of(table, categories, types) == [ONE, TWO]


def test_distinct_before_mean(spark, rows):
    table = numbers(spark, [("a", "2", "2"), ("b", "8", None), ("c", None, None)])
    typed = cleaning.melt(table, [TWO])
    means = {r["featureName"]: r["mean"] for r in cleaning.numeric_stats(typed).collect()}
    assert means == {"2": 5.0}
    assert ("c", 5.0) in rows(cleaning.impute_mean(typed), "eid", "featureValue")


def test_negative_sentinel(spark, rows):
    out = cleaning.clean(numbers(spark, [("a", "-1"), ("b", "5"), ("c", None)]), [TWO])
    assert rows(out, "eid", "featureValue") == [("b", 1.0), ("c", 0.4)]


def test_mean_zero_is_imputed_then_dropped(spark, rows):
    table = numbers(spark, [("a", "-3"), ("b", "3"), ("c", None)])
    assert rows(cleaning.clean(table, [TWO]), "eid", "featureValue") == [("b", 1.0)]
    assert ("c", 0.0) in rows(cleaning.impute_mean(cleaning.melt(table, [TWO])), "eid", "featureValue")


def test_feature_without_values(spark):
    table = numbers(spark, [("a", None), ("b", None)])
    assert cleaning.clean(table, [TWO]).count() == 0
    assert cleaning.impute_mean(cleaning.melt(table, [TWO])).count() == 0


def test_steps_equal_the_single_job(spark, rows):
    table = wide(spark, [("a", "7", "8", "4"), ("b", "99999", "7", None), ("c", None, None, "-2"), ("d", "1", "1", "9")])
    typed = cleaning.melt(table, [ONE, TWO])
    steps = cleaning.max_scale(cleaning.positive_only(cleaning.impute_mean(typed)))
    columns = ("eid", "category", "featureName", "featureValue")
    assert rows(steps, *columns) == rows(cleaning.clean(table, [ONE, TWO]), *columns)


def test_deceased(spark, rows):
    table = wide(spark, [("a", "7", None), ("b", "8", "61"), ("b", "9", None)], ("1-0.0", "40000-0.0"))
    assert rows(cleaning.clean(table, [ONE]), "eid") == [("a",), ("b",), ("b",)]
    assert rows(cleaning.clean(table, [ONE], drop_deceased=True), "eid") == [("a",)]
    death = Field("A", "40000", "Date")
    assert rows(cleaning.drop_field_rows(cleaning.melt(table, [ONE, death])), "eid", "featureName") == [
        ("a", "1=7"), ("a", "40000"), ("b", "1=8"), ("b", "1=9"), ("b", "40000")
    ]


def tree(spark, depth=5):
    nodes = [("c0", "n0", "0", "Y")] + [(f"c{i}", f"n{i}", f"n{i - 1}", "Y") for i in range(1, depth)]
    nodes += [("-1", "m0", "0", "N"), ("-1", "m1", "m0", "N"), ("x", "lost", "nowhere", "Y")]
    return spark.createDataFrame(nodes, "coding string, node_id string, parent_id string, selectable string")


@pytest.mark.parametrize("depth", [5, 8])
def test_code_map(spark, rows, depth):
    expected = [(f"c{i}", f"n{min(i, 2)}") for i in range(depth)]
    assert rows(hierarchy.code_map(tree(spark, depth))) == expected


def test_rollup(spark, rows):
    names = ["1=c0", "1=c3", "1=c4", "1=-1", "1=zzz"]
    tall = spark.createDataFrame(
        [("a", "A", n, 1.0) for n in names] + [("a", "B", "9=c3", 1.0)],
        "eid string, category string, featureName string, featureValue double",
    )
    out = hierarchy.rollup_codes(tall, {"A": tree(spark)})
    assert rows(out, "category", "featureName") == [("A", "1=n0"), ("A", "1=n2"), ("A", "1=n2"), ("B", "9=c3")]
    assert rows(hierarchy.unmatched_codes(tall, {"A": tree(spark)})) == [("A", "-1", 1), ("A", "zzz", 1)]


def test_subtract_keeps_left_repeats(spark, rows):
    left = spark.createDataFrame([("x", None), ("x", None), ("y", 1), (None, None)], "a string, b int")
    right = spark.createDataFrame([("y", 1), (None, None)], "a string, b int")
    assert rows(setops.subtract_rows(left, right)) == [("x", None), ("x", None)]


def test_bag_union_keeps_repeats(spark):
    one = spark.range(3)
    assert setops.bag_union(one, one).count() == 6


cell = st.one_of(st.none(), st.integers(-3, 6).map(str))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell, cell), min_size=1, max_size=8))
def test_clean_against_plain_python(spark, data):
    table = wide(spark, [(str(i), *r) for i, r in enumerate(data)])
    got = {
        (r["eid"], r["featureName"], round(r["featureValue"], 9))
        for r in cleaning.clean(table, [ONE, TWO]).collect()
    }
    expected = set()
    known = [float(r[2]) for r in data if r[2] is not None]
    filled = [float(r[2]) if r[2] is not None else (sum(known) / len(known) if known else None) for r in data]
    kept = [v for v in filled if v is not None and v > 0]
    for i, r in enumerate(data):
        expected |= {(str(i), f"1={v}", 1.0) for v in r[:2] if v is not None}
        if filled[i] is not None and filled[i] > 0:
            expected.add((str(i), "2", round(filled[i] / max(kept), 9)))
    assert got == expected


def test_clean_plan_has_no_wide_shuffle(spark):
    """With one row per person the only exchanges carry per-feature sums."""
    table = wide(spark, [("a", "7", "8", "4")])
    out = cleaning.clean(table, [ONE, TWO], one_row_per_person=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan
    assert out.where(F.col("featureValue") <= 0).count() == 0
