import pytest

from phenoweave.operators import components, features, numbering, profiles, sizing, statistics
from pyspark.sql import functions as F

TALL = "eid string, category string, featureName string, featureValue double"


def tall(spark, data):
    return spark.createDataFrame(data, TALL)


def people(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("eid"))


def test_population_counts_distinct(spark):
    raw = people(spark, 5)
    assert statistics.population(raw.union(raw)).first()[0] == 5


def rarity(spark):
    held = {"f1": 1, "f2": 2, "f3": 3}
    return tall(spark, [(str(i), "A", f, 1.0) for f, n in held.items() for i in range(n) for _ in range(2)])


def test_rarity_is_strict(spark, rows):
    out = statistics.percent_rare(rarity(spark), people(spark, 10), 0.2)
    assert [(c, round(p, 2)) for c, p in rows(out)] == [("A", 33.33)]


def test_rarity_per_category(spark, rows):
    data = rarity(spark).union(tall(spark, [(str(i), "B", "g", 1.0) for i in range(9)]))
    out = statistics.percent_rare(data, people(spark, 10), 0.2)
    assert [(c, round(p, 2)) for c, p in rows(out)] == [("A", 33.33), ("B", 0.0)]


def test_percent_negative(spark, rows):
    out = statistics.percent_negative(tall(spark, [("1", "A", "f", v) for v in (-1.0, 2.0, 0.0, 3.0)]))
    assert rows(out) == [("A", 25.0)]


def test_top_n_ties_by_name(spark, rows):
    data = tall(spark, [("1", "A", f, 1.0) for f in "xxxbbaa"])
    assert rows(statistics.top_features(data, 2), "featureName", "rows", "rank") == [("a", 2, 2), ("x", 3, 1)]
    assert rows(statistics.unique_features(data)) == [("A", 3)]


def test_report_holds_every_metric(spark):
    data = rarity(spark)
    report = statistics.statistics_report(people(spark, 10), data, data, 0.2)
    values = {(r["metric"], r["category"], r["feature"]): r["value"] for r in report.collect()}
    assert values[("population", None, None)] == 10
    assert values[("unique_features", "A", None)] == 3
    assert values[("top_1", "A", "f3")] == 6
    assert values[("pct_negative", "A", None)] == 0
    assert round(values[("pct_rare", "A", None)], 2) == 33.33


def test_person_means_and_vocabulary(spark, rows):
    data = tall(spark, [("1", "A", "2", 1.0), ("1", "A", "2", 3.0), ("1", "A", "1=7", 1.0), ("1", "A", "1=7", 1.0)])
    fields = spark.createDataFrame([("1",), ("2",)], "field string")
    assert rows(features.person_means(data, fields), "featureName", "featureValue") == [
        ("1=7", 1.0), ("1=7", 1.0), ("2", 2.0)
    ]
    assert features.categorical_rows(data, fields).count() == 2
    assert features.numeric_rows(data, fields).count() == 2


def test_keep_most_common(spark, rows):
    data = tall(spark, [("1", "M", f, 1.0) for f in "xxxbbaa"])
    assert rows(features.keep_most_common(data, 2).select("featureName").distinct()) == [("a",), ("x",)]


def test_matrix_entries_and_index(spark, rows):
    data = tall(spark, [("1", "CANCER", "b", 0.5), ("1", "CANCER", "b", 0.7), ("2", "Medication", "a", 1.0), ("2", "Other", "c", 1.0)])
    entries = features.matrix_entries(data)
    assert rows(entries) == [("1", "b", 0.7), ("2", "a", 1.0)]
    assert rows(features.matrix_entries(data, None).select("featureName")) == [("a",), ("b",), ("c",)]
    assert rows(features.feature_index(entries)) == [("a", 0), ("b", 1)]
    assert rows(features.indexed_entries(entries)) == [("1", 1, 0.7), ("2", 0, 1.0)]
    assert rows(features.feature_frequency(entries)) == [("a", 1.0), ("b", 0.7)]


@pytest.mark.parametrize("persons,kept", [(2001, ["f2"]), (1999, ["f1", "f2"])])
def test_variance_selection(spark, persons, kept):
    everyone = people(spark, persons)
    # a constant column keeps every person in the matrix
    entries = (
        everyone.withColumn("featureName", F.lit("all"))
        .union(everyone.where("eid < 1").withColumn("featureName", F.lit("f1")))
        .union(everyone.where("eid < 3").withColumn("featureName", F.lit("f2")))
        .withColumn("value", F.lit(1.0))
    )
    out = features.selected_features(entries).select("featureName").collect()
    assert sorted(r[0] for r in out) == kept


def test_vectors_are_sparse(spark):
    entries = spark.createDataFrame(
        [("1", "b", 0.5), ("1", "a", 2.0), ("2", "c", 3.0)], "eid string, featureName string, value double"
    )
    got = {r["eid"]: r["features"] for r in features.to_vectors(entries).collect()}
    assert got["1"].size == 3 and got["1"].toArray().tolist() == [2.0, 0.5, 0.0]
    assert got["2"].indices.tolist() == [2]


def test_number_rows_over_partitions(spark):
    data = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = numbering.number_rows(data, [F.col("x")], "n").collect()
    assert all(r["x"] == r["n"] for r in got) and len(got) == 1000


def test_broadcast_is_sized(spark):
    frame = spark.range(3)
    assert "broadcast" in sizing.sized(frame, 3)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in sizing.sized(frame, 10**9)._jdf.queryExecution().toString().lower()
    assert sizing.partitions_for(spark, 10**12) == 250_000
    assert sizing.partitions_for(spark, 10) == 2


def test_hot_person_and_hot_feature(spark, rows):
    """A third of the rows are one person's repeats, another third one feature's."""
    hot = spark.range(3000).select(F.lit("hot").alias("eid"), F.lit("CANCER").alias("category"), F.lit("1=x").alias("featureName"))
    wide = spark.range(3000).select(F.col("id").cast("string").alias("eid"), F.lit("CANCER").alias("category"), F.lit("1=y").alias("featureName"))
    rest = spark.range(3000).select(
        F.col("id").cast("string").alias("eid"), F.lit("CANCER").alias("category"), F.concat(F.lit("1=z"), F.col("id") % 10).alias("featureName")
    )
    data = hot.union(wide).union(rest).withColumn("featureValue", F.lit(1.0))
    summary = {r["featureName"]: (r["rows"], r["persons"]) for r in statistics.feature_summary(data).collect()}
    assert summary["1=x"] == (3000, 1) and summary["1=y"] == (3000, 3000) and summary["1=z3"] == (300, 300)
    entries = features.matrix_entries(data)
    assert entries.count() == 6001
    assert rows(features.feature_frequency(entries).where("featureName = '1=x'")) == [("1=x", 1.0)]
    numbered = numbering.number_rows(data, [F.col("featureName"), F.col("eid")], "n")
    assert numbered.select("n").distinct().count() == 9000
    labels = data.select("eid").distinct().withColumn("label", (F.col("eid") == "hot").cast("int"))
    fields = spark.createDataFrame(FIELDS, "category string, field string, categorical boolean")
    top = profiles.top_codes(data, labels, fields).where("rank = 1")
    assert rows(top, "label", "code", "rows") == [(0, "y", 3000), (1, "x", 3000)]


FIELDS = [("CANCER", "1", True), ("Lifestyle", "2", False), ("Lifestyle", "3", True)]


def test_profile(spark, rows):
    data = tall(
        spark,
        [("p", "CANCER", "1=x", 1.0), ("q", "CANCER", "1=y", 1.0), ("q", "CANCER", "1=y", 1.0),
         ("p", "Lifestyle", "2", 0.5), ("q", "Lifestyle", "2", 1.0), ("p", "Lifestyle", "3=4", 1.0),
         ("z", "CANCER", "1=x", 1.0), ("p", "?", "unknown=1", 1.0)],
    )
    labels = spark.createDataFrame([("p", 0), ("q", 0)], "eid string, label int")
    fields = spark.createDataFrame(FIELDS, "category string, field string, categorical boolean")
    out = profiles.cluster_profile(data, labels, fields).collect()
    assert [(r["label"], [(p["category"], p["items"]) for p in r["profile"]]) for r in out] == [
        (0, [("CANCER", ["y", "x"]), ("Lifestyle(Categorical)", ["3=4"]), ("Lifestyle(Non-Categorical)", ["2:0.75"])])
    ]


def test_profile_lists_stop_at_ten(spark):
    data = tall(spark, [("p", "CANCER", f"1=c{i:02d}", 1.0) for i in range(15) for _ in range(20 - i)])
    labels = spark.createDataFrame([("p", 3)], "eid string, label int")
    fields = spark.createDataFrame(FIELDS, "category string, field string, categorical boolean")
    items = profiles.cluster_profile(data, labels, fields).first()["profile"][0]["items"]
    assert items == [f"c{i:02d}" for i in range(10)]


def test_percentages(spark, rows):
    held = [("a", 0), ("b", 0), ("e", 1)]
    data = tall(spark, [(p, "CANCER", "1=x", 1.0) for p, _ in held for _ in range(2)]
                + [(p, "CANCER", "1=y", 1.0) for p in "abcdefgh"])
    labels = spark.createDataFrame([(p, 0) for p in "abcd"] + [(p, 1) for p in "efgh"], "eid string, label int")
    chosen = spark.createDataFrame([(0, "1=x")], "label int, featureName string")
    meanings = spark.createDataFrame([("x", "lung"), ("q", "none")], "code string, meaning string")
    out = profiles.cluster_percentages(data, labels, chosen, meanings, 8)
    assert rows(out) == [("lung", 0, 50.0, 37.5)]
    pivot = profiles.percentage_pivot(out, [0, 1])
    assert rows(pivot, "meaning", "percentFeatureInCluster0", "percentFeatureInCluster1", "percentFeatureInPop") == [
        ("lung", 50.0, 0.0, 37.5)
    ]


def test_trait_means(spark, rows):
    traits = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("z", 9.0)], "Indiv string, t double")
    labels = spark.createDataFrame([("a", 0), ("b", 0)], "eid string, label int")
    assert rows(profiles.matched_traits(traits, labels)) == [(1.0, 0), (3.0, 0)]
    assert rows(profiles.trait_means(traits, labels), "cluster", "t") == [(0, 2.0)]


def weights(spark, data):
    return spark.createDataFrame(data, "label int, featureName string, weight double")


def test_component_tables(spark, rows):
    w = weights(spark, [(0, "20001=a", 0.0), (1, "20001=a", 2.0), (0, "20003=1120001", 0.05), (1, "20003=1120001", 0.5)])
    assert rows(components.count_above(w, 0.1)) == [(0, 0), (1, 2)]
    assert components.mean_above(w, 0.1).first()[0] == 1.0
    # an empty component does not shift the next one's label
    assert rows(components.strong_features(w, 1.0), "label") == [(1,)]
    counts = {(r["category"], r["threshold"], r["label"]): r["features"] for r in components.threshold_counts(w).collect()}
    assert counts[("med", 0.01, 0)] == 1 and counts[("med", 0.1, 0)] == 0
    assert counts[("cancer", 0.0, 0)] == 0 and counts[("cancer", 0.05, 1)] == 1
    assert ("cancer", 0.1, 1) not in counts and ("noncan", 0.0, 0) not in counts


def test_category_by_exact_field(spark, rows):
    w = weights(spark, [(0, "20003=1120001", 1.0), (0, "20001=5", 1.0), (0, "20002=5", 1.0)])
    assert rows(w.select("featureName", components.category_of("featureName").alias("c"))) == [
        ("20001=5", "cancer"), ("20002=5", "noncan"), ("20003=1120001", "med")
    ]


def test_info_table_keeps_fields_apart(spark, rows):
    w = weights(spark, [(0, "1=7", 0.5), (0, "2=7", 0.05), (1, "2=7", 0.3)])
    meanings = spark.createDataFrame(
        [("A", "1", "7", "seven"), ("B", "2", "7", "other")], "category string, field string, code string, meaning string"
    )
    assert rows(components.info_table(w, meanings)) == [(0, "A", "seven", 0.5), (1, "B", "other", 0.3)]


def test_summary_is_dealt_by_persons(spark, monkeypatch):
    """Groups of a feature and person are spread by the number of persons, with no map of all of a mapper's groups before."""
    monkeypatch.setattr(statistics, "PERSONS_PER_TASK", 2)
    data = spark.createDataFrame([("a", f"f{i % 3}", f"p{i % 40}") for i in range(240)], "category string, featureName string, eid string")
    assert statistics.dealt(data, 40).rdd.getNumPartitions() == 20
    plan = statistics.feature_summary(data, 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    got = {r["featureName"]: (r["rows"], r["persons"]) for r in statistics.feature_summary(data, 40).collect()}
    assert got == {f"f{i}": (80, 40) for i in range(3)}


def test_index_reads_entries_once(spark, monkeypatch):
    """What the entries are made of runs once, for the numbers and for the join."""
    ran = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            ran.add(len(frame))
            yield frame

    schema = "eid string, featureName string, value double"
    made = spark.createDataFrame([(f"p{i}", f"f{i % 4}", float(i)) for i in range(12)], schema).mapInPandas(counted, schema)
    got = {(r["eid"], r["feature"], r["value"]) for r in features.indexed_entries(made).collect()}
    assert got == {(f"p{i}", i % 4, float(i)) for i in range(12)} and ran.value == 12
    assert features.to_vectors(made).count() == 12 and ran.value == 24
