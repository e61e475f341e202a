from phenoweave.functions.names import view_name_of
from phenoweave.operators.cleaning import Field, melt
from phenoweave.sources import delimited, lookups, tall


def test_view_names():
    assert view_name_of("data/feature.csv") == "feature"
    assert view_name_of("data/MEDICATIONS/part-00000") == "00000"
    assert view_name_of("data/codes.tsv") == "tsv"
    assert view_name_of("???") == "???"


def test_load_registers_view_and_keeps_strings(spark, tmp_path, rows):
    path = tmp_path / "people.csv"
    path.write_text("eid,1-0.0\n1,007\n2,\n")
    table = delimited.load_table(spark, str(path))
    assert [t for _, t in table.dtypes] == ["string", "string"]
    assert rows(spark.table("people")) == [("1", "007"), ("2", None)]


def test_baseline_columns_only(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("eid,1-0.0,1-0.1,1-1.0,2-0.0\n1,a,b,c,d\n")
    assert delimited.load_raw(spark, str(path)).columns == ["eid", "1-0.0", "1-0.1", "2-0.0"]


def test_category_file_with_carriage_returns(spark, tmp_path, rows):
    path = tmp_path / "feature.csv"
    path.write_bytes(b"CANCER,Lifestyle\r20001,1239\r,1249\r")
    fields = lookups.category_fields(delimited.load_table(spark, str(path)))
    assert rows(fields) == [("CANCER", "20001"), ("Lifestyle", "1239"), ("Lifestyle", "1249")]


def test_dictionary_fills_blank_types(spark, rows):
    raw = spark.createDataFrame(
        [
            ("0", "eid", "5", "Sequence", None),
            ("1", "1-0.0", "5", "Categorical (single)", "x"),
            ("2", "1-0.1", "4", "", None),
            ("3", "1-1.0", "4", None, None),
            ("4", "2-0.0", "bad", None, None),
        ],
        "Colnum string, UDI string, `Count` string, Type string, Description string",
    )
    known = lookups.baseline_dictionary(raw)
    assert rows(known) == [
        (0, "eid", 5, "Sequence", ""),
        (1, "1-0.0", 5, "Categorical (single)", "x"),
        (2, "1-0.1", 4, "Categorical (single)", ""),
        (4, "2-0.0", None, "", ""),
    ]
    assert rows(lookups.dictionary_fields(known)) == [("1",), ("2",), ("eid",)]


def test_field_partition(spark, rows):
    categories = spark.createDataFrame([("A", "1"), ("A", "2")], "category string, field string")
    types = spark.createDataFrame(
        [("1", "Categorical (multiple)"), ("2", "Integer")], "field string, featureType string"
    )
    assert rows(lookups.field_partition(categories, types)) == [("A", "1", True), ("A", "2", False)]


def test_tab_separated_lookups(spark, tmp_path, rows):
    tree = tmp_path / "tree.tsv"
    tree.write_text("coding\tmeaning\tnode_id\tparent_id\tselectable\n-1\ttop\t10\t0\tN\n7\tleaf\t11\t10\tY\n")
    assert rows(lookups.load_hierarchy(spark, str(tree))) == [("-1", "10", "0", "N"), ("7", "11", "10", "Y")]
    assert rows(lookups.load_meanings(spark, str(tree), "node_id")) == [("10", "top"), ("11", "leaf")]
    scores = tmp_path / "scores.txt"
    scores.write_text("Indiv\theight\tb.m.i\n1\t0.5\t1\n2\tx\t2\n")
    assert rows(lookups.load_trait_scores(spark, str(scores))) == [("1", 0.5, 1.0), ("2", None, 2.0)]


def test_tall_files_round_trip(spark, tmp_path, rows):
    data = spark.createDataFrame(
        [("1", "a=1", 1.0, "A"), ("2", "b", 0.5, "B")],
        "eid string, featureName string, featureValue double, category string",
    ).repartition(3)
    tall.write_tall_csv(data, str(tmp_path / "t.csv"))
    assert rows(tall.read_tall_csv(spark, str(tmp_path / "t.csv"))) == [("1", "a=1", 1.0), ("2", "b", 0.5)]
    tall.write_tall(data, str(tmp_path / "t"))
    assert rows(tall.read_tall(spark, str(tmp_path / "t"), "B"), "eid", "featureName") == [("2", "b")]
    tall.write_result(data.select("eid", "category"), str(tmp_path / "r"))
    assert rows(delimited.load_table(spark, str(tmp_path / "r"), "r")) == [("1", "A"), ("2", "B")]


def test_bucketed_table_joins_without_shuffling_rows(spark, tmp_path):
    data = spark.range(100).selectExpr(
        "cast(id % 10 AS string) AS eid", "'a' AS featureName", "1D AS featureValue", "'A' AS category"
    )
    tall.write_tall_table(data, "bucketed_tall", str(tmp_path / "b"), 4)
    labels = data.select("eid").distinct().repartition(4, "eid").hint("merge")
    joined = spark.table("bucketed_tall").hint("merge").join(labels, "eid")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("bucketed_tall")]
    assert joined.count() == 100
    assert "Exchange" not in scan.split("SortMergeJoin")[1]


def test_stage_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame(
            [("1", "a", 1.0, "A")], "eid string, featureName string, featureValue double, category string"
        )

    for _ in range(2):
        assert tall.stage(spark, str(tmp_path / "s"), build).count() == 1
    assert len(calls) == 1


def test_dotted_names_survive_melt(spark, rows):
    wide = spark.createDataFrame([("1", "x")], ["eid", "1-0.0"])
    out = melt(wide, [Field("A", "1", "Categorical (single)")])
    assert rows(out, "featureName") == [("1=x",)]


def test_stage_is_built_again_when_a_category_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "f", 1.0, "X"), ("b", "g", 2.0, "Y")], tall.TALL_SCHEMA + ", category string")
    path = str(tmp_path / "s")
    assert tall.stage(spark, path, lambda: rows.where("category = 'X'"), ("X",)).count() == 1
    assert tall.stage(spark, path, lambda: rows, ("X", "Y")).count() == 2
    assert tall.stage(spark, path, lambda: 1 / 0, ("X", "Y")).count() == 2
