"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.functions.names import base_field
from phenoweave.operators import (
    cleaning,
    clusters,
    components,
    features,
    hierarchy,
    matrix,
    nmf,
    profiles,
    quality,
    setops,
    stability,
    statistics,
    svd,
    sweeps,
)
from phenoweave.plans import roles
from phenoweave.session import cut_lineage, ensure_checkpoint_dir, stored
from phenoweave.sources import delimited, lookups, tall as tall_files

DIGITS = 6
NMF_K = 3
CATEGORY_BY_FIELD = {"brand": "cancer", "type": "noncan"}
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# Sources and cleaning


def dict_type_fill(spark, d):
    return lookups.baseline_dictionary(roles.raw_dictionary(spark, d)).select("UDI", "Count", "Type")


def dict_fields(spark, d):
    return lookups.dictionary_fields(lookups.baseline_dictionary(roles.raw_dictionary(spark, d)))


def _types(spark, d):
    return lookups.field_types(lookups.baseline_dictionary(roles.raw_dictionary(spark, d)))


def category_fields(spark, d):
    """Fields of each category with their filled cells in the export."""
    counts = (
        lookups.baseline_dictionary(roles.raw_dictionary(spark, d))
        .groupBy(base_field("UDI").alias("field"))
        .agg(F.sum("Count").alias("filled"))
    )
    return lookups.category_fields(roles.category_map(spark)).join(counts, "field").select(
        "category", "field", "filled"
    )


def field_partition(spark, d):
    return lookups.field_partition(lookups.category_fields(roles.category_map(spark)), _types(spark, d))


def wide_subset(spark, d):
    kept = cleaning.subset(roles.wide(spark, d), roles.FIELD_CATEGORIES["Demographic"])
    return kept.toDF(*[c.replace("-", "_").replace(".", "_") for c in kept.columns])


def _typed(spark, d, *categories):
    return cleaning.melt(roles.wide(spark, d), roles.fields(*categories), one_row_per_person=True)


def melt_tall(spark, d):
    return _typed(spark, d)


def melt_tall_repeated_persons(spark, d):
    """The same for an export that may list a person twice."""
    wide = roles.wide(spark, d)
    return cleaning.melt(wide.unionByName(wide), roles.fields())


def exclude_persons(spark, d):
    alive = cleaning.exclude_deceased(roles.wide(spark, d))
    return cleaning.melt(alive, roles.fields(), one_row_per_person=True)


def subtract_rows(spark, d):
    bought = roles.coded(spark, d).select("eid", "featureName")
    gone = bought.where(F.col("featureName").startswith("brand=Brand#1"))
    left = setops.subtract_rows(bought.where(F.col("featureName").startswith("brand=")), gone)
    return left.groupBy("eid", "featureName").agg(F.count("*").alias("rows"))


def impute_mean(spark, d):
    filled = cleaning.impute_mean(_typed(spark, d))
    return rounded(filled.drop("featureType"), "featureValue")


def max_scale(spark, d):
    kept = cleaning.positive_only(_typed(spark, d))
    return rounded(cleaning.max_scale(kept).drop("featureType"), "featureValue")


def _clean(spark, d, **options):
    return cleaning.clean(roles.wide(spark, d), roles.fields(), one_row_per_person=True, **options)


def clean_tall(spark, d):
    return rounded(_clean(spark, d), "featureValue")


def clean_tall_alive(spark, d):
    return rounded(_clean(spark, d, drop_deceased=True), "featureValue")


def rollup_codes(spark, d):
    tree = {"NonCancerIllness": roles.hierarchy(spark, d)}
    rolled = hierarchy.rollup_codes(roles.diagnoses(spark, d), tree)
    return rolled.groupBy("eid", "featureName").agg(F.count("*").alias("rows"))


def rollup_unmatched(spark, d):
    tree = {"NonCancerIllness": roles.hierarchy(spark, d)}
    return hierarchy.unmatched_codes(roles.diagnoses(spark, d), tree)


def hierarchy_levels(spark, d):
    return hierarchy.ancestors(roles.hierarchy(spark, d))


def stage_roundtrip(spark, d):
    """Export to text, load, clean, store by category, reload."""
    folder = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    roles.raw_wide(spark, d).write.option("header", True).csv(f"{folder}/export.csv")
    wide = delimited.load_raw(spark, f"{folder}/export.csv")

    def build():
        return cleaning.clean(wide, roles.fields(), one_row_per_person=True)

    kinds = tuple(sorted({f.category for f in roles.fields()}))
    tall_files.stage(spark, f"{folder}/clean", build, kinds)
    stored = tall_files.stage(spark, f"{folder}/clean", build, kinds)
    tall_files.write_tall_csv(stored, f"{folder}/clean.csv")
    return rounded(tall_files.read_tall_csv(spark, f"{folder}/clean.csv"), "featureValue")


def _file(spark, df, name):
    """``df`` as a tab-separated file with a header in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}/{name}.tsv"
    df.write.option("header", True).option("sep", "\t").csv(path)
    return path


def hierarchy_file(spark, d):
    path = _file(spark, roles.hierarchy(spark, d), "tree")
    return lookups.load_hierarchy(spark, path)


def meanings_file(spark, d):
    path = _file(spark, roles.hierarchy(spark, d), "meanings")
    return lookups.load_meanings(spark, path, "node_id")


def traits_file(spark, d):
    scores = lookups.load_trait_scores(spark, _file(spark, roles.traits(spark, d), "scores"))
    return rounded(scores, "mean_price", "max_price", "orders")


def result_file(spark, d):
    """A result table written as text and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}/frequency"
    tall_files.write_result(features.feature_frequency(roles.entries(spark, d)), path)
    return delimited.load_table(spark, path).select(
        "featureName", F.col("frequency").cast("double").alias("frequency")
    )


# Statistics and feature shaping


def _all_rows(spark, d):
    """Clean rows of the measured categories with the coded ones."""
    return setops.bag_union(_clean(spark, d), roles.coded(spark, d))


def population(spark, d):
    return statistics.population(roles.wide(spark, d))


def unique_features(spark, d):
    return statistics.unique_features(_all_rows(spark, d))


def top5_features(spark, d):
    top = statistics.top_features(roles.coded(spark, d), 5)
    return top.select("category", "featureName", "rows", F.col("rank").cast("long").alias("rank"))


def pct_negative(spark, d):
    return rounded(statistics.percent_negative(_typed(spark, d)), "pct_negative")


def pct_rare(spark, d):
    rare = statistics.percent_rare(_all_rows(spark, d), roles.wide(spark, d), threshold=0.5)
    return rounded(rare, "pct_rare")


def stats_report(spark, d):
    report = statistics.statistics_report(
        roles.wide(spark, d),
        _typed(spark, d),
        _all_rows(spark, d),
        threshold=0.5,
        top_categories=list(features.MODEL_CATEGORIES),
    )
    return rounded(report, "value")


def categorical_features(spark, d):
    return features.categorical_rows(_typed(spark, d), dict_fields(spark, d)).drop("featureType")


def numeric_person_mean(spark, d):
    return rounded(features.person_means(_clean(spark, d), dict_fields(spark, d)), "featureValue")


def top500_keep(spark, d):
    kept = features.keep_most_common(roles.items(spark, d))
    return kept.groupBy("eid", "featureName").agg(F.count("*").alias("rows"))


def feature_union(spark, d):
    others = _all_rows(spark, d).where(F.col("category") != "Medication")
    rows = features.model_features(setops.bag_union(others, roles.items(spark, d)), dict_fields(spark, d))
    return rounded(
        rows.groupBy("eid", "category", "featureName").agg(
            F.count("*").alias("rows"), F.sum("featureValue").alias("total")
        ),
        "total",
    )


def feature_frequency(spark, d):
    return rounded(features.feature_frequency(roles.quantities(spark, d)), "frequency")


def feature_index(spark, d):
    return features.feature_index(roles.entries(spark, d))


def matrix_coo(spark, d):
    return features.indexed_entries(roles.entries(spark, d))


def variance_select(spark, d):
    """Entries that survive the selection at share 0.9."""
    return features.variance_select(roles.entries(spark, d), 0.9)


def feature_variances(spark, d):
    return rounded(features.feature_variances(roles.quantities(spark, d)), "variance")


# Profiles


def _fields_table(spark):
    rows = [(f.category, f.field, cleaning.is_categorical_type(f.type)) for f in roles.fields()]
    rows += [(category, field, True) for field, category in roles.CODED_CATEGORIES.items()]
    return spark.createDataFrame(rows, "category string, field string, categorical boolean")


def cluster_top10_codes(spark, d):
    top = profiles.top_codes(_all_rows(spark, d), roles.assignment(spark, d), _fields_table(spark))
    return top.withColumn("rank", F.col("rank").cast("long"))


def cluster_top10_features(spark, d):
    top = profiles.top_categorical(_all_rows(spark, d), roles.assignment(spark, d), _fields_table(spark))
    return top.withColumn("rank", F.col("rank").cast("long"))


def cluster_numeric_means(spark, d):
    means = profiles.numeric_means(_all_rows(spark, d), roles.assignment(spark, d), _fields_table(spark))
    return rounded(means, "mean")


def cluster_profile(spark, d):
    profile = profiles.cluster_profile(
        _all_rows(spark, d), roles.assignment(spark, d), _fields_table(spark), digits=3
    )
    return profile.select("label", F.explode("profile").alias("p")).select(
        "label", "p.category", F.array_join("p.items", "|").alias("items")
    )


def _percentages(spark, d):
    every = stored(roles.coded(spark, d).select("eid", "category", "featureName", "featureValue"), "coded")
    coded = every.where(F.col("category") == "CANCER")
    labels = roles.assignment(spark, d)
    chosen = profiles.top_codes(coded, labels, _fields_table(spark)).select(
        "label", F.concat(F.lit("brand="), "code").alias("featureName")
    )
    decode = roles.meanings(spark, d).where(F.col("field") == "brand")
    persons = every.agg(F.countDistinct("eid")).first()[0]
    return profiles.cluster_percentages(coded, labels, chosen, decode, persons)


def feature_pct_cluster_vs_pop(spark, d):
    return rounded(_percentages(spark, d), "percentFeatureInCluster", "percentFeatureInPop")


def feature_pct_pivot(spark, d):
    table = profiles.percentage_pivot(_percentages(spark, d), [0, 1, 2, 3])
    return rounded(table, *[c for c in table.columns if c != "meaning"])


def left_matched(spark, d):
    kept = roles.assignment(spark, d).where("label < 2")
    return rounded(profiles.matched_traits(roles.traits(spark, d), kept), "mean_price", "max_price", "orders")


def trait_means(spark, d):
    means = profiles.trait_means(roles.traits(spark, d), roles.assignment(spark, d))
    return rounded(means, "mean_price", "max_price", "orders")


# Matrix algebra


def _cells(spark, d):
    return roles.embedding_entries(spark, d).select(
        F.col("eid").cast("long").alias("row"), F.col("feature").alias("col"), "value"
    )


def matrix_product(spark, d):
    """Transposed matrix times matrix: the 64 x 64 products of the embeddings' columns."""
    cells = _cells(spark, d)
    entries = cells.select(F.col("row").cast("string").alias("eid"), F.col("col").alias("featureName"), "value")
    w = roles.embeddings(spark, d).select("eid", F.col("vector").alias("w"))
    with matrix.held(entries) as m:
        product = cut_lineage(matrix.column_products(m, w, 64))
    long = product.select(F.col("featureName").alias("row"), F.posexplode("s").alias("col", "value"))
    return rounded(long, "value")


def matrix_rows_times_local(spark, d):
    """Matrix times a narrow feature table: three weights per coordinate."""
    with matrix.held(roles.embedding_entries(spark, d).withColumnRenamed("feature", "featureName")) as m:
        h = m.entries.select("featureName").distinct().select(
            "featureName",
            F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: ((F.col("featureName") + t) % 5).cast("double")).alias("h"),
        )
        product = cut_lineage(matrix.row_products(m, h, 3))
    return rounded(nmf.spread(product, "s", 3), "s0", "s1", "s2")


def matrix_sparse_product(spark, d):
    """Product of two sparse tables: persons x brands times brands x types."""
    left = roles.quantities(spark, d).where(F.col("featureName").startswith("brand=")).select(
        F.col("eid").alias("row"), F.col("featureName").alias("col"), "value"
    )
    right = (
        roles.table(spark, d, "part")
        .groupBy(F.concat(F.lit("brand="), "p_brand").alias("row"), F.col("p_type").alias("col"))
        .agg(F.count("*").cast("double").alias("value"))
    )
    return rounded(matrix.multiply_entries(left, right), "value")


def matrix_elementwise(spark, d):
    cells = _cells(spark, d)
    other = matrix.absolute_entries(cells).withColumn("value", F.col("value") + 1.0)
    product = matrix.elementwise(cells, other, "product").withColumnRenamed("value", "product")
    quotient = matrix.elementwise(cells, other, "quotient").withColumnRenamed("value", "quotient")
    return rounded(product.join(quotient, ["row", "col"]), "product", "quotient")


def matrix_transpose(spark, d):
    return rounded(matrix.transpose_entries(_cells(spark, d)), "value")


# Factorization


def _w_start(key, width):
    return F.expr(
        f"transform(sequence(0, {width - 1}), t -> cast((cast({key} AS bigint) * 7 + t * 13) % 97 + 1 AS double) / 98D)"
    )


def _h_start(key, width):
    return F.expr(
        f"transform(sequence(0, {width - 1}), t -> "
        f"cast((ascii(right({key}, 1)) * 31 + length({key}) * 17 + (t + 1) * 29) % 89 + 1 AS double) / 90D)"
    )


def _factors(spark, d, **options):
    options = {"w_start": _w_start, "h_start": _h_start, **options}
    return nmf.factorize(roles.quantities(spark, d), NMF_K, **options)


def _wide_factor(df, column):
    names = [f"{column}{t}" for t in range(NMF_K)]
    return rounded(nmf.spread(df, column, NMF_K), *names)


def nmf_factors_w(spark, d):
    return _wide_factor(_factors(spark, d).w, "w")


def nmf_factors_h(spark, d):
    return _wide_factor(_factors(spark, d).h, "h")


def nmf_error(spark, d):
    """Half squared error and Frobenius error after each iteration."""
    rows = [
        (i + 1, e[0], float((2 * e[0]) ** 0.5)) for i, e in enumerate(_factors(spark, d).errors)
    ]
    return spark.createDataFrame(rows, "iteration int, half_squared double, frobenius double").select(
        "iteration", F.round("half_squared", 4).alias("half_squared"), F.round("frobenius", 4).alias("frobenius")
    )


def nmf_assign(spark, d):
    return nmf.assign(_factors(spark, d))


def nmf_penalized_w(spark, d):
    return _wide_factor(_factors(spark, d, l1=0.5, l2=0.25).w, "w")


def nmf_coordinate_w(spark, d):
    return _wide_factor(_factors(spark, d, method="coordinate", l1=0.05, l2=0.05).w, "w")


def nmf_coordinate_h(spark, d):
    return _wide_factor(_factors(spark, d, method="coordinate", l1=0.05, l2=0.05).h, "h")


def nmf_regularized(spark, d):
    """Penalized factorization from the SVD start: weights per component."""
    factors = nmf.factorize_regularized(roles.entries(spark, d), 4, alpha=1.0, l1_ratio=0.5)
    return nmf.component_weights(factors)


def nmf_error_curve(spark, d):
    return nmf.error_curve(roles.entries(spark, d), 4)


def _weights(spark, d):
    return nmf.component_weights(_factors(spark, d))


def component_counts(spark, d):
    return components.count_above(_weights(spark, d), 0.25)


def component_mean_count(spark, d):
    return components.mean_above(_weights(spark, d), 0.25)


def nonzero_features(spark, d):
    return rounded(components.strong_features(_weights(spark, d), 0.25), "weight")


def threshold_counts(spark, d):
    return components.threshold_counts(
        _weights(spark, d),
        CATEGORY_BY_FIELD,
        thresholds=(0.0, 0.1, 0.2, 0.3, 0.5),
        special={"cancer": (0.0, 0.15, 0.25, 0.35, 0.6)},
    )


def info_table(spark, d):
    decode = roles.meanings(spark, d).where("field != 'name'")
    return rounded(components.info_table(_weights(spark, d), decode), "weight")


# Clustering


def _vectors(spark, d):
    return roles.embeddings(spark, d).select("eid", array_to_vector("vector").alias("features"))


def _entry_vectors(spark, d):
    return features.to_vectors(roles.entries(spark, d))


def bkm_assign(spark, d):
    vectors = _entry_vectors(spark, d)
    return clusters.assignments(clusters.bisecting_kmeans(vectors), vectors)


def bkm_cost(spark, d):
    cost = clusters.cost(clusters.bisecting_kmeans(_vectors(spark, d)))
    return spark.createDataFrame([(clusters.DEFAULT_K, cost)], "k int, error double")


def bkm_sweep(spark, d):
    return clusters.error_by_k(_vectors(spark, d))


def bkm_tree(spark, d):
    """Labels at the largest k of the sweep, from the same tree."""
    vectors = _vectors(spark, d)
    return clusters.split_tree(vectors).labels(vectors, max(clusters.SWEEP))


def pca_project(spark, d):
    vectors = _vectors(spark, d)
    labels = clusters.assignments(clusters.bisecting_kmeans(vectors), vectors)
    return clusters.pca_project(vectors, labels)


def svd_project(spark, d):
    return svd.svd_project(roles.entries(spark, d), roles.assignment(spark, d))


def stanmf_dissimilarity(spark, d):
    """Three coordinates of the embeddings against the next three."""
    rows = roles.embeddings(spark, d)
    first = rows.select("eid", F.slice("vector", 1, 3).alias("w"))
    second = rows.select("eid", F.slice("vector", 4, 3).alias("w"))
    return rounded(stability.dissimilarity(first, second, 3), "dissimilarity")


def stanmf_table(spark, d):
    return stability.stability_table(roles.quantities(spark, d))


def stanmf_select(spark, d):
    """Assignment by the best run of the most stable k."""
    factors, _ = stability.stable_factorization(roles.quantities(spark, d))
    return nmf.assign(factors)


# Quality and searches


def _scores(spark, d, score, **options):
    return score(
        roles.embedding_entries(spark, d).withColumnRenamed("feature", "featureName"),
        roles.embeddings(spark, d).select("eid", "label"),
        **options,
    )


def silhouette_ref(spark, d):
    return rounded(_scores(spark, d, quality.silhouette_self_inclusive), "a", "b", "score")


def silhouette_ref_mean(spark, d):
    return rounded(
        _scores(spark, d, quality.silhouette_self_inclusive).agg(F.avg("score").alias("score")), "score"
    )


def cosine_score(spark, d):
    return rounded(_scores(spark, d, quality.cosine_persons).agg(F.avg("score").alias("score")), "score")


def cosine_persons(spark, d):
    return rounded(_scores(spark, d, quality.cosine_persons).select("eid", "label", "a", "b"), "a", "b")


def silhouette_cosine(spark, d):
    return rounded(_scores(spark, d, quality.silhouette_persons, metric="cosine"), "silhouette")


def silhouette_sqeuclidean(spark, d):
    return rounded(_scores(spark, d, quality.silhouette_persons, metric="sqeuclidean"), "silhouette")


def silhouette_euclidean(spark, d):
    return rounded(_scores(spark, d, quality.silhouette_persons, metric="euclidean"), "silhouette")


def silhouette_estimated(spark, d):
    """Euclidean silhouette of every person, exact where no cluster has more persons than the sample."""
    scored = _scores(spark, d, quality.silhouette_estimated)
    return rounded(scored, "silhouette", "error")


def silhouette_bands(spark, d):
    persons = _scores(spark, d, quality.silhouette_persons, metric="cosine")
    return rounded(sweeps.silhouette_bands(persons), "silhouette")


def silhouette_sampled(spark, d):
    """Plain Euclidean silhouette of 300 persons, the way the sweeps sample."""
    return _scores(spark, d, quality.silhouette_persons, metric="euclidean", sample=300)


def k_vs_silhouette(spark, d):
    return sweeps.silhouette_by_k(roles.quantities(spark, d))


def optimal_k(spark, d):
    return sweeps.optimal_k(roles.quantities(spark, d))


def grid_search(spark, d):
    return sweeps.grid_search(roles.quantities(spark, d))


def _order_grid(spark, d):
    """A settings table of the grid's shape: figures of the orders per nation group."""
    return (
        roles.table(spark, d, "orders")
        .join(roles.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            (F.col("c_nationkey") % 3).alias("k"),
            (F.col("c_custkey") % 5).cast("double").alias("alpha"),
            (F.col("o_orderkey") % 3 / F.lit(2.0)).alias("l1_ratio"),
        )
        .agg((F.avg("o_totalprice") / 30000).alias("avg_nonzero_feature_count"))
    )


def grid_accepted(spark, d):
    return rounded(sweeps.accepted(_order_grid(spark, d)), "avg_nonzero_feature_count")


def grid_pivot(spark, d):
    table = sweeps.grid_pivot(_order_grid(spark, d), 1, [0.0, 0.5, 1.0])
    return rounded(table, "l1_0", "l1_1", "l1_2")


def silhouette_chart(spark, d):
    """Chart rows for every k that the sweep draws."""
    return sweeps.silhouette_charts(roles.quantities(spark, d))


def best_brand(spark, d):
    """The sweep's final pick on real figures: most frequent, the later name on ties."""
    table = features.feature_frequency(roles.entries(spark, d)).where(F.col("featureName").startswith("brand="))
    return sweeps.best_of(table, "frequency", "featureName")


def phenotypes(spark, d):
    """From purchases to phenotypes: matrix, factorization, assignment, decoded shares."""
    coded = stored(roles.coded(spark, d), "coded")
    every = stored(features.matrix_entries(coded), "entries")
    people = every.select("eid").distinct()  # before selection, which may leave some without entries
    entries = features.variance_select(every, 0.99)
    factors = nmf.factorize(entries, 4, w_start=_w_start, h_start=_h_start)
    labels = nmf.assign(factors, people)
    strong = components.strong_features(nmf.component_weights(factors), 0.5)
    decode = roles.meanings(spark, d).where(F.col("field") == "brand")
    persons = people.count()
    brands = coded.where(F.col("category") == "CANCER")
    return rounded(
        profiles.cluster_percentages(brands, labels, strong, decode, persons),
        "percentFeatureInCluster",
        "percentFeatureInPop",
    )


ALL: tuple[Query, ...] = (
    dict_type_fill,
    dict_fields,
    category_fields,
    field_partition,
    wide_subset,
    melt_tall,
    melt_tall_repeated_persons,
    exclude_persons,
    subtract_rows,
    impute_mean,
    max_scale,
    clean_tall,
    clean_tall_alive,
    rollup_codes,
    rollup_unmatched,
    hierarchy_levels,
    stage_roundtrip,
    hierarchy_file,
    meanings_file,
    traits_file,
    result_file,
    population,
    unique_features,
    top5_features,
    pct_negative,
    pct_rare,
    stats_report,
    categorical_features,
    numeric_person_mean,
    top500_keep,
    feature_union,
    feature_frequency,
    feature_index,
    matrix_coo,
    variance_select,
    feature_variances,
    cluster_top10_codes,
    cluster_top10_features,
    cluster_numeric_means,
    cluster_profile,
    feature_pct_cluster_vs_pop,
    feature_pct_pivot,
    left_matched,
    trait_means,
    matrix_product,
    matrix_rows_times_local,
    matrix_sparse_product,
    matrix_elementwise,
    matrix_transpose,
    nmf_factors_w,
    nmf_factors_h,
    nmf_error,
    nmf_assign,
    nmf_penalized_w,
    nmf_coordinate_w,
    nmf_coordinate_h,
    nmf_regularized,
    nmf_error_curve,
    component_counts,
    component_mean_count,
    nonzero_features,
    threshold_counts,
    info_table,
    bkm_assign,
    bkm_cost,
    bkm_sweep,
    bkm_tree,
    pca_project,
    svd_project,
    stanmf_dissimilarity,
    stanmf_table,
    stanmf_select,
    silhouette_ref,
    silhouette_ref_mean,
    cosine_score,
    cosine_persons,
    silhouette_cosine,
    silhouette_sqeuclidean,
    silhouette_euclidean,
    silhouette_estimated,
    silhouette_bands,
    silhouette_sampled,
    k_vs_silhouette,
    optimal_k,
    grid_search,
    grid_accepted,
    grid_pivot,
    silhouette_chart,
    best_brand,
    phenotypes,
)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in ALL}
