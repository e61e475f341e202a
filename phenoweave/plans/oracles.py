"""The registered queries as SQL for a second engine."""

from __future__ import annotations

K = 3
ITERATIONS = 200
EPSILON = "2e-15"

WIDE = """
totals AS (SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_custkey),
wide AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS eid,
    CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '99999' ELSE c_mktsegment END AS seg0,
    CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 1 THEN 'MIXED' END AS seg1,
    CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '99999'
         ELSE CAST(c_nationkey AS VARCHAR) END AS nat0,
    CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS bal0,
    lo AS tot0, hi AS tot1,
    CASE WHEN c_custkey % 17 = 0 THEN '61' END AS death
  FROM customer LEFT JOIN totals ON c_custkey = o_custkey)"""


def _melt(source: str) -> str:
    def coded(field, column):
        return (
            f"SELECT eid, 'Demographic' AS category, '{field}=' || {column} AS \"featureName\", "
            f"CAST(1 AS DOUBLE) AS \"featureValue\", '{TYPES[field]}' AS \"featureType\" FROM {source} "
            f"WHERE {column} IS NOT NULL AND {column} <> '99999'"
        )

    def number(category, field, column):
        return (
            f"SELECT eid, '{category}', '{field}', CAST({column} AS DOUBLE), '{TYPES[field]}' FROM {source}"
        )

    parts = [
        coded("seg", "seg0"),
        coded("seg", "seg1"),
        coded("nat", "nat0"),
        number("PhysicalMeasure", "bal", "bal0"),
        number("Lifestyle", "tot", "tot0"),
        number("Lifestyle", "tot", "tot1"),
    ]
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")"


TYPES = {
    "eid": "Sequence",
    "seg": "Categorical (multiple)",
    "nat": "Categorical (single)",
    "bal": "Continuous",
    "tot": "Continuous",
    "40000": "Date",
}


def _clean(source: str = "wide") -> str:
    """CTEs ``typed``, ``stats`` and ``clean``."""
    return f"""
typed AS ({_melt(source)}),
stats AS (SELECT "featureName", avg("featureValue") AS m FROM typed
          WHERE "featureType" = 'Continuous' AND "featureValue" IS NOT NULL GROUP BY "featureName"),
imputed AS (SELECT eid, category, t."featureName", coalesce(t."featureValue", m) AS v
            FROM typed t LEFT JOIN stats s ON t."featureName" = s."featureName"),
kept AS (SELECT * FROM imputed WHERE v > 0),
clean AS (SELECT eid, category, "featureName", v / max(v) OVER (PARTITION BY category, "featureName") AS "featureValue"
          FROM kept)"""


CODED = """
bought AS (SELECT CAST(o_custkey AS VARCHAR) AS eid, p_brand, p_type, p_name, l_quantity
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
coded AS (
  SELECT eid, 'CANCER' AS category, 'brand=' || p_brand AS "featureName", CAST(1 AS DOUBLE) AS "featureValue" FROM bought
  UNION ALL SELECT eid, 'NonCancerIllness', 'type=' || p_type, 1 FROM bought
  UNION ALL SELECT eid, 'Medication', 'name=' || p_name, 1 FROM bought),
entries AS (SELECT eid, "featureName", max("featureValue") AS value FROM coded GROUP BY eid, "featureName"),
quantities AS (
  SELECT eid, "featureName", sum(l_quantity) / 50.0 AS value FROM (
    SELECT eid, 'brand=' || p_brand AS "featureName", l_quantity FROM bought
    UNION ALL SELECT eid, 'type=' || p_type, l_quantity FROM bought)
  GROUP BY eid, "featureName")"""

LABELS = """
labels AS (SELECT CAST(c_custkey AS VARCHAR) AS eid, CAST(c_nationkey % 4 AS INTEGER) AS label FROM customer)"""

ALL_ROWS = """
allrows AS (SELECT eid, category, "featureName", "featureValue" FROM clean UNION ALL SELECT * FROM coded)"""

TREE = """
paths AS (SELECT DISTINCT 'n' || c_nationkey AS n, c_mktsegment AS s, o_orderpriority AS p, o_orderstatus AS t
          FROM orders JOIN customer ON o_custkey = c_custkey),
tree AS (
  SELECT '-1' AS coding, 'r' || r_regionkey AS node_id, '0' AS parent_id, 'N' AS selectable FROM region
  UNION ALL SELECT 'c:n' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, 'Y' FROM nation
  UNION ALL SELECT DISTINCT 'c:' || n || '.' || s, n || '.' || s, n, 'Y' FROM paths
  UNION ALL SELECT DISTINCT 'c:' || n || '.' || s || '.' || p, n || '.' || s || '.' || p, n || '.' || s, 'Y' FROM paths
  UNION ALL SELECT DISTINCT 'c:' || n || '.' || s || '.' || p || '.' || t, n || '.' || s || '.' || p || '.' || t,
    n || '.' || s || '.' || p, 'Y' FROM paths),
level AS (
  SELECT node_id, 0 AS depth, node_id AS ancestor FROM tree WHERE parent_id = '0'
  UNION ALL
  SELECT t.node_id, l.depth + 1, CASE WHEN l.depth + 1 <= 2 THEN t.node_id ELSE l.ancestor END
  FROM tree t JOIN level l ON t.parent_id = l.node_id),
codes AS (SELECT coding, ancestor FROM tree JOIN level USING (node_id) WHERE selectable = 'Y'),
diagnoses AS (
  SELECT CAST(o_custkey AS VARCHAR) AS eid,
    CASE WHEN o_orderkey % 35 = 4 THEN '-1' WHEN o_orderkey % 35 = 9 THEN 'c:none' ELSE 'c:' ||
      CASE WHEN o_orderkey % 5 = 0 THEN 'n' || c_nationkey
           WHEN o_orderkey % 5 = 1 THEN 'n' || c_nationkey || '.' || c_mktsegment
           WHEN o_orderkey % 5 = 2 THEN 'n' || c_nationkey || '.' || c_mktsegment || '.' || o_orderpriority
           ELSE 'n' || c_nationkey || '.' || c_mktsegment || '.' || o_orderpriority || '.' || o_orderstatus END
    END AS code
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

DICTIONARY = """
cells AS (
  SELECT 'eid' AS "UDI", count(eid) AS n FROM wide UNION ALL SELECT 'seg-0.0', count(seg0) FROM wide
  UNION ALL SELECT 'seg-0.1', count(seg1) FROM wide UNION ALL SELECT 'nat-0.0', count(nat0) FROM wide
  UNION ALL SELECT 'bal-0.0', count(bal0) FROM wide UNION ALL SELECT 'tot-0.0', count(tot0) FROM wide
  UNION ALL SELECT 'tot-0.1', count(tot1) FROM wide UNION ALL SELECT '40000-0.0', count(death) FROM wide),
types(field, t) AS (VALUES """ + ", ".join(f"('{f}', '{t}')" for f, t in TYPES.items()) + """),
dictionary AS (SELECT "UDI", CAST(n AS INTEGER) AS "Count", t AS "Type", field
               FROM cells JOIN types ON field = split_part("UDI", '-', 1))"""

CATEGORIES = """
categories(category, field) AS (VALUES ('Demographic', 'seg'), ('Demographic', 'nat'),
  ('PhysicalMeasure', 'bal'), ('Lifestyle', 'tot'))"""

EMBEDDED = """
e AS (SELECT CAST(vec_id AS VARCHAR) AS eid, CAST(label AS INTEGER) AS label,
  list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (1 + vec_id % 3) + CASE WHEN i = 1 THEN 0.25 ELSE 0 END) AS v
  FROM embeddings)"""

CELLS = """
cells AS (SELECT CAST(eid AS BIGINT) AS row, CAST(i - 1 AS INTEGER) AS col, v[i] AS value
          FROM e, (SELECT unnest(range(1, 65)) AS i))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(p.strip() for p in parts) + " "


def _r(column: str, name: str | None = None, digits: int = 6) -> str:
    return f'round({column}, {digits}) AS "{name or column}"'


# Factorization as a recursion over whole factors: a row per round, a list per component.


def _factor_ctes(
    method: str = "multiplicative",
    l1: float = 0.0,
    l2: float = 0.0,
    k: int = K,
    iterations: int = ITERATIONS,
    source: str = "quantities",
) -> str:
    ks = range(k)
    w0 = ", ".join(f"list(((CAST(eid AS BIGINT) * 7 + {t} * 13) % 97 + 1) / 98.0::DOUBLE ORDER BY p) AS w{t}" for t in ks)
    h0 = ", ".join(
        f"list(((ascii(right(f, 1)) * 31 + length(f) * 17 + {t + 1} * 29) % 89 + 1) / 90.0::DOUBLE ORDER BY q) AS h{t}" for t in ks
    )

    def half(x, y, rows, source):
        """The factor ``x`` renewed from the other one: Gram matrix and products, then one component after the other."""
        grams = ", ".join(f"list_inner_product({y}{a}, {y}{b}) AS g{a}{b}" for a in ks for b in ks)
        products = ", ".join(f"list_transform({rows}, lambda r: list_inner_product(r, {y}{t})) AS p{t}" for t in ks)
        now = f"(SELECT *, {grams}, {products} FROM {source})"
        for t in ks:
            multiplicative = method == "multiplicative"
            terms = " + ".join(f"z[{s + 1}] * g{t}{s}" for s in ks)
            old = f"z[{t + 1}]"
            if multiplicative:
                value = f"{old} * z[{k + 1}] / ({terms} + {l1} + {l2} * {old} + {EPSILON})"
            else:
                value = f"greatest(0.0, {old} - ({terms} + {l2} * {old} - z[{k + 1}] + {l1}) / (g{t}{t} + {l2}))"
            zipped = ", ".join(f"{'u' if s < t and not multiplicative else x}{s}" for s in ks)
            now = f"(SELECT *, list_transform(list_zip({zipped}, p{t}), lambda z: {value}) AS u{t} FROM {now})"
        return now

    kept = lambda x, name: ", ".join(f"{name}{t} AS {x}{t}" for t in ks)
    ws, hs = ", ".join(f"w{t}" for t in ks), ", ".join(f"h{t}" for t in ks)
    first = f"(SELECT i, vr, vc, {kept('w', 'u')}, {hs} FROM {half('w', 'h', 'vr', f'(SELECT * FROM rounds, cells_in_lists WHERE i < {iterations})')})"
    return ", ".join(
        [
            f'v AS MATERIALIZED (SELECT eid, "featureName" AS f, value FROM {source})',
            "people AS MATERIALIZED (SELECT eid, row_number() OVER (ORDER BY eid) AS p FROM (SELECT DISTINCT eid FROM v))",
            "names AS MATERIALIZED (SELECT f, row_number() OVER (ORDER BY f) AS q FROM (SELECT DISTINCT f FROM v))",
            "every_cell AS MATERIALIZED (SELECT p, q, coalesce(value, 0.0)::DOUBLE AS x FROM people CROSS JOIN names LEFT JOIN v ON v.eid = people.eid AND v.f = names.f)",
            "cells_in_lists AS MATERIALIZED (SELECT (SELECT list(r ORDER BY p) FROM (SELECT p, list(x ORDER BY q) AS r FROM every_cell GROUP BY p)) AS vr, "
            "(SELECT list(r ORDER BY q) FROM (SELECT q, list(x ORDER BY p) AS r FROM every_cell GROUP BY q)) AS vc)",
            f"rounds AS (SELECT 0 AS i, * FROM (SELECT {w0} FROM people), (SELECT {h0} FROM names) UNION ALL "
            f"SELECT i + 1 AS i, {ws}, {kept('h', 'u')} FROM {half('h', 'w', 'vc', first)})",
            f"last_round AS MATERIALIZED (SELECT * FROM rounds WHERE i = {iterations})",
            f"w_last AS MATERIALIZED (SELECT eid, {', '.join(f'w{t}[p] AS w{t}' for t in ks)} FROM people, last_round)",
            f"h_last AS MATERIALIZED (SELECT f, {', '.join(f'h{t}[q] AS h{t}' for t in ks)} FROM names, last_round)",
        ]
    )


def _factors(**options) -> str:
    return _with(CODED, recursive=True).rstrip() + ", " + _factor_ctes(**options) + " "


LAST_W, LAST_H = "w_last", "h_last"
W_ROWS = f"SELECT eid, {', '.join(_r(f'w{t}') for t in range(K))} FROM {LAST_W}"
H_ROWS = f"SELECT f AS \"featureName\", {', '.join(_r(f'h{t}') for t in range(K))} FROM {LAST_H}"
WEIGHTS = (
    "weights AS ("
    + " UNION ALL ".join(f"SELECT {t} AS label, f AS \"featureName\", h{t} AS weight FROM {LAST_H}" for t in range(K))
    + ")"
)


def _weights() -> str:
    return _factors().rstrip() + ", " + WEIGHTS + " "


def _error_rows() -> str:
    wh = " + ".join(f"w{t}[p] * h{t}[q]" for t in range(K))
    return f"SELECT i AS iteration, 0.5 * sum((x - ({wh})) ** 2) AS e FROM rounds, every_cell WHERE i > 0 GROUP BY i"


def _counts_by_threshold() -> str:
    special = (0.0, 0.15, 0.25, 0.35, 0.6)
    default = (0.0, 0.1, 0.2, 0.3, 0.5)
    values = ", ".join(
        [f"('cancer', {t}::DOUBLE)" for t in special] + [f"('noncan', {t}::DOUBLE)" for t in default]
    )
    return (
        f"SELECT t.category, t.threshold, label, CAST(count(*) FILTER (WHERE weight > threshold) AS BIGINT) AS features "
        f"FROM (SELECT *, CASE WHEN \"featureName\" LIKE 'brand=%' THEN 'cancer' ELSE 'noncan' END AS category FROM weights) x "
        f"JOIN (VALUES {values}) t(category, threshold) ON x.category = t.category "
        "GROUP BY t.category, t.threshold, label"
    )


def _pairs(distance: str) -> str:
    """Mean distance of every person to every cluster, with and without itself."""
    return (
        "sizes AS (SELECT label, count(*) AS n FROM e GROUP BY label), "
        f"d AS (SELECT x.eid, x.label, y.label AS other, sum(CASE WHEN x.eid = y.eid THEN 0 ELSE {distance} END) AS total, "
        f"avg({distance}) AS mean FROM e x, e y GROUP BY x.eid, x.label, y.label)"
    )


SQUARED = "list_inner_product(x.v, x.v) + list_inner_product(y.v, y.v) - 2 * list_inner_product(x.v, y.v)"
COSINE = (
    "list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(y.v, y.v))"
)
STANDARD = (
    "s AS (SELECT eid, d.label, max(CASE WHEN other = d.label THEN total / nullif(n - 1, 0) END) AS a, "
    "min(CASE WHEN other <> d.label THEN total / n END) AS b, max(CASE WHEN other = d.label THEN n END) AS n "
    "FROM d JOIN sizes ON sizes.label = other GROUP BY eid, d.label), "
    "sil AS (SELECT eid, label, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM s)"
)
INCLUSIVE = (
    "s AS (SELECT eid, label, max(CASE WHEN other = label THEN mean END) AS a, "
    "min(CASE WHEN other <> label THEN mean END) AS b FROM d GROUP BY eid, label)"
)
INCLUSIVE_COSINE = (
    "s AS (SELECT eid, label, max(CASE WHEN other = label THEN mean END) AS a, "
    "avg(CASE WHEN other <> label THEN mean END) AS b FROM d GROUP BY eid, label)"
)

TALL_COLUMNS = 'eid, category, "featureName", "featureValue"'
ROUNDED_TALL = f'eid, category, "featureName", {_r("\"featureValue\"", "featureValue")}'
COUNTED = (
    'ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rows DESC, {item}) AS rank FROM counted)'
)
PERCENT = """
shares AS (
  SELECT DISTINCT lower(split_part(s."featureName", '=', 2)) AS meaning, s.label,
    CAST(held AS DOUBLE) / persons * 100 AS c, CAST(held_all AS DOUBLE) / all_persons * 100 AS p
  FROM selected s
  JOIN (SELECT label, "featureName", count(DISTINCT b.eid) AS held FROM brands b JOIN labels l ON b.eid = l.eid GROUP BY ALL) h
    ON h.label = s.label AND h."featureName" = s."featureName"
  JOIN (SELECT label, count(DISTINCT b.eid) AS persons FROM brands b JOIN labels l ON b.eid = l.eid GROUP BY label) n
    ON n.label = s.label
  JOIN (SELECT "featureName", count(DISTINCT b.eid) AS held_all FROM brands b JOIN labels l ON b.eid = l.eid GROUP BY ALL) a
    ON a."featureName" = s."featureName",
  (SELECT count(DISTINCT eid) AS all_persons FROM bought))"""
SELECTED = """
brands AS (SELECT * FROM coded WHERE category = 'CANCER'),
counted AS (SELECT label, "featureName", count(*) AS rows FROM brands JOIN labels USING (eid) GROUP BY ALL),
selected AS (SELECT label, "featureName" FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY rows DESC, split_part("featureName", '=', 2)) AS rank FROM counted)
  WHERE rank <= 10)"""
GRID = """
grid AS (SELECT c_nationkey % 3 AS k, CAST(c_custkey % 5 AS DOUBLE) AS alpha, (o_orderkey % 3) / 2.0::DOUBLE AS l1_ratio,
  avg(o_totalprice) / 30000 AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    base = _with(WIDE, _clean())
    alive = _with(WIDE + ", alive AS (SELECT * FROM wide WHERE death IS NULL)", _clean("alive"))
    every = _with(WIDE, _clean(), CODED, ALL_ROWS)
    profile = _with(WIDE, _clean(), CODED, ALL_ROWS, LABELS)
    pairs_sq = _with(EMBEDDED, _pairs(SQUARED))[:-1]
    pairs_cos = _with(EMBEDDED, _pairs(COSINE))[:-1]
    pairs_1cos = _with(EMBEDDED, _pairs(f"1 - {COSINE}"))[:-1]
    pairs_euc = _with(EMBEDDED, _pairs(f"sqrt(greatest(0, {SQUARED}))"))[:-1]
    coded_counts = (
        "counted AS (SELECT label, category AS \"group\", split_part(\"featureName\", '=', 2) AS code, count(*) AS rows "
        "FROM allrows JOIN labels USING (eid) WHERE category IN ('CANCER', 'Medication', 'NonCancerIllness') GROUP BY ALL), "
        + COUNTED.format(by='label, "group"', item="code")
    )
    named_counts = (
        "named AS (SELECT label, category AS \"group\", \"featureName\", count(*) AS rows "
        "FROM allrows JOIN labels USING (eid) WHERE category = 'Demographic' GROUP BY ALL), "
        "named_ranked AS (SELECT *, row_number() OVER (PARTITION BY label, \"group\" ORDER BY rows DESC, \"featureName\") AS rank FROM named)"
    )
    means = (
        "means AS (SELECT label, category AS \"group\", \"featureName\", avg(\"featureValue\") AS mean "
        "FROM allrows JOIN labels USING (eid) WHERE \"featureName\" IN ('bal', 'tot') GROUP BY ALL)"
    )
    rare = (
        "holders AS (SELECT category, \"featureName\", count(DISTINCT eid) AS persons, count(*) AS rows FROM allrows GROUP BY ALL), "
        "rare AS (SELECT category, avg(CASE WHEN persons < 0.5 * (SELECT count(DISTINCT eid) FROM wide) THEN 1.0 ELSE 0.0 END) * 100 AS p, "
        "count(*) AS features FROM holders GROUP BY category)"
    )
    negative = 'SELECT category, avg(CASE WHEN "featureValue" < 0 THEN 1.0 WHEN "featureValue" >= 0 THEN 0.0 END) * 100 AS p FROM typed GROUP BY category'
    top_names = (
        "counted AS (SELECT category, \"featureName\", count(*) AS rows FROM coded GROUP BY ALL), "
        + COUNTED.format(by="category", item='"featureName"')
    )
    common = (
        "items AS (SELECT CAST(o_custkey AS VARCHAR) AS eid, 'Medication' AS category, 'item=' || l_partkey AS \"featureName\", 1.0::DOUBLE AS \"featureValue\" "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
        "common AS (SELECT \"featureName\" FROM items GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 500)"
    )
    person_means = (
        "averaged AS (SELECT eid, category, \"featureName\", \"featureValue\" FROM clean WHERE category = 'Demographic' "
        "UNION ALL SELECT eid, category, \"featureName\", avg(\"featureValue\") FROM clean WHERE category <> 'Demographic' GROUP BY ALL)"
    )
    variances = (
        "n AS (SELECT count(DISTINCT eid)::DOUBLE AS n FROM {t}), "
        "var AS (SELECT \"featureName\", sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2 AS variance FROM {t}, n GROUP BY 1)"
    )
    tree = lambda rest: _with(TREE, recursive=True) + rest
    argmax = (
        "CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END"
    )
    return {
        "dict_type_fill": _with(WIDE, DICTIONARY) + 'SELECT "UDI", "Count", "Type" FROM dictionary',
        "dict_fields": _with(WIDE, DICTIONARY) + "SELECT DISTINCT field FROM dictionary",
        "category_fields": _with(WIDE, DICTIONARY, CATEGORIES)
        + 'SELECT category, field, CAST(sum("Count") AS BIGINT) AS filled FROM categories JOIN dictionary USING (field) GROUP BY ALL',
        "field_partition": _with(WIDE, DICTIONARY, CATEGORIES)
        + "SELECT DISTINCT category, field, \"Type\" LIKE 'Categorical%' AS categorical FROM categories JOIN dictionary USING (field)",
        "wide_subset": _with(WIDE) + "SELECT eid, seg0 AS seg_0_0, seg1 AS seg_0_1, nat0 AS nat_0_0 FROM wide",
        "melt_tall": base + f'SELECT {TALL_COLUMNS}, "featureType" FROM typed',
        "melt_tall_repeated_persons": base + f'SELECT {TALL_COLUMNS}, "featureType" FROM typed',
        "exclude_persons": alive + f'SELECT {TALL_COLUMNS}, "featureType" FROM typed',
        "subtract_rows": _with(CODED)
        + "SELECT eid, \"featureName\", count(*) AS rows FROM coded c WHERE category = 'CANCER' AND NOT EXISTS ("
        "SELECT 1 FROM coded g WHERE g.\"featureName\" LIKE 'brand=Brand#1%' AND g.eid IS NOT DISTINCT FROM c.eid "
        "AND g.\"featureName\" IS NOT DISTINCT FROM c.\"featureName\") GROUP BY ALL",
        "impute_mean": base + f'SELECT eid, category, "featureName", {_r("v", "featureValue")} FROM imputed WHERE v IS NOT NULL',
        "max_scale": base
        + 'SELECT eid, category, "featureName", round("featureValue" / max("featureValue") OVER (PARTITION BY category, "featureName"), 6) '
        'AS "featureValue" FROM typed WHERE "featureValue" > 0',
        "clean_tall": base + f"SELECT {ROUNDED_TALL} FROM clean",
        "clean_tall_alive": alive + f"SELECT {ROUNDED_TALL} FROM clean",
        "rollup_codes": tree(
            "SELECT eid, 'diag=' || ancestor AS \"featureName\", count(*) AS rows FROM diagnoses JOIN codes ON code = coding GROUP BY ALL"
        ),
        "rollup_unmatched": tree(
            "SELECT 'NonCancerIllness' AS category, code, count(*) AS dropped_rows FROM diagnoses "
            "WHERE code NOT IN (SELECT coding FROM codes) GROUP BY ALL"
        ),
        "hierarchy_levels": tree("SELECT node_id, depth, ancestor FROM level"),
        "stage_roundtrip": base
        + f'SELECT eid, "featureName", {_r("\"featureValue\"", "featureValue")} FROM clean',
        "hierarchy_file": tree("SELECT coding, node_id, parent_id, selectable FROM tree"),
        "meanings_file": tree(
            "SELECT node_id AS code, coalesce(r_name, n_name, node_id) AS meaning FROM tree "
            "LEFT JOIN region ON node_id = 'r' || r_regionkey LEFT JOIN nation ON node_id = 'n' || n_nationkey"
        ),
        "traits_file": "SELECT CAST(o_custkey AS VARCHAR) AS \"Indiv\", round(avg(o_totalprice), 6) AS mean_price, "
        "round(max(o_totalprice), 6) AS max_price, round(count(*)::DOUBLE, 6) AS orders FROM orders GROUP BY o_custkey",
        "result_file": _with(CODED) + 'SELECT "featureName", sum(value) AS frequency FROM entries GROUP BY 1',
        "population": "SELECT count(DISTINCT c_custkey) AS population FROM customer",
        "unique_features": every
        + 'SELECT category, count(DISTINCT "featureName") AS features FROM allrows GROUP BY category',
        "top5_features": _with(CODED, top_names) + 'SELECT category, "featureName", rows, rank FROM ranked WHERE rank <= 5',
        "pct_negative": base + f"SELECT category, {_r('p', 'pct_negative')} FROM ({negative})",
        "pct_rare": _with(WIDE, _clean(), CODED, ALL_ROWS, rare) + f"SELECT category, {_r('p', 'pct_rare')} FROM rare",
        "stats_report": _with(WIDE, _clean(), CODED, ALL_ROWS, rare, top_names)
        + "SELECT 'population' AS metric, NULL::VARCHAR AS category, NULL::VARCHAR AS feature, "
        "round(count(DISTINCT eid)::DOUBLE, 6) AS value FROM wide "
        "UNION ALL SELECT 'unique_features', category, NULL, features::DOUBLE FROM rare "
        "UNION ALL SELECT 'top_' || rank, category, \"featureName\", rows::DOUBLE FROM ranked WHERE rank <= 5 "
        f"UNION ALL SELECT 'pct_negative', category, NULL, round(p, 6) FROM ({negative}) "
        "UNION ALL SELECT 'pct_rare', category, NULL, round(p, 6) FROM rare",
        "categorical_features": base + f"SELECT {TALL_COLUMNS} FROM typed WHERE category = 'Demographic'",
        "numeric_person_mean": base.rstrip() + ", " + person_means + f" SELECT {ROUNDED_TALL} FROM averaged",
        "top500_keep": _with(common)
        + 'SELECT eid, "featureName", count(*) AS rows FROM items WHERE "featureName" IN (SELECT "featureName" FROM common) GROUP BY ALL',
        "feature_union": _with(WIDE, _clean(), CODED, common, person_means)
        + 'SELECT eid, category, "featureName", count(*) AS rows, round(sum("featureValue"), 6) AS total FROM ('
        f"SELECT {TALL_COLUMNS} FROM coded WHERE category <> 'Medication' UNION ALL "
        f"SELECT {TALL_COLUMNS} FROM items WHERE \"featureName\" IN (SELECT \"featureName\" FROM common) "
        f"UNION ALL SELECT {TALL_COLUMNS} FROM averaged) GROUP BY eid, category, \"featureName\"",
        "feature_frequency": _with(CODED)
        + 'SELECT "featureName", round(sum(value), 6) AS frequency FROM quantities GROUP BY 1',
        "feature_index": _with(CODED)
        + 'SELECT "featureName", row_number() OVER (ORDER BY "featureName") - 1 AS feature FROM (SELECT DISTINCT "featureName" FROM entries)',
        "matrix_coo": _with(CODED)
        + 'SELECT eid, feature, value FROM entries JOIN (SELECT "featureName", row_number() OVER (ORDER BY "featureName") - 1 AS feature '
        'FROM (SELECT DISTINCT "featureName" FROM entries)) USING ("featureName")',
        "variance_select": _with(CODED, variances.format(t="entries"))
        + 'SELECT eid, "featureName", value FROM entries JOIN var USING ("featureName") WHERE variance > 0.9 * (1 - 0.9)',
        "feature_variances": _with(CODED, variances.format(t="quantities"))
        + f'SELECT "featureName", {_r("variance")} FROM var',
        "cluster_top10_codes": profile.rstrip() + ", " + coded_counts
        + ' SELECT label, "group", code, rows, rank FROM ranked WHERE rank <= 10',
        "cluster_top10_features": profile.rstrip() + ", " + named_counts
        + ' SELECT label, "group", "featureName", rows, rank FROM named_ranked WHERE rank <= 10',
        "cluster_numeric_means": profile.rstrip() + ", " + means
        + f' SELECT label, "group", "featureName", {_r("mean")} FROM means',
        "cluster_profile": profile.rstrip() + ", " + ", ".join([coded_counts, named_counts, means])
        + " SELECT label, \"group\" AS category, string_agg(code, '|' ORDER BY rank) AS items FROM ranked WHERE rank <= 10 GROUP BY 1, 2 "
        "UNION ALL SELECT label, \"group\" || '(Categorical)', string_agg(\"featureName\", '|' ORDER BY rank) FROM named_ranked WHERE rank <= 10 GROUP BY 1, 2 "
        "UNION ALL SELECT label, \"group\" || '(Non-Categorical)', string_agg(\"featureName\" || ':' || CAST(round(mean, 3) AS VARCHAR), '|') FROM means GROUP BY 1, 2",
        "feature_pct_cluster_vs_pop": _with(CODED, LABELS, SELECTED, PERCENT)
        + f"SELECT meaning, label, {_r('c', 'percentFeatureInCluster')}, {_r('p', 'percentFeatureInPop')} FROM shares",
        "feature_pct_pivot": _with(CODED, LABELS, SELECTED, PERCENT)
        + "SELECT meaning, "
        + ", ".join(
            f"round(coalesce(max(c) FILTER (WHERE label = {i}), 0), 6) AS \"percentFeatureInCluster{i}\"" for i in range(4)
        )
        + ', round(max(p), 6) AS "percentFeatureInPop" FROM shares GROUP BY meaning',
        "left_matched": "SELECT round(avg(o_totalprice), 6) AS mean_price, round(max(o_totalprice), 6) AS max_price, "
        "round(count(*)::DOUBLE, 6) AS orders, any_value(CAST(c_nationkey % 4 AS INTEGER)) AS cluster "
        "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 < 2 GROUP BY o_custkey",
        "trait_means": "SELECT CAST(c_nationkey % 4 AS INTEGER) AS cluster, round(avg(a), 6) AS mean_price, round(avg(b), 6) AS max_price, "
        "round(avg(n), 6) AS orders FROM (SELECT o_custkey, avg(o_totalprice) AS a, max(o_totalprice) AS b, count(*) AS n "
        "FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "matrix_product": _with(EMBEDDED, CELLS)
        + "SELECT a.col AS row, b.col AS col, round(sum(a.value * b.value), 6) AS value FROM cells a JOIN cells b ON a.row = b.row GROUP BY 1, 2",
        "matrix_rows_times_local": _with(EMBEDDED, CELLS)
        + "SELECT CAST(row AS VARCHAR) AS eid, "
        + ", ".join(f"round(sum(value * ((col + {t}) % 5)), 6) AS s{t}" for t in range(3))
        + " FROM cells GROUP BY row",
        "matrix_sparse_product": _with(CODED)
        + "SELECT eid AS row, p_type AS col, round(sum(value * n), 6) AS value FROM quantities "
        "JOIN (SELECT 'brand=' || p_brand AS b, p_type, count(*) AS n FROM part GROUP BY ALL) ON b = \"featureName\" GROUP BY ALL",
        "matrix_elementwise": _with(EMBEDDED, CELLS)
        + f"SELECT row, col, round(value * (abs(value) + 1), 6) AS product, round(value / (abs(value) + 1 + {EPSILON}), 6) AS quotient FROM cells",
        "matrix_transpose": _with(EMBEDDED, CELLS) + "SELECT col AS row, row AS col, round(value, 6) AS value FROM cells",
        "nmf_factors_w": _factors() + W_ROWS,
        "nmf_factors_h": _factors() + H_ROWS,
        "nmf_error": _factors()
        + f"SELECT iteration, round(e, 4) AS half_squared, round(sqrt(2 * e), 4) AS frobenius FROM ({_error_rows()})",
        "nmf_assign": _factors() + f"SELECT eid, {argmax} AS label FROM {LAST_W}",
        "nmf_penalized_w": _factors(l1=0.5, l2=0.25) + W_ROWS,
        "nmf_coordinate_w": _factors(method="coordinate", l1=0.05, l2=0.05) + W_ROWS,
        "nmf_coordinate_h": _factors(method="coordinate", l1=0.05, l2=0.05) + H_ROWS,
        "component_counts": _weights()
        + "SELECT label, count(*) FILTER (WHERE weight > 0.25) AS features FROM weights GROUP BY label",
        "component_mean_count": _weights()
        + "SELECT avg(features) AS avg_nonzero_feature_count FROM (SELECT label, count(*) FILTER (WHERE weight > 0.25) AS features FROM weights GROUP BY label)",
        "nonzero_features": _weights()
        + f'SELECT label, "featureName", {_r("weight")} FROM weights WHERE weight > 0.25',
        "threshold_counts": _weights() + _counts_by_threshold(),
        "info_table": _weights()
        + "SELECT label, CASE WHEN \"featureName\" LIKE 'brand=%' THEN 'CANCER' ELSE 'NonCancerIllness' END AS category, "
        f"lower(split_part(\"featureName\", '=', 2)) AS meaning, {_r('weight')} FROM weights WHERE weight > 0.1",
        "stanmf_dissimilarity": _with(EMBEDDED)
        + "SELECT round(abs(6 - ("
        + " + ".join(["greatest(" + ", ".join(f"c{i}{j}" for j in range(3)) + ")" for i in range(3)]
                     + ["greatest(" + ", ".join(f"c{i}{j}" for i in range(3)) + ")" for j in range(3)])
        + ")) / 3, 6) AS dissimilarity FROM (SELECT "
        + ", ".join(f"corr(v[{i + 1}], v[{j + 4}]) AS c{i}{j}" for i in range(3) for j in range(3))
        + " FROM e)",
        "silhouette_ref": f"{pairs_sq}, {INCLUSIVE} SELECT eid, label, {_r('a')}, {_r('b')}, round((b - a) / greatest(a, b), 6) AS score FROM s",
        "silhouette_ref_mean": f"{pairs_sq}, {INCLUSIVE} SELECT round(avg((b - a) / greatest(a, b)), 6) AS score FROM s",
        "cosine_score": f"{pairs_cos}, {INCLUSIVE_COSINE} SELECT round(avg((a - b) / greatest(a, b)), 6) AS score FROM s",
        "cosine_persons": f"{pairs_cos}, {INCLUSIVE_COSINE} SELECT eid, label, {_r('a')}, {_r('b')} FROM s",
        "silhouette_cosine": f"{pairs_1cos}, {STANDARD} SELECT eid, label, {_r('silhouette')} FROM sil",
        "silhouette_sqeuclidean": f"{pairs_sq}, {STANDARD} SELECT eid, label, {_r('silhouette')} FROM sil",
        "silhouette_euclidean": f"{pairs_euc}, {STANDARD} SELECT eid, label, {_r('silhouette')} FROM sil",
        "silhouette_estimated": f"{pairs_euc}, {STANDARD} SELECT eid, label, {_r('silhouette')}, 0.0::DOUBLE AS error FROM sil",
        "silhouette_bands": f"{pairs_1cos}, {STANDARD} SELECT eid, label, {_r('silhouette')}, "
        "CAST(row_number() OVER (ORDER BY label, round(silhouette, 12), eid) - 1 + 10 * dense_rank() OVER (ORDER BY label) AS BIGINT) AS y FROM sil",
        "grid_accepted": _with(GRID)
        + f"SELECT k, alpha, l1_ratio, {_r('n', 'avg_nonzero_feature_count')} FROM grid WHERE n BETWEEN 5 AND 10",
        "grid_pivot": _with(GRID)
        + "SELECT alpha, "
        + ", ".join(f"round(max(n) FILTER (WHERE l1_ratio = {r}), 6) AS l1_{i}" for i, r in enumerate((0.0, 0.5, 1.0)))
        + " FROM grid WHERE k = 1 GROUP BY alpha",
        "phenotypes": _with(
            CODED,
            variances.format(t="entries"),
            'chosen AS (SELECT e.* FROM entries e JOIN var USING ("featureName") WHERE variance > 0.99 * (1 - 0.99))',
            _factor_ctes(k=4, source="chosen"),
            'strongest AS (SELECT eid, greatest(w0, w1, w2, w3) AS top, w0, w1, w2 FROM w_last)',
            "labels AS (SELECT eid, CASE WHEN w0 = top OR top IS NULL THEN 0 WHEN w1 = top THEN 1 WHEN w2 = top THEN 2 ELSE 3 END AS label "
            "FROM (SELECT DISTINCT eid FROM bought) LEFT JOIN strongest USING (eid))",
            "brands AS (SELECT * FROM coded WHERE category = 'CANCER')",
            "selected AS ("
            + " UNION ALL ".join(f'SELECT {t} AS label, f AS "featureName" FROM h_last WHERE h{t} > 0.5' for t in range(4))
            + ")",
            PERCENT,
            recursive=True,
        )
        + f"SELECT meaning, label, {_r('c', 'percentFeatureInCluster')}, {_r('p', 'percentFeatureInPop')} FROM shares",
        "best_brand": _with(CODED)
        + 'SELECT "featureName", sum(value) AS frequency FROM entries WHERE "featureName" LIKE \'brand=%\' GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1',
    }
