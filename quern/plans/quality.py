"""Data quality and leakage audit queries."""

from pyspark.sql import functions as F

from quern.operators import quality as Q
from quern.plans import bind as B
from quern.registry import query

S = B.SURVEY
ALL = ("id", "total", "acct", "day", "seg", "prio", "nation", "cust", "target")


def _overview(name, src, cols, rate):
    miss = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cols)
    return f"""SELECT '{name}' AS dataset, count(*) AS n_rows, {len(cols)} AS n_cols, {rate} AS target_rate, CAST({miss} AS BIGINT) AS missing_cells,
  count(*) - count(DISTINCT {cols[0]}) AS duplicate_ids, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {src})) AS duplicate_rows FROM {src}"""


LI = ("l_orderkey", "l_linenumber", "l_returnflag", "y")


@query(
    "dataset_overview",
    f"""WITH {S}, li AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_linestatus = 'F' AS INT) AS y FROM lineitem)
{_overview('lines', 'li', LI, 'avg(y)')} UNION ALL {_overview('survey', 'survey', ALL, 'CAST(NULL AS DOUBLE)')}""",
    f="target_rate",
)
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("y"))
    a = Q.dataset_overview({"lines": li}, "l_orderkey", "y")
    return a.unionByName(Q.dataset_overview({"survey": B.survey(t)}, "id"))


def _dtype(c):
    return {"id": "bigint", "cust": "bigint", "total": "double", "acct": "double", "day": "int", "nation": "int"}.get(c, "string")


@query(
    "schema_summary",
    f"""WITH {S} {' UNION ALL '.join(f"""SELECT '{c}' AS "column", '{'categorical' if c in ('seg', 'prio', 'target') else 'numeric'}' AS role, '{_dtype(c)}' AS dtype,
  (SELECT count(*) FILTER ({c} IS NULL) FROM train) AS missing, (SELECT 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) FROM train) AS missing_pct,
  (SELECT count(DISTINCT {c}) FROM train) AS "unique", (SELECT count(*) FILTER ({c} IS NULL) FROM test) AS missing_2,
  (SELECT 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) FROM test) AS missing_pct_2, (SELECT count(DISTINCT {c}) FROM test) AS unique_2""" for c in ALL)}""",
    f="missing_pct missing_pct_2",
)
def _(t):
    return Q.schema_summary(*B.splits(t))


@query(
    "constant_columns",
    f"""WITH {S}, x AS (SELECT *, 1 AS one FROM survey) {' UNION ALL '.join(f"""SELECT '{c}' AS "column", n AS n_values, CAST(n <= 1 AS INT) AS is_constant, CAST(n <= 3 AS INT) AS is_low
FROM (SELECT count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)) AS n FROM x)""" for c in (*ALL, 'one'))}""",
)
def _(t):
    return Q.constant_columns(B.survey(t).withColumn("one", F.lit(1)))


@query(
    "integrity_checks",
    f"""WITH {S}, tr AS (SELECT * FROM survey WHERE id % 5 <> 0 UNION ALL SELECT * FROM survey WHERE id % 1000 = 1),
te AS (SELECT * FROM survey WHERE id % 5 = 0 OR id % 500 = 3), sa AS (SELECT id FROM survey WHERE id % 5 = 0 OR id % 900 = 4)
SELECT 'train_duplicate_ids' AS "check", count(*) - count(DISTINCT id) AS n FROM tr
UNION ALL SELECT 'test_duplicate_ids', count(*) - count(DISTINCT id) FROM te
UNION ALL SELECT 'train_test_overlap', count(DISTINCT id) FROM tr WHERE id IN (SELECT id FROM te)
UNION ALL SELECT 'test_not_in_sample', count(*) FROM te WHERE id NOT IN (SELECT id FROM sa)
UNION ALL SELECT 'sample_not_in_test', count(*) FROM sa WHERE id NOT IN (SELECT id FROM te)
UNION ALL SELECT 'train_duplicate_rows', (SELECT count(*) FROM tr) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tr))""",
)
def _(t):
    s = B.survey(t)
    train = s.where("id % 5 <> 0").unionAll(s.where("id % 1000 = 1"))
    return Q.integrity_checks(train, s.where("id % 5 = 0 OR id % 500 = 3"), s.where("id % 5 = 0 OR id % 900 = 4").select("id"), "id")


@query("require_columns", "SELECT count(*) AS n_rows FROM orders")
def _(t):
    ok = Q.require_columns(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"], unique="o_orderkey", not_null=["o_custkey", "o_totalprice"])
    return ok.agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "join_validate",
    """WITH r AS (SELECT p_partkey AS k, count(*) AS k2 FROM part WHERE p_size <= 40 GROUP BY 1), l AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS left_rows, CAST(sum(n * coalesce(k2, 1)) AS BIGINT) AS joined_rows, CAST(sum(CASE WHEN k2 IS NULL THEN n ELSE 0 END) AS BIGINT) AS unmatched_left,
  count(*) FILTER (n > 1) AS repeated_left_keys, (SELECT count(*) FILTER (k2 > 1) FROM r) AS repeated_right_keys,
  CAST((SELECT count(*) FILTER (k2 > 1) FROM r) = 0 AND sum(n * coalesce(k2, 1)) = sum(n) AS INT) AS valid FROM l LEFT JOIN r USING (k)""",
)
def _(t):
    return Q.join_validate(
        t.lineitem.select(F.col("l_partkey").alias("k")), t.part.where("p_size <= 40").select(F.col("p_partkey").alias("k")), "k"
    )


@query(
    "cross_split_row_overlap",
    """WITH a AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS x, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS f FROM lineitem WHERE l_orderkey % 5 <> 0),
b AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS x, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS f FROM lineitem WHERE l_orderkey % 5 = 0),
ca AS (SELECT q, d, x, f, count(*) AS n_a FROM a GROUP BY ALL), cb AS (SELECT q, d, x, f, count(*) AS n_b FROM b GROUP BY ALL)
SELECT ca.q, ca.d, ca.x, ca.f, n_a, n_b FROM ca JOIN cb ON ca.q = cb.q AND ca.d = cb.d AND ca.x = cb.x AND ca.f IS NOT DISTINCT FROM cb.f""",
)
def _(t):
    li = t.lineitem.select(
        "l_orderkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"),
        F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("f"),
    )
    return Q.cross_split_overlap(li.where("l_orderkey % 5 <> 0"), li.where("l_orderkey % 5 = 0"), ["q", "d", "x", "f"])


EV_A = "SELECT user_id, event_id, value AS v, CASE WHEN event_id % 4 > 0 THEN value * 2 END AS w FROM events"
EV_B = "SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value + 0.5 ELSE value END AS v, CASE WHEN event_id % 8 > 0 THEN value * 2 END AS w FROM events"


@query(
    "column_match_rate",
    f"""WITH a AS ({EV_A}), b AS ({EV_B}), j AS (SELECT a.user_id, 'v' AS "column", a.v AS x, b.v AS y FROM a JOIN b USING (event_id)
  UNION ALL SELECT a.user_id, 'w', a.w, b.w FROM a JOIN b USING (event_id))
SELECT user_id, "column", count(*) AS n_rows, avg(CAST(coalesce(abs(x - y) <= 0.1, x IS NULL AND y IS NULL) AS INT)) AS match_rate, max(abs(x - y)) AS max_abs_diff FROM j GROUP BY 1, 2""",
    f="match_rate max_abs_diff",
)
def _(t):
    e, k = t.events, F.col("event_id")
    a = e.select("user_id", "event_id", F.col("value").alias("v"), F.when(k % 4 > 0, F.col("value") * 2).alias("w"))
    b = e.select("user_id", "event_id", F.when(k % 3 == 0, F.col("value") + 0.5).otherwise(F.col("value")).alias("v"), F.when(k % 8 > 0, F.col("value") * 2).alias("w"))
    return Q.column_match_rate(a, b, "user_id", "event_id", ["v", "w"], tol=0.1)


@query(
    "column_set_diff",
    """WITH c AS (SELECT count(c_custkey) AS k, count(c_name) AS n, count(c_nationkey) AS x, count(c_acctbal) AS b, count(c_mktsegment) AS m FROM customer),
s AS (SELECT count(s_suppkey) AS k, count(s_name) AS n, count(s_nationkey) AS x, count(s_acctbal) AS b FROM supplier)
SELECT 'c_custkey' AS "column", c.k AS values_a, NULL::BIGINT AS values_b, 'only_a' AS side FROM c UNION ALL SELECT 'c_name', c.n, NULL, 'only_a' FROM c
UNION ALL SELECT 'c_acctbal', c.b, NULL, 'only_a' FROM c UNION ALL SELECT 'c_mktsegment', c.m, NULL, 'only_a' FROM c UNION ALL SELECT 'nationkey', c.x, s.x, 'both' FROM c, s
UNION ALL SELECT 's_suppkey', NULL, s.k, 'only_b' FROM s UNION ALL SELECT 's_name', NULL, s.n, 'only_b' FROM s UNION ALL SELECT 's_acctbal', NULL, s.b, 'only_b' FROM s""",
)
def _(t):
    return Q.column_set_diff(t.customer.withColumnRenamed("c_nationkey", "nationkey"), t.supplier.withColumnRenamed("s_nationkey", "nationkey"))


@query(
    "missing_summary",
    f"""WITH {S} {' UNION ALL '.join(f"""SELECT '{c}' AS "column", a AS train_pct, b AS test_pct, b - a AS delta_points
FROM (SELECT 100.0::DOUBLE * avg(CAST({c} IS NULL AS INT)) AS a FROM train), (SELECT 100.0::DOUBLE * avg(CAST({c} IS NULL AS INT)) AS b FROM test)""" for c in ('total', 'acct', 'seg'))}""",
    f="train_pct test_pct delta_points",
)
def _(t):
    return Q.missing_summary(*B.splits(t), ["total", "acct", "seg"])


@query(
    "missing_by_target",
    f"""WITH {S}, x AS ({' UNION ALL '.join(f"""SELECT '{c}' AS "column", {', '.join(f"100.0::DOUBLE * avg(CAST({c} IS NULL AS INT)) FILTER (target = '{k}') AS miss_{k}" for k in B.CLASSES)} FROM survey""" for c in ('total', 'acct', 'seg'))})
SELECT *, greatest(miss_F, miss_O, miss_P) - least(miss_F, miss_O, miss_P) AS spread FROM x""",
    f="miss_F miss_O miss_P spread",
)
def _(t):
    return Q.missing_by_target(B.survey(t), ["total", "acct", "seg"], "target", B.CLASSES)


@query(
    "missing_signal",
    f"""WITH {S}, l AS ({B.sql_long(('total', 'acct', 'seg'), 'survey', 'target', 'v', 'VARCHAR', '"column"')}),
c AS (SELECT "column", CASE WHEN v IS NULL THEN 'missing' ELSE 'present' END AS state, target, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT "column", state, target, n, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY "column", state) AS share_pct,
  round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY "column", state) - 100.0::DOUBLE * sum(n) OVER (PARTITION BY "column", target) / sum(n) OVER (PARTITION BY "column"), 9) AS lift_points FROM c""",
    f="share_pct lift_points",
)
def _(t):
    return Q.missing_signal(B.survey(t), ["total", "acct", "seg"], "target").withColumn("lift_points", F.round("lift_points", 9))


@query(
    "sentinel_report",
    f"""WITH {S}, x AS (SELECT CASE WHEN id % 50 = 0 THEN -999.0 ELSE acct END AS acct, CASE WHEN id % 70 = 0 THEN 9999.0 ELSE total END AS total FROM survey),
l AS ({B.sql_long(('acct', 'total'), 'x', '', 'v', 'DOUBLE', '"column"')})
SELECT "column", count(*) FILTER (v IN (-9999, -999, 9999, 99, -99)) AS n_sentinel,
  count(*) FILTER (v < CASE "column" WHEN 'acct' THEN 0 ELSE 5000 END OR v > CASE "column" WHEN 'acct' THEN 9000 ELSE 400000 END) AS n_outside, min(v) AS min, max(v) AS max FROM l GROUP BY 1""",
)
def _(t):
    s = B.survey(t)
    x = s.select(
        F.when(F.col("id") % 50 == 0, -999.0).otherwise(F.col("acct")).alias("acct"),
        F.when(F.col("id") % 70 == 0, 9999.0).otherwise(F.col("total")).alias("total"),
    )
    return Q.sentinel_report(x, {"acct": (0, 9000), "total": (5000, 400000)})


@query(
    "iqr_outliers",
    f"""WITH l AS (SELECT 'value' AS "column", value AS v FROM events UNION ALL SELECT 'k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events),
q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1),
b AS (SELECT "column", q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT "column", lower, upper, count(*) FILTER (v < lower OR v > upper) AS n_outliers, 100.0::DOUBLE * avg(CAST(v < lower OR v > upper AS INT)) AS pct FROM l JOIN b USING ("column") GROUP BY 1, 2, 3""",
    f="lower upper pct",
)
def _(t):
    e = t.events.select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return Q.iqr_outliers(e, ["value", "k"])


@query(
    "id_alignment",
    """WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey % 97 <> 0),
b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey % 89 <> 0)
SELECT count(*) FILTER (b.pos IS NULL) AS missing, count(*) FILTER (a.pos IS NULL) AS extra, count(*) FILTER (a.pos <> b.pos) AS displaced,
  CAST(count(*) FILTER (b.pos IS NULL OR a.pos IS NULL OR a.pos <> b.pos) = 0 AS INT) AS same_order FROM a FULL JOIN b USING (id)""",
)
def _(t):
    from quern.functions.ordered import numbered

    ids = t.orders.select(F.col("o_orderkey").alias("id"))
    a = numbered(ids.where("id % 97 <> 0"), [], F.col("id"), ["id"], "pos")
    b = numbered(ids.where("id % 89 <> 0"), [], F.col("id"), ["id"], "pos")
    return Q.id_alignment(a, b, "id", "pos")


POOL = """pool AS (SELECT 'good' AS model, o_orderkey AS id, o_totalprice / 500000 AS value FROM orders
  UNION ALL SELECT 'copy', o_orderkey, o_totalprice / 500000 FROM orders UNION ALL SELECT 'nulls', o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice / 500000 END FROM orders
  UNION ALL SELECT 'range', o_orderkey, o_totalprice / 100000 FROM orders UNION ALL SELECT 'twice', o_orderkey // 2, o_totalprice / 500000 FROM orders
  UNION ALL SELECT 'short', o_orderkey, o_totalprice / 500000 FROM orders WHERE o_orderkey % 2 = 0)"""


def _pool(t):
    o, v = t.orders, F.col("o_totalprice") / 500000
    k = F.col("o_orderkey")
    parts = [
        o.select(F.lit("good").alias("model"), k.alias("id"), v.alias("value")),
        o.select(F.lit("copy"), k, v),
        o.select(F.lit("nulls"), k, F.when(k % 10 > 0, v)),
        o.select(F.lit("range"), k, F.col("o_totalprice") / 100000),
        o.select(F.lit("twice"), F.floor(k / 2), v),
        o.where("o_orderkey % 2 = 0").select(F.lit("short"), k, v),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(
    "prediction_validator",
    f"""WITH {POOL}, c AS (SELECT model, count(*) AS n_rows, (SELECT count(*) FROM (SELECT id FROM pool p2 WHERE p2.model = pool.model GROUP BY id HAVING count(*) > 1)) AS duplicate_ids,
  count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (isinf(value) OR isnan(value)) AS not_finite, count(*) FILTER (value < 0 OR value > 1) AS out_of_range FROM pool GROUP BY 1)
SELECT *, CASE WHEN n_rows <> (SELECT count(*) FROM orders) THEN 'row_count' WHEN duplicate_ids > 0 THEN 'duplicate_ids' WHEN nulls > 0 THEN 'nulls' WHEN not_finite > 0 THEN 'not_finite'
  WHEN out_of_range > 0 THEN 'out_of_range' ELSE 'ok' END AS verdict FROM c""",
)
def _(t):
    return Q.prediction_validator(_pool(t), t.orders.agg(F.count(F.lit(1)).alias("n")).scalar())


@query(
    "exact_duplicate_sets",
    f"""WITH {POOL}, s AS (SELECT model, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR) || ':' || coalesce(CAST(value AS VARCHAR), ''), ',' ORDER BY id, value)) AS h FROM pool GROUP BY 1)
SELECT model, n, min(model) OVER (PARTITION BY n, h) AS kept, CAST(model <> min(model) OVER (PARTITION BY n, h) AS INT) AS is_duplicate FROM s""",
)
def _(t):
    return Q.exact_duplicate_sets(_pool(t))


@query(
    "impossible_combo_check",
    """WITH x AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'shipped_before_order' AS rule, count(*) FILTER (l_shipdate < o_orderdate) AS n_rows, 100.0::DOUBLE * count(*) FILTER (l_shipdate < o_orderdate) / count(*) AS pct FROM x
UNION ALL SELECT 'line_above_order_total', count(*) FILTER (l_extendedprice > o_totalprice), 100.0::DOUBLE * count(*) FILTER (l_extendedprice > o_totalprice) / count(*) FROM x""",
    f="pct",
)
def _(t):
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.impossible_combo(
        x, {"shipped_before_order": F.col("l_shipdate") < F.col("o_orderdate"), "line_above_order_total": F.col("l_extendedprice") > F.col("o_totalprice")}
    )


@query(
    "file_inventory",
    """WITH f AS (SELECT source AS split, lang AS kind, doc_id // 4 AS id, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS columns FROM documents),
k AS (SELECT split, count(DISTINCT kind) AS n_kinds FROM f GROUP BY 1),
full_ids AS (SELECT split, count(*) FILTER (c = n_kinds) AS complete_ids FROM (SELECT split, id, count(DISTINCT kind) AS c FROM f GROUP BY 1, 2) JOIN k USING (split) GROUP BY 1)
SELECT split, kind, count(*) AS n_files, count(DISTINCT id) AS n_ids, count(DISTINCT columns) AS n_schemas, complete_ids FROM f JOIN full_ids USING (split) GROUP BY split, kind, complete_ids""",
)
def _(t):
    listing = t.documents.select(
        F.col("source").alias("split"), F.col("lang").alias("kind"), F.floor(F.col("doc_id") / 4).alias("id"),
        F.when(F.col("n_chars") > 500, "long").otherwise("short").alias("columns"),
    )
    return Q.file_inventory(listing)
