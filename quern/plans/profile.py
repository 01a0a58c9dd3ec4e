"""Profiling, association and drift queries."""

from pyspark.sql import functions as F

from quern.operators import profile as P
from quern.plans import bind as B
from quern.registry import query

S = B.SURVEY
L = f"l AS ({B.sql_long(B.NUM, 'survey', 'target')})"
CATL = f"cl AS ({' UNION ALL '.join(f'''SELECT target, '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'Missing') AS level FROM survey''' for c in B.CAT)})"


@query(
    "numeric_profile",
    f"""WITH {S}, {L} SELECT feature, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
  100.0::DOUBLE * avg(CAST(x IS NULL AS INT)) AS missing_pct, {', '.join(f'quantile_cont(x, {p / 100}) AS p{p:02d}' for p in P.PERCENTS)} FROM l GROUP BY 1""",
    f="mean std min max missing_pct " + " ".join(f"p{p:02d}" for p in P.PERCENTS),
)
def _(t):
    return P.numeric_profile(B.survey(t), B.NUM)


@query(
    "percentile_by_class",
    f"""WITH {S}, {L}, m AS (SELECT feature, quantile_cont(x, 0.5) AS m FROM l GROUP BY 1),
q AS (SELECT feature, target, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95,
  quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, 100.0::DOUBLE * avg(CAST(x IS NULL AS INT)) AS missing_pct FROM l GROUP BY 1, 2)
SELECT q.*, round(100 * (p50 / nullif(m, 0) - 1), 9) AS median_lift_pct FROM q JOIN m USING (feature)""",
    f="p05 p50 p95 iqr missing_pct median_lift_pct",
)
def _(t):
    return P.percentile_by_class(B.survey(t), B.NUM, "target").withColumn("median_lift_pct", F.round("median_lift_pct", 9))


@query("class_balance", f"WITH {S} SELECT target, count(*) AS n, count(*) / (SELECT count(*) FROM survey) AS share FROM survey GROUP BY 1", f="share")
def _(t):
    return P.class_balance(B.survey(t), "target")


@query(
    "mean_lift_by_class",
    f"""WITH {S}, {L}, o AS (SELECT feature, avg(x) AS overall_mean FROM l GROUP BY 1), c AS (SELECT feature, target, avg(x) AS class_mean FROM l GROUP BY 1, 2)
SELECT feature, target, class_mean, overall_mean, round(100 * (class_mean / overall_mean - 1), 9) AS lift_pct FROM c JOIN o USING (feature)""",
    f="class_mean overall_mean lift_pct",
)
def _(t):
    return P.mean_lift_by_class(B.survey(t), B.NUM, "target").withColumn("lift_pct", F.round("lift_pct", 9))


@query(
    "class_vs_rest",
    f"""WITH {S}, {L}, q AS (SELECT feature, quantile_cont(x, 0.5) FILTER (target = 'F') AS class_median, quantile_cont(x, 0.5) FILTER (target <> 'F') AS rest_median,
  quantile_cont(x, 0.05) FILTER (target = 'F') AS class_p05, quantile_cont(x, 0.95) FILTER (target = 'F') AS class_p95 FROM l GROUP BY 1)
SELECT *, round(100 * (class_median / nullif(rest_median, 0) - 1), 9) AS lift_pct FROM q""",
    f="class_median rest_median class_p05 class_p95 lift_pct",
)
def _(t):
    return P.class_vs_rest(B.survey(t), B.NUM, "target", "F").withColumn("lift_pct", F.round("lift_pct", 9))


SH = ", ".join(f"avg(CAST(target = '{c}' AS INT)) AS share_{c}" for c in B.CLASSES)


@query("category_target_mix", f"WITH {S} SELECT coalesce(seg, 'Missing') AS level, count(*) AS n, {SH} FROM survey GROUP BY 1", f="share_F share_O share_P")
def _(t):
    return P.category_target_mix(B.survey(t), "seg", "target", B.CLASSES)


@query(
    "category_signal_scan",
    f"""WITH {S}, {CATL}, c AS (SELECT feature, level, target, count(*) AS n FROM cl GROUP BY 1, 2, 3), x AS (SELECT *, sum(n) OVER (PARTITION BY feature, level) AS ln,
  sum(n) OVER (PARTITION BY feature, target) AS cn, sum(n) OVER (PARTITION BY feature) AS an FROM c)
SELECT feature, level, target, CAST(ln AS BIGINT) AS level_n, 100.0::DOUBLE * n / ln AS share_pct, round(100.0::DOUBLE * n / ln - 100.0::DOUBLE * cn / an, 9) AS lift_points FROM x""",
    f="share_pct lift_points",
)
def _(t):
    return P.category_signal_scan(B.survey(t), B.CAT, "target").withColumn("lift_points", F.round("lift_points", 9))


@query(
    "interaction_mix",
    f"WITH {S} SELECT coalesce(seg, 'Missing') || ' | ' || prio AS combo, count(*) AS n, {SH} FROM survey GROUP BY 1 HAVING count(*) >= 100",
    f="share_F share_O share_P",
)
def _(t):
    return P.interaction_mix(B.survey(t), "seg", "prio", "target", B.CLASSES, min_rows=100)


ETA = """eta AS (SELECT feature, sum(n * pow(m - g, 2)) / nullif(sum(n * pow(m - g, 2)) + sum(n * v), 0) AS eta2 FROM (
  SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM (
    SELECT feature, target, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM l WHERE x IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)"""


def _v(src, name):
    return f"""{name}c AS (SELECT feature, level, target, count(*) AS o FROM {src} GROUP BY 1, 2, 3),
{name}m AS (SELECT *, sum(o) OVER (PARTITION BY feature, level) AS ro, sum(o) OVER (PARTITION BY feature, target) AS co, sum(o) OVER (PARTITION BY feature) AS n FROM {name}c),
{name} AS (SELECT feature, greatest(sum(o * o / (ro * co / n)) - max(n), 0.0) AS chi2, CASE WHEN least(count(DISTINCT level), count(DISTINCT target)) <= 1 THEN 0.0 ELSE
  sqrt(greatest(sum(o * o / (ro * co / n)) - max(n), 0.0) / max(n) / (least(count(DISTINCT level), count(DISTINCT target)) - 1)) END AS v FROM {name}m GROUP BY 1)"""


@query("eta_squared", f"WITH {S}, {L}, {ETA} SELECT feature, eta2, sqrt(eta2) AS eta FROM eta", f="eta2 eta")
def _(t):
    return P.eta_squared(B.survey(t), B.NUM, "target")


@query(
    "cramers_v",
    f"""WITH {S}, {CATL}, {_v('cl', 'cv')}, y AS (SELECT CAST(target = 'F' AS VARCHAR) AS target, 'late' AS feature, CAST(day > 1200 AS VARCHAR) AS level FROM survey),
yc AS (SELECT level, target, count(*) AS o FROM y GROUP BY 1, 2), ym AS (SELECT *, sum(o) OVER (PARTITION BY level) * sum(o) OVER (PARTITION BY target) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM yc)
SELECT feature, 'plain' AS variant, round(chi2, 6) AS chi2, round(v, 8) AS cramers_v FROM cv
UNION ALL SELECT 'late', 'corrected', round(sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e), 6), round(sqrt(sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) / max(n)), 8) FROM ym""",
    f="chi2 cramers_v",
)
def _(t):
    s = B.survey(t)
    late = s.select((F.col("target") == "F").cast("string").alias("target"), (F.col("day") > 1200).cast("string").alias("late"))
    plain = P.cramers_v(s, B.CAT, "target").withColumn("variant", F.lit("plain"))
    out = plain.unionByName(P.cramers_v(late, ["late"], "target", correction=True).withColumn("variant", F.lit("corrected")))
    return out.select("feature", "variant", F.round("chi2", 6).alias("chi2"), F.round("cramers_v", 8).alias("cramers_v"))


@query(
    "feature_strength_rank",
    f"""WITH {S}, {L}, {ETA}, {CATL}, {_v('cl', 'cv')}, ml AS ({' UNION ALL '.join(f"SELECT target, '{c}' AS feature, CAST({c} IS NULL AS VARCHAR) AS level FROM survey" for c in (*B.NUM, *B.CAT))}), {_v('ml', 'mv')}
SELECT feature, 'numeric' AS kind, eta2 AS strength FROM eta UNION ALL SELECT feature, 'category', round(v, 8) FROM cv UNION ALL SELECT feature, 'missing', round(v, 8) FROM mv""",
    f="strength",
)
def _(t):
    out = P.feature_strength(B.survey(t), B.NUM, B.CAT, "target")
    return out.withColumn("strength", F.when(F.col("kind") == "numeric", F.col("strength")).otherwise(F.round("strength", 8)))


@query(
    "kruskal_h",
    f"""WITH {S}, {L}, r AS (SELECT feature, target, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY feature, x) AS t, count(*) OVER (PARTITION BY feature) AS n FROM l WHERE x IS NOT NULL),
g AS (SELECT feature, target, sum(rk) AS rs, count(*) AS nk FROM r GROUP BY 1, 2), q AS (SELECT feature, sum(rs * rs / nk) AS q FROM g GROUP BY 1),
tie AS (SELECT feature, max(n)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS tie FROM r GROUP BY 1)
SELECT feature, CAST(n AS BIGINT) AS n, round((12.0::DOUBLE / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - tie / (n * n * n - n), 0), 4) AS h FROM q JOIN tie USING (feature)""",
    f="h",
)
def _(t):
    return P.kruskal_h(B.survey(t), B.NUM, "target").withColumn("h", F.round("h", 4))


LC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIRS = P.pairs_of(LC)


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS corr FROM lineitem" for a, b in PAIRS), f="corr")
def _(t):
    return P.corr_matrix(t.lineitem, LC).withColumn("corr", F.round("corr", 9))


@query(
    "spearman_matrix",
    "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in LC)
    + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS spearman FROM r" for a, b in PAIRS),
    f="spearman",
)
def _(t):
    return P.spearman_matrix(t.lineitem, LC).withColumn("spearman", F.round("spearman", 9))


LABELS = ("big", "late", "building", "rich", "urgent")
FLAGS = """flags AS (SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice, CAST(o_totalprice > 300000 AS INT) AS big, CAST(o_orderdate >= DATE '1999-01-01' AS INT) AS late,
  CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INT) AS building, CAST(c_acctbal > 6000 AS INT) AS rich, CAST(o_orderpriority = '1-URGENT' AS INT) AS urgent
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def flags(t):
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return x.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), "o_totalprice",
        (F.col("o_totalprice") > 300000).cast("int").alias("big"),
        (F.col("o_orderdate") >= F.to_date(F.lit("1999-01-01"))).cast("int").alias("late"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("building"),
        (F.col("c_acctbal") > 6000).cast("int").alias("rich"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
    )


@query(
    "phi_lift_pairs",
    f"WITH {FLAGS}, p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, avg({a} * {b}) AS rate, avg({a}) AS pa, avg({b}) AS pb FROM flags" for a, b in P.pairs_of(LABELS))
    + ") SELECT a, b, rate, round((rate - pa * pb) / nullif(sqrt(pa * (1 - pa) * pb * (1 - pb)), 0), 9) AS phi, rate / (pa * pb) AS lift FROM p",
    f="rate phi lift",
)
def _(t):
    return P.phi_lift_pairs(flags(t), LABELS).withColumn("phi", F.round("phi", 9))


@query("positives_histogram", f"WITH {FLAGS} SELECT {' + '.join(LABELS)} AS positives, count(*) AS n FROM flags GROUP BY 1")
def _(t):
    return P.positives_histogram(flags(t), LABELS)


RES = [("big", "0.4"), ("late", "0.3 + 0.0001 * (id % 1000)"), ("rich", "o_totalprice / 500000")]


@query(
    "residual_corr",
    f"WITH {FLAGS}, r AS (SELECT {', '.join(f'{y} - ({p})::DOUBLE AS {y}' for y, p in RES)} FROM flags) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS corr FROM r" for a, b in P.pairs_of([y for y, _ in RES])),
    f="corr",
)
def _(t):
    x = flags(t).withColumns({f"p_{y}": F.expr(f"CAST({p} AS DOUBLE)") for y, p in RES})
    return P.residual_corr(x, [(y, f"p_{y}") for y, _ in RES]).withColumn("corr", F.round("corr", 9))


TL = f"tl AS ({B.sql_long(B.NUM, 'train', '0 AS s')} UNION ALL {B.sql_long(B.NUM, 'test', '1 AS s')})"


@query(
    "numeric_drift_smd",
    f"""WITH {S}, {TL}, a AS (SELECT feature, avg(x) FILTER (s = 0) AS mean_a, avg(x) FILTER (s = 1) AS mean_b, var_samp(x) FILTER (s = 0) AS va, var_samp(x) FILTER (s = 1) AS vb, stddev_samp(x) AS sd FROM tl GROUP BY 1)
SELECT feature, mean_a, mean_b, round((mean_b - mean_a) / nullif(sqrt((va + vb) / 2), 0), 9) AS smd, round((mean_b - mean_a) / nullif(sd, 0), 9) AS smd_pooled FROM a""",
    f="mean_a mean_b smd smd_pooled",
)
def _(t):
    out = P.numeric_drift(*B.splits(t), B.NUM)
    return out.withColumns({c: F.round(c, 9) for c in ("smd", "smd_pooled")})


@query(
    "categorical_drift_tvd",
    f"""WITH {S} {' UNION ALL '.join(f"""SELECT '{c}' AS feature, round(sum(abs(coalesce(a.n, 0) / (SELECT count(*) FROM train) - coalesce(b.n, 0) / (SELECT count(*) FROM test))) / 2, 9) AS tvd
FROM (SELECT coalesce({c}, 'Missing') AS lv, count(*) AS n FROM train GROUP BY 1) a FULL JOIN (SELECT coalesce({c}, 'Missing') AS lv, count(*) AS n FROM test GROUP BY 1) b USING (lv)""" for c in B.CAT)}""",
    f="tvd",
)
def _(t):
    return P.categorical_drift(*B.splits(t), B.CAT).withColumn("tvd", F.round("tvd", 9))




@query(
    "category_coverage",
    """WITH a AS (SELECT o_custkey AS cust, o_orderpriority AS prio FROM orders WHERE o_orderkey % 3 > 0), b AS (SELECT o_custkey AS cust, o_orderpriority AS prio FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'cust' AS feature, (SELECT count(DISTINCT cust) FROM a) AS levels_a, (SELECT count(DISTINCT cust) FROM b) AS levels_b, (SELECT count(DISTINCT cust) FROM b WHERE cust NOT IN (SELECT cust FROM a)) AS unseen_in_b
UNION ALL SELECT 'prio', (SELECT count(DISTINCT prio) FROM a), (SELECT count(DISTINCT prio) FROM b), (SELECT count(DISTINCT prio) FROM b WHERE prio NOT IN (SELECT prio FROM a))""",
)
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio"))
    return P.category_coverage(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 3 = 0"), ["cust", "prio"])


@query("adversarial_auc")
def _(t):
    return P.adversarial_auc(*(s.where("total IS NOT NULL AND acct IS NOT NULL") for s in B.splits(t)), list(B.NUM))


@query(
    "mutual_info_rank",
    f"""WITH {S}, b AS ({' UNION ALL '.join(f"SELECT target, '{c}' AS feature, CASE WHEN {c} IS NULL THEN -1 ELSE least(floor(({c} - (SELECT min({c}) FROM survey)) / ((SELECT max({c}) FROM survey) - (SELECT min({c}) FROM survey))::DOUBLE * 10), 9) END AS bin FROM survey" for c in B.NUM)}),
c AS (SELECT feature, bin, target, count(*) AS o FROM b GROUP BY 1, 2, 3), m AS (SELECT *, sum(o) OVER (PARTITION BY feature, bin) AS ro, sum(o) OVER (PARTITION BY feature, target) AS co, sum(o) OVER (PARTITION BY feature) AS n FROM c)
SELECT feature, round(sum(o / n * ln((o / ro) * (n / co))), 9) AS mi FROM m GROUP BY 1""",
    f="mi",
)
def _(t):
    return P.mutual_info(B.survey(t), B.NUM, "target").withColumn("mi", F.round("mi", 9))


@query("pca_variance")
def _(t):
    return P.pca_variance(t.lineitem, LC, 4)


@query(
    "histogram",
    f"""WITH l AS ({B.sql_long(('o_totalprice', 'o_custkey'), 'orders')}), m AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1),
b AS (SELECT feature, lo, hi, CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin FROM l JOIN m USING (feature))
SELECT feature, bin, lo + bin * ((hi - lo) / 20) AS left_edge, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    f="left_edge",
)
def _(t):
    return P.histogram(t.orders, ["o_totalprice", "o_custkey"])


@query(
    "row_count_hist",
    """WITH p AS (SELECT user_id, count(*) AS n, avg(CAST(event_type = 'error' AS INT)) AS share FROM events GROUP BY 1)
SELECT n // 10 * 10 AS rows_from, count(*) AS entities, avg(share) AS flag_share FROM p GROUP BY 1""",
    f="flag_share",
)
def _(t):
    return P.row_count_hist(t.events, "user_id", F.col("event_type") == "error")


@query(
    "entity_five_numbers",
    """WITH p AS (SELECT user_id, count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_flagged FROM events GROUP BY 1), l AS (SELECT 'n_rows' AS feature, n_rows::DOUBLE AS x FROM p UNION ALL SELECT 'n_flagged', n_flagged FROM p)
SELECT feature, min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max FROM l GROUP BY 1""",
)
def _(t):
    return P.five_numbers(t.events, "user_id", F.col("event_type") == "error")
