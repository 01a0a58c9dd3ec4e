"""Metric queries."""

from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.plans import bind as B
from quern.plans import pool as P
from quern.plans.profile import FLAGS, flags
from quern.registry import query


def sql_auc(src, y, s, key=""):
    """Exact tie-averaged AUC by ranks."""
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    part2 = f"PARTITION BY {k}s"
    return f"""(SELECT {k}(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y = 1) * (count(*) FILTER (y = 0))::DOUBLE, 0) AS auc,
  count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives
  FROM (SELECT *, rank() OVER ({part} ORDER BY s) + (count(*) OVER ({part2}) - 1) / 2.0::DOUBLE AS r FROM (SELECT {k}{y} AS y, {s} AS s FROM {src})) {f'GROUP BY {key}' if key else ''})"""


@query("metric_auc", f"WITH {P.PRED} SELECT slice, positives, negatives, auc FROM {sql_auc('pred', 'y', 'm1', 'slice')} UNION ALL SELECT 'all', positives, negatives, auc FROM {sql_auc('pred', 'y', 'm1')}", f="auc")
def _(t):
    p = P.pred(t)
    return M.auc(p, ["slice"], "y", "m1").unionByName(M.auc(p, [], "y", "m1").withColumn("slice", F.lit("all")))


ML = ("big", "late", "rich")


@query(
    "metric_auc_micro_macro",
    f"WITH {FLAGS}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS label, {c} AS y, 0.3e0 * {c} + {P.h(7919 + i)} AS s FROM flags" for i, c in enumerate(ML))
    + f") SELECT avg(auc) AS macro, count(*) AS labels, (SELECT auc FROM {sql_auc('l', 'y', 's')}) AS micro FROM {sql_auc('l', 'y', 's', 'label')}",
    f="macro micro",
)
def _(t):
    x = flags(t)
    arr = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("y"), F.expr(f"0.3e0 * {c} + {P.h(7919 + i)}").alias("s")) for i, c in enumerate(ML)])
    return M.auc_micro_macro(x.select(F.explode(arr).alias("p")).select("p.*"), "label", "y", "s")


FE = ("total", "acct", "day")


@query(
    "single_feature_auc",
    f"WITH {B.SURVEY}, x AS (SELECT *, CAST(target = 'F' AS INT) AS yf, CAST(day > 1200 AS INT) AS yl FROM survey), l AS ("
    + " UNION ALL ".join(f"SELECT '{y}' AS label, '{c}' AS feature, '{y}|{c}' AS k, {y} AS y, {c}::DOUBLE AS s FROM x WHERE {c} IS NOT NULL" for y in ("yf", "yl") for c in FE)
    + f"), a AS (SELECT k, auc FROM {sql_auc('l', 'y', 's', 'k')}), b AS (SELECT split_part(k, '|', 1) AS label, split_part(k, '|', 2) AS feature, greatest(auc, 1 - auc) AS strength, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY strength DESC, feature) AS rank FROM b) SELECT * FROM r WHERE rank <= 2",
    f="strength",
)
def _(t):
    x = B.survey(t).withColumns({"yf": (F.col("target") == "F").cast("int"), "yl": (F.col("day") > 1200).cast("int")})
    return M.single_feature_auc(x, FE, ["yf", "yl"], top=2)


@query(
    "metric_pr_auc",
    f"WITH {P.PRED}, c AS (SELECT slice, m1 AS s, sum(y) AS p, count(*) AS n FROM pred GROUP BY 1, 2), w AS (SELECT *, sum(p) OVER a AS tp, sum(n) OVER a AS al FROM c WINDOW a AS (PARTITION BY slice ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT slice, CAST(sum(p) AS BIGINT) AS positives, sum(p * tp / al) / sum(p) AS average_precision FROM w GROUP BY 1",
    f="average_precision",
)
def _(t):
    return M.average_precision(P.pred(t), ["slice"], "y", "m1")


@query(
    "metric_f_beta_confusion",
    f"WITH {P.PRED}, c AS (SELECT slice, count(*) FILTER (y = 1 AND m1 >= 0.5) AS tp, count(*) FILTER (y = 0 AND m1 >= 0.5) AS fp, count(*) FILTER (y = 1 AND m1 < 0.5) AS fn, count(*) FILTER (y = 0 AND m1 < 0.5) AS tn FROM pred GROUP BY 1) SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, 5 * tp / nullif(5 * tp + 4 * fn + fp, 0) AS f2 FROM c",
    f="precision recall f1 f2",
)
def _(t):
    return M.f_beta_confusion(P.pred(t).withColumn("p", (F.col("m1") >= 0.5).cast("int")), ["slice"], "y", "p")


@query("metric_balanced_accuracy", f"WITH {P.LAB}, r AS (SELECT target AS class, count(*) AS n, avg(CAST(target = l1 AS INT)) AS recall FROM lab GROUP BY 1) SELECT *, (SELECT avg(recall) FROM r) AS balanced_accuracy FROM r", f="recall balanced_accuracy")
def _(t):
    return M.class_recall(P.lab(t), "target", "l1")


@query("metric_logloss", f"WITH {P.PROB} SELECT slice, avg(-ln(greatest(least(CASE target WHEN 'F' THEN aF WHEN 'O' THEN aO ELSE aP END, 1 - 1e-15), 1e-15))) AS log_loss, count(*) AS n FROM prob GROUP BY 1", f="log_loss")
def _(t):
    return M.log_loss(P.prob(t), ["slice"], "target", {c: f"a{c}" for c in P.CLS})


@query("metric_rmse_mae", "WITH x AS (SELECT user_id, value AS y, 50e0 + event_id % 7 - value AS e FROM events) SELECT user_id, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, round(avg(e), 9) AS bias, quantile_cont(abs(e), 0.95) AS p95_abs FROM x GROUP BY 1", f="rmse mae bias p95_abs")
def _(t):
    x = t.events.withColumn("p", F.expr("50e0 + event_id % 7"))
    return M.error_summary(x, ["user_id"], "value", "p").withColumn("bias", F.round("bias", 9))


@query(
    "agg_pooled_score",
    "WITH x AS (SELECT user_id, pow(50e0 + event_id % 7 - value, 2) AS s FROM events), p AS (SELECT user_id, sum(s) AS sse, count(*) AS n, sqrt(avg(s)) AS rmse FROM x GROUP BY 1) SELECT sqrt(sum(sse) / sum(n)) AS pooled_rmse, avg(rmse) AS mean_rmse, quantile_cont(rmse, 0.5) AS median_rmse FROM p",
    f="pooled_rmse mean_rmse median_rmse",
)
def _(t):
    return M.pooled_score(t.events.withColumn("p", F.expr("50e0 + event_id % 7")), "user_id", "value", "p")


@query(
    "best_threshold_f1",
    f"WITH {P.PRED}, c AS (SELECT m1 AS s, sum(y) AS p, count(*) AS n FROM pred GROUP BY 1), w AS (SELECT s, sum(p) OVER a AS tp, sum(n) OVER a AS al FROM c WINDOW a AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), f AS (SELECT s AS threshold, round(2 * tp / (al + (SELECT sum(p) FROM c)), 12) AS f1 FROM w) SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold DESC LIMIT 1",
    f="threshold f1",
)
def _(t):
    return M.best_threshold_f1(P.pred(t), "y", "m1")


GRID = [round(0.05 + 0.005 * i, 3) for i in range(181)]


@query(
    "threshold_grid_f1",
    f"WITH {P.PRED}, g AS (SELECT unnest({GRID}::DOUBLE[]) AS threshold), j AS (SELECT threshold, m1 >= threshold AS hit, y, count(*) AS n FROM pred, g GROUP BY ALL) SELECT threshold, 2 * coalesce(sum(n) FILTER (hit AND y = 1), 0) / nullif(coalesce(sum(n) FILTER (hit), 0) + sum(n) FILTER (y = 1), 0) AS f1 FROM j GROUP BY 1",
    f="f1",
)
def _(t):
    return M.threshold_grid_f1(P.pred(t), "y", "m1", GRID)


@query(
    "segment_auc",
    f"WITH {P.PRED}, x AS (SELECT *, floor(price / 20000)::INT AS seg FROM pred) SELECT seg, positives, negatives, auc FROM {sql_auc('x', 'y', 'm2', 'seg')} WHERE positives + negatives >= 200 AND least(positives, negatives) >= 20",
    f="auc",
)
def _(t):
    return M.segment_auc(P.pred(t).withColumn("seg", F.floor(F.col("price") / 20000)), "seg", "y", "m2")


BND = " ".join(f"WHEN p > {a} AND p <= {b} THEN '{a:.2f}-{b:.2f}'" for a, b in zip(M.BANDS[:-1], M.BANDS[1:]))
PCT = "(rank() OVER (PARTITION BY slice ORDER BY m1 DESC) + (count(*) OVER (PARTITION BY slice, m1) - 1) / 2e0) / count(*) OVER (PARTITION BY slice)"


@query("score_band_lift", f"WITH {P.PRED}, x AS (SELECT *, {PCT} AS p FROM pred) SELECT CASE {BND} END AS band, count(*) AS n, avg(y) AS rate, avg(y) / (SELECT avg(y) FROM pred) AS lift FROM x GROUP BY 1", f="rate lift")
def _(t):
    return M.score_bands(P.pred(t), ["slice"], "y", "m1")


@query("group_top_share", f"WITH {P.PRED}, x AS (SELECT *, {PCT} AS p FROM pred) SELECT yr, count(*) AS n, avg(CAST(p <= 0.2 AS INT)) AS share_in_top, avg(y) FILTER (p <= 0.2) AS rate_in_top, avg(y) FILTER (p > 0.2) AS rate_outside FROM x GROUP BY 1", f="share_in_top rate_in_top rate_outside")
def _(t):
    return M.top_share_by_group(P.pred(t), "yr", ["slice"], "y", "m1")


@query("paired_bootstrap")
def _(t):
    return M.paired_bootstrap(P.pred(t), "cust", "y", "m1", "m2", replicates=30)


@query("metric_noise_curve")
def _(t):
    return M.noise_curve(P.pred(t), "cust", "y", "m1", [0.05, 0.2, 0.5], replicates=10)


@query(
    "worst_decile_share",
    "WITH p AS (SELECT user_id, sum(pow(value - 50, 2)) AS sse FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY sse DESC) AS rn FROM p) SELECT sum(sse) FILTER (rn <= (SELECT ceil(count(*) * 0.1) FROM p)) AS worst_sse, sum(sse) AS total_sse, sum(sse) FILTER (rn <= (SELECT ceil(count(*) * 0.1) FROM p)) / sum(sse) AS share FROM r",
    f="worst_sse total_sse share",
)
def _(t):
    per = t.events.groupBy("user_id").agg(F.sum(F.pow(F.col("value") - 50, 2)).alias("sse"))
    return M.worst_decile_share(per, "sse", "user_id")


@query(
    "error_pairs",
    f"WITH {P.LAB}, x AS (SELECT *, floor(price / 100000)::INT AS band FROM lab), t AS (SELECT band, slice, count(*) AS n FROM x GROUP BY 1, 2), b AS (SELECT target || '->' || l1 AS pair, band, slice, count(*) AS errors FROM x WHERE target <> l1 GROUP BY 1, 2, 3) SELECT b.*, n AS rows, errors / n AS error_share FROM b JOIN t USING (band, slice)",
    f="error_share",
)
def _(t):
    return M.error_pairs(P.lab(t), "target", "l1", F.floor(F.col("price") / 100000), "slice")


@query(
    "expected_metric",
    f"WITH {P.PROB}, x AS (SELECT *, CASE WHEN bF >= bO AND bF >= bP THEN 'F' WHEN bO >= bP THEN 'O' ELSE 'P' END AS pred FROM prob) SELECT ({' + '.join(f'''sum(CASE WHEN pred = '{c}' THEN a{c} ELSE 0 END) / sum(a{c})''' for c in P.CLS)}) / 3 AS expected_balanced_accuracy FROM x",
    f="expected_balanced_accuracy",
)
def _(t):
    x = P.prob(t).withColumn("pred", F.expr("CASE WHEN bF >= bO AND bF >= bP THEN 'F' WHEN bO >= bP THEN 'O' ELSE 'P' END"))
    return M.expected_balanced_accuracy(x, "pred", {c: f"a{c}" for c in P.CLS})


@query(
    "leaderboard_percentile",
    """WITH s AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS comp, o_totalprice AS score, CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY comp ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY comp) AS n,
  row_number() OVER (PARTITION BY cust ORDER BY d, id) AS attempt, count(*) OVER (PARTITION BY cust) AS m FROM s)
SELECT id, comp, rank, (n - rank) / (n - 1) * 100.0::DOUBLE AS beaten_pct, attempt, 100.0::DOUBLE * attempt / m AS attempt_pct, 100.0::DOUBLE * date_diff('day', DATE '1995-01-01', d) / date_diff('day', DATE '1995-01-01', DATE '2001-08-02') AS time_pct FROM r""",
    f="beaten_pct attempt_pct time_pct",
)
def _(t):
    s = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("comp"), F.col("o_totalprice").alias("score"), F.to_date("o_orderdate").alias("d"))
    out = M.leaderboard_percentile(s, s, "comp", "score")
    day = lambda x: F.to_date(F.lit(x))
    return M.attempt_progress(out, ["cust"], "d", "id", day("1995-01-01"), day("2001-08-02")).select("id", "comp", "rank", "beaten_pct", "attempt", "attempt_pct", "time_pct")


@query(
    "agg_best_per_key",
    "WITH x AS (SELECT o_custkey AS k, o_totalprice AS s, o_orderpriority AS nm, o_custkey % 2 AS hi FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN hi = 1 THEN -s ELSE s END, nm) AS rn FROM x) SELECT k, s AS best, nm AS best_name FROM r WHERE rn = 1",
)
def _(t):
    x = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("s"), F.col("o_orderpriority").alias("nm"), (F.col("o_custkey") % 2).alias("hi"))
    return M.best_per_key(x, "k", "s", "nm", "hi")
