"""Purchase rhythm queries."""

from pyspark.sql import functions as F

from quern.functions.mathx import sql_norm_cdf as CDF
from quern.operators import customer as C
from quern.operators import rhythm as R
from quern.plans import bind as B
from quern.registry import query


def _days(t):
    return C.day_level(C.order_level(B.lines(t)))


def _gaps(t):
    return C.order_gaps(C.order_level(B.lines(t)))


def _est(t):
    return R.with_window(R.estimators_long(R.estimators(_gaps(t))), B.population(t))


SKEW = "CASE WHEN count({0}) < 3 THEN NULL WHEN var_pop({0}) = 0 THEN 0.0 ELSE round(skewness({0}), 9) END"
HS = [(n, v) for n, v in R.HORIZONS.items()]
ESTQ = (
    B.GAPS
    + """,
h AS (SELECT og.*, hist FROM og JOIN (VALUES """
    + ", ".join(f"('{n}', {v})" for n, v in HS)
    + """) hz(hist, lim) ON og.d <= lim),
est AS (SELECT customer_id, hist, min(d) AS r, count(*) AS n, (max(d) - min(d)) / nullif(count(*) - 1, 0) AS mean,
  quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median, CAST(min(gap) AS DOUBLE) AS min, CAST(max(gap) AS DOUBLE) AS max,
  quantile_cont(CAST(gap AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(gap AS DOUBLE), 0.75) AS q75,
  CAST(max(gap) FILTER (k = 1) AS DOUBLE) AS last, avg(gap) FILTER (k <= 2) AS last2, avg(gap) FILTER (k <= 3) AS last3,
  sum(gap * pow(0.7, k - 1)) / sum(pow(0.7, k - 1)) FILTER (gap IS NOT NULL) AS ewm,
  (sum(gap) - max(gap)) / nullif(count(gap) - 1, 0) AS trim FROM h GROUP BY 1, 2)"""
)
LONG = (
    ESTQ
    + ", el AS ("
    + " UNION ALL ".join(
        f"SELECT customer_id, hist, r, n, '{e}' AS est, CASE WHEN {e} > 0 THEN round(CAST({e} AS DOUBLE), 9) END AS period FROM est"
        for e in R.ESTIMATORS
    )
    + "), ew AS (SELECT el.*, 14.0::DOUBLE AS lo, (14.0 + win_len)::DOUBLE AS hi FROM el JOIN pop USING (customer_id))"
)


@query(
    "rhythm_own_hit",
    f"""WITH {B.DAYS}, x AS (SELECT days.*, win_len, min(d) OVER (PARTITION BY customer_id) AS r FROM days JOIN pop USING (customer_id)),
a AS (SELECT customer_id, count(gap) AS n_gaps, count(*) FILTER (gap > r) AS alive,
  count(*) FILTER (gap > r + 14 AND gap <= r + 14 + win_len) AS hit, count(*) FILTER (gap > r AND gap <= r + 14) AS hidden,
  count(*) FILTER (gap > r + 14 + win_len) AS late, count(*) FILTER (gap <= win_len) AS short FROM x GROUP BY 1)
SELECT customer_id, n_gaps, alive, alive / nullif(n_gaps, 0) AS share_alive, hit / nullif(alive, 0) AS p_hit,
  hidden / nullif(alive, 0) AS p_hidden, late / nullif(alive, 0) AS p_late, short / nullif(n_gaps, 0) AS share_le_window FROM a""",
    f="share_alive p_hit p_hidden p_late share_le_window",
)
def _(t):
    return R.own_hit(_days(t), B.population(t))


@query(
    "win_gap_ewm",
    f"""WITH {B.DAYS} SELECT customer_id, sum(gap * pow(0.7, rk - 1)) / sum(pow(0.7, rk - 1)) FILTER (gap IS NOT NULL) AS gap_ewm
FROM days GROUP BY 1""",
    f="gap_ewm",
)
def _(t):
    return R.gap_ewm(_days(t))


@query(
    "win_gap_trim",
    f"WITH {B.DAYS} SELECT customer_id, (sum(gap) - max(gap)) / nullif(count(gap) - 1, 0) AS gap_trim FROM days GROUP BY 1",
    f="gap_trim",
)
def _(t):
    return R.gap_trim(_days(t))


@query(
    "win_gap_stats",
    f"""WITH {B.GAPS}, rec AS (SELECT customer_id, min(d) AS r FROM ot GROUP BY 1),
x AS (SELECT customer_id, horizon, CAST(gap AS DOUBLE) AS gap FROM og JOIN (VALUES (90), (180), (365), (730)) hz(horizon) ON d < horizon WHERE gap IS NOT NULL),
a AS (SELECT customer_id, horizon, count(*) AS n, avg(gap) AS mean, stddev_samp(gap) AS std, CAST(min(gap) AS BIGINT) AS min,
  CAST(max(gap) AS BIGINT) AS max, {SKEW.format('gap')} AS skew, avg(CAST(gap <= 7 AS INT)) AS share_le_7,
  avg(CAST(gap <= 30 AS INT)) AS share_le_30, avg(CAST(gap <= 90 AS INT)) AS share_le_90, quantile_cont(gap, 0.25) AS q25,
  quantile_cont(gap, 0.5) AS median, quantile_cont(gap, 0.75) AS q75, quantile_cont(gap, 0.9) AS q90 FROM x GROUP BY 1, 2)
SELECT a.*, r, r - mean AS r_minus_mean, r / nullif(median, 0) AS r_to_median, max - r AS max_minus_r, std / nullif(mean, 0) AS cv
FROM a JOIN rec USING (customer_id)""",
    f="mean std skew share_le_7 share_le_30 share_le_90 q25 median q75 q90 r_minus_mean r_to_median cv",
)
def _(t):
    return R.gap_stats(_gaps(t)).withColumn("skew", F.round("skew", 9))


@query(
    "win_estimators",
    f"WITH {LONG} SELECT customer_id, hist, r, n, est, period FROM el",
    f="period",
)
def _(t):
    return R.estimators_long(R.estimators(_gaps(t)))


DIST = "greatest(lo - {0}, 0.0) + greatest({0} - hi, 0.0)"


@query(
    "rhythm_next_time",
    f"""WITH {LONG}, x AS (SELECT *, period - r AS t, period - (r - floor(r / period) * period) AS tmod FROM ew)
SELECT customer_id, hist, est, period, t, CASE WHEN t IS NOT NULL THEN {DIST.format('t')} END AS dist,
  CAST(t > lo AND t <= hi AS INT) AS inside, tmod, CAST(tmod > lo AND tmod <= hi AS INT) AS tmod_inside,
  CAST(floor((r + hi) / period) - floor((r + lo) / period) AS BIGINT) AS cycles FROM x""",
    f="period t dist tmod",
)
def _(t):
    return R.next_time(_est(t))


@query(
    "rhythm_window_units",
    f"WITH {LONG} SELECT customer_id, hist, est, (r + lo) / period AS ulo, (r + hi) / period AS uhi FROM ew",
    f="ulo uhi",
)
def _(t):
    return R.window_units(_est(t))


def _soft(center, sd):
    return f"({CDF(f'(hi - ({center})) / ({sd})')} - {CDF(f'(lo - ({center})) / ({sd})')})"


# the normal approximation is good to 1e-7: compare six decimals
@query(
    "rhythm_soft_hit",
    f"WITH {LONG} SELECT customer_id, hist, est, "
    + ", ".join(f"round({_soft('period - r', sd)}, 6) + 0.0 AS {n}" for n, sd in (("phit10", "10e0"), ("phit20", "20e0"), ("phit_rel", "period * 0.25e0")))
    + " FROM ew",
    f="phit10 phit20 phit_rel",
)
def _(t):
    return R.soft_hit(_est(t)).withColumns({c: F.round(c, 6) for c in ("phit10", "phit20", "phit_rel")})


def _ln(x, s):
    return CDF(f"(ln(greatest({x}, 1e-9)) - ln(b)) / {s}e0")


_LN = []
for _s in (0.25, 0.5, 0.8):
    _w = f"({_ln('r + hi', _s)} - {_ln('r + lo', _s)})"
    _a = f"greatest(1 - {_ln('r', _s)}, 1e-6)"
    _t = str(_s).replace(".", "")
    _LN += [f"round({_w}, 5) AS win_{_t}", f"CASE WHEN {_a} > 0.001 THEN round({_w} / {_a}, 3) END AS win_alive_{_t}"]


@query(
    "rhythm_lognormal",
    f"WITH {LONG}, z AS (SELECT *, CASE WHEN period IS NOT NULL THEN greatest(period, 1.0) END AS b FROM ew WHERE est IN ('median', 'mean')) SELECT customer_id, hist, est, {', '.join(_LN)} FROM z",
    f="win_025 win_05 win_08 win_alive_025 win_alive_05 win_alive_08",
)
def _(t):
    # conditional probabilities of long-lapsed customers divide by less than the approximation's error: not shown
    out = R.lognormal(_est(t).where(F.col("est").isin("median", "mean"))).drop("hidden_alive_05")
    for c in ("025", "05", "08"):
        out = out.withColumn(f"win_alive_{c}", F.when(F.col(f"alive_{c}") > 0.001, F.round(f"win_alive_{c}", 3))).drop(f"alive_{c}")
    return out.withColumns({f"win_{c}": F.round(f"win_{c}", 5) for c in ("025", "05", "08")})


@query(
    "rhythm_multi_cycle",
    f"""WITH {LONG}, x AS (SELECT *, period - r AS c1, 2 * period - r AS c2, 3 * period - r AS c3 FROM ew WHERE est IN ('mean', 'median', 'max', 'trim', 'last')),
s AS (SELECT *, {', '.join(f"coalesce(least(greatest({_soft(f'c{m}', 'period * 0.25')}, 0.0), 1.0), 0.0) AS s{m}, coalesce(CAST(c{m} > lo AND c{m} <= hi AS INT), 0) AS h{m}, CASE WHEN period IS NOT NULL THEN {DIST.format(f'c{m}')} END AS d{m}" for m in (1, 2, 3))} FROM x)
SELECT customer_id, hist, est, greatest(h1, h2, h3) AS any_hard, h1 + h2 + h3 AS n_hard,
  CASE WHEN 1 - (1 - s1) * (1 - s2) * (1 - s3) < 1e-6 THEN 0.0 ELSE 1 - (1 - s1) * (1 - s2) * (1 - s3) END AS p_any_soft,
  CASE WHEN s1 + s2 + s3 < 1e-6 THEN 0.0 ELSE s1 + s2 + s3 END AS e_soft,
  least(d1, d2, d3) AS min_dist, CAST(coalesce(r > period, FALSE) AS INT) AS overdue, r / period AS recency_to_period FROM s""",
    f="p_any_soft e_soft min_dist recency_to_period",
)
def _(t):
    # probabilities below the error of the normal approximation are shown as 0
    out = R.multi_cycle(_est(t).where(F.col("est").isin("mean", "median", "max", "trim", "last")))
    return out.withColumns({c: F.when(F.col(c) < 1e-6, 0.0).otherwise(F.col(c)) for c in ("p_any_soft", "e_soft")})


def _cyc(col):
    return f"""dd AS (SELECT customer_id, {col} AS level, d, d - lag(d) OVER (PARTITION BY customer_id, {col} ORDER BY d) AS gap
  FROM (SELECT DISTINCT customer_id, {col}, d FROM lines WHERE {col} IS NOT NULL)),
cyc AS (SELECT *, (first - last) / (n - 1) AS mean_gap, last / nullif(med, 0) AS r_med, med - last AS t_med, (first - last) / (n - 1) - last AS t_mean
  FROM (SELECT customer_id, level, min(d) AS last, max(d) AS first, count(*) AS n, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS med, max(gap) AS mx FROM dd GROUP BY 1, 2)
  WHERE n >= 2)"""


@query(
    "rhythm_by_category",
    f"""WITH {B.LINES}, {_cyc('category')}, x AS (SELECT cyc.*, 14.0::DOUBLE AS lo, (14.0 + win_len)::DOUBLE AS hi FROM cyc JOIN pop USING (customer_id)),
y AS (SELECT *, {DIST.format('t_mean')} AS dist, CAST(t_med > lo AND t_med <= hi AS INT) AS inn FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY dist, last, level) AS b,
  row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, last, level) AS m FROM y)
SELECT customer_id, count(*) AS n_series, count(*) FILTER (dist = 0) AS n_hit, avg(CAST(dist = 0 AS INT)) AS hit_share,
  min(dist) AS min_dist, max(t_mean) FILTER (b = 1) AS best_t, max(mean_gap) FILTER (b = 1) AS best_gap,
  CAST(sum(inn) AS BIGINT) AS n_inside_med, sum(inn * n) / sum(n) AS inside_by_days, min(abs(t_med - (lo + hi) / 2)) AS min_mid_dist,
  min(r_med) AS min_r_med, avg(r_med) AS mean_r_med, max(mx - last) AS max_mx_r, count(*) FILTER (n >= 3) AS series_3plus,
  max(med) FILTER (m = 1) AS main_med, max(last) FILTER (m = 1) AS main_last FROM z GROUP BY 1""",
    f="hit_share min_dist best_t best_gap inside_by_days min_mid_dist min_r_med mean_r_med main_med",
)
def _(t):
    return R.by_category(R.level_cycles(B.lines(t), "category"), B.population(t))


@query(
    "rhythm_overdue_share",
    f"WITH {B.LINES}, {_cyc('category2')} SELECT customer_id, avg(CAST(last > med AS INT)) AS overdue_share FROM cyc GROUP BY 1",
    f="overdue_share",
)
def _(t):
    return R.overdue_share(R.level_cycles(B.lines(t), "category2"))


@query(
    "rhythm_repeat",
    f"""WITH {B.LINES}, u AS (SELECT DISTINCT customer_id, brand, d FROM lines WHERE brand IS NOT NULL),
r AS (SELECT customer_id, min(d) AS r FROM lines GROUP BY 1),
p AS (SELECT customer_id, brand, count(*) AS n, max(CAST(d = r AS INT)) AS in_last, max(CAST(d > r AS INT)) AS bef FROM u JOIN r USING (customer_id) GROUP BY 1, 2)
SELECT customer_id, avg(CAST(n >= 2 AS INT)) AS repeat_share, max(n) AS max_days, avg(bef) FILTER (in_last = 1) AS last_seen_share FROM p GROUP BY 1""",
    f="repeat_share last_seen_share",
)
def _(t):
    return R.repeats(B.lines(t), "brand")


TW = R.TREND_WINDOWS
TP = list(zip(TW[:-1], TW[1:]))


@query(
    "rhythm_trends",
    f"WITH {B.ORDERS}, a AS (SELECT customer_id, "
    + ", ".join(f"count(*) FILTER (d < {w}) AS n{w}, coalesce(sum(s) FILTER (d < {w}), 0.0) AS s{w}" for w in TW)
    + """, arg_min(loy, d * 1000000000 + order_id) AS loy_now, arg_min(loy, d * 1000000000 + order_id) FILTER (d >= 300) AS loy_then,
  arg_min(s, d * 1000000000 + order_id) AS s_last, avg(s) AS s_mean, avg(disc) FILTER (d < 90) AS disc90, avg(disc) FILTER (d < 365) AS disc365
  FROM ot GROUP BY 1) SELECT customer_id, """
    + ", ".join(f"n{a} / (n{b} - n{a} + 1) AS trend_n_{a}_{b}, s{a} / (s{b} - s{a} + 1) AS trend_s_{a}_{b}, n{a} / nullif(n{b}, 0) AS share_n_{a}_{b}" for a, b in TP)
    + """, (s365 / nullif(n365, 0)) / nullif(s730 / nullif(n730, 0), 0) AS aov_365_730, s_last / s_mean AS last_to_mean,
  loy_now - loy_then AS loy_year_change, disc90 - disc365 AS disc_drift FROM a""",
    f=" ".join(f"trend_n_{a}_{b} trend_s_{a}_{b} share_n_{a}_{b}" for a, b in TP) + " aov_365_730 last_to_mean",
)
def _(t):
    out = R.trends(C.order_level(B.lines(t)))
    return out.withColumns({c: F.round(c, 6) for c in ("loy_year_change", "disc_drift")})


# differences of averages cancel: compare them to six decimals
from quern.registry import ORACLES  # noqa: E402

ORACLES["rhythm_trends"] = (
    f"SELECT * REPLACE (round(loy_year_change, 6) + 0.0 AS loy_year_change, round(disc_drift, 6) + 0.0 AS disc_drift) FROM ({ORACLES['rhythm_trends']})"
)


@query(
    "rhythm_category_recency",
    f"WITH {B.LINES} SELECT customer_id, "
    + ", ".join(
        f"min(d) FILTER (category = '{v}') AS recency_{v.lower()}, count(DISTINCT d) FILTER (category = '{v}' AND d < 365) AS days365_{v.lower()}, "
        f"count(*) FILTER (category = '{v}' AND d < 180) / nullif(count(*) FILTER (d < 180), 0) AS share180_{v.lower()}"
        for v in B.TYPES
    )
    + " FROM lines GROUP BY 1",
    f=" ".join(f"share180_{v.lower()}" for v in B.TYPES),
)
def _(t):
    return R.category_recency(B.lines(t), "category", B.TYPES)


MIX = f"""mix AS (SELECT customer_id, d, {', '.join(f"avg(CAST(category = '{v}' AS INT)) AS c{i}" for i, v in enumerate(B.TYPES))}
  FROM lines WHERE category IS NOT NULL GROUP BY 1, 2),
bk AS (SELECT *, row_number() OVER w - 1 AS rk, d - lag(d) OVER w AS gap, min(d) OVER (PARTITION BY customer_id) AS r,
  {', '.join(f"first_value(c{i}) OVER w AS l{i}" for i in range(6))} FROM mix WINDOW w AS (PARTITION BY customer_id ORDER BY d))"""


@query(
    "basket_drift",
    f"""WITH {B.LINES}, {MIX} SELECT customer_id, CASE WHEN count(*) >= 6 THEN round(least(({' + '.join(f'abs(avg(c{i}) FILTER (rk < 3) - avg(c{i}) FILTER (rk >= 3))' for i in range(6))}) / 2, 1.0), 9) END AS basket_drift
FROM bk GROUP BY 1""",
    f="basket_drift",
)
def _(t):
    out = R.basket_drift(R.baskets(B.lines(t), B.TYPES), B.TYPES)
    return out.withColumn("basket_drift", F.round("basket_drift", 9))


@query(
    "basket_similar_wait",
    f"""WITH {B.LINES}, {MIX}, x AS (SELECT bk.*, win_len, pow({' + '.join(f'least(c{i}, l{i})' for i in range(6))}, 2) AS w FROM bk JOIN pop USING (customer_id) WHERE gap IS NOT NULL),
a AS (SELECT customer_id, max(r) AS r, sum(w) AS wait_mass, coalesce(sum(w) FILTER (gap > r), 0.0) AS wait_alive,
  coalesce(sum(w) FILTER (gap > r + 14 AND gap <= r + 14 + win_len), 0.0) AS wait_window, sum(w * gap) / nullif(sum(w), 0) AS av, avg(gap) AS mn FROM x GROUP BY 1)
SELECT customer_id, wait_mass, wait_alive, wait_window, round(av - mn, 6) AS wait_gap_shift, round(r - av, 6) AS wait_overdue,
  CASE WHEN wait_alive > 0 THEN least(greatest(wait_window / wait_alive, 0.0), 1.0) END AS wait_share FROM a""",
    f="wait_mass wait_alive wait_window wait_gap_shift wait_overdue wait_share",
)
def _(t):
    out = R.basket_similar_wait(R.baskets(B.lines(t), B.TYPES), B.population(t))
    return out.withColumns({c: F.round(c, 6) for c in ("wait_gap_shift", "wait_overdue")})


def _base(t):
    ot = C.order_level(B.lines(t))
    f = ot.groupBy("customer_id").agg(F.min("d").alias("recency"), F.count(F.lit(1)).alias("n_orders"))
    return f.withColumn("score", F.col("n_orders") / (F.col("recency") + 30)).join(B.targets(t), "customer_id")


BASE = f"""base AS (SELECT f.*, n_orders / (recency + 30) AS score, slice, target
  FROM (SELECT customer_id, min(d) AS recency, count(*) AS n_orders FROM ot GROUP BY 1) f JOIN target USING (customer_id))"""
SEG = "SELECT *, '4+' AS seg FROM base WHERE n_orders >= 4 UNION ALL SELECT *, '4-8' FROM base WHERE n_orders BETWEEN 4 AND 8 UNION ALL SELECT *, '9+' FROM base WHERE n_orders >= 9"


GRID_SQL = f"""WITH {LONG}, {B.TARGET}, {BASE}, sg AS ({SEG}), x AS (
  SELECT sg.*, est, cycle, period AS p, cycle * period - recency > lo AND cycle * period - recency <= hi AS inn, recency > period AS ov
  FROM sg JOIN ew USING (customer_id), (VALUES (1), (2), (3)) c(cycle)
  WHERE hist = 'year' AND period IS NOT NULL AND est IN ('mean', 'median', 'max', 'trim', 'q75', 'last', 'ewm')),
r AS (SELECT seg, est AS period, cycle, branch, target FROM x, (VALUES ('all'), ('in_window'), ('overdue'), ('not_overdue'), ('in_and_overdue'), ('in_and_fresh')) b(branch)
  WHERE CASE branch WHEN 'all' THEN TRUE WHEN 'in_window' THEN inn WHEN 'overdue' THEN ov WHEN 'not_overdue' THEN NOT ov WHEN 'in_and_overdue' THEN inn AND ov ELSE inn AND NOT ov END),
g AS (SELECT seg, period, cycle, branch, count(*) AS n, avg(target) AS precision FROM r GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20)
SELECT g.*, precision / greatest(b, 1e-9) AS lift, precision * ln(1 + n) AS rule_score FROM g JOIN (SELECT seg, avg(target) AS b FROM sg GROUP BY 1) USING (seg)"""


@query(
    "agg_hit_rate_grid",
    GRID_SQL,
    f="precision lift rule_score",
)
def _(t):
    est = _est(t).where("hist = 'year'")
    return R.hit_rate_grid(est, _base(t), min_rows=20)


@query(
    "agg_best_rule",
    f"SELECT * FROM ({GRID_SQL}) AS rules WHERE seg = '4+' QUALIFY row_number() OVER (ORDER BY round(rule_score, 9) DESC, period, cycle, branch) = 1",
    f="precision lift rule_score",
)
def _(t):
    return R.best_rule(R.hit_rate_grid(_est(t).where("hist = 'year'"), _base(t), min_rows=20))


@query(
    "segment_rule_boost",
    f"""WITH {LONG}, {B.TARGET}, {BASE}, tt AS (SELECT customer_id, any_value(lo) AS lo, any_value(hi) AS hi, max(period - r) FILTER (hist = 'all' AND est = 'mean') AS tm,
  max(period - r) FILTER (hist = 'year' AND est = 'max') AS tx FROM ew GROUP BY 1),
z AS (SELECT customer_id, score, coalesce(CAST(n_orders BETWEEN 2 AND 3 AND tm > 35 AND tm <= 85 AS INT), 0) AS core,
  coalesce(CAST(n_orders >= 4 AND tx > lo AND tx <= hi AS INT), 0) AS core4 FROM base JOIN tt USING (customer_id))
SELECT customer_id, core, core4, score + core + core4 AS boosted FROM z""",
    f="boosted",
)
def _(t):
    e = _est(t)
    pick = lambda h, n: F.max(F.when((F.col("hist") == h) & (F.col("est") == n), F.col("period") - F.col("r")))
    tt = e.groupBy("customer_id").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), pick("all", "mean").alias("t_mean"), pick("year", "max").alias("t_max"))
    return R.rule_boost(_base(t).join(tt, "customer_id"))


@query(
    "metric_ap_at_20pct",
    f"""WITH {B.ORDERS}, {B.TARGET}, {BASE}, x AS (
  SELECT *, row_number() OVER w AS rn, sum(target) OVER w AS hits, count(*) OVER (PARTITION BY slice) AS n, sum(target) OVER (PARTITION BY slice) AS pos
  FROM base WINDOW w AS (PARTITION BY slice ORDER BY score DESC, customer_id ROWS UNBOUNDED PRECEDING))
SELECT slice, n, CAST(ceil(n * 0.2) AS BIGINT) AS k, CAST(pos AS BIGINT) AS positives,
  sum(CASE WHEN target = 1 THEN hits / rn ELSE 0 END) / greatest(least(ceil(n * 0.2), pos), 1) AS ap
FROM x WHERE rn <= ceil(n * 0.2) GROUP BY slice, n, pos""",
    f="ap",
)
def _(t):
    from quern.operators.metrics import ap_at_share

    return ap_at_share(_base(t), ["slice"], "target", "score", "customer_id")
