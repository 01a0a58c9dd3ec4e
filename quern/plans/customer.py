"""Customer history queries."""

from pyspark.sql import functions as F

from quern.operators import customer as C
from quern.plans import bind as B
from quern.registry import query


@query("label_window", f"WITH {B.POP} SELECT customer_id, slice, CAST(cutoff AS VARCHAR) AS cutoff, win_len FROM pop")
def _(t):
    return B.population(t).select("customer_id", "slice", F.col("cutoff").cast("string").alias("cutoff"), "win_len")


@query(
    "agg_order_level",
    f"WITH {B.ORDERS} SELECT customer_id, order_id, d, s, n, disc, loy, weekend FROM ot",
    f="s disc loy",
)
def _(t):
    return C.order_level(B.lines(t))


@query(
    "agg_customer_rfm",
    f"""WITH {B.ORDERS}, base AS (
  SELECT customer_id, min(d) AS recency, max(d) AS tenure, avg(d) AS d_mean, stddev_samp(d) AS d_std, count(*) AS n_orders,
    CAST(sum(n) AS BIGINT) AS n_items, sum(s) AS sum_paid, avg(s) AS order_sum_mean, max(s) AS order_sum_max,
    stddev_samp(s) AS order_sum_std, avg(n) AS items_per_order, max(n) AS items_max, avg(disc) AS order_disc_mean,
    avg(loy) AS order_loy_mean, max(loy) AS order_loy_max, avg(weekend) AS weekend_share,
    arg_min(s, d * 1000000000 + order_id) AS last_order_sum, arg_max(s, d * 1000000000 + order_id) AS first_order_sum,
    arg_min(loy, d * 1000000000 + order_id) AS last_loy, arg_max(loy, d * 1000000000 + order_id) AS first_loy,
    quantile_cont(s, 0.5) AS order_sum_median
  FROM ot GROUP BY 1)
SELECT *, last_loy - first_loy AS loy_change, last_order_sum / order_sum_mean AS last_sum_to_mean FROM base""",
    f="d_mean d_std sum_paid order_sum_mean order_sum_max order_sum_std items_per_order order_disc_mean order_loy_mean "
      "order_loy_max weekend_share last_order_sum first_order_sum last_loy first_loy loy_change last_sum_to_mean order_sum_median",
)
def _(t):
    return C.customer_rfm(C.order_level(B.lines(t)))


W = (7, 30, 90, 180, 365, 730)


@query(
    "agg_windowed_lookback",
    f"WITH {B.ORDERS}, w AS (SELECT customer_id, "
    + ", ".join(
        f"count(*) FILTER (d <= {w}) AS n_orders_{w}, coalesce(sum(s) FILTER (d <= {w}), 0.0) AS sum_{w}, "
        f"CAST(coalesce(sum(n) FILTER (d <= {w}), 0) AS BIGINT) AS n_items_{w}"
        for w in W
    )
    + ", " + ", ".join(f"max(loy) FILTER (d <= {w}) AS loy_max_{w}, avg(disc) FILTER (d <= {w}) AS disc_mean_{w}" for w in (90, 365))
    + """, count(*) FILTER (d > 365) AS n_orders_older_365 FROM ot GROUP BY 1)
SELECT *, sum_90 / nullif(n_orders_90, 0) AS aov_90, sum_365 / nullif(n_orders_365, 0) AS aov_365 FROM w""",
    f=" ".join(f"sum_{w}" for w in W) + " loy_max_90 loy_max_365 disc_mean_90 disc_mean_365 aov_90 aov_365",
)
def _(t):
    return C.windowed_lookback(C.order_level(B.lines(t)), W)


E_ = C.LOOKBACK_EDGES
PAIRS = list(zip(E_[:-1], E_[1:]))


@query(
    "agg_disjoint_bins",
    f"WITH {B.ORDERS}, b AS (SELECT customer_id, count(*) FILTER (d >= 0 AND d < 733) AS total, "
    + ", ".join(f"count(*) FILTER (d >= {a} AND d < {b}) AS n_{a}_{b}" for a, b in PAIRS)
    + " FROM ot GROUP BY 1) SELECT customer_id, "
    + ", ".join(f"n_{a}_{b}, n_{a}_{b} / nullif(total, 0) AS share_{a}_{b}" for a, b in PAIRS)
    + " FROM b",
    f=" ".join(f"share_{a}_{b}" for a, b in PAIRS),
)
def _(t):
    return C.disjoint_bins(C.order_level(B.lines(t)))


@query(
    "agg_month_buckets",
    f"WITH {B.DAYS} SELECT customer_id, "
    + ", ".join(f"count(*) FILTER (d // 30 = {i}) AS mb_{i:02d}" for i in range(24))
    + " FROM days GROUP BY 1",
)
def _(t):
    return C.month_buckets(C.day_level(C.order_level(B.lines(t))))


@query(
    "agg_seasonal_window",
    f"WITH {B.DAYS} SELECT customer_id, "
    + ", ".join(
        f"count(*) FILTER (d BETWEEN {365 * y - 14} - win_len - {m} AND {365 * y - 15} + {m}) AS {tag}{sfx}"
        for y, tag in ((1, "ya"), (2, "ya2")) for m, sfx in ((0, "_days"), (30, "_days_wide"))
    )
    + " FROM days JOIN pop USING (customer_id) GROUP BY 1",
)
def _(t):
    days = C.day_level(C.order_level(B.lines(t)))
    return C.seasonal_window(days.join(B.population(t).select("customer_id", "win_len"), "customer_id"))


@query(
    "agg_distinct",
    f"""WITH {B.LINES} SELECT customer_id, count(DISTINCT product_id) AS n_product_id, count(DISTINCT brand) AS n_brand,
  count(DISTINCT category) AS n_category, count(DISTINCT category2) AS n_category2, count(DISTINCT gender) AS n_gender,
  count(DISTINCT d // 7) AS n_week, count(DISTINCT strftime(order_date, '%Y-%m')) AS n_month FROM lines GROUP BY 1""",
)
def _(t):
    return C.distinct_counts(B.lines(t))


@query(
    "agg_crosstab_share",
    f"WITH {B.LINES} SELECT customer_id, "
    + ", ".join(
        f"count(*) FILTER (category = '{v}') / nullif(count(category), 0) AS share_{v.lower()}, "
        f"count(*) FILTER (category = '{v}' AND d <= 90) / nullif(count(category) FILTER (d <= 90), 0) AS share90_{v.lower()}"
        for v in B.TYPES
    )
    + " FROM lines GROUP BY 1",
    f=" ".join(f"share_{v.lower()} share90_{v.lower()}" for v in B.TYPES),
)
def _(t):
    return C.crosstab_share(B.lines(t), "category", B.TYPES)


@query(
    "agg_top_value",
    f"""WITH {B.LINES}, c AS (SELECT customer_id, brand, count(*) AS n FROM lines GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, brand) AS rn,
  sum(n) OVER (PARTITION BY customer_id) AS total FROM c)
SELECT customer_id, brand AS top_brand, n AS n_top, n / total AS share FROM r WHERE rn = 1""",
    f="share",
)
def _(t):
    return C.top_value(B.lines(t), "brand")


@query(
    "agg_top_share",
    f"""WITH {B.LINES}, c AS (SELECT customer_id, brand, count(*) AS n FROM lines GROUP BY 1, 2)
SELECT customer_id, max(n) / sum(n) AS top_share FROM c GROUP BY 1""",
    f="top_share",
)
def _(t):
    return C.top_share(B.lines(t), "brand")


@query("win_gap", f"WITH {B.GAPS} SELECT customer_id, order_id, d, k, gap FROM og")
def _(t):
    return C.order_gaps(C.order_level(B.lines(t))).select("customer_id", "order_id", "d", "k", "gap")


@query(
    "win_kth",
    f"WITH {B.DAYS} SELECT customer_id, " + ", ".join(f"max(d) FILTER (rk = {k}) AS d_day_{k + 1}" for k in (1, 2, 4, 9))
    + ", max(gap) FILTER (rk = 2) AS gap_prev FROM days GROUP BY 1",
)
def _(t):
    return C.kth_day(C.day_level(C.order_level(B.lines(t))))


K = (2, 3, 5, 10)


@query(
    "win_last_k",
    f"WITH {B.GAPS}, a AS (SELECT customer_id, min(d) AS r, "
    + ", ".join(
        f"avg(s) FILTER (k < {k}) AS sum_mean_{k}, avg(n) FILTER (k < {k}) AS items_mean_{k}, avg(disc) FILTER (k < {k}) AS disc_mean_{k}, "
        f"CASE WHEN count(*) FILTER (k < {k}) = {k} THEN max(d) FILTER (k < {k}) END AS recency_kth_{k}"
        for k in K
    )
    + " FROM og GROUP BY 1), b AS (SELECT *, "
    + ", ".join(f"recency_kth_{k} - r AS span_{k}, (recency_kth_{k} - r) / {k - 1} AS gap_mean_{k}" for k in K)
    + " FROM a) SELECT * EXCLUDE (r), " + ", ".join(f"r / nullif(gap_mean_{k}, 0) AS recency_to_gap_{k}" for k in K) + " FROM b",
    f=" ".join(f"sum_mean_{k} items_mean_{k} disc_mean_{k} gap_mean_{k} recency_to_gap_{k}" for k in K),
)
def _(t):
    return C.last_k(C.order_gaps(C.order_level(B.lines(t))), K)


@query(
    "cal_calendar",
    f"""WITH {B.ORDERS}, x AS (SELECT ot.*, day(order_date) AS dom, isodow(order_date) - 1 AS wd, month(order_date) AS mo,
  year(order_date) * 12 + month(order_date) AS mi,
  year(scoring_date) * 12 + month(scoring_date) - year(order_date) * 12 - month(order_date) AS rel,
  d * 1000000000 + order_id AS newest FROM ot JOIN pop USING (customer_id))
SELECT customer_id, arg_min(dom, newest) AS last_dom, arg_min(wd, newest) AS last_weekday, arg_min(mo, newest) AS last_month,
  avg(CAST(dom <= 10 AS INT)) AS share_dom_le10, avg(CAST(dom >= 21 AS INT)) AS share_dom_ge21,
  avg(CAST(wd >= 5 AS INT)) AS weekend_share, count(*) FILTER (rel BETWEEN 10 AND 12) AS n_window_ya,
  count(*) FILTER (rel BETWEEN 22 AND 24) AS n_window_ya2, count(*) FILTER (rel BETWEEN 13 AND 15) AS n_before_window_ya,
  count(*) FILTER (rel BETWEEN 7 AND 9) AS n_after_window_ya, count(DISTINCT mi) AS active_months,
  count(DISTINCT mi) FILTER (rel <= 12) AS active_months_year
FROM x GROUP BY 1""",
    f="share_dom_le10 share_dom_ge21 weekend_share",
)
def _(t):
    return C.calendar_features(B.orders_dated(t))
