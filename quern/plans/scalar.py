"""Row-wise, cleaning and imputation queries."""

from pyspark.sql import functions as F

from quern.functions.mathx import clip, micros
from quern.operators import scalar as X
from quern.plans import bind as B
from quern.registry import query

S = B.SURVEY
EV = "ev AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"


def ev(t):
    return t.events.select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("safe_ratio_null", f"WITH {EV} SELECT event_id, value / nullif(k, 0) AS r FROM ev", f="r")
def _(t):
    return ev(t).select("event_id", X.ratio_null("value", "k").alias("r"))


@query("safe_ratio_eps", f"WITH {EV} SELECT event_id, value / (k + 1e-6::DOUBLE) AS r FROM ev", f="r")
def _(t):
    return ev(t).select("event_id", X.ratio_eps("value", "k").alias("r"))


@query("nan_inf_clean", f"WITH {EV} SELECT event_id, CASE WHEN k % 10 = 0 OR k % 10 = 1 THEN NULL ELSE value END AS v FROM ev")
def _(t):
    raw = F.when(F.col("k") % 10 == 0, F.lit(float("nan"))).when(F.col("k") % 10 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return ev(t).select("event_id", X.finite(raw).alias("v"))


@query("downcast", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS l_quantity, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS l_extendedprice FROM lineitem", f="l_quantity l_extendedprice")
def _(t):
    return X.downcast(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@query(
    "bin_cut",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice <= 100000 THEN 'low' WHEN o_totalprice > 100000 AND o_totalprice <= 300000 THEN 'mid' WHEN o_totalprice > 300000 AND o_totalprice <= 450000 THEN 'high' END AS right_closed,
  CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN 'low' WHEN o_totalprice >= 100000 AND o_totalprice < 300000 THEN 'mid' WHEN o_totalprice >= 300000 AND o_totalprice < 450000 THEN 'high' END AS left_closed FROM orders""",
)
def _(t):
    e, n = (0, 100000, 300000, 450000), ("low", "mid", "high")
    return t.orders.select("o_orderkey", X.bin_cut("o_totalprice", e, n, lowest=True).alias("right_closed"), X.bin_cut("o_totalprice", e, n, right=False).alias("left_closed"))


@query("floor_bin", "SELECT o_orderkey, CAST(floor(o_totalprice / 7500) AS BIGINT) AS b FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.floor_bin("o_totalprice", 7500).alias("b"))


@query("log1p_nonneg", "SELECT c_custkey, c_acctbal AS c_acctbal_log, ln(1 + c_custkey) AS c_custkey_log FROM customer", f="c_custkey_log")
def _(t):
    return X.log1p_nonneg(t.customer, ["c_acctbal", "c_custkey"]).select("c_custkey", "c_acctbal_log", "c_custkey_log")


@query(
    "cyclic_hour",
    f"WITH {EV}, h AS (SELECT event_id, CAST(floor((event_id * 37.5 - 50000) / 3600) AS BIGINT) AS hh FROM ev), g AS (SELECT event_id, ((hh % 24) + 24) % 24 AS hour FROM h) SELECT event_id, hour, round(sin(hour * {2 * 3.141592653589793 / 24!r}), 12) AS hour_sin, round(cos(hour * {2 * 3.141592653589793 / 24!r}), 12) AS hour_cos FROM g",
    f="hour_sin hour_cos",
)
def _(t):
    out = ev(t).select("event_id", *[x.alias(n) for n, x in X.cyclic_hour(F.col("event_id") * 37.5 - 50000).items()])
    return out.withColumns({n: F.round(n, 12) for n in ("hour_sin", "hour_cos")})


@query("clip", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS bal FROM customer")
def _(t):
    return t.customer.select("c_custkey", clip(F.col("c_acctbal"), 0.0, 5000.0).alias("bal"))


@query(
    "digit_features",
    "SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) % 10 AS units, CAST(floor(abs(c_acctbal) / 10) AS BIGINT) % 10 AS tens, CAST(floor(abs(c_acctbal) / 100) AS BIGINT) % 10 AS hundreds, CAST(floor(round(abs(c_acctbal) * 10, 6)) AS BIGINT) % 10 AS d1, CAST(floor(round(abs(c_acctbal) * 100, 6)) AS BIGINT) % 10 AS d2 FROM customer",
)
def _(t):
    return t.customer.select("c_custkey", *[X.digit("c_acctbal", p).alias(n) for n, p in (("units", 0), ("tens", 1), ("hundreds", 2), ("d1", -1), ("d2", -2))])


@query(
    "float_signature",
    """WITH w AS (SELECT l_orderkey, l_linenumber, l_discount, CAST(round_even(abs(l_discount) * 100, 0) AS BIGINT) AS v FROM lineitem),
d AS (SELECT *, v % 10 AS d0, v // 10 % 10 AS d1, v // 100 % 10 AS d2, v // 1000 % 10 AS d3 FROM w)
SELECT l_orderkey, l_linenumber, CASE WHEN (SELECT max(d0) > min(d0) FROM d) THEN d0 END AS l_discount_d0, CASE WHEN (SELECT max(d1) > min(d1) FROM d) THEN d1 END AS l_discount_d1,
  CASE WHEN (SELECT max(d2) > min(d2) FROM d) THEN d2 END AS l_discount_d2, CASE WHEN (SELECT max(d3) > min(d3) FROM d) THEN d3 END AS l_discount_d3, concat(d3, d2, d1, d0) AS l_discount_sig FROM d""",
)
def _(t):
    return X.float_signature(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount"), "l_discount").drop("l_discount")


@query("rounded_string", "SELECT o_orderkey, printf('%.0f', round_even(o_totalprice / 1000, 0)) AS s FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.rounded_string(F.col("o_totalprice") / 1000, 0).alias("s"))


@query("category_cross", f"WITH {S} SELECT id, coalesce(seg, 'Missing') || '_' || prio || '_' || target AS combo FROM survey")
def _(t):
    return B.survey(t).select("id", X.category_cross(["seg", "prio", "target"]).alias("combo"))


@query("normalize_category", f"WITH {S} SELECT id, coalesce(lower(seg), 'missing') AS seg_norm FROM survey")
def _(t):
    return B.survey(t).select("id", X.normalize_category(F.concat(F.lit("  "), "seg", F.lit(" "))).alias("seg_norm"))


@query("ordinal_map", f"WITH {S} SELECT id, CASE prio WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 ELSE -1 END AS code, CASE seg WHEN 'BUILDING' THEN 1 END AS open_code FROM survey")
def _(t):
    levels = {"5-LOW": 0, "3-MEDIUM": 1, "2-HIGH": 2, "1-URGENT": 3}
    return B.survey(t).select("id", X.ordinal_map("prio", levels).alias("code"), X.ordinal_map("seg", {"BUILDING": 1}, None).alias("open_code"))


@query(
    "flag_rules",
    f"WITH {S}, f AS (SELECT id, coalesce(CAST(acct < 0 AS INT), 0) AS overdrawn, coalesce(CAST(total > 300000 AS INT), 0) AS large, CAST(day > 1800 AS INT) AS recent FROM survey) SELECT *, overdrawn + large + recent AS risk_score, least(large, recent) AS all_flags FROM f",
)
def _(t):
    rules = {"overdrawn": F.col("acct") < 0, "large": F.col("total") > 300000, "recent": F.col("day") > 1800}
    return X.flag_rules(B.survey(t), rules, ["large", "recent"]).select("id", *rules, "risk_score", "all_flags")


@query(
    "row_stats",
    f"""WITH {S}, l AS ({B.sql_long(('total', 'acct', 'day'), 'survey', 'id')}), a AS (SELECT id, avg(x) AS row_mean, stddev_samp(x) AS row_std, min(x) AS row_min, max(x) AS row_max, max(x) - min(x) AS row_range FROM l GROUP BY 1)
SELECT a.*, total - acct AS total_minus_acct, total - day AS total_minus_day, acct - day AS acct_minus_day FROM a JOIN survey USING (id)""",
    f="row_mean row_std row_min row_max row_range total_minus_acct total_minus_day acct_minus_day",
)
def _(t):
    return X.row_stats(B.survey(t).select("id", "total", "acct", "day"), ["total", "acct", "day"]).drop("total", "acct", "day")


SPEC = {
    "price_per_unit": "l_extendedprice / nullif(l_quantity, 0)",
    "net": "l_extendedprice * (1 - l_discount)",
    "tax_pressure": "l_tax / (l_discount + 0.01)",
    "wear_rate": "l_quantity / (l_linenumber + 1)",
    "wear_left": "greatest(50 - l_quantity, 0) * l_linenumber",
}


@query("domain_ratios", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{v} AS {k}" for k, v in SPEC.items()) + " FROM lineitem", f=" ".join(SPEC))
def _(t):
    return X.domain_features(t.lineitem, SPEC).select("l_orderkey", "l_linenumber", *SPEC)


@query("missing_indicators", f"WITH {S} SELECT id, CAST(total IS NULL AS INT) AS total_is_missing, CAST(acct IS NULL AS INT) AS acct_is_missing, CAST(seg IS NULL AS INT) AS seg_is_missing FROM survey")
def _(t):
    return X.missing_indicators(B.survey(t).select("id", "total", "acct", "seg"), ["total", "acct", "seg"]).drop("total", "acct", "seg")


@query(
    "impute_median_train",
    f"WITH {S} SELECT id, coalesce(total, (SELECT quantile_cont(total, 0.5) FROM train)) AS total, coalesce(acct, (SELECT quantile_cont(acct, 0.5) FROM train)) AS acct, coalesce(total, (SELECT quantile_cont(total, 0.5) FROM survey)) AS total_pooled FROM survey",
    f="total acct total_pooled",
)
def _(t):
    s = B.survey(t).withColumn("total_pooled", F.col("total"))
    out = X.impute_median(s, ["total", "acct"], fit=s.where("id % 5 <> 0"))
    return X.impute_median(out, ["total_pooled"]).select("id", "total", "acct", "total_pooled")


@query(
    "impute_mode",
    f"WITH {S} SELECT id, coalesce(seg, (SELECT seg FROM survey WHERE seg IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, seg LIMIT 1)) AS seg FROM survey",
)
def _(t):
    return X.impute_mode(B.survey(t), ["seg"]).select("id", "seg")


SER = """ser AS (SELECT event_id, user_id, epoch_us(ts) AS pos, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events)"""


def ser(t):
    return t.events.select("event_id", "user_id", micros("ts").alias("pos"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))


@query(
    "impute_interpolate",
    f"""WITH {SER}, r AS (SELECT *, row_number() OVER w AS n FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER a AS n0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER b AS n1, first_value(v IGNORE NULLS) OVER b AS v1,
  quantile_cont(v, 0.5) OVER (PARTITION BY user_id) AS med FROM r
  WINDOW a AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, user_id, coalesce(v, CASE WHEN n0 IS NOT NULL AND n1 IS NOT NULL AND (n - n0 <= 100 OR n1 - n <= 100) THEN v0 + (v1 - v0) * (n - n0) / nullif(n1 - n0, 0) WHEN n1 IS NULL AND n - n0 <= 100 THEN v0 WHEN n0 IS NULL AND n1 - n <= 100 THEN v1 END, med) AS v_filled FROM p""",
    f="v_filled",
)
def _(t):
    return X.interpolate(ser(t), ["user_id"], "pos", "v").select("event_id", "user_id", "v_filled")


@query(
    "forward_backward_fill",
    f"""WITH {SER}, s AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY pos) AS s FROM ser),
f AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS f FROM s)
SELECT event_id, first_value(f IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v_lag1 FROM f""",
)
def _(t):
    return X.fill_after_shift(ser(t), ["user_id"], "pos", "v").select("event_id", "v_lag1")


@query(
    "standard_scale",
    f"WITH {S} SELECT id, round((total - (SELECT avg(total) FROM train)) / (SELECT stddev_pop(total) FROM train), 9) AS total_z, round((acct - (SELECT avg(acct) FROM train)) / (SELECT stddev_pop(acct) FROM train), 9) AS acct_z FROM survey",
    f="total_z acct_z",
)
def _(t):
    s = B.survey(t)
    out = X.standard_scale(s, ["total", "acct"], fit=s.where("id % 5 <> 0"))
    return out.select("id", F.round("total_z", 9).alias("total_z"), F.round("acct_z", 9).alias("acct_z"))


@query(
    "robust_zscore",
    """WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd FROM events GROUP BY 1),
d AS (SELECT event_id, user_id, value, med, sd, abs(value - med) AS dev FROM events JOIN m USING (user_id)), a AS (SELECT user_id, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY 1)
SELECT event_id, (value - med) / (CASE WHEN mad > 0 THEN mad * 1.4826 WHEN sd > 0 THEN sd END) AS value_rz FROM d JOIN a USING (user_id)""",
    f="value_rz",
)
def _(t):
    return X.robust_zscore(t.events.select("event_id", "user_id", "value"), ["user_id"], "value", scale=1.4826).select("event_id", "value_rz")


@query("to_numeric_coerce", "SELECT page_id, TRY_CAST(trim(regexp_extract(url, '/([^/]*)$', 1)) AS DOUBLE) AS n, TRY_CAST(substr(url, 6, 1) AS DOUBLE) AS m FROM pages")
def _(t):
    return t.pages.select("page_id", X.to_numeric(F.regexp_extract("url", "/([^/]*)$", 1)).alias("n"), X.to_numeric(F.substring("url", 6, 1)).alias("m"))


@query("class_encode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code, o_orderstatus AS decoded FROM orders")
def _(t):
    return X.class_encode(t.orders, "o_orderstatus", B.CLASSES).select("o_orderkey", "code", "decoded")
