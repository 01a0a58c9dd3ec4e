"""Alignment and sequential queries over user event series."""

from pyspark.sql import functions as F

from quern.operators import align as A
from quern.plans.series import SEQ, lc, prefix
from quern.registry import query


@query(
    "ts_step_limit",
    """WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r(user_id, event_id, rn, value) AS (SELECT user_id, event_id, rn, value FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.event_id, s.rn, r.value + least(greatest(s.value - r.value, -2.5), 2.5) FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT user_id, event_id, value FROM r""",
    f="value",
)
def _(t):
    return A.step_limit(prefix(t), "user_id", "md", "event_id", "value", 2.5)


def _sequence(t):
    """Suffix rows of each user's series with time in days as the quantity to recover."""
    p = prefix(t).withColumn("day", F.col("md") / 24)
    return p.where(F.col("rn") > F.col("n_known"))


def _start(t):
    p = prefix(t)
    return p.groupBy("user_id").agg((F.max("last_pos") / 24).alias("start"), F.lit(1.0).alias("direction"))


@query("ts_align_beam")
def _(t):
    curve = lc(t).groupBy(F.floor("t").alias("x")).agg(F.avg("flux").alias("y"))
    shared = curve.agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "y"))).alias("grid")).scalar()
    payload = _start(t).select("user_id", F.struct(shared.alias("grid"), "start").alias("payload"))
    return A.beam(_sequence(t), payload, "user_id", "day", "event_id", "value")


@query(
    "ts_match_ncc",
    f"""WITH {SEQ}, s AS (SELECT user_id, event_id, md, value, tvt_input, last_known, rn <= n_known AS k FROM pf),
g AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, k) AS n, avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS g FROM s WINDOW w AS (PARTITION BY user_id, k ORDER BY md, event_id)),
a AS (SELECT user_id, k, list(g ORDER BY i) AS all_g FROM g GROUP BY ALL),
h AS (SELECT unnest([8, 15, 25]) AS h),
w AS (SELECT user_id, event_id, k, i, n, h, tvt_input, last_known, list_transform(range(i - h, i + h + 1), lambda j: all_g[greatest(1, least(n, j))]) AS w FROM g JOIN a USING (user_id, k), h
      WHERE NOT k OR (i > h AND i <= n - h AND (i - 1 - h) % 3 = 0 AND n > 2 * h + 1)),
z AS (SELECT * EXCLUDE (w), list_transform(w, lambda x: (x - list_avg(w)) / (list_stddev_pop(w) + 1e-6)) AS z FROM w),
m AS (SELECT s.event_id, s.h, round(list_dot_product(s.z, c.z) / (2 * s.h + 1), 9) AS score, c.i, c.tvt_input FROM z AS s JOIN z AS c ON s.user_id = c.user_id AND s.h = c.h AND c.k AND NOT s.k),
b AS (SELECT event_id, h, max(score) AS score, arg_max(tvt_input, (score, -i)) AS pos FROM m GROUP BY ALL),
o AS (SELECT s.user_id, s.event_id, s.h, coalesce(b.pos, s.last_known) AS pos, coalesce(b.score, 0) AS score FROM z AS s LEFT JOIN b USING (event_id, h) WHERE NOT s.k),
r AS (SELECT user_id, event_id, {", ".join(f"max(pos) FILTER (h = {h}) AS pos_{h}, max(score) FILTER (h = {h}) AS score_{h}" for h in (8, 15, 25))} FROM o GROUP BY ALL)
SELECT *, (exp(3 * score_8) * pos_8 + exp(3 * score_15) * pos_15 + exp(3 * score_25) * pos_25) / (exp(3 * score_8) + exp(3 * score_15) + exp(3 * score_25)) AS matched FROM r""",
    f="pos_8 score_8 pos_15 score_15 pos_25 score_25 matched",
)
def _(t):
    return A.match_ncc(prefix(t), "user_id", "md", "event_id", "tvt_input", "value")


@query(
    "ts_feature_bank",
    """WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1), d AS (SELECT e.*, med FROM events e JOIN m USING (user_id)),
s AS (SELECT user_id, greatest(1.4826e0 * quantile_cont(abs(value - med), 0.5), 1e-3) AS sc FROM d GROUP BY 1),
w AS (SELECT event_id, value, sc, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS m, stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS s,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS q, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND 9 FOLLOWING) AS a, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND 11 FOLLOWING) AS b FROM d JOIN s USING (user_id))
SELECT event_id, round(least(greatest((value - m) / greatest(coalesce(s, 0), 0.25 * sc), -5.0), 5.0), 6) AS f_raw, round(least(greatest((q - m) / greatest(coalesce(s, 0), 0.25 * sc), -5.0), 5.0), 6) AS f_smooth, round(least(greatest((b - a) / 2 / sc, -5.0), 5.0), 6) AS f_slope FROM w""",
    f="f_raw f_smooth f_slope",
)
def _(t):
    out = A.feature_bank(lc(t).select("user_id", "event_id", "pos", F.col("flux").alias("value")), "user_id", "pos", "event_id", "value")
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("f_raw", "f_smooth", "f_slope")])
