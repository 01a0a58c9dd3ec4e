"""Series queries: events as light curves and as sequences with a known prefix."""

from pyspark.sql import functions as F

from quern.functions.mathx import micros
from quern.operators import series as T
from quern.plans import bind as B
from quern.registry import query

T0 = 1704067200000000  # microseconds at the first day of the events
LC = f"""lc AS (SELECT user_id, event_id, event_type AS band, epoch_us(ts) AS pos, (epoch_us(ts) - {T0}) / 86400000000e0 AS t, value AS flux,
  CAST(json_extract(props, '$.k') AS INT) / 20e0 AS err FROM events)"""


def lc(t):
    k = F.get_json_object("props", "$.k").cast("int")
    pos = micros("ts")
    return t.events.select(
        "user_id", "event_id", F.col("event_type").alias("band"), pos.alias("pos"), ((pos - F.lit(T0)) / F.lit(86400000000.0)).alias("t"),
        F.col("value").alias("flux"), (k / F.lit(20.0)).alias("err"),
    )


def mom(x, mad):
    return f"""count({x}) AS count, avg({x}) AS mean, stddev_pop({x}) AS std, min({x}) AS min, max({x}) AS max, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.1) AS p10, quantile_cont({x}, 0.9) AS p90,
  {mad} AS mad, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr, CASE WHEN count({x}) < 3 THEN NULL ELSE round(skewness({x}), 6) END AS skew, CASE WHEN count({x}) < 4 THEN NULL ELSE round(kurtosis({x}), 6) END AS kurt, max({x}) - min({x}) AS amp"""


FL = "mean std min max median p10 p90 mad iqr skew kurt amp"


def rounded(df, cols=("skew", "kurt"), n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("agg_moments", f"WITH {LC}, m AS (SELECT user_id, quantile_cont(flux, 0.5) AS md FROM lc GROUP BY 1) SELECT user_id, {mom('flux', 'quantile_cont(abs(flux - md), 0.5)')} FROM lc JOIN m USING (user_id) GROUP BY 1", f=FL)
def _(t):
    return rounded(T.moments(lc(t), ["user_id"], "flux"))


@query("agg_weighted", f"WITH {LC}, w AS (SELECT *, 1.0 / (err * err + 1e-6) AS w FROM lc WHERE err > 0), m AS (SELECT user_id, sum(w * flux) / sum(w) AS wmean FROM w GROUP BY 1) SELECT user_id, wmean, sqrt(sum(w * pow(flux - wmean, 2)) / sum(w)) AS wstd FROM w JOIN m USING (user_id) GROUP BY 1, 2", f="wmean wstd")
def _(t):
    return T.weighted(lc(t), ["user_id"], "flux", "err")


@query("agg_snr", f"WITH {LC}, s AS (SELECT user_id, CASE WHEN err > 0 THEN flux / err END AS x FROM lc), m AS (SELECT user_id, quantile_cont(x, 0.5) AS md FROM s GROUP BY 1) SELECT user_id, {mom('x', 'quantile_cont(abs(x - md), 0.5)')} FROM s JOIN m USING (user_id) GROUP BY 1", f=FL)
def _(t):
    return rounded(T.moments(lc(t).withColumn("x", T.snr("flux", "err")), ["user_id"], "x"))


BAND = ("click", "error", "purchase", "signup", "view")  # fixed values: all event types


@query(
    "agg_band_pivot",
    f"""WITH {LC}, m AS (SELECT user_id, band, quantile_cont(flux, 0.5) AS md FROM lc GROUP BY 1, 2), a AS (SELECT user_id, band, {mom('flux', 'quantile_cont(abs(flux - md), 0.5)')} FROM lc JOIN m USING (user_id, band) WHERE band IN {BAND} GROUP BY 1, 2)
SELECT user_id, {', '.join(f"coalesce(max(count) FILTER (band = '{b}'), 0) AS {b}_count, " + ', '.join(f"max({c}) FILTER (band = '{b}') AS {b}_{c}" for c in FL.split()) for b in BAND)},
  round(max(mean) FILTER (band = 'click') - max(mean) FILTER (band = 'error'), 6) AS colour_click_error, round(max(mean) FILTER (band = 'error') - max(mean) FILTER (band = 'view'), 6) AS colour_error_view FROM a GROUP BY 1""",
    f=" ".join(f"{b}_{c}" for b in BAND for c in FL.split()) + " colour_click_error colour_error_view",
)
def _(t):
    out = T.band_pivot(lc(t), "user_id", "band", "flux", BAND, [("click", "error"), ("error", "view")])
    return rounded(out, [f"{b}_{c}" for b in BAND for c in ("skew", "kurt")] + ["colour_click_error", "colour_error_view"])


ED = (0, 1, 3, 7, 14, 30)
TAGS = [f"bin_{a}_{b}" for a, b in zip(ED[:-1], ED[1:])]


@query(
    "agg_time_bins",
    f"WITH {LC}, z AS (SELECT *, t - min(t) OVER (PARTITION BY user_id) AS dt FROM lc) SELECT user_id, "
    + ", ".join(
        f"count(*) FILTER (dt >= {a} AND dt < {b}) AS bin_{a}_{b}_count, avg(flux) FILTER (dt >= {a} AND dt < {b}) AS bin_{a}_{b}_mean, stddev_pop(flux) FILTER (dt >= {a} AND dt < {b}) AS bin_{a}_{b}_std, min(flux) FILTER (dt >= {a} AND dt < {b}) AS bin_{a}_{b}_min, max(flux) FILTER (dt >= {a} AND dt < {b}) AS bin_{a}_{b}_max"
        for a, b in zip(ED[:-1], ED[1:])
    )
    + " FROM z GROUP BY 1",
    f=" ".join(f"{g}_mean {g}_std {g}_min {g}_max" for g in TAGS),
)
def _(t):
    return T.time_bins(T.t0_dt(lc(t), "user_id", "t"), "user_id", "dt", "flux", ED)


@query("win_t0_dt", f"WITH {LC} SELECT event_id, user_id, min(t) OVER (PARTITION BY user_id) AS t0, t - min(t) OVER (PARTITION BY user_id) AS dt FROM lc", f="t0 dt")
def _(t):
    return T.t0_dt(lc(t), "user_id", "t").select("event_id", "user_id", "t0", "dt")


@query(
    "win_cadence",
    f"WITH {LC}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM lc) SELECT user_id, max(t) - min(t) AS span, avg(g) AS gap_mean, max(g) AS gap_max, quantile_cont(g, 0.5) AS gap_median, quantile_cont(g, 0.9) AS gap_p90 FROM g GROUP BY 1",
    f="span gap_mean gap_max gap_median gap_p90",
)
def _(t):
    return T.cadence(lc(t), "user_id", "t", "event_id")


@query(
    "win_max_rates",
    f"WITH {LC}, g AS (SELECT *, t - lag(t) OVER w AS g, flux - lag(flux) OVER w AS df FROM lc WINDOW w AS (PARTITION BY user_id, band ORDER BY t, event_id)) SELECT user_id, band, max(df / g) FILTER (g > 0) AS rise_rate, min(df / g) FILTER (g > 0) AS decay_rate FROM g GROUP BY 1, 2",
    f="rise_rate decay_rate",
)
def _(t):
    return T.max_rates(lc(t), ["user_id", "band"], "t", "flux", "event_id")


@query(
    "win_sequence_features",
    f"""WITH {LC}, d AS (SELECT *, t - min(t) OVER p AS dt, max(t) OVER p - min(t) OVER p AS span, quantile_cont(flux, 0.5) OVER p AS med, coalesce(t - lag(t) OVER o, 0) AS step_t, coalesce(flux - lag(flux) OVER o, 0) AS step_v FROM lc WINDOW p AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY t, event_id)),
m AS (SELECT user_id, quantile_cont(abs(flux - med), 0.5) AS mad FROM d GROUP BY 1) SELECT event_id, dt, dt / (span + 1e-6) AS dt_norm, ln(1 + dt) AS dt_log, (flux - med) / mad AS z, CASE WHEN err > 0 THEN flux / err ELSE 0 END AS snr, step_t, step_v FROM d JOIN m USING (user_id)""",
    f="dt dt_norm dt_log z snr step_t step_v",
)
def _(t):
    return T.sequence_features(lc(t), "user_id", "t", "flux", "err", "event_id").select("event_id", "dt", "dt_norm", "dt_log", "z", "snr", "step_t", "step_v")


@query("win_min_obs_filter", f"WITH {LC} SELECT event_id, user_id FROM lc QUALIFY count(flux) OVER (PARTITION BY user_id) >= 65")
def _(t):
    return T.min_obs(lc(t), "user_id", "flux", 65).select("event_id", "user_id")


PEAK = "pk AS (SELECT user_id, t AS t_peak, flux AS peak_value, CASE WHEN err > 0 THEN flux / err END AS peak_snr FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY flux DESC, t) AS rn FROM lc) WHERE rn = 1)"


@query("ts_peak", f"WITH {LC}, {PEAK} SELECT pk.*, (SELECT max(t) FROM lc WHERE lc.user_id = pk.user_id) - t_peak AS after_peak FROM pk", f="t_peak peak_value peak_snr after_peak")
def _(t):
    return T.peak(lc(t), "user_id", "t", "flux", "err")


@query(
    "ts_half_max_width",
    f"WITH {LC}, g AS (SELECT *, flux - lag(flux) OVER (PARTITION BY user_id, band ORDER BY t, event_id) AS d, max(flux) OVER (PARTITION BY user_id, band) AS top FROM lc) SELECT user_id || band AS series, CASE WHEN count(*) FILTER (flux >= 0.5 * top) > 1 THEN max(t) FILTER (flux >= 0.5 * top) - min(t) FILTER (flux >= 0.5 * top) END AS fwhm, CASE WHEN count(*) > 1 AND var_pop(flux) > 0 THEN sum(d * d) / (count(*) - 1) / var_pop(flux) END AS von_neumann FROM g GROUP BY 1",
    f="fwhm von_neumann",
)
def _(t):
    return T.half_max_width(lc(t).withColumn("series", F.concat("user_id", "band")), "series", "t", "flux", "event_id")


@query("ts_slope", f"WITH {LC} SELECT user_id, band, round(regr_slope(flux, t), 6) AS slope, count(flux) AS n FROM lc GROUP BY 1, 2", f="slope")
def _(t):
    return rounded(T.slope(lc(t), ["user_id", "band"], "t", "flux"), ["slope"])


@query(
    "ts_decay_fit",
    f"WITH {LC}, {PEAK}, x AS (SELECT user_id, CASE WHEN t >= t_peak AND flux > 0 THEN t - t_peak END AS x, CASE WHEN t >= t_peak AND flux > 0 THEN ln(flux) END AS y FROM lc JOIN pk USING (user_id)) SELECT user_id, count(y) AS decay_n, CASE WHEN count(y) >= 3 THEN round(regr_slope(y, x), 6) END AS decay_slope, CASE WHEN count(y) >= 3 THEN round(regr_r2(y, x), 6) END AS decay_r2 FROM x GROUP BY 1",
    f="decay_slope decay_r2",
)
def _(t):
    return rounded(T.decay_fit(lc(t), "user_id", "t", "flux", "err"), ["decay_slope", "decay_r2"])


# sequences: hours along the path, a smooth truth known for the first 30 % of each user's rows
SEQ0 = f"""SELECT user_id, event_id, (epoch_us(ts) - {T0}) / 3600000000e0 AS md, CAST(json_extract(props, '$.k') AS INT) * 1e0 AS z, CASE WHEN event_id % 3 > 0 THEN value END AS gr,
  value, 100 + 0.1e0 * (epoch_us(ts) - {T0}) / 3600000000e0 + value / 50 AS tvt FROM events"""
SEQ = f"""seq AS (SELECT *, CASE WHEN rn <= 0.3 * n_rows THEN tvt END AS tvt_input FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n_rows FROM ({SEQ0}))),
pre AS (SELECT *, max(CASE WHEN tvt_input IS NOT NULL THEN md END) OVER (PARTITION BY user_id) AS last_pos, count(tvt_input) OVER (PARTITION BY user_id) AS n_known,
  max(CASE WHEN tvt_input IS NOT NULL THEN rn END) OVER (PARTITION BY user_id) AS last_rn FROM seq),
pf AS (SELECT *, max(CASE WHEN rn = last_rn THEN tvt_input END) OVER (PARTITION BY user_id) AS last_known FROM pre)"""


def seq(t):
    pos = micros("ts") - F.lit(T0)
    s = t.events.select(
        "user_id", "event_id", (pos / F.lit(3600000000.0)).alias("md"), (F.get_json_object("props", "$.k").cast("int") * F.lit(1.0)).alias("z"),
        F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("gr"), "value",
        (100 + F.lit(0.1) * pos / F.lit(3600000000.0) + F.col("value") / 50).alias("tvt"),
    )
    from quern.functions.ordered import join_keys, numbered

    s = numbered(s, ["user_id"], F.col("md"), ["md", "event_id"], "_i")
    s = join_keys(s, s.groupBy("user_id").agg(F.count(F.lit(1)).alias("_m")), ["user_id"])
    return s.withColumn("tvt_input", F.when(F.col("_i") <= 0.3 * F.col("_m"), F.col("tvt"))).drop("_i", "_m")


def prefix(t):
    return T.prefix_frame(seq(t), "user_id", "md", "event_id", "tvt_input")


WO = "(PARTITION BY user_id ORDER BY md, event_id)"


@query("win_steps", f"WITH {SEQ} SELECT event_id, md - lag(md) OVER w AS step_md, value - lag(value) OVER w AS step_value, z - lag(z) OVER w AS step_z, sqrt(pow(md - lag(md) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step_2d FROM seq WINDOW w AS {WO}", f="step_md step_value step_z step_2d")
def _(t):
    return T.steps(seq(t), "user_id", "md", "event_id", ["md", "value", "z"], ("md", "z")).select("event_id", "step_md", "step_value", "step_z", "step_2d")


TR, CE = (5, 25, 75), (5, 21, 51, 101)


@query(
    "win_rolling",
    f"WITH {SEQ} SELECT event_id, "
    + ", ".join(f"avg(value) OVER t{n} AS mean_{n}, round(stddev_samp(value) OVER t{n}, 6) AS std_{n}, min(value) OVER t{n} AS min_{n}, max(value) OVER t{n} AS max_{n}" for n in TR) + ", "
    + ", ".join(f"avg(value) OVER c{n} AS cmean_{n}, max(abs(value)) OVER c{n} AS envelope_{n}, avg(value * value) OVER c{n} AS energy_{n}" for n in CE)
    + " FROM seq WINDOW " + ", ".join(f"t{n} AS (PARTITION BY user_id ORDER BY md, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in TR) + ", "
    + ", ".join(f"c{n} AS (PARTITION BY user_id ORDER BY md, event_id ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING)" for n in CE),
    f=" ".join(f"mean_{n} std_{n} min_{n} max_{n}" for n in TR) + " " + " ".join(f"cmean_{n} envelope_{n} energy_{n}" for n in CE),
)
def _(t):
    out = T.rolling(seq(t), "user_id", "md", "event_id", "value", TR, CE)
    keep = [f"{a}_{n}" for n in TR for a in ("mean", "std", "min", "max")] + [f"{a}_{n}" for n in CE for a in ("cmean", "envelope", "energy")]
    return rounded(out.select("event_id", *keep), [f"std_{n}" for n in TR])


SH = (1, 5, 15, 30)


@query(
    "win_lag_lead",
    f"WITH {SEQ} SELECT event_id, " + ", ".join(f"lag(value, {s}) OVER w AS lag_{s}, lead(value, {s}) OVER w AS lead_{s}" for s in SH)
    + f", value - lag(value) OVER w AS diff_1, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS diff_2, (z - lag(z) OVER w) / nullif(md - lag(md) OVER w, 0) AS dz_dmd FROM seq WINDOW w AS {WO}",
    f="diff_1 diff_2 dz_dmd",
)
def _(t):
    out = T.lag_lead(seq(t), "user_id", "md", "event_id", "value", "z", "md", SH)
    return out.select("event_id", *[f"{a}_{s}" for s in SH for a in ("lag", "lead")], "diff_1", "diff_2", "dz_dmd")


@query("win_fraction", f"WITH {SEQ} SELECT event_id, (rn - n_known - 1) / greatest(n_rows - n_known - 1, 1) AS frac, md - last_pos AS since FROM pf WHERE rn > n_known", f="frac since")
def _(t):
    return T.fraction(prefix(t), "md").select("event_id", "frac", "since")


@query("delta_target", f"WITH {SEQ} SELECT event_id, tvt - last_known AS delta, tvt - last_known + last_known AS restored FROM pf WHERE rn > n_known", f="delta restored")
def _(t):
    p = T.fraction(prefix(t), "md").withColumn("delta", T.delta_target(F.col("tvt"), F.col("last_known")))
    return p.select("event_id", "delta", (F.col("delta") + F.col("last_known")).alias("restored"))


@query(
    "ts_median_slope_extrapolate",
    f"WITH {SEQ}, l AS (SELECT *, (tvt_input - lag(tvt_input) OVER {WO}) / nullif(md - lag(md) OVER {WO}, 0) AS s FROM pf WHERE rn <= n_known AND rn > n_known - 10), m AS (SELECT user_id, quantile_cont(s, 0.5) AS slope FROM l GROUP BY 1) SELECT event_id, last_known AS constant, last_known + coalesce(slope, 0) * (md - last_pos) AS extrapolated FROM pf JOIN m USING (user_id) WHERE rn > n_known",
    f="constant extrapolated",
)
def _(t):
    return T.median_slope_extrapolate(prefix(t), "user_id", "md", "event_id", "tvt_input", 10).select("event_id", "constant", "extrapolated")


@query("ts_prefix_poly")
def _(t):
    return T.prefix_poly(prefix(t), "user_id", "md", "tvt_input", "tvt", (5, 10, 20))


@query(
    "ts_affine_calibrate",
    f"WITH {SEQ}, a AS (SELECT user_id, count(*) FILTER (gr IS NOT NULL AND tvt IS NOT NULL) AS n, regr_slope(tvt, gr) AS s, regr_intercept(tvt, gr) AS i, avg(tvt) - avg(gr) AS d FROM seq GROUP BY 1) SELECT user_id, n, CASE WHEN n >= 45 THEN round(s, 6) ELSE 1.0 END AS scale, CASE WHEN n >= 45 THEN i ELSE d END AS offset FROM a",
    f="scale offset",
)
def _(t):
    return rounded(T.affine_calibrate(seq(t), "user_id", "gr", "tvt", 45), ["scale"])


@query(
    "ts_segment_medians",
    f"""WITH {SEQ}, x AS (SELECT *, tvt_input + z AS v, rn - 1 AS i, n_known // 3 AS t1, 2 * n_known // 3 AS t2 FROM pf WHERE rn <= n_known),
m AS (SELECT user_id, quantile_cont(v, 0.5) AS b_full, quantile_cont(v, 0.5) FILTER (t1 > 0 AND i < greatest(1, t1)) AS e, quantile_cont(v, 0.5) FILTER (t2 > t1 AND i >= t1 AND i < greatest(t1 + 1, t2)) AS md_, quantile_cont(v, 0.5) FILTER (n_known >= 5 AND i >= n_known - 50) AS l, sum(exp(0.02 * (i - n_known + 1)) * v) / sum(exp(0.02 * (i - n_known + 1))) AS b_wls FROM x GROUP BY 1)
SELECT user_id, b_full, coalesce(e, b_full) AS b_early, coalesce(md_, b_full) AS b_mid, coalesce(l, b_full) AS b_late, b_wls FROM m""",
    f="b_full b_early b_mid b_late b_wls",
)
def _(t):
    return T.segment_medians(prefix(t), "user_id", F.col("tvt_input") + F.col("z"))


@query(
    "ts_surface_offset",
    f"""WITH {SEQ}, x AS (SELECT *, 90 + md / 9 + z / 100 AS raw, CASE WHEN rn <= n_known THEN tvt_input - (90 + md / 9 + z / 100) END AS d FROM pf), q AS (SELECT user_id, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.1) AS lo, quantile_cont(d, 0.9) AS hi FROM x GROUP BY 1),
f AS (SELECT user_id, count(d) AS n, avg(d) AS om, max(med) AS omed, avg(d) FILTER (d BETWEEN lo AND hi) AS ot, regr_intercept(d, md - last_pos) FILTER (rn > n_known - 500) AS oi, regr_slope(d, md - last_pos) FILTER (rn > n_known - 500) AS os, max(md) AS e FROM x JOIN q USING (user_id) GROUP BY 1)
SELECT event_id, raw + om AS pred_mean, raw + omed AS pred_median, raw + ot AS pred_trimmed, raw + oi + os * (md - e) AS pred_line FROM x JOIN f USING (user_id) WHERE rn > n_known AND n >= 15""",
    f="pred_mean pred_median pred_trimmed pred_line",
)
def _(t):
    p = prefix(t).withColumn("raw", 90 + F.col("md") / 9 + F.col("z") / 100)
    return T.surface_offset(p, "user_id", "md", "tvt_input", "raw", min_known=15).select("event_id", "pred_mean", "pred_median", "pred_trimmed", "pred_line")


@query(
    "ts_prefix_select",
    f"WITH {SEQ}, x AS (SELECT user_id, tvt_input AS y, 100 + md / 10 AS a, 101 + md / 11 AS b, 100.5 + md / 10.2e0 AS c FROM seq WHERE tvt_input IS NOT NULL), r AS (SELECT user_id, 'a' AS s, sqrt(avg(pow(a - y, 2))) AS r FROM x GROUP BY 1 UNION ALL SELECT user_id, 'b', sqrt(avg(pow(b - y, 2))) FROM x GROUP BY 1 UNION ALL SELECT user_id, 'c', sqrt(avg(pow(c - y, 2))) FROM x GROUP BY 1) SELECT user_id, s AS selected, r AS prefix_rmse FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r, s) = 1",
    f="prefix_rmse",
)
def _(t):
    x = seq(t).withColumns({"a": 100 + F.col("md") / 10, "b": 101 + F.col("md") / 11, "c": 100.5 + F.col("md") / 10.2})
    return T.prefix_select(x, "user_id", "tvt_input", ["a", "b", "c"])


@query("ts_poly_project")
def _(t):
    p = T.fraction(prefix(t), "md")
    return T.poly_project(p, "user_id", "frac", "tvt", "z").select("event_id", "projected")


@query("ts_warmup_shrink", f"WITH {SEQ} SELECT event_id, value * (1 - exp(-greatest(md - last_pos, 0.0) / 85e0)) * 0.9e0 AS shrunk FROM pf WHERE rn > n_known", f="shrunk")
def _(t):
    return T.fraction(prefix(t), "md").select("event_id", T.warmup_shrink(F.col("value"), F.col("since"), 85.0, 0.9).alias("shrunk"))


SMOOTH = ", ".join(f"({w}, {i}, {k}, {x!r}::DOUBLE)" for w in range(17, 4, -2) for i, r in enumerate(T.savgol_weights(w, 3)) for k, x in enumerate(r))


@query(
    "ts_savgol",
    f"""WITH {SEQ}, w(wl, place, k, weight) AS (VALUES {SMOOTH}),
a AS (SELECT user_id, event_id, rn, value, count(*) OVER (PARTITION BY user_id) AS nr FROM pf),
b AS (SELECT *, least(nr, 17) - CASE WHEN least(nr, 17) % 2 = 0 THEN 1 ELSE 0 END AS wl FROM a), c AS (SELECT *, greatest(least(rn - wl // 2, nr - wl + 1), 1) AS st FROM b)
SELECT c.event_id, round(coalesce(sum(q.value * w.weight), any_value(c.value)), 5) AS smooth FROM c LEFT JOIN w ON w.wl = c.wl AND w.place = c.rn - c.st LEFT JOIN a q ON q.user_id = c.user_id AND q.rn = c.st + w.k GROUP BY c.event_id""",
    f="smooth",
)
def _(t):
    return rounded(T.savgol(prefix(t), "user_id", "md", "event_id", "value").select("event_id", "smooth"), ["smooth"], 5)


GRID = f"""grid AS (SELECT band, floor(t) AS x, avg(flux) AS y FROM lc GROUP BY 1, 2),
pt AS (SELECT event_id, band, t AS x FROM lc)"""


@query(
    "join_nearest_grid",
    f"""WITH {LC}, {GRID}, lo AS (SELECT pt.*, g.x AS x0, g.y AS y0 FROM pt ASOF LEFT JOIN grid g ON pt.band = g.band AND pt.x >= g.x), hi AS (SELECT pt.event_id, g.x AS x1, g.y AS y1 FROM pt ASOF LEFT JOIN grid g ON pt.band = g.band AND pt.x <= g.x)
SELECT event_id, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / nullif(x1 - x0, 0) END AS interp, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x - x0 <= x1 - x THEN y0 ELSE y1 END AS nearest, CAST(x0 IS NOT NULL AND (x1 IS NOT NULL OR x0 = x) AS INT) AS inside FROM lo JOIN hi USING (event_id)""",
    f="interp nearest",
)
def _(t):
    l = lc(t)
    grid = l.groupBy("band", F.floor("t").alias("x")).agg(F.avg("flux").alias("y"))
    return T.nearest_grid(l.select("event_id", "band", F.col("t").alias("x")), grid, ["band"], "x", "y", "event_id").select("event_id", "interp", "nearest", "inside")


@query(
    "join_asof_band_interp",
    f"""WITH {LC}, a AS (SELECT * FROM lc WHERE band = 'click'), b AS (SELECT user_id, t AS x, avg(flux) AS y FROM lc WHERE band = 'view' GROUP BY 1, 2),
lo AS (SELECT a.*, b.x AS x0, b.y AS y0 FROM a ASOF JOIN b ON a.user_id = b.user_id AND a.t >= b.x), hi AS (SELECT a.event_id, b.x AS x1, b.y AS y1 FROM a ASOF JOIN b ON a.user_id = b.user_id AND a.t <= b.x)
SELECT event_id, user_id, t, flux - CASE WHEN x0 = t THEN y0 ELSE y0 + (y1 - y0) * (t - x0) / nullif(x1 - x0, 0) END AS difference FROM lo JOIN hi USING (event_id)""",
    f="t difference",
)
def _(t):
    return T.band_difference(lc(t), "user_id", "band", "t", "flux", "event_id", "click", "view").select("event_id", "user_id", "t", "difference")
