"""Series per entity: light-curve aggregates, window features, fits, calibration and alignment.

``pos`` is a numeric position that orders the rows of an entity; ties are broken by ``uid``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.mathx import sample_kurtosis, sample_skew
from quern.functions.ordered import ROWS_PER_TASK, UNKNOWN, carried, framed, hot_groups, join_keys, numbered, quantiles

MOMENTS = ("count", "mean", "std", "min", "max", "median", "p10", "p90", "mad", "iqr", "skew", "kurt", "amp")


def moments(df: DataFrame, keys: Sequence[str], value: str, limit: int | None = None) -> DataFrame:
    """Count, mean, population deviation, extremes, quantiles, MAD, IQR, corrected skewness and kurtosis, amplitude."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"))
    found = hot_groups(rows, keys, limit or ROWS_PER_TASK)  # both quantile steps see the same groups
    x = F.col("_x")
    base = rows.groupBy(*keys).agg(
        F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"),
        sample_skew(x).alias("skew"), sample_kurtosis(x).alias("kurt"), (F.max("_x") - F.min("_x")).alias("amp"),
    )
    q = quantiles(rows, keys, {"median": ("_x", 0.5), "p10": ("_x", 0.1), "p90": ("_x", 0.9), "_q1": ("_x", 0.25), "_q3": ("_x", 0.75)}, limit, found)
    dev = join_keys(rows, q.select(*keys, "median"), keys).withColumn("_d", F.abs(F.col("_x") - F.col("median")))
    mad = quantiles(dev, keys, {"mad": ("_d", 0.5)}, limit, found)
    out = join_keys(join_keys(base, q, keys), mad, keys)
    return out.withColumn("iqr", F.col("_q3") - F.col("_q1")).select(*keys, *MOMENTS)


def weighted(df: DataFrame, keys: Sequence[str], value: str, err: str) -> DataFrame:
    """Inverse-variance weighted mean and deviation over rows with a positive error."""
    ok = df.where((F.col(err) > 0) & F.col(value).isNotNull()).withColumn("_w", 1.0 / (F.col(err) * F.col(err) + 1e-6))
    mean = ok.groupBy(*keys).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("wmean"))
    rows = join_keys(ok, mean, keys)
    dev = F.col(value) - F.col("wmean")
    return rows.groupBy(*keys).agg(F.first("wmean").alias("wmean"), F.sqrt(F.sum(F.col("_w") * dev * dev) / F.sum("_w")).alias("wstd"))


def snr(value: str, err: str) -> Column:
    return F.when(F.col(err) > 0, F.col(value) / F.col(err))


def band_pivot(df: DataFrame, entity: str, band: str, value: str, bands: Sequence[str], colours: Sequence[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """All moments per (entity, band) as columns, and differences of band means."""
    m = moments(df.where(F.col(band).isin(*bands)), [entity, band], value, limit)
    pick = lambda b, c: F.max(F.when(F.col(band) == b, F.col(c)))
    out = m.groupBy(entity).agg(*[pick(b, c).alias(f"{b}_{c}") for b in bands for c in MOMENTS])
    out = out.withColumns({f"{b}_count": F.coalesce(F.col(f"{b}_count"), F.lit(0)) for b in bands})
    return out.withColumns({f"colour_{a}_{b}": F.col(f"{a}_mean") - F.col(f"{b}_mean") for a, b in colours})


def time_bins(df: DataFrame, entity: str, dt: str, value: str, edges: Sequence[float]) -> DataFrame:
    """Count, mean, population deviation, min and max of a value in fixed time bins."""
    aggs = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        v = F.when((F.col(dt) >= lo) & (F.col(dt) < hi), F.col(value))
        tag = f"bin_{lo:g}_{hi:g}"
        aggs += [F.count(v).alias(f"{tag}_count"), F.avg(v).alias(f"{tag}_mean"), F.stddev_pop(v).alias(f"{tag}_std"), F.min(v).alias(f"{tag}_min"), F.max(v).alias(f"{tag}_max")]
    return df.groupBy(entity).agg(*aggs)


def t0_dt(df: DataFrame, entity: str, t: str) -> DataFrame:
    """Time since the first observation of the entity (aggregate and join, not a window over the entity)."""
    t0 = df.groupBy(entity).agg(F.min(t).alias("t0"))
    return join_keys(df, t0, [entity]).withColumn("dt", F.col(t) - F.col("t0"))


def _lags(df: DataFrame, keys: Sequence[str], pos: str, uid: str, cols: dict[str, str], limit: int | None, found: object = UNKNOWN) -> DataFrame:
    return framed(df, keys, F.col(pos), [pos, uid], 1, 0, lambda w: {o: F.lag(c).over(w) for o, c in cols.items()}, limit, found)


def cadence(df: DataFrame, entity: str, t: str, uid: str, limit: int | None = None) -> DataFrame:
    """Span and gap statistics of observation times."""
    found = hot_groups(df, [entity], limit or ROWS_PER_TASK)
    gaps = _lags(df, [entity], t, uid, {"_p": t}, limit, found).withColumn("_g", F.col(t) - F.col("_p"))
    base = gaps.groupBy(entity).agg((F.max(t) - F.min(t)).alias("span"), F.avg("_g").alias("gap_mean"), F.max("_g").alias("gap_max"))
    return join_keys(base, quantiles(gaps, [entity], {"gap_median": ("_g", 0.5), "gap_p90": ("_g", 0.9)}, limit, found), [entity])


def max_rates(df: DataFrame, keys: Sequence[str], t: str, value: str, uid: str, limit: int | None = None) -> DataFrame:
    """Largest and smallest change per unit time over positive gaps."""
    rows = _lags(df, keys, t, uid, {"_pt": t, "_pv": value}, limit)
    gap = F.col(t) - F.col("_pt")
    rate = F.when(gap > 0, (F.col(value) - F.col("_pv")) / gap)
    return rows.groupBy(*keys).agg(F.max(rate).alias("rise_rate"), F.min(rate).alias("decay_rate"))


def sequence_features(df: DataFrame, entity: str, t: str, value: str, err: str, uid: str, limit: int | None = None) -> DataFrame:
    """Per row: time since start, normalised and log time, robust z-score, signal to noise, steps in time and value."""
    rows = t0_dt(df, entity, t)
    found = hot_groups(df, [entity], limit or ROWS_PER_TASK)
    span = rows.groupBy(entity).agg(F.max("dt").alias("_span"), F.stddev_pop(value).alias("_sd"))
    med = quantiles(rows, [entity], {"_med": (value, 0.5)}, limit, found)
    rows = join_keys(join_keys(rows, span, [entity]), med, [entity]).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = quantiles(rows, [entity], {"_mad": ("_dev", 0.5)}, limit, found)
    rows = _lags(join_keys(rows, mad, [entity]), [entity], t, uid, {"_pt": t, "_pv": value}, limit, found)
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd"))
    return rows.select(
        *df.columns, "dt",
        (F.col("dt") / (F.col("_span") + 1e-6)).alias("dt_norm"),
        F.log1p("dt").alias("dt_log"),
        F.coalesce((F.col(value) - F.col("_med")) / scale, F.lit(0.0)).alias("z"),
        F.coalesce(snr(value, err), F.lit(0.0)).alias("snr"),
        F.coalesce(F.col(t) - F.col("_pt"), F.lit(0.0)).alias("step_t"),
        F.coalesce(F.col(value) - F.col("_pv"), F.lit(0.0)).alias("step_v"),
    )


def min_obs(df: DataFrame, entity: str, value: str, n: int) -> DataFrame:
    keep = df.groupBy(entity).agg(F.count(value).alias("_n")).where(F.col("_n") >= n).drop("_n")
    return df.join(keep, entity, "left_semi")


def peak(df: DataFrame, entity: str, t: str, value: str, err: str) -> DataFrame:
    """Value, time and signal to noise of the peak (first in time on ties) and the time left after it."""
    top = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("k"), F.col(t).alias("t"), F.col(value).alias("v"), snr(value, err).alias("s"))))
    return df.groupBy(entity).agg(top.alias("p"), F.max(t).alias("_end")).select(
        entity, F.col("p.t").alias("t_peak"), F.col("p.v").alias("peak_value"), F.col("p.s").alias("peak_snr"), (F.col("_end") - F.col("p.t")).alias("after_peak")
    )


def half_max_width(df: DataFrame, entity: str, t: str, value: str, uid: str, limit: int | None = None) -> DataFrame:
    """Time between the first and last value at or above half the peak, and the von Neumann ratio."""
    top = df.groupBy(entity).agg(F.max(value).alias("_top"), F.var_pop(value).alias("_var"), F.count(value).alias("_n"))
    rows = join_keys(_lags(df, [entity], t, uid, {"_pv": value}, limit), top, [entity])
    above = F.when(F.col(value) >= 0.5 * F.col("_top"), F.col(t))
    step = F.col(value) - F.col("_pv")
    out = rows.groupBy(entity, "_var", "_n").agg(F.count(above).alias("_a"), (F.max(above) - F.min(above)).alias("_w"), F.sum(step * step).alias("_ss"))
    return out.select(
        entity, F.when(F.col("_a") > 1, F.col("_w")).alias("fwhm"),
        F.when((F.col("_n") > 1) & (F.col("_var") > 0), F.col("_ss") / (F.col("_n") - 1) / F.col("_var")).alias("von_neumann"),
    )


def slope(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.count(y).alias("n"))


def decay_fit(df: DataFrame, entity: str, t: str, value: str, err: str) -> DataFrame:
    """Slope and R squared of log value against time after the peak; needs three positive points."""
    rows = join_keys(df, peak(df, entity, t, value, err).select(entity, "t_peak"), [entity])
    ok = (F.col(t) >= F.col("t_peak")) & (F.col(value) > 0)
    x = F.when(ok, F.col(t) - F.col("t_peak"))
    y = F.when(ok, F.ln(F.when(F.col(value) > 0, F.col(value))))
    out = rows.groupBy(entity).agg(F.count(y).alias("decay_n"), F.regr_slope(y, x).alias("_s"), F.regr_r2(y, x).alias("_r"))
    enough = F.col("decay_n") >= 3
    return out.select(entity, "decay_n", F.when(enough, F.col("_s")).alias("decay_slope"), F.when(enough, F.col("_r")).alias("decay_r2"))


# ---- sequences with a known prefix -------------------------------------------------------------------------


def steps(df: DataFrame, entity: str, pos: str, uid: str, cols: Sequence[str], plane: tuple[str, str], limit: int | None = None) -> DataFrame:
    """Step of each column and the length of the step in a plane."""
    rows = _lags(df, [entity], pos, uid, {f"_p_{c}": c for c in {*cols, *plane}}, limit)
    d = lambda c: F.col(c) - F.col(f"_p_{c}")
    out = rows.withColumns({f"step_{c}": d(c) for c in cols})
    out = out.withColumn("step_2d", F.sqrt(d(plane[0]) * d(plane[0]) + d(plane[1]) * d(plane[1])))
    return out.drop(*[f"_p_{c}" for c in {*cols, *plane}])


def rolling(df: DataFrame, entity: str, pos: str, uid: str, col: str, trailing: Sequence[int] = (5, 25, 75), centred: Sequence[int] = (5, 21, 51, 101), limit: int | None = None) -> DataFrame:
    """Trailing mean, deviation, min and max, centred means, a centred maximum envelope and centred energy."""
    x = F.col(col)

    def build(w) -> dict[str, Column]:
        out = {}
        for n in trailing:
            f = w.rowsBetween(-n + 1, 0)
            out |= {f"mean_{n}": F.avg(x).over(f), f"std_{n}": F.stddev_samp(x).over(f), f"min_{n}": F.min(x).over(f), f"max_{n}": F.max(x).over(f)}
        for n in centred:
            f = w.rowsBetween(-(n // 2), n // 2)
            out |= {f"cmean_{n}": F.avg(x).over(f), f"envelope_{n}": F.max(F.abs(x)).over(f), f"energy_{n}": F.avg(x * x).over(f)}
        return out

    before = max(max(trailing) - 1, max(centred) // 2)
    return framed(df, [entity], F.col(pos), [pos, uid], before, max(centred) // 2, build, limit)


def lag_lead(df: DataFrame, entity: str, pos: str, uid: str, col: str, z: str, md: str, shifts: Sequence[int] = (1, 5, 15, 30), limit: int | None = None) -> DataFrame:
    """Values before and after, first and second difference, and the derivative of one column by another."""

    def build(w) -> dict[str, Column]:
        out = {}
        for s in shifts:
            out |= {f"lag_{s}": F.lag(col, s).over(w), f"lead_{s}": F.lead(col, s).over(w)}
        out["diff_1"] = F.col(col) - F.lag(col).over(w)
        out["diff_2"] = F.col(col) - 2 * F.lag(col).over(w) + F.lag(col, 2).over(w)
        out["dz_dmd"] = (F.col(z) - F.lag(z).over(w)) / F.nullif(F.col(md) - F.lag(md).over(w), F.lit(0.0))
        return out

    return framed(df, [entity], F.col(pos), [pos, uid], max(*shifts, 2), max(shifts), build, limit)


def prefix_frame(df: DataFrame, entity: str, pos: str, uid: str, known: str, limit: int | None = None) -> DataFrame:
    """Row number, rows and known rows of the entity, and position and value of the last known row.

    The known rows are a prefix of the entity, so the known count is the row number of the last known row.
    """
    rows = numbered(df, [entity], F.col(pos), [pos, uid], "rn", limit)
    st = rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(known).alias("n_known"),
        F.max(F.when(F.col(known).isNotNull(), F.struct("rn", F.col(pos).alias("p"), F.col(known).alias("v")))).alias("_l"),
    )
    return join_keys(rows, st.select(entity, "n_rows", "n_known", F.col("_l.p").alias("last_pos"), F.col("_l.v").alias("last_known")), [entity])


def fraction(p: DataFrame, pos: str) -> DataFrame:
    """Position 0..1 inside the unknown suffix and the distance from the last known row. Input: ``prefix_frame``."""
    m = F.col("n_rows") - F.col("n_known")
    return p.where(F.col("rn") > F.col("n_known")).withColumns(
        {"frac": (F.col("rn") - F.col("n_known") - 1) / F.greatest(m - 1, F.lit(1)), "since": F.col(pos) - F.col("last_pos")}
    )


def median_slope_extrapolate(p: DataFrame, entity: str, pos: str, uid: str, known: str, last: int = 80, limit: int | None = None) -> DataFrame:
    """Median step slope over the last known rows, extended from the last known row; also the constant baseline."""
    tail = p.where((F.col("rn") <= F.col("n_known")) & (F.col("rn") > F.col("n_known") - last))
    tail = _lags(tail, [entity], pos, uid, {"_pp": pos, "_pv": known}, limit)
    gap = F.col(pos) - F.col("_pp")
    tail = tail.withColumn("_s", F.when(gap > 0, (F.col(known) - F.col("_pv")) / gap))
    s = quantiles(tail, [entity], {"slope": ("_s", 0.5)}, limit)
    out = join_keys(p.where(F.col("rn") > F.col("n_known")), s, [entity])
    return out.withColumns(
        {"constant": F.col("last_known"), "extrapolated": F.col("last_known") + F.coalesce("slope", F.lit(0.0)) * (F.col(pos) - F.col("last_pos"))}
    )


def poly_sums(df: DataFrame, keys: Sequence[str], x: Column, y: Column, degree: int, low: int = 0) -> DataFrame:
    """Power sums of a least-squares polynomial with terms x^low .. x^degree; a group reduces to a few numbers."""
    rows = df.withColumns({"_x": x, "_y": y}).where("_x IS NOT NULL AND _y IS NOT NULL")
    sx = [F.sum(F.pow("_x", F.lit(float(i)))).alias(f"_sx{i}") for i in range(2 * low, 2 * degree + 1)]
    sy = [F.sum(F.pow("_x", F.lit(float(i))) * F.col("_y")).alias(f"_sy{i}") for i in range(low, degree + 1)]
    return rows.groupBy(*keys).agg(*sx, *sy, F.count(F.lit(1)).alias("_n"))


def poly_solve(sums: DataFrame, keys: Sequence[str], degree: int, low: int = 0, out: str = "coef") -> DataFrame:
    """Coefficients of the normal equations, solved in batches of groups."""
    k = degree - low + 1

    @F.pandas_udf("array<double>")
    def solve(sx: pd.Series, sy: pd.Series) -> pd.Series:
        res = []
        for a, b in zip(sx, sy):
            a, b = np.asarray(a, float), np.asarray(b, float)
            res.append(np.linalg.lstsq(np.array([a[i : i + k] for i in range(k)]), b, rcond=None)[0].tolist())
        return pd.Series(res)

    sx = F.array(*[F.col(f"_sx{i}") for i in range(2 * low, 2 * degree + 1)])
    sy = F.array(*[F.col(f"_sy{i}") for i in range(low, degree + 1)])
    return sums.select(*keys, "_n", solve(sx, sy).alias(out))


def prefix_poly(p: DataFrame, entity: str, pos: str, known: str, truth: str, windows: Sequence[int] = (100, 300, 800)) -> DataFrame:
    """Anchored polynomials (no constant) of degree 1-3 of truth - last known over the suffix, and prefix slopes."""
    span = p.groupBy(entity).agg(F.greatest(F.max(pos) - F.max("last_pos"), F.lit(1e-9)).alias("_span"))
    suffix = join_keys(p.where(F.col("rn") > F.col("n_known")), span, [entity])
    x = (F.col(pos) - F.col("last_pos")) / F.col("_span")
    y = F.col(truth) - F.col("last_known")
    out = None
    for d in (1, 2, 3):
        one = poly_solve(poly_sums(suffix, [entity], x, y, d, 1), [entity], d, 1, f"coef_{d}").drop("_n")
        out = one if out is None else join_keys(out, one, [entity])
    pre = p.where(F.col("rn") <= F.col("n_known"))
    near = lambda w, c: F.when(F.col("rn") > F.col("n_known") - w, F.col(c))
    slopes = pre.groupBy(entity).agg(*[F.regr_slope(near(w, known), near(w, pos)).alias(f"slope_{w}") for w in windows], F.regr_slope(known, pos).alias("slope_all"))
    return join_keys(out, slopes, [entity])


def poly_project(df: DataFrame, entity: str, x: str, y: str, z: str, degree: int = 3, mix: float = 0.75) -> DataFrame:
    """Path plus offset projected on a polynomial per entity (from power sums), mixed with the raw path."""
    sums = poly_sums(df, [entity], F.col(x), F.col(y) + F.col(z), degree)
    coef = poly_solve(sums.where("_n >= 8"), [entity], degree)
    rows = join_keys(df, coef, [entity])
    fit = F.lit(0.0)
    for i in range(degree, -1, -1):
        fit = fit * F.col(x) + F.col("coef")[i]
    projected = F.lit(1 - mix) * F.col(y) + F.lit(mix) * (fit - F.col(z))
    return rows.withColumn("projected", F.coalesce(projected, F.col(y))).drop("coef", "_n")


def affine_calibrate(df: DataFrame, entity: str, x: str, y: str, min_points: int = 20) -> DataFrame:
    """Scale and offset that map x to y; below the minimum or for a constant x: scale 1 and the mean difference."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    out = df.groupBy(entity).agg(
        F.count(a).alias("n"), F.regr_slope(b, a).alias("_s"), F.regr_intercept(b, a).alias("_i"), F.stddev_pop(a).alias("_sd"), (F.avg(y) - F.avg(x)).alias("_d")
    )
    ok = (F.col("n") >= min_points) & (F.col("_sd") >= 1e-6)
    off = F.when(F.col("n") > 0, F.col("_d")).otherwise(0.0)
    return out.select(entity, "n", F.when(ok, F.col("_s")).otherwise(1.0).alias("scale"), F.when(ok, F.col("_i")).otherwise(off).alias("offset"))


def segment_medians(p: DataFrame, entity: str, value: Column, limit: int | None = None) -> DataFrame:
    """Median over the known prefix, its early, middle and late thirds and last 50 rows, and a tail-weighted mean."""
    rows = p.where(F.col("rn") <= F.col("n_known")).withColumn("_v", value)
    n, i = F.col("n_known"), F.col("rn") - 1
    t1, t2 = F.floor(n / 3), F.floor(2 * n / 3)
    pieces = {
        "_early": F.when((t1 > 0) & (i < F.greatest(F.lit(1), t1)), F.col("_v")),
        "_mid": F.when((t2 > t1) & (i >= t1) & (i < F.greatest(t1 + 1, t2)), F.col("_v")),
        "_late": F.when((n >= 5) & (i >= n - 50), F.col("_v")),
    }
    rows = rows.withColumns(pieces)
    q = quantiles(rows, [entity], {"b_full": ("_v", 0.5), "_e": ("_early", 0.5), "_m": ("_mid", 0.5), "_l": ("_late", 0.5)}, limit)
    w = F.exp(0.02 * (i - n + 1))
    wls = rows.groupBy(entity).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("b_wls"))
    full = F.col("b_full")
    return join_keys(q, wls, [entity]).select(entity, "b_full", F.coalesce("_e", full).alias("b_early"), F.coalesce("_m", full).alias("b_mid"), F.coalesce("_l", full).alias("b_late"), "b_wls")


def surface_offset(p: DataFrame, entity: str, pos: str, known: str, raw: str, tail: int = 500, min_known: int = 30, limit: int | None = None) -> DataFrame:
    """A reference surface shifted by the prefix error: mean, median, 10-90 % trimmed mean, or a tail line."""
    rows = p.withColumn("_d", F.when(F.col("rn") <= F.col("n_known"), F.col(known) - F.col(raw)))
    q = quantiles(rows, [entity], {"_med": ("_d", 0.5), "_lo": ("_d", 0.1), "_hi": ("_d", 0.9)}, limit)
    rows = join_keys(rows, q, [entity])
    inside = F.when(F.col("_d").between(F.col("_lo"), F.col("_hi")), F.col("_d"))
    near = F.col("rn") > F.col("n_known") - tail
    x = F.when(near & F.col("_d").isNotNull(), F.col(pos) - F.col("last_pos"))
    fit = rows.groupBy(entity).agg(
        F.count("_d").alias("_n"), F.avg("_d").alias("off_mean"), F.first("_med").alias("off_median"), F.avg(inside).alias("off_trimmed"),
        F.regr_intercept(F.when(near, F.col("_d")), x).alias("off_line"), F.regr_slope(F.when(near, F.col("_d")), x).alias("slope_line"), F.max(pos).alias("_end"),
    ).where(F.col("_n") >= min_known)
    out = p.where(F.col("rn") > F.col("n_known")).join(fit, entity)
    r = F.col(raw)
    return out.withColumns(
        {
            "pred_mean": r + F.col("off_mean"), "pred_median": r + F.col("off_median"), "pred_trimmed": r + F.col("off_trimmed"),
            "pred_line": r + F.col("off_line") + F.col("slope_line") * (F.col(pos) - F.col("_end")),
        }
    ).drop("_n", "_end")


def prefix_select(df: DataFrame, entity: str, truth: str, candidates: Sequence[str]) -> DataFrame:
    """Candidate with the lowest RMSE over the entity's known rows (ties: first in the list)."""
    e = lambda c: F.sqrt(F.avg((F.col(c) - F.col(truth)) * (F.col(c) - F.col(truth))))
    out = df.where(F.col(truth).isNotNull()).groupBy(entity).agg(*[e(c).alias(c) for c in candidates])
    best = F.least(*[F.struct(F.col(c).alias("r"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(candidates)])
    return out.select(entity, best["c"].alias("selected"), best["r"].alias("prefix_rmse"))


def warmup_shrink(value: Column, since: Column, tau: float, alpha: float) -> Column:
    """value * (1 - exp(-since / tau)) * alpha."""
    return value * (1 - F.exp(-F.greatest(since, F.lit(0.0)) / F.lit(tau))) * F.lit(alpha)


def savgol_weights(window: int, degree: int) -> list[list[float]]:
    """For each place in a window, the weights of the window's values in the least-squares polynomial at that place."""
    x = np.arange(window, dtype=float) - window // 2
    a = np.vander(x, degree + 1, increasing=True)
    return (a @ np.linalg.pinv(a)).tolist()


def savgol(p: DataFrame, entity: str, pos: str, uid: str, col: str, window: int = 17, degree: int = 3, limit: int | None = None) -> DataFrame:
    """Polynomial smoothing with fixed weights: centred inside, the edge window's polynomial at the ends.

    The window shrinks to the entity's length (odd); shorter entities stay unchanged. Every row needs only the
    ``window - 1`` rows around it, so long entities are cut into tiles. Input: ``prefix_frame`` (rn, n_rows).
    """
    sizes = [w for w in range(window if window % 2 else window - 1, degree + 1, -2) if w >= degree + 2]
    table = F.create_map(*[x for w in sizes for x in (F.lit(w), F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in savgol_weights(w, degree)]))])
    rows = framed(
        p, [entity], F.col(pos), [pos, uid], window - 1, window - 1,
        lambda w: {"_near": F.collect_list(F.struct("rn", F.col(col).cast("double").alias("v"))).over(w.rowsBetween(-(window - 1), window - 1))}, limit,
    )
    n = F.col("n_rows")
    wl = F.least(n, F.lit(window))
    wl = F.when(wl % 2 == 0, wl - 1).otherwise(wl).cast("int")
    half = F.floor(wl / 2)
    start = F.greatest(F.least(F.col("rn") - half, n - wl + 1), F.lit(1))  # first row number of the window used
    rows = rows.withColumns({"_wl": wl, "_st": start})
    vals = F.transform(F.filter("_near", lambda r: (r["rn"] >= F.col("_st")) & (r["rn"] < F.col("_st") + F.col("_wl"))), lambda r: r["v"])
    weights = F.try_element_at(F.try_element_at(table, F.col("_wl")), (F.col("rn") - F.col("_st") + 1).cast("int"))
    smooth = F.aggregate(F.zip_with(vals, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("smooth", F.when(weights.isNotNull(), smooth).otherwise(F.col(col))).drop("_near", "_wl", "_st")


# ---- joins along a position ----------------------------------------------------------------------------------


def nearest_grid(points: DataFrame, grid: DataFrame, keys: Sequence[str], x: str, y: str, uid: str, limit: int | None = None) -> DataFrame:
    """Value of a reference curve at each point: linear between its neighbours (flat outside) and nearest.

    One union and two carries instead of a range join: each point meets only the grid rows around it.
    """
    keys = list(keys)
    p = points.select(*keys, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_f"), F.col(uid).cast("long").alias("_u"), F.lit(None).cast("double").alias("_y"))
    g = grid.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.avg(y).alias("_y"))
    g = g.select(*keys, "_x", F.lit(0).alias("_f"), F.lit(0).cast("long").alias("_u"), "_y")
    both = p.unionByName(g)
    mark = F.when(F.col("_f") == 0, F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    order = ["_x", "_f", "_u"]
    both = carried(both, keys, F.col("_x"), order, {"_lo": mark}, limit=limit)
    both = carried(both, keys, F.col("_x"), order, {"_hi": mark}, reverse=True, limit=limit)
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_x")
    line = lo["y"] + (hi["y"] - lo["y"]) * (v - lo["x"]) / F.nullif(hi["x"] - lo["x"], F.lit(0.0))
    interp = F.when(lo.isNull(), hi["y"]).when(hi.isNull() | (lo["x"] == v), lo["y"]).otherwise(line)
    near = F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).when(v - lo["x"] <= hi["x"] - v, lo["y"]).otherwise(hi["y"])
    inside = (lo.isNotNull() & (hi.isNotNull() | (lo["x"] == v))).cast("int")
    got = both.where("_f = 1").select(*keys, F.col("_u").alias(uid), interp.alias("interp"), near.alias("nearest"), inside.alias("inside"))
    return join_keys(points, got, [*keys, uid])


def band_difference(df: DataFrame, entity: str, band: str, t: str, value: str, uid: str, a: str, b: str, limit: int | None = None) -> DataFrame:
    """Series A minus series B interpolated at A's times, inside B's time range only."""
    pa = df.where(F.col(band) == a).select(entity, uid, t, F.col(value).alias("_va"))
    pb = df.where(F.col(band) == b).select(entity, t, F.col(value).alias("_vb"))
    got = nearest_grid(pa, pb, [entity], t, "_vb", uid, limit)
    return got.where("inside = 1").select(entity, uid, t, (F.col("_va") - F.col("interp")).alias("difference"))


def delta_target(value: Column, last_known: Column) -> Column:
    return value - last_known


