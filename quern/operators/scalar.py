"""Row-wise expressions, cleaning and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.mathx import clip
from quern.functions.ordered import ROWS_PER_TASK, carried, framed, hot_groups, join_keys, numbered, quantiles


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio_null(a: Column | str, b: Column | str) -> Column:
    return c(a) / F.nullif(c(b), F.lit(0))


def ratio_eps(a: Column | str, b: Column | str, eps: float = 1e-6) -> Column:
    return c(a) / (c(b) + F.lit(eps))


def finite(x: Column | str) -> Column:
    """NaN and infinities become null."""
    x = c(x)
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def downcast(df: DataFrame) -> DataFrame:
    """Doubles to float, integers to the smallest type that holds the column's range (one aggregation)."""
    from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, ShortType

    whole = [f.name for f in df.schema if isinstance(f.dataType, (LongType, IntegerType, ShortType))]
    casts = {f.name: "float" for f in df.schema if isinstance(f.dataType, DoubleType)}
    if whole:
        lim = df.agg(*[F.min(n).alias(f"lo_{n}") for n in whole], *[F.max(n).alias(f"hi_{n}") for n in whole]).first()
        for n in whole:
            lo, hi = lim[f"lo_{n}"], lim[f"hi_{n}"]
            if lo is None:
                continue
            casts[n] = next(t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(2**b) <= lo and hi < 2**b)
    return df.withColumns({n: F.col(n).cast(t) for n, t in casts.items()})


def bin_cut(x: Column | str, edges: Sequence[float], labels: Sequence[str], right: bool = True, lowest: bool = False) -> Column:
    """Fixed-edge bins: (lo, hi] when ``right``, else [lo, hi); outside the edges null."""
    x = c(x)
    out = None
    for i, (lo, hi, name) in enumerate(zip(edges[:-1], edges[1:], labels)):
        if right:
            cond = ((x >= lo) if lowest and i == 0 else (x > lo)) & (x <= hi)
        else:
            cond = (x >= lo) & (x < hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def floor_bin(x: Column | str, period: float) -> Column:
    return F.floor(c(x) / F.lit(period))


def log1p_nonneg(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p of every listed column whose minimum is not negative; others stay."""
    lo = df.agg(F.struct(*[F.min(n).alias(n) for n in cols]).alias("s")).scalar()
    return df.withColumns({f"{n}_log": F.when(lo[n] >= 0, F.log1p(F.greatest(F.col(n), F.lit(0.0)))).otherwise(F.col(n)) for n in cols})


def cyclic_hour(seconds: Column | str) -> dict[str, Column]:
    h = F.pmod(F.floor(c(seconds) / 3600), F.lit(24))
    return {"hour": h, "hour_sin": F.sin(h * F.lit(2 * 3.141592653589793 / 24)), "hour_cos": F.cos(h * F.lit(2 * 3.141592653589793 / 24))}


def digit(x: Column | str, place: int) -> Column:
    """Decimal digit of |x|: place 0 = units, 1 = tens, -1 = first after the point."""
    a = F.abs(c(x))
    scaled = F.round(a * F.lit(10.0 ** -place), 6) if place < 0 else a / F.lit(10.0**place)
    return F.pmod(F.floor(scaled), F.lit(10)).cast("int")


def float_signature(df: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """Digits of round(100 |x|) as columns and one string; digit columns with a single value are null."""
    whole = F.bround(F.abs(F.col(col)) * 100, 0).cast("long")
    ds = {f"{col}_d{i}": F.pmod(F.floor(whole / F.lit(10**i)), F.lit(10)).cast("int") for i in range(digits)}
    out = df.withColumns(ds)
    n = out.agg(F.struct(*[(F.max(k) > F.min(k)).alias(k) for k in ds]).alias("s")).scalar()
    sig = F.concat_ws("", *[F.col(k).cast("string") for k in reversed(list(ds))])
    return out.withColumn(f"{col}_sig", sig).withColumns({k: F.when(n[k], F.col(k)) for k in ds})


def rounded_string(x: Column | str, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.bround(c(x), places))


def category_cross(cols: Sequence[str], sep: str = "_", missing: str = "Missing") -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(x).cast("string"), F.lit(missing)) for x in cols])


def normalize_category(x: Column | str, missing: str = "missing") -> Column:
    t = F.lower(F.trim(c(x)))
    return F.coalesce(F.when(t != "", t), F.lit(missing))


def ordinal_map(x: Column | str, levels: dict[str, int], unknown: int | None = -1) -> Column:
    m = F.create_map(*[F.lit(v) for kv in levels.items() for v in kv])
    got = F.try_element_at(m, c(x))
    return got if unknown is None else F.coalesce(got, F.lit(unknown))


def flag_rules(df: DataFrame, rules: dict[str, Column], all_of: Sequence[str]) -> DataFrame:
    """0/1 flags (null condition = 0), their sum and the AND of a chosen few."""
    flags = {k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in rules.items()}
    out = df.withColumns(flags)
    score = sum((F.col(k) for k in list(rules)[1:]), F.col(list(rules)[0]))
    return out.withColumns({"risk_score": score, "all_flags": F.least(*[F.col(k) for k in all_of])})


def row_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, min, max, range over columns of a row (nulls skipped) and all pairwise differences."""
    vals = F.filter(F.array(*[F.col(x).cast("double") for x in cols]), lambda v: v.isNotNull())
    n = F.size(vals)
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    mean = total / F.nullif(n, F.lit(0))
    ss = F.aggregate(F.transform(vals, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    pairs = {f"{a}_minus_{b}": F.col(a) - F.col(b) for i, a in enumerate(cols) for b in cols[i + 1 :]}
    return df.withColumns(
        {
            "row_mean": mean,
            "row_std": F.sqrt(ss / F.nullif(n - 1, F.lit(0))),
            "row_min": F.array_min(vals),
            "row_max": F.array_max(vals),
            "row_range": F.array_max(vals) - F.array_min(vals),
            **pairs,
        }
    )


def domain_features(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Named ratios, products and differences from SQL expressions; zero denominators should use ``nullif``."""
    return df.withColumns({k: F.expr(v) for k, v in spec.items()})


def missing_indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{x}_is_missing": F.col(x).isNull().cast("int") for x in cols})


def impute_median(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Fill with the median of ``fit`` (training rows); ``fit=None`` pools the medians over ``df`` itself."""
    q = quantiles(fit if fit is not None else df, [], {x: (x, 0.5) for x in cols}, limit)
    med = q.agg(F.struct(*[F.first(x).alias(x) for x in cols]).alias("s")).scalar()
    return df.withColumns({x: F.coalesce(F.col(x).cast("double"), med[x]) for x in cols})


def impute_mode(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Fill with the most frequent level (ties: first by name)."""
    from quern.operators.quality import cells

    src = fit if fit is not None else df
    counts = cells(src, cols).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
    modes = best.agg(F.map_from_entries(F.collect_list(F.struct("column", "b.value"))).alias("m")).scalar()  # one entry per column
    return df.withColumns({x: F.coalesce(F.col(x), F.try_element_at(modes, F.lit(x)).cast(df.schema[x].dataType)) for x in cols})


def interpolate(df: DataFrame, keys: Sequence[str], pos: str, col: str, max_gap: int = 100, limit: int | None = None) -> DataFrame:
    """Linear interpolation along a series, ends filled with the nearest value, at most ``max_gap`` rows deep.

    Rows still null get the entity's median. Positions are row numbers within the entity.
    """
    lead, known = F.col(pos), F.col(col).isNotNull()
    rows = numbered(df, keys, lead, [pos], "_rn", limit)
    point = F.when(known, F.struct(F.col("_rn").alias("n"), F.col(col).cast("double").alias("v")))
    rows = carried(rows, keys, lead, [pos], {"_lo": point}, limit=limit)
    rows = carried(rows, keys, lead, [pos], {"_hi": point}, reverse=True, limit=limit)
    lo, hi, n = F.col("_lo"), F.col("_hi"), F.col("_rn")
    line = lo["v"] + (hi["v"] - lo["v"]) * (n - lo["n"]) / F.nullif(hi["n"] - lo["n"], F.lit(0))
    # a filled row must be near the known row on at least one side, as with a two-sided fill limit
    near_lo, near_hi = (n - lo["n"]) <= max_gap, (hi["n"] - n) <= max_gap
    fill = F.when(lo.isNotNull() & hi.isNotNull() & (near_lo | near_hi), line).when(hi.isNull() & near_lo, lo["v"]).when(lo.isNull() & near_hi, hi["v"])
    med = quantiles(df, keys, {"_med": (col, 0.5)}, limit)
    out = join_keys(rows.withColumn("_f", F.coalesce(F.col(col).cast("double"), fill)), med, keys)
    return out.withColumn(f"{col}_filled", F.coalesce("_f", "_med")).drop("_lo", "_hi", "_rn", "_f", "_med")


def fill_after_shift(df: DataFrame, keys: Sequence[str], pos: str, col: str, shift: int = 1, limit: int | None = None) -> DataFrame:
    """Lagged value, holes filled forward and then backward."""
    order, lead = [pos], F.col(pos)
    rows = framed(df, keys, lead, order, shift, 0, lambda w: {"_s": F.lag(col, shift).over(w)}, limit)
    rows = carried(rows, keys, lead, order, {"_f": F.col("_s")}, limit=limit)
    rows = carried(rows, keys, lead, order, {"_b": F.col("_f")}, reverse=True, limit=limit)
    return rows.withColumn(f"{col}_lag{shift}", F.col("_b")).drop("_s", "_f", "_b")


def standard_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation of the training rows; a constant column is only centred."""
    src = fit if fit is not None else df
    s = src.agg(F.struct(*[F.avg(x).alias(f"m_{x}") for x in cols], *[F.stddev_pop(x).alias(f"s_{x}") for x in cols]).alias("s")).scalar()
    return df.withColumns({f"{x}_z": (F.col(x) - s[f"m_{x}"]) / F.coalesce(F.nullif(s[f"s_{x}"], F.lit(0.0)), F.lit(1.0)) for x in cols})


def robust_zscore(df: DataFrame, keys: Sequence[str], col: str, scale: float = 1.0, limit: int | None = None) -> DataFrame:
    """(x - median) / (scale * MAD) per entity; deviation when the MAD is 0; null when both are 0."""
    found = hot_groups(df, keys, limit or ROWS_PER_TASK)  # both steps see the same groups
    med = quantiles(df, keys, {"_med": (col, 0.5)}, limit, found)
    rows = join_keys(df, med, keys).withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    mad = quantiles(rows, keys, {"_mad": ("_dev", 0.5)}, limit, found)
    sd = df.groupBy(*keys).agg(F.stddev_pop(col).alias("_sd"))
    rows = join_keys(join_keys(rows, mad, keys), sd, keys)
    width = F.when(F.col("_mad") > 0, F.col("_mad") * F.lit(scale)).when(F.col("_sd") > 0, F.col("_sd"))
    return rows.withColumn(f"{col}_rz", (F.col(col) - F.col("_med")) / width).drop("_med", "_mad", "_sd", "_dev")


def to_numeric(x: Column | str) -> Column:
    """String to double; anything unreadable or blank becomes null."""
    return F.trim(c(x)).try_cast("double")


def class_encode(df: DataFrame, target: str, classes: Sequence[str]) -> DataFrame:
    """Class label to its position in the list and back."""
    code = ordinal_map(target, {v: i for i, v in enumerate(classes)}, None)
    out = df.withColumn("code", code)
    return out.withColumn("decoded", F.get(F.array(*[F.lit(v) for v in classes]), F.col("code")))


