"""Categorical encoders: fitted on one frame, applied to another, unseen levels explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ordered import join_keys, numbered, quantiles

MAX_LEVELS = 1000  # one column per level; one_hot_sparse takes any number


def text_lead(x: Column) -> Column:
    """Number in UTF-8 byte order of the first six bytes of a string."""
    return F.conv(F.rpad(F.substring(F.hex(F.encode(x, "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("double")


def known_levels(df: DataFrame, col: str) -> list[str]:
    rows = df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{col} has more than {MAX_LEVELS} levels: use one_hot_sparse")
    return [r[0] for r in rows]


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """0/1 column per training level; unknown and missing levels are all zero."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in levels})


def one_hot_sparse(train: DataFrame, rows: DataFrame, id_col: str, col: str) -> DataFrame:
    """One-hot coding in long form for any number of levels: (id, code, 1.0) where the training table knows the level."""
    codes = _coded(train.where(F.col(col).isNotNull()).select(col).distinct(), col)
    return rows.join(codes, col).select(id_col, "code", F.lit(1.0).alias("value"))


def _coded(levels: DataFrame, col: str) -> DataFrame:
    codes = numbered(levels, [], text_lead(F.col(col)), [col], "code")
    return codes.withColumn("code", F.col("code") - 1)


def label_encode_union(train: DataFrame, test: DataFrame, col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Codes over the sorted union of both tables' levels."""
    codes = _coded(train.select(col).unionAll(test.select(col)).where(F.col(col).isNotNull()).distinct(), col)
    codes = codes.withColumnRenamed("code", out)
    return train.join(codes, col, "left"), test.join(codes, col, "left")


def ordinal_encode(train: DataFrame, rows: DataFrame, col: str, out: str, unknown: int = -1) -> DataFrame:
    """Codes over the sorted training levels; unknown and missing become ``unknown``."""
    codes = _coded(train.where(F.col(col).isNotNull()).select(col).distinct(), col).withColumnRenamed("code", out)
    return rows.join(codes, col, "left").withColumn(out, F.coalesce(out, F.lit(unknown)))


def factorize(train: DataFrame, rows: DataFrame, col: str, pos: str, out: str) -> DataFrame:
    """Codes in order of first appearance by ``pos``; unseen and missing become -1."""
    first = train.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(pos).alias("_p"))
    codes = numbered(first, [], F.col("_p"), ["_p"], out).select(col, (F.col(out) - 1).alias(out))
    return rows.join(codes, col, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def count_freq(frames: Sequence[DataFrame], rows: DataFrame, col: str) -> DataFrame:
    """Count and share of each level over all given frames."""
    pool = frames[0].select(col)
    for f in frames[1:]:
        pool = pool.unionAll(f.select(col))
    counts = pool.groupBy(col).agg(F.count(F.lit(1)).alias(f"{col}_count"))
    total = counts.agg(F.sum(f"{col}_count")).scalar()
    return join_keys(rows, counts.withColumn(f"{col}_freq", F.col(f"{col}_count") / total), [col])


def target_encode(train: DataFrame, rows: DataFrame, col: str, target: str, smooth: float = 10.0) -> DataFrame:
    """(n mean + s global) / (n + s); unseen levels get the global mean and count 0."""
    st = train.groupBy(col).agg(F.count(target).alias("_n"), F.sum(target).alias("_s"))
    g = st.agg((F.sum("_s") / F.sum("_n"))).scalar()
    out = join_keys(rows, st, [col])
    n, s = F.coalesce("_n", F.lit(0)), F.coalesce("_s", F.lit(0))
    return out.withColumns({f"{col}_te": (s + F.lit(smooth) * g) / (n + F.lit(smooth)), f"{col}_n": n}).drop("_n", "_s")


def target_encode_oof(train: DataFrame, col: str, target: str, fold: str, smooth: float = 10.0) -> DataFrame:
    """Each row encoded from the other folds: level totals minus the totals of its own fold.

    One (level, fold) aggregation feeds everything, so folds need no loop and no extra scan.
    """
    lf = train.groupBy(col, fold).agg(F.count(target).alias("n"), F.sum(target).alias("s"))
    lv = lf.groupBy(col).agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    fo = lf.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    al = lf.agg(F.struct(F.sum("n").alias("n"), F.sum("s").alias("s")).alias("a")).scalar()
    tab = join_keys(lf, lv, [col]).join(fo, fold)
    g = (al["s"] - F.col("fs")) / (al["n"] - F.col("fn"))
    n, s = F.col("tn") - F.col("n"), F.col("ts") - F.col("s")
    tab = tab.select(col, fold, ((s + F.lit(smooth) * g) / (n + F.lit(smooth))).alias(f"{col}_te"), n.alias(f"{col}_n"))
    return join_keys(train, tab, [col, fold])


def target_encode_oof_apply(train: DataFrame, test: DataFrame, col: str, target: str, fold: str, folds: int, smooth: float = 10.0) -> DataFrame:
    """Test rows: mean over folds of the encodings fitted without that fold."""
    lf = train.groupBy(col, fold).agg(F.count(target).alias("n"), F.sum(target).alias("s"))
    fo = lf.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    tot = fo.agg(F.struct(F.sum("fn").alias("n"), F.sum("fs").alias("s"), F.map_from_entries(F.collect_list(F.struct(fold, F.struct("fn", "fs")))).alias("f")).alias("a")).scalar()
    lv = lf.groupBy(col).agg(
        F.sum("n").alias("tn"), F.sum("s").alias("ts"),
        *[F.sum(F.when(F.col(fold) == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(folds)],
        *[F.sum(F.when(F.col(fold) == i, F.col("s")).otherwise(0)).alias(f"s{i}") for i in range(folds)],
    )
    out = join_keys(test, lv, [col])
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = []
    for i in range(folds):
        own = F.try_element_at(tot["f"], F.lit(i))
        g = (tot["s"] - own["fs"]) / (tot["n"] - own["fn"])
        parts.append((z("ts") - z(f"s{i}") + F.lit(smooth) * g) / (z("tn") - z(f"n{i}") + F.lit(smooth)))
    enc = sum(parts[1:], parts[0]) / folds
    return out.withColumn(f"{col}_te", enc).drop("tn", "ts", *[f"{a}{i}" for a in "ns" for i in range(folds)])


def target_encode_multiclass(train: DataFrame, rows: DataFrame, col: str, target: str, classes: Sequence, smooth: float = 30.0) -> DataFrame:
    """Smoothed class probabilities per level and the level's share of training rows."""
    st = train.groupBy(col).agg(
        F.count(target).alias("_n"), *[F.sum((F.col(target) == c).cast("int")).alias(f"_c{i}") for i, c in enumerate(classes)]
    )
    tot = st.agg(F.struct(F.sum("_n").alias("n"), *[F.sum(f"_c{i}").alias(f"c{i}") for i in range(len(classes))]).alias("t")).scalar()
    out = join_keys(rows, st, [col])
    n = F.coalesce("_n", F.lit(0))
    cols = {
        f"{col}_p_{c}": (F.coalesce(f"_c{i}", F.lit(0)) + F.lit(smooth) * tot[f"c{i}"] / tot["n"]) / (n + F.lit(smooth))
        for i, c in enumerate(classes)
    }
    cols[f"{col}_freq"] = n / tot["n"]
    return out.withColumns(cols).drop("_n", *[f"_c{i}" for i in range(len(classes))])


def group_stats(frames: Sequence[DataFrame], rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and deviation of a value per key over all frames, and value minus mean."""
    pool = frames[0].select(key, value)
    for f in frames[1:]:
        pool = pool.unionAll(f.select(key, value))
    st = pool.groupBy(key).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"))
    return join_keys(rows, st, [key]).withColumn(f"{value}_diff", F.col(value) - F.col(f"{value}_mean"))


def group_profile(train: DataFrame, rows: DataFrame, key: str, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Per-key training mean of each feature (training median for unseen keys), key count and residual."""
    st = train.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"{c}_gm") for c in cols])
    med = quantiles(train, [], {c: (c, 0.5) for c in cols}, limit).agg(F.struct(*[F.first(c).alias(c) for c in cols]).alias("s")).scalar()
    out = join_keys(rows, st, [key]).withColumn(f"{key}_count", F.coalesce("_n", F.lit(0))).drop("_n")
    out = out.withColumns({f"{c}_gm": F.coalesce(F.col(f"{c}_gm"), med[c]) for c in cols})
    return out.withColumns({f"{c}_res": F.col(c) - F.col(f"{c}_gm") for c in cols})


def binned_lookup(train: DataFrame, rows: DataFrame, keys: Sequence[str], target: str, out: str, min_rows: int = 20) -> DataFrame:
    """Majority class per combination of bins with enough rows (ties: first class), else the overall mode."""
    counts = train.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("n"))
    pick = F.min(F.struct((-F.col("n")).alias("m"), F.col(target).alias("t")))
    rule = counts.groupBy(*keys).agg(F.sum("n").alias("_rows"), pick.alias("_b")).where(F.col("_rows") >= min_rows)
    mode = counts.groupBy(target).agg(F.sum("n").alias("n")).agg(pick["t"].alias("m")).scalar()
    got = join_keys(rows, rule.select(*keys, F.col("_b.t").alias(out)), keys)
    return got.withColumn(out, F.coalesce(out, mode))


def centroid_distance(train: DataFrame, rows: DataFrame, vec: str, target: str, dim: int) -> DataFrame:
    """Distance of each standardised vector to each class centroid (training rows), nearest class, second and margin.

    Centroids are classes x dimensions numbers and ride along as one scalar value.
    """
    at = [F.col(vec)[i].cast("double") for i in range(dim)]
    st = train.agg(
        F.struct(F.array(*[F.avg(a) for a in at]).alias("m"), F.array(*[F.coalesce(F.nullif(F.stddev_pop(a), F.lit(0.0)), F.lit(1.0)) for a in at]).alias("s")).alias("st")
    ).scalar()
    cent = train.groupBy(target).agg(F.array(*[F.avg(a) for a in at]).alias("c"))
    cents = cent.agg(F.array_sort(F.collect_list(F.struct(target, "c"))).alias("cs")).scalar()
    out = rows.withColumn("_st", st).withColumn("_cs", cents)
    scaled = lambda v: F.zip_with(F.zip_with(v, F.col("_st.m"), lambda x, m: x - m), F.col("_st.s"), lambda x, s: x / s)
    out = out.withColumn("_z", scaled(F.col(vec).cast("array<double>")))
    dist = F.transform(
        "_cs",
        lambda c: F.struct(
            F.sqrt(F.aggregate(F.zip_with("_z", scaled(c["c"]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("d"),
            c[target].alias("k"),
        ),
    )
    out = out.withColumn("_d", F.array_sort(dist))
    return out.withColumns(
        {"nearest": F.col("_d")[0]["k"], "nearest_dist": F.col("_d")[0]["d"], "margin": F.col("_d")[1]["d"] - F.col("_d")[0]["d"]}
    ).drop("_st", "_cs", "_z", "_d")
