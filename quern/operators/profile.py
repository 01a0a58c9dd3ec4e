"""Profiling, association with a target and drift between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.mathx import clip, safe_div
from quern.functions.ordered import average_rank, quantiles
from quern.operators.quality import cells


def numbers(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form of numeric columns: (kept columns, feature, x)."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(*keep, F.explode(arr).alias("p")).select(*keep, "p.*")


# fixed values: percentiles of the profile
PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def numeric_profile(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    long = numbers(df, cols)
    q = quantiles(long, ["feature"], {f"p{p:02d}": ("x", p / 100) for p in PERCENTS}, limit)
    base = long.groupBy("feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), (100.0 * F.avg(F.col("x").isNull().cast("int"))).alias("missing_pct"),
    )
    return base.join(q, "feature")


def percentile_by_class(df: DataFrame, cols: Sequence[str], target: str, limit: int | None = None) -> DataFrame:
    """p05, median, p95, IQR and missing share per feature and class, with the median's lift over all rows."""
    long = numbers(df, cols, [target])
    want = {"p05": ("x", 0.05), "q25": ("x", 0.25), "p50": ("x", 0.5), "q75": ("x", 0.75), "p95": ("x", 0.95)}
    q = quantiles(long, ["feature", target], want, limit)
    miss = long.groupBy("feature", target).agg((100.0 * F.avg(F.col("x").isNull().cast("int"))).alias("missing_pct"))
    whole = quantiles(long, ["feature"], {"_m": ("x", 0.5)}, limit)
    out = q.join(miss, ["feature", target]).join(whole, "feature")
    return out.select(
        "feature", target, "p05", "p50", "p95", (F.col("q75") - F.col("q25")).alias("iqr"), "missing_pct",
        (100.0 * (safe_div(F.col("p50"), F.col("_m")) - 1)).alias("median_lift_pct"),
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def mean_lift_by_class(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    long = numbers(df, cols, [target])
    per = long.groupBy("feature", target).agg(F.avg("x").alias("class_mean"), F.sum("x").alias("_s"), F.count("x").alias("_n"))
    whole = per.groupBy("feature").agg((F.sum("_s") / F.sum("_n")).alias("overall_mean"))
    out = per.join(whole, "feature")
    return out.select("feature", target, "class_mean", "overall_mean", (100.0 * (safe_div(F.col("class_mean"), F.col("overall_mean")) - 1)).alias("lift_pct"))


def class_vs_rest(df: DataFrame, cols: Sequence[str], target: str, value, limit: int | None = None) -> DataFrame:
    side = F.when(F.col(target) == value, "class").otherwise("rest")
    long = numbers(df.withColumn("_side", side), cols, ["_side"])
    q = quantiles(long, ["feature", "_side"], {"p05": ("x", 0.05), "p50": ("x", 0.5), "p95": ("x", 0.95)}, limit)
    pick = lambda s, c: F.max(F.when(F.col("_side") == s, F.col(c)))
    out = q.groupBy("feature").agg(
        pick("class", "p50").alias("class_median"), pick("rest", "p50").alias("rest_median"), pick("class", "p05").alias("class_p05"), pick("class", "p95").alias("class_p95")
    )
    return out.withColumn("lift_pct", 100.0 * (safe_div(F.col("class_median"), F.col("rest_median")) - 1))


def category_target_mix(df: DataFrame, col: str, target: str, classes: Sequence) -> DataFrame:
    """Class shares within each level; missing is a level of its own."""
    level = F.coalesce(F.col(col).cast("string"), F.lit("Missing"))
    return df.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col(target) == c).cast("int")).alias(f"share_{c}") for c in classes]
    )


def _level_counts(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    long = cells(df, cols, [target]).withColumn("level", F.coalesce("value", F.lit("Missing")))
    return long.groupBy(F.col("column").alias("feature"), "level", target).agg(F.count(F.lit(1)).alias("n"))


def category_signal_scan(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Lift in points of each class share on each level of each categorical feature."""
    counts = _level_counts(df, cols, target)
    tot = counts.groupBy("feature", "level").agg(F.sum("n").alias("level_n"))
    base = counts.groupBy("feature", target).agg(F.sum("n").alias("_c")).join(counts.groupBy("feature").agg(F.sum("n").alias("_a")), "feature")
    out = counts.join(tot, ["feature", "level"]).join(base, ["feature", target])
    share = 100.0 * F.col("n") / F.col("level_n")
    return out.select("feature", "level", target, "level_n", share.alias("share_pct"), (share - 100.0 * F.col("_c") / F.col("_a")).alias("lift_points"))


def interaction_mix(df: DataFrame, a: str, b: str, target: str, classes: Sequence, min_rows: int = 200) -> DataFrame:
    combo = F.concat_ws(" | ", F.coalesce(F.col(a).cast("string"), F.lit("Missing")), F.coalesce(F.col(b).cast("string"), F.lit("Missing")))
    out = df.groupBy(combo.alias("combo")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col(target) == c).cast("int")).alias(f"share_{c}") for c in classes]
    )
    return out.where(F.col("n") >= min_rows)


def eta_squared(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Between-class over total sum of squares (class sums only, then one row per feature)."""
    per = numbers(df, cols, [target]).where("x IS NOT NULL").groupBy("feature", target).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    )
    grand = per.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    j = per.join(grand, "feature")
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2))
    total = between + F.sum(F.col("n") * F.col("v"))
    out = j.groupBy("feature").agg(safe_div(between, total).alias("eta2"))
    return out.withColumn("eta", F.sqrt("eta2"))


def cramers_v(df: DataFrame, cols: Sequence[str], target: str, correction: bool = False) -> DataFrame:
    """Cramer's V of each feature with the target; optional continuity correction for 2 x 2 tables.

    Chi-square needs expected counts of empty cells too: sum of (o-e)^2/e = sum over observed cells of
    o^2/e - n. The corrected form is only used on 2 x 2, where every cell is listed.
    """
    counts = _level_counts(df.where(F.col(target).isNotNull()), cols, target).withColumnRenamed("n", "o")
    rows = counts.groupBy("feature", "level").agg(F.sum("o").alias("ro"))
    colt = counts.groupBy("feature", target).agg(F.sum("o").alias("co"))
    dims = (
        rows.groupBy("feature").agg(F.count(F.lit(1)).alias("r"), F.sum("ro").alias("n"))
        .join(colt.groupBy("feature").agg(F.count(F.lit(1)).alias("k")), "feature")
    )
    j = counts.join(rows, ["feature", "level"]).join(colt, ["feature", target]).join(dims, "feature")
    j = j.withColumns({c: F.col(c).cast("double") for c in ("o", "ro", "co", "n")})  # products of counts leave 64 bits
    e = F.col("ro") * F.col("co") / F.col("n")
    if correction:
        # the four deviations of a 2 x 2 table are equal in size, whether or not a cell is empty
        dev = F.abs(F.col("o") - e)
        shrunk = dev - F.least(F.lit(0.5), dev)
        full = F.max(shrunk * shrunk)
        inv = F.max(F.col("n") * F.col("n") * F.col("n"))
        margins = F.max(F.col("ro") * (F.col("n") - F.col("ro")) * F.col("co") * (F.col("n") - F.col("co")))
        plain = F.sum(F.col("o") * F.col("o") / e) - F.max("n")
        chi = F.when((F.max("r") == 2) & (F.max("k") == 2), full * inv / margins).otherwise(plain)
    else:
        chi = F.sum(F.col("o") * F.col("o") / e) - F.max("n")
    out = j.groupBy("feature").agg(chi.alias("chi2"), F.max("n").alias("n"), F.max("r").alias("r"), F.max("k").alias("k"))
    dof = F.least("r", "k") - 1
    v = F.when(dof <= 0, 0.0).otherwise(F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / F.col("n") / F.greatest(dof, F.lit(1))))
    return out.select("feature", F.greatest("chi2", F.lit(0.0)).alias("chi2"), v.alias("cramers_v"))


def feature_strength(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str) -> DataFrame:
    """One table: eta squared of numeric features, Cramer's V of categories and of missing-value flags."""
    flags = df.select(target, *[F.col(c).isNull().cast("string").alias(c) for c in (*numeric, *categorical)])
    parts = [
        eta_squared(df, numeric, target).select("feature", F.lit("numeric").alias("kind"), F.col("eta2").alias("strength")),
        cramers_v(df, categorical, target).select("feature", F.lit("category").alias("kind"), F.col("cramers_v").alias("strength")),
        cramers_v(flags, [*numeric, *categorical], target).select("feature", F.lit("missing").alias("kind"), F.col("cramers_v").alias("strength")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def kruskal_h(df: DataFrame, cols: Sequence[str], target: str, limit: int | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction.

    Ranks come from value counts per feature (average ranks of ties), so no raw row is ever sorted globally.
    """
    from quern.functions.ordered import running

    long = numbers(df, cols, [target]).where("x IS NOT NULL")
    per = long.groupBy("feature", "x", target).agg(F.count(F.lit(1)).alias("k"))
    vals = per.groupBy("feature", "x").agg(F.sum("k").alias("t"))
    cum = running(vals, ["feature"], F.col("x"), ["x"], {"c": F.col("t")}, limit)
    rank = F.col("c") - F.col("t") + (F.col("t") + 1) / 2.0
    t = F.col("t").cast("double")
    ties = cum.groupBy("feature").agg(F.sum("t").alias("n"), F.sum(t * t * t - t).alias("tie"))
    sums = per.join(cum.select("feature", "x", rank.alias("rank")), ["feature", "x"]).groupBy("feature", target).agg(
        F.sum(F.col("k") * F.col("rank")).alias("rs"), F.sum("k").alias("nk")
    )
    n = F.col("n").cast("double")
    parts = sums.groupBy("feature").agg(F.sum(F.col("rs") * F.col("rs") / F.col("nk")).alias("q")).join(ties, "feature")
    h = 12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return parts.select("feature", F.col("n"), (h / F.nullif(1 - F.col("tie") / (n * n * n - n), F.lit(0.0))).alias("h"))


def pairs_of(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


def pair_table(df: DataFrame, pairs: Sequence[tuple[str, str]], measures: dict[str, callable]) -> DataFrame:
    """One aggregation that evaluates measures for every column pair, then one row per pair."""
    aggs = [fn(a, b).alias(f"{m}_{i}") for i, (a, b) in enumerate(pairs) for m, fn in measures.items()]
    one = df.agg(*aggs)
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, (a, b) in enumerate(pairs)]
    )
    return one.select(F.explode(rows).alias("p")).select("p.*")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns."""
    return pair_table(df, pairs_of(cols), {"corr": lambda a, b: F.corr(a, b)})


def spearman_matrix(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Pearson correlation of average ranks."""
    ranked = df.select(*cols)
    for c in cols:
        ranked = average_rank(ranked, [], c, f"_r_{c}", limit=limit)
    return pair_table(ranked.select(*[F.col(f"_r_{c}").alias(c) for c in cols]), pairs_of(cols), {"spearman": lambda a, b: F.corr(a, b)})


def phi_lift_pairs(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Co-occurrence, phi and lift of every pair of 0/1 labels from one aggregation."""
    both = lambda a, b: F.avg((F.col(a) * F.col(b)).cast("double"))
    pa = lambda a, b: F.avg(F.col(a).cast("double"))
    pb = lambda a, b: F.avg(F.col(b).cast("double"))
    out = pair_table(df, pairs_of(labels), {"rate": both, "pa": pa, "pb": pb})
    x, y = F.col("pa"), F.col("pb")
    phi = (F.col("rate") - x * y) / F.nullif(F.sqrt(x * (1 - x) * y * (1 - y)), F.lit(0.0))
    return out.select("a", "b", "rate", phi.alias("phi"), safe_div(F.col("rate"), x * y).alias("lift"))


def positives_histogram(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    n = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    return df.groupBy(n.alias("positives")).agg(F.count(F.lit(1)).alias("n"))


def residual_corr(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation of y - p between labels; ``pairs`` are (label column, probability column)."""
    res = df.select(*[(F.col(y) - F.col(p)).alias(y) for y, p in pairs])
    return corr_matrix(res, [y for y, _ in pairs])


def two_splits(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return a.select(*cols, F.lit("a").alias("split")).unionByName(b.select(*cols, F.lit("b").alias("split")))


def numeric_drift(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardised mean difference b - a: by the root mean variance and by the pooled sample's deviation."""
    x = F.col("x")
    pick = lambda fn, s: fn(F.when(F.col("split") == s, x))
    out = numbers(two_splits(a, b, cols), cols, ["split"]).groupBy("feature").agg(
        pick(F.avg, "a").alias("mean_a"), pick(F.avg, "b").alias("mean_b"), pick(F.var_samp, "a").alias("_va"),
        pick(F.var_samp, "b").alias("_vb"), F.stddev_samp("x").alias("_sd"),
    )
    diff = F.col("mean_b") - F.col("mean_a")
    return out.select(
        "feature", "mean_a", "mean_b", safe_div(diff, F.sqrt((F.col("_va") + F.col("_vb")) / 2)).alias("smd"), safe_div(diff, F.col("_sd")).alias("smd_pooled")
    )


def categorical_drift(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Total variation distance between the level shares of two tables."""
    long = cells(two_splits(a, b, cols), cols, ["split"]).withColumn("level", F.coalesce("value", F.lit("Missing")))
    side = lambda s: F.sum((F.col("split") == s).cast("long"))
    counts = long.groupBy("column", "level").agg(side("a").alias("na"), side("b").alias("nb"))
    tot = counts.groupBy("column").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    j = counts.join(tot, "column")
    return j.groupBy(F.col("column").alias("feature")).agg((F.sum(F.abs(F.col("na") / F.col("ta") - F.col("nb") / F.col("tb"))) / 2).alias("tvd"))


def category_coverage(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Levels in each table and levels of b never seen in a."""
    long = cells(two_splits(a, b, cols), cols, ["split"]).where("value IS NOT NULL")
    has = lambda s: F.max((F.col("split") == s).cast("int"))
    lv = long.groupBy("column", "value").agg(has("a").alias("ia"), has("b").alias("ib"))
    return lv.groupBy(F.col("column").alias("feature")).agg(
        F.sum("ia").alias("levels_a"), F.sum("ib").alias("levels_b"), F.sum(F.col("ib") * (1 - F.col("ia"))).alias("unseen_in_b")
    )


def mutual_info(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of equal-width binned features with the target; a missing value is its own bin."""
    stats = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])
    one = stats.agg(F.struct(*[F.first(c).alias(c) for c in stats.columns]).alias("s")).scalar()

    def bin_of(c: str) -> Column:
        span = F.nullif(one[f"hi_{c}"] - one[f"lo_{c}"], F.lit(0.0))
        b = clip(F.floor((F.col(c) - one[f"lo_{c}"]) / span * bins), hi=bins - 1)
        return F.coalesce(b, F.when(F.col(c).isNotNull(), F.lit(0)), F.lit(-1)).cast("int")

    arr = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in cols])
    counts = df.select(target, F.explode(arr).alias("p")).groupBy("p.feature", "p.bin", target).agg(F.count(F.lit(1)).alias("o"))
    rows = counts.groupBy("feature", "bin").agg(F.sum("o").alias("ro"))
    colt = counts.groupBy("feature", target).agg(F.sum("o").alias("co"))
    n = counts.groupBy("feature").agg(F.sum("o").alias("n"))
    j = counts.join(rows, ["feature", "bin"]).join(colt, ["feature", target]).join(n, "feature")
    p = F.col("o") / F.col("n")
    lift = (F.col("o") / F.col("ro")) * (F.col("n") / F.col("co"))
    return j.groupBy("feature").agg(F.sum(p * F.ln(lift)).alias("mi"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """Equal-width counts per column between its minimum and maximum."""
    long = numbers(df, cols).where("x IS NOT NULL")
    lim = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = long.join(F.broadcast(lim), "feature")  # one row per column
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)))
    return j.groupBy("feature", b.alias("bin"), (F.col("lo") + b * width).alias("left_edge")).agg(F.count(F.lit(1)).alias("n"))


def row_count_hist(df: DataFrame, entity: str, flag: Column, width: int = 10) -> DataFrame:
    """Rows per entity in bins, with the number of entities and their mean share of flagged rows."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("int")).alias("share"))
    b = F.floor(F.col("n") / width) * width
    return per.groupBy(b.alias("rows_from")).agg(F.count(F.lit(1)).alias("entities"), F.avg("share").alias("flag_share"))


def five_numbers(df: DataFrame, entity: str, flag: Column, limit: int | None = None) -> DataFrame:
    """Five-number summary over entities of rows and flagged rows."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(flag.cast("int")).alias("n_flagged"))
    long = numbers(per, ["n_rows", "n_flagged"])
    return quantiles(long, ["feature"], {"min": ("x", 0.0), "q1": ("x", 0.25), "median": ("x", 0.5), "q3": ("x", 0.75), "max": ("x", 1.0)}, limit)


def adversarial_auc(a: DataFrame, b: DataFrame, cols: Sequence[str], folds: int = 3, seed: int = 0) -> DataFrame:
    """Out-of-fold AUC of a classifier that tells the two tables apart (0.5 = no drift)."""
    from quern.operators.metrics import auc
    from quern.operators.models import oof_logistic

    rows = two_splits(a, b, cols).withColumn("label", (F.col("split") == "b").cast("int"))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(folds)).cast("int"))
    scored = oof_logistic(rows, cols, "label", "_fold", folds)
    return auc(scored, [], "label", "score")


def pca_variance(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Explained variance of principal components of standardised columns."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    vec = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip").transform(df.select(*cols))
    z = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(vec).transform(vec)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(z)
    share = [float(x) for x in model.explainedVariance]
    rows = [(i + 1, s, sum(share[: i + 1])) for i, s in enumerate(share)]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")
