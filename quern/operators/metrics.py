"""Ranking, classification and regression metrics as aggregations.

Ranking metrics first reduce rows to distinct scores with counts, then take prefix sums with
``running``, so no task ever sorts all raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ordered import join_keys, numbered, running
from quern.session import stored


def attach(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group totals as columns; without keys they are scalar subqueries instead of a join."""
    if keys:
        return join_keys(df, totals, keys)
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})


def ap_at_share(
    df: DataFrame, keys: Sequence[str], target: str, score: str, tie: str, share: float = 0.2, limit: int | None = None
) -> DataFrame:
    """Average precision over the top share of each group, divided by min(k, positives); ties broken by id."""
    rows = df.select(*keys, F.col(target).alias("_y"), (-F.col(score)).alias("_s"), F.col(tie).alias("_t"))
    cum = running(rows, keys, F.col("_s"), ["_s", "_t"], {"_rn": F.lit(1), "_hits": F.col("_y")}, limit)
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"))
    cum = attach(cum, size, keys).withColumn("k", F.ceil(F.col("n") * F.lit(share)))
    top = cum.where(F.col("_rn") <= F.col("k"))
    hit = F.when(F.col("_y") == 1, F.col("_hits") / F.col("_rn")).otherwise(0.0)
    out = top.groupBy(*keys, "n", "k", "positives").agg(F.sum(hit).alias("_sum"))
    best = F.greatest(F.least(F.col("k"), F.col("positives")), F.lit(1))
    return out.select(*keys, "n", "k", "positives", (F.col("_sum") / best).alias("ap"))


def score_counts(df: DataFrame, keys: Sequence[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    """Rows reduced to (keys, score) with positive and total weight."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(y) * w).alias("_p"), F.sum(w).alias("_w"))


def auc(df: DataFrame, keys: Sequence[str], y: str, score: str, weight: Column | None = None, limit: int | None = None) -> DataFrame:
    """ROC-AUC per group, ties counted half; null when a class is missing.

    The counts per score are written: group sizes and sums both read them, and ``df`` may be a model's scores.
    """
    c = stored(score_counts(df, keys, y, score, weight))
    cum = running(c, keys, F.col("_s"), ["_s"], {"_n": F.col("_w") - F.col("_p")}, limit)
    neg = F.col("_w") - F.col("_p")
    part = F.col("_p") * (F.col("_n") - neg / 2.0)
    out = cum.groupBy(*keys).agg(F.sum(part).alias("_a"), F.sum("_p").alias("positives"), F.sum(neg).alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select(*keys, "positives", "negatives", (F.col("_a") / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def auc_micro_macro(long: DataFrame, label: str, y: str, score: str, limit: int | None = None) -> DataFrame:
    """AUC of all labels pooled and the mean of per-label AUCs, from long (label, y, score) rows."""
    per = auc(long, [label], y, score, limit=limit)
    micro = auc(long, [], y, score, limit=limit).select("auc").scalar()
    return per.agg(F.avg("auc").alias("macro"), F.count(F.lit(1)).alias("labels")).withColumn("micro", micro)


def single_feature_auc(df: DataFrame, cols: Sequence[str], labels: Sequence[str], top: int = 3, limit: int | None = None) -> DataFrame:
    """Strength max(auc, 1 - auc) and direction of each feature alone; the top few per label."""
    from pyspark.sql import Window

    pairs = F.array(
        *[F.struct(F.lit(lb).alias("label"), F.lit(c).alias("feature"), F.col(lb).alias("y"), F.col(c).cast("double").alias("x")) for lb in labels for c in cols]
    )
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where("x IS NOT NULL")
    a = auc(long, ["label", "feature"], "y", "x", limit=limit)
    a = a.select("label", "feature", F.greatest("auc", 1 - F.col("auc")).alias("strength"), F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("direction"))
    w = Window.partitionBy("label").orderBy(F.desc("strength"), "feature")  # one row per feature
    return a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def average_precision(df: DataFrame, keys: Sequence[str], y: str, score: str, limit: int | None = None) -> DataFrame:
    """Step-wise area under the precision-recall curve over distinct scores."""
    c = score_counts(df, keys, y, score).withColumn("_neg", -F.col("_s"))
    cum = running(c, keys, F.col("_neg"), ["_neg"], {"_tp": F.col("_p"), "_all": F.col("_w")}, limit)
    out = cum.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("_tp") / F.col("_all")).alias("_a"), F.sum("_p").alias("positives"))
    return out.select(*keys, "positives", (F.col("_a") / F.nullif("positives", F.lit(0))).alias("average_precision"))


def f_beta_confusion(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    n = lambda a, b: F.sum(((F.col(y) == a) & (F.col(pred) == b)).cast("int"))
    out = df.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    z = F.lit(0)
    return out.withColumns(
        {
            "precision": tp / F.nullif(tp + fp, z),
            "recall": tp / F.nullif(tp + fn, z),
            "f1": 2 * tp / F.nullif(2 * tp + fp + fn, z),
            "f2": 5 * tp / F.nullif(5 * tp + 4 * fn + fp, z),
        }
    )


def class_recall(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Recall of each class and the mean over classes (balanced accuracy)."""
    per = df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(pred)).cast("int")).alias("recall"))
    return per.withColumn("balanced_accuracy", per.agg(F.avg("recall")).scalar())


def log_loss(df: DataFrame, keys: Sequence[str], y: str, probs: dict, eps: float = 1e-15) -> DataFrame:
    """Clipped log loss; ``probs`` maps class value to probability column, rows are renormalised after clipping."""
    clipped = {k: F.least(F.greatest(F.col(c), F.lit(eps)), F.lit(1 - eps)) for k, c in probs.items()}
    total = sum(list(clipped.values())[1:], list(clipped.values())[0])
    p = None
    for k, v in clipped.items():
        p = F.when(F.col(y) == k, v) if p is None else p.when(F.col(y) == k, v)
    return df.groupBy(*keys).agg(F.avg(-F.ln(p / total)).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def error_summary(df: DataFrame, keys: Sequence[str], y: str, pred: str, limit: int | None = None) -> DataFrame:
    """RMSE, MAE, bias and 95th percentile of the absolute error per group."""
    from quern.functions.ordered import quantiles

    rows = df.withColumn("_e", F.col(pred) - F.col(y)).withColumn("_ae", F.abs("_e"))
    base = rows.groupBy(*keys).agg(
        F.count("_e").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_ae").alias("mae"), F.avg("_e").alias("bias")
    )
    return attach(base, quantiles(rows, keys, {"p95_abs": ("_ae", 0.95)}, limit), keys)


def pooled_score(df: DataFrame, entity: str, y: str, pred: str, limit: int | None = None) -> DataFrame:
    """Pooled RMSE over all rows, and mean and median of the per-entity RMSE."""
    from quern.functions.ordered import quantiles

    e = F.col(pred) - F.col(y)
    per = df.groupBy(entity).agg(F.sum(e * e).alias("sse"), F.count(F.lit(1)).alias("n")).withColumn("rmse", F.sqrt(F.col("sse") / F.col("n")))
    out = per.agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("pooled_rmse"), F.avg("rmse").alias("mean_rmse"))
    return attach(out, quantiles(per, [], {"median_rmse": ("rmse", 0.5)}, limit), [])


def best_threshold_f1(df: DataFrame, y: str, score: str, limit: int | None = None) -> DataFrame:
    """Threshold (score >= t is positive) with the highest F1 over every score; ties: highest threshold."""
    c = score_counts(df, [], y, score).withColumn("_neg", -F.col("_s"))
    cum = running(c, [], F.col("_neg"), ["_neg"], {"_tp": F.col("_p"), "_all": F.col("_w")}, limit)
    pos = c.agg(F.sum("_p")).scalar()
    f1 = F.round(2 * F.col("_tp") / (F.col("_all") + pos), 12)
    best = cum.select(f1.alias("f1"), F.col("_s").alias("t")).agg(F.max(F.struct("f1", "t")).alias("b"))
    return best.select(F.col("b.t").alias("threshold"), F.col("b.f1").alias("f1"))


def threshold_grid_f1(df: DataFrame, y: str, score: str, grid: Sequence[float]) -> DataFrame:
    """F1 at each threshold of a fixed grid. Rows fall in one grid cell each; counts are then summed from the top."""
    from pyspark.sql import Window

    edges = sorted(grid)
    cell = F.size(F.filter(F.array(*[F.lit(float(t)) for t in edges]), lambda t: t <= F.col(score)))
    c = df.groupBy(cell.alias("_c")).agg(F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_n"))
    cells_ = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(edges)], "_c int, threshold double")
    w = Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0)  # one row per grid point
    j = c.join(cells_, "_c", "full").withColumns({"_tp": F.sum(F.coalesce("_p", F.lit(0))).over(w), "_all": F.sum(F.coalesce("_n", F.lit(0))).over(w)})
    pos = c.agg(F.sum("_p")).scalar()
    return j.where("threshold IS NOT NULL").select("threshold", (2 * F.col("_tp") / F.nullif(F.col("_all") + pos, F.lit(0))).alias("f1"))


def segment_auc(df: DataFrame, segment: str, y: str, score: str, min_rows: int = 200, min_class: int = 20, limit: int | None = None) -> DataFrame:
    """AUC inside segments that have enough rows and enough of each class."""
    out = auc(df, [segment], y, score, limit=limit)
    return out.where((F.col("positives") + F.col("negatives") >= min_rows) & (F.least("positives", "negatives") >= min_class))


# fixed values: ranking band edges
BANDS = (0.0, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 1.0)


def score_bands(df: DataFrame, keys: Sequence[str], y: str, score: str, bands: Sequence[float] = BANDS, limit: int | None = None) -> DataFrame:
    """Target rate by position in the ranking (0 = best), lift over all rows."""
    from quern.functions.ordered import average_rank

    rows = average_rank(df.withColumn("_neg", -F.col(score)), keys, "_neg", "_pct", pct=True, limit=limit)
    p = F.col("_pct")
    band = None
    for lo, hi in zip(bands[:-1], bands[1:]):
        name = f"{lo:.2f}-{hi:.2f}"
        band = F.when((p > lo) & (p <= hi), name) if band is None else band.when((p > lo) & (p <= hi), name)
    out = rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
    return out.withColumn("lift", F.col("rate") / df.agg(F.avg(y)).scalar())


def top_share_by_group(df: DataFrame, group: str, keys: Sequence[str], y: str, score: str, top: float = 0.2, limit: int | None = None) -> DataFrame:
    """Share of each group inside the top of the ranking, target rate inside and outside it."""
    from quern.functions.ordered import average_rank

    rows = average_rank(df.withColumn("_neg", -F.col(score)), keys, "_neg", "_pct", pct=True, limit=limit)
    inside = F.col("_pct") <= top
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside.cast("int")).alias("share_in_top"),
        F.avg(F.when(inside, F.col(y))).alias("rate_in_top"), F.avg(F.when(~inside, F.col(y))).alias("rate_outside"),
    )


def uniform(*cols: Column | str) -> Column:
    """Reproducible number in [0, 1) from a hash of the columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 40))).cast("double") / float(1 << 40)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform number by its distribution function."""
    import math

    acc, out = 0.0, None
    for k in range(9):
        acc += math.exp(-1.0) / math.factorial(k)
        out = F.when(u < acc, k) if out is None else out.when(u < acc, k)
    return out.otherwise(9)


def paired_bootstrap(df: DataFrame, unit: str, y: str, a: str, b: str, replicates: int = 50, seed: int = 0, limit: int | None = None, tail: float = 0.05) -> DataFrame:
    """AUC difference a - b over Poisson(1) resamples of units: mean, median, the ``tail`` percentiles and P(a better).

    A row is repeated only for replicates where its weight is positive. Resampling is stratified by class by nature:
    a weight never moves a row to the other class, and the AUC is a mean over both classes.
    """
    reps = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.struct(r.alias("rep"), poisson_one(uniform(F.col(unit), r, F.lit(seed))).alias("w"))),
        lambda x: x["w"] > 0,
    )
    rows = df.select(unit, y, a, b, F.explode(reps).alias("r")).select(y, a, b, "r.*")
    aa = auc(rows, ["rep"], y, a, F.col("w"), limit).select("rep", F.col("auc").alias("_a"))
    bb = auc(rows, ["rep"], y, b, F.col("w"), limit).select("rep", F.col("auc").alias("_b"))
    d = aa.join(bb, "rep").select((F.col("_a") - F.col("_b")).alias("d"))  # one row per replicate
    q = F.percentile("d", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    return d.agg(F.count("d").alias("replicates"), F.avg("d").alias("mean"), q.alias("q"), F.avg((F.col("d") > 0).cast("int")).alias("p_better")).select(
        "replicates", "mean", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "p_better"
    )


def noise_curve(df: DataFrame, unit: str, y: str, score: str, shares: Sequence[float], replicates: int = 20, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Deviation and 5-95 % width of the AUC by sample share, over hashed subsamples of units."""
    cells_ = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(r).alias("rep")) for s in shares for r in range(replicates)])
    picked = F.filter(cells_, lambda c: uniform(F.col(unit), c["share"], c["rep"], F.lit(seed)) < c["share"])
    rows = df.select(y, score, F.explode(picked).alias("c")).select(y, score, "c.*")
    a = auc(rows, ["share", "rep"], y, score, limit=limit)
    q = F.percentile("auc", F.array(F.lit(0.05), F.lit(0.95)))
    return a.groupBy("share").agg(
        F.avg(F.col("positives") + F.col("negatives")).alias("mean_rows"), F.stddev_samp("auc").alias("sd"), (q[1] - q[0]).alias("width")
    )


def worst_decile_share(per_entity: DataFrame, sse: str, tie: str, share: float = 0.1, limit: int | None = None) -> DataFrame:
    """Share of the total squared error held by the worst tenth of entities, equal errors ordered by ``tie``."""
    rows = numbered(per_entity.withColumn("_neg", -F.col(sse)), [], F.col("_neg"), ["_neg", tie], "_rn", limit)
    n = per_entity.agg(F.greatest(F.ceil(F.count(F.lit(1)) * F.lit(share)), F.lit(1))).scalar()
    return rows.agg(F.sum(F.when(F.col("_rn") <= n, F.col(sse))).alias("worst_sse"), F.sum(sse).alias("total_sse")).withColumn(
        "share", F.col("worst_sse") / F.greatest("total_sse", F.lit(1e-12))
    )


def error_pairs(df: DataFrame, y: str, pred: str, band: Column, level: str) -> DataFrame:
    """True -> predicted errors by feature band and category, with the share of the band's rows."""
    rows = df.withColumn("band", band)
    tot = rows.groupBy("band", level).agg(F.count(F.lit(1)).alias("rows"))
    bad = rows.where(F.col(y) != F.col(pred)).groupBy(F.concat_ws("->", y, pred).alias("pair"), "band", level).agg(F.count(F.lit(1)).alias("errors"))
    return join_keys(bad, tot, ["band", level]).withColumn("error_share", F.col("errors") / F.col("rows"))


def expected_balanced_accuracy(df: DataFrame, pred: str, probs: dict) -> DataFrame:
    """Balanced accuracy a prediction would have if the probabilities were right (0 recall for an empty class)."""
    rec = [
        F.coalesce(F.sum(F.when(F.col(pred) == k, F.col(c)).otherwise(0.0)) / F.nullif(F.sum(c), F.lit(0.0)), F.lit(0.0)) for k, c in probs.items()
    ]
    return df.agg((sum(rec[1:], rec[0]) / len(rec)).alias("expected_balanced_accuracy"))


def leaderboard_percentile(subs: DataFrame, board: DataFrame, comp: str, score: str, limit: int | None = None) -> DataFrame:
    """Rank and percent beaten of each submission on its board (higher is better).

    Boards and submissions are reduced to distinct scores; better scores come from one prefix sum.
    """
    both = board.select(comp, (-F.col(score)).alias("_neg"), F.lit(1).alias("_n")).unionAll(subs.select(comp, (-F.col(score)).alias("_neg"), F.lit(0).alias("_n")))
    vals = both.groupBy(comp, "_neg").agg(F.sum("_n").alias("_n"))
    cum = running(vals, [comp], F.col("_neg"), ["_neg"], {"_c": F.col("_n")}, limit).withColumn("_better", F.col("_c") - F.col("_n"))
    tot = board.groupBy(comp).agg(F.count(F.lit(1)).alias("_total"))
    out = join_keys(subs.withColumn("_neg", -F.col(score)), cum.select(comp, "_neg", "_better"), [comp, "_neg"]).join(tot, comp)
    rank = F.least(F.col("_better") + 1, F.col("_total"))
    pct = F.when(F.col("_total") == 1, 100.0).otherwise((F.col("_total") - rank) / F.nullif(F.col("_total") - 1, F.lit(0)) * 100.0)
    return out.withColumns({"rank": rank, "beaten_pct": pct}).drop("_neg", "_better", "_total")


def attempt_progress(subs: DataFrame, keys: Sequence[str], when: str, tie: str, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Attempt number and percent of attempts and of the time span used."""
    rows = subs.withColumn("_t", F.unix_date(F.col(when)))
    rows = numbered(rows, keys, F.col("_t"), ["_t", tie], "attempt", limit)
    n = subs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    used = 100.0 * (F.datediff(F.col(when), start)) / F.datediff(end, start)
    out = join_keys(rows, n, keys)
    return out.withColumns(
        {"attempt_pct": 100.0 * F.col("attempt") / F.col("_n"), "time_pct": F.least(F.greatest(used, F.lit(0.0)), F.lit(100.0))}
    ).drop("_t", "_n")


def best_per_key(df: DataFrame, key: str, score: str, name: str, higher: str) -> DataFrame:
    """Best score and its owner per key; ``higher`` is a 0/1 column telling whether larger is better (ties: first name)."""
    s = F.when(F.col(higher) == 1, -F.col(score)).otherwise(F.col(score))
    return df.groupBy(key).agg(F.min(F.struct(s.alias("k"), F.col(name).alias("n"), F.col(score).alias("s"))).alias("b")).select(
        key, F.col("b.s").alias("best"), F.col("b.n").alias("best_name")
    )


def top_k_recall(actual: DataFrame, recommended: DataFrame, keys: Sequence[str], item: str, rank: str, k: int = 6) -> DataFrame:
    """Share of each row's distinct items found among the first k recommendations.

    Long rows on both sides: actual (keys, item), recommended (item, rank), with the keys too if lists differ per key.
    """
    on = [c for c in (*keys, item) if c in recommended.columns]
    hits = recommended.where(F.col(rank) <= k).select(*on).distinct().withColumn("_h", F.lit(1))
    rows = actual.select(*keys, item).distinct().join(hits, on, "left")
    return rows.groupBy(*keys).agg((F.count("_h") / F.count(F.lit(1))).alias("recall"))
