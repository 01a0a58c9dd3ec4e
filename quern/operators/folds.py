"""Folds, splits, samples and weights. Order comes from an md5 of the id and a seed, so it is reproducible anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ordered import digest, hash_lead, join_keys, numbered


def dealt(df: DataFrame, strata: Sequence[str], ids: Sequence[str], seed: int, out: str = "_deal", limit: int | None = None) -> DataFrame:
    """0-based position of each row in the hashed order of its stratum."""
    rows = df.withColumn("_h", digest(*ids, seed=seed))
    rows = numbered(rows, strata, hash_lead(F.col("_h")), ["_h", *ids], out, limit)
    return rows.withColumn(out, F.col(out) - 1).drop("_h")


def kfold(df: DataFrame, id_col: str, k: int, seed: int = 0, limit: int | None = None) -> DataFrame:
    return dealt(df, [], [id_col], seed, limit=limit).withColumn("fold", (F.col("_deal") % k).cast("int")).drop("_deal")


def stratified(df: DataFrame, id_col: str, strata: Sequence[str], k: int, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of each stratum dealt round-robin, so class counts differ by at most one between folds."""
    return dealt(df, strata, [id_col], seed, limit=limit).withColumn("fold", (F.col("_deal") % k).cast("int")).drop("_deal")


def grouped(df: DataFrame, group: str, k: int, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Whole groups in one fold."""
    folds = kfold(df.select(group).distinct(), group, k, seed, limit)
    return join_keys(df, folds, [group])


def stratified_group(df: DataFrame, group: str, target: str, classes: Sequence, k: int, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Groups kept whole and classes balanced: groups with a like class profile are dealt round-robin by size.

    The profile is the group's main class; inside it groups go largest first in a snake order (0..k-1, k-1..0).
    """
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum((F.col(target) == c).cast("int")).alias(f"_c{i}") for i, c in enumerate(classes)])
    main = F.greatest(*[F.struct(F.col(f"_c{i}").alias("n"), F.lit(-i).alias("i")) for i in range(len(classes))])["i"]
    per = per.withColumns({"_main": -main, "_neg": -F.col("_n"), "_h": digest(group, seed=seed)})
    per = numbered(per, ["_main"], F.col("_neg"), ["_neg", "_h"], "_rn", limit)
    p = F.pmod(F.col("_rn") - 1, F.lit(2 * k))
    fold = F.when(p < k, p).otherwise(2 * k - 1 - p).cast("int")
    return join_keys(df, per.select(group, fold.alias("fold")), [group])


def multilabel(df: DataFrame, id_col: str, labels: Sequence[str], k: int, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Stratified by the combination of labels; combinations rarer than k rows share one stratum."""
    combo = F.concat_ws("", *[F.col(c).cast("string") for c in labels])
    rows = df.withColumn("_combo", combo)
    counts = rows.groupBy("_combo").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(counts, "_combo").withColumn("_st", F.when(F.col("_n") >= k, F.col("_combo")).otherwise("rare"))
    return stratified(rows, id_col, ["_st"], k, seed, limit).drop("_combo", "_n", "_st")


def time_forward(df: DataFrame, slice_col: str, slices: Sequence[str]) -> DataFrame:
    """(validation slice, role) pairs per row: earlier slices train, the slice itself validates."""
    s = F.col(slice_col)
    roles = F.array_compact(
        F.array(*[F.when(s < v, F.struct(F.lit(v).alias("valid_slice"), F.lit("train").alias("role"))).when(s == v, F.struct(F.lit(v).alias("valid_slice"), F.lit("valid").alias("role"))) for v in slices[1:]])
    )
    return df.withColumn("_r", F.explode(roles)).select(*df.columns, "_r.*")


def holdout(df: DataFrame, id_col: str, strata: Sequence[str], parts: int = 5, seed: int = 0, limit: int | None = None) -> DataFrame:
    """One of ``parts`` stratified folds is the test set."""
    out = stratified(df, id_col, strata, parts, seed, limit)
    return out.withColumn("part", F.when(F.col("fold") == 0, "test").otherwise("train")).drop("fold")


def nested(df: DataFrame, group: str, outer: int, inner: int, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Outer fold per group, and an inner fold among the groups outside each outer fold (one row per outer fold)."""
    g = kfold(df.select(group).distinct(), group, outer, seed, limit).withColumnRenamed("fold", "own_fold")
    rounds = g.withColumn("outer_fold", F.explode(F.array(*[F.lit(i) for i in range(outer)])))
    train = rounds.where("own_fold <> outer_fold")
    train = dealt(train, ["outer_fold"], [group], seed + 1, limit=limit)
    train = train.select(group, "outer_fold", (F.col("_deal") % inner).cast("int").alias("inner_fold"), F.lit("train").alias("role"))
    test = rounds.where("own_fold = outer_fold").select(group, "outer_fold", F.lit(None).cast("int").alias("inner_fold"), F.lit("outer_test").alias("role"))
    return train.unionAll(test)


def nested_choice(scores: DataFrame) -> DataFrame:
    """Per outer fold: the setting with the best mean inner score (ties: first by name) and its outer score.

    Input rows: outer_fold, setting, inner_fold (null for the outer test), sse, n; lower RMSE is better.
    """
    inner = scores.where("inner_fold IS NOT NULL").groupBy("outer_fold", "setting").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))
    best = inner.groupBy("outer_fold").agg(F.min(F.struct("rmse", "setting")).alias("b"))
    outer = scores.where("inner_fold IS NULL").groupBy("outer_fold", "setting").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("outer_rmse"))
    pick = best.select("outer_fold", F.col("b.setting").alias("setting"), F.col("b.rmse").alias("inner_rmse"))
    return pick.join(outer, ["outer_fold", "setting"])


def stratified_sample(df: DataFrame, id_col: str, strata: Sequence[str], per_class: int, seed: int = 0, limit: int | None = None) -> DataFrame:
    """The first ``per_class`` rows of each class in hashed order."""
    return dealt(df, strata, [id_col], seed, limit=limit).where(F.col("_deal") < per_class).drop("_deal")


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """n / (k * count of the class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.withColumn("weight", tot["n"] / (tot["k"] * F.col("n")))


def fold_frames(df: DataFrame, fold: int, external: str = "is_external") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a fold; external rows only ever train."""
    ext = F.col(external) == 1
    return df.where((F.col("fold") != fold) | ext), df.where((F.col("fold") == fold) & ~ext)


def fold_roles(df: DataFrame, folds: int, external: str = "is_external") -> DataFrame:
    """How many own and external rows train and validate in each fold."""
    r = df.withColumn("valid_fold", F.explode(F.array(*[F.lit(i) for i in range(folds)])))
    ext = F.col(external) == 1
    role: Column = F.when(ext, "train_external").when(F.col("fold") == F.col("valid_fold"), "valid").otherwise("train")
    return r.groupBy("valid_fold", role.alias("role")).agg(F.count(F.lit(1)).alias("n"))
