"""Models as Spark jobs: out-of-fold scoring, small searches, feature selection and baselines with Spark ML.

Folds are columns: a fold is a filter, and the out-of-fold scores of all folds are one union.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.metrics import auc, uniform
from quern.session import stored


def prepared(cols: Sequence[str], scale: bool = True) -> list:
    """Median imputation, assembling and scaling, all fitted on the training rows of a fold."""
    filled = [f"_i_{c}" for c in cols]
    stages = [Imputer(strategy="median", inputCols=list(cols), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v")]
    if scale:
        stages.append(StandardScaler(inputCol="_v", outputCol="_x", withMean=True, withStd=True))
    return stages


def _numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _fit(train: DataFrame, cols: Sequence[str], label: str, model: Callable[[str], object], scale: bool) -> list:
    """Preparation and one or several models (their scores are averaged) on the training rows."""
    train = train.withColumn(label, F.col(label).cast("double"))
    prep = Pipeline(stages=prepared(cols, scale)).fit(train)
    made = model("_x" if scale else "_v")
    ready = prep.transform(train)
    return [prep, *[m.fit(ready) for m in (made if isinstance(made, list) else [made])]]


def _score(df: DataFrame, fitted: list, out: str, regression: bool) -> DataFrame:
    prep, *models = fitted
    value = F.col("prediction") if regression else vector_to_array("probability")[1]
    names = [f"_m{i}" for i in range(len(models))]
    t = prep.transform(df)
    for i, m in enumerate(models):
        t = m.transform(t).withColumn(names[i], value).drop("rawPrediction", "probability", "prediction")
    return t.select(*df.columns, (sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).alias(out))


def oof(
    df: DataFrame, cols: Sequence[str], label: str, fold: str, folds: int, model: Callable[[str], object], scale: bool = True, regression: bool = False,
    external: str | None = None, test: DataFrame | None = None, refit: bool = False,
) -> DataFrame:
    """Out-of-fold ``score`` for every row; several models (``model`` gives a list) are averaged in the row.

    With ``test``, its rows get the mean score over the fold models, or with ``refit`` that of a model of all rows.
    Rows flagged by ``external`` only train. The table is cached while models are fitted and released then.
    """
    df = _numeric(df, cols).persist()
    own = df if external is None else df.where(F.col(external) == 0)
    fitted = []
    for i in range(folds):
        train = df.where(F.col(fold) != i) if external is None else df.where((F.col(fold) != i) | (F.col(external) == 1))
        fitted.append(_fit(train, cols, label, model, scale))
    last = [_fit(df, cols, label, model, scale)] if refit and test is not None else fitted
    df.unpersist()
    out = None
    for i, m in enumerate(fitted):
        part = _score(own.where(F.col(fold) == i), m, "score", regression)
        out = part if out is None else out.unionByName(part)
    if test is not None:
        t = _numeric(test, cols)
        for j, m in enumerate(last):
            t = _score(t, m, f"_s{j}", regression)
        names = [f"_s{j}" for j in range(len(last))]
        t = t.withColumn("score", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)
        out = out.unionByName(t.withColumns({fold: F.lit(-1)}), allowMissingColumns=True)
    return out


def oof_logistic(df: DataFrame, cols: Sequence[str], label: str, fold: str, folds: int, reg: float = 0.0, test: DataFrame | None = None, refit: bool = True) -> DataFrame:
    """Logistic regression out of fold; test rows are scored by a final fit on all rows."""
    return oof(df, cols, label, fold, folds, lambda x: LogisticRegression(featuresCol=x, labelCol=label, regParam=reg, maxIter=50), test=test, refit=refit)


def oof_gbt(df: DataFrame, cols: Sequence[str], label: str, fold: str, folds: int, trees: int = 10, depth: int = 3, seeds: Sequence[int] = (0,), test: DataFrame | None = None) -> DataFrame:
    """Boosted trees, averaged over seeds."""
    make = lambda x: [GBTClassifier(featuresCol=x, labelCol=label, maxIter=trees, maxDepth=depth, subsamplingRate=0.8, seed=s) for s in seeds]
    return oof(df, cols, label, fold, folds, make, scale=False, test=test)


def oof_one_vs_rest(df: DataFrame, cols: Sequence[str], label: str, classes: Sequence, fold: str, folds: int, trees: int = 10, depth: int = 3, seeds: Sequence[int] = (0,)) -> DataFrame:
    """Boosted trees per class against the rest, out of fold; ``score_<class>`` sum to one in each row."""
    out = df
    for c in classes:
        one = oof_gbt(out.withColumn("_one", (F.col(label) == c).cast("int")), cols, "_one", fold, folds, trees, depth, seeds)
        out = one.withColumnRenamed("score", f"score_{c}").drop("_one")
    total = F.greatest(sum((F.col(f"score_{c}") for c in classes[1:]), F.col(f"score_{classes[0]}")), F.lit(1e-12))
    return out.withColumns({f"score_{c}": F.col(f"score_{c}") / total for c in classes})


def oof_by_segment(df: DataFrame, cols: Sequence[str], label: str, fold: str, folds: int, segment: str, values: Sequence, reg: float = 0.0) -> DataFrame:
    """A separate model per listed segment and one for all other rows."""
    rest = df.where(~F.coalesce(F.col(segment).isin(*values), F.lit(False)))
    out = None if rest.isEmpty() else oof_logistic(rest, cols, label, fold, folds, reg)
    for v in values:
        one = oof_logistic(df.where(F.col(segment) == v), cols, label, fold, folds, reg)
        out = one if out is None else out.unionByName(one)
    return out


def oof_ridge(df: DataFrame, cols: Sequence[str], label: str, fold: str, folds: int, alpha: float = 1.0) -> DataFrame:
    """Ridge by normal equations; ``alpha`` is the penalty on the sum of squares, so it is divided by the row count."""
    n = df.count() * (folds - 1) / folds
    return oof(
        df, cols, label, fold, folds,
        lambda x: LinearRegression(featuresCol=x, labelCol=label, regParam=alpha / n, elasticNetParam=0.0, solver="normal", standardization=False), regression=True,
    )


def long_labels(df: DataFrame, id_col: str, labels: Sequence[str], cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One row per id and label, with label indicators and label x feature interactions."""
    arr = F.array(*[F.struct(F.lit(lb).alias("label"), F.col(lb).alias("y")) for lb in labels])
    long = df.select(id_col, *cols, F.explode(arr).alias("p")).select(id_col, *cols, "p.*")
    extra = {f"is_{lb}": (F.col("label") == lb).cast("double") for lb in labels[1:]}
    extra |= {f"{lb}_x_{c}": F.when(F.col("label") == lb, F.col(c).cast("double")).otherwise(0.0) for lb in labels[1:] for c in cols}
    return long.withColumns(extra), [*cols, *extra]


def long_label_model(df: DataFrame, id_col: str, labels: Sequence[str], cols: Sequence[str], folds: int, reg: float = 0.001) -> DataFrame:
    """One logistic model over user x label rows, scored out of fold (folds by user), then calibrated per label."""
    long, feats = long_labels(df, id_col, labels, cols)
    long = long.withColumn("_fold", F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int"))
    scored = oof_logistic(long, feats, "y", "_fold", folds, reg).select(id_col, "label", "y", "score")
    cal = scored.groupBy("label").agg(F.regr_slope("y", "score").alias("_s"), F.regr_intercept("y", "score").alias("_i"))
    out = scored.join(F.broadcast(cal), "label")  # one row per label
    return out.withColumn("calibrated", F.least(F.greatest(F.col("_s") * F.col("score") + F.col("_i"), F.lit(0.0)), F.lit(1.0))).drop("_s", "_i")


def param_grid(df: DataFrame, cols: Sequence[str], label: str, fold: str, folds: int, grid: Sequence[dict]) -> DataFrame:
    """Mean out-of-fold AUC of each setting and the best one. The table is written once for all settings and folds."""
    df = stored(df.select(*dict.fromkeys([*cols, label, fold])))
    rows = []
    for g in grid:
        scored = oof(df, cols, label, fold, folds, lambda x, g=g: LogisticRegression(featuresCol=x, labelCol=label, maxIter=30, **g))
        per = auc(scored, [fold], label, "score").agg(F.avg("auc")).first()[0]
        rows.append((str(sorted(g.items())), float(per)))
    best = max(rows, key=lambda r: r[1])[0]
    return df.sparkSession.createDataFrame([(n, a, int(n == best)) for n, a in rows], "setting string, mean_auc double, best int")


def feature_views(df: DataFrame, views: dict[str, Sequence[str]], label: str, fold: str, folds: int, id_col: str) -> DataFrame:
    """The same model on nested column sets, one out-of-fold column per view."""
    out = None
    for name, cols in views.items():
        one = oof_gbt(df.select(id_col, fold, label, *cols), cols, label, fold, folds).select(id_col, F.col("score").alias(name))
        out = one if out is None else out.join(one, id_col)
    return out


def _forest_importance(ready: DataFrame, label: str, seed: int, trees: int) -> list[float]:
    """Impurity importances of a forest on rows with assembled features ``_v``."""
    m = RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=trees, maxDepth=5, seed=seed).fit(ready)
    return [float(x) for x in m.featureImportances.toArray()]


def _ready(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    rows = _numeric(df, cols).withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=prepared(cols, False)).fit(rows).transform(rows)


def tree_importance(df: DataFrame, cols: Sequence[str], label: str, seed: int = 0, trees: int = 10) -> list[float]:
    return _forest_importance(_ready(df, cols, label), label, seed, trees)


def shuffled(df: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """The label column in a reproducible random order: positions of two hashed orders are matched."""
    from quern.operators.folds import dealt

    a = dealt(df, [], [id_col], seed, "_a")
    b = dealt(df.select(id_col, F.col(label).alias("_y")), [], [id_col], seed + 7919, "_a").select("_a", "_y")
    return a.join(b, "_a").drop("_a", label).withColumnRenamed("_y", label)


def null_importance(df: DataFrame, cols: Sequence[str], label: str, id_col: str, rounds: int = 6, share: float = 0.9, fits: int = 3, trees: int = 10) -> DataFrame:
    """Keep a feature if its importance, the mean of ``fits`` forests, beats the given percentile of its importances on
    ``rounds`` shuffled labels.

    A fit reads its rows several times, so the table and each shuffled copy are written once. Features are filled and
    assembled once for all fits: only labels are shuffled.
    """
    df = stored(df.select(*dict.fromkeys([id_col, label, *cols])))
    ready = stored(_ready(df, cols, label).select(id_col, label, "_v"))
    each = [_forest_importance(ready, label, s, trees) for s in range(fits)]
    real = [sum(x) / fits for x in zip(*each)]
    null = [_forest_importance(stored(shuffled(ready, id_col, label, s)), label, s, trees) for s in range(rounds)]
    rows = [(c, real[i], float(r[i])) for r in null for i, c in enumerate(cols)]
    t = df.sparkSession.createDataFrame(rows, "feature string, importance double, null_importance double")
    out = t.groupBy("feature", "importance").agg(F.percentile("null_importance", F.lit(share)).alias("threshold"))
    return out.withColumn("keep", (F.col("importance") > F.col("threshold")).cast("int"))


def feature_budget(importance: DataFrame, n: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def variance_and_kbest(df: DataFrame, cols: Sequence[str], target: str, k: int) -> DataFrame:
    """Drop constant columns, keep the k with the most mutual information."""
    from quern.operators.profile import mutual_info

    spread = df.agg(*[F.coalesce(F.var_pop(c), F.lit(0.0)).alias(c) for c in cols]).first()
    live = [c for c in cols if spread[c] > 0]
    return mutual_info(df, live, target).orderBy(F.desc("mi"), "feature").limit(k)


def importance_views(df: DataFrame, cols: Sequence[str], label: str, id_col: str, seed: int = 0) -> DataFrame:
    """Impurity importance, and the AUC lost when one column is shuffled, averaged after scaling to sum 1."""
    data = stored(_numeric(df.select(id_col, label, *cols), cols))
    m = Pipeline(stages=[*prepared(cols, False), RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=10, maxDepth=5, seed=seed)]).fit(
        data.withColumn(label, F.col(label).cast("double"))
    )
    impurity = [float(x) for x in m.stages[-1].featureImportances.toArray()]
    value = lambda d: auc(m.transform(d).withColumn("score", vector_to_array("probability")[1]), [], label, "score").first()["auc"]
    base = value(data)
    loss = [max(base - value(shuffled(data.select(id_col, *cols, label), id_col, c, seed)), 0.0) for c in cols]
    total = sum(loss) or 1.0
    rows = [(c, impurity[i], loss[i], (impurity[i] + loss[i] / total) / 2) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, impurity double, auc_loss double, importance double")


def baseline_ladder(df: DataFrame, cols: Sequence[str], single: str, label: str, fold: str, folds: int) -> DataFrame:
    """Balanced accuracy of the majority class, a one-feature tree and the reference model, out of fold."""
    df = stored(df.select(*dict.fromkeys([*cols, single, label, fold])))
    hard = lambda d: d.withColumn("_p", (F.col("score") >= 0.5).cast("int"))
    recall = lambda d: d.groupBy(label).agg(F.avg((F.col("_p") == F.col(label)).cast("int")).alias("r")).agg(F.avg("r")).first()[0]
    # the most frequent class of the other folds, from one row per fold and class
    counts = {(r[fold], r[label]): r["count"] for r in df.groupBy(fold, label).count().collect()}
    classes = sorted({y for _, y in counts})
    other = lambda f: max(classes, key=lambda y: sum(n for (g, z), n in counts.items() if g != f and z == y))
    top = F.create_map(*[F.lit(x) for f in sorted({g for g, _ in counts}) for x in (f, other(f))])[F.col(fold)]
    tree = oof(df, [single], label, fold, folds, lambda x: DecisionTreeClassifier(featuresCol=x, labelCol=label, maxDepth=3, seed=0), scale=False)
    full = oof_gbt(df, cols, label, fold, folds)
    rows = [("majority", recall(df.withColumn("_p", top))), ("one_feature", recall(hard(tree))), ("reference", recall(hard(full)))]
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in rows], "model string, balanced_accuracy double")


def stack_ridge(df: DataFrame, models: Sequence[str], y: str, fold: str, folds: int, alpha: float = 1.0) -> DataFrame:
    return oof_ridge(df, models, y, fold, folds, alpha)


def stack_logistic(df: DataFrame, models: Sequence[str], y: str, fold: str, folds: int, reg: float = 0.01, mean_share: float = 0.25) -> DataFrame:
    """Logistic regression on logits, mixed with the plain mean."""
    eps = 1e-6
    clip = lambda m: F.least(F.greatest(F.col(m), F.lit(eps)), F.lit(1 - eps))
    z = df.withColumns({f"z_{m}": F.ln(clip(m) / (1 - clip(m))) for m in models})
    out = oof_logistic(z, [f"z_{m}" for m in models], y, fold, folds, reg)
    mean: Column = sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)
    return out.withColumn("conservative", F.lit(1 - mean_share) * F.col("score") + F.lit(mean_share) * mean).drop(*[f"z_{m}" for m in models])


def ablation(df: DataFrame, families: dict[str, Sequence[str]], y: str, fold: str, folds: int, reg: float = 0.01) -> DataFrame:
    """Refit without each family: AUC difference to the full set and the number of folds that got better."""
    every = [c for f in families.values() for c in f]
    score = lambda cols: auc(oof_logistic(df, cols, y, fold, folds, reg), [fold], y, "score").select(fold, "auc")
    full = score(every).withColumnRenamed("auc", "_full").persist()
    out = None
    for name, cols in families.items():
        d = score([c for c in every if c not in cols]).join(full, fold).withColumn("_d", F.col("auc") - F.col("_full"))
        one = d.agg(F.avg("_d").alias("auc_change"), F.sum((F.col("_d") > 0).cast("int")).alias("folds_better")).select(F.lit(name).alias("family"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def subsample(df: DataFrame, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """Reproducible share of rows by hash."""
    return df.where(uniform(id_col, F.lit(seed)) < share)


def gbt_regressor(x: str, label: str, trees: int = 10, depth: int = 3, seed: int = 0) -> GBTRegressor:
    return GBTRegressor(featuresCol=x, labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
