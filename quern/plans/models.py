"""Model queries: small Spark ML jobs over the whole tables."""

from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.operators import models as L
from quern.plans import bind as B
from quern.plans import pool as P
from quern.plans.profile import flags
from quern.registry import query

NUM = ["total", "acct", "day", "nation"]


def rows(t):
    s = B.survey(t)
    y = ((F.col("day") + F.col("acct") / 10 + F.col("id") % 500) > 1700).cast("int")
    return s.select("id", "total", "acct", "day", F.col("nation").cast("double").alias("nation"), F.coalesce(y, F.lit(0)).alias("y"), (F.col("id") % 3).cast("int").alias("fold"))


def shown(df):
    """AUC per fold of out-of-fold scores."""
    return M.auc(df, ["fold"], "y", "score")


@query("oof_logistic")
def _(t):
    return shown(L.oof_logistic(rows(t), NUM, "y", "fold", 3))


@query("oof_gbt")
def _(t):
    r = rows(t)
    return shown(L.oof_gbt(r.where("id % 10 > 0"), NUM, "y", "fold", 3, trees=4, test=r.where("id % 10 = 0")))


@query("oof_by_segment")
def _(t):
    r = rows(t).withColumn("seg", (F.col("day") > 1200).cast("int"))
    return M.auc(L.oof_by_segment(r, NUM, "y", "fold", 3, "seg", [0, 1]), ["seg"], "y", "score")


@query("oof_ridge_closed_form")
def _(t):
    return M.error_summary(L.oof_ridge(rows(t), NUM, "y", "fold", 3), ["fold"], "y", "score")


@query("long_label_model")
def _(t):
    x = flags(t).withColumn("day", F.col("id") % 100)
    return M.auc(L.long_label_model(x, "id", ["big", "late", "rich"], ["day", "o_totalprice"], 3), ["label"], "y", "calibrated")


@query("param_grid_cv")
def _(t):
    return L.param_grid(rows(t), NUM, "y", "fold", 3, [{"regParam": 0.0}, {"regParam": 0.1}])


@query("feature_views")
def _(t):
    v = L.feature_views(rows(t), {"all": NUM, "small": ["day", "acct"]}, "y", "fold", 3, "id")
    return v.agg(F.corr("all", "small").alias("corr"), F.count(F.lit(1)).alias("n"))


@query("null_importance_select")
def _(t):
    return L.null_importance(rows(t), NUM, "y", "id")


@query("feature_budget")
def _(t):
    imp = L.tree_importance(rows(t), NUM, "y")
    return L.feature_budget(t.spark.createDataFrame(list(zip(NUM, imp)), "feature string, importance double"), 2)


@query("variance_and_kbest")
def _(t):
    return L.variance_and_kbest(rows(t).withColumn("one", F.lit(1.0)), [*NUM, "one"], "y", 3)


@query("importance_views")
def _(t):
    return L.importance_views(rows(t), NUM, "y", "id")


@query("baseline_ladder")
def _(t):
    return L.baseline_ladder(rows(t), NUM, "day", "y", "fold", 3)


def _stack(t):
    return P.pred(t).withColumn("fold", (F.col("id") % 3).cast("int"))


@query("stack_ridge")
def _(t):
    return shown(L.stack_ridge(_stack(t), list(P.MODELS), "y", "fold", 3))


@query("stack_logistic")
def _(t):
    return shown(L.stack_logistic(_stack(t), list(P.MODELS), "y", "fold", 3).withColumn("score", F.col("conservative")))


@query("ablation_by_family")
def _(t):
    return L.ablation(_stack(t), {"first": ["m1", "m4"], "second": ["m2"], "third": ["m3"]}, "y", "fold", 3)
