"""Encoder and fold queries."""

from pyspark.sql import functions as F

from quern.operators import encode as E
from quern.operators import folds as K
from quern.plans import bind as B
from quern.plans.profile import FLAGS, flags
from quern.registry import query

S = B.SURVEY
Y = "CAST(target = 'F' AS INT)"


def sets(t):
    s = B.survey(t).withColumn("y", (F.col("target") == "F").cast("int"))
    return s, s.where("id % 5 <> 0"), s.where("id % 5 = 0")


def hashed(order: str, seed: int, extra: str = "") -> str:
    return f"md5(CAST({order} AS VARCHAR) || '|{seed}')"


@query("one_hot", f"WITH {S} SELECT id, {', '.join(f'''coalesce(CAST(seg = '{v}' AS INT), 0) AS seg_{v}''' for v in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM survey")
def _(t):
    _s, train, _ = sets(t)
    return E.one_hot(B.survey(t).select("id", "seg"), "seg", E.known_levels(train, "seg")).drop("seg")


@query("label_encode_union", f"WITH {S}, c AS (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS code FROM (SELECT DISTINCT seg FROM survey WHERE seg IS NOT NULL)) SELECT id, code FROM survey LEFT JOIN c USING (seg)")
def _(t):
    a, b = E.label_encode_union(*B.splits(t), "seg", "code")
    return a.unionByName(b).select("id", "code")


@query("ordinal_encode_unknown", f"WITH {S}, c AS (SELECT cust, row_number() OVER (ORDER BY CAST(cust AS VARCHAR)) - 1 AS code FROM (SELECT DISTINCT cust FROM train)) SELECT id, coalesce(code, -1) AS code FROM survey LEFT JOIN c USING (cust)")
def _(t):
    s, train, _ = sets(t)
    s, train = (d.withColumn("cust", F.col("cust").cast("string")) for d in (s, train))
    return E.ordinal_encode(train, s, "cust", "code").select("id", "code")


@query("factorize", f"WITH {S}, c AS (SELECT cust, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT cust, min(id) AS p FROM train GROUP BY 1)) SELECT id, coalesce(code, -1) AS code FROM survey LEFT JOIN c USING (cust)")
def _(t):
    s, train, _ = sets(t)
    return E.factorize(train, s, "cust", "id", "code").select("id", "code")


@query("count_freq_encode", f"WITH {S} SELECT id, n AS seg_count, n / (SELECT count(*) FROM survey) AS seg_freq FROM survey LEFT JOIN (SELECT seg AS sg, count(*) AS n FROM survey GROUP BY 1) c ON seg IS NOT DISTINCT FROM sg", f="seg_freq")
def _(t):
    s, a, b = sets(t)
    return E.count_freq([a, b], s, "seg").select("id", "seg_count", "seg_freq")


@query(
    "target_encode_smooth",
    f"WITH {S}, c AS (SELECT cust, count(*) AS n, sum({Y}) AS s FROM train GROUP BY 1) SELECT id, (coalesce(s, 0) + 10.0::DOUBLE * (SELECT avg({Y}) FROM train)) / (coalesce(n, 0) + 10.0) AS cust_te, coalesce(n, 0) AS cust_n FROM survey LEFT JOIN c USING (cust)",
    f="cust_te",
)
def _(t):
    s, train, _ = sets(t)
    return E.target_encode(train, s, "cust", "y").select("id", "cust_te", "cust_n")


@query(
    "target_encode_oof",
    f"""WITH {S}, tr AS (SELECT *, {Y} AS y, id % 4 AS fold FROM train), te AS (SELECT * FROM test),
f(fold) AS (VALUES (0), (1), (2), (3)),
g AS (SELECT f.fold, avg(y) AS g FROM f, tr WHERE tr.fold <> f.fold GROUP BY 1),
c AS (SELECT f.fold, cust, count(*) AS n, sum(y) AS s FROM f, tr WHERE tr.fold <> f.fold GROUP BY 1, 2)
SELECT tr.id, (coalesce(s, 0) + 10.0::DOUBLE * g) / (coalesce(n, 0) + 10) AS cust_te FROM tr JOIN g USING (fold) LEFT JOIN c ON c.fold = tr.fold AND c.cust = tr.cust
UNION ALL SELECT id, avg((coalesce(s, 0) + 10.0::DOUBLE * g) / (coalesce(n, 0) + 10)) FROM (SELECT te.id, s, g, n FROM te CROSS JOIN g LEFT JOIN c ON c.fold = g.fold AND c.cust = te.cust) GROUP BY 1""",
    f="cust_te",
)
def _(t):
    _s, train, test = sets(t)
    train = train.withColumn("fold", (F.col("id") % 4).cast("int"))
    a = E.target_encode_oof(train, "cust", "y", "fold").select("id", "cust_te")
    return a.unionAll(E.target_encode_oof_apply(train, test, "cust", "y", "fold", 4).select("id", "cust_te"))


@query(
    "target_encode_multiclass",
    f"WITH {S}, c AS (SELECT seg AS sg, count(*) AS n, {', '.join(f'''count(*) FILTER (target = '{k}') AS c{k}''' for k in B.CLASSES)} FROM train GROUP BY 1) SELECT id, "
    + ", ".join(f"(coalesce(c{k}, 0) + 30.0::DOUBLE * (SELECT avg(CAST(target = '{k}' AS INT)) FROM train)) / (coalesce(n, 0) + 30) AS seg_p_{k}" for k in B.CLASSES)
    + ", coalesce(n, 0) / (SELECT count(*) FROM train) AS seg_freq FROM survey LEFT JOIN c ON seg IS NOT DISTINCT FROM sg",
    f="seg_p_F seg_p_O seg_p_P seg_freq",
)
def _(t):
    s, train, _ = sets(t)
    return E.target_encode_multiclass(train, s, "seg", "target", B.CLASSES).select("id", "seg_p_F", "seg_p_O", "seg_p_P", "seg_freq")


@query("group_stats", f"WITH {S}, g AS (SELECT cust, avg(total) AS m, stddev_samp(total) AS s FROM survey GROUP BY 1) SELECT id, m AS total_mean, s AS total_std, round(total - m, 6) AS total_diff FROM survey JOIN g USING (cust)", f="total_mean total_std total_diff")
def _(t):
    s, a, b = sets(t)
    return E.group_stats([a, b], s, "cust", "total").select("id", "total_mean", "total_std", F.round("total_diff", 6).alias("total_diff"))


@query(
    "group_profile_residual",
    f"""WITH {S}, a AS (SELECT * FROM survey WHERE id % 3 > 0 AND cust % 7 > 0), g AS (SELECT cust, count(*) AS n, avg(total) AS t, avg(day) AS d FROM a GROUP BY 1),
x AS (SELECT id, total, day, coalesce(n, 0) AS cust_count, coalesce(t, (SELECT quantile_cont(total, 0.5) FROM a)) AS total_gm, coalesce(d, (SELECT quantile_cont(day::DOUBLE, 0.5) FROM a)) AS day_gm FROM survey LEFT JOIN g USING (cust))
SELECT id, cust_count, total_gm, day_gm, round(total - total_gm, 6) AS total_res, round(day - day_gm, 6) AS day_res FROM x""",
    f="total_gm day_gm total_res day_res",
)
def _(t):
    s = B.survey(t)
    out = E.group_profile(s.where("id % 3 > 0 AND cust % 7 > 0"), s, "cust", ["total", "day"])
    return out.select("id", "cust_count", "total_gm", "day_gm", F.round("total_res", 6).alias("total_res"), F.round("day_res", 6).alias("day_res"))


@query(
    "binned_lookup_rule",
    f"""WITH {S}, b AS (SELECT *, floor(total / 50000) AS tb, day // 100 AS db FROM survey), tr AS (SELECT * FROM b WHERE id % 5 <> 0),
c AS (SELECT tb, db, target, count(*) AS n FROM tr GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY tb, db ORDER BY n DESC, target) AS rn, sum(n) OVER (PARTITION BY tb, db) AS rows_ FROM c)
SELECT id, coalesce(r.target, (SELECT target FROM tr GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1)) AS pred FROM b LEFT JOIN r ON b.tb IS NOT DISTINCT FROM r.tb AND b.db = r.db AND rn = 1 AND rows_ >= 50""",
)
def _(t):
    s = B.survey(t).withColumns({"tb": F.floor(F.col("total") / 50000), "db": F.floor(F.col("day") / 100)})
    return E.binned_lookup(s.where("id % 5 <> 0"), s, ["tb", "db"], "target", "pred", 50).select("id", "pred")


@query(
    "class_centroid_distance",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM e WHERE vec_id % 5 <> 0 GROUP BY 1), z AS (SELECT vec_id, label, i, (v - m) / s AS z FROM e JOIN st USING (i)),
c AS (SELECT label AS k, i, avg(z) AS c FROM z WHERE vec_id % 5 <> 0 GROUP BY 1, 2), d AS (SELECT vec_id, k, sqrt(sum(pow(z - c, 2))) AS d FROM z JOIN c USING (i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS rn, lead(d) OVER (PARTITION BY vec_id ORDER BY d, k) AS d2 FROM d)
SELECT vec_id, k AS nearest, round(d, 9) AS nearest_dist, round(d2 - d, 9) AS margin FROM r WHERE rn = 1""",
    f="nearest_dist margin",
)
def _(t):
    e = t.embeddings
    out = E.centroid_distance(e.where("vec_id % 5 <> 0"), e, "embedding", "label", 64)
    return out.select("vec_id", "nearest", F.round("nearest_dist", 9).alias("nearest_dist"), F.round("margin", 9).alias("margin"))


def _fold_sql(part: str, k: int, seed: int, src: str, cols: str, idc: str = "id") -> str:
    return f"SELECT {cols}, CAST((row_number() OVER ({part} ORDER BY {hashed(idc, seed)}, {idc}) - 1) % {k} AS BIGINT) AS fold FROM {src}"


@query("fold_kfold", f"WITH {S} {_fold_sql('', 5, 7, 'survey', 'id')}")
def _(t):
    return K.kfold(B.survey(t).select("id"), "id", 5, 7)


@query("fold_stratified", f"WITH {S} {_fold_sql('PARTITION BY target, prio', 5, 7, 'survey', 'id, target, prio')}")
def _(t):
    return K.stratified(B.survey(t).select("id", "target", "prio"), "id", ["target", "prio"], 5, 7)


@query("fold_group", f"WITH {S}, g AS (SELECT DISTINCT cust FROM survey), f AS ({_fold_sql('', 5, 7, 'g', 'cust', 'cust')}) SELECT id, cust, fold FROM survey JOIN f USING (cust)")
def _(t):
    return K.grouped(B.survey(t).select("id", "cust"), "cust", 5, 7)


@query(
    "fold_stratified_group",
    f"""WITH {S}, c AS (SELECT cust, count(*) AS n, count(*) FILTER (target = 'F') AS f, count(*) FILTER (target = 'O') AS o, count(*) FILTER (target = 'P') AS p FROM survey GROUP BY 1),
m AS (SELECT *, CASE WHEN f >= o AND f >= p THEN 0 WHEN o >= p THEN 1 ELSE 2 END AS main FROM c), r AS (SELECT cust, (row_number() OVER (PARTITION BY main ORDER BY n DESC, {hashed('cust', 7)}) - 1) % 10 AS p FROM m)
SELECT id, cust, target, CASE WHEN p < 5 THEN p ELSE 9 - p END AS fold FROM survey JOIN r USING (cust)""",
)
def _(t):
    return K.stratified_group(B.survey(t).select("id", "cust", "target"), "cust", "target", B.CLASSES, 5, 7)


ML = ("big", "late", "rich")


@query(
    "fold_multilabel",
    f"WITH {FLAGS}, c AS (SELECT *, concat({', '.join(ML)}) AS combo FROM flags), s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY combo) >= 5 THEN combo ELSE 'rare' END AS st FROM c) {_fold_sql('PARTITION BY st', 5, 3, 's', 'id')}",
)
def _(t):
    return K.multilabel(flags(t), "id", ML, 5, 3).select("id", "fold")


@query(
    "split_time_forward",
    "WITH s AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS slice FROM orders), v(valid_slice) AS (VALUES ('1996'), ('1997'), ('1998'), ('1999'), ('2000'), ('2001')) SELECT valid_slice, CASE WHEN slice < valid_slice THEN 'train' ELSE 'valid' END AS role, count(*) AS n FROM s, v WHERE slice <= valid_slice GROUP BY 1, 2",
)
def _(t):
    s = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("slice"))
    return K.time_forward(s, "slice", [str(y) for y in range(1995, 2002)]).groupBy("valid_slice", "role").agg(F.count(F.lit(1)).alias("n"))


@query("split_holdout_stratified", f"WITH {S}, f AS ({_fold_sql('PARTITION BY target', 5, 11, 'survey', 'id, target')}) SELECT id, target, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS part FROM f")
def _(t):
    return K.holdout(B.survey(t).select("id", "target"), "id", ["target"], 5, 11)


@query(
    "split_nested",
    f"""WITH g AS (SELECT DISTINCT user_id FROM events), o AS ({_fold_sql('', 4, 5, 'g', 'user_id', 'user_id')}), r AS (SELECT user_id, fold AS own, outer_fold FROM o, (VALUES (0), (1), (2), (3)) v(outer_fold)),
tr AS (SELECT user_id, outer_fold, (row_number() OVER (PARTITION BY outer_fold ORDER BY {hashed('user_id', 6)}, user_id) - 1) % 3 AS inner_fold FROM r WHERE own <> outer_fold),
a AS (SELECT user_id, outer_fold, inner_fold FROM tr UNION ALL SELECT user_id, outer_fold, NULL FROM r WHERE own = outer_fold),
sc AS (SELECT outer_fold, inner_fold, setting, sum(pow(value - setting, 2)) AS sse, count(*) AS n FROM a JOIN events USING (user_id), (VALUES (30.0::DOUBLE), (50.0), (60.0)) s(setting) GROUP BY 1, 2, 3),
i AS (SELECT outer_fold, setting, sqrt(sum(sse) / sum(n)) AS inner_rmse FROM sc WHERE inner_fold IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY inner_rmse, setting) AS rn FROM i)
SELECT b.outer_fold, b.setting, inner_rmse, sqrt(sse / n) AS outer_rmse FROM b JOIN sc ON sc.outer_fold = b.outer_fold AND sc.setting = b.setting AND sc.inner_fold IS NULL WHERE rn = 1""",
    f="inner_rmse outer_rmse",
)
def _(t):
    roles = K.nested(t.events, "user_id", 4, 3, 5)
    rows = roles.join(t.events.select("user_id", "value"), "user_id")
    rows = rows.withColumn("setting", F.explode(F.array(*[F.lit(x) for x in (30.0, 50.0, 60.0)])))
    scores = rows.groupBy("outer_fold", "inner_fold", "setting").agg(F.sum(F.pow(F.col("value") - F.col("setting"), 2)).alias("sse"), F.count(F.lit(1)).alias("n"))
    return K.nested_choice(scores)


@query("sample_stratified", f"WITH {S}, f AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY {hashed('id', 13)}, id) AS rn FROM survey) SELECT id, target FROM f WHERE rn <= 700")
def _(t):
    return K.stratified_sample(B.survey(t).select("id", "target"), "id", ["target"], 700, 13)


@query("sample_weights_balanced", f"WITH {S}, c AS (SELECT prio, count(*) AS n FROM survey GROUP BY 1) SELECT prio, n, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c", f="weight")
def _(t):
    return K.balanced_weights(B.survey(t), "prio")


@query(
    "train_append_external",
    f"WITH {S}, f AS ({_fold_sql('', 4, 9, 'survey', 'id')}), x AS (SELECT id, fold, CAST(id % 6 = 0 AS INT) AS ext FROM f) SELECT v AS valid_fold, CASE WHEN ext = 1 THEN 'train_external' WHEN fold = v THEN 'valid' ELSE 'train' END AS role, count(*) AS n FROM x, (VALUES (0), (1), (2), (3)) t(v) GROUP BY 1, 2",
)
def _(t):
    x = K.kfold(B.survey(t).select("id"), "id", 4, 9).withColumn("is_external", (F.col("id") % 6 == 0).cast("int"))
    return K.fold_roles(x, 4)
