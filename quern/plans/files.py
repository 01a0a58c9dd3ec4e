"""Source and sink queries: tables are written in the reference layouts and read back."""

from pyspark.sql import functions as F

from quern.registry import query
from quern.sources import files as S


@query("scan_csv", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, '2000-01-0' || (1 + c_custkey % 9) AS day FROM customer UNION ALL SELECT s_suppkey, 'fé' || s_name, s_acctbal, NULL FROM supplier")
def _(t):
    a, b = S.work_folder(t.spark, "csv"), S.work_folder(t.spark, "latin")
    c = t.customer.select("c_custkey", "c_name", "c_acctbal", F.concat(F.lit("0"), 1 + F.col("c_custkey") % 9, F.lit("/01/2000")).alias("day"))
    c.write.option("header", True).csv(a)
    t.supplier.select("s_suppkey", F.concat(F.lit("fé"), "s_name"), "s_acctbal").write.option("encoding", "ISO-8859-1").csv(b)
    x = S.scan_csv(t.spark, a, "id long, name string, bal double, day date", date_format="dd/MM/yyyy").withColumn("day", F.col("day").cast("string"))
    y = S.scan_csv(t.spark, b, "a long, b string, c double", header=False, encoding="ISO-8859-1", names=["id", "name", "bal"])
    return x.unionByName(y, allowMissingColumns=True)


@query("scan_parquet_pruned", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def _(t):
    return S.scan_parquet(t.spark, t.path("lineitem"), ["l_orderkey", "l_extendedprice"])


@query("scan_multi_split", "SELECT event_id, value, 'split_' || (user_id % 4) AS split FROM events")
def _(t):
    root = S.work_folder(t.spark, "splits")
    e = t.events.select("event_id", "value", "user_id")
    for i in range(4):
        e.where(F.col("user_id") % 4 == i).drop("user_id").write.option("header", True).csv(f"{root}/split_{i}/lightcurves.csv")
    return S.scan_multi_split(t.spark, root, "lightcurves.csv", "event_id long, value double")


@query(
    "scan_entity_files",
    "WITH a AS (SELECT 'r' || n_regionkey AS entity, count(*) AS rows_a FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), b AS (SELECT 'r' || n_regionkey AS entity, count(*) AS rows_b FROM nation WHERE n_regionkey < 4 GROUP BY 1) SELECT entity, rows_a, rows_b, CAST(rows_a IS NOT NULL AND rows_b IS NOT NULL AS INT) AS complete FROM a FULL JOIN b USING (entity)",
)
def _(t):
    root = S.work_folder(t.spark, "wells")
    n, p = t.nation, t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    for i in range(5):
        p.where(F.col("n_regionkey") == i).select("s_suppkey", "s_acctbal").write.option("header", True).csv(f"{root}/r{i}__path")
        if i < 4:
            n.where(F.col("n_regionkey") == i).select("n_nationkey", "n_name").write.option("header", True).csv(f"{root}/r{i}__reference")
    a = S.scan_entity_files(t.spark, root, "path", "s_suppkey long, s_acctbal double")
    b = S.scan_entity_files(t.spark, root, "reference", "n_nationkey int, n_name string")
    return S.entity_inventory(a, b)


@query(
    "scan_prediction_pool",
    """WITH m("group", model, score) AS (VALUES ('trees', 'a_0.951', 0.951::DOUBLE), ('trees', 'b_0.962', 0.962), ('nets', 'c_0.940', 0.940)) SELECT m.*, (SELECT count(*) FROM orders) AS n, (SELECT count(DISTINCT o_orderkey) FROM orders) AS ids FROM m""",
)
def _(t):
    root = S.work_folder(t.spark, "pool")
    o = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("value"))
    for folder, name in (("trees", "a_0.951"), ("trees", "b_0.962"), ("nets", "c_0.940"), ("nets", "notes")):
        o.write.option("header", True).csv(f"{root}/{folder}/{name}")
    rows = S.scan_pool(t.spark, root)
    return rows.groupBy("group", "model", "score").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("sink_parquet_stage", "SELECT o_orderstatus AS slice, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("slice"))
    return S.sink_stage(df, S.work_folder(t.spark, "stage"), ["slice"]).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query("sink_submission", "SELECT o_orderkey AS id, o_totalprice / 500000 AS prediction FROM orders", f="prediction")
def _(t):
    p = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("prediction"))
    sample = t.orders.select(F.col("o_orderkey").alias("id"), (-F.col("o_orderkey")).alias("pos"))
    return S.sink_submission(p, sample, "id", "prediction", "pos", S.work_folder(t.spark, "submission"))


@query("stage_cache", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1", f="total")
def _(t):
    path = S.work_folder(t.spark, "cache")
    build = lambda: t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    key = S.fingerprint([t.orders], "orders per customer")
    S.stage_cache(t.spark, path, build, key)
    return S.stage_cache(t.spark, path, build, key)


@query("load_optional_external", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg, 0 AS is_external FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 1 FROM supplier WHERE s_acctbal >= 0")
def _(t):
    main = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    ext = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("other"))
    return S.load_optional_external(main, ext, F.col("bal") < 0)
