"""Join and set queries."""

from pyspark.sql import functions as F

from quern.operators import joins as J
from quern.plans import bind as B
from quern.registry import query


@query("join_left_m1", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey")
def _(t):
    p = t.part.where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return J.left_m1(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), p, "l_partkey")


@query("join_inner", f"WITH {B.LINES} SELECT customer_id, order_id, product_id, d, paid FROM lines")
def _(t):
    return B.lines(t).select("customer_id", "order_id", "product_id", "d", "paid")


@query(
    "join_seen_before",
    f"WITH {B.LINES}, r AS (SELECT customer_id, min(d) AS r FROM lines GROUP BY 1), x AS (SELECT customer_id, brand, min(d) AS lo, max(d) AS hi FROM lines GROUP BY 1, 2) SELECT customer_id, brand, CAST(hi > r AS INT) AS seen FROM x JOIN r USING (customer_id) WHERE lo = r",
)
def _(t):
    return J.seen_before(B.lines(t), "customer_id", "brand", "d")


@query(
    "join_anti_new",
    r"WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM documents), e AS (SELECT k, min(doc_id) AS doc_id FROM k WHERE doc_id % 3 = 0 AND k <> '' GROUP BY 1) SELECT doc_id FROM e WHERE k NOT IN (SELECT k FROM k WHERE doc_id % 3 > 0)",
)
def _(t):
    from quern.operators.textops import clean

    d = t.documents
    return J.anti_new(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 > 0"), clean(F.lower("text")), "doc_id").select("doc_id")


@query("union_by_name", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg, 'customer' AS part FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return J.union_by_name({"customer": c, "supplier": t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"))})


@query("split_row_key", "SELECT l_orderkey, l_linenumber, 'well_' || l_orderkey AS entity, CAST(l_linenumber AS BIGINT) AS row_index FROM lineitem")
def _(t):
    k = t.lineitem.select("l_orderkey", "l_linenumber", F.concat_ws("_", F.lit("well"), "l_orderkey", "l_linenumber").alias("key"))
    return J.split_row_key(k, "key").drop("key")


A, BB = "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 250000", "SELECT o_custkey AS id FROM orders WHERE o_orderdate >= DATE '1999-01-01'"


def _ab(t):
    o = t.orders
    return o.where("o_totalprice > 250000").select(F.col("o_custkey").alias("id")), o.where("o_orderdate >= DATE'1999-01-01'").select(F.col("o_custkey").alias("id"))


@query("set_diff", f"({A}) EXCEPT ({BB})")
def _(t):
    return J.set_diff(*_ab(t))


@query("set_intersect", f"({A}) INTERSECT ({BB})")
def _(t):
    return J.set_intersect(*_ab(t))


@query(
    "top_k_changes",
    "WITH a AS (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500), b AS (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice * (1 + (o_orderkey % 7) / 50e0) DESC, o_orderkey LIMIT 500) SELECT id, 'entered' AS change FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'left' FROM a WHERE id NOT IN (SELECT id FROM b)",
)
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice")
    top = lambda e: o.orderBy(F.desc(F.expr(e)), "id").limit(500)
    return J.top_changes(top("o_totalprice"), top("o_totalprice * (1 + (id % 7) / 50e0)"), "id")


@query("dedupe_keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return J.dedupe(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query(
    "merge_new_rows",
    "WITH e AS (SELECT p_brand AS k, min(p_partkey) AS v FROM part WHERE p_brand < 'Brand#2' GROUP BY 1), d AS (SELECT p_brand AS k, p_partkey AS v FROM part) SELECT k, v FROM e UNION ALL SELECT k, min(v) FROM d WHERE k NOT IN (SELECT k FROM e) GROUP BY 1",
)
def _(t):
    p = t.part.select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("v"))
    return J.merge_new(p.where("k < 'Brand#2'").groupBy("k").agg(F.min("v").alias("v")), p, "k")


@query(
    "fuzzy_title_match",
    """WITH l AS (SELECT s_suppkey AS lid, lower('Supplier ' || s_suppkey || ' ' || s_nationkey) AS a FROM supplier), r AS (SELECT c_custkey AS rid, lower('supplier ' || c_custkey || '-' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ' ltd' ELSE '' END) AS b0 FROM customer),
r2 AS (SELECT rid, trim(regexp_replace(b0, '[^a-z0-9]+', ' ', 'g')) AS b FROM r), s AS (SELECT lid, rid, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.92 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END, 9) AS s FROM l, r2),
k AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY s DESC, rid) AS rn FROM s WHERE s >= 0.75) SELECT l.lid, rid, s AS similarity FROM l LEFT JOIN k ON k.lid = l.lid AND rn = 1""",
    f="similarity",
)
def _(t):
    l = t.supplier.select(F.col("s_suppkey").alias("lid"), F.concat_ws(" ", F.lit("Supplier"), "s_suppkey", "s_nationkey").alias("a"))
    r = t.customer.select(
        F.col("c_custkey").alias("rid"),
        F.concat(F.lit("supplier "), "c_custkey", F.lit("-"), "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, " LTD").otherwise("")).alias("b"),
    )
    return J.fuzzy_match(l, r, "lid", "a", "rid", "b", 0.75)
