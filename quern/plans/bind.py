"""Stand-ins for the input shapes over the given tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import customer as C
from quern.registry import Tables

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")  # fixed values: levels of p_type
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")  # fixed values: levels of event_type


def population(t: Tables) -> DataFrame:
    pop = t.customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.to_date(F.lit("2001-02-01")))
        .otherwise(F.to_date(F.lit("2001-03-01")))
        .alias("scoring_date"),
    )
    return C.label_window(pop)


def order_lines(t: Tables) -> DataFrame:
    o = t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
    )
    li = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("paid"),
        (F.col("l_discount") * 100).alias("disc"),
        (F.col("l_tax") * 100).alias("loy"),
    )
    return li.join(o, "order_id")


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat_ws("-", "p_type", F.floor(F.col("p_size") / 10).cast("string")).alias("category2"),
        F.element_at(F.array(F.lit("f"), F.lit("m"), F.lit("u")), F.col("p_size") % 3 + 1).alias("gender"),
    )


def lines(t: Tables) -> DataFrame:
    return C.purchase_lines(order_lines(t), products(t), population(t))


def orders_dated(t: Tables) -> DataFrame:
    """One row per order that has lines: customer, order, days before cutoff, dates."""
    rows = lines(t).groupBy("customer_id", "order_id").agg(F.first("d").alias("d"), F.first("order_date").alias("order_date"))
    return rows.join(population(t).select("customer_id", "scoring_date"), "customer_id")


def targets(t: Tables) -> DataFrame:
    """1 when the customer orders inside the target window after the scoring date."""
    pop = population(t).select("customer_id", "slice", "scoring_date", "win_len")
    o = t.orders.select(F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("od"))
    hit = o.join(pop, "customer_id").where("od > scoring_date AND od <= date_add(scoring_date, win_len)")
    hit = hit.groupBy("customer_id").agg(F.lit(1).alias("hit"))
    return pop.join(hit, "customer_id", "left").select("customer_id", "slice", F.coalesce("hit", F.lit(0)).alias("target"))


POP = """pop AS (
  SELECT *, CAST(scoring_date AS VARCHAR) AS slice, CAST(scoring_date - INTERVAL 14 DAY AS DATE) AS cutoff,
         date_diff('day', scoring_date, CAST(scoring_date + INTERVAL 3 MONTH AS DATE)) AS win_len
  FROM (SELECT c_custkey AS customer_id,
               CASE WHEN c_custkey % 2 = 0 THEN DATE '2001-02-01' ELSE DATE '2001-03-01' END AS scoring_date
        FROM customer))"""
LINES = (
    POP
    + """,
lines AS (
  SELECT o.o_custkey AS customer_id, l.l_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date,
         l.l_partkey AS product_id, l.l_extendedprice AS paid, l.l_discount * 100 AS disc, l.l_tax * 100 AS loy,
         p.p_brand AS brand, p.p_type AS category, p.p_type || '-' || CAST(p.p_size // 10 AS VARCHAR) AS category2,
         (['f', 'm', 'u'])[p.p_size % 3 + 1] AS gender, pop.cutoff, pop.win_len,
         date_diff('day', CAST(o.o_orderdate AS DATE), pop.cutoff) AS d
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = l.l_partkey JOIN pop ON pop.customer_id = o.o_custkey
  WHERE date_diff('day', CAST(o.o_orderdate AS DATE), pop.cutoff) >= 0)"""
)
ORDERS = (
    LINES
    + """,
ot AS (
  SELECT customer_id, order_id, min(d) AS d, min(order_date) AS order_date, sum(paid) AS s, count(*) AS n,
         avg(disc) AS disc, max(loy) AS loy, max(CAST(isodow(order_date) >= 6 AS INT)) AS weekend
  FROM lines GROUP BY 1, 2)"""
)
DAYS = (
    ORDERS
    + """,
days AS (
  SELECT *, d - lag(d) OVER (PARTITION BY customer_id ORDER BY d) AS gap,
         row_number() OVER (PARTITION BY customer_id ORDER BY d) - 1 AS rk
  FROM (SELECT customer_id, d, count(*) AS day_orders, sum(s) AS day_sum FROM ot GROUP BY 1, 2))"""
)
GAPS = (
    ORDERS
    + """,
og AS (
  SELECT *, d - lag(d) OVER (PARTITION BY customer_id ORDER BY d, order_id) AS gap,
         row_number() OVER (PARTITION BY customer_id ORDER BY d, order_id) - 1 AS k FROM ot)"""
)
TARGET = """target AS (
  SELECT p.customer_id, p.slice,
         CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.customer_id
              AND CAST(o.o_orderdate AS DATE) > p.scoring_date
              AND CAST(o.o_orderdate AS DATE) <= p.scoring_date + p.win_len::INT) THEN 1 ELSE 0 END AS target
  FROM pop p)"""


def survey(t: Tables) -> DataFrame:
    """Orders with customer attributes, holes in some columns and a three-way class."""
    o, c = t.orders, t.customer
    k = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("id"),
        F.when(k % 13 != 0, F.col("o_totalprice")).alias("total"),
        F.when(k % 11 != 0, F.col("c_acctbal")).alias("acct"),
        F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1995-01-01"))).alias("day"),
        F.when(k % 7 != 0, F.col("c_mktsegment")).alias("seg"),
        F.col("o_orderpriority").alias("prio"),
        F.col("c_nationkey").alias("nation"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("target"),
    )


SURVEY = """survey AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS total,
         CASE WHEN o_orderkey % 11 <> 0 THEN c_acctbal END AS acct,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day,
         CASE WHEN o_orderkey % 7 <> 0 THEN c_mktsegment END AS seg, o_orderpriority AS prio, c_nationkey AS nation,
         o_custkey AS cust, o_orderstatus AS target
  FROM orders JOIN customer ON o_custkey = c_custkey),
train AS (SELECT * FROM survey WHERE id % 5 <> 0), test AS (SELECT * FROM survey WHERE id % 5 = 0)"""
CLASSES = ("F", "O", "P")  # fixed values: levels of o_orderstatus
NUM = ("total", "acct", "day")
CAT = ("seg", "prio")


def splits(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the survey (four to one by id)."""
    s = survey(t)
    return s.where("id % 5 <> 0"), s.where("id % 5 = 0")


def sql_long(cols, source: str, keep: str = "", value: str = "x", kind: str = "DOUBLE", name: str = "feature") -> str:
    """Long form of columns as SQL."""
    keep = keep + ", " if keep else ""
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS {name}, CAST({c} AS {kind}) AS {value} FROM {source}" for c in cols)
