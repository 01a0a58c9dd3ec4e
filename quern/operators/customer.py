"""Order history features per customer: order, customer and look-back aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ordered import framed, hot_groups, join_keys, numbered, quantiles

CID = "customer_id"
SET_LINES = 100_000  # lines of a customer whose distinct values one task holds as sets


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b with a zero denominator giving null."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a / F.nullif(b, F.lit(0))


def when_sum(cond: Column, value: Column | None = None) -> Column:
    return F.sum(F.when(cond, F.lit(1) if value is None else value).otherwise(0 if value is None else 0.0))


def label_window(pop: DataFrame, gap_days: int = 14, months: int = 3) -> DataFrame:
    """Scoring date -> slice name, feature cutoff and length of the target window in days."""
    s = F.col("scoring_date")
    return pop.withColumns(
        {
            "slice": F.date_format(s, "yyyy-MM-dd"),
            "cutoff": F.date_sub(s, gap_days),
            "win_len": F.datediff(F.add_months(s, months), s),
        }
    )


def purchase_lines(lines: DataFrame, products: DataFrame, pop: DataFrame) -> DataFrame:
    """Order lines with product attributes (left, m:1) and the customer's cutoff (inner, m:1); ``d`` = days before cutoff."""
    return (
        lines.join(products, "product_id", "left")
        .join(pop.select(CID, "cutoff", "win_len"), CID, "inner")
        .withColumn("d", F.datediff("cutoff", "order_date"))
        .where("d >= 0")
    )


def order_level(lines: DataFrame) -> DataFrame:
    return lines.groupBy(CID, "order_id").agg(
        F.first("d").alias("d"),
        F.sum("paid").alias("s"),
        F.count(F.lit(1)).alias("n"),
        F.avg("disc").alias("disc"),
        F.max("loy").alias("loy"),
        F.max((F.weekday("order_date") >= 5).cast("int")).alias("weekend"),
    )


def day_level(ot: DataFrame) -> DataFrame:
    """Active days with the gap to the next newer active day and the rank from the newest (0 = newest).

    One row per customer and calendar day, so a window over one customer is bounded by the calendar.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(CID).orderBy("d")
    days = ot.groupBy(CID, "d").agg(F.count(F.lit(1)).alias("day_orders"), F.sum("s").alias("day_sum"))
    return days.withColumns({"gap": F.col("d") - F.lag("d").over(w), "rk": F.row_number().over(w) - 1})


def order_gaps(ot: DataFrame, limit: int | None = None) -> DataFrame:
    """Orders with rank from the newest (0 = newest) and the gap to the neighbouring newer order."""
    lead = F.col("d")
    rows = numbered(ot, [CID], lead, ["d", "order_id"], "k", limit).withColumn("k", F.col("k") - 1)
    return framed(
        rows, [CID], lead, ["d", "order_id"], 1, 0, lambda w: {"gap": F.col("d") - F.lag("d").over(w)}, limit
    )


def customer_rfm(ot: DataFrame, limit: int | None = None) -> DataFrame:
    newest = F.struct("d", "order_id")
    base = ot.groupBy(CID).agg(
        F.min("d").alias("recency"),
        F.max("d").alias("tenure"),
        F.avg("d").alias("d_mean"),
        F.stddev_samp("d").alias("d_std"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("n").alias("n_items"),
        F.sum("s").alias("sum_paid"),
        F.avg("s").alias("order_sum_mean"),
        F.max("s").alias("order_sum_max"),
        F.stddev_samp("s").alias("order_sum_std"),
        F.avg("n").alias("items_per_order"),
        F.max("n").alias("items_max"),
        F.avg("disc").alias("order_disc_mean"),
        F.avg("loy").alias("order_loy_mean"),
        F.max("loy").alias("order_loy_max"),
        F.avg("weekend").alias("weekend_share"),
        F.min_by("s", newest).alias("last_order_sum"),
        F.max_by("s", newest).alias("first_order_sum"),
        F.min_by("loy", newest).alias("last_loy"),
        F.max_by("loy", newest).alias("first_loy"),
    )
    base = base.withColumns(
        {
            "loy_change": F.col("last_loy") - F.col("first_loy"),
            "last_sum_to_mean": ratio("last_order_sum", "order_sum_mean"),
        }
    )
    return join_keys(base, quantiles(ot, [CID], {"order_sum_median": ("s", 0.5)}, limit), [CID])


def windowed_lookback(ot: DataFrame, windows: Sequence[int] = (7, 30, 90, 180, 365, 730)) -> DataFrame:
    """Counts, sums and item counts within nested look-back windows, and the older remainder, in one pass."""
    aggs = []
    for w in windows:
        m = F.col("d") <= w
        aggs += [
            when_sum(m).alias(f"n_orders_{w}"),
            when_sum(m, F.col("s")).alias(f"sum_{w}"),
            when_sum(m, F.col("n")).cast("long").alias(f"n_items_{w}"),
        ]
    for w in (90, 365):
        m = F.col("d") <= w
        aggs += [F.max(F.when(m, F.col("loy"))).alias(f"loy_max_{w}"), F.avg(F.when(m, F.col("disc"))).alias(f"disc_mean_{w}")]
    out = ot.groupBy(CID).agg(*aggs, when_sum(F.col("d") > 365).alias("n_orders_older_365"))
    return out.withColumns({f"aov_{w}": ratio(f"sum_{w}", f"n_orders_{w}") for w in (90, 365)})


# fixed values: day-bin edges
LOOKBACK_EDGES = (0, 7, 14, 30, 60, 90, 120, 180, 270, 365, 450, 540, 733)


def disjoint_bins(rows: DataFrame, edges: Sequence[int] = LOOKBACK_EDGES) -> DataFrame:
    """Row counts per disjoint [lo, hi) day bin, and each bin's share of the rows inside the edges."""
    d = F.col("d")
    pairs = list(zip(edges[:-1], edges[1:]))
    out = rows.groupBy(CID).agg(
        *[when_sum((d >= a) & (d < b)).alias(f"n_{a}_{b}") for a, b in pairs],
        when_sum((d >= edges[0]) & (d < edges[-1])).alias("_all"),
    )
    return out.withColumns({f"share_{a}_{b}": ratio(f"n_{a}_{b}", "_all") for a, b in pairs}).drop("_all")


def month_buckets(days: DataFrame, buckets: int = 24) -> DataFrame:
    """Active days in each 30-day bucket before the cutoff."""
    b = F.floor(F.col("d") / 30)
    return days.groupBy(CID).agg(*[when_sum(b == i).alias(f"mb_{i:02d}") for i in range(buckets)])


def seasonal_window(days: DataFrame, gap_days: int = 14, margin: int = 30) -> DataFrame:
    """Active days in the target window one and two years earlier, exact and widened by a margin."""
    aggs = []
    for years, tag in ((1, "ya"), (2, "ya2")):
        lo = F.lit(365 * years - gap_days) - F.col("win_len")
        hi = F.lit(365 * years - gap_days - 1)
        aggs += [
            when_sum(F.col("d").between(lo, hi)).alias(f"{tag}_days"),
            when_sum(F.col("d").between(lo - margin, hi + margin)).alias(f"{tag}_days_wide"),
        ]
    return days.groupBy(CID).agg(*aggs)


def distinct_counts(lines: DataFrame, cols: Sequence[str] = ("product_id", "brand", "category", "category2", "gender"), limit: int = SET_LINES) -> DataFrame:
    """Exact distinct counts of several columns plus active weeks and months.

    A line is sent once, to its customer's task, which holds the sets of one customer at a time. With customers above
    ``limit`` lines there is one long (customer, column, value) de-duplication instead, shuffled on all three, so that a
    very large customer is spread over tasks.
    """
    kinds = {c: F.col(c) for c in cols}
    kinds["week"] = F.floor(F.col("d") / 7)
    kinds["month"] = F.year("order_date") * 12 + F.month("order_date")
    if hot_groups(lines, [CID], limit) is None:
        narrow = lines.select(CID, *[v.alias(f"_{k}") for k, v in kinds.items()]).repartition(CID)
        return narrow.groupBy(CID).agg(*[F.size(F.collect_set(f"_{k}")).cast("long").alias(f"n_{k}") for k in kinds])
    kinds = {k: v.cast("string") for k, v in kinds.items()}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
    long = lines.select(CID, F.explode(pairs).alias("p")).select(CID, "p.*").where("value IS NOT NULL").distinct()
    return long.groupBy(CID).agg(*[when_sum(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def crosstab_share(lines: DataFrame, col: str, levels: Sequence[str], recent: int = 90) -> DataFrame:
    """Share of a customer's items on each level, all time and inside the last ``recent`` days."""
    c, r = F.col(col), F.col("d") <= recent
    known = c.isNotNull()
    out = lines.groupBy(CID).agg(
        when_sum(known).alias("_a"),
        when_sum(known & r).alias("_r"),
        *[when_sum(c == v).alias(f"_a_{i}") for i, v in enumerate(levels)],
        *[when_sum((c == v) & r).alias(f"_r_{i}") for i, v in enumerate(levels)],
    )
    name = [v.lower() for v in levels]
    return out.select(
        CID,
        *[ratio(f"_a_{i}", "_a").alias(f"share_{v}") for i, v in enumerate(name)],
        *[ratio(f"_r_{i}", "_r").alias(f"share{recent}_{v}") for i, v in enumerate(name)],
    )


def top_value(lines: DataFrame, col: str) -> DataFrame:
    """Most frequent level per customer (ties: first by name), its count and its share of all items.

    Counts first, then an aggregate argmax: no window over raw lines.
    """
    counts = lines.groupBy(CID, col).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col(col).isNotNull(), F.struct((-F.col("n")).alias("m"), F.col(col).alias("v"))))
    out = counts.groupBy(CID).agg(best.alias("b"), F.sum("n").alias("total"))
    return out.select(
        CID, F.col("b.v").alias(f"top_{col}"), (-F.col("b.m")).alias("n_top"), ratio(-F.col("b.m"), F.col("total")).alias("share")
    )


def top_share(lines: DataFrame, col: str) -> DataFrame:
    """Share of the largest level among rows where the level is known."""
    counts = lines.where(F.col(col).isNotNull()).groupBy(CID, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(CID).agg(ratio(F.max("n"), F.sum("n")).alias("top_share"))


def last_k(gaps: DataFrame, ks: Sequence[int] = (2, 3, 5, 10)) -> DataFrame:
    """Means, span, mean gap and recency ratio over the newest k orders; span values only when k exist."""
    small = gaps.where(F.col("k") < max(ks))
    aggs = [F.min("d").alias("_r")]
    for k in ks:
        m = F.col("k") < k
        aggs += [
            F.avg(F.when(m, F.col("s"))).alias(f"sum_mean_{k}"),
            F.avg(F.when(m, F.col("n"))).alias(f"items_mean_{k}"),
            F.avg(F.when(m, F.col("disc"))).alias(f"disc_mean_{k}"),
            when_sum(m).alias(f"_c_{k}"),
            F.max(F.when(m, F.col("d"))).alias(f"_hi_{k}"),
        ]
    out = small.groupBy(CID).agg(*aggs)
    for k in ks:
        whole = F.col(f"_c_{k}") == k
        span = F.col(f"_hi_{k}") - F.col("_r")
        out = out.withColumns(
            {
                f"span_{k}": F.when(whole, span),
                f"gap_mean_{k}": F.when(whole, span / F.lit(k - 1)),
                f"recency_kth_{k}": F.when(whole, F.col(f"_hi_{k}")),
            }
        ).withColumn(f"recency_to_gap_{k}", ratio(F.col("_r"), F.col(f"gap_mean_{k}")))
    return out.drop("_r", *[f"_c_{k}" for k in ks], *[f"_hi_{k}" for k in ks])


def kth_day(days: DataFrame, ks: Sequence[int] = (1, 2, 4, 9), gap_rank: int = 2) -> DataFrame:
    """Age of the (k+1)-th newest active day and the gap of one chosen rank."""
    return days.groupBy(CID).agg(
        *[F.max(F.when(F.col("rk") == k, F.col("d"))).alias(f"d_day_{k + 1}") for k in ks],
        F.max(F.when(F.col("rk") == gap_rank, F.col("gap"))).alias("gap_prev"),
    )


def calendar_features(ot_dates: DataFrame) -> DataFrame:
    """Calendar position of the newest order and shares of orders early, late and on weekends.

    Input: one row per order with ``d, order_id, order_date, scoring_date``.
    """
    dom, wd = F.dayofmonth("order_date"), F.weekday("order_date")
    idx = lambda c: F.year(c) * 12 + F.month(c)
    newest = F.struct("d", "order_id", dom.alias("dom"), wd.alias("wd"), F.month("order_date").alias("mo"))
    # one row per customer, month and distance first: distinct months are then counted without a copy of the rows for each
    months = ot_dates.groupBy(CID, idx("order_date").alias("_mi"), (idx("scoring_date") - idx("order_date")).alias("_rel")).agg(
        F.min(newest).alias("_new"), F.count("order_date").alias("_n"), when_sum(dom <= 10).alias("_le10"), when_sum(dom >= 21).alias("_ge21"), when_sum(wd >= 5).alias("_end"), F.count(F.lit(1)).alias("_rows")
    )
    inside = lambda lo, hi: F.sum(F.when(F.col("_rel").between(lo, hi), F.col("_rows")).otherwise(0))
    share = lambda c: F.sum(c) / F.nullif(F.sum("_n"), F.lit(0))
    return months.groupBy(CID).agg(
        F.min("_new")["dom"].alias("last_dom"),
        F.min("_new")["wd"].alias("last_weekday"),
        F.min("_new")["mo"].alias("last_month"),
        share("_le10").alias("share_dom_le10"),
        share("_ge21").alias("share_dom_ge21"),
        share("_end").alias("weekend_share"),
        inside(10, 12).alias("n_window_ya"),
        inside(22, 24).alias("n_window_ya2"),
        inside(13, 15).alias("n_before_window_ya"),
        inside(7, 9).alias("n_after_window_ya"),
        F.size(F.collect_set("_mi")).cast("long").alias("active_months"),
        F.size(F.collect_set(F.when(F.col("_rel") <= 12, F.col("_mi")))).cast("long").alias("active_months_year"),
    )
