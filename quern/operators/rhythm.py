"""Purchase rhythm: gaps, period estimates and how likely the next order falls in the target window.

Frames named ``days`` have one row per (customer, active day), frames named ``cycles`` one row per
(customer, level, active day): a window over one of their groups is bounded by the calendar, so plain
windows and exact percentiles are used there. Order-level frames have no such bound and go through
``quern.functions.ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.mathx import clip, norm_cdf, sample_skew
from quern.functions.ordered import join_keys, quantiles
from quern.operators.customer import CID, ratio, when_sum

# fixed values: history horizons in days
HORIZONS = {"all": 10_000, "year": 365, "half": 182}
# fixed values: names of the period estimates
ESTIMATORS = ("mean", "median", "min", "max", "q25", "q75", "last", "last2", "last3", "ewm", "trim")
GAP_DAYS = 14


def _between_window(t: Column, lo: Column, hi: Column) -> Column:
    return (t > lo) & (t <= hi)


def _distance(t: Column, lo: Column, hi: Column) -> Column:
    """Days outside the window, 0 inside."""
    return F.when(t.isNotNull(), F.greatest(lo - t, F.lit(0.0)) + F.greatest(t - hi, F.lit(0.0)))


def with_window(df: DataFrame, pop: DataFrame) -> DataFrame:
    lo = F.lit(float(GAP_DAYS))
    return df.join(pop.select(CID, "win_len"), CID).withColumns({"lo": lo, "hi": lo + F.col("win_len")})


def own_hit(days: DataFrame, pop: DataFrame) -> DataFrame:
    """Share of a customer's own gaps longer than the current pause that end before, in or after the window."""
    w = Window.partitionBy(CID)
    g, r = F.col("gap"), F.col("r")
    lo, hi = r + GAP_DAYS, r + GAP_DAYS + F.col("win_len")
    rows = days.withColumn("r", F.min("d").over(w)).join(pop.select(CID, "win_len"), CID)
    out = rows.groupBy(CID).agg(
        F.count("gap").alias("n_gaps"),
        when_sum(g > r).alias("alive"),
        when_sum((g > lo) & (g <= hi)).alias("_hit"),
        when_sum((g > r) & (g <= lo)).alias("_hidden"),
        when_sum(g > hi).alias("_late"),
        when_sum(g <= F.col("win_len")).alias("_short"),
    )
    return out.select(
        CID, "n_gaps", "alive",
        ratio("alive", "n_gaps").alias("share_alive"),
        ratio("_hit", "alive").alias("p_hit"),
        ratio("_hidden", "alive").alias("p_hidden"),
        ratio("_late", "alive").alias("p_late"),
        ratio("_short", "n_gaps").alias("share_le_window"),
    )


def gap_ewm(days: DataFrame, decay: float = 0.7) -> DataFrame:
    w = F.when(F.col("gap").isNotNull(), F.pow(F.lit(decay), F.col("rk") - 1))
    return days.groupBy(CID).agg((F.sum(F.col("gap") * w) / F.sum(w)).alias("gap_ewm"))


def gap_trim(days: DataFrame) -> DataFrame:
    """Mean gap without the largest one."""
    return days.groupBy(CID).agg(
        ((F.sum("gap") - F.max("gap")) / F.nullif(F.count("gap") - 1, F.lit(0))).alias("gap_trim")
    )


def gap_stats(gaps: DataFrame, horizons: Sequence[int] = (90, 180, 365, 730), limit: int | None = None) -> DataFrame:
    """Gap statistics per look-back horizon and how the current pause compares with them (long by horizon)."""
    rec = gaps.groupBy(CID).agg(F.min("d").alias("r"))
    hs = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: F.col("d") < h)
    rows = gaps.where("gap IS NOT NULL").select(CID, "gap", F.explode(hs).alias("horizon"))
    g = F.col("gap")
    keys = [CID, "horizon"]
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("gap").alias("mean"),
        F.stddev_samp("gap").alias("std"),
        F.min("gap").alias("min"),
        F.max("gap").alias("max"),
        sample_skew(F.col("gap")).alias("skew"),
        *[F.avg((g <= q).cast("int")).alias(f"share_le_{q}") for q in (7, 30, 90)],
    )
    qs = quantiles(rows, keys, {"q25": ("gap", 0.25), "median": ("gap", 0.5), "q75": ("gap", 0.75), "q90": ("gap", 0.9)}, limit)
    out = join_keys(base, qs, keys).join(rec, CID)
    return out.withColumns(
        {
            "r_minus_mean": F.col("r") - F.col("mean"),
            "r_to_median": ratio("r", "median"),
            "max_minus_r": F.col("max") - F.col("r"),
            "cv": ratio("std", "mean"),
        }
    )


def estimators(gaps: DataFrame, limit: int | None = None) -> DataFrame:
    """Eleven period estimates per customer and history horizon.

    Orders are ranked from the newest, and a horizon keeps the newest ones, so ranks and gaps of the whole
    history stay valid inside each horizon: one pass serves all of them.
    """
    hs = F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("v")) for n, v in HORIZONS.items()]),
        lambda h: F.col("d") <= h["v"],
    )
    rows = gaps.select(CID, "d", "k", "gap", F.explode(hs).alias("h")).withColumn("hist", F.col("h.name")).drop("h")
    keys = [CID, "hist"]
    k, g = F.col("k"), F.col("gap")
    w = F.when(g.isNotNull(), F.pow(F.lit(0.7), k - 1))
    base = rows.groupBy(*keys).agg(
        F.min("d").alias("r"),
        F.count(F.lit(1)).alias("n"),
        ((F.max("d") - F.min("d")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("mean"),
        F.min("gap").cast("double").alias("min"),
        F.max("gap").cast("double").alias("max"),
        F.max(F.when(k == 1, g)).cast("double").alias("last"),
        F.avg(F.when(k <= 2, g)).alias("last2"),
        F.avg(F.when(k <= 3, g)).alias("last3"),
        (F.sum(g * w) / F.sum(w)).alias("ewm"),
        ((F.sum("gap") - F.max("gap")) / F.nullif(F.count("gap") - 1, F.lit(0))).alias("trim"),
    )
    qs = quantiles(rows.where("gap IS NOT NULL"), keys, {"q25": ("gap", 0.25), "median": ("gap", 0.5), "q75": ("gap", 0.75)}, limit)
    return join_keys(base, qs, keys)


def estimators_long(est: DataFrame) -> DataFrame:
    """(customer, hist, r, n, est, period); periods that are not positive become null.

    Periods keep nine decimals, so whole-cycle tests do not hang on the last bit of a weighted mean.
    """
    long = est.unpivot([CID, "hist", "r", "n"], list(ESTIMATORS), "est", "period")
    long = long.withColumn("period", F.round("period", 9))
    return long.withColumn("period", F.when(F.col("period") > 0, F.col("period")))


def next_time(est: DataFrame) -> DataFrame:
    """Expected next order day per estimate, its place relative to the window and whole cycles inside it.

    Input: ``estimators_long`` joined by ``with_window``.
    """
    p, r, lo, hi = F.col("period"), F.col("r"), F.col("lo"), F.col("hi")
    # the remainder by whole cycles, as the definition has it: an exact remainder differs from it in the last bits
    t, tm = p - r, p - (r - F.floor(r / p) * p)
    return est.select(
        CID, "hist", "est", "period",
        t.alias("t"),
        _distance(t, lo, hi).alias("dist"),
        _between_window(t, lo, hi).cast("int").alias("inside"),
        tm.alias("tmod"),
        _between_window(tm, lo, hi).cast("int").alias("tmod_inside"),
        (F.floor((r + hi) / p) - F.floor((r + lo) / p)).alias("cycles"),
    )


def window_units(est: DataFrame) -> DataFrame:
    p = F.col("period")
    return est.select(CID, "hist", "est", ((F.col("r") + F.col("lo")) / p).alias("ulo"), ((F.col("r") + F.col("hi")) / p).alias("uhi"))


def _soft(center: Column, sd: Column) -> Column:
    return norm_cdf((F.col("hi") - center) / sd) - norm_cdf((F.col("lo") - center) / sd)


def soft_hit(est: DataFrame) -> DataFrame:
    """Normal probability of hitting the window with fixed (10, 20 days) or relative (quarter period) spread."""
    p = F.col("period")
    t = p - F.col("r")
    return est.select(
        CID, "hist", "est",
        _soft(t, F.lit(10.0)).alias("phit10"),
        _soft(t, F.lit(20.0)).alias("phit20"),
        _soft(t, p * 0.25).alias("phit_rel"),
    )


def lognormal(est: DataFrame, sigmas: Sequence[float] = (0.25, 0.5, 0.8)) -> DataFrame:
    """Log-normal probability that the gap ends in the window, plain and given that the pause already lasts r days."""
    b = clip(F.col("period"), 1.0)
    r = F.col("r").cast("double")

    def cdf(x: Column, s: float) -> Column:
        return norm_cdf((F.ln(F.greatest(x, F.lit(1e-9))) - F.ln(b)) / F.lit(s))

    cols = []
    for s in sigmas:
        tag = str(s).replace(".", "")
        win = cdf(r + F.col("hi"), s) - cdf(r + F.col("lo"), s)
        alive = F.greatest(1 - cdf(r, s), F.lit(1e-6))
        cols += [win.alias(f"win_{tag}"), alive.alias(f"alive_{tag}"), (win / alive).alias(f"win_alive_{tag}")]
    hidden = (cdf(r + F.col("lo"), 0.5) - cdf(r, 0.5)) / F.greatest(1 - cdf(r, 0.5), F.lit(1e-6))
    return est.select(CID, "hist", "est", *cols, hidden.alias("hidden_alive_05"))


def multi_cycle(est: DataFrame, cycles: int = 3) -> DataFrame:
    """Hits over several skipped cycles: any, count, 1 - prod(1 - p), sum of p, distance, overdue."""
    p, r, lo, hi = F.col("period"), F.col("r"), F.col("lo"), F.col("hi")
    centers = [F.lit(float(m)) * p - r for m in range(1, cycles + 1)]
    hard = [F.coalesce(_between_window(c, lo, hi).cast("int"), F.lit(0)) for c in centers]
    soft = [F.coalesce(F.least(F.greatest(_soft(c, p * 0.25), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for c in centers]
    miss = F.lit(1.0)
    for s in soft:
        miss = miss * (1 - s)
    return est.select(
        CID, "hist", "est",
        F.greatest(*hard).alias("any_hard"),
        sum(hard[1:], hard[0]).alias("n_hard"),
        (1 - miss).alias("p_any_soft"),
        sum(soft[1:], soft[0]).alias("e_soft"),
        F.least(*[_distance(c, lo, hi) for c in centers]).alias("min_dist"),
        F.coalesce(r > p, F.lit(False)).cast("int").alias("overdue"),
        (r / p).alias("recency_to_period"),
    )


def level_cycles(lines: DataFrame, col: str) -> DataFrame:
    """Gap series per (customer, level) with at least two active days."""
    w = Window.partitionBy(CID, col).orderBy("d")
    days = lines.where(F.col(col).isNotNull()).select(CID, col, "d").distinct()
    days = days.withColumn("gap", F.col("d") - F.lag("d").over(w))
    st = days.groupBy(CID, F.col(col).alias("level")).agg(
        F.min("d").alias("last"),
        F.max("d").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.percentile("gap", F.lit(0.5)).alias("med"),
        F.max("gap").alias("mx"),
    )
    mean_gap = (F.col("first") - F.col("last")) / (F.col("n") - 1)
    return st.where("n >= 2").withColumns(
        {
            "mean_gap": mean_gap,
            "r_med": ratio("last", "med"),
            "t_med": F.col("med") - F.col("last"),
            "t_mean": mean_gap - F.col("last"),
        }
    )


def by_category(cycles: DataFrame, pop: DataFrame) -> DataFrame:
    """Per customer: series count, how many series expect a purchase in the window, best series, pause ratios."""
    st = with_window(cycles, pop)
    dist = _distance(F.col("t_mean"), F.col("lo"), F.col("hi"))
    st = st.withColumns({"dist": dist, "hit": (dist == 0).cast("int"), "inn": _between_window(F.col("t_med"), F.col("lo"), F.col("hi")).cast("int")})
    best = F.struct("dist", "last", "level")
    top = F.struct((-F.col("n")).alias("m"), F.col("last"), F.col("level"))
    return st.groupBy(CID).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.sum("hit").alias("n_hit"),
        F.avg("hit").alias("hit_share"),
        F.min("dist").alias("min_dist"),
        F.min_by("t_mean", best).alias("best_t"),
        F.min_by("mean_gap", best).alias("best_gap"),
        F.sum("inn").alias("n_inside_med"),
        ratio(F.sum(F.col("inn") * F.col("n")), F.sum("n")).alias("inside_by_days"),
        F.min(F.abs(F.col("t_med") - (F.col("lo") + F.col("hi")) / 2)).alias("min_mid_dist"),
        F.min("r_med").alias("min_r_med"),
        F.avg("r_med").alias("mean_r_med"),
        F.max(F.col("mx") - F.col("last")).alias("max_mx_r"),
        when_sum(F.col("n") >= 3).alias("series_3plus"),
        F.min_by("med", top).alias("main_med"),
        F.min_by("last", top).alias("main_last"),
    )


def overdue_share(cycles: DataFrame) -> DataFrame:
    """Share of levels whose current pause exceeds their median gap."""
    return cycles.groupBy(CID).agg(F.avg((F.col("last") > F.col("med")).cast("int")).alias("overdue_share"))


def repeats(lines: DataFrame, col: str) -> DataFrame:
    """Share of levels bought on 2+ days, most days for one level, share of the newest day's levels bought before."""
    known = F.col(col).isNotNull()
    # lines without a level only tell the newest day; levels of one customer with the same newest day are summed first
    # dealt by level at once, so that a large customer is in several tasks; the days of one level are bounded by the calendar
    dealt = lines.select(CID, col, "d").repartition(CID, col)
    per = dealt.groupBy(CID, col).agg(F.size(F.collect_set("d")).alias("n"), F.min("d").alias("newest"), F.max("d").alias("oldest"))
    days = per.groupBy(CID, "newest").agg(
        F.count(col).alias("levels"),
        when_sum(known & (F.col("n") >= 2)).alias("twice"),
        F.max(F.when(known, F.col("n"))).alias("most"),
        when_sum(known & (F.col("oldest") > F.col("newest"))).alias("before"),
    )
    last = F.min_by(F.struct("before", "levels"), "newest")
    out = days.groupBy(CID).agg(F.sum("twice").alias("twice"), F.sum("levels").alias("levels"), F.max("most").alias("max_days"), last.alias("last"))
    return out.where("levels > 0").select(
        CID, (F.col("twice") / F.col("levels")).alias("repeat_share"), "max_days", ratio("last.before", "last.levels").alias("last_seen_share")
    )


# fixed values: look-back windows in days
TREND_WINDOWS = (30, 60, 90, 120, 180, 270, 365, 540, 730)


def trends(ot: DataFrame) -> DataFrame:
    """Ratios between nested windows, spend trends, loyalty change over a year and discount drift."""
    d = F.col("d")
    newest = F.struct("d", "order_id")
    base = ot.groupBy(CID).agg(
        *[when_sum(d < w).alias(f"n{w}") for w in TREND_WINDOWS],
        *[when_sum(d < w, F.col("s")).alias(f"s{w}") for w in TREND_WINDOWS],
        F.min_by("loy", newest).alias("loy_now"),
        F.min_by("loy", F.when(d >= 300, newest)).alias("loy_then"),
        F.min_by("s", newest).alias("s_last"),
        F.avg("s").alias("s_mean"),
        F.avg(F.when(d < 90, F.col("disc"))).alias("disc90"),
        F.avg(F.when(d < 365, F.col("disc"))).alias("disc365"),
    )
    cols = []
    for a, b in zip(TREND_WINDOWS[:-1], TREND_WINDOWS[1:]):
        cols += [
            ratio(F.col(f"n{a}"), F.col(f"n{b}") - F.col(f"n{a}") + 1).alias(f"trend_n_{a}_{b}"),
            ratio(F.col(f"s{a}"), F.col(f"s{b}") - F.col(f"s{a}") + 1).alias(f"trend_s_{a}_{b}"),
            ratio(F.col(f"n{a}"), F.col(f"n{b}")).alias(f"share_n_{a}_{b}"),
        ]
    aov = lambda w: ratio(F.col(f"s{w}"), F.col(f"n{w}"))
    return base.select(
        CID, *cols,
        ratio(aov(365), aov(730)).alias("aov_365_730"),
        ratio("s_last", "s_mean").alias("last_to_mean"),
        (F.col("loy_now") - F.col("loy_then")).alias("loy_year_change"),
        (F.col("disc90") - F.col("disc365")).alias("disc_drift"),
    )


def category_recency(lines: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Per level: recency, active days within a year, share of the items of the last 180 days."""
    d = F.col("d")
    per = lines.groupBy(CID, col, "d").agg(F.count(F.lit(1)).alias("n"))
    near = when_sum(d < 180, F.col("n"))
    aggs = [near.alias("_all")]
    for v in levels:
        m = F.col(col) == v
        tag = v.lower()
        aggs += [
            F.min(F.when(m, d)).alias(f"recency_{tag}"),
            when_sum(m & (d < 365)).alias(f"days365_{tag}"),
            when_sum(m & (d < 180), F.col("n")).alias(f"_n_{tag}"),
        ]
    out = per.groupBy(CID).agg(*aggs)
    return out.withColumns({f"share180_{v.lower()}": ratio(f"_n_{v.lower()}", "_all") for v in levels}).drop(
        "_all", *[f"_n_{v.lower()}" for v in levels]
    )


def baskets(lines: DataFrame, levels: Sequence[str], col: str = "category") -> DataFrame:
    """Category mix of every shopping day (shares over fixed levels) with rank from the newest."""
    w = Window.partitionBy(CID).orderBy("d")
    mix = lines.where(F.col(col).isNotNull()).groupBy(CID, "d").agg(
        F.array(*[F.avg((F.col(col) == v).cast("double")) for v in levels]).alias("mix")
    )
    return mix.withColumns(
        {
            "rk": F.row_number().over(w) - 1,
            "gap": F.col("d") - F.lag("d").over(w),
            "latest": F.first("mix").over(w),
            "r": F.min("d").over(w),
        }
    )


def basket_drift(b: DataFrame, levels: Sequence[str], recent: int = 3, need: int = 6) -> DataFrame:
    """Half the L1 distance between the mean mix of the newest baskets and of all earlier ones."""
    new = F.col("rk") < recent
    parts = [
        F.abs(F.avg(F.when(new, F.col("mix")[i])) - F.avg(F.when(~new, F.col("mix")[i]))) for i in range(len(levels))
    ]
    half = sum(parts[1:], parts[0]) / 2
    return b.groupBy(CID).agg(F.when(F.count(F.lit(1)) >= need, F.least(F.greatest(half, F.lit(0.0)), F.lit(1.0))).alias("basket_drift"))


def basket_similar_wait(b: DataFrame, pop: DataFrame) -> DataFrame:
    """Gaps after baskets weighted by squared overlap with the newest basket: mass, surviving mass, in-window mass."""
    rows = b.where("gap IS NOT NULL").join(pop.select(CID, "win_len"), CID)
    overlap = F.aggregate(F.zip_with("mix", "latest", lambda x, y: F.least(x, y)), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("w", overlap * overlap)
    g, r = F.col("gap"), F.col("r")
    lo = r + GAP_DAYS
    out = rows.groupBy(CID).agg(
        F.max("r").alias("_r"),
        F.sum("w").alias("wait_mass"),
        when_sum(g > r, F.col("w")).alias("wait_alive"),
        when_sum((g > lo) & (g <= lo + F.col("win_len")), F.col("w")).alias("wait_window"),
        ratio(F.sum(F.col("w") * g), F.sum("w")).alias("_avg"),
        F.avg("gap").alias("_mean"),
    )
    share = ratio("wait_window", "wait_alive")
    return out.select(
        CID, "wait_mass", "wait_alive", "wait_window",
        (F.col("_avg") - F.col("_mean")).alias("wait_gap_shift"),
        (F.col("_r") - F.col("_avg")).alias("wait_overdue"),
        clip(share, 0.0, 1.0).alias("wait_share"),
    )


# fixed values: estimates tried as rules
AUDIT_PERIODS = ("mean", "median", "max", "trim", "q75", "last", "ewm")


def hit_rate_grid(est: DataFrame, seg: DataFrame, min_rows: int = 80) -> DataFrame:
    """Precision, lift and size of every (segment, period, cycle, branch) rule with enough rows.

    ``est``: estimators of one horizon in long form with lo/hi; ``seg``: customer, n_orders, recency, target.
    """
    rows = est.where(F.col("est").isin(*AUDIT_PERIODS) & F.col("period").isNotNull()).join(
        seg.select(CID, "n_orders", "recency", "target"), CID
    )
    n, rec, p = F.col("n_orders"), F.col("recency"), F.col("period")
    segments = F.array_compact(
        F.array(F.when(n.between(4, 8), "4-8"), F.when(n >= 9, "9+"), F.when(n >= 4, "4+"))
    )
    rows = rows.withColumn("seg", F.explode(segments)).withColumn("cycle", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    hit = F.col("cycle") * p - rec
    inn, over = _between_window(hit, F.col("lo"), F.col("hi")), rec > p
    branches = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(inn, "in_window"),
            F.when(over, "overdue"),
            F.when(~over, "not_overdue"),
            F.when(inn & over, "in_and_overdue"),
            F.when(inn & ~over, "in_and_fresh"),
        )
    )
    rules = (
        rows.withColumn("branch", F.explode(branches))
        .groupBy("seg", F.col("est").alias("period"), "cycle", "branch")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("precision"))
        .where(F.col("n") >= min_rows)
    )
    base = seg.withColumn("seg", F.explode(segments)).groupBy("seg").agg(F.avg("target").alias("_base"))
    rules = rules.join(F.broadcast(base), "seg")  # three segments
    return rules.select(
        "seg", "period", "cycle", "branch", "n", "precision",
        (F.col("precision") / F.greatest(F.col("_base"), F.lit(1e-9))).alias("lift"),
        (F.col("precision") * F.log1p(F.col("n"))).alias("rule_score"),
    )


def best_rule(rules: DataFrame, seg: str = "4+") -> DataFrame:
    """The rule of a segment with the highest precision x log(1 + n); ties by name. A grid has a few hundred rows."""
    return rules.where(F.col("seg") == seg).orderBy(F.desc(F.round("rule_score", 9)), "period", "cycle", "branch").limit(1)


def rule_boost(scored: DataFrame) -> DataFrame:
    """Add 1 to the score of customers with 2-3 orders whose mean-gap estimate lands in (35, 85], and of the
    4+ segment's chosen rule (longest yearly gap ends inside the window).

    Input: customer, n_orders, score, t_mean, t_max, lo, hi.
    """
    n, t = F.col("n_orders"), F.col("t_mean")
    core = F.coalesce(n.between(2, 3) & (t > 35) & (t <= 85), F.lit(False)).cast("int")
    core4 = F.coalesce((n >= 4) & _between_window(F.col("t_max"), F.col("lo"), F.col("hi")), F.lit(False)).cast("int")
    return scored.select(CID, core.alias("core"), core4.alias("core4"), (F.col("score") + core + core4).alias("boosted"))
