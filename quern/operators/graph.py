"""Track graphs: linking points of consecutive frames, cleaning edges, components, bridges and scores.

Nodes: (ds, node_id, t, x, y); edges: (source_id, target_id, prob, distance).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.ordered import numbered
from quern.operators.spatial import within
from quern.session import cut_lineage, stored


def mutual_best(pairs: DataFrame, cost: str) -> DataFrame:
    """Pairs that are the cheapest choice of both their ends (ties by ids)."""
    rest = F.struct(*[c for c in pairs.columns if c not in ("source_id", "target_id")])
    choice = F.struct(F.col(cost), F.col("source_id"), F.col("target_id"))
    best = lambda key: pairs.groupBy(key).agg(F.min_by(F.struct("source_id", "target_id", rest.alias("_r")), choice).alias("_e")).select("_e.*")
    return best("source_id").join(best("target_id").select("source_id", "target_id"), ["source_id", "target_id"]).select("source_id", "target_id", "_r.*").select(*pairs.columns)


def link_greedy(pairs: DataFrame, cost: str) -> DataFrame:
    """One-to-one links, cheapest first: mutual choices are taken and their ends removed until no pair is left.

    The same result as sorting all pairs by cost, without sorting them in one place. Every round takes at least the
    cheapest pair left, so the loop ends.
    """
    left, out = pairs, None
    while True:
        got = cut_lineage(mutual_best(left, cost))
        out = got if out is None else out.unionByName(got)
        if got.isEmpty():
            return out
        left = left.join(got.select("source_id"), "source_id", "left_anti").join(got.select("target_id"), "target_id", "left_anti")
        left = cut_lineage(left)


def motion_link(nodes: DataFrame, tight: float, relaxed: float, velocity: float = 1.0) -> DataFrame:
    """One-to-one links of consecutive frames in two passes: near points first, then by predicted position.

    The tight pass links by distance. Its links give points a velocity; points still open are then linked within the
    relaxed radius by distance to the position predicted from the link before + 0.05 x distance moved (points without
    a link before are predicted to stay). All frames are linked at once.
    """
    here = nodes.select("ds", "t", F.col("node_id").alias("source_id"), "x", "y", F.col("x").alias("sx"), F.col("y").alias("sy"))
    there = nodes.select("ds", (F.col("t") - 1).alias("t"), F.col("node_id").alias("target_id"), "x", "y", F.col("x").alias("gx"), F.col("y").alias("gy"))
    near = cut_lineage(within(here, there, ["ds", "t"], "x", "y", relaxed).select("ds", "source_id", "target_id", "distance", "sx", "sy", "gx", "gy"))
    first = link_greedy(near.where(F.col("distance") <= tight), "distance")
    speed = first.select(F.col("target_id").alias("source_id"), (F.col("gx") - F.col("sx")).alias("vx"), (F.col("gy") - F.col("sy")).alias("vy"))
    rest = near.join(first.select("source_id"), "source_id", "left_anti").join(first.select("target_id"), "target_id", "left_anti")
    rest = rest.join(speed, "source_id", "left")
    ahead = lambda at, v: F.col(at) + F.lit(velocity) * F.coalesce(F.col(v), F.lit(0.0))
    off = F.sqrt(F.pow(F.col("gx") - ahead("sx", "vx"), 2) + F.pow(F.col("gy") - ahead("sy", "vy"), 2))
    second = link_greedy(cut_lineage(rest.withColumn("cost", F.round(off + 0.05 * F.col("distance"), 9)).drop("vx", "vy")), "cost")
    keep = ["ds", "source_id", "target_id"]
    return first.select(*keep).unionByName(second.select(*keep))


def degree_filter(nodes: DataFrame, edges: DataFrame, longest: float) -> DataFrame:
    """Drop edges with missing ends, non-consecutive or long ones; keep the best edge per target, then per source."""
    a = nodes.select(F.col("node_id").alias("source_id"), F.col("t").alias("_ts"))
    b = nodes.select(F.col("node_id").alias("target_id"), F.col("t").alias("_tt"))
    # as many nodes as edges: sorted on both sides, neither is broadcast
    ok = edges.join(a.hint("merge"), "source_id").join(b.hint("merge"), "target_id").where((F.col("_tt") == F.col("_ts") + 1) & (F.col("distance") <= longest))
    rest = F.struct("source_id", "target_id", "prob", "distance")
    best = lambda df, key: df.groupBy(key).agg(F.min_by(rest, F.struct((-F.col("prob")).alias("p"), "distance", "source_id", "target_id")).alias("e")).select("e.*")
    return best(best(ok, "target_id"), "source_id")


def ends_starts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a successor (ends) or predecessor (starts)."""
    out = edges.select(F.col("source_id").alias("node_id")).distinct()
    inc = edges.select(F.col("target_id").alias("node_id")).distinct()
    e = nodes.join(out, "node_id", "left_anti").withColumn("kind", F.lit("end"))
    return e.unionByName(nodes.join(inc, "node_id", "left_anti").withColumn("kind", F.lit("start")))


def _trees(e: DataFrame) -> DataFrame | None:
    """(node_id, component) of the nodes with edges u -> v, None unless every node has one source and no edges run in a circle."""
    n, single = e.agg(F.count(F.lit(1)), F.countDistinct("v")).first()
    if n != single:
        return None
    # where a node points, and whether that is the start of its tree
    known = cut_lineage(e.join(e.select(F.col("v").alias("u"), F.lit(False).alias("end")), "u", "left").select(F.col("v").alias("node"), F.col("u").alias("to"), F.coalesce("end", F.lit(True)).alias("end")))
    done, open_, left = known.where("end"), known.where("NOT end"), n
    while True:
        last, left = left, open_.count()
        if not left:
            break
        if left == last:  # fewer nodes are open after each round, unless edges run in a circle
            return None
        further = done.unionByName(open_).select(F.col("node").alias("to"), F.col("to").alias("_t"), "end")
        got = cut_lineage(open_.select("node", "to").join(further, "to").select("node", F.col("_t").alias("to"), "end"))
        done, open_ = done.unionByName(got.where("end")), got.where("NOT end")
    least = done.groupBy("to").agg(F.least(F.min("node"), F.first("to")).alias("component"))
    inner = done.join(least, "to").select(F.col("node").alias("node_id"), "component")
    return inner.unionByName(least.select(F.col("to").alias("node_id"), "component"))


def components(nodes: DataFrame, edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """(node_id, component): smallest node id of each connected component.

    Where every node has one source, nodes find the start of their tree by steps that double. Other edges take
    alternating star steps: every node hands its larger neighbours, then its smaller ones, to the smallest node it
    knows. Long chains shorten by a factor each round, and hub nodes only ever meet one row of minima.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    found = _trees(cut_lineage(e.distinct()))
    if found is not None:
        return nodes.join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:  # ends when a round changes nothing: the edges are then stars around the smallest nodes
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(m2.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return nodes.join(e.select(F.col("u").alias("node_id"), F.col("v").alias("component")), "node_id", "left").select(
        "node_id", F.coalesce("component", "node_id").alias("component")
    )


def min_component(nodes: DataFrame, edges: DataFrame, comp: DataFrame, shortest: int, keep_forks: bool = True) -> DataFrame:
    """Nodes of components with enough members, or with a division."""
    forks = edges.groupBy(F.col("source_id").alias("node_id")).agg((F.count(F.lit(1)) >= 2).cast("int").alias("f"))
    st = comp.join(forks, "node_id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max(F.coalesce("f", F.lit(0))).alias("has_fork"))
    ok = F.col("size") >= shortest
    keep = st.where(ok | (F.col("has_fork") == 1)) if keep_forks else st.where(ok)
    return nodes.join(comp, "node_id").join(keep, "component")


def leaf_prune(nodes: DataFrame, edges: DataFrame, weakest: float) -> DataFrame:
    """Nodes left after dropping leaves before the last frame whose only incoming edge is weak."""
    end = nodes.agg(F.max("t")).scalar()
    inc = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_n"), F.max("prob").alias("_p")).where((F.col("_n") == 1) & (F.col("_p") < weakest))
    drop = nodes.where(F.col("t") < end).join(inc, "node_id", "left_semi").join(edges.select(F.col("source_id").alias("node_id")), "node_id", "left_anti")
    return nodes.join(drop.select("node_id"), "node_id", "left_anti")


def track_smooth(nodes: DataFrame, edges: DataFrame, window: int = 2, weight: float = 0.5) -> DataFrame:
    """Move each node towards the line through its unbranched track neighbours up to ``window`` steps away."""
    one = lambda key, other: edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(other).alias("_o")).where("_n = 1").select(F.col(key).alias("_k"), F.col("_o"))
    pos = nodes.select(F.col("node_id").alias("_at"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    found = nodes.select("node_id", F.lit(0).alias("d"), F.col("node_id").alias("_at"))
    for sign, table in ((-1, one("target_id", "source_id")), (1, one("source_id", "target_id"))):
        cur = nodes.select("node_id", F.col("node_id").alias("_at"))
        for s in range(1, window + 1):
            cur = cur.join(table, F.col("_at") == F.col("_k")).select("node_id", F.col("_o").alias("_at"))
            found = found.unionByName(cur.select("node_id", F.lit(sign * s).alias("d"), "_at"))
    fit = found.join(pos, "_at").groupBy("node_id").agg(F.count(F.lit(1)).alias("_n"), F.regr_intercept("_x", "d").alias("_fx"), F.regr_intercept("_y", "d").alias("_fy"))
    fit = fit.where("_n >= 3")
    out = nodes.join(fit, "node_id", "left")
    mix = lambda raw, f: F.coalesce(F.lit(1 - weight) * F.col(raw) + F.lit(weight) * F.col(f), F.col(raw))
    return out.withColumns({"sx": mix("x", "_fx"), "sy": mix("y", "_fy")}).drop("_n", "_fx", "_fy")


def gap_bridge(nodes: DataFrame, edges: DataFrame, skip: int = 3, max_total: float = 30.0, max_step: float = 10.0, max_share: float = 0.05, limit: int | None = None) -> DataFrame:
    """Joins between track ends at t and starts at t + skip: near enough, direction not reversed, one-to-one, best first.

    Direction: against the step before the end or after the start, cosine > -0.25 and a step change <= 6; the rank is
    distance + 2 x penalty for cosines below 0.25. The number of joins is capped at a share of the edges.
    """
    es = ends_starts(nodes, edges)
    a = es.where("kind = 'end'").select("ds", "t", F.col("node_id").alias("source_id"), "x", "y", F.col("x").alias("sx"), F.col("y").alias("sy"))
    b = es.where("kind = 'start'").select("ds", (F.col("t") - skip).alias("t"), F.col("node_id").alias("target_id"), "x", "y", F.col("x").alias("gx"), F.col("y").alias("gy"))
    pairs = within(a, b, ["ds", "t"], "x", "y", min(max_total, max_step * skip))
    pos = nodes.select(F.col("node_id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    single = lambda key, other: edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(other).alias("_id")).where("_n = 1").join(pos, "_id").select(F.col(key), "_x", "_y")
    pre = single("target_id", "source_id").select(F.col("target_id").alias("source_id"), F.col("_x").alias("px"), F.col("_y").alias("py"))
    nxt = single("source_id", "target_id").select(F.col("source_id").alias("target_id"), F.col("_x").alias("nx"), F.col("_y").alias("ny"))
    p = pairs.join(pre, "source_id", "left").join(nxt, "target_id", "left")
    c = F.col
    stepx, stepy = (c("gx") - c("sx")) / skip, (c("gy") - c("sy")) / skip
    norm = lambda x, y: F.sqrt(x * x + y * y)

    def context(ux, uy):
        n1, n2 = norm(ux, uy), norm(stepx, stepy)
        still = (n1 <= 0.01) | (n2 <= 0.01)
        cos = (ux * stepx + uy * stepy) / (n1 * n2 + 1e-9)
        ok = still | ((cos > -0.25) & (norm(ux - stepx, uy - stepy) <= 6.0))
        return F.coalesce(ok, F.lit(False)), F.when(still, 0.0).otherwise(F.coalesce(F.greatest(0.25 - cos, F.lit(0.0)), F.lit(0.0)))

    okp, penp = context(c("sx") - c("px"), c("sy") - c("py"))
    okn, penn = context(c("nx") - c("gx"), c("ny") - c("gy"))
    p = p.where(okp | okn).withColumn("rank_cost", F.round(c("distance") + 2.0 * (penp + penn), 9))
    links = link_greedy(cut_lineage(p.select("ds", "t", "source_id", "target_id", "distance", "rank_cost")), "rank_cost")
    cap = max(1, round(edges.count() * max_share))
    ranked = numbered(links, [], F.col("rank_cost"), ["rank_cost", "source_id", "target_id"], "_rn", limit)
    return ranked.where(F.col("_rn") <= cap).drop("_rn")


def node_match(pred: DataFrame, true: DataFrame, radius: float = 7.0) -> DataFrame:
    """One-to-one match of predicted to true nodes per frame within the radius, nearest pairs first."""
    a = pred.select("ds", "t", F.col("node_id").alias("source_id"), "x", "y")
    b = true.select("ds", "t", F.col("node_id").alias("target_id"), "x", "y")
    pairs = within(a, b, ["ds", "t"], "x", "y", radius).select("source_id", "target_id", "distance")
    out = link_greedy(cut_lineage(pairs), "distance")
    return out.select(F.col("source_id").alias("pred_id"), F.col("target_id").alias("true_id"), "distance")


def edge_scores(pred_edges: DataFrame, true_edges: DataFrame, match: DataFrame, n_pred: int, n_true: int, a: float = 0.1) -> DataFrame:
    """TP, FP, FN edges, Jaccard and Jaccard adjusted for a surplus of predicted nodes."""
    ms, mt = match.select(F.col("pred_id").alias("source_id"), F.col("true_id").alias("ms")), match.select(F.col("pred_id").alias("target_id"), F.col("true_id").alias("mt"))
    te = true_edges.select(F.col("source_id").alias("ms"), F.col("target_id").alias("mt"), F.lit(1).alias("_tp"))
    outs = true_edges.select(F.col("source_id").alias("ms"), F.lit(1).alias("_out")).distinct()
    ins = true_edges.select(F.col("target_id").alias("mt"), F.lit(1).alias("_in")).distinct()
    j = pred_edges.select("source_id", "target_id").distinct().join(ms, "source_id", "left").join(mt, "target_id", "left")
    j = j.join(te, ["ms", "mt"], "left").join(outs, "ms", "left").join(ins, "mt", "left")
    tp = F.col("_tp").isNotNull()
    fp = ~tp & (F.col("_in").isNotNull() | F.col("_out").isNotNull())
    total = true_edges.select("source_id", "target_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    one = j.agg(F.sum(tp.cast("int")).alias("tp"), F.sum(fp.cast("int")).alias("fp")).withColumn("fn", total - F.col("tp"))
    jac = F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    out = one.withColumn("jaccard", F.coalesce(jac, F.lit(0.0)))
    return out.withColumn("adjusted", F.greatest(F.col("jaccard") * (1.0 - F.lit(a) * (n_pred - n_true) / n_true), F.lit(0.0)))


def forks(edges: DataFrame) -> DataFrame:
    """Nodes with two or more successors."""
    return edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children")).where("children >= 2")


def descendants(start: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node): the nodes of ``start`` and all nodes reached from them along the edges.

    Where every node has one source, the steps double: a node gets what its ancestor 1, 2, 4, ... steps back was reached
    by, so the rounds grow with the logarithm of the longest lineage. Other edges are walked one step a round.
    """
    e = cut_lineage(edges.select(F.col("source_id").alias("back"), F.col("target_id").alias("node")).where("back <> node").distinct())
    start = cut_lineage(start.select(*keys, "node").distinct())
    left, single = e.agg(F.count(F.lit(1)), F.countDistinct("node")).first()
    if left == single:
        step, reach = e, start
        while left:
            reach = reach.unionByName(cut_lineage(step.join(reach.withColumnRenamed("node", "back"), "back").select(*keys, "node")))
            step = cut_lineage(step.join(step.select(F.col("node").alias("back"), F.col("back").alias("_b")), "back").select(F.col("_b").alias("back"), "node"))
            last, left = left, step.count()
            if left == last:  # fewer nodes have an ancestor twice as far, unless edges run in a circle
                break
        else:
            return reach
    front = reach = start
    while True:
        front = front.join(e.select(F.col("back").alias("node"), F.col("node").alias("_n")), "node").select(*keys, F.col("_n").alias("node")).distinct()
        front = cut_lineage(front.join(reach, [*keys, "node"], "left_anti"))
        if front.isEmpty():
            return reach
        reach = reach.unionByName(front)


def fork_confusion(pred_edges: DataFrame, true_edges: DataFrame, match: DataFrame, pred_comp: DataFrame) -> DataFrame:
    """TP, FP, FN divisions: the two child lineages of a true division and its anchor must meet in one forked component."""
    tf = forks(true_edges).select(F.col("node_id").alias("src"))
    kids = true_edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("kid")).join(tf, "src")
    two = kids.groupBy("src").agg(F.slice(F.array_sort(F.collect_set("kid")), 1, 2).alias("k")).select("src", F.posexplode("k").alias("side", "node"))
    reach = descendants(two, true_edges, ["src", "side"])
    tp_ = match.select(F.col("true_id").alias("node"), F.col("pred_id"))
    comp = stored(pred_comp.select(F.col("node_id").alias("pred_id"), "component"))
    hit = reach.join(tp_, "node").join(comp, "pred_id").select("src", "side", "component").distinct()
    both = hit.groupBy("src", "component").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("src", "component")
    parent = true_edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("node")).join(tf, "src")
    anchors = tf.select("src", F.col("src").alias("node")).unionByName(parent).join(tp_, "node").join(comp, "pred_id").select("src", "component").distinct()
    pf = forks(pred_edges).select(F.col("node_id").alias("pred_id"))
    forked = pf.join(comp, "pred_id").select("component").distinct()
    good = cut_lineage(both.join(anchors, ["src", "component"]).join(forked, "component").select("src").distinct())
    n = lambda d: d.agg(F.count(F.lit(1)).alias("n")).scalar()
    has_out = true_edges.select(F.col("source_id").alias("node")).distinct()
    fp = pf.join(match, "pred_id").select(F.col("true_id").alias("node")).join(has_out, "node", "left_semi").join(good.select(F.col("src").alias("node")), "node", "left_anti")
    one = tf.agg(F.count(F.lit(1)).alias("_all")).select("_all", n(good).alias("tp"), n(fp).alias("fp"))
    return one.select("tp", "fp", (F.col("_all") - F.col("tp")).alias("fn"))


