"""Neighbours in the plane: range joins on grid cells, k nearest neighbours, imputation from neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.ordered import join_keys, quantiles
from quern.session import cut_lineage, stored


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size)))


def around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """One row per cell of the 3 x 3 block around each point."""
    step = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    out = df.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    return out.withColumns({"_cx": cell(F.col(x), size) + F.col("_dx"), "_cy": cell(F.col(y), size) + F.col("_dy")}).drop("_dx", "_dy")


def touched(df: DataFrame, x: str, y: str, size: float, radius: float) -> DataFrame:
    """One row per cell that the square of half side ``radius`` around each point touches."""

    def span(c: str) -> Column:
        # a little wider than the radius: the last bit of a difference must not lose a pair
        r = F.lit(float(radius)) + (F.abs(c) + F.lit(float(radius))) * F.lit(1e-12)
        return F.explode(F.sequence(cell(F.col(c) - r, size), cell(F.col(c) + r, size)))

    return df.withColumn("_cx", span(x)).withColumn("_cy", span(y))


def within(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str, radius: float) -> DataFrame:
    """Pairs of rows of two frames (other column names distinct) with equal keys and distance <= radius.

    Points meet through grid cells of twice the radius, so only nearby points are ever compared and a point of ``a``
    is sent to four cells, rarely more. The planner does not count these copies: left alone, it would broadcast
    them by the size of the frame before them, so the join asks for a shuffle.
    """
    size = 2.0 * radius
    left = touched(a.withColumns({"_ax": F.col(x), "_ay": F.col(y)}).drop(x, y), "_ax", "_ay", size, radius).hint("merge")
    right = b.withColumns({"_bx": F.col(x), "_by": F.col(y)}).drop(x, y).withColumns({"_cx": cell(F.col("_bx"), size), "_cy": cell(F.col("_by"), size)})
    d = F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), 2) + F.pow(F.col("_ay") - F.col("_by"), 2))
    return left.join(right, [*keys, "_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_cx", "_cy", "_ax", "_ay", "_bx", "_by")


def gate(nodes: DataFrame, ds: str, t: str, node: str, x: str, y: str, radius: float, frames: int = 1) -> DataFrame:
    """Pairs of points ``frames`` frames apart within a distance: (ds, t, source_id, target_id, distance)."""
    a = nodes.select(ds, t, F.col(node).alias("source_id"), x, y)
    b = nodes.select(ds, (F.col(t) - frames).alias(t), F.col(node).alias("target_id"), x, y)
    return within(a, b, [ds, t], x, y, radius).select(ds, t, "source_id", "target_id", "distance")


FANOUT = 2  # bits by which the cells of one level of the search tree are split in each direction
DEEPEST = 40  # bits of the smallest cells


def _tree(r: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their leaf (_d bits, _cx, _cy), and the cells of each level (keys, _cx, _cy, n, box, _leaf, parent).

    Cells are split until they hold ``most`` points at most; boxes are those of the points in a cell. ``r`` has the
    numbers of the smallest cells (_ix, _iy); those of larger ones are their first bits.
    """
    levels, open_, done = [], r, None
    for bits in range(0, DEEPEST + 1, FANOUT):
        at = {c: F.shiftright(f"_i{c[-1]}", DEEPEST - bits) for c in ("_cx", "_cy")}
        up = [F.shiftright(c, FANOUT).alias(f"_p{c[-1]}") for c in ("_cx", "_cy")]
        here = open_.withColumns(at)
        box = [f(c).alias(f"{to}{c[-1]}") for c in ("_bx", "_by") for f, to in ((F.min, "_lo"), (F.max, "_hi"))]
        cells = here.groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"), *box)
        cells = stored(cells.withColumn("_leaf", (F.col("_n") <= most) | F.lit(bits == DEEPEST)).select("*", *up))
        levels.append(cells)
        spot = [*keys, "_cx", "_cy"]
        leaf = here.join(cells.where("_leaf").select(*spot), spot, "left_semi").withColumn("_d", F.lit(bits))
        done = leaf if done is None else done.unionByName(leaf)
        if cells.where("NOT _leaf").isEmpty():
            break
        open_ = stored(here.join(cells.where("NOT _leaf").select(*spot), spot, "left_semi").drop("_cx", "_cy"))
    return done.drop("_ix", "_iy"), levels


def knn(query: DataFrame, ref: DataFrame, keys: Sequence[str], x: str, y: str, k: int, qid: str, rid: str, other: tuple[str, str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """k nearest reference points per query point, exact: (qid, rid, distance, rank, carried reference columns).

    Reference points lie in a tree of cells. Queries go down level by level with the cells that may hold one of their k
    nearest: those not farther than the bound within which the cells met surely hold k points. A query far from a
    crowded place so looks at its nearest edge only. Equal reference places keep only what can be among a query's k
    nearest. ``other``: (query column, reference column) that must differ; the bound then allows for all points of the
    query's own entity.
    """
    q = query.select(*keys, F.col(qid).alias("_q"), F.col(x).alias("_ax"), F.col(y).alias("_ay"), *([F.col(other[0]).alias("_qe")] if other else []))
    r = ref.select(*keys, F.col(rid).alias("_r"), F.col(x).alias("_bx"), F.col(y).alias("_by"), *([F.col(other[1]).alias("_re")] if other else []), *carry)
    r = r.where("_bx IS NOT NULL AND _by IS NOT NULL" + (" AND _re IS NOT NULL" if other else ""))
    named = [F.col("_q").alias(qid), F.col("_r").alias(rid), "distance", "rank", *carry]
    d = F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), 2) + F.pow(F.col("_ay") - F.col("_by"), 2))
    order = Window.partitionBy("_q").orderBy("distance", "_r")

    def nearest(cand: DataFrame) -> DataFrame:
        cand = cand.where("_qe <> _re") if other else cand
        cand = cand.select("_q", "_r", d.alias("distance"), *carry).where("distance IS NOT NULL")
        return cand.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*named)

    most = max(32, k * (k + 1))
    if keys:
        largest = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= most:  # every group is one leaf
            return nearest(q.join(r, list(keys)))
    place = [*keys, "_bx", "_by"]
    top = lambda df, part, n: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy("_r"))).where(F.col("_rn") <= n).drop("_rn")
    if other:
        # k per entity at a place, then the k + 1 entities with the smallest ids there
        r = top(r, [*place, "_re"], k)
        first = F.min("_r").over(Window.partitionBy(*place, "_re"))
        r = r.withColumn("_f", first).withColumn("_rn", F.dense_rank().over(Window.partitionBy(*place).orderBy("_f", "_re"))).where(F.col("_rn") <= k + 1).drop("_f", "_rn")
    else:
        r = top(r, place, k + 1)
    r = stored(r)
    box = r.agg(F.min("_bx"), F.max("_bx"), F.min("_by"), F.max("_by")).first()
    if box[0] is None:
        return nearest(q.withColumn("_k", F.lit(0)).join(r.drop(*keys).withColumn("_k", F.lit(0)), "_k").limit(0))
    side = max(box[1] - box[0], box[3] - box[2], 1e-9) * (1 + 1e-9)
    number = lambda c, low: F.floor((F.col(c) - F.lit(float(low))) / F.lit(float(side)) * F.lit(float(1 << DEEPEST)))
    points, levels = _tree(r.withColumns({"_ix": number("_bx", box[0]), "_iy": number("_by", box[2])}), keys, most)
    if other:
        own = r.groupBy(*keys, F.col("_re").alias("_qe")).agg(F.count(F.lit(1)).alias("_own"))
        q = q.join(own, [*keys, "_qe"], "left")
    q = stored(q.withColumn("_need", F.lit(k) + (F.coalesce("_own", F.lit(0)) if other else F.lit(0))).drop("_own").where("_ax IS NOT NULL AND _ay IS NOT NULL"))
    off = lambda a, c, f: f(F.abs(F.col(a) - F.col(f"_lo{c}")), F.abs(F.col(a) - F.col(f"_hi{c}")))
    out_of = lambda a, c: F.when(F.col(a).between(F.col(f"_lo{c}"), F.col(f"_hi{c}")), 0.0).otherwise(off(a, c, F.least))
    far = F.sqrt(F.pow(off("_ax", "x", F.greatest), 2) + F.pow(off("_ay", "y", F.greatest), 2)) * (1 + 1e-12)
    near = F.sqrt(F.pow(out_of("_ax", "x"), 2) + F.pow(out_of("_ay", "y"), 2)) * (1 - 1e-12)
    me = ["_q", "_ax", "_ay", "_need", *keys]
    by_far = Window.partitionBy(*me)
    cell_cols = ["_d", "_cx", "_cy", "_leaf", "_near", "_far", "_n"]

    def kept(front: DataFrame) -> DataFrame:
        """The rows not beyond the bound of their query, written."""
        held = F.sum("_n").over(by_far.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0))
        reach = F.min(F.when(F.col("_held") >= F.col("_need"), F.col("_far"))).over(by_far)
        front = front.withColumn("_held", held).withColumn("_reach", reach)
        return stored(front.where(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach"))).drop("_held", "_reach"))

    own_cols = ["_qe"] if other else []
    front = None
    for i, cells in enumerate(levels):
        now = cells.withColumn("_d", F.lit(i * FANOUT))
        if front is None:
            met = q.join(now, list(keys)) if keys else q.crossJoin(now)  # one cell without keys
            front = met.withColumns({"_near": near, "_far": far}).select(*me, *own_cols, *cell_cols)
        else:
            inner = front.where("NOT _leaf").select(*me, *own_cols, F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
            met = inner.join(now, [*keys, "_px", "_py"]).withColumns({"_near": near, "_far": far}).select(*me, *own_cols, *cell_cols)
            front = front.where("_leaf").unionByName(met)
        front = kept(front)
    return nearest(front.select(*me, *own_cols, "_d", "_cx", "_cy").join(points, [*keys, "_d", "_cx", "_cy"]))


def idw(neighbours: DataFrame, qid: str, value: str, eps: float = 1e-3) -> DataFrame:
    """Inverse-distance mean and spread and the nearest distance."""
    w = 1.0 / (F.col("distance") + eps)
    out = neighbours.groupBy(qid).agg(
        F.sum(w).alias("_w"), F.sum(w * F.col(value)).alias("_s"), F.sum(w * F.col(value) * F.col(value)).alias("_ss"), F.min("distance").alias("nearest")
    )
    mean = F.col("_s") / F.col("_w")
    return out.select(qid, mean.alias("idw_mean"), F.sqrt(F.greatest(F.col("_ss") / F.col("_w") - mean * mean, F.lit(0.0))).alias("idw_std"), "nearest")


def plane(neighbours: DataFrame, query: DataFrame, qid: str, x: str, y: str, nx: str, ny: str, value: str, eps: float = 1e-3) -> DataFrame:
    """Weighted local plane a x + b y + c from the neighbours, evaluated at the query point.

    Coordinates are taken relative to the query point, so the value there is the plane's constant (Cramer's rule).
    """
    j = neighbours.join(query.select(qid, F.col(x).alias("_qx"), F.col(y).alias("_qy")), qid)
    w, u, v, z = 1.0 / (F.col("distance") + eps), F.col(nx) - F.col("_qx"), F.col(ny) - F.col("_qy"), F.col(value)
    s = {"w": w, "u": w * u, "v": w * v, "uu": w * u * u, "uv": w * u * v, "vv": w * v * v, "z": w * z, "uz": w * u * z, "vz": w * v * z}
    out = j.groupBy(qid).agg(*[F.sum(e).alias(f"_{n}") for n, e in s.items()], F.count(F.lit(1)).alias("n"))
    c = {n: F.col(f"_{n}") for n in s}
    ridge = 1e-9
    a, b, d = c["uu"] + ridge, c["vv"] + ridge, c["w"] + ridge
    det = a * (b * d - c["v"] * c["v"]) - c["uv"] * (c["uv"] * d - c["v"] * c["u"]) + c["u"] * (c["uv"] * c["v"] - b * c["u"])
    num = a * (b * c["z"] - c["vz"] * c["v"]) - c["uv"] * (c["uv"] * c["z"] - c["vz"] * c["u"]) + c["uz"] * (c["uv"] * c["v"] - b * c["u"])
    # three points in a line leave the plane undefined: fall back to the weighted mean
    return out.select(qid, "n", F.when(F.abs(det) > 1e-9 * a * b * d, num / F.nullif(det, F.lit(0.0))).otherwise(c["z"] / d).alias("plane_value"))


def resample(df: DataFrame, entity: str, pos: str, x: str, y: str, uid: str, points: int = 25, limit: int | None = None) -> DataFrame:
    """Path of each entity at equally spaced normalised positions: (entity, i, x, y)."""
    from quern.operators.series import nearest_grid

    ends = df.groupBy(entity).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    rows = join_keys(df, ends, [entity]).withColumn("_f", (F.col(pos) - F.col("_lo")) / F.coalesce(F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(1.0)))
    at = ends.select(entity, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("_f", F.col("i") / F.lit(float(points - 1)))
    a = nearest_grid(at, rows.select(entity, "_f", F.col(x).alias("_y")), [entity], "_f", "_y", "i", limit).select(entity, "i", F.col("interp").alias(x))
    b = nearest_grid(at, rows.select(entity, "_f", F.col(y).alias("_y")), [entity], "_f", "_y", "i", limit).select(entity, "i", F.col("interp").alias(y))
    return a.join(b, [entity, "i"])


def path_rank(paths: DataFrame, heading: DataFrame, entity: str, x: str, y: str, radius: float, points: int = 25, queries: DataFrame | None = None) -> DataFrame:
    """Other entities whose resampled path has a median point distance <= radius, same direction first.

    ``queries``: entities to search for (all, if not given); they are held against all entities.

    A median within the radius needs more than half of the points within it, so a pair has one near point at least
    among any ``points - points // 2`` of them. Every other point goes through the range join with its whole path
    beside it; a pair counts at the first of those points that is near, so it arises once and is judged where it arises.
    """
    some = list(range(0, points, 2))
    flat = lambda e, sx, sy: paths.groupBy(F.col(entity).alias(e)).agg(
        *[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{to}{i}") for i in range(points) for c, to in ((x, sx), (y, sy))]
    )
    a, b = flat("a", "_px", "_py"), flat("b", "_qx", "_qy")
    if queries is not None:
        a = a.join(queries.select(F.col(entity).alias("a")).distinct(), "a", "left_semi")
    spread = lambda d, sx, sy: d.withColumn(
        "_at", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"{sx}{i}").alias("x"), F.col(f"{sy}{i}").alias("y")) for i in some]))
    ).select("*", "_at.*").drop("_at")
    dist = lambda i: F.sqrt(F.pow(F.col(f"_px{i}") - F.col(f"_qx{i}"), 2) + F.pow(F.col(f"_py{i}") - F.col(f"_qy{i}"), 2))
    near = within(spread(a, "_px", "_py"), spread(b, "_qx", "_qy"), ["i"], "x", "y", radius).where("a <> b")
    first = F.lit(None)
    for i in reversed(some):
        first = F.when(dist(i) <= radius, F.lit(i)).otherwise(first)
    near = near.where(F.col("i") == first).select("a", "b", F.sort_array(F.array(*[dist(i) for i in range(points)])).alias("_d"))
    # distances of missing points are null and come first
    known = F.size(F.filter("_d", lambda d: d.isNotNull()))
    close = F.size(F.filter("_d", lambda d: d <= radius))
    near = near.withColumn("_n", known).where(close >= points // 2 + 1)
    pick = lambda n: F.element_at("_d", (points - F.col("_n") + n).cast("int"))
    low, high = pick(F.floor((F.col("_n") + 1) / 2)), pick(F.floor(F.col("_n") / 2) + 1)
    med = near.select("a", "b", F.when(low == high, low).otherwise((low + high) / 2).alias("distance"))
    ha, hb = heading.select(F.col(entity).alias("a"), F.col("direction").alias("_da")), heading.select(F.col(entity).alias("b"), F.col("direction").alias("_db"))
    out = med.join(ha, "a").join(hb, "b").withColumn("same_direction", (F.col("_da") == F.col("_db")).cast("int")).drop("_da", "_db")
    w = Window.partitionBy("a").orderBy(F.desc("same_direction"), F.round("distance", 9), "b")
    return out.withColumn("rank", F.row_number().over(w))


def cluster_folds(df: DataFrame, entity: str, x: str, y: str, clusters: int = 12, folds: int = 4, seed: int = 0) -> DataFrame:
    """k-means clusters of entity positions kept whole, dealt to folds largest first into the smallest fold."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=[x, y], outputCol="_v").transform(df.select(entity, x, y))
    lab = KMeans(k=clusters, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).select(entity, "cluster")
    lab = cut_lineage(lab)
    load, where = [0] * folds, {}
    for r in sorted(lab.groupBy("cluster").count().collect(), key=lambda r: (-r["count"], r["cluster"])):  # one row per cluster
        i = load.index(min(load))
        where[r["cluster"]], load[i] = i, load[i] + r["count"]
    m = F.create_map(*[F.lit(x) for kv in where.items() for x in kv])
    return lab.withColumn("fold", m[F.col("cluster")])


def anchor_transfer(target: DataFrame, reference: DataFrame, choice: DataFrame, entity: str, uid: str, pos: str, correction: str, limit: int | None = None) -> DataFrame:
    """Correction curve of each target's chosen neighbour at the target's own positions, 0 at the anchor.

    ``choice``: (entity, ref). All targets of one reference share one interpolation over its curve.
    """
    from quern.operators.series import nearest_grid

    pts = target.join(choice, entity).select("ref", uid, entity, pos)
    zero = reference.select(entity).distinct().select(F.col(entity).alias("ref"), F.lit(0.0).alias(pos), F.lit(0.0).alias(correction))
    curve = reference.select(F.col(entity).alias("ref"), F.col(pos).cast("double").alias(pos), correction).where(F.col(pos) > 0).unionByName(zero)
    got = nearest_grid(pts, curve, ["ref"], pos, correction, uid, limit)
    return got.select(entity, uid, "ref", F.when(F.col(pos) <= 0, 0.0).otherwise(F.col("interp")).alias("transferred"))


def spacing(nodes: DataFrame, ds: str, t: str, node: str, x: str, y: str, k: int = 3, default: float = 10.0, limit: int | None = None) -> DataFrame:
    """Median distance to the k nearest points of the same frame; a default when alone."""
    near = knn(nodes, nodes.withColumn("_id2", F.col(node)), [ds, t], x, y, k, node, "_id2", other=(node, node))
    med = quantiles(near, [node], {"spacing": ("distance", 0.5)}, limit, None)  # k rows a node: no group is large
    return nodes.select(node).join(med, node, "left").withColumn("spacing", F.coalesce("spacing", F.lit(default)))
