"""Near-duplicate embeddings by collision counting over many one-dimensional projections.

Vectors are normalised and projected on Gaussian directions. Two vectors collide in a projection when one lies in the
window of half-width ``REACH`` standard deviations centred on the other, the deviation being that of a pair at exactly
the wanted cosine. Pairs whose number of collisions reaches a count calibrated for recall are verified by the exact
cosine in double precision.

Where to look: the projections form compound tables; each table sorts the vectors of a label into cells of its
projections, and pairs are counted where they share a cell. The number of projections per table grows with the
logarithm of the label's own size, so the load of a cell stays level, and the number of tables grows with it, so that a
pair at the wanted cosine shares a cell with probability ``FOUND`` in a label of any size. A pair that shares cells in
several tables is counted in the first. Cells with more than ``TILE`` vectors are dealt into blocks and compared block against block.
Tiles return link counts per vector and a spanning forest, never their pairs.

Equal vectors of a label are one class with a size. Vectors that are null, zero, or hold null or non-finite
components, rows without a label or identifier, link with nothing; vectors of different length never link. Repeated
rows count as other vectors.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, comb, erf, log, log1p, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import saved

COSINE = 0.93
TABLES = 8  # at least
MOST_PER = 24  # projections of a table
FOUND = 0.99  # of pairs at the wanted cosine, by a shared cell in some table
COUNTED = 192  # projections whose collisions are counted, at most
REACH = 2.0  # half-width of the window in deviations of a pair at the wanted cosine
CELL = 4.0  # width of a cell in the same deviations
LOAD = 128  # vectors wanted in a cell
TILE = 1000
RECALL = 0.999  # of pairs at the wanted cosine, by the collision count alone
SEED = 5


def deviation(cosine: float) -> float:
    """Standard deviation of the projected difference of two unit vectors at this cosine."""
    return sqrt(2 - 2 * cosine)


def same_cell(c: float) -> float:
    """Probability that a pair shares the cell of one projection, whose width is c deviations of the pair."""
    return erf(c / sqrt(2)) - 2 / (sqrt(2 * np.pi) * c) * (1 - np.exp(-c * c / 2))


def per_table(n: int, cosine: float = COSINE) -> int:
    """Projections per table for labels of at most n vectors."""
    same = same_cell(CELL * deviation(cosine) / sqrt(2))  # a random pair's deviation is sqrt(2)
    return max(2, min(MOST_PER, round(log(max(n, 1) / LOAD) / -log(same)))) if n > LOAD else 2


def tables_for(per: int) -> int:
    """Tables of so many projections in which a pair at the wanted cosine shares a cell with probability ``FOUND``."""
    return max(TABLES, ceil(log(1 - FOUND) / log1p(-same_cell(CELL) ** per)))


def sizes_of_per(cosine: float) -> list[int]:
    """Smallest label that takes 3, 4, ... ``MOST_PER`` projections per table."""
    return [bisect_left(range(1 << 62), per, key=lambda n: per_table(n, cosine)) for per in range(3, MOST_PER + 1)]


def least_count(total: int, reach: float = REACH, recall: float = RECALL) -> int:
    """Largest count that pairs at the wanted cosine reach with the given probability."""
    p = erf(reach / sqrt(2))
    tail, c = 0.0, total + 1
    while tail < recall and c > 0:
        c -= 1
        tail += comb(total, c) * p**c * (1 - p) ** (total - c)
    return c


def projected(x: np.ndarray, total: int) -> np.ndarray:
    """Unit vectors (n, dim) on all directions (n, total); the directions depend on the dimension only."""
    return x @ np.random.default_rng([SEED, x.shape[1]]).normal(size=(x.shape[1], total))


def unit(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    x = np.stack([np.asarray(v, "f8") for v in column]).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells_of(p: np.ndarray, per: int, cosine: float) -> np.ndarray:
    """Cell number (hashed) of each vector in each table."""
    grid = np.floor(p / (CELL * deviation(cosine))).astype("i8").reshape(len(p), -1, per)
    h = np.full(grid.shape[:2], 1469598103934665603, "i8").view("u8")
    for k in range(per):
        h = (h ^ (grid[:, :, k].view("u8") + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return h.view("i8")


def spread(classes: DataFrame, cosine: float) -> DataFrame:
    """One row per class and table: where it is looked for."""
    kind = classes.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sort = np.array([batch.column("dim"), batch.column("per")]).T
            for dim, per in np.unique(sort, axis=0).tolist():
                at = np.flatnonzero((sort == (dim, per)).all(1))
                part = batch.take(pa.array(at))
                tables = tables_for(per)
                cells = cells_of(projected(unit(part.column("embedding").to_pylist(), dim), tables * per), per, cosine)
                for t in range(tables):
                    extra = [pa.array(np.full(len(at), t, "i4")), pa.array(cells[:, t])]
                    yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "t", "cell"])

    return classes.mapInArrow(run, f"label string, embedding {kind}, dim int, rep long, m long, per int, t int, cell long")


def tile(cosine: float):
    """Compares the vectors of one tile; rows (rep, n, other): linked vectors, and an edge of the spanning forest."""
    reach = REACH * deviation(cosine)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, i, j = int(pdf["t"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values("rep", ignore_index=True)
        x = unit(pdf["embedding"], int(pdf["dim"].iloc[0]))
        per = int(pdf["per"].iloc[0])
        p = projected(x, tables_for(per) * per)
        cells = cells_of(p, per, cosine)
        total = min(p.shape[1], COUNTED)
        least = least_count(total)
        p = np.ascontiguousarray(p[:, :total].T, "f4")
        rep, m, block = pdf["rep"].to_numpy(), pdf["m"].to_numpy(), pdf["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros(len(pdf), "i8")
        root = np.arange(len(pdf))
        pairs = []
        for lo in range(0, len(left), 256):
            a = left[lo : lo + 256]
            hits = np.zeros((len(a), len(right)), "u1")
            for k in range(total):
                hits += np.abs(p[k, a][:, None] - p[k, right][None, :]) <= reach
            ok = hits >= least
            for u in range(t):
                ok &= cells[a, u][:, None] != cells[right, u][None, :]
            if i == j:
                ok &= a[:, None] < right[None, :]
            ai, bi = np.nonzero(ok)
            ai, bi = a[ai], right[bi]
            near = np.concatenate([np.einsum("nd,nd->n", x[ai[s : s + 50_000]], x[bi[s : s + 50_000]]) for s in range(0, len(ai), 50_000)] or [np.zeros(0)]) >= cosine
            ai, bi = ai[near], bi[near]
            np.add.at(links, ai, m[bi])
            np.add.at(links, bi, m[ai])
            pairs.append((ai, bi))
        ai, bi = (np.concatenate(c) for c in zip(*pairs)) if pairs else (root[:0], root[:0])
        while True:  # smallest row reachable inside the tile
            low = np.minimum(root[ai], root[bi])
            new = root.copy()
            np.minimum.at(new, ai, low)
            np.minimum.at(new, bi, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"rep": rep[some], "n": links[some], "other": rep[root[some]]})

    return run


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    v = v.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good, F.lit(False)))
    usable = v.where("ok").withColumn("dim", F.size("embedding"))
    classes = saved(usable.groupBy("label", "embedding", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes")
    # only labels that take more than two projections are looked up: each has more than LOAD vectors
    steps = sizes_of_per(cosine)
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") >= steps[0])
    pers = saved(sizes.select("label", "dim", sum(((F.col("n") >= n).cast("int") for n in steps), F.lit(2)).alias("per")), "pers")
    sized = classes.join(pers, ["label", "dim"], "left").withColumn("per", F.coalesce("per", F.lit(2)))
    placed = saved(spread(sized.select(*classes.columns, "per"), cosine), "placed")
    key = ["label", "dim", "t", "cell"]
    full = saved(placed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int")).drop("n"), "cells")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    near = placed.join(full, key).withColumn("block", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = near.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "blocks")
    found = saved(near.groupBy(*key, "i", "j").applyInPandas(tile(cosine), "rep long, n long, other long"), "found")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = components(found, "rep", "other").withColumnRenamed("vertex", "rep")
    named = classes.join(counts, "rep", "left").join(groups, "rep", "left")
    named = saved(named.select("label", "embedding", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    good_rows = usable.select("label", "embedding", "vec_id").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = v.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good_rows.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
