"""Near copies by 64-bit similarity fingerprints, found with the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, all four-word shingles with repeats, XXH64 (seed 42) of
each; a bit is 1 if more than half of the hashes have it. Texts of fewer words are one shingle, texts without words
(null, empty, blank) have fingerprint zero and are linked like any other.

Search for pairs that differ in at most ``MOST`` bits:

1. Equal fingerprints form one class; only classes are compared.
2. Correlated bits are grouped into partitions of nearly equal width. If partition i gets threshold t_i and the
   thresholds add up to ``MOST - partitions + 1``, every pair within ``MOST`` bits is within t_i in some partition i
   (t_i = -1: never probed). Number of partitions and thresholds come from a dynamic programme over estimated probe and
   candidate counts; the bit statistics cover all classes.
3. A fingerprint is indexed by its value in each partition and probes all values within t_i; hits are verified on all
   64 bits. First each index value links its members to its smallest one; those links are contracted to groups.
   The full probe then only returns links between different groups, so a dense group never emits all its pairs.

Repeated rows keep their rows; null identifiers take part through their class but cannot be its representative.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import saved

MOST = 4  # bits in which linked fingerprints differ at most
SHINGLE = 4  # words
SEED = 42
PIECE = 1 << 14  # hashes whose bits are counted at once


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number; memory beyond the words stays bounded."""
    words = (text or "").encode().lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones = np.zeros(64, "i8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, n, PIECE):
        h = np.array([digest(join(words[i : i + SHINGLE]), SEED) for i in range(lo, min(n, lo + PIECE))], ">u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long of the same bits."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column("t")], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return base.mapInArrow(run, "doc_id long, fp long")


def bit_products(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((64, 64))
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype("i8")
            x = ((fp[:, None] >> np.arange(64)) & 1).astype("f4")
            n += len(fp)
            total += x.T @ x
        i, j = np.nonzero(np.ones((64, 64)))
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j]), pa.array(np.full(4096, n))], names=["k", "s", "n"])

    rows = classes.select("fp").mapInArrow(run, "k long, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out, n = np.zeros(4096), 0
    for r in rows:
        out[r["k"]], n = r["s"], r["n"]
    return n, out.reshape(64, 64)


def bit_groups(n: int, products: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into groups of nearly equal size, the most correlated ones together."""
    if n < 2:
        corr = np.eye(64)
    else:
        p = np.diag(products) / n
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        corr = np.abs((products / n - np.outer(p, p)) / np.outer(sd, sd))
    sizes = [64 // parts + (i < 64 % parts) for i in range(parts)]
    left, groups = set(range(64)), []
    for size in sizes:
        rest = sorted(left)
        sub = corr[np.ix_(rest, rest)] - np.eye(len(rest)) * 2
        group = [rest[int(sub.sum(1).argmax())]]
        left.discard(group[0])
        while len(group) < size:
            rest = sorted(left)
            best = rest[int(corr[np.ix_(rest, group)].sum(1).argmax())]
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def within_share(p: np.ndarray, t: int) -> float:
    """Share of random pairs that differ in at most t of the bits with set shares p."""
    dist = np.zeros(t + 2)
    dist[0] = 1.0
    for q in 2 * p * (1 - p):
        moved = dist * q
        dist = dist * (1 - q)
        dist[1:] += moved[:-1]
    return float(dist[: t + 1].sum()) if t >= 0 else 0.0


def plan(n: int, products: np.ndarray, most: int = MOST) -> list[tuple[list[int], int]]:
    """(bits, threshold) per partition: the cheapest over numbers of partitions, thresholds by dynamic programming.

    Cost of threshold t in a partition: one unit per probe row, a tenth per candidate pair.
    """
    share = np.diag(products) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, most + 2):
        groups = bit_groups(n, products, parts)
        total = most - parts + 1
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            new: dict[int, tuple[float, list[int]]] = {}
            for done, (cost, ts) in state.items():
                for t in range(-1, most + 1):
                    ball = sum(comb(len(g), i) for i in range(t + 1))
                    if ball > 3000:
                        break
                    c = cost + n * ball + 0.1 * n * n / 2 * within_share(share[g], t)
                    if done + t not in new or c < new[done + t][0]:
                        new[done + t] = (c, [*ts, t])
            state = new
        if total in state and (best is None or state[total][0] < best[0]):
            best = (state[total][0], list(zip(groups, state[total][1])))
    return best[1]


def value(fp: Column, bits: list[int]) -> Column:
    """The chosen bits of a fingerprint side by side."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def masks(width: int, t: int) -> list[int]:
    """All patterns of so many bits with at most t ones."""
    out, layer = [0], [(0, -1)]
    for _ in range(max(t, 0)):
        layer = [(m | 1 << i, i) for m, last in layer for i in range(last + 1, width)]
        out += [m for m, _ in layer]
    return out


def keys(classes: DataFrame, parts: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """One row per fingerprint, partition and index value (or probed value)."""
    fp = F.col("fp")
    cells = []
    for i, (bits, t) in enumerate(parts):
        if t < 0:
            continue
        v = value(fp, bits)
        near = [v.bitwiseXOR(F.lit(m).cast("long")) for m in (masks(len(bits), t) if probe else [0])]
        cells += [F.struct(F.lit(i).alias("part"), x.alias("v")) for x in near]
    return classes.withColumn("k", F.explode(F.array(*cells))).select("k.part", "k.v", *classes.columns)


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (a, b) between representatives that join all linked classes; not all linked pairs (see module)."""
    n, products = bit_products(classes)
    parts = plan(n, products, most)
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= most
    index = keys(classes, parts, False)
    hubs = index.groupBy("part", "v").agg(F.min(F.struct("rep", "fp")).alias("h"), F.count("*").alias("n")).where("n > 1")
    hubs = saved(hubs.select("part", "v", F.col("h.rep").alias("a"), F.col("h.fp").alias("afp")), "hubs")
    first = index.join(hubs, ["part", "v"]).where((F.col("rep") != F.col("a")) & near("fp", "afp"))
    first = saved(first.select("a", F.col("rep").alias("b")), "links")
    groups = components(first)
    c = classes.join(groups.withColumnRenamed("vertex", "rep"), "rep", "left")
    c = saved(c.select("rep", "fp", F.coalesce("component", "rep").alias("g")), "classes")
    left = keys(c, parts, True).select("part", "v", F.col("fp").alias("afp"), F.col("g").alias("a"))
    right = keys(c, parts, False).select("part", "v", F.col("fp").alias("bfp"), F.col("g").alias("b"))
    rest = left.join(right, ["part", "v"]).where((F.col("afp") < F.col("bfp")) & (F.col("a") != F.col("b")) & near("afp", "bfp"))
    return first.unionByName(rest.select("a", "b"))


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest identifier reachable."""
    fps = saved(fingerprints(docs, text, doc_id), "fingerprints")
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    groups = components(links(classes.where("rep IS NOT NULL"), most)).withColumnRenamed("vertex", "rep")
    named = saved(classes.join(groups, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
