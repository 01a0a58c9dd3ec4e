"""Near copies by word similarity: long fingerprints, the generalised pigeonhole with a stated recall, exact check.

Linked are texts whose sets of five-word shingles (A-Z lower-cased, words as in ``simhash``) have a Jaccard similarity
of at least ``SIMILARITY``. Texts of fewer words are one shingle; texts without words (null, empty, blank) are alike.
Two texts at that similarity differ in a share of at most acos(2 s / (1 + s)) / pi of the bits of a fingerprint (0.151
at 0.8; derived for many shingles, texts of few shingles differ in somewhat more).

1. Equal shingle sets form one class, known by a 64-bit hash of the set; only classes are compared. A fingerprint has
   as many 64-bit words as the plan below needs; each bit is the majority of that bit over mixed shingle hashes.
2. Correlated bits of a word are grouped into partitions a little wider than log2 of the classes. Each partition gets
   threshold -1 (not probed), 0 or 2; a dynamic programme finds the cheapest thresholds, by estimated rows and
   candidates, with which a pair at ``SIMILARITY`` meets in some partition with probability ``RECALL``. A bound on all
   bits together would need thresholds whose candidates grow with the square of the classes.
3. Classes that share a cell and differ little in one further word are candidates; that bound is passed with 0.998.
   Each class is first checked against its nearest cell minimum, then against the minima of its other cells that are
   in other groups; the links found are contracted each time. Only then are all candidates between different groups
   checked: a group of close texts is one by then and does not emit its pairs. Whole fingerprints that differ in too
   many bits end a check early.
4. Texts that share long passages without reaching ``SIMILARITY`` still crowd cells. Cells of more than ``CROWD``
   classes in different groups emit no pairs; all their classes are compared through their rarest shingles instead: two
   similar sets share one of them, at places that leave room for the overlap needed. That search is exact, so it loses
   no pair, and texts that differ in their rare shingles never meet. Before it, each of these classes is checked
   against the centre of the largest other group at each of its rare shingles, and the links found are contracted:
   else the stragglers of a large group of close texts would each meet all of its members.
   A check compares the shingle sets themselves: no pair below ``SIMILARITY`` is linked.

Rows with equal identifier and text are one row; different texts of one identifier, and rows without one, are judged by
themselves. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.components import components
from quern.llm.shared import saved

SHINGLE = 5  # words
SIMILARITY = 0.8
RECALL = 0.92  # of pairs at exactly that similarity; more similar ones are found more surely
CHECKED = 0.998  # share of such pairs that pass the bound on the further word
NARROWEST, WIDEST = 16, 32  # bits of a partition
MARGIN = 0.03  # added to the share of differing bits that a whole fingerprint may have, for texts of few shingles
SPARE = 1.1  # partitions to choose from, relative to the number needed
STEPS = 500  # of the dynamic programme
ROWS = 255  # hashes whose bits are counted at once, in bytes
CROWD = 16  # classes of different groups in one cell, above which rare shingles are compared instead
LISTED = 1 << 16  # most frequent shingles that every task knows, 1 MB
THRESHOLDS = {-1: None, 0: 0, 2: 1}  # bits apart: radius in which both sides write cells


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    n = max(len(words) - SHINGLE + 1, 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(words[i : i + SHINGLE]), simhash.SEED) for i in range(n)), "u8", n))


def words_of(h: np.ndarray, count: int) -> np.ndarray:
    """``count`` words of 64 majority bits; the hashes of word k are the given ones mixed with k."""
    ones = np.zeros(64 * count, "i8")
    offset = np.arange(1, count + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(h), ROWS):
        x = h[lo : lo + ROWS, None] + offset
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view("u1"), axis=1), axis=0, dtype="u1")
    return np.packbits(ones * 2 > len(h)).view("u8")


def differing(similarity: float = SIMILARITY) -> float:
    """Largest expected share of bits in which two texts of that similarity differ."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def at_most(width: int, t: int, p: float) -> float:
    """Probability of at most t differing bits among so many."""
    return sum(comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(t + 1))


def bound(p: float) -> int:
    """Bits of one word in which all but 1 - CHECKED of such pairs differ at most."""
    return next(t for t in range(65) if at_most(64, t, p) >= CHECKED)


def shape(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(bits of a partition, words of a fingerprint) for so many rows; the last word is the one to check."""
    width = min(WIDEST, max(NARROWEST, ceil(log2(max(n, 2))) + 2))
    needed = log(1 - RECALL) / log(1 - at_most(width, 0, differing(similarity)))
    return width, ceil(SPARE * needed / (64 // width)) + 1


def prints(docs: DataFrame, count: int, text: str, doc_id: str) -> DataFrame:
    """(key, rep, words) per row: its own key, the hash of its shingle set and its fingerprint."""
    base = docs.select(row_key(doc_id, text).alias("key"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, words = np.zeros(batch.num_rows, "u8"), np.zeros((batch.num_rows, count), "u8")
            for i, t in enumerate(batch.column("t")):
                h = shingles(t.as_py())
                reps[i], words[i] = xxhash.xxh64_intdigest(h.tobytes(), simhash.SEED), words_of(h, count)
            ends = np.arange(0, words.size + 1, count, dtype="i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.ravel().view("i8")))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(reps.view("i8")), lists], names=["key", "rep", "words"])

    return base.mapInArrow(run, "key long, rep long, words array<long>")


def matrix(batch: pa.RecordBatch, count: int) -> np.ndarray:
    return batch.column("words").flatten().to_numpy(zero_copy_only=False).astype("i8").view("u8").reshape(-1, count)


def bit_products(classes: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """Number of classes, and per word how many have bits i and j both set, over all of them."""
    upper = np.triu_indices(64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((count, 64, 64))
        for batch in batches:
            words = matrix(batch, count)
            n += len(words)
            for k in range(count):
                x = ((words[:, k, None] >> np.arange(64, dtype="u8")) & np.uint64(1)).astype("f4")
                total[k] += x.T @ x
        sums = np.append(total[:, upper[0], upper[1]].ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["k", "s"])

    rows = classes.select("words").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(count * len(upper[0]) + 1)
    for r in rows:
        flat[r["k"]] = r["s"]
    out = np.zeros((count, 64, 64))
    out[:, upper[0], upper[1]] = flat[:-1].reshape(count, -1)
    out[:, upper[1], upper[0]] = flat[:-1].reshape(count, -1)
    return int(flat[-1]), out


def plan(n: int, products: np.ndarray, width: int, similarity: float = SIMILARITY) -> list[tuple[int, list[int], int]]:
    """(word, bits, radius) of the probed partitions, by dynamic programming over the logarithm of the chance to miss.

    Cost of a threshold: one unit per cell written, a tenth per candidate pair estimated from the shares of set bits.
    """
    p, wanted = differing(similarity), -log(1 - RECALL)
    groups = []
    for k in range(len(products) - 1):
        share = np.diag(products[k]) / max(n, 1)
        groups += [(k, g[:width], share[g[:width]]) for g in simhash.bit_groups(n, products[k], 64 // width)]
    cost = np.full(STEPS + 1, np.inf)
    cost[0] = 0.0
    chosen = []
    for _, g, share in groups:
        best, pick = cost.copy(), np.full(STEPS + 1, -1)
        for t, radius in THRESHOLDS.items():
            if t < 0:
                continue
            gain = int(-log(1 - at_most(len(g), t, p)) / wanted * STEPS)
            price = n * sum(comb(len(g), i) for i in range(radius + 1)) + 0.1 * n * n / 2 * simhash.within_share(share, t)
            to = np.minimum(np.arange(STEPS + 1) + gain, STEPS)
            for u in np.flatnonzero(np.isfinite(cost)):
                if cost[u] + price < best[to[u]]:
                    best[to[u]], pick[to[u]] = cost[u] + price, t * (STEPS + 1) + u
        chosen.append(pick)
        cost = best
    out, u = [], STEPS
    for (k, g, _), pick in zip(reversed(groups), reversed(chosen)):
        if pick[u] >= 0:
            t, u = divmod(int(pick[u]), STEPS + 1)
            out.append((k, g, THRESHOLDS[t]))
    return out[::-1]


def cells(classes: DataFrame, parts: list[tuple[int, list[int], int]], count: int) -> DataFrame:
    """(k, rep, c): one row per class and cell; c is the word to check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rep = matrix(batch, count), batch.column("rep").to_numpy(zero_copy_only=False)
            for i, (k, bits, radius) in enumerate(parts):
                v = np.zeros(len(words), "i8")
                for place, b in enumerate(bits):
                    v |= ((words[:, k] >> np.uint64(b)) & np.uint64(1)).astype("i8") << place
                for m in simhash.masks(len(bits), radius):
                    columns = [pa.array(v ^ m | i << WIDEST + 1), pa.array(rep), pa.array(words[:, -1].view("i8"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "rep", "c"])

    return classes.select("rep", "words").mapInArrow(run, "k long, rep long, c long")


def sets(docs: DataFrame, rows: DataFrame, reps: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(rep, h) with the sorted shingle hashes of the named classes, from one text of each."""
    keys = rows.join(reps, "rep").groupBy("rep").agg(F.min("key").alias("key"))
    base = docs.select(row_key(doc_id, text).alias("key"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [shingles(t.as_py()).tobytes() for t in batch.column("t")]
            reps = np.array([xxhash.xxh64_intdigest(x, simhash.SEED) for x in h], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(h, pa.binary())], names=["rep", "h"])

    return base.join(saved(keys.select("key"), "wanted"), "key", "left_semi").select("t").mapInArrow(run, "rep long, h binary").dropDuplicates(["rep"])


def resembling(pairs: DataFrame, classes: DataFrame, count: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole fingerprints differ in few enough bits, three deviations and MARGIN allowed."""
    share, bits = differing(similarity) + MARGIN, 64 * count
    most = int(bits * share + 3 * sqrt(bits * share * (1 - share)))
    wa = classes.select(F.col("rep").alias("a"), F.col("words").alias("wa"))
    wb = classes.select(F.col("rep").alias("b"), F.col("words").alias("wb"))
    bits_apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    return saved(pairs.join(wa, "a").join(wb, "b").where(bits_apart <= most).select("a", "b"), "resembling")


def checked(pairs: DataFrame, docs: DataFrame, rows: DataFrame, text: str, doc_id: str, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets are that similar."""
    reps = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    s = saved(sets(docs, rows, reps, text, doc_id), "sets")
    both = pairs.join(s.select(F.col("rep").alias("a"), F.col("h").alias("ha")), "a").join(s.select(F.col("rep").alias("b"), F.col("h").alias("hb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8")
                least, most = sorted((len(x), len(y)))
                common = len(np.intersect1d(x, y, assume_unique=True)) if least >= similarity * most else 0
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not yet in one group."""
    ga = groups.select(F.col("vertex").alias("a"), F.col("component").alias("ga"))
    gb = groups.select(F.col("vertex").alias("b"), F.col("component").alias("gb"))
    return pairs.join(ga, "a", "left").join(gb, "b", "left").where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b")


def grouped(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with the group ``g`` that each ``rep`` is in now: itself, if it has no link."""
    now = groups.select(F.col("vertex").alias("rep"), "component")
    return df.drop("g").join(now, "rep", "left").withColumn("g", F.coalesce("component", "rep")).drop("component")


def occurrences(shingled: DataFrame) -> DataFrame:
    """(t, df): how many sets of (rep, g, h) hold each shingle. A batch counts its own before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(h.as_py(), "i8") for h in batch.column("h")]
            t, n = np.unique(np.concatenate(held) if held else np.zeros(0, "i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n.astype("i8"))], names=["t", "df"])

    return shingled.select("h").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))


def rare_shingles(shingled: DataFrame, similarity: float, listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """The sets (rep, g, h), written once, and their shingles (rep, g, n, t, df, r) that are rare enough to find partners
    by, with their place r in the set.

    Shingles are ordered by the number of sets that hold them, then by value. The shorter set of a pair has its first
    common shingle among its first n - 2 s / (1 + s) n + 1, the longer one among its first n - s n + 1.
    The last ``listed`` shingles of that order, a list of bounded size, are known to every task: a set gives its other
    shingles, and of the listed ones only as many as the others leave room for. So close texts do not give what they
    all hold, and the places are those among all shingles. Shingles of one set only come first; they are but counted.
    """
    shingled = saved(shingled.select("rep", "g", "h"), "shingled")
    often = saved(occurrences(shingled), "often")
    last = often.where("df > 1").orderBy(F.desc("df"), F.desc("t")).limit(listed).toArrow()
    order = np.argsort(last.column("t").to_numpy())
    common, times = last.column("t").to_numpy()[order], last.column("df").to_numpy()[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, g, h in zip(*(batch.column(c).to_pylist() for c in ("rep", "g", "h"))):
                v = np.frombuffer(h, "i8")
                at = np.minimum(np.searchsorted(common, v), max(len(common) - 1, 0))
                known = common[at] == v if len(common) else np.zeros(len(v), bool)
                others = int((~known).sum())
                room = max(len(v) - ceil(len(v) * similarity - 1e-9) + 1 - others, 0)
                first = np.lexsort((v[known], times[at[known]]))[:room]
                t = np.concatenate([v[~known], v[known][first]])
                df = np.concatenate([np.zeros(len(t) - len(first), "i8"), times[at[known]][first]])
                for i in range(0, len(t), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    columns = [pa.array(np.full(len(t[part]), x, "i8")) for x in (rep, g, len(v), others)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(t[part]), pa.array(df[part])], names=["rep", "g", "n", "others", "t", "df"])

    given = saved(shingled.mapInArrow(run, "rep long, g long, n long, others long, t long, df long"), "given")
    counted = given.where("df = 0").drop("df").join(often.where("df > 1"), "t").withColumn("met", F.lit(1))
    counted = counted.unionByName(given.where("df > 0").withColumn("met", F.lit(0)))
    alone = F.col("others") - F.sum("met").over(Window.partitionBy("rep"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("df", "t")) + alone)
    return shingled, saved(ranked.where(F.col("r") <= places(similarity)).drop("others", "met"), "rare")


def places(share: float) -> Column:
    return F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1


def exploded(shingled: DataFrame) -> DataFrame:
    """(rep, g, t): one row per shingle of (rep, g, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, g, h in zip(*(batch.column(c).to_pylist() for c in ("rep", "g", "h"))):
                v = np.frombuffer(h, "i8")
                for i in range(0, len(v), 1 << 16):
                    part = v[i : i + (1 << 16)]
                    columns = [pa.array(np.full(len(part), x, "i8")) for x in (rep, g)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(part)], names=["rep", "g", "t"])

    return shingled.select("rep", "g", "h").mapInArrow(run, "rep long, g long, t long")


def to_centres(shingled: DataFrame, rare: DataFrame) -> DataFrame:
    """Pairs (a, b): each set and the centre of the largest other group at each of its rare shingles.

    The centre of a group is the set whose shingles are the most frequent in the group: it has the largest overlap with
    its members on average, so a set that resembles some of them mostly resembles it. One row per rare shingle at most.
    """
    top = rare.groupBy("t", "g").agg(F.count("*").alias("c")).groupBy("t").agg(F.max(F.struct("c", "g"))["g"].alias("top"))
    met = saved(rare.join(top, "t").where("g <> top").select("rep", F.col("top").alias("g")).distinct(), "met")
    # a group of one set is its own centre
    reps = shingled.select("rep", "g")
    many = reps.groupBy("g").agg((F.min("rep") < F.max("rep")).alias("many")).where("many")
    reps = reps.join(many.join(met, "g", "left_semi"), "g", "left_semi").select("rep")
    members = saved(exploded(shingled.join(reps, "rep", "left_semi")), "members")
    held = members.groupBy("g", "t").agg(F.count("*").alias("c"))
    overlap = members.join(held, ["g", "t"]).groupBy("g", "rep").agg(F.avg("c").alias("c"))
    centres = overlap.groupBy("g").agg(F.max(F.struct("c", "rep"))["rep"].alias("centre"))
    met = met.join(centres, "g", "left").withColumn("centre", F.coalesce("centre", "g"))
    return met.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()


def by_rare_shingles(shingled: DataFrame, similarity: float, rare: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of different groups that may be that similar, from (rep, g, h); no similar pair is missing.

    Two similar sets share one of their ``rare_shingles`` (``rare``, if they are known, with the groups of now); what
    follows that shingle in either set bounds the overlap.
    """
    probe = rare_shingles(shingled, similarity)[1] if rare is None else rare
    index = probe.where(F.col("r") <= places(2 * similarity / (1 + similarity)))
    x = index.select("t", F.col("rep").alias("a"), F.col("g").alias("ga"), F.col("n").alias("na"), F.col("r").alias("ra"))
    y = probe.select("t", F.col("rep").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    room = 1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    need = (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    fits = shorter & (F.col("ga") != F.col("gb")) & (F.col("na") >= similarity * F.col("nb") - 1e-9) & (room >= need)
    return x.join(y, "t").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(key, component) for every row, once per ``row_key``; rows of one component are joined by links."""
    width, count = shape(docs.count(), similarity)
    rows = saved(prints(docs, count, text, doc_id), "prints")
    classes = saved(rows.groupBy("rep").agg(F.any_value("words").alias("words")), "classes")
    n, products = bit_products(classes, count)
    index = cells(classes, plan(n, products, width, similarity), count)
    hubs = index.groupBy("k").agg(F.min(F.struct("rep", "c")).alias("h"), F.count("*").alias("n")).where("n > 1")
    hubs = saved(hubs.select("k", F.col("h.rep").alias("a"), F.col("h.c").alias("ac")), "hubs")
    shared = saved(index.join(hubs, "k"), "shared")
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    most = bound(differing(similarity))
    close = shared.where((F.col("rep") != F.col("a")) & (apart("c", "ac") <= most)).withColumnRenamed("rep", "b")
    close = saved(close.groupBy("a", "b").agg(F.min(apart("c", "ac")).alias("d")), "near")
    nearest = close.groupBy("b").agg(F.min(F.struct("d", "a")).alias("n")).select("n.a", "b")
    alike = lambda pairs: checked(resembling(pairs, classes, count, similarity), docs, rows, text, doc_id, similarity)
    links = saved(alike(nearest), "links")
    links = saved(links.unionByName(alike(across(close.select("a", "b"), components(links)))), "links")
    spots = saved(grouped(shared.select("k", "rep", "c"), components(links)), "spots")
    crowds = spots.groupBy("k").agg(F.count("*").alias("n"), F.min("g").alias("least"), F.max("g").alias("most"))
    crowds = saved(crowds.where((F.col("n") > CROWD) & (F.col("least") != F.col("most"))).select("k"), "crowds")
    crowded = saved(spots.join(crowds, "k", "left_semi").select("rep", "g").distinct(), "crowded")
    shingled, rare = rare_shingles(sets(docs, rows, crowded.select("rep"), text, doc_id).join(crowded, "rep"), similarity)
    links = saved(links.unionByName(alike(saved(to_centres(shingled, rare), "central"))), "links")
    groups = components(links)
    rare = by_rare_shingles(shingled, similarity, saved(grouped(rare, groups), "rare"))
    spots = saved(grouped(spots.join(crowds, "k", "left_anti"), groups), "spots")
    other = spots.select("k", F.col("rep").alias("b"), F.col("c").alias("bc"), F.col("g").alias("bg"))
    rest = spots.withColumnRenamed("rep", "a").join(other, "k").where((F.col("a") < F.col("b")) & (F.col("g") != F.col("bg")) & (apart("c", "bc") <= most))
    links = links.unionByName(alike(saved(rest.select("a", "b").unionByName(rare).distinct(), "candidates")))
    groups = components(saved(links, "links")).withColumnRenamed("vertex", "rep")
    return rows.select("key", "rep").distinct().join(groups, "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
