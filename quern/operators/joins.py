"""Joins and set operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ordered import join_keys
from quern.session import stored


def left_m1(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left m:1 join; the planner broadcasts the right side when its size allows."""
    return left.join(right, on, "left")


def seen_before(lines: DataFrame, key: str, item: str, age: str) -> DataFrame:
    """Items of each key's newest day, and whether they were bought on an earlier day."""
    newest = lines.groupBy(key).agg(F.min(age).alias("_r"))
    per = join_keys(lines.groupBy(key, item).agg(F.min(age).alias("_lo"), F.max(age).alias("_hi")), newest, [key])
    return per.where(F.col("_lo") == F.col("_r")).select(key, item, (F.col("_hi") > F.col("_r")).cast("int").alias("seen"))


def anti_new(external: DataFrame, train: DataFrame, key: Column, id_col: str) -> DataFrame:
    """External rows whose key is not in train nor on an earlier external row."""
    ext = external.withColumn("_k", key).where("_k <> ''")
    first = ext.groupBy("_k").agg(F.min(id_col).alias(id_col))
    fresh = first.join(train.select(key.alias("_k")).distinct(), "_k", "left_anti")
    return external.join(fresh.select(id_col), id_col, "left_semi")


def union_by_name(frames: dict[str, DataFrame], flag: str = "part") -> DataFrame:
    out = None
    for name, df in frames.items():
        df = df.withColumn(flag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def split_row_key(df: DataFrame, col: str) -> DataFrame:
    """``entity_rowindex`` into entity (everything before the last underscore) and row number."""
    return df.withColumns(
        {"entity": F.regexp_extract(col, r"^(.*)_(\d+)$", 1), "row_index": F.regexp_extract(col, r"^(.*)_(\d+)$", 2).try_cast("long")}
    )


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().exceptAll(b.distinct())


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def top_changes(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Ids that entered or left between two top lists."""
    enter = b.select(id_col).join(a.select(id_col), id_col, "left_anti").withColumn("change", F.lit("entered"))
    leave = a.select(id_col).join(b.select(id_col), id_col, "left_anti").withColumn("change", F.lit("left"))
    return enter.unionByName(leave)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: str = "first") -> DataFrame:
    """First or last row per key in the given order, as an aggregate: partial results combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    pick = (F.min_by if keep == "first" else F.max_by)(F.struct(*rest), place)
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def merge_new(existing: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """All existing rows plus one discovered row for each unseen key."""
    fresh = dedupe(discovered, [key], [F.struct(*[c for c in discovered.columns if c != key])])
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti").select(*existing.columns))


def title_key(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def title_similarity(a: Column, b: Column) -> Column:
    """1 when equal, 0.92 when one contains the other, else 1 - edit distance / longer length; 0 for empty text."""
    ratio = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.92).otherwise(ratio)


SHORT = 40  # letters of a title up to which letters are dropped: about 800 keys for two edits
PIECE = 8  # letters of the pieces by which contained titles are found
FILTER_BITS = 27  # bits of a filter, as a power of two: 16 MB, however many keys there are


def shortened(d: DataFrame, edits: int, bits=None) -> DataFrame:
    """(k, h): each key of up to ``SHORT`` + ``edits`` letters with the hashes of all that is left without up to ``edits`` of them.

    Made where the key is; of a key with many, only those that may be in ``bits``. Keys are plain letters, digits and blanks.
    """
    rate = 0x9E3779B97F4A7C15  # odd, so it has an inverse
    up = np.array([pow(rate, i, 1 << 64) for i in range(SHORT + edits)], "u8")
    one, two = (np.uint64(pow(rate, -i, 1 << 64)) for i in (1, 2))

    def run(batches):
        for t in batches:
            k = t.column("k")
            text = np.frombuffer("".join(k.to_pylist()).encode(), "u1").astype("u8") + np.uint64(1)
            size = np.asarray(pc.binary_length(k)).astype("i8")
            start = np.cumsum(size) - size
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                sums = np.zeros((int(n) + 1, len(rows)), "u8")  # of the letters before each place, by their places
                np.cumsum((text[start[rows][:, None] + np.arange(n)] * up[:n]).T, axis=0, out=sums[1:])
                left = [sums[n]] + [sums[i] + (sums[n] - sums[i + 1]) * one for i in range(n)]
                if edits == 2:
                    left += [sums[i] + (sums[j] - sums[i + 1]) * one + (sums[n] - sums[j + 1]) * two for i in range(n) for j in range(i + 1, n)]
                h = np.concatenate(left)
                h = ((h ^ (h >> np.uint64(29))) * np.uint64(rate) >> np.uint64(1)).astype("i8")
                at = np.tile(rows, len(left))
                if bits is not None:
                    x = h & ((1 << FILTER_BITS) - 1)
                    hit = (bits.value[x >> 3] >> (x & 7).astype("u1")) & 1 == 1
                    h, at = h[hit], at[hit]
                yield pa.RecordBatch.from_arrays([k.take(pa.array(at)), pa.array(h)], names=["k", "h"])

    return d.where(F.length("k") <= SHORT + edits).select("k").mapInArrow(run, "k string, h long")


def pieces(d: DataFrame, size: Column | None = None) -> DataFrame:
    """(k, hs): each key with the hashes of its pieces of ``PIECE`` (or ``size``) letters; shorter keys are left out."""
    n = F.lit(PIECE) if size is None else size
    grams = F.transform(F.sequence(F.lit(1), F.length("k") - n + 1), lambda i: F.xxhash64(F.substring("k", i, n)))
    return d.where(F.length("k") >= n).select("k", F.array_distinct(grams).alias("hs"))


def bits_of(hashes: DataFrame):
    """Broadcast bits of the hashes in column ``h``: of fixed size, so many hashes fill it and let more pass."""
    bit = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = hashes.select(bit.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("m"))
    got = words.toArrow()  # a row per 64 bits at most
    table = np.zeros(1 << (FILTER_BITS - 6), "i8")
    table[got["w"].to_numpy()] = got["m"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table.view("u1"))


def probed(lists: DataFrame, bits, every: bool = False) -> DataFrame:
    """(k, h): the hashes of each key that may be in ``bits``, made where the key is; or with ``every`` the keys of which all may be."""

    def run(batches):
        for t in batches:
            n, h = np.asarray(t.column("hs").value_lengths()), np.asarray(t.column("hs").flatten())
            x = h & ((1 << FILTER_BITS) - 1)
            hit = (bits.value[x >> 3] >> (x & 7).astype("u1")) & 1 == 1
            row = np.repeat(np.arange(len(n)), n)
            if every:
                yield pa.RecordBatch.from_arrays([t.column("k").take(pa.array(np.flatnonzero(np.bincount(row[hit], minlength=len(n)) == n)))], names=["k"])
            else:
                yield pa.RecordBatch.from_arrays([t.column("k").take(pa.array(row[hit])), pa.array(h[hit])], names=["k", "h"])

    return lists.mapInArrow(run, "k string" if every else "k string, h long")


def each(lists: DataFrame) -> DataFrame:
    return lists.select("k", F.explode("hs").alias("h"))


def contained(inner: DataFrame, outer: DataFrame, inner_name: str, outer_name: str) -> DataFrame:
    """Pairs of keys that may lie in another, by the rarest piece of ``PIECE`` letters of the inner one (all of it, if shorter).

    Inner keys with a piece that no outer key holds, and outer pieces by which no inner key is sought, are told by a filter
    of fixed size where the pieces are made, and are not sent.
    """
    brief = inner.where(F.length("k") < PIECE)
    possible = stored(probed(pieces(inner), bits_of(each(pieces(outer))), every=True))
    mine = stored(each(pieces(possible)))
    often = probed(pieces(outer), bits_of(mine)).groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    # a piece that no outer key holds leaves its key without a match
    own = mine.join(often.hint("merge"), "h", "left").groupBy("k").agg(F.min_by("h", F.struct(F.coalesce("f", F.lit(0)), "h")).alias("h"))
    own = stored(own.unionByName(brief.select("k", F.xxhash64("k").alias("h"))))
    bits = bits_of(own)
    sizes = brief.select(F.length("k").alias("n")).distinct()
    holds = probed(pieces(outer), bits).unionByName(probed(pieces(outer.join(F.broadcast(sizes), F.length("k") >= F.col("n")), F.col("n")), bits))
    got = own.select(F.col("k").alias(inner_name), "h").join(holds.select(F.col("k").alias(outer_name), "h").hint("merge"), "h")
    return got.where(F.contains(outer_name, F.col(inner_name))).select("lk", "rk")


def fuzzy_match(left: DataFrame, right: DataFrame, left_id: str, left_title: str, right_id: str, right_title: str, accept: float = 0.75) -> DataFrame:
    """Best candidate per title with similarity >= ``accept`` (ties: smallest id); null below it.

    Titles collapse to distinct keys. Equal and contained keys are found by hash joins. Keys one, then two edits apart
    share what is left when as many letters are dropped from each: a title whose best candidate beats all that could lie
    further away is settled. The rest, and keys above ``SHORT`` letters, meet through rare bigrams: an edit touches at
    most two bigrams, so two titles within the allowed distance must share one of each other's rarest few.
    """
    spread = 4 * left.sparkSession.sparkContext.defaultParallelism  # keys are few bytes with much work each
    lk = stored(left.select(title_key(left_title).alias("k")).where("k <> ''").distinct().repartition(spread))
    rk = stored(right.select(title_key(right_title).alias("k")).where("k <> ''").distinct().repartition(spread))
    ids = right.select(title_key(right_title).alias("rk"), right_id).groupBy("rk").agg(F.min(right_id).alias(right_id))
    ids = stored(ids)

    def judged(pairs: DataFrame) -> DataFrame:
        s = F.round(title_similarity(F.col("lk"), F.col("rk")), 9)
        scored = pairs.withColumn("s", s).where(F.col("s") >= accept).join(ids.hint("merge"), "rk")
        return scored.groupBy("lk").agg(F.min(F.struct((-F.col("s")).alias("m"), F.col(right_id))).alias("b"))

    named = lambda d, n: d.select(F.col("k").alias(n), "h")
    # the planner does not count exploded rows and would broadcast them: these joins ask for a shuffle
    meet = lambda a, b: named(a, "lk").join(named(b, "rk").hint("merge"), "h").select("lk", "rk")
    found = judged(lk.select(F.col("k").alias("lk"), F.col("k").alias("rk")))
    found = found.unionByName(judged(contained(lk, rk, "lk", "rk"))).unionByName(judged(contained(rk, lk, "rk", "lk")))
    left_over, best = lk, None
    for edits in (1, 2):
        own = stored(shortened(left_over, edits))
        # what the other titles leave is sent only where one of these may have left it too
        near = meet(own, shortened(rk, edits, bits_of(own))).distinct()
        found = (best if best is not None else found).unionByName(judged(near))
        best = stored(found.groupBy("lk").agg(F.min("b").alias("b")))
        # further away: one edit more, in a title longer by all of them
        room = 1 - (edits + 1) / (F.length("k") + edits + 1)
        sure = (-F.col("b.m") > room + 1e-8) & (F.length("k") <= SHORT)
        done = left_over.join(best, F.col("k") == F.col("lk")).where(sure).select("k")
        # nothing further away is accepted
        far = (room + 1e-8 < accept) & (F.length("k") <= SHORT)
        left_over = stored(left_over.where(~far).join(done, "k", "left_anti"))

    def grams(d: DataFrame) -> DataFrame:
        s = F.concat(F.lit("^"), F.col("k"), F.lit("$"))
        g = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
        return d.select("k", F.explode(g).alias("g"))

    if not left_over.isEmpty():
        lg, rg = grams(left_over), grams(rk)
        freq = stored(lg.unionAll(rg).groupBy("g").agg(F.count(F.lit(1)).alias("f")))

        def ranked(x: DataFrame) -> DataFrame:
            items = x.hint("merge").join(freq, "g").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("gs"))  # bigrams of one title
            return items.select("k", F.posexplode("gs").alias("i", "x")).select("k", "i", "x.g")

        # d edits <= (1 - accept) * longer length, longer <= own / accept; equal bigrams repeated in a title only make its set smaller
        room = lambda k: 2 * F.floor(F.length(k) * F.lit((1 - accept) / accept) + 1e-9) + 1
        rare = lambda d: ranked(d).where(F.col("i") < room(F.col("k"))).select("k", F.col("g").alias("h"))
        best = best.unionByName(judged(meet(rare(lg), rare(rg)).distinct())).groupBy("lk").agg(F.min("b").alias("b"))
    out = left.withColumn("lk", title_key(left_title)).join(best, "lk", "left")
    return out.select(left_id, F.col(f"b.{right_id}").alias(right_id), (-F.col("b.m")).alias("similarity"))
