"""Spelling variants: words one edit apart, found with asymmetric chunks, and the form each rare one belongs to.

Words are maximal runs of Latin letters of whole texts, only A-Z lower-cased, counted over all documents. Two words are
near if one inserted, deleted or replaced character turns one into the other.

Search: of two near words the shorter (of equal ones either) is cut into two disjoint chunks, its halves; one edit lies in
one half and preserves the other. The longer one contributes its positional grams of the same length: the chunk is found
at the same place or, behind an insertion, one place later, so only grams within that shift are sent. An equi-join on
(length, open half, chunk) brings candidates together, Levenshtein distance verifies them. Where very many words share a
chunk, the half that holds the edit is cut in the same way again and its preserved part joins the key, round after round
until a key is shared by few words or one place is left open; so no group emits all its pairs. Pre-aggregated counts are
the only rows that come from the documents, and the search runs on distinct words.

Defined results: null and empty texts have no words. Identifiers enter the damage rule as text, a null one as empty text.
Repeated rows count as often as they occur. Empty tables give empty results; other columns are not read. Very long runs
are one word. Ties between forms go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import saved

RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")  # [a-zÀ-ÿ]+ in UTF-8
DAMAGED = 199  # one run in so many loses a character
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
HELD = 200_000  # distinct words a task counts before it passes them on
CROWD = 64  # candidates of a key per word that takes part, beyond which the key is cut further
GROUP = 20_000  # words of a key, beyond which it is cut further


def damaged(doc_id: str, run: bytes, every: int = DAMAGED) -> bytes:
    """The lower-cased run, without one of its characters where the hash of identifier and run says so."""
    h = crc32(b"%s:%s" % (doc_id.encode(), run))
    if every and h % every == 0:
        s = run.decode()
        k = h % len(s)
        return (s[:k] + s[k + 1 :]).encode()
    return run


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = DAMAGED, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least ``length`` characters and ``count`` occurrences."""
    base = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column("i"), batch.column("t")):
                if not t.is_valid:
                    continue
                start = crc32(i.as_py().encode() + b":")
                for w, n in Counter(m[0] for m in RUN.finditer(t.as_py().lower())).items():
                    if every and crc32(w, start) % every == 0:
                        w = damaged(i.as_py(), w, every)
                    if len(w) >= length and len(w) - w.count(b"\xc3") >= length:
                        held[w] += n
                if len(held) > HELD:
                    yield out(held)
                    held.clear()
        if held:
            yield out(held)

    return base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def outside(word: Column, more: Column) -> Column:
    """Hash of what lies outside the open places [a, b) of a word with ``more`` characters inserted in them."""
    return F.xxhash64("size", "a", "b", F.substring(word, F.lit(1), F.col("a")), F.substring(word, F.col("b") + more + 1, F.length(word)))


def halves(rows: DataFrame) -> DataFrame:
    """Every row twice: once with the first half of its open places, once with the second."""
    m = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    cut = F.array(F.struct(F.col("a").alias("a"), m.alias("b")), F.struct(m.alias("a"), F.col("b").alias("b")))
    more = F.length("word") - F.col("size")
    out = rows.withColumn("c", F.explode(cut)).select("word", "chunk", "size", "c.a", "c.b")
    return out.withColumn("key", outside(F.col("word"), more))


def near(vocabulary: DataFrame) -> DataFrame:
    """(x, y): every pair of distinct words one edit apart, once, the shorter (of equal length the smaller) first.

    ``vocabulary`` holds each word once, in column ``word``.
    """
    w = vocabulary.select("word", F.length("word").alias("l")).where("l > 0")
    whole = lambda size, chunk: w.select("word", F.lit(chunk).alias("chunk"), size.alias("size"), F.lit(0).alias("a"), size.alias("b"))
    one = F.col("l")
    rows = whole(one, True).unionByName(whole(one, False)).unionByName(whole(one - 1, False).where("size > 0"))
    found, level = None, halves(rows)
    while True:
        level = saved(level, "chunks")
        sizes = level.groupBy("size", "key").agg(F.sum(F.col("chunk").cast("long")).alias("chunks"), F.sum((~F.col("chunk")).cast("long")).alias("grams"))
        # a key with one word only has that word as its chunk and its gram
        both = sizes.where("chunks > 0 AND grams > 0 AND chunks + grams > 2")
        crowded = (F.col("chunks") * F.col("grams") > CROWD * (F.col("chunks") + F.col("grams"))) | (F.col("chunks") + F.col("grams") > GROUP)
        both = both.select("size", "key", crowded.alias("crowded"))
        level = saved(level.join(both, ["size", "key"]), "shared-chunks")
        last = (F.col("b") - F.col("a")) < 2
        ready = level.where(~F.col("crowded") | last)
        x = ready.where("chunk").select("size", "key", F.col("word").alias("x"))
        y = ready.where("NOT chunk").select("size", "key", F.col("word").alias("y"))
        pairs = x.join(y, ["size", "key"]).where((F.length("y") > F.length("x")) | (F.col("x") < F.col("y")))
        pairs = pairs.where(F.levenshtein("x", "y", 1) == 1).select("x", "y")
        found = pairs if found is None else found.unionByName(pairs)
        level = level.where(F.col("crowded") & ~last).drop("key", "crowded")
        if level.isEmpty():
            return found.distinct()
        level = halves(level)


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word of (word, form), in as many rounds as the chain's length doubles."""
    at = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return at
        at = moved.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = DAMAGED, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word.

    ``form`` is the near word with most occurrences if it has at least ``ratio`` times those of the word, else null;
    ``root`` is the end of the chain of forms, the word itself if it has none.
    """
    v = saved(words(docs, text, doc_id, every, length, count), "words")
    pairs = saved(near(v), "near")
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other")).unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("other")))
    count_of = v.select(F.col("word").alias("other"), F.col("n").alias("m"))
    best = both.join(count_of, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("f"))
    named = v.join(best, "word", "left")
    fits = -F.col("f.m") >= ratio * F.col("n")
    named = named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("f.w")).alias("form"), F.when(fits, -F.col("f.m")).alias("form_n"))
    named = saved(named, "forms")
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
