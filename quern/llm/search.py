"""Ranked lexical search, term at a time with limited accumulators.

Documents are indexed once per block of queries: a task turns blocks of documents into postings of the query terms,
sorted by term (one row per block, held in the shared folder). A second pass scores every query on every block. Terms go
from the rarest to the most frequent. A document that holds the current term gets an accumulator, until the bounds of
the remaining terms (weight times the largest impact in the block) sum to less than the kth best score known, partial
scores of this block and final ones of the task's earlier blocks included: a document without an accumulator can then
no longer reach the first k. Accumulators that cannot reach it either are dropped; the survivors are updated exactly by
the remaining terms. Each task passes on k rows per query; they are merged in two steps, so that no query's rows of all
tasks meet in one window first.

Queries are a stated set and go through in blocks of about ``BLOCK`` terms, which bounds what a task is sent.

Defined results: null, empty and letterless texts have no term and are not counted in N. Rows with equal identifiers
are documents of their own, each with its place; rows without one come last among equal scores. Query rows that share
an identifier (null included) are one query with the terms of all. Queries without a term found have no rows; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import saved

BEST = 50
BLOCK = 500_000  # query terms sent to a task at once
DOCS, POSTINGS = 16_384, 2_000_000  # documents and postings of an index block
SALT = 64  # groups of a query's rows that are cut to the best k before all of them meet
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# bytes of UTF-8 text: separators become blanks, A-Z lower case; all bytes from 0x80 belong to terms
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
INDEX = "docs long, total long, ids binary, named binary, n binary, term binary, at binary, tf binary"


def queries_of(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, term): the distinct terms of each query."""
    folded = F.translate(F.col(f"`{text}`").cast("string"), UPPER, LOWER)
    each = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(folded, F.lit(TERM), 1)).alias("term"))
    return each.distinct()


def index(docs: DataFrame, terms: list[bytes], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per block of documents: their number and terms, and the postings of ``terms`` as arrays sorted by term."""
    number = {t: i for i, t in enumerate(terms)}
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = number.keys()
        docs = total = 0
        ids, n, term, at, tf = [], [], [], [], []

        def out() -> pa.RecordBatch:
            order = np.argsort(np.array(term, "i4"), kind="stable")
            named = np.array([i is not None for i in ids], "u1")
            cols = [np.array([i or 0 for i in ids], "i8"), named, np.array(n, "i8"), np.array(term, "i4")[order], np.array(at, "i4")[order], np.array(tf, "i8")[order]]
            row = [pa.array([docs], pa.int64()), pa.array([total], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in cols]]
            return pa.RecordBatch.from_arrays(row, names=["docs", "total", "ids", "named", "n", "term", "at", "tf"])

        for batch in batches:
            for i, t in zip(batch.column("i"), batch.column("t")):
                words = t.as_py().translate(FOLD).split(b" ") if t.is_valid else []
                count = Counter(words)
                size = len(words) - count.pop(b"", 0)
                if not size:
                    continue
                docs, total = docs + 1, total + size
                found = wanted & count.keys()
                if found:
                    term += [number[w] for w in found]
                    tf += [count[w] for w in found]
                    at += [len(ids)] * len(found)
                    ids.append(i.as_py())
                    n.append(size)
                if len(ids) >= DOCS or len(term) >= POSTINGS:
                    yield out()
                    docs = total = 0
                    ids, n, term, at, tf = [], [], [], [], []
        if docs:
            yield out()

    return base.mapInArrow(run, INDEX)


def frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, "i8")
        for batch in batches:
            for t in batch.column("term"):
                df += np.bincount(np.frombuffer(t.as_buffer(), "i4"), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(size, "i8")
    for r in blocks.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row per term of the block
        out[r["term"]] = r["df"]
    return out


def ordered(score: np.ndarray, ids: np.ndarray, named: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, then ascending identifier, those without one last."""
    return np.lexsort((ids, 1 - named.astype("i8"), -score))[:k]


def accumulate(terms: np.ndarray, weight: np.ndarray, start: np.ndarray, at: np.ndarray, impact: np.ndarray, top: np.ndarray, docs: int, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) of a block that can be among the k best; ``terms`` rarest first, ``bar`` a kth best score known."""
    bound = weight[terms] * top[terms]
    left = np.append(np.cumsum(bound[::-1])[::-1], 0)
    score, live = np.zeros(docs, "i8"), np.zeros(docs, bool)
    creating = True
    for j, t in enumerate(terms):
        if creating and left[j] < bar:  # nothing new can reach the first k
            creating = False
            live &= score + left[j] >= bar
        rows, part = at[start[t] : start[t + 1]], impact[start[t] : start[t + 1]]
        if creating:
            live[rows] = True
        else:
            keep = live[rows]
            rows, part = rows[keep], part[keep]
        score[rows] += weight[t] * part
        if creating and left[j + 1] < int(score.max(initial=0)):
            held = score[live]
            if len(held) >= k:
                bar = max(bar, int(np.partition(held, len(held) - k)[len(held) - k]))
    found = np.flatnonzero(live & (score > 0) & (score >= bar))
    return found, score[found]


def best(blocks: DataFrame, ids: list[int | None], terms: list[np.ndarray], weight: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): up to k rows per query and task. ``terms``: term numbers of each query, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u1"))] * len(ids)
        for batch in batches:
            for row in range(batch.num_rows):
                part = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), t)
                own, named, n, term, at, tf = part("ids", "i8"), part("named", "u1"), part("n", "i8"), part("term", "i4"), part("at", "i4"), part("tf", "i8")
                m = 100 - 50 + (50 * n * docs) // total
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
                size = np.bincount(term, minlength=len(weight))
                start = np.append(0, np.cumsum(size))
                top = np.zeros(len(weight), "i8")
                held = np.flatnonzero(size)
                if len(held):
                    top[held] = np.maximum.reduceat(impact, start[held])
                for q, wanted in enumerate(terms):
                    score, doc, ok = kept[q]
                    bar = int(score[-1]) if len(score) == k else 1
                    wanted = wanted[size[wanted] > 0]
                    found, new = accumulate(wanted, weight, start, at, impact, top, len(own), k, bar)
                    if len(found):
                        score, doc, ok = np.append(score, new), np.append(doc, own[found]), np.append(ok, named[found])
                        first = ordered(score, doc, ok, k)
                        kept[q] = score[first], doc[first], ok[first]
        for i, (score, doc, ok) in zip(ids, kept):
            if len(score):
                cols = [pa.array([i] * len(score), pa.int64()), pa.array(doc, pa.int64(), mask=ok == 0), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=["item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query."""
    wanted = saved(queries_of(items), "queries")
    parts = -(-wanted.count() // block) or 1
    out = None
    for part in range(parts):
        # about ``block`` rows
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        vocabulary = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(vocabulary)}
        blocks = saved(index(docs, [t.encode() for t in vocabulary]), "postings")
        size = blocks.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
        n, total = size["docs"] or 0, size["total"] or 1
        df = frequencies(blocks, len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], "i8")
        of: dict[int | None, list[int]] = {}
        for r in rows:
            of.setdefault(r["item_id"], []).append(number[r["term"]])
        rarest = [np.array(sorted(t, key=lambda x: (df[x], x)), "i8") for t in of.values()]
        found = best(blocks, list(of), rarest, weight, n, total, k)
        out = found if out is None else out.unionByName(found)
    first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT))
    out = out.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*first))).where(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*first))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")
