"""Benchmark decontamination by template windows: numbers, names and units become typed placeholders.

A text becomes template words: runs of letters and digits, lower-cased; a word with a digit is a number, a word of ``UNITS``
right after a number is a unit, a capitalised word inside a sentence may be a name. Every text is read in three forms:
with names kept, with names as placeholders, and with every capitalised word as one, as names also begin sentences; the
slots tell later whether it was a name. Windows of ``SPAN`` template words are hashed; a window with fewer than
``LITERAL`` ordinary words (two in the third form, whose windows hold more placeholders) keeps its values, else tables
of numbers would all look alike.

Windows of documents pass a bit filter of fixed size that holds all benchmark windows (no window of the benchmark is
lost) and are then hash-joined with the benchmark's windows. Pairs of a document and an item with at least ``SHARE`` of
the item's windows are judged occurrence by occurrence: a band of diagonals (document position less item position)
around one of them, in which each item window takes its match nearest to that diagonal. An occurrence counts when it
holds at least ``SHARE`` of the item's windows and its slots are filled consistently: of the matched slots, at least
``SHARE`` agree with the most frequent document value of their item value, and the other way round. That catches
exact passages as well as questions with other numbers or names, however many versions a document holds. The document
as a whole is judged too, which finds items whose parts are scattered; one with at least ``SHARE`` of the windows word
for word, values included, needs no vote. Windows that an item repeats keep the slots of each of their positions.

Items of fewer than ``SPAN`` template words are found only in documents that consist of exactly those words. Null and
empty texts of either table match nothing. Repeated rows of documents each keep their row; items with equal
identifiers are one item.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import saved

SPAN = 5  # template words of a window
SHARE = 0.8  # of the windows of an item, and of its slot values
LITERAL = (3, 3, 2)  # ordinary words that a window needs to stand with placeholders, by form
FILTER_BITS = 24  # the filter has 2 ** 24 bits (2 MB) however large the benchmark is
PIECE = 1 << 18  # characters read at once; longer words count as several
UNITS = frozenset("mm cm m km mg g kg t ml l s sec min h hours days weeks months years percent usd eur gbp dollars euros cents miles feet inches pounds ounces degrees mph kmh watts volts joules newtons".split())
RATE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of hashes, with its inverse modulo 2 ** 64
BACK = np.uint64(pow(int(RATE), -1, 1 << 64))
SEPARATOR, LETTER, DIGIT, MARK = range(4)
CLASS = np.full(256, SEPARATOR, "u1")  # bytes of characters beyond ASCII are letters
CLASS[128:] = CLASS[ord("a") : ord("z") + 1] = CLASS[ord("A") : ord("Z") + 1] = LETTER
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[[ord(c) for c in ".!?:\n"]] = MARK
ODD = re.compile(r"[^\x00-\x7f\w]")  # punctuation and blanks beyond ASCII


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse for every byte of a piece (a character has at most four)."""
    n = np.full(4 * PIECE, RATE, "u8"), np.full(4 * PIECE, BACK, "u8")
    for x in n:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return n


def mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * RATE


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word; equal words have equal hashes wherever they stand."""
    up, down = powers()
    sums = np.zeros(len(text) + 1, "u8")
    np.cumsum((np.frombuffer(text, "u1").astype("u8") + np.uint64(1)) * up[: len(text)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hash(word: str) -> int:
    b = word.encode()
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0])


@functools.cache
def marks() -> tuple[np.uint64, np.uint64, np.uint64, np.ndarray]:
    """Hashes of the placeholders for numbers, names and units, and those of all unit words."""
    return (*(np.uint64(word_hash(x)) for x in ("\0number", "\0name", "\0unit")), np.array(sorted(word_hash(u) for u in UNITS), "u8"))


def words_of(piece: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Hashes, kinds (0 word, 1 number, 2 unit, 3 capitalised) and whether a sentence mark stands before, per word.

    The last value tells whether a mark follows the last word.
    """
    if not piece.isascii():
        piece = ODD.sub(" ", piece)
    low, raw = piece.lower().encode(), piece.encode()
    if len(low) != len(raw):
        raw = low  # a lower case of another length: no capitals are seen
    b, r = np.frombuffer(low, "u1"), np.frombuffer(raw, "u1")
    kinds = CLASS[b]
    inside = np.zeros(len(b) + 2, "i1")
    inside[1:-1] = (kinds == LETTER) | (kinds == DIGIT)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.flatnonzero(kinds == MARK)
    if not len(starts):
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, bool), bool(len(stops))
    value = word_hashes(low, starts, ends)
    seen = np.searchsorted(stops, starts)
    after = np.diff(seen, prepend=0) > 0
    second = np.minimum(starts + 1, len(b) - 1)
    capital = (r[starts] != b[starts]) | ((b[starts] >= 0xC3) & (r[second] != b[second]))
    kind = np.where(capital, 3, 0)
    number = np.flatnonzero(np.logical_or.reduceat(kinds == DIGIT, starts))
    kind[number] = 1
    unit = number[number + 1 < len(kind)] + 1
    if len(unit):
        known = marks()[3]
        place = np.minimum(np.searchsorted(known, value[unit]), len(known) - 1)
        kind[unit[(kind[unit] != 1) & (known[place] == value[unit])]] = 2
    return value, kind, after, bool(seen[-1] < len(stops))


def pieces_of(text: str) -> Iterator[str]:
    """The text cut at blanks into pieces of at most ``PIECE`` characters."""
    lo = 0
    while len(text) - lo > PIECE:
        cut = max(text.rfind(" ", lo, lo + PIECE), text.rfind("\n", lo, lo + PIECE))
        hi = cut + 1 if cut > lo else lo + PIECE
        yield text[lo:hi]
        lo = hi
    yield text[lo:] if lo else text


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (hashes of the words), template hashes in the three forms (3, n), and slot kinds of the second form."""
    values, kinds, befores, open_ = [], [], [], True
    for piece in pieces_of(text or ""):
        v, k, after, last = words_of(piece)
        if len(v):
            after[0] |= open_
        open_ = last if len(v) else open_ or last
        values.append(v)
        kinds.append(k)
        befores.append(after)
    value, kind, before = (x[0] if len(x) == 1 else np.concatenate(x) for x in (values, kinds, befores))
    number, name, unit, _ = marks()
    plain = np.where(kind == 1, number, np.where(kind == 2, unit, value)) if kind.any() else value
    capital = kind == 3
    kind = np.where(capital & before, 0, kind)  # a capital at the start of a sentence counts in the third form only
    return value, np.stack([plain, np.where(kind == 3, name, plain), np.where(capital, name, plain)]), kind


def window_hashes(value: np.ndarray, forms: np.ndarray, kind: np.ndarray, span: int) -> np.ndarray:
    """Hashes of all windows in the forms (3, n - span + 1); texts shorter than a window have one of their own length."""
    n = len(value)
    width = min(span, n)
    if n == 0:
        return np.zeros((3, 0), "u8")
    count = n - width + 1

    def rolled(x: np.ndarray, at=slice(0, None)) -> np.ndarray:
        h = np.zeros(count, "u8")[at]
        for k in range(width):
            h = mixed(h) + x[k : count + k][at]
        return mixed(h) ^ np.uint64(width if n < span else 0)

    exact = rolled(value)
    out = np.broadcast_to(exact, (3, count)).copy()
    for f, form in enumerate(forms):
        sums = np.concatenate([[0], np.cumsum(form == value)])
        literal = sums[width:] - sums[:-width]
        at = np.flatnonzero((literal < width) & (literal >= min(LITERAL[f], width)))
        out[f, at] = rolled(form, at)
    return out


def rows_of(text: str | None, span: int, keep=None) -> tuple[np.ndarray, np.ndarray, list]:
    """Window hashes (distinct forms), their positions, and the values of the slots of each."""
    value, forms, kind = template(text)
    h = window_hashes(value, forms, kind, span)
    width = min(span, len(value))
    hs, ps, slots = [], [], []
    for f in range(len(h)):
        # a later form counts where it differs
        at = np.arange(h.shape[1]) if f == 0 else np.flatnonzero((h[f] != h[:f]).all(0))
        if keep is not None:
            at = at[keep(h[f, at])]
        slot = forms[f] != value  # placeholders of this form
        slots += [value[p : p + width][slot[p : p + width]].view("i8").tolist() for p in at]
        hs.append(h[f, at])
        ps.append(at)
    return np.concatenate(hs).view("i8"), np.concatenate(ps), slots


def windows(rows: DataFrame, text: str, key: str, span: int, bits=None) -> DataFrame:
    """(id, h, pos, slots): the windows of every text, or those in a broadcast bit filter."""
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if bits is None else (lambda h: passes(bits.value, h))
        for batch in batches:
            ids, hs, ps, ss = [], [], [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t")):
                h, p, s = rows_of(t.as_py(), span, keep)
                ids += [i] * len(h)
                hs.append(h)
                ps.append(p)
                ss += s
            if ids:
                cols = [pa.array(ids, pa.int64()), pa.array(np.concatenate(hs)), pa.array(np.concatenate(ps).astype("i8")), pa.array(ss, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "pos", "slots"])

    return base.mapInArrow(run, "id long, h long, pos long, slots array<long>")


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes whose two bits are set in the filter."""
    size = np.uint64((1 << FILTER_BITS) - 1)
    a, b = (h & size).astype("i8"), ((h >> np.uint64(FILTER_BITS)) & size).astype("i8")
    hit = (bits[a >> 3] >> (a & 7).astype("u1")) & 1
    return (hit & (bits[b >> 3] >> (b & 7).astype("u1"))).astype(bool)


def bit_filter(items: DataFrame) -> np.ndarray:
    """The filter over all windows of the benchmark: at most 2 ** FILTER_BITS / 64 words reach the driver."""
    h, low = F.col("h"), (1 << FILTER_BITS) - 1
    bit = F.explode(F.array(h.bitwiseAND(F.lit(low)), F.shiftrightunsigned(h, FILTER_BITS).bitwiseAND(F.lit(low))))
    words = items.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("m"))
    out = np.zeros((1 << FILTER_BITS) // 64, "i8")
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out.view("u1")


def agreement(i: np.ndarray, d: np.ndarray) -> float:
    """Share of slots that agree with the most frequent partner of their value, on the side where it is smaller."""
    if not len(i):
        return 1.0
    pair, c = np.unique(np.stack([i, d]), axis=1, return_counts=True)
    best = 1.0
    for side in pair:
        _, at = np.unique(side, return_inverse=True)
        top = np.zeros(at.max() + 1, "i8")
        np.maximum.at(top, at, c)
        best = min(best, float(top.sum() / len(i)))
    return best


def judged(n: int, at: np.ndarray, off: np.ndarray, same: np.ndarray, owner: np.ndarray, ivalue: np.ndarray, dvalue: np.ndarray, share: float) -> tuple[float, float] | None:
    """(coverage, consistency) of an item of n windows in a document, None if it is not found.

    Per match: item position, diagonal and equality of all slots; per pair of slots: its match and both values.
    """

    def voted(use: np.ndarray) -> float:
        some = use[owner]
        return agreement(ivalue[some], dvalue[some])

    verbatim = len(np.unique(at[same]))
    if verbatim >= share * n:  # no vote on a copy word for word
        return len(np.unique(at)) / n, 1.0
    # the document as a whole: each of its windows stands at the item position with equal slots, else at the first one
    order = np.lexsort((at, ~same, at + off))
    whole = np.zeros(len(at), bool)
    whole[order[np.diff((at + off)[order], prepend=-1) != 0]] = True
    consistency = voted(whole)
    if consistency >= share:
        return len(np.unique(at)) / n, consistency
    diagonals, count = np.unique(off, return_counts=True)
    slack = max(SPAN, n // 4)  # words put in or left out within an occurrence
    order = np.argsort(off, kind="stable")
    lo, hi = np.searchsorted(off[order], diagonals - slack), np.searchsorted(off[order], diagonals + slack, "right")
    for k in np.argsort(-count, kind="stable"):
        if hi[k] - lo[k] < share * n:
            continue
        band = order[lo[k] : hi[k]]
        band = band[np.lexsort((np.abs(off[band] - diagonals[k]), at[band]))]
        first = np.diff(at[band], prepend=-1) != 0
        if first.sum() < share * n:
            continue
        nearest = off[band][first][np.cumsum(first) - 1]
        use = np.zeros(len(at), bool)
        use[band[off[band] == nearest]] = True  # in all forms
        consistency = voted(use)
        if consistency >= share:
            return float(first.sum() / n), consistency
    return None


def judge(share: float):
    """Judges the matches of one document and item."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values(["at", "pos"], ignore_index=True)
        owner, left, right, same = [], [], [], []
        for k, (i, d) in enumerate(zip(m["islots"], m["slots"])):
            i, d = list(i), list(d)
            fit = len(i) == len(d)
            same.append(not fit or i == d)
            if fit:
                owner += [k] * len(i)
                left += i
                right += d
        at = m["at"].to_numpy("i8")
        got = judged(int(m["n"].iloc[0]), at, m["pos"].to_numpy("i8") - at, np.array(same), np.array(owner, "i8"), np.array(left, "i8"), np.array(right, "i8"), share)
        rows = [] if got is None else [(int(m["doc"].iloc[0]), int(m["item"].iloc[0]), *got)]
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "consistency"])

    return run


def findings(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, coverage, consistency) of every item found in a document."""
    spark = docs.sparkSession
    items = saved(windows(benchmark, item_text, item_id, span).where("id IS NOT NULL").distinct(), "items")
    sizes = items.groupBy(F.col("id").alias("item")).agg(F.countDistinct("pos").alias("n"))
    bits = spark.sparkContext.broadcast(bit_filter(items))
    hits = windows(docs, text, doc_id, span, bits).where("id IS NOT NULL").withColumnRenamed("id", "doc")
    known = items.groupBy("h", F.col("id").alias("item")).agg(F.collect_list(F.struct(F.col("pos").alias("at"), F.col("slots").alias("islots"))).alias("known"))
    hits = saved(hits.join(known, "h").select("doc", "item", "pos", "slots", "known"), "hits")
    covered = hits.select("doc", "item", F.explode("known.at").alias("p")).groupBy("doc", "item").agg(F.countDistinct("p").alias("m"))
    likely = covered.join(sizes, "item").where(F.col("m") >= share * F.col("n")).select("doc", "item", "n")
    likely = saved(likely, "likely")
    matches = hits.join(likely, ["doc", "item"]).select("doc", "item", "n", "pos", "slots", F.explode("known").alias("k")).select("doc", "item", "n", "pos", "slots", "k.*")
    return matches.groupBy("doc", "item").applyInPandas(judge(share), "doc_id long, item_id long, coverage double, consistency double")


def flagged(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **more) -> DataFrame:
    """One row per document with an item: doc_id, item_ids (sorted), coverage and consistency of the best."""
    found = findings(docs, benchmark, text, doc_id, **more)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("consistency").alias("consistency"))
