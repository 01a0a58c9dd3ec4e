"""Language-model scoring by context-tree weighting over bytes.

A text is its words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, a blank between them, and an end mark. Every byte is
eight binary decisions. A decision has a Krichevsky-Trofimov estimate in each context of 0 to ``ORDER`` bytes before the
byte, across words, zeros standing before the text. The block probability of a context is half its own estimate and half
the product of its children's. Held against the training counts, that gives each depth its weight, and a byte's
probability mixes the estimates of all depths at which its decision has been seen. Minus its logarithm is the code
length.

How it runs: texts are packed into batches. A batch yields its distinct windows (context and byte) and words with their
training counts; aggregation adds them up over the corpus. Windows that share their last ``ROOT`` context bytes are
subtrees, several of which make a block that one task folds up, level by level; what it holds grows with distinct
windows, not with text. The levels above have at most 256 ** (ROOT - 1) contexts and are folded on the driver. Each
batch then gets the code lengths of its own windows and the counts of its own words back in a join, and scores its
texts. All training text is counted, nothing is pruned or hashed into tables of fixed size; words are told apart by a
tabulation hash of 63 bits.

Defined results: null, empty and blank texts hold the end mark only. Rows without identifier are learnt from. Repeated
rows are learnt from and scored as often as they occur. An empty table gives an empty result. Without training text
every decision has probability one half and the base score is zero. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BufferedReader
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import saved

ORDER = 5  # bytes of context at most
ROOT = 3  # bytes of context that the windows of one subtree share
END = b"\n"  # occurs in no word
FOLDS, LEFT_OUT = 7, 2  # documents with this remainder are not learnt from
BATCH = 32 << 20  # bytes of text after which a batch ends
PIECE = 1 << 19  # bytes whose windows are cut at once
PENDING = 1 << 20  # keys that wait to be added up
TEXT_BITS = 15  # a piece has fewer texts than that gives numbers; with a gram they fit a signed long
SCATTER = np.random.default_rng(1).integers(0, 1 << 64, (256, 256), "u8", endpoint=False)  # random numbers of the hash of words, by place and byte
END_KEY = -1
BLOCK = 200_000  # windows of a block of subtrees
PACKED = "batch long, text binary, size binary, doc binary, named binary, held binary"
TREE = "ctx int, node int, zeros long, ones long, below double, gram binary, count binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series from x + 8 down."""
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3)
    return s - shift - np.log(x + 4) - np.log(x + 5) - np.log(x + 6) - np.log(x + 7)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def blobs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array([c.tobytes()], pa.binary()) for c in columns]


def packed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per batch of texts: the normalised texts end to end (compressed), their sizes, identifiers and folds."""
    i = F.col(f"`{doc_id}`")
    base = docs.select(i.cast("long").alias("i"), F.coalesce(i.cast("string"), F.lit("")).alias("s"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId() << 24, 0
        squeeze, parts, sizes, ids, held = zstandard.ZstdCompressor(1).compressobj(), [], [], [], []

        def out() -> pa.RecordBatch:
            named = np.array([d is not None for d in ids], "u1")
            row = [pa.array([number]), pa.array([b"".join([*parts, squeeze.flush()])], pa.binary())]
            row += blobs(np.array(sizes, "i8"), np.array([d or 0 for d in ids], "i8"), named, np.array(held, "u1"))
            return pa.RecordBatch.from_arrays(row, names=names(PACKED))

        for batch in batches:
            for i, s, t in zip(batch.column("i"), batch.column("s"), batch.column("t")):
                plain = b" ".join(t.as_py().lower().split()) + END
                parts.append(squeeze.compress(plain))
                sizes.append(len(plain))
                ids.append(i.as_py())
                held.append(i.is_valid and crc32(s.as_py().encode()) % FOLDS == LEFT_OUT)
                total += len(plain)
                if total >= BATCH:
                    yield out()
                    number, total = number + 1, 0
                    squeeze, parts, sizes, ids, held = zstandard.ZstdCompressor(1).compressobj(), [], [], [], []
        if sizes:
            yield out()

    return base.mapInArrow(run, PACKED)


def unpacked(text: bytes, size: bytes, order: int = ORDER) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(number of the first text, grams, texts) of pieces of a batch; a gram is the context, latest byte first, then the byte."""
    size = np.frombuffer(size, "i8")
    line, end = BufferedReader(zstandard.ZstdDecompressor().stream_reader(text)), np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = min(lo + (1 << TEXT_BITS), max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + PIECE))))
        texts = [line.read(n) for n in size[lo:hi].tolist()]
        yield lo, windows(texts, order), texts
        lo = hi


def windows(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The grams of every byte of the texts, one after the other."""
    pad = b"\0" * order
    line = np.frombuffer(b"".join(pad + t for t in texts), "u1").astype("i8")
    gram = line.copy()
    for k in range(1, order + 1):
        gram[k:] |= line[:-k] << (8 * (order + 1 - k))
    size = np.fromiter(map(len, texts), "i8", len(texts))
    first = np.cumsum(size + order) - size
    return gram[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) of every token; keys of words are negative, grams are not."""
    line = np.frombuffer(b"".join(texts), "u1")
    size = np.fromiter(map(len, texts), "i8", len(texts))
    inside = (line != 0x20) & (line != END[0])
    at = np.flatnonzero(inside)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)[: len(at)])
    place = at - np.repeat(at[first], np.diff(np.append(first, len(at))))
    mixed_in = SCATTER[place & 255, line[at]] * (2 * (place >> 8) + 1).astype("u8")
    key = np.add.reduceat(mixed_in, first) if len(first) else mixed_in
    key = (key | np.uint64(1 << 63)).view("i8")
    text = np.searchsorted(np.cumsum(size), at[first], "right")
    return np.append(key, np.full(len(texts), END_KEY)), np.append(text, np.arange(len(texts)))


def summed(key: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts; the given keys are in order each."""
    every = np.concatenate(key)
    order = np.argsort(every, kind="stable")  # merges what is in order already
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.add.reduceat(np.concatenate(count)[order], first)


def counted(batches: DataFrame) -> DataFrame:
    """(batch, key, count): the distinct grams and words of each batch with their training counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for row in range(b.num_rows):
                text, size, number = (b.column(c)[row].as_py() for c in ("text", "size", "batch"))
                train = np.frombuffer(b.column("held")[row].as_buffer(), "u1") == 0
                keys, counts = [], []
                for lo, gram, texts in unpacked(text, size):
                    mine = train[lo : lo + len(texts)]
                    key, of = words(texts)
                    every = np.append(key, gram)
                    learnt = np.append(mine[of], np.repeat(mine, list(map(len, texts))))
                    each, n = np.unique(every[learnt], return_counts=True)
                    other = np.unique(every[~learnt])
                    keys += [each, other]
                    counts += [n, np.zeros(len(other), "i8")]
                    if sum(map(len, keys[1:])) > PENDING:
                        keys, counts = ([x] for x in summed(keys, counts))
                key, count = summed(keys, counts)
                for lo in range(0, len(key), PIECE):
                    k = key[lo : lo + PIECE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), number)), pa.array(k), pa.array(count[lo : lo + len(k)])], names=["batch", "key", "count"])

    return batches.select("batch", "text", "size", "held").mapInArrow(run, "batch long, key long, count long")


class Level:
    """The windows of one context depth: distinct (context, byte) in order, their counts, and the decisions they make."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.key, self.count = key, count

    def shorter(self) -> tuple["Level", np.ndarray]:
        """The level with the oldest context byte left off, and where each window of this one lies in it."""
        key, up = np.unique((self.key >> 16 << 8) | (self.key & 255), return_inverse=True)
        return Level(key, np.bincount(up, weights=self.count, minlength=len(key))), up

    def decide(self, j: int) -> None:
        """Decision j of every window: group of equal context and leading bits, the bit, and zeros and ones of the group."""
        lead = self.key >> (8 - j)
        new = np.append(True, lead[1:] != lead[:-1])
        self.first, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        self.bit = (self.key >> (7 - j)) & 1
        self.ones = np.bincount(self.group, weights=self.count * self.bit)
        self.zeros = np.bincount(self.group, weights=self.count) - self.ones


def mixed(own: np.ndarray, chance: np.ndarray, deeper: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Probability at a depth: its weight times its estimate plus the rest times the deeper one, if that has been seen."""
    return np.where(known, own * chance + (1 - own) * deeper, chance)


def fold(gram: np.ndarray, count: np.ndarray, tops: list[tuple[np.ndarray, ...]] | None = None) -> np.ndarray | list[np.ndarray]:
    """Fold subtrees up from the longest contexts to those of ``ROOT`` bytes.

    ``gram`` is distinct and in order. Without ``tops`` the sums for the contexts above are returned (context, node,
    zeros, ones, log probability); with them the log10 probability of each window's byte.
    """
    levels, ups = [Level(gram, count.astype("f8"))], []
    for _ in range(ORDER - ROOT):
        level, up = levels[-1].shorter()
        levels.append(level)
        ups.append(up)
    out, sums = np.zeros(len(gram)), []
    for j in range(8):
        at = np.arange(len(gram))
        child = None
        for depth, level in enumerate(levels):
            level.decide(j)
            kt = estimate(level.zeros, level.ones)
            if child is None:
                level.log = kt
            else:
                below = np.bincount(level.group[ups[depth - 1][child.first]], weights=child.log, minlength=len(kt))
                level.log = np.logaddexp(kt, below) - np.log(2)
                at = ups[depth - 1][at]
            if tops is not None:
                g = level.group[at]
                bit, zeros, ones = level.bit[at], level.zeros[g], level.ones[g]
                chance = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
                own = np.exp(kt - np.log(2) - level.log)[g]
                p = chance if child is None else mixed(own, chance, p, known)
                known = zeros + ones > 0
            child = level
        if tops is None:
            key = child.key[child.first]
            node = (1 << j) | ((key & 255) >> (8 - j))
            context, where = np.unique((key >> 16 << 8) | node, return_inverse=True)
            total = lambda x: np.bincount(where, weights=x, minlength=len(context))
            sums.append([context >> 8, context & 255, total(child.zeros), total(child.ones), total(child.log)])
        else:
            node = (1 << j) | ((gram & 255) >> (8 - j))
            bit = (gram >> (7 - j)) & 1
            for length, (key, zeros, ones, own) in zip(range(ROOT - 1, -1, -1), tops):
                r = np.searchsorted(key, (gram >> 8 * (ORDER + 1 - length) << 8) | node)
                chance = (np.where(bit == 1, ones[r], zeros[r]) + 0.5) / (zeros[r] + ones[r] + 1)
                p = mixed(own[r], chance, p, known)
                known = zeros[r] + ones[r] > 0
            out += np.log10(np.where(known, p, 0.5))
    return out if tops is not None else [np.concatenate(c) for c in zip(*sums)]


def top_levels(ctx: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(key, zeros, ones, weight) of the depths under ``ROOT``, longest first, from sums per context and node."""
    out, ctx = [], ctx.astype("i8")
    for _ in range(ROOT):
        key, at = np.unique(ctx << 8 | node, return_inverse=True)
        zeros, ones, below = (np.bincount(at, weights=x, minlength=len(key)) for x in (zeros, ones, below))
        kt = estimate(zeros, ones)
        log = np.logaddexp(kt, below) - np.log(2)
        out.append((key, zeros, ones, np.exp(kt - np.log(2) - log)))
        ctx, node, below = key >> 16, key & 255, log
    return out


def tree(totals: DataFrame, blocks: int) -> DataFrame:
    """Blocks of subtrees (grams and counts) and their sums for the contexts above, from (key, count) of all grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(b.column("key").to_numpy(), b.column("count").to_numpy()) for b in batches if b.num_rows]
        if not table:
            return
        gram, count = (np.concatenate(c) for c in zip(*table))
        order = np.argsort(gram)
        gram, count = gram[order], count[order]
        ctx, node, zeros, ones, below = fold(gram, count)
        empty = [pa.nulls(len(ctx), pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(ctx, pa.int32()), pa.array(node, pa.int32()), pa.array(zeros.astype("i8")), pa.array(ones.astype("i8")), pa.array(below), *empty], names=names(TREE))
        gone = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([*gone, *blobs(gram, count)], names=names(TREE))

    suffix = F.shiftright("key", 8 * (ORDER + 1 - ROOT))
    return totals.select("key", "count", suffix.alias("suffix")).repartition(blocks, "suffix").select("key", "count").mapInArrow(run, TREE)


def lengths(blocks: DataFrame, tops: list[tuple[np.ndarray, ...]]) -> DataFrame:
    """(key, value): log10 probability of every gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                gram, count = (np.frombuffer(batch.column(c)[row].as_buffer(), "i8") for c in ("gram", "count"))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(fold(gram, count, tops))], names=["key", "value"])

    return blocks.select("gram", "count").mapInArrow(run, "key long, value double")


def gram_values(totals: DataFrame) -> DataFrame:
    """(key, value): log10 probability of every gram of (key, count)."""
    grams = totals.where("key >= 0")
    folded = saved(tree(grams, -(-grams.count() // BLOCK) or 1), "tree")
    sums = folded.where("gram IS NULL").groupBy("ctx", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    rows = sums.toPandas()  # at most 256 ** (ROOT - 1) contexts of 255 nodes
    return lengths(folded.where("gram IS NOT NULL"), top_levels(*[rows[c].to_numpy() for c in ("ctx", "node", "zeros", "ones", "below")]))


def applied(text: pa.Table, values: pa.Table) -> pa.Table:
    """The scores of a batch's texts, given the values of its grams (log10 probability) and words (training count)."""
    key, value = values.column("key").to_numpy(), values.column("value").to_numpy()
    order = np.argsort(key)
    key, value = key[order], value[order]
    out = []
    for row in range(text.num_rows):
        doc, named, held = (np.frombuffer(text.column(c)[row].as_buffer(), t) for c, t in (("doc", "i8"), ("named", "u1"), ("held", "u1")))
        for lo, gram, texts in unpacked(text.column("text")[row].as_py(), text.column("size")[row].as_py()):
            size = np.array(list(map(len, texts)))
            # in order of the grams, the search runs through the keys once
            both = np.sort((gram << TEXT_BITS) | np.repeat(np.arange(len(texts)), size))
            gram = both >> TEXT_BITS
            new = np.append(True, gram[1:] != gram[:-1])
            score = value[np.searchsorted(key, gram[new])][np.cumsum(new) - 1]
            score = np.bincount(both & ((1 << TEXT_BITS) - 1), weights=score, minlength=len(texts))
            token, of = words(texts)
            count = value[np.searchsorted(key, token)]
            total = lambda x: np.bincount(of, weights=x, minlength=len(texts))
            part = slice(lo, lo + len(texts))
            out.append(pa.table([
                pa.array(doc[part], mask=named[part] == 0), pa.array(held[part] > 0), pa.array(np.bincount(of)),
                pa.array(total(count > 0).astype("i8")), pa.array(total(np.log10(count + 1))), pa.array(score), pa.array(size),
            ], names=names(SCORES)))
    empty = [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
    return pa.concat_tables(out) if out else pa.table(empty, names=names(SCORES))


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``score`` is the log10 probability by the tree, ``bits_per_byte`` its code length per byte; ``base_score`` that of a
    word model with one added to each count.
    """
    batches = saved(packed(docs, text, doc_id), "batches")
    pairs = saved(counted(batches), "counts")
    totals = saved(pairs.groupBy("key").agg(F.sum("count").alias("count")), "totals")
    tokens = totals.where("key < 0")
    size = tokens.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()
    values = gram_values(totals).unionByName(tokens.select("key", F.col("count").cast("double").alias("value")))
    back = pairs.select("batch", "key").join(values, "key").select("batch", "key", "value")
    out = batches.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(applied, SCORES)
    train = F.lit(size["n"]).cast("long")
    base = F.col("base") - F.col("n_tokens") * float(np.log10(size["n"] + size["v"] + 1))
    bits = -F.col("score") / F.col("n_bytes") / float(np.log10(2))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", train.alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))
