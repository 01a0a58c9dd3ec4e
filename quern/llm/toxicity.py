"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word enters as the sum of an embedding of its hash bucket and the mean embedding of its hashed letter trigrams. The
network runs over overlapping windows of words; inside each window an attention over positions pools the states to one
logit. A document scores as its highest window, so one bad passage in a long text counts. Every window of every text
is scored.

Training (numpy, backpropagation through time) knows labels of documents only: each round scores all windows of the
bounded sample and learns from each document's highest window.

Defined results: null texts and texts without words have no window and score the share of label 1 in the sample,
capped below one half; without labelled rows every score is 0. Equal texts get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import gru

WINDOW, STRIDE = 64, 48  # words of one window, words between the starts of two
UNITS = 8  # state size of each direction
WIDTH = 12  # size of the word vectors
WORDS, TRIGRAMS = 1 << 14, 1 << 12  # hash buckets
BATCH = 1024  # windows run at once
SAMPLE_ROWS = (2500, 1000)  # training rows of label 0 and of label 1 at most
SAMPLE_CHARS = 8000  # training rows have at most so many characters; scoring knows no such limit
ROUNDS, STEPS = 9, 500  # passes over the sample at least, training steps at least
CACHE = 60_000  # distinct words whose gate inputs a task keeps
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, rows: tuple[int, int] = SAMPLE_ROWS) -> list:
    """(label, text) pairs of at most ``rows`` documents per label, chosen by hash of the identifier.

    Only the chosen identifiers, at most three times ``rows`` per label on average, are broadcast to the documents.
    """
    y = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__y"))
    y = y.withColumn("__h", F.xxhash64("__id"))
    counts = {r["__y"]: r["n"] for r in y.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    top = 2.0**63
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(top - 1024, -top + 2 * top * 2.5 * rows[k] / n)))])
    y = y.where(F.col("__h") <= limits[F.col("__y")]).orderBy("__h").limit(4 * sum(rows))
    d = docs.where(F.length(text) <= SAMPLE_CHARS).select(F.col(doc_id).alias("__id"), F.col(text).alias("__t"))
    d = d.join(F.broadcast(y), "__id").dropDuplicates(["__id"])
    out = []
    for k in counts:
        out += [(r["__y"], r["__t"]) for r in d.where(F.col("__y") == k).orderBy("__h").limit(rows[k]).select("__y", "__t").collect()]
    return out


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of words; those of their byte trigrams (ends marked) in one row; trigrams per word."""
    marked = [b"<%b>" % w.encode() for w in words]
    sizes = np.array([len(b) for b in marked], "i8")
    b = np.frombuffer(b"".join(marked), "u1").astype("u4")
    tri = (b[:-2] * 65599 + b[1:-1] * 8191 + b[2:] * 127) * np.uint32(2654435761) >> np.uint32(16)
    ends = np.cumsum(sizes)
    inside = np.ones(len(b), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return np.array([zlib.crc32(x) % WORDS for x in marked], "i8"), (tri % TRIGRAMS).astype("i8")[inside[:-2]], sizes - 2


def spans(words: int) -> list[int]:
    """Starts of the overlapping windows that cover so many words."""
    return [] if words == 0 else list(range(0, max(1, words - WINDOW + STRIDE), STRIDE))


def vectors(p: dict, word: np.ndarray, tri: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Word vectors, one row per word."""
    if not len(word):
        return np.zeros((0, WIDTH), "f4")
    mean = np.add.reduceat(p["tri"].take(tri, axis=0), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype("f4")
    return p["word"].take(word, axis=0) + mean


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by number, as an array of n rows."""
    out = np.zeros((n, rows.shape[1]), "f4")
    if len(at):
        order = np.argsort(at, kind="stable")
        keys = at[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out[keys[first]] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    return out


def gate_table(p: dict, v: np.ndarray) -> np.ndarray:
    """Gate inputs (2, 3 * units, words + 1) of word vectors; the last column is padding."""
    k = p["u"].shape[2]
    t = p["in"] @ v.T + p["b"][:, :, None]
    pad = np.zeros((2, 3 * k, 1), "f4")
    pad[:, :k] = gru.KEEP
    return np.concatenate([t, pad], axis=2).astype("f4")


def gates(rows: list[np.ndarray], b: np.ndarray):
    """Reads the gate inputs of word numbers ``b`` (steps, batch) from one (words, 3 * units) table per direction."""

    def read(d: int, s: int, out: np.ndarray) -> None:
        np.copyto(out, rows[d].take(b[s], axis=0).T)

    return read


def attend(p: dict, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of windows, attention (steps, batch) and pooled states (2 * units, batch)."""
    s = np.einsum("k,skb->sb", p["att"], h) + (mask - 1) * 1e4
    e = np.exp(s - s.max(0))
    alpha = e / e.sum(0)
    c = np.einsum("sb,skb->kb", alpha, h)
    return p["out"] @ c + p["bias"], alpha, c


def window_logits(p: dict, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logits of windows given as word numbers (windows, WINDOW); padding is the last column of the table."""
    out, pad, rows = [], table.shape[2] - 1, [np.ascontiguousarray(t.T) for t in table]
    for lo in range(0, len(ids), BATCH):
        b = np.ascontiguousarray(ids[lo : lo + BATCH].T)
        h = gru.states(gates(rows, b), p["u"], WINDOW, b.shape[1])
        out.append(attend(p, h, b != pad)[0])
    return np.concatenate(out) if out else np.zeros(0, "f4")


def windows(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of documents given as word numbers, and the document of each."""
    starts = [spans(len(d)) for d in docs]
    ids = np.full((sum(map(len, starts)), WINDOW), pad, "i8")
    own = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    i = 0
    for d, st in zip(docs, starts):
        for s in st:
            piece = d[s : s + WINDOW]
            ids[i, : len(piece)] = piece
            i += 1
    return ids, own


def train(pairs: list, rounds: int = ROUNDS, steps: int = STEPS, batch: int = 64, seed: int = 11) -> dict | None:
    """Weights from (label, text) pairs; None without pairs."""
    if not pairs:
        return None
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in WORD.findall(t.lower())], "i8") for _, t in pairs]
    y = np.array([a for a, _ in pairs], "f4")
    prior = float(y.mean())
    word, tri, sizes = word_buckets(list(vocab)) if vocab else (np.zeros(0, "i8"),) * 3
    starts = np.cumsum(sizes) - sizes
    k = UNITS
    p = {
        "word": rng.normal(0, 0.05, (WORDS, WIDTH)).astype("f4"),
        "tri": rng.normal(0, 0.3, (TRIGRAMS, WIDTH)).astype("f4"),
        "in": rng.normal(0, 0.4, (2, 3 * k, WIDTH)).astype("f4"),
        "b": gru.init_bias(k),
        "u": gru.init_recurrent(rng, k),
        "att": rng.normal(0, 0.3, 2 * k).astype("f4"),
        "out": rng.normal(0, 0.3, 2 * k).astype("f4"),
        "bias": np.zeros(1, "f4"),
    }
    ids, own = windows(docs, len(vocab))
    if not len(ids):
        return {"prior": prior, **p}
    first = np.searchsorted(own, np.arange(len(docs)))
    has = np.flatnonzero(np.bincount(own, minlength=len(docs)))
    rounds = max(rounds, -(-steps * batch // max(1, len(has))))
    opt = gru.Adam(p, 0.015, rounds * (len(has) // batch + 1) + 3 * (int((y[has] == 0).sum()) // batch + 1))
    last = np.append(first[1:], len(ids))
    # early rounds follow short documents more: what a label says about a window is surer there
    for r in range(rounds):
        table = gate_table(p, vectors(p, word, tri, sizes))
        score = window_logits(p, table, ids) if r else rng.random(len(ids))
        best = np.array([first[d] + int(np.argmax(score[first[d] : last[d]])) for d in has])
        other = np.array([rng.integers(first[d], last[d]) for d in has[y[has] == 0]]) if r < 3 else has[:0]
        sure = 1.0 / (last[has] - first[has]) if r < 3 else np.ones(len(has))
        picks = np.concatenate([best, other])
        target = np.concatenate([y[has], np.zeros(len(other), "f4")])
        weight = np.concatenate([np.where(y[has] == 1, sure, 1.0), np.full(len(other), 0.5)])
        order = rng.permutation(len(picks))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            b, t, wt = ids[picks[at]].T, target[at], weight[at]
            words, local = np.unique(b, return_inverse=True)
            local = local.reshape(b.shape)
            real = words[words < len(vocab)]
            n_tri = sizes[real]
            at_tri = tri[np.repeat(starts[real] - np.cumsum(n_tri) + n_tri, n_tri) + np.arange(n_tri.sum())]
            drop = rng.random(len(real)) < 0.5  # a dropped word channel makes the letters speak
            v = vectors(p, word[real], at_tri, n_tri)
            v[drop] -= p["word"][word[real][drop]]
            x = gate_table(p, v)
            local = np.where(b < len(vocab), local, x.shape[2] - 1)
            mask = b < len(vocab)
            h, kept = gru.forward(np.ascontiguousarray(x[:, :, local].transpose(0, 2, 1, 3)), p["u"])
            logit, alpha, c = attend(p, h, mask)
            g = ((1 / (1 + np.exp(-logit)) - t) * wt / len(at)).astype("f4")
            dc = np.outer(p["out"], g)
            da = np.einsum("kb,skb->sb", dc, h)
            ds = alpha * (da - (alpha * da).sum(0))
            dh = alpha[:, None, :] * dc[None] + p["att"][None, :, None] * ds[:, None, :]
            dx, du = gru.backward(dh.astype("f4"), p["u"], kept)
            dt = summed(dx.transpose(1, 3, 0, 2).reshape(local.size, 6 * k), local.reshape(-1), x.shape[2])[: len(real)]
            dv = dt @ p["in"].reshape(6 * k, WIDTH)
            dw = summed(dv[~drop], word[real][~drop], WORDS)
            dtri = summed(np.repeat(dv / np.maximum(n_tri, 1)[:, None].astype("f4"), n_tri, axis=0), at_tri, TRIGRAMS)
            dw += 1e-5 * p["word"]
            grads = {"word": dw, "tri": dtri, "u": du, "in": (dt.T @ v).reshape(p["in"].shape), "b": dt.sum(0).reshape(p["b"].shape)}
            opt.update(grads | {"att": np.einsum("sb,skb->k", ds, h), "out": c @ g, "bias": np.array([g.sum()], "f4")})
    return {"prior": prior, **p}


class Scorer:
    """Scores texts with a model; keeps the gate inputs of words it has seen, up to ``CACHE`` words."""

    def __init__(self, model: dict):
        self.p, self.base = model, min(0.49, model["prior"])
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        pad = np.zeros((1, 3 * UNITS), "f4")
        pad[:, :UNITS] = gru.KEEP
        self.rows = [pad, pad]  # number 0 is padding

    def numbers(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            for w in new:
                ids[w] = len(ids) + 1
            more = gate_table(self.p, vectors(self.p, *word_buckets(new)))[:, :, :-1]
            self.rows = [np.concatenate([a, np.ascontiguousarray(b.T)]) for a, b in zip(self.rows, more)]
        return np.fromiter(map(ids.__getitem__, words), "i8", len(words))

    def logits(self, ids: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(ids), BATCH):
            b = np.ascontiguousarray(ids[lo : lo + BATCH].T)
            h = gru.states(gates(self.rows, b), self.p["u"], WINDOW, b.shape[1])
            out.append(attend(self.p, h, b != 0)[0])
        return np.concatenate(out)

    def scores(self, texts: list[str | None], piece: int = 50_000) -> np.ndarray:
        """Highest window of each text; texts go through in groups of about ``piece`` words."""
        best = np.full(len(texts), -np.inf)
        group: list[tuple[int, list[str]]] = []
        waiting = 0

        def flush() -> None:
            nonlocal group, waiting
            if not group:
                return
            if len(self.ids) > CACHE:
                self.clear()
            flat = self.numbers([w for _, ws in group for w in ws])
            at, docs = 0, []
            for _, ws in group:
                docs.append(flat[at : at + len(ws)])
                at += len(ws)
            ids, own = windows(docs, 0)
            np.maximum.at(best, np.array([i for i, _ in group])[own], self.logits(ids))
            group, waiting = [], 0

        for i, t in enumerate(texts):
            words = WORD.findall((t or "").lower())
            if not words:
                continue
            for lo in range(0, max(1, len(words) - WINDOW + STRIDE), piece // STRIDE * STRIDE):
                # long texts are cut at window starts, each part with the rest of its last window
                part = words[lo : lo + piece // STRIDE * STRIDE + WINDOW - STRIDE]
                group.append((i, part))
                waiting += len(part)
                if waiting >= piece:
                    flush()
        flush()
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -60, 60))), self.base)


def score(docs: DataFrame, model: dict | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score to every row; a column named alike is replaced."""
    keep = [c for c in docs.columns if c != out]
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model is not None else None
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            s = scorer.scores(texts) if scorer else np.zeros(len(texts))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64())], names=[*keep, out])

    return base.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Learns from labelled rows that are not held out and scores every row."""
    return score(docs, train(sample(docs, labels, text, doc_id, label)), text)
