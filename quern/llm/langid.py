"""Language identification: a bidirectional gated recurrent network over bytes labels every position of a text.

Texts are cut into windows of ``WINDOW`` bytes (the last one padded); the network runs over all windows of a batch at
once in both directions, gives class probabilities for every byte, and the document's probabilities are their mean
over all its bytes. Trained in numpy by backpropagation through time on a bounded sample of labelled windows.

Defined results: null texts and texts without a letter are ``und`` with score 0; texts without labelled rows to learn
from are all ``und``; equal texts get equal results; other columns pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import gru

WINDOW = 128  # bytes of one window
UNITS = 8  # state size of each direction
BATCH = 1024  # windows run at once
SAMPLE_ROWS = 3000  # training rows per language at most, those with the smallest text hash
SAMPLE_WINDOWS = 3  # windows taken from one training row
ROUNDS = 500  # training steps
PAD = 256
UNKNOWN = "und"


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, text: str, lang: str, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS) -> list:
    """(language, bytes) pairs: a bounded number of distinct texts per language, a few windows of each.

    The bound per language is kept by the rank of the text hash inside hash ranges: a first pass counts distinct
    texts per language, the second keeps those whose hash lies below the matching quantile, so no task holds a
    language.
    """
    d = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("y"), F.col(text).cast("string").alias("t")
    )
    d = d.withColumn("h", F.xxhash64("t"))
    counts = {r["y"]: r["n"] for r in d.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return []
    top = 2.0**63
    limits = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, int(max(-top, min(top - 1024, -top + 2 * top * 0.9 * rows / n))))])
    d = d.where(F.col("h") <= limits[F.col("y")])
    size = F.length("t")
    cuts = [
        F.substring("t", (F.pmod(F.xxhash64("t", F.lit(k)), F.greatest(size - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
        for k in range(windows)
    ]
    d = d.select("y", "h", F.array(*cuts).alias("w")).groupBy("h").agg(F.min("y").alias("y"), F.min("w").alias("w"))
    pieces = d.select("y", F.explode("w").alias("w")).orderBy("y", F.xxhash64("w"), "w")
    return [(r["y"], r["w"].encode()[:WINDOW]) for r in pieces.limit(len(counts) * rows * windows).collect()]


def train(pairs: list, units: int = UNITS, rounds: int = ROUNDS, batch: int = 128, seed: int = 7) -> dict | None:
    """Weights from (language, bytes) pairs; None without pairs."""
    names = sorted({y for y, _ in pairs})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    x = np.full((len(pairs), WINDOW), PAD, "i4")
    for i, (_, b) in enumerate(pairs):
        x[i, : len(b)] = np.frombuffer(b, "u1")
    y = np.array([names.index(a) for a, _ in pairs])
    by = [np.flatnonzero(y == i) for i in range(len(names))]
    k, c = units, len(names)
    p = {
        "table": rng.normal(0, 0.3, (2, 3 * k, PAD + 1)).astype("f4") * np.r_[[0.5] * (2 * k), [1.0] * k].astype("f4")[None, :, None]
        + gru.init_bias(k)[:, :, None],
        "u": gru.init_recurrent(rng, k),
        "out": rng.normal(0, 0.3, (c, 2 * k)).astype("f4"),
        "bias": np.zeros(c, "f4"),
    }
    opt = gru.Adam(p, 0.02, rounds)
    p["table"][:, :k, PAD] = gru.KEEP
    eye = np.eye(PAD + 1, dtype="f4")
    span = 64
    for _ in range(rounds):
        rows = np.concatenate([rng.choice(i, batch // c + 1) for i in by])
        at = int(rng.integers(0, WINDOW - span + 1))
        b = x[rows, at : at + span].T  # (steps, batch)
        mask = (b != PAD).astype("f4")
        gates = p["table"][:, :, b].transpose(0, 2, 1, 3)  # (2, steps, 3k, batch)
        h, kept = gru.forward(np.ascontiguousarray(gates), p["u"])
        logits = np.einsum("ck,skb->scb", p["out"], h) + p["bias"][:, None]
        e = np.exp(logits - logits.max(1, keepdims=True))
        q = e / e.sum(1, keepdims=True)
        q[:, y[rows], np.arange(len(rows))] -= 1
        q *= (mask / max(1.0, mask.sum()))[:, None, :]
        dh = np.einsum("ck,scb->skb", p["out"], q)
        dx, du = gru.backward(dh, p["u"], kept)
        hot = eye[b.reshape(-1)]  # one-hot bytes: the gradient of the table is a product
        dt = np.stack([dx[d].transpose(1, 0, 2).reshape(3 * k, -1) @ hot for d in (0, 1)])
        opt.update({"table": dt, "u": du, "out": np.einsum("scb,skb->ck", q, h), "bias": q.sum((0, 2))})
        p["table"][:, :, PAD] = 0
        p["table"][:, :k, PAD] = gru.KEEP
    return {"names": names, **p}


def probabilities(model: dict, texts: list[bytes]) -> np.ndarray:
    """(texts, classes): mean over all bytes of the class probabilities at each byte; empty texts get zeros."""
    table, u, out, bias = model["table"], model["u"], model["out"], model["bias"]
    sizes = np.array([len(t) for t in texts], "i8")
    counts = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros((len(texts), len(bias)))
    for lo in range(0, int(first[-1]), BATCH):
        hi = min(lo + BATCH, int(first[-1]))
        i, j = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
        b = np.full((hi - lo, WINDOW), PAD, "i8")
        own = np.empty(hi - lo, "i8")
        for n in range(i, j):
            a, z = max(lo, first[n]), min(hi, first[n + 1])
            if a >= z:
                continue
            piece = np.frombuffer(texts[n], "u1", min(sizes[n], (z - first[n]) * WINDOW) - (a - first[n]) * WINDOW, (a - first[n]) * WINDOW)
            b[a - lo : z - lo].reshape(-1)[: len(piece)] = piece
            own[a - lo : z - lo] = n
        bt = np.ascontiguousarray(b.T)
        h = gru.states(lambda d, s, o: np.take(table[d], bt[s], axis=1, out=o, mode="clip"), u, WINDOW, hi - lo)
        q = np.matmul(out, h)  # (steps, classes, batch)
        q += bias[:, None]
        np.exp(q, out=q)
        q /= q.sum(1, keepdims=True)
        q *= (bt != PAD)[:, None, :]
        np.add.at(total, own, q.sum(0).T.astype("f8"))
    return total / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, model: dict | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its probability to every row; columns named alike are replaced."""
    keep = [c for c in docs.columns if c not in (pred, score)]
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(known, F.col(text).cast("string").cast("binary")).alias("__bytes"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(pred, "string").add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("__bytes")
            texts = [x.as_py() or b"" for x in raw]
            names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model is not None and texts:
                q = probabilities(model, texts)
                at = q.argmax(1)
                best = np.where([len(t) > 0 for t in texts], q[np.arange(len(texts)), at], 0.0)
                names = [model["names"][a] if t else UNKNOWN for a, t in zip(at, texts)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(np.clip(best, 0, 1))], names=[*keep, pred, score])

    return base.mapInArrow(run, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    model = train(sample(docs.where(~held_out(doc_id)), text, lang))
    return predict(docs, model, text)
