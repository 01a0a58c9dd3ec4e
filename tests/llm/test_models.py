"""Language and toxicity models: gradients, held-out accuracy, defined results of odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm import gru, langid, toxicity


def test_backward_matches_differences():
    rng = np.random.default_rng(0)
    k, steps, batch = 3, 5, 2
    u = rng.normal(0, 0.4, (2, 3 * k, k)).astype("f4")
    x = rng.normal(0, 0.3, (2, steps, 3 * k, batch)).astype("f4") + gru.init_bias(k)[:, None, :, None] * 0.8
    w = rng.normal(size=(steps, 2 * k, batch)).astype("f4")
    loss = lambda x, u: float((gru.forward(x, u)[0].astype("f8") * w).sum())
    dx, du = gru.backward(w, u, gru.forward(x, u)[1])
    eps = 1e-3
    for a, da, swap in ((x, dx, lambda v: loss(v, u)), (u, du, lambda v: loss(x, v))):
        for _ in range(40):
            at = tuple(rng.integers(0, s) for s in a.shape)
            up, down = a.copy(), a.copy()
            up[at] += eps
            down[at] -= eps
            assert abs((swap(up) - swap(down)) / (2 * eps) - da[at]) < 2e-2


def test_states_match_the_training_pass():
    rng = np.random.default_rng(2)
    u, x = gru.init_recurrent(rng, 4), rng.normal(size=(2, 7, 12, 5)).astype("f4")
    want, _ = gru.forward(x, u)
    got = gru.states(lambda d, s, o: np.copyto(o, x[d, s]), u, 7, 5)
    assert np.allclose(want, got, atol=1e-5)


def test_language_is_learnt_and_odd_rows_are_defined(spark, corpus):
    pairs = langid.sample(corpus.where(~langid.held_out()), "text", "lang")
    assert pairs and {y for y, _ in pairs} == {"xa", "yo", "zu"}
    got = langid.predict(corpus, langid.train(pairs, rounds=150))
    assert got.columns == ["doc_id", "text", "lang", "text2", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == corpus.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (300, 301, 302, 303):
            assert r["lang_pred"] == "und" and r["score"] == 0
    held = got.where(langid.held_out() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert got.where("doc_id = 304").first()["lang_pred"] == "yo"


def test_long_texts_are_read_to_the_end():
    pairs = [(y, (c * 128).encode()) for y, c in (("a", "x"), ("b", "y")) for _ in range(20)]
    model = langid.train(pairs, rounds=80)
    q = langid.probabilities(model, [b"x" * 1000 + b"y" * 3000, b"y" * 1000 + b"x" * 3000, b""])
    assert q[0].argmax() == 1 and q[1].argmax() == 0 and q[2].sum() == 0


def test_language_without_labels_or_rows(spark, corpus, nothing):
    assert {r["lang_pred"] for r in langid.identify(corpus.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(nothing).count() == 0


def toxic_corpus(spark, corpus):
    bad = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" grobbel flumpf grobbel"))).otherwise(F.col("text"))
    docs = corpus.withColumn("text", bad)
    labels = docs.where("doc_id < 240").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).unionByName(
        spark.createDataFrame([(999, 1, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    )
    return docs, labels


def test_toxicity_is_learnt_and_odd_rows_are_defined(spark, corpus):
    docs, labels = toxic_corpus(spark, corpus)
    got = toxicity.assess(docs, labels)
    rows = {(r["doc_id"], r["text"]): r["score"] for r in got.collect()}
    assert got.count() == docs.count() and all(0 <= s <= 1 for s in rows.values())
    odd = {s for (i, _), s in rows.items() if i in (301, 302, 303)}
    assert len(odd) == 1 and odd.pop() < 0.5
    held = got.where(toxicity.held_out() & (F.col("doc_id") < 240)).collect()
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.9 * len(held)


def test_every_window_counts():
    pairs = [(i % 2, "plain words here " * 5 + ("grobbel " if i % 2 else "")) for i in range(60)]
    model = toxicity.train(pairs)
    s = toxicity.Scorer(model).scores(["plain words here " * 3000 + "grobbel", "plain words here " * 3000, None, ""], piece=1000)
    assert s[0] >= 0.5 > s[1] and s[2] == s[3] < 0.5


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        seen = {i for s in toxicity.spans(n) for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n))


def test_toxicity_without_labels(spark, corpus, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.assess(corpus, none).collect()} == {0.0}
    assert toxicity.assess(nothing, none).count() == 0
