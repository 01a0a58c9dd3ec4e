"""Fingerprints, components, embeddings and decontamination against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontam, embdup, simhash
from quern.llm.components import components


def smallest(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rng = np.random.default_rng(3)
    n = 120
    edges = {"path": [(i, i + 1) for i in rng.permutation(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "random": rng.integers(0, n, (90, 2)).tolist()}[kind]
    edges = [(int(a), int(b)) for a, b in edges]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges + edges[:5] + [(None, 3)], "a long, b long")).collect()}
    want = smallest(n, [e for e in edges if e[0] != e[1]])
    assert all(want[v] == c for v, c in got.items()) and set(got) == {v for e in edges if e[0] != e[1] for v in e}


def test_fingerprint_by_definition():
    text = "One TWO\tthree\x0bfour  five six \xc9t\xe9 seven\n"
    words = ["one", "two", "three", "four", "five", "six", "\xc9t\xe9", "seven"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 5)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Ab cD") == xxhash.xxh64_intdigest(b"ab cd", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_thresholds_leave_no_pair_out():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2, (500, 64)).astype("f8")
    for n in (500, 10**6, 10**10):
        parts = simhash.plan(n, fps.T @ fps)
        assert sorted(b for bits, _ in parts for b in bits) == list(range(64))
        assert sum(t + 1 for _, t in parts) >= simhash.MOST + 1


def test_near_copies_match_all_pairs(spark, corpus):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    fps = list(base)
    for b in base[:12]:
        for _ in range(8):
            v = b & (2**64 - 1)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(bit)
            fps.append(v - 2**64 if v >= 2**63 else v)
    fps = sorted(set(fps))
    classes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "rep long, fp long")
    got = {r["vertex"]: r["component"] for r in components(simhash.links(classes)).collect()}
    u = np.array(fps, "i8").view("u8")
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    want = smallest(len(fps), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_near_copies_of_odd_rows(spark, corpus, nothing):
    got = simhash.near_copies(corpus).collect()
    assert len(got) == corpus.count()
    zero = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] in (300, 301, 302)}
    assert set(zero.values()) == {("0" * 16, 300)}
    assert simhash.near_copies(nothing).count() == 0


def vectors(spark, rng, n=400, dim=16):
    x = rng.normal(size=(n, dim))
    for i in range(n // 2, n):
        x[i] = x[int(rng.integers(0, n // 4))] + rng.normal(0, rng.choice([0, 0.05, 0.15, 0.3]), dim)
    x[7] = 2 * x[6]
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3)) for i in range(n)]
    odd = [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, [None] + [1.0] * (dim - 1), 1), (1004, rows[0][1], None), (1005, [1.0, 2.0], 0), (1006, [], 0), (1007, [float("inf")] * dim, 0)]
    return rows, spark.createDataFrame(rows + odd + [rows[3]], "vec_id long, embedding array<float>, label int"), odd


@pytest.mark.parametrize("tile", [1000, 40])
def test_embeddings_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embdup, "TILE", tile)
    rows, df, odd = vectors(spark, np.random.default_rng(6))
    all_rows = rows + [rows[3]]
    x = np.array([r[1] for r in all_rows], "f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in all_rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = embdup.near_vectors(df).collect()
    assert len(got) == len(all_rows) + len(odd)
    links = {}
    for r in got:
        links.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    for i, *_ in odd:
        assert links[i] == [(0, i, True)]
    mine = np.array([links[r[0]][0][0] for r in all_rows])
    assert (mine <= near.sum(1)).all() and mine.sum() >= 0.98 * near.sum()
    if mine.sum() == near.sum():
        want = smallest(len(all_rows), list(zip(*np.nonzero(near))))
        assert all(links[r[0]][0][1] == all_rows[w][0] for r, w in zip(all_rows, want))


def test_recall_holds_in_large_labels(spark, monkeypatch):
    """Pairs just above the bound, placed as in a label of a million vectors beside a small label."""
    rng = np.random.default_rng(8)
    dim, pairs = 32, 300
    x = rng.normal(size=(pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(pairs, dim))
    off -= (off * x).sum(1, keepdims=True) * x
    y = 0.932 * x + np.sqrt(1 - 0.932**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    rows = [(2 * i + k, v[i].tolist(), int(i < 20)) for i in range(pairs) for k, v in enumerate((x, y))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    per = embdup.per_table(10**6)
    monkeypatch.setattr(embdup, "per_table", lambda n, cosine=0.93: per if n > 100 else 2)
    found = {r["vec_id"] for r in embdup.near_vectors(df).where("n_links > 0").collect()}
    assert per == 9
    assert sum(2 * i in found for i in range(20, pairs)) >= 0.96 * (pairs - 20)
    assert sum(2 * i in found for i in range(20)) >= 19


def test_no_embeddings(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embdup.near_vectors(none).count() == 0


def test_counts_keep_recall():
    assert embdup.least_count(32) < 32 and embdup.per_table(10) == 2 and embdup.per_table(10**9) > embdup.per_table(10**4)


BENCH = [
    (1, "Alice drives from the old harbour with 12 boxes and pays 30 dollars for each box she sells there"),
    (2, "the quiet river bends around seven grey stones before it meets the northern sea again"),
    (3, "tiny item"),
    (4, None),
    (5, ""),
]


def found(spark, docs):
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: list(r["item_ids"]) for r in decontam.flagged(d, b).collect()}


def test_items_and_their_variants_are_found(spark):
    pad = "some other words that nobody asked for stand here "
    docs = [
        (1, pad + BENCH[0][1] + " " + pad),
        (2, pad + BENCH[0][1].replace("12", "57").replace("30", "99")),
        (3, pad + BENCH[1][1].upper() + " " + pad * 50),
        (4, pad * 3),
        (5, "Tiny item"),
        (6, "a tiny item here"),
        (7, None),
        (8, ""),
        (9, "the quiet river bends around eleven green hills before it finds another northern town again"),
        (10, pad + "1 2 3 4 5 6 7 8 9 10 11 12 13"),
        (None, BENCH[0][1]),
    ]
    assert found(spark, docs) == {1: [1], 2: [1], 3: [2], 5: [3]}


def test_slots_must_agree():
    a = decontam.template("pay 5 dollars now")
    assert a[2].tolist() == [0, 1, 2, 0]
    h1 = decontam.window_hashes(*decontam.template("He gave 5 coins to John and 5 coins to him"), 5)
    h2 = decontam.window_hashes(*decontam.template("He gave 8 coins to Mary and 8 coins to him"), 5)
    assert (h1[1] == h2[1]).all() and not (h1[0] == h2[0]).all()


def test_words_by_definition(monkeypatch):
    text = "\u00c9t\u00e9 in Paris: 3km and \u201cx\u201d\u00a0y_z. \u00c9va saw \u00c9va, 7 kg! STRASSE stra\u00dfe" + " w1 end" * 50
    words = [w for w in "\u00e9t\u00e9 in paris 3km and x y z \u00e9va saw \u00e9va 7 kg strasse stra\u00dfe".split() + ["w1", "end"] * 50]
    for piece in (decontam.PIECE, 40):
        monkeypatch.setattr(decontam, "PIECE", piece)
        value, _, kind = decontam.template(text)
        assert value.tolist() == [decontam.word_hash(w) for w in words]
        assert kind[:15].tolist() == [0, 0, 3, 1, 0, 0, 0, 0, 0, 0, 3, 1, 2, 0, 0]
        decontam.powers.cache_clear()
    monkeypatch.undo()
    decontam.powers.cache_clear()


def test_inconsistent_slots_are_let_go(spark):
    item = "when x then 5 follows and when y then 5 follows and when z then 5 follows so in all cases 5 follows"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    good, bad = item.replace("5", "8"), item
    for v in ("3", "4", "6", "7"):
        bad = bad.replace("5", v, 1)
    d = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.flagged(d, b).collect()] == [1]


def test_each_occurrence_is_judged(spark):
    item = "A farmer sells 12 baskets of ripe plums for 30 coins and keeps 7 of the baskets for the long winter"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    pad = " other words stand between the versions here "
    version = lambda x, y, z: item.replace("12", x).replace("30", y).replace("7 ", z + " ")
    versions = [version("41", "52", "63"), version("84", "95", "16"), version("27", "38", "49")]
    docs = [(1, item + pad + versions[0]), (2, pad.join(versions)), (3, versions[0] + " " + item), (4, " ".join(versions)), (5, pad * 40 + item + pad * 40 + pad.join(versions)), (6, pad)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.flagged(d, b).collect()) == [1, 2, 3, 4, 5]


def test_items_that_repeat_a_template(spark):
    tom = "Tom bought 3 red apples at the shop. Tom bought 5 red apples at the shop. Tom bought 8 red apples at the shop."
    long = " ".join(f"word{chr(97 + k)}{chr(98 + k)}" for k in range(24)) + " pay 5 now or 5 then"
    b = spark.createDataFrame([(1, tom), (2, long)], "item_id long, text string")
    other = tom.replace("3", "14").replace("5", "26").replace("8", "37")
    docs = [(1, tom), (2, "before it " + tom + " after it " + other), (3, other), (4, long.replace("pay 5", "pay 6")), (5, "Tom bought 3 red apples at the shop")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: list(r["item_ids"]) for r in decontam.flagged(d, b).collect()} == {1: [1], 2: [1], 3: [1], 4: [2]}


def test_renamed_questions_are_found(spark):
    """Names begin sentences, stand inside them, or do both."""
    items = [
        "Sarah has 12 apples. Tom gives Sarah 3 apples. How many apples does Sarah have",
        "Nora walks to the market every morning. Nora carries 4 heavy bags home. Later Nora gives 2 bags to Peter. How many bags are left",
    ]
    b = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    new = [t.replace("Sarah", "Maria").replace("Tom", "John").replace("Nora", "Emil").replace("Peter", "Clara") for t in items]
    pad = "Some words stand before it. "
    docs = [(1, pad + new[0] + " and so on"), (2, pad + new[1].replace("4", "9")), (3, items[0]), (4, pad * 9), (5, "Emil walks to the station. Clara has 5 pears. How many pears does Otto eat")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: list(r["item_ids"]) for r in decontam.flagged(d, b).collect()} == {1: [1], 2: [2], 3: [1]}


def test_empty_tables(spark, nothing):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.flagged(nothing, b).count() == 0
    assert decontam.flagged(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), b).count() == 0


def test_filter_keeps_every_item_window():
    h = np.random.default_rng(7).integers(0, 2**63, 1000).astype("u8")
    bits = np.zeros((1 << decontam.FILTER_BITS) // 8, "u1")
    for x in h.tolist():
        for b in (x & (1 << decontam.FILTER_BITS) - 1, x >> decontam.FILTER_BITS & (1 << decontam.FILTER_BITS) - 1):
            bits[b >> 3] |= 1 << (b & 7)
    assert decontam.passes(bits, h).all()
