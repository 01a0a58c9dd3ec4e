"""Near copies at five words and similarity 0.8 against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import similar


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes_of(texts):
    """Component of every text by all pairs, and the linked pairs of different texts."""
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))], [(i, j) for i, j in pairs if sets[i] != sets[j]]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[int(rng.integers(len(out)))] = f"e{rng.integers(10**9)}"
    return " ".join(out)


def corpus(seed=7):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(50):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 300)))]
        texts += [" ".join(words)] + [edited(rng, words, int(rng.integers(1, max(2, len(words) // 25)))) for _ in range(5)]
    return texts + texts[:9] + [None, "", " \n", "One two", "one  TWO", "one two three", "x " * 20000]


def test_pairs_at_the_bound_are_found(spark):
    texts = corpus()
    got = {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit("mine")).withColumn("rep", F.lit(1))
    near = similar.near_copies(df).collect()
    key = {r["key"]: r["component"] for r in near}
    assert len(near) == len(key) == len(texts)
    for r in df.select("doc_id", similar.row_key().alias("k")).collect():
        got[r["doc_id"]] = key[r["k"]]
    want, pairs = classes_of(texts)
    assert len(pairs) > 200
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    for i in range(len(texts)):
        for j in range(i):
            assert got[i] != got[j] or want[i] == want[j]
            if shingles(texts[i]) == shingles(texts[j]):
                assert got[i] == got[j]


def test_a_dense_group_is_one_component(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = [edited(rng, words, 2) for _ in range(300)]
    near = similar.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(near) == 300 and len({r["component"] for r in near}) == 1


def test_rows_without_or_with_shared_identifiers(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b), (2, None), (None, None)]
    near = similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(near) == 6 and sorted(map(len, by_component(near).values())) == [2, 2, 2]
    assert similar.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r["component"], []).append(r["key"])
    return out


@pytest.mark.parametrize("n", [300, 10**6, 10**8])
def test_plan_reaches_its_recall(n):
    width, count = similar.shape(n)
    products = np.full((count, 64, 64), n / 4) + np.eye(64) * n / 4
    parts = similar.plan(n, products, width)
    p, miss = similar.differing(), 1.0
    for _, bits, radius in parts:
        assert len(bits) == width
        miss *= 1 - similar.at_most(width, 2 * radius, p)
    assert miss <= 1 - similar.RECALL and len({(k, tuple(b)) for k, b, _ in parts}) == len(parts)
    assert all(k < count - 1 for k, _, _ in parts)


def test_words_by_definition():
    h = similar.shingles("One two three four five six seven eight nine")
    want = [xxhash.xxh64_intdigest(" ".join(w).encode(), 42) for w in zip(*["one two three four five six seven eight nine".split()[i:] for i in range(5)])]
    assert sorted(want) == h.tolist()
    m = 2**64 - 1
    for count in (1, 3):
        mixed = []
        for x in want:
            x = (x + count * 0x9E3779B97F4A7C15) & m
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
            x = (x ^ x >> 27) * 0x94D049BB133111EB & m
            mixed.append(x ^ x >> 31)
        got = similar.words_of(h, count)[-1:].view("u1")
        assert np.unpackbits(got).tolist() == [2 * sum(y >> (8 * (b // 8) + 7 - b % 8) & 1 for y in mixed) > len(mixed) for b in range(64)]


def test_rare_shingles_miss_no_similar_pair_and_skip_shared_passages(spark):
    """By all pairs; texts that share 80 words of 100 with all others and nothing else never meet."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, base = word(80), word(100)
    apart = [" ".join(word(10) + passage + word(10)) for _ in range(200)]
    near = [edited(rng, base, int(rng.integers(1, 5))) for _ in range(60)] + [" ".join(base[:k]) for k in range(70, 100, 3)] + ["a b", "a b c"]
    sets = [shingles(t) for t in apart + near]
    hashes = [similar.shingles(t) for t in apart + near]
    rows = [(i, i, bytearray(h.tobytes())) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "rep long, g long, h binary")
    got = {(r["a"], r["b"]) for r in similar.by_rare_shingles(df, 0.8).collect()}
    want = {(j, i) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 100 and want <= got
    assert not [p for p in got if p[0] < 200]
    one = df.withColumn("g", F.lit(0).cast("long"))
    assert similar.by_rare_shingles(one, 0.8).count() == 0
    assert similar.by_rare_shingles(df.where("rep < 0"), 0.8).count() == 0


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    texts = corpus(9)[:200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = []
    for crowd in (10**9, 2):
        monkeypatch.setattr(similar, "CROWD", crowd)
        near = {r["key"]: r["component"] for r in similar.near_copies(df).collect()}
        groups.append(near)
    plain, crowded = groups
    assert plain.keys() == crowded.keys()
    assert all(len({crowded[k] for k in plain if plain[k] == c}) == 1 for c in set(plain.values()))
    want, _ = classes_of(texts)
    key = {r["doc_id"]: r["k"] for r in df.select("doc_id", similar.row_key().alias("k")).collect()}
    for c in set(crowded.values()):
        assert len({want[i] for i in key if crowded[key[i]] == c}) == 1


def test_stragglers_of_a_large_group_meet_its_centre(spark):
    """Copies with one edit are one group already; those with three edits resemble the original only."""
    rng = np.random.default_rng(21)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    places = [list(5 + 7 * rng.permutation(20)[:n]) for n in [1] * 120 + [3] * 60]
    hashes = [similar.shingles(" ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(base))) for i, at in enumerate([[], *places])]
    rows = [(i, 0 if i <= 120 else i, bytearray(h.tobytes())) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "rep long, g long, h binary")
    tokens, rare = similar.rare_shingles(df, 0.8)
    assert similar.by_rare_shingles(df, 0.8, rare).count() > 5000
    pairs = [(r["a"], r["b"]) for r in similar.to_centres(tokens, rare).collect()]
    assert {(0, i) for i in range(121, 181)} <= set(pairs) and len(pairs) <= 180
    links = spark.createDataFrame([(i, 0) for i in range(181)], "vertex long, component long")
    assert similar.by_rare_shingles(df, 0.8, similar.grouped(rare, links)).count() == 0


def test_places_of_rare_shingles_are_those_among_all(spark):
    """However few shingles every task knows, a set gives the same ones with the same places, and not what all hold."""
    rng = np.random.default_rng(8)
    stem = rng.integers(-(2**60), 2**60, 90)
    sets = [np.unique(np.concatenate([rng.permutation(stem)[: 60 + i % 30], rng.integers(0, 40, i % 7), rng.integers(2**61, 2**62, i % 25)])).astype("i8") for i in range(80)]
    shingled = spark.createDataFrame([(i, i // 3, bytearray(v.astype("i8").view("u8").tobytes())) for i, v in enumerate(sets)], "rep long, g long, h binary")
    df = {}
    for v in sets:
        for t in v.tolist():
            df[t] = df.get(t, 0) + 1
    want = set()
    for i, v in enumerate(sets):
        first = sorted((df[t], t) for t in v.tolist())[: len(v) - -(-8 * len(v) // 10) + 1]
        want |= {(i, t, n, r) for r, (n, t) in enumerate(first, 1) if n > 1}
    for listed in (0, 20, 1000):
        rows = similar.rare_shingles(shingled, 0.8, listed)[1]
        assert {(r["rep"], r["t"], r["df"], r["r"]) for r in rows.collect()} == want and want
    assert {r["t"]: r["df"] for r in similar.occurrences(shingled).collect()} == df
