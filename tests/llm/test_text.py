"""Spelling variants, context-tree scoring and lexical search against brute force on small fixtures."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from quern.llm import ctw, search, variants

AZ = str.maketrans(search.UPPER, search.LOWER)


def held(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# --- spelling variants

def brute_words(rows, every, length, count):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= length and n >= count}


def brute_near(words):
    shapes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shapes[w[:i], w[i + 1 :]].add(w)
    near = {w: set() for w in words}
    for (a, b), same in shapes.items():
        if a + b in near:
            for w in same:
                near[w].add(a + b)
                near[a + b].add(w)
        for w in same:
            near[w] |= same - {w}
    return near


def brute_variants(rows, every, length, count, ratio):
    words = brute_words(rows, every, length, count)
    near = brute_near(words)

    def form(w):
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        return best if best is not None and words[best] >= ratio * words[w] else None

    out = {}
    for w, n in words.items():
        root = w
        while form(root) is not None:
            root = form(root)
        out[w] = (n, len(near[w]), form(w), words.get(form(w)), root)
    return out


def got_variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def misspelt(spark):
    rng = np.random.default_rng(5)
    names = ["banana", "bandana", "caféteria", "têteàtête", "aaaaaaa", "Strasse", "singing"]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = names[int(rng.integers(0, len(names)))]
            k = int(rng.integers(0, len(w)))
            words.append([w, w.upper(), w, w[:k] + "x" + w[k:], w[:k] + w[k + 1 :], w[:k] + "y" + w[k + 1 :], w + w[-1]][int(rng.choice(7, p=[0.5, 0.1, 0.2, 0.05, 0.05, 0.05, 0.05]))])
        rows.append((i, " ".join(words) + " 12x×y", i, "z"))
    rows += [(None, "banana bananna", 1, None), (None, None, 1, None), (70, "", 1, None), (71, "q" * 20_000, 1, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, word string")


def test_variants_equal_all_pairs(spark):
    docs = misspelt(spark)
    for every, length, count, ratio in ((199, 6, 5, 5), (7, 3, 1, 2)):
        want = brute_variants(held(docs), every, length, count, ratio)
        assert got_variants(variants.variants(docs, every=every, length=length, count=count, ratio=ratio)) == want
        assert any(v[2] for v in want.values())


def test_crowded_chunks_are_cut_until_no_group_is_large(spark, monkeypatch):
    """Words that share a long stem: one chunk holds them all; every pair one edit apart is still found."""
    monkeypatch.setattr(variants, "CROWD", 1)
    monkeypatch.setattr(variants, "GROUP", 8)
    rng = np.random.default_rng(6)
    words = {"stemstem" + "".join(rng.choice(list("abcd"), rng.integers(1, 6))) for _ in range(400)} | {"x" + "".join(rng.choice(list("abcd"), 3)) + "tailtail" for _ in range(60)}
    got = variants.near(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    pairs = {(a, b) for a, s in brute_near(words).items() for b in s if (len(a), a) < (len(b), b)}
    assert len(got) == len(pairs) and {(r["x"], r["y"]) for r in got} == pairs


def test_variants_of_nothing(spark, nothing):
    assert variants.variants(nothing).count() == 0
    assert variants.near(spark.createDataFrame([], "word string")).count() == 0


# --- context-tree weighting

def stream(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def brute_ctw(train, texts, order):
    """log10 probability of each text by the recursive definition on dictionaries."""
    seen = {}

    def decisions(u):
        for i in range(order, len(u)):
            for j in range(8):
                yield u[i - order : i][::-1], (j, u[i] >> (8 - j)), (u[i] >> (7 - j)) & 1

    for t in train:
        for context, node, bit in decisions(b"\0" * order + t):
            for d in range(order + 1):
                seen.setdefault((context[:d], node), [0, 0])[bit] += 1
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in seen.items()}
    log, below = {}, defaultdict(float)
    for k in sorted(seen, key=lambda k: -len(k[0])):
        log[k] = kt[k] if len(k[0]) == order else float(np.logaddexp(kt[k], below[k])) - math.log(2)
        if k[0]:
            below[k[0][:-1], k[1]] += log[k]
    out = []
    for t in texts:
        total = 0.0
        for context, node, bit in decisions(b"\0" * order + t):
            p = None
            for d in range(order, -1, -1):
                k = (context[:d], node)
                if k in seen:
                    chance = (seen[k][bit] + 0.5) / (sum(seen[k]) + 1)
                    own = math.exp(kt[k] - math.log(2) - log[k])
                    p = chance if p is None else own * chance + (1 - own) * p
            total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def left_out(i):
    return i is not None and crc32(str(i).encode()) % 7 == 2


def test_scores_equal_the_definition(spark, corpus, monkeypatch):
    monkeypatch.setattr(ctw, "BATCH", 3000)
    monkeypatch.setattr(ctw, "PIECE", 500)
    monkeypatch.setattr(ctw, "BLOCK", 700)
    docs = corpus.where("doc_id IS NULL OR doc_id < 60 OR doc_id BETWEEN 300 AND 303")
    rows = held(docs)
    train = [stream(t) for i, t in rows if not left_out(i)]
    words = Counter(w for t in train for w in [*t.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    log = brute_ctw(train, [stream(t) for _, t in rows], ctw.ORDER)
    want = []
    for (i, t), s in zip(rows, log):
        u = [*stream(t).split(), b"\n"]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in u)
        want.append((-1 if i is None else i, left_out(i), len(u), sum(words[w] > 0 for w in u), n, base, s, len(stream(t))))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["n_bytes"]) for r in ctw.score(docs).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a == pytest.approx(b, rel=1e-9)


def test_probabilities_of_all_bytes_add_up():
    """Whatever the context, seen or not, the 256 probabilities sum to one."""
    gram, count = np.unique(ctw.windows([b"the cat sat on the mat\n", b"\n", b"\xc3\xa9t\xc3\xa9 \x00\n"]), return_counts=True)
    contexts = np.append(np.unique(gram >> 8)[:6], [0, 0x7171717171])
    every = np.unique(np.concatenate([gram, *[(c << 8) | np.arange(256) for c in contexts]]))
    n = np.zeros(len(every))
    n[np.searchsorted(every, gram)] = count
    log = ctw.fold(every, n, ctw.top_levels(*ctw.fold(every, n)))
    for c in contexts:
        assert (10 ** log[every >> 8 == c]).sum() == pytest.approx(1)


def test_score_without_training_text(spark, nothing):
    assert ctw.score(nothing).count() == 0
    i = next(i for i in range(100) if left_out(i))
    r = ctw.score(spark.createDataFrame([(i, "ab c")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert r["score"] == pytest.approx(5 * 8 * math.log10(0.5))


# --- lexical search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute_search(rows, items, k):
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(terms(t))
    out = []
    for item, wanted in queries.items():
        scores = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = ["w%d" % i for i in range(40)] + ["Été", "日本", "\U0001f600x"]
    share = np.array([1 / (i + 1) for i in range(len(vocabulary))])
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    rows = [(i, text(int(rng.integers(1, 30))), i) for i in range(300)]
    rows += [(None, "w3 w5 w30", 0), (None, None, 0), (400, "", 0), (401, "--- !", 0), (402, text(5000), 0), rows[7], rows[7], rows[8], (500, rows[7][1].upper(), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank long")
    items = [(i, text(12)) for i in range(25)] + [(3, "w1 w2"), (None, "W20 w21"), (None, "w22"), (90, None), (91, ""), (92, "unheard"), (93, "w0")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search([r[:2] for r in rows], items, 7)
    get = lambda **how: sorted([tuple(r) for r in search.search(docs, asked, 7, **how).collect()], key=repr)
    assert get() == want
    monkeypatch.setattr(search, "DOCS", 20)
    assert get(block=40) == want  # queries in several blocks, documents in small ones


def test_accumulators_stop_where_bounds_cannot_reach():
    """The frequent term creates no accumulator once the rare one decides the first k, and still counts for the survivor."""
    at = np.array([3, 0, 1, 2, 3, 4], "i4")  # term 0 in document 3, term 1 in all five
    impact = np.array([100, 9, 9, 9, 7, 9])
    found, score = search.accumulate(np.array([0, 1]), np.array([50, 2]), np.array([0, 1, 6]), at, impact, np.array([100, 9]), 5, 1, 1)
    assert found.tolist() == [3] and score.tolist() == [5014]


def test_search_of_nothing(spark, nothing):
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(nothing, some).count() == 0
    assert search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), some.where("false")).count() == 0
