"""Packing, sharding, tool calls, URL filter, WARC and the pipeline."""

import base64
import gzip
import hashlib
import io
import json
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import packing, sharding, toolcalls, urlfilter, warc
from quern.llm.queries import tokenizer_path

TABLES = "/root/testdata/sf0.001"


def test_encoder_equals_the_tokenizer():
    enc = packing.Encoder(tokenizer_path())
    assert enc.narrow is not None
    for s in ["a <|endoftext|> b", "don't I'LL we've 123abc", "\x00\x1f x", "a b\xa0c\n\n d", "\xe9\t\tb　　c  ", " ", "\n", "\U0001f642\U0001f642 x٣ १", "", "  two  spaces", "caf\xe9\xb2 \xbd!"]:
        assert enc.ids(s) == enc.whole(s)


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)] and packing.cuts(2049) == [(0, 1), (1, 2048)]
    assert packing.cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_sum_of_squares_by_definition():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 31, 300)
    bins, offs, gaps = packing.sum_of_squares(lengths, 30)
    fill = defaultdict(int)
    for i, s in enumerate(lengths.tolist()):
        def cost(b):
            after = dict(fill)
            after[b] = after.get(b, 0) + s
            return sum(n * n for n in Counter(30 - f for f in after.values() if f < 30).values())
        options = [b for b in fill if fill[b] + s <= 30] + [len(fill)]
        assert cost(int(bins[i])) == min(cost(b) for b in options)
        assert offs[i] == fill[int(bins[i])]
        fill[int(bins[i])] += s
    assert [30 - fill[b] for b in range(len(gaps))] == gaps.tolist()


@pytest.mark.parametrize("group", [20_000, 40])
def test_packing_is_gapless_and_whole(spark, corpus, group):
    rows = packing.pieces(corpus, tokenizer_path(), size=128).cache()
    got = packing.pack(rows, 128, group).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in got) == Counter((r["doc_id"], r["piece"]) for r in rows.collect())
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 128
    total = sum(r["length"] for r in got)
    assert len(seqs) <= 1.05 * -(-total // 128) + 1
    enc = packing.Encoder(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for r in got:
        ids = np.frombuffer(enc.whole(texts[r["doc_id"]] or "") + b"\0\0\0\0", "<u4")[r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_groups_stay_bounded_when_nothing_fits_together(spark):
    lengths = [70 + i % 50 for i in range(400)]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows, 128, 40).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400)) and len({r["sequence_id"] for r in got}) == 400
    assert max(Counter(r["sequence_id"] >> 24 for r in got).values()) <= 80


def test_packing_nothing(spark, nothing):
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


def test_shards_are_even_and_stable():
    a = sharding.fill(sharding.SHARDS)
    n = Counter(a)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == len(sharding.SHARDS)
    b = sharding.fill(sharding.SHARDS[:-1])
    kept = sum(x == y for x, y in zip(a, b) if x != len(sharding.SHARDS) - 1)
    assert kept >= 0.9 * sum(x != len(sharding.SHARDS) - 1 for x in a)
    w = Counter(sharding.fill(["a", "b"], 101, [3, 1]))
    assert abs(w[0] - 3 * w[1]) <= 4
    with pytest.raises(ValueError):
        sharding.fill(["a", "a"])
    with pytest.raises(ValueError):
        sharding.fill(["a"], 100)


def test_fill_by_turns():
    shards, slots = ["a", "b", "c"], 13
    prefs = [[(sharding.digest(f"start {s}") + k * (sharding.digest(f"stride {s}") % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    owner = {}
    while len(owner) < slots:
        for i, p in enumerate(prefs):
            if len(owner) < slots:
                owner[next(x for x in p if x not in owner)] = i
    assert sharding.fill(shards, slots) == [owner[s] for s in range(slots)]


def test_placement(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, "x")], "doc_id long, slot string")
    rows = sharding.place(df, ["doc_id"]).collect()
    owner = sharding.fill(sharding.SHARDS)
    assert len(rows) == 4 and {r["doc_id"] for r in rows} == {1, 2, None}
    for r in rows:
        slot = sharding.digest("\0" if r["doc_id"] is None else str(r["doc_id"])) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[owner[slot]])
    assert sharding.place(df.limit(0), ["doc_id", "slot"]).count() == 0


def message(conv, turn, role, body):
    return (conv, turn, role, body if body is None or isinstance(body, str) else json.dumps(body))


SCHEMAS = {"add": {"a": {"type": "integer", "required": True}, "b": {"type": "number", "minimum": 0}, "mode": {"type": "string", "enum": ["x", "y"]}}}


def linked(spark, rows):
    return toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()


def test_calls_are_linked_ordered_and_checked(spark):
    call = lambda i, after=(), name="add", **args: {"id": i, "name": name, "arguments": args, "after": list(after)}
    rows = [
        message(1, 0, "user", "plain words"),
        message(1, 1, "assistant", {"tool_calls": [call("q", ["p"], b=1.5, a=2, mode="x"), call("p", a=1)]}),
        message(1, 2, "tool", {"tool_call_id": "p", "content": 'say "hi"'}),
        message(1, 3, "tool", {"tool_call_id": "lost", "content": "x"}),
        message(1, 3, "assistant", {"tool_calls": [call("r", ["none"], a="no", b=-1, mode="z", more=1)]}),
        message(2, 5, "assistant", {"tool_calls": [call("q", name="other")]}),
        message(2, 4, "tool", {"tool_call_id": "q", "content": "early"}),
        message(2, 6, "assistant", {"tool_calls": [call("q", a=1)]}),
        message(3, 1, "assistant", {"tool_calls": [call("a", ["b"], a=1), call("b", ["a"], a=1), call("c", a=1)]}),
        message(4, None, "assistant", "{not json"),
        message(None, 1, "assistant", {"tool_calls": [call("n", a=1)]}),
        message(5, 1, "user", None),
    ]
    got = {(r["conv_id"], r["call_id"]): r for r in linked(spark, rows)}
    assert set(got) == {(1, "q"), (1, "p"), (1, "lost"), (1, "r"), (2, "q"), (3, "a"), (3, "b"), (3, "c"), (None, "n")}
    assert got[1, "p"]["step"] < got[1, "q"]["step"] < got[1, "r"]["step"]
    assert got[1, "p"]["status"] == "linked" and got[1, "q"]["status"] == "unanswered" and got[1, "lost"]["status"] == "orphan" and got[2, "q"]["status"] == "early"
    assert got[1, "p"]["canonical"] == '{"arguments":{"a":1},"id":"p","name":"add","result":"say \\"hi\\""}'
    assert got[1, "q"]["canonical"] == '{"arguments":{"a":2,"b":1.5,"mode":"x"},"id":"q","name":"add"}' and got[1, "q"]["valid"]
    assert got[1, "r"]["problems"] == "a is no integer; b too small; mode not allowed; unknown argument; waits for an unknown call"
    assert got[2, "q"]["problems"] == "unknown tool" and got[2, "q"]["copies"] == 2
    assert "circular" in got[3, "a"]["problems"] and "circular" in got[3, "b"]["problems"] and got[3, "c"]["valid"]


def test_a_reversed_chain_is_put_in_order(spark):
    n = 12
    rows = [message(1, i, "assistant", {"tool_calls": [{"id": f"c{i:02d}", "name": "add", "arguments": {"a": i}, "after": [f"c{i + 1:02d}"] if i + 1 < n else []}]}) for i in range(n)]
    got = sorted(linked(spark, rows), key=lambda r: r["step"])
    assert [r["call_id"] for r in got] == [f"c{i:02d}" for i in reversed(range(n))] and all(r["valid"] for r in got)


def test_circles_at_different_turns(spark):
    """Every member of a circle is marked, whatever the turns beside it; calls before it are not, calls behind it are."""
    call = lambda conv, turn, i, after: message(conv, turn, "assistant", {"tool_calls": [{"id": i, "name": "add", "arguments": {"a": 1}, "after": after}]})
    rows = [call(1, 0, "a", ["b"]), call(1, 1, "b", ["a", "d"]), call(1, 10, "c", []), call(1, 2, "d", []), call(1, 1_000_000, "e", ["c"]), call(1, 3, "f", ["b"])]
    rows += [call(2, 5, "a", ["a"]), call(2, 7, "b", []), call(3, 9, "a", ["b"]), call(3, 9, "b", []), call(None, 0, "a", ["b"]), call(None, 1, "b", ["a"])]
    got = {(r["conv_id"], r["call_id"]): r for r in linked(spark, rows) if r["conv_id"] is not None}
    assert {k for k, r in got.items() if "circular" in r["problems"]} == {(1, "a"), (1, "b"), (1, "f"), (2, "a")}
    assert got[3, "b"]["step"] < got[3, "a"]["step"] and got[1, "c"]["step"] < got[1, "e"]["step"]


def test_no_messages(spark):
    assert linked(spark, []) == []


URLS = ["HTTP://A.B.Net/x?y#z", "http://example.net/en/1", "http://x.example.net/en", "http://notnet/", "ftp://m.example.com/de/#", "http://example.org/fr/a", "http://org", None, "no scheme/net/", "http://", "http://EXAMPLE.com?q=://net/", "http://u.net", "http://Ä.org/fr/é" + "x" * 3000]


def brute_url(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_rules_by_definition(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string")
    got = urlfilter.judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, best = brute_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0


def brute_scores(urls, order):
    """Interpolated models of (string, accepted, rejected) by dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    text = lambda s: urlfilter.START * order + s + urlfilter.END
    for s, a, r in urls:
        t = text(s)
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[t[i - k : i + 1]][0] += a
                counts[t[i - k : i + 1]][1] += r
    followers = defaultdict(lambda: [0, 0, 0, 0])
    for g, (a, r) in counts.items():
        f = followers[len(g), g[:-1]]
        f[0] += a
        f[1] += r
        f[2] += a > 0
        f[3] += r > 0

    def prob(g, side):
        k = len(g) - 1
        q = 1 / 256 if k == 0 else prob(g[1:], side)
        f = followers[len(g), g[:-1]]
        n, t = f[side], f[2 + side]
        p = (counts[g][side] + t * q) / (n + t) if n + t else q
        return max(p, 1e-6) if k == 0 else p

    out = {}
    for s, _, _ in urls:
        t = text(s)
        gs = [t[i - order : i + 1] for i in range(order, len(t))]
        out[s] = sum(np.log(prob(g, 0) / prob(g, 1)) for g in gs) / len(gs)
    return out


def test_scores_by_dictionaries(spark):
    rng = np.random.default_rng(9)
    urls = [("".join(rng.choice(list("abcd"), rng.integers(1, 12))), int(rng.integers(0, 3)), int(rng.integers(0, 2))) for _ in range(60)]
    urls = list({u[0]: u for u in urls}.values()) + [("e" * 1300, 1, 0), ("", 0, 1)]
    df = spark.createDataFrame([(s, "", a, r) for s, a, r in urls], "host string, path string, a long, r long")
    got = {r["host"]: r["score"] for r in urlfilter.scores(df, 3).collect()}
    want = brute_scores(urls, 3)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_threshold():
    assert urlfilter.threshold([]) == 0 and urlfilter.threshold([(5, 3, 0)]) == 0
    t = urlfilter.threshold([(-500, 0, 4), (-100, 1, 5), (300, 6, 0)])
    assert -0.1 < t <= 0.3


PAGES = [(1, "http://a/\r\nX: y", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 150_000), (6, "u", "é" * 150_000), (7, "u", "WARC/1.1\r\n\r\n"), (2, "v", "same"), (None, "w", "same"), (8, "u", "x" * warc.CHUNK)]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_come_back_whole(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    rows = warc.read(warc.write(df, warc.place(spark, "test-warc"), "page_id", "url", "html", least)).collect()
    records = [r for r in rows if r["last"]]
    assert len(records) == len(PAGES)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    top = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            top[b] = max(top.get(b, -1), i)
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = top.get(b) if i is not None else None
        want[i, len(b), sha(b), "revisit" if first is not None and first != i else "response", first if first != i else None] += 1
    assert Counter((r["record"], r["bytes"], r["digest"], r["type"], r["refers_to"]) for r in records) == want
    whole = defaultdict(bytes)
    for r in sorted((r for r in rows if r["record"] in (6, 7, 8)), key=lambda r: r["chunk_no"]):
        assert len(r["data"]) <= warc.CHUNK
        whole[r["record"]] += r["data"]
    assert whole[6] == ("é" * 150_000).encode() and whole[7] == b"WARC/1.1\r\n\r\n" and whole[8] == b"x" * warc.CHUNK


def test_archives_are_plain_gzip_members(spark):
    df = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").coalesce(1)
    m = warc.write(df, warc.place(spark, "test-warc"), "page_id", "url", "html").first()
    with gzip.open(m["path"].removeprefix("file:"), "rb") as f:
        text = f.read()
    assert text.count(b"WARC/1.1\r\n") == 2 == m["records"] and text.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"no record\r\n")))


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_stage(name, spark, before, rows):
    """Identifiers that a stage keeps, computed over a plain list of rows; models are trained by the same functions."""
    import corpus_pipeline as P
    from quern.llm import decontam, langid, toxicity

    texts = [r["text"] for r in rows]
    if name == "language ID":
        model = langid.train(langid.sample(before.where(~langid.held_out()), "text", "lang"))
        n = len(model["names"])
        best = [langid.probabilities(model, [(t or "").encode()]).max() for t in texts]
        letters = [any(c.isalpha() for c in t or "") for t in texts]
        return [r["doc_id"] for r, q, a in zip(rows, best, letters) if a and q >= 1 / n + P.ABOVE_CHANCE * (1 - 1 / n)]
    if name == "toxicity":
        labels = spark.read.parquet(f"{TABLES}/labels.parquet")
        scorer = toxicity.Scorer(toxicity.train(toxicity.sample(before, labels, "text", "doc_id", "toxic")))
        return [r["doc_id"] for r in rows if scorer.scores([r["text"]])[0] < 0.5]
    if name == "near dedup":
        sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for t in texts]
        group = list(range(len(rows)))
        for _ in rows:
            new = [min(group[j] for j in range(len(rows)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in range(len(rows))]
            if new == group:
                break
            group = new
        first = {}
        for r, g in zip(rows, group):
            here = (r["doc_id"] is None, r["doc_id"] or 0)
            first[g] = min(first.get(g, here), here)
        return [None if missing else i for missing, i in first.values()]
    windows = lambda t: {tuple(w[i : i + 5]) for w in [("".join(c if c.isalnum() else " " for c in t or "")).lower().split()] for i in range(len(w) - 4)}
    items = [w for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect() if (w := windows(r["text"]))]
    assert decontam.SPAN == 5
    return [r["doc_id"] for r in rows if not any(len(w & windows(r["text"])) >= 0.8 * len(w) for w in items)]


def test_pipeline(spark):
    """Each stage against a brute-force version over its own input, the last one by its tokens."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{TABLES}/documents.parquet").withColumn("__extra", F.lit(1)).withColumn("score", F.lit("mine"))
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    docs = P.saved(docs, "test")
    assert [n for n, _ in P.STAGES] == ["language ID", "toxicity", "near dedup", "decontamination", "packing"]
    columns = docs.columns
    order = lambda ids: sorted(ids, key=lambda x: (x is None, x or 0))
    for name, stage in P.STAGES:
        before, rows = docs, docs.collect()
        docs = P.saved(stage(spark, docs, TABLES), "test")
        if name != "packing":
            got = docs.collect()
            assert docs.columns == columns and {r["score"] for r in got} == {"mine"}
            assert order(r["doc_id"] for r in got) == order(brute_stage(name, spark, before, rows))
    enc = packing.Encoder(tokenizer_path())
    want = Counter()
    for r in rows:
        ids = enc.whole(r["text"] or "") + b"\0\0\0\0"
        for k, (at, n) in enumerate(packing.cuts(len(ids) // 4)):
            want[r["doc_id"], k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])] += 1
    got = docs.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    ends = Counter()
    for r in got:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= packing.SIZE and all(r["offset"] + r["length"] <= ends[r["sequence_id"]] for r in got)


def test_stages_tell_rows_apart_by_themselves(spark):
    """Rows without identifier and different texts under one identifier are judged one by one."""
    import corpus_pipeline as P

    item = next(r["text"] for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").orderBy("item_id").collect())
    rows = [(1, prose(1)), (1, prose(2)), (1, prose(1)), (2, prose(2)), (3, prose(3)), (None, prose(3)), (None, f"{prose(4)} {item} {prose(5)}"), (7, f"{prose(6)} {item}"), (7, prose(7)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in P.near_copies(spark, docs, TABLES).collect()]
    assert Counter(kept) == Counter([rows[0], rows[1], rows[4], *rows[5:]])
    clean = [(r["doc_id"], r["text"]) for r in P.clean(spark, docs, TABLES).collect()]
    assert Counter(clean) == Counter(r for r in rows if item not in (r[1] or ""))


def prose(seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40))


def test_stages_take_empty_tables(spark, nothing):
    import corpus_pipeline as P

    for _, stage in P.STAGES:
        assert stage(spark, nothing, TABLES).count() == 0


def test_registered_queries():
    import __spark_entry__ as E

    names = [q for q in E.queries() if q.startswith("op") or q == "pipeline"]
    assert len(names) == 14 and os.path.basename(E.queries()["pipeline"].__code__.co_filename) == "corpus_pipeline.py"


def test_no_table_of_urls_or_ngrams_is_broadcast(spark, monkeypatch):
    """File sizes say little about these tables: joins of what grows with the corpus ask for a shuffle."""
    plans = []
    plain = urlfilter.saved
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(urlfilter, "saved", lambda df, name: plans.append(plan(df)) or plain(df, name))
    pages = [(i, f"https://a{i % 7}.example.{'net/en' if i % 2 else 'com/de'}/{i}") for i in range(60)] + [(99, "https://b.example.com/es/7")]
    out = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"))
    assert len(plans) == 9 and not any("BroadcastHashJoin" in p for p in [*plans, plan(out)])
    assert out.where("score IS NULL OR verdict IS NULL").count() == 0 and out.count() == 61
