"""Findings of the reviews: each test failed before its finding was settled."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import ordered
from quern.operators import blend, customer, graph, rhythm, spatial


def test_remainder_of_the_period_is_taken_by_whole_cycles(spark):
    """r - floor(r / p) * p in doubles, bit for bit: exact remainders leave another residue where r is nearly n cycles."""
    rows = [(i, "all", r, 3, "mean", p, 14.0, 103.0) for i, (r, p) in enumerate([(505, 33.666666667), (1038, 148.285714286), (832, 138.666666667)])]
    est = spark.createDataFrame(rows, "customer_id long, hist string, r long, n long, est string, period double, lo double, hi double")
    got = {x["customer_id"]: x["tmod"] for x in rhythm.next_time(est).collect()}
    assert got == {i: p - (r - math.floor(r / p) * p) for i, _, r, _, _, p, _, _ in rows}


def test_range_join_never_broadcasts_its_copies(spark, tmp_path):
    """The planner sees the frame before it is copied to cells, so its size says nothing; pairs equal all pairs."""
    pts = [(i, i % 3, (i * 7 % 23) * 0.5 - 4.0, (i * 5 % 19) * 0.5 - 3.0) for i in range(200)]
    spark.createDataFrame(pts, "i long, k long, x double, y double").write.parquet(f"{tmp_path}/pts")
    a = spark.read.parquet(f"{tmp_path}/pts")
    b = a.withColumnRenamed("i", "j")
    got = spatial.within(a, b, ["k"], "x", "y", 2.0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(p[0], q[0]) for p in pts for q in pts if p[1] == q[1] and math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) <= 2.0}
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_mutual_best_takes_each_end_once(spark):
    """Each end chooses one pair, also where a pair is given twice, as the row numbers of the SQL do."""
    rows = [(1, 10, 1.0, "a"), (1, 10, 1.0, "a"), (1, 11, 2.0, "b"), (2, 11, 3.0, "c"), (2, 12, 3.0, "d"), (3, 12, 1.0, "e")]
    pairs = spark.createDataFrame(rows, "source_id long, target_id long, cost double, note string")
    got = graph.mutual_best(pairs, "cost")
    assert got.columns == pairs.columns
    assert sorted(map(tuple, got.collect())) == [(1, 10, 1.0, "a"), (3, 12, 1.0, "e")]


def test_paths_are_ranked_for_the_queries_as_for_all(spark):
    """The given entities against all others: medians, ties and missing points as by hand."""
    import random

    rnd = random.Random(5)
    pts = {e: [(i / 24.0, rnd.choice([0.0, 1.0, 4.0, 9.0]) + e % 3) for i in range(25)] for e in range(12)}
    rows = [(e, i, *p) for e, ps in pts.items() for i, p in enumerate(ps) if (e, i) != (5, 3)]
    paths = spark.createDataFrame(rows, "e long, i int, x double, y double")
    heading = spark.createDataFrame([(e, 1 if e % 2 else -1) for e in pts], "e long, direction int")
    have = {(r[0], r[1]): r[2:] for r in rows}
    want = {}
    for a in (0, 5, 10):
        for b in pts:
            d = sorted(math.dist(have[a, i], have[b, i]) for i in range(25) if (a, i) in have and (b, i) in have)
            if a != b and sum(v <= 3.0 for v in d) >= 13:
                want[a, b] = (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2
    got = spatial.path_rank(paths, heading, "e", "x", "y", 3.0, queries=heading.where("e % 5 = 0")).collect()
    assert {(r["a"], r["b"]): pytest.approx(r["distance"]) for r in got} == want and want


def test_titles_settled_by_few_edits_skip_the_common_bigrams(spark, monkeypatch):
    """All titles share most bigrams: equal to all pairs, and only titles without a candidate near them meet by bigrams."""
    from quern.operators import joins

    left = [(i, f"Supplier {i * 37} {i % 25}") for i in range(30)] + [(90, "x"), (91, "unlike all the others"), (92, None)]
    right = [(j, f"supplier {j}-{j % 7}" + (" LTD" if j % 2 else "")) for j in range(200, 700, 3)] + [(1000, "supplier"), (1001, "a x b")]
    l, r = spark.createDataFrame(left, "lid long, a string"), spark.createDataFrame(right, "rid long, b string")
    j = l.join(r).select("lid", "rid", F.round(joins.title_similarity(joins.title_key("a"), joins.title_key("b")), 9).alias("s"))
    want = {}
    for x in sorted(j.where("s >= 0.75").collect(), key=lambda x: (x["lid"], -x["s"], x["rid"])):
        want.setdefault(x["lid"], (x["rid"], x["s"]))
    judged = []
    whole = joins.title_similarity
    monkeypatch.setattr(joins, "title_similarity", lambda a, b: judged.append(1) or whole(a, b))
    got = {x["lid"]: (x["rid"], x["similarity"]) for x in joins.fuzzy_match(l, r, "lid", "a", "rid", "b", 0.75).collect() if x["rid"] is not None}
    assert got == want and len(want) > 20
    assert len(judged) == 6  # equal, contained on either side, one edit, two edits, bigrams


def test_pairs_that_share_few_rare_terms_are_not_compared(spark):
    """Texts that share one rare word each are no likely pairs; a pair at the threshold is."""
    from quern.operators import textops

    docs = [(i, " ".join([f"own{i}x{k}" for k in range(20)] + [f"shared{min(i, j)}and{max(i, j)}" for j in range(12) if j != i])) for i in range(12)]
    docs += [(20, " ".join(f"near{k}" for k in range(30))), (21, " ".join(f"near{k}" for k in range(8, 38)))]
    w = textops.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", "text", (1,), 1, 1.0)
    assert [tuple(r) for r in textops.likely_pairs(w, "id", 0.5).collect()] == [(20, 21)]
    assert [(r["a"], r["b"]) for r in textops.similar_pairs(w, "id", 0.5).collect()] == [(20, 21)]


def test_far_queries_look_only_at_the_edge_of_a_crowded_place(spark, monkeypatch):
    """Queries beside a grid of 4900 points meet few cells on every level; neighbours equal all pairs."""
    plain = spatial.stored
    fronts = []
    monkeypatch.setattr(spatial, "stored", lambda df: fronts.append(plain(df)) or fronts[-1])
    ref = spark.range(4900).selectExpr("id AS rid", "id % 50 AS re", "(id % 70) * 1.0D AS bx0", "CAST(id DIV 70 AS DOUBLE) AS by0").selectExpr("rid", "re", "bx0 AS x", "by0 AS y")
    query = spark.range(40).selectExpr("id", "id AS e", "-60.3D - id % 3 AS x", "id * 1.7D + 0.1D AS y")
    got = sorted((r["id"], r["rank"], r["rid"], r["distance"]) for r in spatial.knn(query, ref, [], "x", "y", 5, "id", "rid", other=("e", "re")).collect())
    want = []
    for i in range(40):
        qx, qy = -60.3 - i % 3, i * 1.7 + 0.1
        near = sorted((math.sqrt((qx - j % 70) ** 2 + (qy - j // 70) ** 2), j) for j in range(4900) if j % 50 != i)[:5]
        want += [(i, k + 1, j, d) for k, (d, j) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))
    met = [f.count() for f in fronts if "_near" in f.columns]
    assert met and max(met) <= 40 * 64


def test_model_jobs_compute_their_rows_once(spark, tmp_path):
    """Fits, folds, scores and group sizes read a written copy: what comes before is computed once."""
    import os

    from quern.operators import metrics, models

    def counted(name):
        mark = f"{tmp_path}/{name}"
        os.mkdir(mark)

        def run(batches):
            open(f"{mark}/{os.urandom(8).hex()}", "w").close()
            yield from batches

        rows = spark.range(0, 120, 1, 1).selectExpr("id", "id % 7 * 1.0D AS a", "id % 5 * 1.0D AS b", "CAST(id % 7 + id % 3 > 4 AS int) AS y", "CAST(id % 2 AS int) AS fold")
        return rows.mapInPandas(run, rows.schema), lambda: len(os.listdir(mark))

    df, times = counted("grid")
    assert models.param_grid(df, ["a", "b"], "y", "fold", 2, [{"regParam": 0.1}]).count() == 1 and times() == 1
    df, times = counted("auc")
    assert metrics.auc(df, ["fold"], "y", "a").count() == 2 and times() == 1
    df, times = counted("null")
    assert models.null_importance(df, ["a", "b"], "y", "id", rounds=1).count() == 2 and times() == 1


def test_calendar_features_count_months_without_copies_of_the_rows(spark):
    """One distinct count a column would copy every order; months are reduced first."""
    from quern.operators import customer

    days = ["2000-12-05", "2000-12-25", "2001-01-06", "1999-02-28", None]
    rows = [(1, i, i, d) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "customer_id long, d int, order_id long, day string").selectExpr("customer_id", "d", "order_id", "CAST(day AS date) AS order_date", "DATE '2001-02-01' AS scoring_date")
    out = customer.calendar_features(df)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.first().asDict()
    assert (got["last_dom"], got["last_weekday"], got["last_month"]) == (5, 1, 12)
    assert (got["share_dom_le10"], got["share_dom_ge21"], got["weekend_share"]) == (0.5, 0.5, 0.5)
    assert (got["active_months"], got["active_months_year"], got["n_window_ya2"]) == (3, 2, 1)


def test_ranks_of_large_groups_need_no_window_over_their_rows(spark):
    """A slice of more rows than one task should sort several times is ranked from the counts of its values."""
    df = spark.range(600_000).select("id", (F.col("id") % 2).alias("s"), (F.col("id") % 1000 / 8.0).alias("v"))
    got = blend.rank_pct(df, ["s"], {"v": 1.0})
    assert "rank(" not in got._jdf.queryExecution().executedPlan().toString()
    # 600 rows of each value, the even values in one slice and the odd ones in the other
    wrong = got.withColumn("want", (F.floor(F.col("id") % 1000 / 2) * 600 + 300.5) / 300_000).where("abs(want - blend) > 1e-12 OR blend IS NULL")
    assert got.count() == 600_000 and wrong.count() == 0


def test_rows_of_repeating_values_are_numbered_without_chunks(spark):
    """Values that repeat are numbered value by value, nulls first; only counts of values go along the order."""
    rows = [(i, None if i % 50 == 7 else float(i * 7 % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = blend._position(df, [], "v", "id", "p", 100)
    assert "_coarse" not in got._jdf.queryExecution().toString()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert {r["id"]: r["p"] for r in got.collect()} == {r[0]: p for p, r in enumerate(order)}


def test_only_rows_that_may_move_are_numbered(spark):
    """Rows between the ends of the anchor's ranking come last, so they take no part in the second numbering."""
    rows = [(i, (i * 37 % 101) / 101.0, None if i % 90 == 5 else (i * 53 % 97) / 97.0) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    plain = blend.selective(df, "a", "b", "id", 0.05, extreme_only=True)
    large = blend.selective(df, "a", "b", "id", 0.05, extreme_only=True, limit=60)
    assert sorted(map(str, large.collect())) == sorted(map(str, plain.collect()))
    assert "_rn" in (text := large._jdf.queryExecution().optimizedPlan().toString()) and "Union" in text


def test_distinct_counts_send_each_line_once(spark):
    """One shuffle of the lines and no copy of them per column; customers above the limit are spread, with the same counts."""
    lines = spark.sql("SELECT id % 5 customer_id, id % 7 product_id, if(id % 3 = 0, NULL, 'b' || id % 4) brand, 'c' category, NULL gender, id % 40 d, date_add(DATE '2000-01-20', CAST(id % 40 AS INT)) order_date FROM range(300)")
    cols = ("product_id", "brand", "category", "gender")
    got = customer.distinct_counts(lines, cols)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    want = [(c, 7, 4, 1, 0, 2, 2) for c in range(5)]
    for rows in (got, customer.distinct_counts(lines, cols, limit=20)):
        assert [tuple(r)[:5] for r in rows.orderBy("customer_id").collect()] == [w[:5] for w in want]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, customer.distinct_counts(lines, cols, limit=20).collect()))


def test_repeats_read_the_lines_once(spark, tmp_path):
    """Lines without a level set the newest day only; customers with nothing else have no row."""
    rows = [(1, "a", 3), (1, "a", 3), (1, "a", 9), (1, "b", 3), (1, "c", 5), (2, None, 1), (2, "a", 4), (2, "a", 6), (3, None, 2)]
    spark.createDataFrame(rows, "customer_id long, brand string, d int").write.parquet(f"{tmp_path}/lines")
    got = rhythm.repeats(spark.read.parquet(f"{tmp_path}/lines"), "brand")
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 1 / 3, 2, 0.5), (2, 1.0, 2, None)]


def reached(edges, starts):
    """(start, node) of all nodes reached, by walking."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for key, node in starts:
        todo = [node]
        while todo:
            at = todo.pop()
            if (key, at) not in out:
                out.add((key, at))
                todo += after.get(at, ())
    return out


def test_lineages_are_followed_in_few_rounds(spark, monkeypatch):
    """a lineage of 200 steps takes rounds by its logarithm; edges with two sources or in a circle give the same nodes."""
    from quern.operators import graph as G

    rounds = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    chain = [(i, i + 1) for i in range(200)] + [(50, 1000), (1000, 1001), (150, 2000)]
    merged = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (9, 5)]
    circle = [(1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (8, 9)]
    for edges, starts in ((chain, [(0, 0), (1, 51), (2, 1000), (3, 150)]), (merged, [(0, 2), (1, 3), (2, 1)]), (circle, [(0, 2), (1, 7), (2, 4)])):
        e = spark.createDataFrame(edges, "source_id long, target_id long")
        got = G.descendants(spark.createDataFrame(starts, "src long, node long"), e, ["src"]).collect()
        assert sorted((r["src"], r["node"]) for r in got) == sorted(reached(edges, starts))
        if edges is chain:
            assert len(rounds) < 30
        nodes = spark.createDataFrame([(i,) for i in sorted({n for x in edges for n in x} | {5000})], "node_id long")
        both = edges + [(b, a) for a, b in edges]
        want = {n: min(m for _, m in reached(both, [(0, n)])) for n in (r["node_id"] for r in nodes.collect())}
        assert {r["node_id"]: r["component"] for r in G.components(nodes, e).collect()} == want
    back = spark.createDataFrame([(9, 4), (9, 6), (4, 5), (6, 2)], "source_id long, target_id long")  # starts that are not the smallest
    assert {r["component"] for r in G.components(back.select(F.col("target_id").alias("node_id")), back).collect()} == {2}


def test_forks_of_one_parent_edges_compute_them_once(spark, monkeypatch):
    """the range join behind both edge sets of graph_fork_confusion is written once."""
    from quern.plans import spatial as P

    made = []
    edges = P.edges
    monkeypatch.setattr(P, "edges", lambda t: made.append(edges(t)) or made[-1])
    plans = []
    cut = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: plans.append("_cx" in df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    from quern.registry import QUERIES

    got = QUERIES["graph_fork_confusion"](spark, "/root/testdata/sf0.001").first()
    assert got["tp"] + got["fn"] > 0 and sum(plans) == 1


def test_style_counts_take_one_pass_over_the_words(spark):
    """markers and function words come from one list of words, not from a replacement each; odd texts keep their counts."""
    from quern.operators import textops as X

    texts = [None, "", "It's İSTANBUL — ‘you’ YOU’D you''ll I  ** *** a  -  b   c", "we’we’we We WE", "\x00,. \n\t[(x)]"]
    out = X.style_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text")
    assert "replace(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r for r in out.collect()}
    for i, x in enumerate(texts):
        r = got[i]
        if x is None:
            assert r["log_tokens"] is None and r["marker_0"] is None and r["word_the"] is None and r["chars_per_token"] == 1
            continue
        words = [w for w in X._WORD.findall(x)]
        n = max(len(words), 1)
        assert r["log_tokens"] == pytest.approx(math.log1p(len(words))) and r["word_mean"] == sum(map(len, words)) / n
        assert r["type_token"] == len({w.lower() for w in words}) / n
        assert [r[f"marker_{k}"] for k in range(len(X.MARKERS))] == [(len(x) - len(x.replace(m, ""))) / len(m) / n for m in X.MARKERS]
        assert [r[f"word_{f}"] for f in X.FUNCTION_WORDS] == [sum(w.lower() == f for w in words) / n for f in X.FUNCTION_WORDS]


def test_meetings_of_rare_terms_are_never_rows(spark, monkeypatch):
    """Vectors of one small vocabulary: pairs equal all pairs, whatever the blocks and pieces, without a join by term."""
    import random

    from quern.operators import textops

    rnd = random.Random(3)
    docs = [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 90}" for _ in range(rnd.randint(3, 60)))) for i in range(150)]
    docs += [(i + 200, t + f" own{i}") for i, t in docs[:40]]
    w = textops.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", "text", (1,), 1, 1.0).persist()
    vec = {}
    for r in w.collect():
        vec.setdefault(r["id"], {})[r["term"]] = r["weight"]
    cos = lambda a, b: sum(x * vec[b].get(t, 0.0) for t, x in vec[a].items())
    want = {(a, b): c for a in vec for b in vec if a < b and (c := cos(a, b)) >= 0.6}
    monkeypatch.setattr(textops, "BLOCK_TERMS", 500)
    monkeypatch.setattr(textops, "MEETINGS", 700)
    likely = textops.likely_pairs(w, "id", 0.6)
    assert "Join" not in likely._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["a"], r["b"]): r["cosine"] for r in textops.similar_pairs(w, "id", 0.6).collect()}
    assert len(want) > 40 and got == {k: pytest.approx(c) for k, c in want.items()}
    w.unpersist()


def test_merges_in_one_task_are_those_of_the_rounds(spark, monkeypatch):
    """The last merges run in one task; before, every round was a dozen jobs. Both give the same groups."""
    import random

    from quern.operators import textops

    rnd = random.Random(4)
    base = [" ".join(f"v{rnd.randrange(400)}" for _ in range(25)) for _ in range(8)]
    docs = [(i, " ".join(x if rnd.random() > 0.15 else f"v{rnd.randrange(400)}" for x in base[i % 8].split())) for i in range(64)]
    df = spark.createDataFrame(docs, "id long, text string")
    groups = lambda: sorted(map(tuple, textops.similar_groups(df, "id", "text", 0.5, 5, 0.5).collect()))
    one = groups()
    monkeypatch.setattr(textops, "ONE_TASK", -1)
    assert groups() == one and len({g for _, g in one}) < 64


def test_null_importance_does_every_shuffle_and_fit(spark, monkeypatch):
    """Registered with the shuffles and fits of the reference: six shuffled labels, three fits on the real ones, all rows."""
    from quern import plans
    from quern.operators import models
    from quern.registry import QUERIES

    plans.load()

    fits, plain = [], models.RandomForestClassifier.fit

    def fit(self, data):
        rows = data.agg(F.count(F.lit(1)), F.sum("y"), F.sum(F.col("y") * F.col("id"))).first()
        fits.append((self.getSeed(), *rows))
        return plain(self, data)

    monkeypatch.setattr(models.RandomForestClassifier, "fit", fit)
    folder = "/root/testdata/sf0.001"
    got = QUERIES["null_importance_select"](spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert len(got) == 4 and {f[1] for f in fits} == {rows} and len({f[2] for f in fits}) == 1
    assert [f[0] for f in fits] == [0, 1, 2, 0, 1, 2, 3, 4, 5]
    assert len({f[3] for f in fits}) == 7  # the real order of labels, and six others


def test_titles_send_only_letters_left_that_may_meet(spark):
    """What is left of the other titles is thinned where it is made; whatever two titles leave alike is kept, to the letter."""
    from itertools import combinations

    from quern.operators import joins

    left, right = ["supplier 12 3", "ab", "b"], [f"supplier {i} {i % 7}" for i in range(500, 900)] + ["supplier 21 3", "supplier 1 3 ltd", "cab", "", "x"]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "k string")
    rest = lambda s: {"".join(c for i, c in enumerate(s) if i not in cut) for n in range(3) for cut in combinations(range(len(s)), n)}
    own = joins.shortened(frame(left), 2)
    sent = joins.shortened(frame(right), 2, joins.bits_of(own)).collect()
    held = {(r["k"], r["h"]) for r in own.collect()}
    assert len(held) == sum(len(rest(k)) for k in left) and len(sent) < 400 < sum(len(rest(k)) for k in right)
    got = {(a, r["k"]) for a, h in held for r in sent if r["h"] == h}
    assert got == {(a, b) for a in left for b in right if rest(a) & rest(b)}
