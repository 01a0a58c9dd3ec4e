"""Edge cases, invariants, leak checks and brute-force comparisons on small frames."""


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions.mathx import norm_cdf, sample_kurtosis, sample_skew
from quern.operators import blend, encode, folds, graph, joins, series, spatial, textops
from quern.sources import files


def test_moments_of_known_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 9, 14)], "x double")
    r = df.agg(sample_skew(F.col("x")).alias("s"), sample_kurtosis(F.col("x")).alias("k")).first()
    assert r["s"] == pytest.approx(1.284428, abs=1e-6) and r["k"] == pytest.approx(0.323386, abs=1e-6)


def test_normal_cdf(spark):
    import math

    df = spark.createDataFrame([(x / 10,) for x in range(-60, 61)], "x double")
    for r in df.select("x", norm_cdf(F.col("x")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * (1 + math.erf(r["x"] / math.sqrt(2))), abs=1e-7)


def test_degenerate_series_give_null(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 5.0, 1.0), (2, 2, 0.0, 3.0, 1.0), (2, 3, 0.0, 3.0, 1.0)], "e int, u int, t double, v double, r double")
    m = {r["e"]: r for r in series.moments(df, ["e"], "v").collect()}
    assert m[1]["skew"] is None and m[2]["std"] == 0 and m[2]["mad"] == 0
    rates = {r["e"]: r["rise_rate"] for r in series.max_rates(df, ["e"], "t", "v", "u").collect()}
    assert rates == {1: None, 2: None}
    assert series.slope(df, ["e"], "t", "v").where("slope IS NOT NULL").count() == 0


def test_mid_rank(spark):
    df = spark.createDataFrame([(x,) for x in (0.2, 0.5, 0.5, 0.8)], "m double")
    got = blend.rank_ecdf(df, spark.createDataFrame([(0.5,)], "m double"), ["m"]).first()
    assert got["blend"] == pytest.approx(0.5)


def test_unseen_key_gets_training_median(spark):
    train = spark.createDataFrame([("a", 20.0), ("a", 40.0), ("b", 30.0)], "k string, age double")
    r = encode.group_profile(train, spark.createDataFrame([("z", 50.0)], "k string, age double"), "k", ["age"]).first()
    assert r["k_count"] == 0 and r["age_gm"] == 30.0 and r["age_res"] == 20.0


def test_own_target_does_not_leak_into_its_encoding(spark):
    rows = [(i, "ab"[i % 2], i % 3, i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame([(i, k, f, int(y)) for i, k, f, y in rows], "id int, k string, fold int, y int")
    flipped = df.withColumn("y", F.when(F.col("id") == 7, 1 - F.col("y")).otherwise(F.col("y")))
    enc = lambda d: {r["id"]: r["k_te"] for r in encode.target_encode_oof(d, "k", "y", "fold").collect()}
    assert enc(df)[7] == enc(flipped)[7]


def test_folds_partition_and_keep_groups(spark):
    df = spark.range(300).withColumn("g", F.col("id") % 17).withColumn("c", (F.col("id") % 4).cast("string"))
    s = folds.stratified(df, "id", ["c"], 5).groupBy("c", "fold").count().toPandas()
    assert s["count"].sum() == 300 and s.groupby("c")["count"].agg(lambda x: x.max() - x.min()).max() <= 1
    assert folds.grouped(df, "g", 4).groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_rerank_keeps_the_multiset(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(200), "a": np.round(rng.random(200), 2), "b": rng.random(200), "m": rng.random(200) < 0.4})
    got = blend.rerank_within_mask(spark.createDataFrame(pdf), F.col("m"), "a", "b", "id").toPandas()
    assert sorted(got[got.m]["reranked"]) == sorted(pdf[pdf.m]["a"])
    assert (got[~got.m]["reranked"] == got[~got.m]["a"]).all()


def test_submission_rejects_a_missing_id(spark, tmp_path):
    sample = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "id int, pos int")
    good = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id int, p double")
    out = files.sink_submission(good, sample, "id", "p", "pos", str(tmp_path / "ok"))
    assert {(r["id"], r["p"]) for r in out.collect()} == {(1, 0.1), (2, 0.2), (3, 0.3)}
    with pytest.raises(ValueError, match="missing_ids"):
        files.sink_submission(good.where("id < 3"), sample, "id", "p", "pos", str(tmp_path / "bad"))


def test_text_to_number(spark):
    from quern.operators.scalar import to_numeric

    df = spark.createDataFrame([("1.5",), (" ",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(to_numeric("s")).collect()] == [1.5, None, None, None]


def test_greedy_links_match_a_sorted_scan(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b), round(float(rng.random()), 2)) for a in range(25) for b in range(100, 125) if rng.random() < 0.3]
    used_a, used_b, want = set(), set(), set()
    for c, a, b in sorted((c, a, b) for a, b, c in pairs):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    df = spark.createDataFrame(pairs, "source_id long, target_id long, distance double")
    assert {(r["source_id"], r["target_id"]) for r in graph.link_greedy(df, "distance").collect()} == want


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5001)]
    df = spark.createDataFrame(edges, "source_id long, target_id long")
    nodes = spark.createDataFrame([(x,) for x in sorted({v for e in edges for v in e} | {9999})], "node_id long")
    got = {r["node_id"]: r["component"] for r in graph.components(nodes, df).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(80)) and got[9999] == 9999 and got[5001] == 5000


def test_knn_with_a_crowded_place_and_copies(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.normal(0, 0.001, (150, 2)), np.tile([[5.0, 5.0]], (40, 1)), rng.uniform(-50, 50, (60, 2))])
    pdf = pd.DataFrame({"id": range(len(xy)), "e": rng.integers(0, 12, len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    df = spark.createDataFrame(pdf)
    ref = df.select(F.col("id").alias("rid"), F.col("e").alias("re"), "x", "y")
    got = spatial.knn(df, ref, [], "x", "y", 3, "id", "rid", other=("e", "re")).toPandas()
    for i, r in pdf.iterrows():
        o = pdf[pdf.e != r.e]
        d = np.sqrt((o.x - r.x) ** 2 + (o.y - r.y) ** 2)
        want = pd.DataFrame({"d": d, "id": o.id}).sort_values(["d", "id"]).head(3)
        mine = got[got.id == r.id].sort_values("rank")
        assert np.allclose(mine["distance"], want["d"]) and set(mine["rid"]) == set(want["id"])


def test_similar_pairs_match_all_pairs(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words[:30] if i % 2 else words, 12))) for i in range(60)]
    w = textops.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", "text", (1,), 1, 1.0)
    m = w.toPandas().pivot(index="id", columns="term", values="weight").fillna(0.0)
    s = m.to_numpy() @ m.to_numpy().T
    want = {(int(m.index[i]), int(m.index[j])) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] >= 0.4}
    got = {(r["a"], r["b"]) for r in textops.similar_pairs(w, "id", 0.4).collect()}
    assert got == want and want


def test_copies_are_dealt_into_capped_groups(spark):
    docs = [(i, "same words in every copy") for i in range(40)] + [(100 + i, f"alone{i} other{i} text{i}") for i in range(3)]
    got = textops.similar_groups(spark.createDataFrame(docs, "id long, text string"), "id", "text", 0.6).toPandas()
    sizes = got.groupby("group_id").size()
    assert len(got) == 43 and sizes.max() <= 18 and sorted(sizes) == [1, 1, 1, 4, 18, 18]


def test_fuzzy_match_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = ["credit card fraud", "customer churn", "cell tracking", "air travel", "loan payback", "go", "melting point"]
    left = [(i, b.replace("c", "k", 1) if i % 2 else b.title()) for i, b in enumerate(base)]
    right = [(100 + i, b + (" 2024" if i % 3 == 0 else "")) for i, b in enumerate(base)] + [(200, "something else"), (201, "g")]
    l, r = spark.createDataFrame(left, "lid long, a string"), spark.createDataFrame(right, "rid long, b string")
    j = l.join(r).select("lid", "rid", F.round(joins.title_similarity(joins.title_key("a"), joins.title_key("b")), 9).alias("s"))
    want = {}
    for x in sorted(j.where("s >= 0.7").collect(), key=lambda x: (x["lid"], -x["s"], x["rid"])):
        want.setdefault(x["lid"], (x["rid"], x["s"]))
    got = {x["lid"]: (x["rid"], x["similarity"]) for x in joins.fuzzy_match(l, r, "lid", "a", "rid", "b", 0.7).collect() if x["rid"] is not None}
    assert got == want and len(want) > 3


def test_transfer_starts_at_zero(spark):
    t = spark.createDataFrame([(1, 10, 0.0), (1, 11, 2.0), (1, 12, 9.0)], "e long, u long, p double")
    r = spark.createDataFrame([(2, 1.0, 4.0), (2, 4.0, 10.0)], "e long, p double, c double")
    c = spark.createDataFrame([(1, 2)], "e long, ref long")
    got = {x["u"]: x["transferred"] for x in spatial.anchor_transfer(t, r, c, "e", "u", "p", "c").collect()}
    assert got == {10: 0.0, 11: 6.0, 12: 10.0}


def test_gap_bridge_is_one_to_one(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (2, 0, 1, 1.0, 0.0), (3, 0, 4, 4.0, 0.0), (4, 0, 5, 5.0, 0.0), (5, 0, 4, 4.5, 0.5)], "node_id long, ds long, t long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0.9, 1.0), (3, 4, 0.9, 1.0)], "source_id long, target_id long, prob double, distance double")
    got = graph.gap_bridge(nodes, edges, 3, 30.0, 10.0, 1.0).collect()
    assert [(r["source_id"], r["target_id"]) for r in got] == [(2, 3)]


def test_node_match_takes_the_nearest_first(spark):
    p = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (2, 0, 0, 3.0, 0.0)], "node_id long, ds long, t long, x double, y double")
    g = spark.createDataFrame([(11, 0, 0, 1.0, 0.0), (12, 0, 0, -5.0, 0.0)], "node_id long, ds long, t long, x double, y double")
    got = {(r["pred_id"], r["true_id"]) for r in graph.node_match(p, g, 5.5).collect()}
    assert got == {(1, 11)}


def test_long_chains_of_falling_costs_are_linked_to_the_end(spark):
    # each pair is cheaper than the one before, so a round settles one pair
    n = 70
    pairs = [(i, 1000 + i, float(2 * n - 2 * i)) for i in range(n)] + [(i + 1, 1000 + i, float(2 * n - 2 * i - 1)) for i in range(n - 1)]
    df = spark.createDataFrame(pairs, "source_id long, target_id long, distance double")
    assert graph.link_greedy(df, "distance").count() == n


def test_motion_link_prefers_the_predicted_place(spark):
    rows = [(1, 0, 0, 0.0, 0.0), (2, 0, 1, 1.0, 0.0), (3, 0, 2, 3.5, 0.0), (4, 0, 2, -1.2, 0.0)]
    nodes = spark.createDataFrame(rows, "node_id long, ds long, t long, x double, y double")
    got = {(r["source_id"], r["target_id"]) for r in graph.motion_link(nodes, 1.5, 4.0).collect()}
    assert got == {(1, 2), (2, 3)}


def test_weights_on_the_simplex():
    g = blend.simplex_grid(3, 10)
    assert len(g) == 66 and all(abs(sum(w) - 1) < 1e-9 for w in g)


def test_a_long_visit_is_one_row(spark):
    hits = spark.range(25_000).select(F.lit("v").alias("visit"), "id", (F.col("id") * 7 % 25_000).alias("t"), F.col("id").cast("int").alias("item"))
    r = textops.session_sequence(hits, "visit", "t", "id", "item").collect()
    assert len(r) == 1 and r[0]["session_len"] == len(r[0]["items"]) == 25_000
    assert textops.session_sequence(hits, "visit", "t", "id", "item", piece=10_000).count() == 3


def test_any_number_of_levels(spark):
    df = spark.range(1500).select("id", F.concat(F.lit("a long common prefix "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("c"))
    got = encode.one_hot_sparse(df, df.where("id < 1400"), "id", "c").toPandas().sort_values("id")
    assert got["code"].tolist() == list(range(1400))


def test_stage_cache_follows_its_sources(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(3).write.parquet(src)
    build = lambda: spark.read.parquet(src)
    key = lambda p=1: files.fingerprint([spark.read.parquet(src)], p)
    assert files.stage_cache(spark, out, build, key()).count() == 3
    spark.range(5).write.mode("overwrite").parquet(src)
    assert files.stage_cache(spark, out, build, key()).count() == 5
    assert key() != key(2)
