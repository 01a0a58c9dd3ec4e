"""Groups above the row limit must give exactly what the plain path gives."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import ordered as O
from quern.operators import align, metrics, series


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 1200
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 25, n))
    t = np.round(np.cumsum(rng.random(n)), 4)
    v = np.round(rng.normal(size=n), 1)
    gap = np.where(rng.random(n) < 0.4, None, v)
    pdf = pd.DataFrame({"ent": key, "u": np.arange(n), "t": t, "v": v, "y": (rng.random(n) < 0.3).astype(int)})
    pdf["g"] = pd.Series(gap, dtype="float64")
    return spark.createDataFrame(pdf).withColumn("g", F.when(~F.isnan("g"), F.col("g"))).cache()


def same(a, b, keys, cols):
    a, b = (x.select(*keys, *cols).toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_row_numbers_and_sums(rows):
    f = lambda lim: O.running(rows, ["ent"], F.col("v"), ["v", "u"], {"rn": F.lit(1), "s": F.col("y")}, lim)
    same(f(None), f(20), ["u"], ["rn", "s"])
    g = lambda lim: O.numbered(rows, [], F.col("v"), ["v", "u"], "rn", lim)
    same(g(None), g(50), ["u"], ["rn"])


@pytest.mark.parametrize("reverse", [False, True])
def test_carry(rows, reverse):
    f = lambda lim: O.carried(rows, ["ent"], F.col("t"), ["t", "u"], {"c": F.col("g")}, reverse, lim)
    same(f(None), f(20), ["u"], ["c"])


def test_frames(rows):
    build = lambda w: {"l": F.lag("v", 3).over(w), "a": F.avg("v").over(w.rowsBetween(-5, 4))}
    f = lambda lim: O.framed(rows, ["ent"], F.col("t"), ["t", "u"], 5, 4, build, lim)
    same(f(None), f(15), ["u"], ["l", "a"])


def test_quantiles_and_ranks(rows):
    want = {"m": ("g", 0.5), "p": ("v", 0.9), "lo": ("v", 0.0)}
    same(O.quantiles(rows, ["ent"], want), O.quantiles(rows, ["ent"], want, 15), ["ent"], ["m", "p", "lo"])
    got = O.quantiles(rows, [], want, 40).first()
    v = rows.toPandas()
    assert got["m"] == pytest.approx(v["g"].median()) and got["p"] == pytest.approx(v["v"].quantile(0.9))
    same(O.average_rank(rows, ["ent"], "v", "r", True), O.average_rank(rows, ["ent"], "v", "r", True, 15), ["u"], ["r"])


def test_metrics(rows):
    same(metrics.auc(rows, ["ent"], "y", "v"), metrics.auc(rows, ["ent"], "y", "v", limit=10), ["ent"], ["auc"])
    f = lambda lim: metrics.ap_at_share(rows, ["ent"], "y", "v", "u", limit=lim)
    same(f(None), f(10), ["ent"], ["ap"])


def test_savgol_matches_direct_fit(rows):
    p = series.prefix_frame(rows, "ent", "t", "u", "g")
    f = lambda lim: series.savgol(p, "ent", "t", "u", "v", 7, 2, lim)
    same(f(None), f(25), ["u"], ["smooth"])
    one = f(None).where("ent = 0").toPandas().sort_values("t").reset_index(drop=True)
    x, y = np.arange(-3, 4), one["v"].to_numpy()
    assert one["smooth"][10] == pytest.approx(np.polyval(np.polyfit(x, y[7:14], 2), 0))
    assert one["smooth"][1] == pytest.approx(np.polyval(np.polyfit(x, y[:7], 2), -2))


def test_sequential_decoding(spark, rows):
    f = lambda lim: align.step_limit(rows, "ent", "t", "u", "v", 0.3, lim)
    same(f(None), f(60), ["u"], ["value"])
    grid = spark.createDataFrame([(float(i), float(np.sin(i))) for i in range(20)], "x double, y double")
    g = grid.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("grid")).scalar()
    pay = rows.groupBy("ent").agg(F.lit(0.0).alias("start")).select("ent", F.struct(g.alias("grid"), "start", F.lit(1.0).alias("direction")).alias("payload"))
    b = lambda lim: align.beam(rows, pay, "ent", "t", "u", "v", limit=lim)
    same(b(None), b(90), ["u"], ["value"])


@pytest.mark.parametrize("by", ["ties", "nulls"])
def test_tied_and_null_leads_are_cut_by_the_rest_of_the_order(spark, by):
    lead = F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(F.lit(1.0 if by == "ties" else None).cast("double"))
    df = spark.range(3000).withColumn("v", lead)
    cut = O.chunked(df, [], F.col("v"), 100, ["v", "id"])
    sizes = [r["count"] for r in cut.groupBy(O.CHUNK).count().collect()]
    assert max(sizes) < 400
    f = lambda lim: O.numbered(df, [], F.col("v"), ["v", "id"], "rn", lim)
    same(f(None), f(100), ["id"], ["rn"])


def test_names_with_dots_and_clashes(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "id long, `_r_id` double")
    got = O.average_rank(df, [], "_r_id", "_r__r_id", limit=20)
    same(O.average_rank(df, [], "_r_id", "_r__r_id"), got, ["id"], ["_r__r_id"])
    q = {"a|0.25": ("_r_id", 0.25), "b.c": ("_r_id", 0.5)}
    assert O.quantiles(df, [], q, 20).first() == O.quantiles(df, [], q).first()


LOWERED = (
    "spearman_matrix blend_rank_pct iqr_outliers blend_selective label_encode_union fold_stratified_group metric_ap_at_20pct "
    "agg_moments impute_interpolate robust_zscore blend_rank_remap kruskal_h"
).split()


@pytest.fixture
def small_limit(monkeypatch):
    import quern.operators.align as a
    import quern.operators.scalar as b
    import quern.operators.series as c

    for m in (O, a, b, c):
        monkeypatch.setattr(m, "ROWS_PER_TASK", 60)


@pytest.mark.parametrize("name", sorted(__import__("test_oracle").ORACLES) if os.environ.get("QUERN_ALL") else LOWERED)
def test_registered_queries_on_the_large_path(spark, small_limit, name):
    """The chunked path of a query gives what its SQL gives."""
    import duckdb
    from test_oracle import DIR, ORACLES, QUERIES, TABLES, canon

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    pd.testing.assert_frame_equal(canon(got), canon(want), check_dtype=False, rtol=1e-6, atol=1e-6)


CHAINS = (
    "win_sequence_features ts_surface_offset impute_median_train group_profile_residual stack_meta_features ts_segment_medians "
    "ts_median_slope_extrapolate rerank_within_mask blend_rank_remap robust_zscore"
).split()


@pytest.mark.parametrize("name", CHAINS)
def test_chains_read_their_source_a_few_times(spark, small_limit, name):
    """On the large path the source is read by the written order index, not once per step of the chain."""
    from test_oracle import DIR, QUERIES

    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count(f"[file:{DIR}/") <= 4


def test_stored_frames_keep_names_types_and_rows(spark, tmp_path):
    from quern.session import stored

    df = spark.sql("SELECT id, id AS `a.b`, CAST(id AS STRING) AS ID2, array(struct(id AS x)) AS s FROM range(5)")
    clash = df.select("*", F.lit(1.5).alias("id"))
    copy = stored(clash)
    assert copy.columns == clash.columns and [t for _, t in copy.dtypes] == [t for _, t in clash.dtypes]
    assert sorted(copy.collect()) == sorted(clash.collect())
    assert stored(clash) is copy and stored(copy) is copy
    assert stored(df.where("id < 0")).count() == 0
    assert stored(spark.sql("SELECT 1 AS a, NULL AS b")).first()["b"] is None
