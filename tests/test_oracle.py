"""Registered queries against their SQL on the smallest tables. QUERN_ALL=1 runs every one."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import canon

from quern import plans
from quern.registry import ORACLES, QUERIES, TABLES

plans.load()
DIR = "/root/testdata/sf0.001"
CORE = (
    "metric_ap_at_20pct agg_customer_rfm win_estimators rhythm_next_time basket_similar_wait schema_summary id_alignment "
    "prediction_validator numeric_profile cramers_v kruskal_h spearman_matrix impute_interpolate robust_zscore "
    "target_encode_oof class_centroid_distance fold_stratified split_nested metric_auc best_threshold_f1 "
    "leaderboard_percentile blend_rank_ecdf blend_rank_remap rerank_within_mask weighted_vote anchor_override "
    "uncertainty_gate agg_moments win_rolling ts_decay_fit join_nearest_grid session_sequence tfidf fuzzy_title_match "
    "range_join_gate graph_components knn_join sink_submission"
).split()
NAMES = sorted(ORACLES) if os.environ.get("QUERN_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(canon(got), canon(want), check_dtype=False, rtol=1e-6, atol=1e-6)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
