"""Time headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quern import plans
from quern.registry import QUERIES
from quern.session import local_session

HEADLINE = (
    "metric_ap_at_20pct", "agg_customer_rfm", "agg_windowed_lookback", "agg_distinct", "win_estimators", "rhythm_next_time",
    "rhythm_by_category", "basket_similar_wait", "schema_summary", "cross_split_row_overlap", "numeric_profile", "cramers_v",
    "kruskal_h", "spearman_matrix", "impute_interpolate", "robust_zscore", "target_encode_oof", "binned_lookup_rule",
    "class_centroid_distance", "fold_stratified", "metric_auc", "metric_pr_auc", "best_threshold_f1", "leaderboard_percentile",
    "blend_rank_pct", "blend_rank_remap", "weighted_vote", "weight_search_simplex", "uncertainty_gate", "agg_moments",
    "win_rolling", "ts_decay_fit", "ts_savgol", "join_nearest_grid", "session_sequence", "text_style_features", "range_join_gate",
    "graph_components", "knn_join", "oof_logistic",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    plans.load()
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    # start-up (first parquet read, first Python worker, code generation) is not part of any query's time
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        QUERIES["agg_customer_rfm"](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
