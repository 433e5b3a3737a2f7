"""Time the headline queries: one JSON line with seconds per query.

The raw tables and stores are staged first (``stage_tables``). Every query then runs once to
warm up and ``BENCH_RUNS`` times for its median; model fits run once. Rows go to the
``noop`` sink, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import REGISTRY  # noqa: E402
from riskgraph.session import local_session  # noqa: E402
from riskgraph.sources.sample import SampleTables  # noqa: E402

HEADLINE = (
    "component_structural_features",
    "simple_structural_features",
    "edge_component_map",
    "edge_mapping_quality",
    "node_degree",
    "match_node_features",
    "match_edge_features",
    "aggregate_node_features",
    "aggregate_edge_features",
    "node_match_audit",
    "edge_match_audit",
    "store_summary_by_label",
    "null_counts",
    "class_separation",
    "leakage_audit",
    "review_queue",
    "review_budget_metrics",
    "global_metrics",
    "calibration_method_metrics",
    "calibration_bins",
    "average_rank_percentile",
    "feature_zscores",
    "case_evidence_topk",
    "evidence_wide",
    "stratified_split",
    "shuffle_labels",
    "forward_neighbor_mean",
    "khop_dual_channel",
    "graph_mean_max_pool",
    "explained_review_queue",
)
FITS = ("fit_logistic", "fit_random_forest")


def timed(run) -> float:
    start = time.perf_counter()
    result = run()
    if result is not None:
        result.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("riskgraph-bench", cores)
    tables = SampleTables(spark, folder)
    seconds = {}

    def stage() -> None:
        tables.scores()
        tables.node_edge_store()

    seconds["stage_tables"] = timed(stage)
    for name in HEADLINE:
        timed(lambda: REGISTRY[name](spark, folder))
        seconds[name] = statistics.median(
            timed(lambda: REGISTRY[name](spark, folder)) for _ in range(runs)
        )
    for name in FITS:
        seconds[name] = timed(lambda: REGISTRY[name](spark, folder))
    rounded = {name: round(value, 3) for name, value in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(rounded.values()), 3),
                "unit": "sec",
                "queries": rounded,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
