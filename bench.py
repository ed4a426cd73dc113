"""Times the headline queries over whole tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paceline import catalog  # noqa: E402
from paceline.session import get_spark  # noqa: E402

HEADLINE = (
    "dedup_rows", "profile", "compare_profiles", "infer_frequency", "rollup_daily", "audit_rollup", "classify_resolution",
    "reconcile_rollups", "reconcile_coverage", "label_from_events", "entity_event_summary", "weekly_features",
    "daily_features", "monthly_features", "order_features", "master_table", "histogram", "boxplot_stats",
    "correlation_matrix", "standardize", "eta_squared", "pca_projection", "silhouette", "davies_bouldin",
    "calinski_harabasz", "knn_distance", "dbscan", "hierarchical_grid", "entity_purity", "relation_strength", "kmeans_grid", "gmm_grid", "evaluate_grid",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    spark = get_spark(app="paceline-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, checkpoint_dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["event_counts"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up is not a query
    spent: dict[str, float] = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    total = round(sum(spent.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": spent, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
