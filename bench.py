"""Headline queries, timed one by one; prints a single JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from statweave.session import local_session  # noqa: E402

HEADLINE = [
    "yearly_means",
    "indicator_coverage",
    "workspace_summary",
    "percent_change",
    "trend_table",
    "dashboard_transforms",
    "lag_features",
    "value_ranking",
    "pair_correlations",
    "correlation_matrix_pearson",
    "correlation_matrix_spearman",
    "hierarchy_reconciliation",
    "ingestion_counts",
    "keep_first",
    "audited_upsert",
    "fact_after_two_ingestions",
    "seasonal_naive_holdout",
    "ridge_panel_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "statweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    from workload import aggregates, fields, files, joins, models, selection, windows  # noqa: F401
    from workload.registry import QUERIES

    # Selections and series calculations over a stored fact, as users run them; first the published pair.
    from statweave.operators.compare import comparison
    from statweave.operators.coverage import yearly_means
    from statweave.operators.select import recent_first, timeseries
    from statweave.operators.series import dashboard_transforms, trends
    from statweave.session import materialized
    from workload.observations import obs

    fact = materialized(obs(spark, sf_dir), "bench-fact")
    fact.limit(1).collect()
    seconds = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    done = lambda df: df.write.format("noop").mode("overwrite").save()
    timed("stored_count_and_yearly_means", lambda: (fact.count(), yearly_means(fact).collect()))
    timed("stored_timeseries_page", lambda: timeseries(fact, "ship_value", "World", how="pct_change", start="1997", limit=50).collect())
    timed("stored_recent_first", lambda: recent_first(fact, limit=100).collect())
    timed("stored_comparison", lambda: comparison(fact, "ship_value", "ship_qty", "World")["correlation"].collect())
    timed("stored_dashboard_transforms", lambda: done(dashboard_transforms(fact)))
    timed("stored_trends", lambda: done(trends(fact, 12)))
    for name in names:
        timed(name, lambda: done(QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "stored_rows": fact.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
