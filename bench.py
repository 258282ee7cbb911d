"""Time the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from gridcompare.operators.selection import apply_selection, next_selection  # noqa: E402
from gridcompare.plans.catalog import CHAIN, all_queries  # noqa: E402
from gridcompare.session import session  # noqa: E402
from gridcompare.sources.driver_tables import DriverTables  # noqa: E402

# The first two read the raw tables and the last four the area and event tables; the others read the stored
# grouped fact and what is stored from it, as a user's queries do.
HEADLINE = (
    "harmonise_layouts",
    "grouped_fact",
    "facet_combinations",
    "facet_values",
    "flagship",
    "filter_with_polygon",
    "fallback_spatial",
    "refine_subset",
    "refine_chain",
    "map_view",
    "map_deciles",
    "plot_view",
    "series_dense",
    "gridtype_share",
    "top_rows",
    "area_dim",
    "areas_within_polygon",
    "selection_disjoint",
    "hull_centre",
)
RUNS = 3


def chain_step_seconds(spark, sf_dir: str) -> list[float]:
    """Time of each step of a session of changed selections, rows to show included."""
    tables = DriverTables(spark, sf_dir)
    grouped, areas, kept = tables.grouped(), tables.areas(), tables.kept()
    result, times = apply_selection(grouped, areas, CHAIN[0], None, True, kept).keep(), []
    for selection in CHAIN[1:]:
        start = time.perf_counter()
        result, _ = next_selection(grouped, areas, result, selection, True, kept)
        result.filtered.write.format("noop").mode("overwrite").save()
        times.append(round(time.perf_counter() - start, 3))
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "gridcompare-bench",
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    first = {name: run(name) for name in HEADLINE}  # also stores the tables the others read
    timed = {name: statistics.median(run(name) for _ in range(RUNS)) for name in HEADLINE}
    steps = chain_step_seconds(spark, sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median of 3, after one first run)",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": {name: round(sec, 3) for name, sec in timed.items()},
                "first_run": {name: round(sec, 3) for name, sec in first.items()},
                "chain_steps": steps,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
