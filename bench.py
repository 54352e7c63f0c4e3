"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import load_all
from tidemark.session import local_session

HEADLINE = (
    "total_return", "price_features", "trailing_liquidity", "pit_latest", "j_asof_price", "universe_rank",
    "cs_rank", "factor_scores", "composite_select", "statements", "snapshot_metrics", "bt_nav", "perf_summary",
    "dcf", "own_outliers", "classify_headline", "novelty", "search_text", "rank_ic", "screen",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry = load_all()
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    registry["screen_sectors"].run(spark, folder).collect()  # start the JVM's caches
    spent = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    total = round(sum(spent.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": spent, "sf": scale}))


if __name__ == "__main__":
    main()
