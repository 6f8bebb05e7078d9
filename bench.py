"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma separated, default below).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["sweep_scores", "walk_forward", "factor_decay", "asof_adjustment", "bootstrap_sharpe", "perf_summary", "alpha_factors",
            "regimes", "cov_matrix", "option_by_delta", "stop_hits", "round_trips", "fill_ledger", "trade_stats", "ewm",
            "xs_momentum", "stream_ohlcv"]


def main() -> None:
    from marketframe.catalog import load
    from marketframe.session import local_session
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    queries, _ = load()
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    queries["perf_summary"](spark, path).write.format("noop").mode("overwrite").save()      # start the JVM's engines
    took = {}
    for name in names:
        runs = []
        for _ in range(2):                      # the first run also compiles; the better of two counts
            start = time.time()
            queries[name](spark, path).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": path.rsplit("sf", 1)[-1].strip("/"), "cpus": cpus}))


if __name__ == "__main__":
    main()
