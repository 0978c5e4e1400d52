"""Times headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import tempfile
import time

from quantloom.queries import QUERIES
from quantloom.session import session

HEADLINE = [
    "event_bars", "brand_bars", "technical_factors", "rsi_14", "fundamental_factors", "pit_asof_join", "universe_sizes", "transform_pipeline", "neutralize_industry_size", "rank_ic_series", "quantile_returns_b",
    "alpha_batch_metrics", "walk_forward_ic", "alpha_backtest_daily", "topn_rotation", "trade_costs", "covariance", "target_weight_rebalance", "windowed_bars", "claim_conflicts", "vector_topk",
]
DATA, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    tmp = tempfile.mkdtemp(prefix="spark-")
    spark = session(f"local[{CPUS}]", int(CPUS), f"{tmp}/checkpoints", spark__ui__enabled="false", spark__driver__memory="8g", spark__local__dir=tmp, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    names = dict(QUERIES)
    try:
        from quantloom.llm.queries import queries

        import corpus_pipeline

        names |= queries() | {"pipeline": corpus_pipeline.run}
    except ImportError:
        pass
    took = {}
    QUERIES["event_bars"](spark, DATA).count()  # starts the engine
    for name in [*HEADLINE, *[n for n in names if n.startswith("op") or n == "pipeline"]]:
        began = time.time()
        names[name](spark, DATA).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(DATA.rstrip("/"))}))


if __name__ == "__main__":
    main()
