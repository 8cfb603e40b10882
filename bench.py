"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed completely (``noop`` sink); times are wall seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tickwise.operators import indicators as ind  # noqa: E402
from tickwise.operators import ml  # noqa: E402
from tickwise.operators import portfolio as pf  # noqa: E402
from tickwise.plans import flows  # noqa: E402
from tickwise.session import get_spark  # noqa: E402
from tickwise.sources import fixtures as fx  # noqa: E402
from tickwise.sources import ingest as ig  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    def daily():
        return fx.bars_daily(spark, sf_dir)

    def hourly():
        return fx.bars_hourly(spark, sf_dir)

    queries = {
        # 15 indicators over 60-row frames for every daily bar (1,000 symbols at sf0.1)
        "d27_enriched_daily": lambda: ind.warm_rows(flows.enriched_bars(daily())),
        # Indicators + six signals + regime + score in one windowed plan
        "e11_signals_daily": lambda: flows.signals(daily()),
        # all customers rebalanced at every cycle from hourly signals
        "f21_rebalance_orders": lambda: pf.rebalance(
            fx.portfolios(spark, sf_dir), fx.positions(spark, sf_dir), flows.signals(hourly()))["orders"],
        # Whole-history features, clean, split, scale, 60x21 sequences
        "l08_ml_prepare_daily": lambda: ml.prepare(daily())["sequences"].select(
            "symbol", "split", "ts", "y", F.size("X").alias("steps")),
        # H7 + B7 + A2 + A3: documents -> messages -> decoded bars
        "a03_message_round_trip": lambda: ig.explode_bars(ig.decode_messages(ig.to_messages(ig.documents_wide(hourly())))),
    }
    run(daily())  # warm-up: JVM, parquet footers
    times, rows = {}, {}
    for name, build in queries.items():
        t0 = time.time()
        run(build())
        times[name] = round(time.time() - t0, 3)
    bars = daily().count()
    rows["bars_daily"] = bars
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
        "cpus": cpus, "rows": rows,
        "bars_per_sec": {k: round(bars / v, 1) for k, v in times.items() if k.endswith("_daily") and v > 0},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
