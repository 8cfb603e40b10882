"""Print physical-plan facts for the flagship flows (exchanges, broadcasts, windows, scans).

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickwise.operators import indicators as ind  # noqa: E402
from tickwise.operators import ml  # noqa: E402
from tickwise.operators import portfolio as pf  # noqa: E402
from tickwise.plans import flows  # noqa: E402
from tickwise.session import get_spark  # noqa: E402
from tickwise.sources import fixtures as fx  # noqa: E402


def facts(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", plan)),
        "broadcast_exchanges": plan.count("BroadcastExchange"),
        "window_ops": len(re.findall(r"\bWindow \[", plan)),
        "python_maps": len(re.findall(r"MapInArrow|FlatMapGroupsInPandas|ArrowEvalPython", plan)),
        "scans": sorted(set(re.findall(r"FileScan (\w+) \[([^\]]*)\]", plan))),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]")
    cases = {
        "d27": lambda: ind.warm_rows(flows.enriched_bars(fx.bars_daily(spark, sf))),
        "e11": lambda: flows.signals(fx.bars_daily(spark, sf)),
        "f21": lambda: pf.rebalance(fx.portfolios(spark, sf), fx.positions(spark, sf), flows.signals(fx.bars_hourly(spark, sf)))["orders"],
        "l08": lambda: ml.prepare(fx.bars_daily(spark, sf))["sequences"],
    }
    for name, build in cases.items():
        f = facts(build())
        scans = "; ".join(f"{fmt}[{cols}]" for fmt, cols in f.pop("scans"))
        print(name, f, "scans:", scans)
    spark.stop()


if __name__ == "__main__":
    main()
