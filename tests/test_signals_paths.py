"""E2 in the Arrow map equals the JVM fold + window path, whatever the Arrow batch size; as-of lookup; K5."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from tests.conftest import SF001
from tickwise.operators import indicators as ind
from tickwise.operators import portfolio as pf
from tickwise.operators import signals as sg
from tickwise.sources import fixtures as fx
from tickwise.sources import sinks as sk
from tickwise.streaming import engine


def _signals(bars, method):
    enr = ind.enrich(bars, with_ema=False)
    return sg.signal_table(enr, ema_method=method)


def test_arrow_e2_equals_fold_with_tiny_batches(spark):
    bars = fx.bars_hourly(spark, SF001)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")          # most rows' predecessors sit in an earlier batch, and every row's frame
    try:
        a = _signals(bars, "arrow").select("symbol", "ts", "signal_2_macd", "macd_line", "marker_final_score").collect()
    finally:
        spark.conf.set(key, old)
    b = _signals(bars, "fold").select("symbol", "ts", "signal_2_macd", "macd_line", "marker_final_score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) > 0


def test_a_cycle_per_trigger_equals_all_cycles_at_once(spark, tmp_dir):
    """Orders of every trigger, also when one is delivered again; only the last cycle's orders are pending."""
    bars = fx.bars_hourly(spark, SF001)
    sig = _signals(bars, "arrow")
    sig.write.parquet(f"{tmp_dir}/signals")
    sig = spark.read.parquet(f"{tmp_dir}/signals")
    ports, pos = fx.portfolios(spark, SF001), fx.positions(spark, SF001)
    whole = pf.rebalance(ports, pos, sig)
    assert {1, 2} & {r.cycle for r in whole["orders"].collect()}
    want, times = whole["orders"].collect(), [r[0] for r in whole["fresh"].select("cycle_ts").distinct().orderBy("cycle_ts").collect()]
    run = engine.Rebalancer(f"{tmp_dir}/run", period_s=pf.DAY_S, max_age_s=pf.DEFAULT_MAX_AGE_S)
    run.begin(ports, pos)
    for n, end in enumerate(times[:3]):
        day = sig.where((F.col("ts") <= F.lit(end)) & (F.col("ts") > F.lit(end) - F.expr("INTERVAL 1 DAY")))
        for _ in range(2 if n == 1 else 1):
            run(day, n)
        got = spark.read.parquet(f"{tmp_dir}/run/pending").collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r) for r in want if r.cycle == n + 1)
    run(sig.limit(0), 3)        # a trigger without signals keeps the state
    state = sk.load_state(spark, f"{tmp_dir}/run/v=3")
    assert {r.portfolio_id: r.trades_used for r in state["portfolios"].collect() if r.trades_used} == dict(collections.Counter(r.portfolio_id for r in want if r.cycle <= 3))


def test_asof_for_any_period_and_age(spark):
    """Against a plain search: every cycle sees the newest signal at or before it that is young enough."""
    rng = random.Random(2)
    start = dt.datetime(2023, 12, 31, 23, 50)
    rows = [(s, start + dt.timedelta(seconds=rng.randrange(0, 4000), microseconds=rng.choice([0, 0, 500])), float(i)) for s in "AB" for i in range(25)]
    rows += [("C", dt.datetime(2024, 1, 1), 7.0), ("D", dt.datetime(1969, 12, 31, 23, 59, 30), 8.0)]
    none = {c: None for c in ("atr_14", "marker_final_score", "regime", "regime_confidence", "volume")}
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").dropDuplicates(["symbol", "ts"]).withColumns({c: F.lit(v).cast("double") for c, v in none.items()})
    taken = [tuple(r)[:3] for r in df.collect()]
    epoch = dt.datetime(1970, 1, 1)
    for period, age in [(300, 60), (300, 1000), (60, 60), (3600, 90_000)]:
        got = sorted(tuple(r)[:4] for r in pf.fresh_signals(df, age, period).collect())
        want = []
        for symbol in "ABCD":
            own = sorted(r for r in taken if r[0] == symbol)
            first = (own[0][1] - epoch) // dt.timedelta(seconds=period)
            last = (own[-1][1] + dt.timedelta(seconds=age) - epoch) // dt.timedelta(seconds=period)
            for k in range(first, last + 1):
                at = epoch + dt.timedelta(seconds=k * period)
                seen = [r for r in own if r[1] <= at]
                if seen and at - seen[-1][1] <= dt.timedelta(seconds=age):
                    want.append((at, symbol, seen[-1][1], seen[-1][2]))
        assert got == sorted(want)
