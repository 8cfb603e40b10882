"""D27 and E11 in one Arrow pass equal the windows, gaps and chunks included, and leave next to no windows in the plan."""

import datetime as dt
import random

from tests.conftest import SF001
from tickwise.operators import chunking
from tickwise.operators import indicators as ind
from tickwise.operators import signals as sg
from tickwise.plans import catalog

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, date string, time string"


def _bars(spark):
    """Series of 1, 50, 130 and 330 rows; the last has missing prices and volumes, equal prices and a NaN."""
    rnd, rows = random.Random(5), []
    for symbol, n in (("A", 1), ("B", 50), ("C", 130), ("D", 330)):
        price = 100.0
        for i in range(n):
            price = max(1.0, price + rnd.choice([0.0, rnd.uniform(-3, 3)]))
            row = [price, price + rnd.random(), price - rnd.random(), price, float(rnd.randrange(1, 500))]
            if symbol == "D":
                row = [None if rnd.random() < 0.03 else v for v in row]
                row[3] = float("nan") if i == 200 else row[3]
                row[4] = 0.0 if 100 <= i < 115 else row[4]
            rows.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *row, "d", "t"))
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df, cols):
    """Rows by series and time; a NaN input is told apart from a missing one by its text."""
    return {(r["symbol"], r["ts"]): [str(r[c]) for c in cols] for r in df.select("symbol", "ts", *cols).collect()}


def test_one_pass_equals_windows_over_gaps_and_batches(spark):
    bars = _bars(spark).coalesce(1).localCheckpoint()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    cols = ["rn", "n_sym", "is_enriched", *ind.INDICATOR_COLS]
    want = _rows(ind.enrich(bars, ema_method="fold"), cols)
    sig = _rows(sg.signal_table(ind.enrich(bars, with_ema=False), ema_method="fold"), sg.SIGNAL_OUT)
    assert len(sig) > 100
    try:
        for size in ("9", "10000"):
            spark.conf.set(key, size)
            assert _rows(ind.enrich(bars), cols) == want
            for lay in (chunking.layout(bars, None), chunking.layout(bars, 120, force=True)):
                enr = ind.enrich(lay.rows, lay.spec, signals=True)
                got = _rows(lay.own(sg.signal_table(enr, lay.spec, ("chunk", "_own_chunk") if lay.chunked else ())), sg.SIGNAL_OUT)
                assert got.keys() == sig.keys()
                for k, row in got.items():
                    for c, a, b in zip(sg.SIGNAL_OUT, row, sig[k]):     # tanh and power may differ in the last place
                        assert a == b or abs(float(a) - float(b)) <= 1e-12, (k, c, a, b)
    finally:
        spark.conf.set(key, old)


def test_few_windows_in_the_plans(spark):
    for query in ("e11_signal_table", "e12_latest_signal", "d27_enriched_bars"):
        plan = catalog.QUERIES[query](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") <= 2, query       # before: a window node for every few of about fifty frames


def test_symbols_are_counted_before_buckets(spark):
    calls = []
    real = chunking.bucket_counts
    chunking.bucket_counts = lambda *a: calls.append(1) or real(*a)
    try:
        assert not chunking.layout(_bars(spark), 1000).chunked and not calls
        assert chunking.layout(_bars(spark), 200).chunked and calls
    finally:
        chunking.bucket_counts = real


def test_newest_signals_come_from_few_rows(spark):
    """before, E12 sorted every SIGNAL row; now the pass returns the last one of each series and batch."""
    bars = _bars(spark).coalesce(1).localCheckpoint()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for size, most in (("9", 50), ("10000", 2)):
            spark.conf.set(key, size)
            for lay in (chunking.layout(bars, None), chunking.layout(bars, 120, force=True)):
                extra = ("chunk", "_own_chunk") if lay.chunked else ()
                every, last = (lay.own(sg.signal_table(ind.enrich(lay.rows, lay.spec, signals=True, newest=n), lay.spec, extra)) for n in (False, True))
                assert _rows(sg.latest_signal(last), sg.SIGNAL_OUT) == _rows(sg.latest_signal(every), sg.SIGNAL_OUT)
                assert 2 <= last.count() <= (most if not lay.chunked else 100) < every.count()
    finally:
        spark.conf.set(key, old)


def test_row_numbers_come_from_the_pass(spark):
    """a window for ``rn`` looked at every row once more."""
    for query, most in (("e11_signal_table", 0), ("e12_latest_signal", 0), ("d27_enriched_bars", 1)):
        plan = catalog.QUERIES[query](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") <= most, query
