"""D1-D15, D27, C5, C6, E1-E11 against plain loops over the formulas and edge cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF001
from tickwise.operators import indicators as ind
from tickwise.operators import signals as sg
from tickwise.plans import flows
from tickwise.sources import fixtures as fx

BAR_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, date string, time string"


def window_indicators(w: pd.DataFrame) -> dict:
    """Indicators of the last row of a frame, from the formulas of SURVEY 2.D in plain loops."""
    def value(x):
        return None if x is None or math.isnan(x) else float(x)

    rows = [{k: value(r[k]) for k in ("high", "low", "close", "volume")} for _, r in w.iterrows()]
    close = [r["close"] for r in rows]

    def mean(xs, n):
        last = xs[-n:]
        return None if len(last) < n or None in last else sum(last) / n

    def ema(xs, span):
        """Recurrence from the first present value; a gap decays the old weight; null before ``span`` values."""
        keep, out, state, old, seen = 1 - 2 / (span + 1), [], None, 1.0, 0
        for x in xs:
            if state is None:
                state = x
            else:
                old *= keep
                if x is not None:
                    state = (old * state + (1 - keep) * x) / (old + (1 - keep))
                    old = 1.0
            seen += x is not None
            out.append(state if seen >= span else None)
        return out

    def minus(a, b):
        return None if a is None or b is None else a - b

    def over(a, b):
        return None if a is None or b is None or b == 0 else a / b

    steps = [None] + [minus(b, a) for a, b in zip(close, close[1:])]
    ranges = []
    for i, r in enumerate(rows):
        prev = close[i - 1] if i else None
        sizes = [minus(r["high"], r["low"])] + [None if minus(r[k], prev) is None else abs(minus(r[k], prev)) for k in ("high", "low")]
        sizes = [x for x in sizes if x is not None]
        ranges.append(max(sizes) if sizes else None)
    line = [minus(a, b) for a, b in zip(ema(close, 12), ema(close, 26))]
    mid, sd = mean(close, 20), None
    if mid is not None:
        sd = math.sqrt(sum((x - mid) ** 2 for x in close[-20:]) / 19)
    sma, vma = mean(close, 10), mean([r["volume"] for r in rows], 10)
    gain = mean([x if x is not None and x > 0 else 0.0 for x in steps], 14)
    loss = mean([-x if x is not None and x < 0 else 0.0 for x in steps], 14)
    rs = over(gain, loss)
    filled = []  # the percentage change looks past gaps
    for x in close:
        filled.append(x if x is not None else filled[-1] if filled else None)
    change = None if len(filled) < 2 else over(minus(filled[-1], filled[-2]), filled[-2])
    return {
        "sma_5": mean(close, 5), "sma_10": sma, "ema_7": ema(close, 7)[-1], "ema_11": ema(close, 11)[-1],
        "macd_line": line[-1], "macd_signal": ema(line, 9)[-1], "atr_14": mean(ranges, 14),
        "momentum": over(minus(close[-1], sma), sma),
        "bb_upper": None if sd is None else mid + 2 * sd, "bb_lower": None if sd is None else mid - 2 * sd,
        "vma_10": vma, "volume_ratio": over(rows[-1]["volume"], vma),
        "rsi_14": None if rs is None else 100 - 100 / (1 + rs),
        "price_change": steps[-1],
        "price_change_pct": None if change is None else 100 * change,
    }


def _close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def test_enrich_matches_pandas(spark):
    bars = fx.bars_hourly(spark, SF001).filter("symbol in ('click', 'view')")
    got = ind.enrich(bars).orderBy("symbol", "ts").toPandas()
    pdf = bars.orderBy("symbol", "ts").toPandas()
    for sym, g in pdf.groupby("symbol"):
        g = g.reset_index(drop=True)
        mine = got[got.symbol == sym].reset_index(drop=True)
        for r in range(len(g)):
            want = window_indicators(g.iloc[max(0, r - 59): r + 1])
            for k, x in want.items():
                y = mine.loc[r, k]
                y = None if pd.isna(y) else float(y)
                assert _close(x, y), (sym, r, k, x, y)


def _bars(spark, closes, volumes=None, symbol="T"):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i, c in enumerate(closes):
        ts = t0 + dt.timedelta(hours=i)
        v = 1000.0 if volumes is None else volumes[i]
        hi = None if c is None else c + 1.0
        lo = None if c is None else c - 1.0
        rows.append((symbol, ts, c, hi, lo, c, v, ts.strftime("%Y%m%d"), ts.strftime("%H:%M")))
    return spark.createDataFrame(rows, BAR_SCHEMA)


@pytest.mark.parametrize("n,emitted", [(59, 0), (60, 26), (93, 59)])
def test_warm_up_gate(spark, n, emitted):
    closes = [100 + math.sin(i / 3.0) * 5 for i in range(n)]
    assert ind.warm_rows(ind.enrich(_bars(spark, closes))).count() == emitted


def test_signal_readiness_starts_at_94(spark):
    closes = [100 + math.sin(i / 3.0) * 5 + i * 0.1 for i in range(100)]
    sig = flows.signals(_bars(spark, closes), chunk_rows=None)
    assert sorted(r[0] for r in sig.select("ts").collect())[0] == dt.datetime(2024, 1, 1) + dt.timedelta(hours=93)
    assert sig.count() == 7
    for c in sg.SIGNAL_COLS:
        assert sig.filter(f"{c} < -1 or {c} > 1").count() == 0


def test_constant_price_and_zero_volume(spark):
    df = ind.enrich(_bars(spark, [50.0] * 70, volumes=[0.0] * 70)).filter("rn = 70").first()
    assert df["rsi_14"] is None             # zero average loss
    assert df["volume_ratio"] is None       # zero average volume
    assert df["bb_upper"] == pytest.approx(50.0) and df["bb_lower"] == pytest.approx(50.0)
    assert df["macd_line"] == pytest.approx(0.0)


def test_null_close_in_the_middle(spark):
    closes = [100.0 + (i % 7) for i in range(80)]
    closes[65] = None
    got = ind.enrich(_bars(spark, closes)).orderBy("ts").toPandas()
    pdf = pd.DataFrame({"close": closes, "high": [None if c is None else c + 1 for c in closes],
                        "low": [None if c is None else c - 1 for c in closes], "volume": [1000.0] * 80}, dtype="float64")
    for r in (65, 66, 70, 79):
        want = window_indicators(pdf.iloc[max(0, r - 59): r + 1])
        for k in ("sma_5", "ema_7", "ema_11", "macd_line", "macd_signal", "atr_14", "rsi_14", "price_change_pct"):
            y = got.loc[r, k]
            assert _close(want[k], None if pd.isna(y) else float(y)), (r, k, want[k], y)


def test_equal_timestamps_are_kept(spark):
    b = _bars(spark, [100.0 + i for i in range(65)])
    dup = b.filter("ts = timestamp_ntz'2024-01-01 10:00:00'").withColumn("close", b["close"] + 0.5)
    out = ind.enrich(b.unionByName(dup))
    assert out.count() == 66
    assert out.select("rn").distinct().count() == 66
