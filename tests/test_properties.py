"""Properties on generated price paths."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickwise.operators import indicators as ind
from tickwise.operators import signals as sg
from tickwise.plans import flows

BAR_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, date string, time string"


def _bars(spark, steps, vols):
    t0, price, rows = dt.datetime(2024, 1, 1), 100.0, []
    for i, (s, v) in enumerate(zip(steps, vols)):
        price = max(1.0, price * (1.0 + s))
        ts = t0 + dt.timedelta(hours=i)
        rows.append(("P", ts, price, price * 1.01, price * 0.99, price, float(v), ts.strftime("%Y%m%d"), ts.strftime("%H:%M")))
    return spark.createDataFrame(rows, BAR_SCHEMA)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.tuples(st.lists(st.floats(-0.05, 0.05), min_size=120, max_size=120),
                 st.lists(st.integers(0, 5000), min_size=120, max_size=120)))
def test_indicator_and_signal_bounds(spark, data):
    steps, vols = data
    bars = _bars(spark, steps, vols)
    enr = ind.enrich(bars)
    assert enr.filter("rsi_14 < 0 or rsi_14 > 100").count() == 0
    assert enr.filter("bb_upper < bb_lower").count() == 0
    assert enr.filter("rn >= 26 and macd_line is null").count() == 0
    sig = flows.signals(bars, chunk_rows=None)
    for c in sg.SIGNAL_COLS:
        assert sig.filter(f"{c} < -1 or {c} > 1").count() == 0
    assert sig.filter("marker_final_score < 0 or marker_final_score > 2").count() == 0
    assert sig.filter("regime not in ('EXPLOSIVE', 'TRENDING', 'NEUTRAL', 'MEAN_REVERSION')").count() == 0
