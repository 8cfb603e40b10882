"""L1-L8 properties: disjoint complete splits, train-only scaling, sequence counts, chunked parity."""

from pyspark.sql import functions as F

from tests.conftest import SF001
from tickwise.operators import ml
from tickwise.sources import fixtures as fx


def test_prepare_properties(spark):
    prep = ml.prepare(fx.bars_hourly(spark, SF001))
    split = prep["split"]
    n_clean = prep["clean"].count()
    assert split.count() == n_clean
    assert split.select("symbol", "ts").distinct().count() == n_clean          # disjoint and complete
    train = prep["scaled"].filter("split = 'train'")
    stats = train.groupBy("symbol").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("s")).collect()
    for r in stats:
        assert abs(r.m) < 1e-9 and abs(r.s - 1.0) < 1e-9                       # fitted on train only
    val = prep["scaled"].filter("split = 'val'").agg(F.avg("close")).first()[0]
    assert abs(val) > 1e-6                                                     # val did not shape the scaler
    sizes = split.groupBy("symbol", "split").count().collect()
    expected = sum(max(0, r["count"] - ml.LOOKBACK) for r in sizes)
    seqs = prep["sequences"]
    assert seqs.count() == expected
    assert seqs.filter(F.size("X") != ml.LOOKBACK).count() == 0


def test_ml_features_chunked_equal_plain(spark):
    bars = fx.bars_hourly(spark, SF001)
    cols = ["symbol", "ts"] + ml.FEATURES + ["target"]
    a, la = ml.ml_features(bars, chunk_rows=None)
    b, lb = ml.ml_features(bars, chunk_rows=600, force_chunks=True)
    ra = sorted(tuple(x) for x in la.own(a).select(*cols).collect())
    rb = sorted(tuple(x) for x in lb.own(b).select(*cols).collect())
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if isinstance(u, float):
                assert abs(u - v) <= 1e-9 * max(1.0, abs(u))
            else:
                assert u == v


def _gap_bars(spark):
    """One symbol, 2,400 bars, closes null in rows 0-2, 700-1499 and 2100-2110."""
    close = F.lit(100.0) + F.sin(F.col("id") / 7.0) * 5 + F.col("id") % 13
    gone = "id < 3 OR id BETWEEN 700 AND 1499 OR id BETWEEN 2100 AND 2110"
    return spark.range(2400).select(
        F.lit("a").alias("symbol"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("ts"),
        (close - 0.5).alias("open"), (close + 1).alias("high"), (close - 1).alias("low"),
        F.when(~F.expr(gone), close).alias("close"), (F.lit(1000.0) + F.col("id") % 17).alias("volume"))


def test_chunks_carry_state_over_long_gaps(spark):
    bars = _gap_bars(spark)
    cols = ["symbol", "ts"] + ml.FEATURES + ["target"]
    for rows in (700, 100):
        for method in (None, "fill"):
            got = []
            for chunk_rows in (None, rows):
                f, lay = ml.ml_features(bars, chunk_rows=chunk_rows, force_chunks=chunk_rows is not None)
                f = ml.clean_features(f, method, lay.spec) if method else f
                got.append([tuple(r) for r in lay.own(f).select(*cols).orderBy("ts").collect()])
            assert len(got[0]) == len(got[1])
            for x, y in zip(*got):
                for u, v in zip(x, y):
                    assert u == v or (isinstance(u, float) and v is not None and abs(u - v) <= 1e-9 * max(1.0, abs(u))), (rows, method, x[1])


def test_scoring_and_metrics(spark):
    prep = ml.prepare(fx.bars_hourly(spark, SF001))
    seqs = prep["sequences"].filter("split = 'train'")   # sf0.001 test splits are shorter than 60 rows
    scored = ml.score(seqs, ml.naive_last_change_model(ml.FEATURES.index("close")))
    assert scored.filter(F.col("prediction").isNull()).count() == 0
    m = ml.regression_metrics(scored).first()
    assert m.mse >= 0 and abs(m.rmse - m.mse ** 0.5) < 1e-12
    h = ml.error_histogram(ml.sample_errors(scored))
    assert h.agg(F.sum("count")).first()[0] == scored.count()
    assert h.agg(F.max("bin")).first()[0] <= 49
