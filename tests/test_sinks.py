"""Write / read round trips on the shared checkpoint folder layout."""

import json

from pyspark.sql import functions as F

from tests.conftest import SF001
from tickwise.operators import ml
from tickwise.sources import fixtures as fx
from tickwise.sources import ingest as ig
from tickwise.sources import sinks as sk


def test_append_and_symbol_tables(spark, tmp_dir):
    bars = fx.bars_hourly(spark, SF001)
    sk.append_points(bars, f"{tmp_dir}/points", "ohlcv")
    pts = spark.read.parquet(f"{tmp_dir}/points")
    assert pts.count() == bars.count() and pts.select("measurement").distinct().count() == 1
    sk.append_columnar(bars, f"{tmp_dir}/col")
    assert spark.read.parquet(f"{tmp_dir}/col").filter(F.col("inserted_at").isNull()).count() == 0
    sk.write_symbol_tables(bars, f"{tmp_dir}/sym")
    assert ig.rows_per_file(spark, f"{tmp_dir}/sym").agg(F.sum("count")).first()[0] == bars.count()
    sk.write_symbol_tables(bars, f"{tmp_dir}/csv", fmt="csv")
    back = ig.load_bars(ig.read_bars_csv(spark, f"{tmp_dir}/csv/symbol=click").withColumn("Type", F.lit("click")))
    assert back.count() == bars.filter("symbol = 'click'").count()


def test_audit_json_and_stats(spark):
    bars = fx.bars_hourly(spark, SF001).withColumn("sma_5", F.lit(1.0))
    rows = sk.to_audit_json(bars, batch_id=7).limit(3).collect()
    doc = json.loads(rows[0][0])
    assert doc["batch_id"] == 7 and doc["data"]["sma_5"] == 1.0 and "symbol" in doc["data"]
    assert sk.extra_fields(bars) == ["sma_5"]


def test_sequences_scalers_and_state(spark, tmp_dir):
    prep = ml.prepare(fx.bars_hourly(spark, SF001))
    sk.write_sequences(prep["sequences"], f"{tmp_dir}/seq")
    seqs, meta = ig.read_sequences(spark, f"{tmp_dir}/seq")
    m = meta.first()
    assert (m.lookback, m.n_features) == (60, 21) and m.sequences == prep["sequences"].count()
    sk.save_scalers(prep["scalers"], f"{tmp_dir}/scalers")
    assert sk.load_scalers(spark, f"{tmp_dir}/scalers").count() == prep["scalers"].count()


def test_portfolio_state_round_trip(spark, tmp_dir):
    default = sk.load_state(spark, f"{tmp_dir}/nothing")
    assert default["portfolios"].first().cash == 10_000_000.0 and default["positions"].count() == default["history"].count() == 0
    ports, pos = fx.portfolios(spark, SF001), fx.positions(spark, SF001)
    hist = spark.createDataFrame([("click", [1.2, 1.3], 5.0)], "symbol string, signal_history array<double>, price double")
    sk.save_state(ports, pos, hist, f"{tmp_dir}/state", 4)
    got = sk.load_state(spark, f"{tmp_dir}/state")
    rows = lambda df, cols: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(got["positions"], pos.columns) == rows(pos.join(ports, "portfolio_id", "left_semi"), pos.columns)
    assert rows(got["portfolios"], ports.columns) == rows(ports, ports.columns)
    assert {r.cycle for r in got["portfolios"].collect()} == {4} and got["history"].first().signal_history == [1.2, 1.3]
