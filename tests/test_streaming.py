"""K1-K9: a drained stream gives exactly the batch tables (stream/batch parity)."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tickwise.operators import indicators as ind
from tickwise.operators import signals as sg
from tickwise.plans import catalog, flows
from tickwise.sources import fixtures as fx
from tickwise.sources import ingest as ig
from tickwise.streaming import engine


def _rows(df, cols):
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.select(*cols).dtypes]
    return sorted(tuple(r) for r in df.select(*rounded).collect())


def run(spark, root, sinks=("enriched", "signals", "latest_signal"), per_trigger=1000, **how):
    stream = engine.bars_from_messages(spark, f"{root}/messages", max_per_trigger=per_trigger, schema=catalog.MSG_SCHEMA, **how)
    engine.start(stream, f"{root}/out", {"availableNow": True}, sinks, state_partitions=4).awaitTermination(600)


def messages(spark):
    bars = fx.bars_hourly(spark, SF001)
    return bars, catalog.arrived(ig.to_messages(ig.documents_wide(bars)), catalog.message_number())


ENRICHED = ["symbol", "ts", "rn", *ind.INDICATOR_COLS]


def test_many_triggers_match_batch(spark, tmp_dir):
    """Six triggers, the replay slowed down so that the files come in order; state goes from batch to batch."""
    bars, msgs = messages(spark)
    for k in range(6):
        msgs.filter(F.floor(catalog.message_number() / 31) == k).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/messages")
        time.sleep(1.1)
    totals = engine.ProgressTotals()
    spark.streams.addListener(totals)
    run(spark, tmp_dir, per_trigger=1)
    want_rows = spark.read.parquet(f"{tmp_dir}/messages").count()
    for _ in range(50):  # events arrive a little later
        if totals.rows >= want_rows:
            break
        time.sleep(0.2)
    spark.streams.removeListener(totals)
    assert totals.stats()["rows"] >= want_rows and totals.batches >= 6

    want = ind.warm_rows(flows.enriched_bars(bars, chunk_rows=None))
    assert _rows(spark.read.parquet(f"{tmp_dir}/out/enriched"), ENRICHED) == _rows(want, ENRICHED)
    signals = flows.signals(bars, chunk_rows=None)
    assert _rows(spark.read.parquet(f"{tmp_dir}/out/signals"), sg.SIGNAL_OUT) == _rows(signals, sg.SIGNAL_OUT)
    # B1: the latest-signal table after the last batch holds one row per symbol, and only two versions are kept
    latest = spark.read.parquet(f"{tmp_dir}/out/latest_signal")
    last = latest.agg(F.max("v")).first()[0]
    assert {r["v"] for r in latest.select("v").distinct().collect()} == {last, last - 1}
    want = _rows(sg.latest_signal(signals), sg.SIGNAL_OUT)
    assert _rows(latest.where(F.col("v") == last), sg.SIGNAL_OUT) == want


def test_lost_state_is_an_error(spark, tmp_dir):
    _, msgs = messages(spark)
    msgs.where(catalog.message_number() < 30).write.mode("append").parquet(f"{tmp_dir}/messages")
    run(spark, tmp_dir, ("enriched",))
    shutil.rmtree(f"{tmp_dir}/out/_checkpoint/state")
    msgs.where(catalog.message_number() >= 30).write.mode("append").parquet(f"{tmp_dir}/messages")
    with pytest.raises(Exception, match="(?i)state"):
        run(spark, tmp_dir, ("enriched",))
    assert spark.read.parquet(f"{tmp_dir}/out/enriched").count() == 0


def test_batch_delivered_twice_leaves_the_tables(spark, tmp_dir):
    """K6: every sink replaces the batch that it gets again."""
    bars, _ = messages(spark)
    kept = bars.withColumn("rn", F.row_number().over(engine.SeriesSpec().base()).cast("long")).withColumns(
        {"partition": F.lit(0), "offset": F.col("rn"), "source_ts": F.col("ts"), "released": F.lit(False), "is_new": F.lit(True)})
    proc = engine.BarSinks(f"{tmp_dir}/out", engine.SINKS)
    proc(kept.where("rn <= 100"), 0)
    second = kept.where("rn <= 130").withColumn("is_new", F.col("rn") > 100).withColumn("released", (F.col("rn") <= 100) & (F.col("rn") >= 35))
    proc(second, 1)
    before = sorted(tuple(r) for r in catalog.sink_rows(spark, f"{tmp_dir}/out").collect())
    proc(second, 1)
    assert sorted(tuple(r) for r in catalog.sink_rows(spark, f"{tmp_dir}/out").collect()) == before
    counts = {s: sum(r[0] == s for r in before) for s in engine.SINKS}
    n = kept.where("rn <= 130").count()
    assert counts["bars"] == counts["audit"] == counts["bar_points"] == n and counts["latest_bar"] == 5
    assert counts["signal_points"] == counts["signals"] > 0


def test_arrival_numbers_late_and_repeated_bars(spark, tmp_dir):
    """K3 + K7 + K9: the order is the broker's, a repeated message counts once, a row without a time is left out."""
    rows = [(f"2024-01-01T00:00:{i:02d}", f'{{"timestamp": "x", "A.csv": {{"Type": "A", "Date": 20240101, "Time": "{t}", "close": {i}}}}}', 0, i, f"2024-01-01 00:00:{i:02d}")
            for i, t in enumerate(["09:00", "09:01", "09:05", "09:02", "09:03", "bad"])]
    df = spark.createDataFrame(rows + rows[1:3], "key string, value string, partition int, offset long, t string")
    df.select("key", "value", "partition", "offset", F.col("t").cast("timestamp_ntz").alias("timestamp")).repartition(3).write.parquet(f"{tmp_dir}/messages")
    with pytest.raises(ValueError, match="watermark"):
        engine.bars_from_messages(spark, f"{tmp_dir}/messages", schema=catalog.MSG_SCHEMA, dedupe=True)
    run(spark, tmp_dir, ("bars", "latest_bar"), dedupe=True, watermark="1 minute")
    got = spark.read.parquet(f"{tmp_dir}/out/bars").orderBy("rn").select("rn", "time", "close").collect()
    assert [tuple(r) for r in got] == [(1, "09:00", 0.0), (2, "09:01", 1.0), (3, "09:05", 2.0), (4, "09:02", 3.0), (5, "09:03", 4.0)]
    latest = spark.read.parquet(f"{tmp_dir}/out/latest_bar")
    assert [r["time"] for r in latest.where(F.col("v") == latest.agg(F.max("v")).first()[0]).collect()] == ["09:03"]
