"""Structured Streaming entry point: messages -> bars -> indicators -> signals -> sinks.

The count window of the reference (newest 60 rows per symbol, warm-up, rows
35-60 released at once) is Spark state keyed by symbol
(:mod:`tickwise.streaming.history`).  It hands a micro-batch the rows its
frames need, numbered by arrival, and the *same* batch operators
(:func:`tickwise.operators.indicators.enrich`,
:func:`tickwise.operators.signals.signal_table`) run over them, so a stream
gives exactly the batch result (K2, K4) and a late bar the result of its place
in the arrival order (K7).

One micro-batch feeds every sink (K6), each under its batch id, so a batch that
is delivered twice leaves the tables as they were.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tickwise.operators import indicators as ind
from tickwise.operators import signals as sg
from tickwise.operators.clean import normalize_bars
from tickwise.operators.series import SeriesSpec
from tickwise.session import configure, ensure_checkpoint_dir, shared_path
from tickwise.sources import ingest as ig
from tickwise.sources import sinks as sk
from tickwise.streaming.history import KEEP_ROWS, with_history

#: windows of a stream run over arrival numbers
ARRIVED = SeriesSpec(part=("symbol",), order=("rn",))
PARTITIONS = "spark.sql.shuffle.partitions"
SINKS = ("enriched", "signals", "latest_bar", "latest_signal", "audit", "bar_points", "signal_points", "bars")


@dataclass
class BarSinks:
    """``foreachBatch`` function over the rows of :func:`with_history`: enrich, score, and write every sink of ``sinks``.

    * ``enriched/batch_id=N``: rows that the warm-up gate releases; ``signals/batch_id=N``
    * ``latest_bar`` and ``latest_signal``: keyed tables (B1), one row per symbol
    * ``audit/batch_id=N``: JSON lines of the batch's bars (B6)
    * ``bar_points``, ``signal_points``: time-series points by batch, measurement and day (B2, B3)
    * ``bars/batch_id=N``: columnar bars clustered by symbol and arrival (B4); the signal table is the columnar one of B5
    """

    root: str
    sinks: tuple[str, ...] = ("enriched", "signals", "latest_signal")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        configure(batch.sparkSession)
        at = lambda name: f"{self.root}/{name}/batch_id={batch_id}"
        rows = batch.withColumn("n_sym", F.max("rn").over(ARRIVED.whole())).persist()
        try:
            self.write_bars(rows.filter("is_new"), batch_id)
            # all frames of a released or new row lie inside the kept rows; a series' first kept row is not its first row
            base = ind.enrich(rows, ARRIVED, with_ema=False)
            if "enriched" in self.sinks:
                enriched = ind.ema_macd(base, ARRIVED)
                for c in ("ema_7", "ema_11", "macd_line", "macd_signal"):
                    enriched = enriched.withColumn(c, F.when(F.isnan(c), None).otherwise(F.col(c)))
                out = enriched.filter(F.col("is_enriched") & ~F.col("released"))
                out.select(*ind.BAR_COLS, *ind.INDICATOR_COLS, "rn", "is_enriched").write.mode("overwrite").parquet(at("enriched"))
            if "signals" in self.sinks:
                scored = sg.signal_table(base, ARRIVED, extra=("rn", "is_new")).filter("is_new").drop("is_new")
                scored.write.mode("overwrite").parquet(at("signals"))
                self.write_signals(batch.sparkSession.read.schema(scored.schema).parquet(at("signals")), batch_id)
        finally:
            rows.unpersist()

    def write_bars(self, new: DataFrame, batch_id: int) -> None:
        bars = new.select(*ind.BAR_COLS, "partition", "offset", "source_ts", "rn")
        if "latest_bar" in self.sinks:
            sk.upsert_latest(bars, f"{self.root}/latest_bar", batch_id, order=("rn",))
        if "audit" in self.sinks:
            sk.write_batch(sk.to_audit_json(bars, batch_id, extra=["rn"]), f"{self.root}/audit", batch_id, fmt="text")
        if "bar_points" in self.sinks:
            sk.append_points(bars.drop("rn"), f"{self.root}/bar_points", "market_data", batch_id=batch_id)
        if "bars" in self.sinks:
            sk.append_columnar(bars, f"{self.root}/bars", batch_id=batch_id)

    def write_signals(self, scored: DataFrame, batch_id: int) -> None:
        if "latest_signal" in self.sinks:
            sk.upsert_latest(scored, f"{self.root}/latest_signal", batch_id, order=("rn",))
        if "signal_points" in self.sinks:
            sk.append_points(scored.drop("rn"), f"{self.root}/signal_points", "trading_signals", tags=("symbol", "regime"), batch_id=batch_id)


def bars_from_messages(spark: SparkSession, source: str, fmt: str = "parquet", max_per_trigger: int = 1000,
                       watermark: str | None = None, dedupe: bool = False, schema: str | None = None) -> DataFrame:
    """A1 -> A2 -> A3 -> C1 (+ K9) as a streaming frame of BAR rows.

    ``dedupe`` drops a message that is delivered again within ``watermark`` of
    broker time (K9).  The watermark is on the broker's time, not the bar's: a
    late bar is no late message and stays (K7).
    """
    msgs = ig.decode_messages(ig.read_messages(spark, source, fmt, max_per_trigger, schema=schema))
    if dedupe:
        if not watermark:
            raise ValueError("duplicate removal needs a watermark to bound its state")
        msgs = msgs.withColumn("_broker", F.col("source_ts").cast("timestamp")).withWatermark("_broker", watermark)
        msgs = msgs.dropDuplicatesWithinWatermark(["partition", "offset"]).drop("_broker")
    return normalize_bars(ig.explode_bars(msgs).filter(F.col("ts").isNotNull()))


def start(bars_stream: DataFrame, root: str | None = None, trigger: dict | None = None,
          sinks: tuple[str, ...] = ("enriched", "signals", "latest_signal"), keep: int = KEEP_ROWS,
          state_partitions: int | None = None):
    """K1 + K6: run :class:`BarSinks` over the keyed history, with a checkpoint on shared storage.

    ``trigger`` defaults to the reference's 500 ms processing-time trigger; pass
    ``{"availableNow": True}`` to take what is there and end.  A query started
    again on the same ``root`` goes on where the last one ended.  The state is
    dealt to ``state_partitions`` (default: the session's shuffle partitions),
    for as long as the checkpoint lives.
    """
    unknown = set(sinks) - set(SINKS)
    if unknown:
        raise ValueError(f"unknown sinks: {sorted(unknown)}")
    spark = bars_stream.sparkSession
    ensure_checkpoint_dir(spark)
    root = root or shared_path(spark, "bar-stream")
    w = with_history(bars_stream, keep).writeStream.foreachBatch(BarSinks(root, sinks))
    w = w.option("checkpointLocation", f"{root}/_checkpoint").trigger(**(trigger or {"processingTime": "500 milliseconds"}))
    session = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(state_partitions or session))    # a query takes the settings of its start
    try:
        return w.start()
    finally:
        spark.conf.set(PARTITIONS, session)


class ProgressTotals(StreamingQueryListener):
    """Exact batches, rows and seconds of every query since the listener was added (``spark.streams.addListener``)."""

    def __init__(self) -> None:
        self.batches, self.rows, self.seconds = 0, 0, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.seconds += (p.durationMs or {}).get("triggerExecution", 0) / 1000.0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def stats(self) -> dict:
        return {"batches": self.batches, "rows": self.rows, "seconds": self.seconds,
                "rows_per_s": self.rows / self.seconds if self.seconds else None}


@dataclass
class Rebalancer:
    """K5 + B12 + B13: one rebalancing cycle per trigger, from stored state.

    A ``foreachBatch`` function over a stream of signals (trigger: the cycle's
    period).  State ``v=N`` (portfolios with positions, score history, newest
    signals) is written from ``v=N-1`` and the batch alone, and ``pending``
    holds the orders of the last cycle only, so a batch delivered again changes
    nothing.  A batch's cycle is the first multiple of ``period_s`` at or after
    its newest signal.
    """

    root: str
    period_s: int = 300
    max_age_s: int = 60
    initial_capital: float = 10_000_000.0

    def begin(self, portfolios: DataFrame, positions: DataFrame) -> None:
        """Store the portfolios that the first cycle starts from."""
        history = portfolios.sparkSession.createDataFrame([], "symbol string, signal_history array<double>, price double")
        sk.save_state(portfolios, positions, history, f"{self.root}/v=-1", 0)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from tickwise.operators import portfolio as pf

        spark = batch.sparkSession
        configure(spark)
        state = sk.load_state(spark, f"{self.root}/v={batch_id - 1}", self.initial_capital)
        keep = ["symbol", "ts", "close", "atr_14", "marker_final_score", "regime", "regime_confidence", "volume"]
        sk.upsert_latest(batch.select(*keep), f"{self.root}/latest", batch_id, order=("ts",))
        latest = spark.read.parquet(f"{self.root}/latest/v={batch_id}")
        period = self.period_s * 1_000_000
        newest = batch.agg(F.max(pf.epoch_micros("ts"))).first()[0]
        if newest is None:     # no signals, no cycle: the state goes on
            done = {"portfolios": state["portfolios"], "history": state["history"]}
            cycle = state["portfolios"].agg(F.max("cycle")).first()[0]
        else:
            cycle_ts = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=-(-newest // period) * period)
            cycle = state["portfolios"].agg(F.max("cycle")).first()[0] + 1
            done = pf.next_cycle(state["portfolios"].drop("cycle"), state["positions"], state["history"], latest, cycle, cycle_ts, self.max_age_s)
            sk.replace_pending(done["orders"], f"{self.root}/pending")
        sk.save_state(done["portfolios"], state["positions"], done["history"], f"{self.root}/v={batch_id}", cycle)
