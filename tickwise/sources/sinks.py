"""Sinks: append tables, keyed upserts, audit JSON, state save/load.

Servers of the reference (key-value, time-series, columnar) become tables on
shared storage: time-series points are appended partitioned by measurement
and date, the columnar table is clustered by (symbol, ts), keyed "latest"
tables are rewritten as new versions (no in-place update).  Writers inside
``foreachBatch`` are idempotent by batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.operators.indicators import BAR_COLS


def latest_per_symbol(df: DataFrame, order=("ts", "partition", "offset")) -> DataFrame:
    """Newest row per symbol; ties on time go to the later arrival."""
    cols = [c for c in df.columns if c != "symbol"]
    key = F.struct(*[F.col(c) for c in order if c in df.columns])
    return df.groupBy("symbol").agg(F.max_by(F.struct(*cols), key).alias("_r")).select("symbol", "_r.*")


def upsert_latest(batch: DataFrame, path: str, batch_id: int, order=("ts", "partition", "offset")) -> str:
    """B1 inside ``foreachBatch``: merge a batch into the latest-per-symbol table.

    Version ``v=batch_id`` is written from version ``batch_id-1`` plus the
    batch, so a retried batch rewrites the same version (idempotent).  The
    table has one row per symbol; the last two versions are kept.
    """
    spark = batch.sparkSession
    prev = _read_version(spark, path, batch_id - 1)
    merged = batch if prev is None else prev.unionByName(batch, allowMissingColumns=True)
    out = f"{path}/v={batch_id}"
    latest_per_symbol(merged, order).write.mode("overwrite").parquet(out)
    if batch_id > 1:
        old, fs = _folder(spark, f"{path}/v={batch_id - 2}")
        fs.delete(old, True)
    return out


def _folder(spark: SparkSession, path: str):
    """The path and the file system that holds it."""
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hp, hp.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_version(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    if version < 0:
        return None
    hp, fs = _folder(spark, f"{path}/v={version}")
    if not fs.exists(hp):
        raise FileNotFoundError(f"version {version} of {path} is lost; the table cannot go on from it")
    return spark.read.parquet(f"{path}/v={version}")


def write_batch(df: DataFrame, path: str, batch_id: int | None, fmt: str = "parquet", parts: tuple[str, ...] = ()) -> None:
    """Append ``df``; as batch ``batch_id`` under its own folder, which a batch delivered again replaces."""
    w = df.write.mode("append" if batch_id is None else "overwrite").format(fmt).partitionBy(*parts)
    w.save(path if batch_id is None else f"{path}/batch_id={batch_id}")


def append_points(df: DataFrame, path: str, measurement: str, tags=("symbol",), fields=None, batch_id: int | None = None) -> None:
    """Append time-series points partitioned by measurement and date, by batch inside ``foreachBatch``."""
    fields = fields or [c for c in df.columns if c not in tags and c not in ("ts", "date", "time")]
    out = df.select(F.lit(measurement).alias("measurement"), *tags, "ts", *fields,
                    F.date_format("ts", "yyyy-MM-dd").alias("day"))
    write_batch(out, path, batch_id, parts=("measurement", "day"))


def append_columnar(df: DataFrame, path: str, fallback_ts: str | None = None, batch_id: int | None = None) -> None:
    """Append clustered by (symbol, ts) with an ingest-time column, by batch inside ``foreachBatch``.

    ``fallback_ts`` fills a missing event time (signals fall back to their
    update time).  Rows are dealt by symbol and day: a symbol that holds most
    rows is not one task.
    """
    if fallback_ts and fallback_ts in df.columns:
        df = df.withColumn("ts", F.coalesce(F.col("ts"), F.col(fallback_ts)))
    out = df.withColumn("inserted_at", F.current_timestamp())
    write_batch(out.repartition("symbol", F.to_date("ts")).sortWithinPartitions("symbol", "ts"), path, batch_id)


def to_audit_json(df: DataFrame, batch_id: int, extra: list[str] | None = None) -> DataFrame:
    """B6 (+C4): one JSON line per bar: ``data`` (base fields + extras), ``kafka_metadata``, batch id, processed time."""
    base = [c for c in BAR_COLS if c in df.columns]
    extra = extra if extra is not None else extra_fields(df)
    meta = [c for c in ("partition", "offset", "source_ts") if c in df.columns]
    return df.select(F.to_json(F.struct(
        F.struct(*base, *extra).alias("data"),
        F.struct(*meta).alias("kafka_metadata"),
        F.lit(batch_id).alias("batch_id"),
        F.current_timestamp().alias("processed_at"),
    )).alias("value"))


def extra_fields(df: DataFrame) -> list[str]:
    """C4: columns beyond the base bar and source fields (plan-time list difference)."""
    known = set(BAR_COLS) | {"partition", "offset", "source_ts", "doc_ts"}
    return [c for c in df.columns if c not in known]


def write_stats(df: DataFrame, required=("open", "high", "low", "close", "volume")) -> DataFrame:
    """Accepted / rejected rows (null required number or bad time), distinct symbols, success rate."""
    ok = F.col("ts").isNotNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return df.agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"),
        F.count_distinct("symbol").alias("symbols"),
    ).withColumn("success_pct", F.when(F.col("accepted") + F.col("rejected") > 0,
                                       F.col("accepted") / (F.col("accepted") + F.col("rejected")) * 100.0).otherwise(0.0))


def write_symbol_tables(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One table partitioned by symbol, fixed column order, snappy."""
    cols = ["symbol"] + [c for c in BAR_COLS if c != "symbol" and c in df.columns]
    w = df.select(*cols).repartition("symbol", F.date_trunc("month", "ts")).write.mode("overwrite").partitionBy("symbol")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.option("compression", "snappy").parquet(path)


def write_sequences(seqs: DataFrame, path: str) -> None:
    """Sequences per split (``split=train|val|test`` folders)."""
    seqs.select("symbol", "split", "ts", "X", "y").write.mode("overwrite").partitionBy("split").parquet(path)


def save_scalers(scalers: DataFrame, path: str) -> None:
    """Scaler long table (replaces the pickle)."""
    scalers.write.mode("overwrite").parquet(path)


def load_scalers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_pending(orders: DataFrame, path: str) -> None:
    """Pending orders are replaced as a whole each cycle."""
    orders.write.mode("overwrite").parquet(path)


#: a position as it is stored with its portfolio
POSITION = "array<struct<symbol: string, shares: long, avg_price: double, last_action_signal: double>>"


def portfolio_state(portfolios: DataFrame, positions: DataFrame, cycle: int) -> DataFrame:
    """B13 save form: one row per portfolio with its cash, counters and its own positions as JSON."""
    own = positions.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "shares", "avg_price", "last_action_signal"))).alias("positions"))
    out = portfolios.join(own, "portfolio_id", "left")
    return out.select("portfolio_id", "cash", F.coalesce("trades_used", F.lit(0)).cast("long").alias("trades_used"), F.lit(cycle).cast("long").alias("cycle"),
                      F.to_json(F.coalesce("positions", F.array().cast(POSITION))).alias("positions"))


def save_state(portfolios: DataFrame, positions: DataFrame, history: DataFrame, path: str, cycle: int) -> None:
    """The portfolios with their positions, and the symbols' score history as a table of its own."""
    portfolio_state(portfolios, positions, cycle).write.mode("overwrite").parquet(f"{path}/portfolios")
    history.write.mode("overwrite").parquet(f"{path}/history")


def load_state(spark: SparkSession, path: str, initial_capital: float = 10_000_000.0) -> dict[str, DataFrame]:
    """B13 load: the stored ``portfolios``, ``positions`` (parsed) and ``history``; without a store one portfolio with the initial capital."""
    hp, fs = _folder(spark, f"{path}/portfolios")
    if fs.exists(hp):
        stored, history = spark.read.parquet(f"{path}/portfolios"), spark.read.parquet(f"{path}/history")
    else:
        stored = spark.createDataFrame([(0, float(initial_capital), 0, 0, "[]")], "portfolio_id long, cash double, trades_used long, cycle long, positions string")
        history = spark.createDataFrame([], "symbol string, signal_history array<double>, price double")
    positions = stored.select("portfolio_id", F.explode(F.from_json("positions", POSITION)).alias("p")).select("portfolio_id", "p.*")
    return {"portfolios": stored.drop("positions"), "positions": positions, "history": history}
