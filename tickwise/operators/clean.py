"""Record cleaning and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: largest limit that Spark applies before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold)
RANK_LIMIT = 1000


def normalize_bars(df: DataFrame) -> DataFrame:
    """Null text -> '', null partition / offset -> 0, null source time -> now."""
    out = df
    for c in ("symbol", "date", "time"):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    if "partition" in out.columns:
        out = out.withColumn("partition", F.coalesce(F.col("partition"), F.lit(0)).cast("int"))
    if "offset" in out.columns:
        out = out.withColumn("offset", F.coalesce(F.col("offset"), F.lit(0)).cast("long"))
    if "source_ts" in out.columns:
        out = out.withColumn("source_ts", F.coalesce(F.col("source_ts"), F.current_timestamp()))
    return out


def parse_ts(col) -> Column:
    """ISO timestamp with a space or a 'T', optional fraction; invalid -> null (never throws)."""
    c = F.regexp_replace(F.col(col) if isinstance(col, str) else col, "T", " ")
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm")),
    ).cast("timestamp_ntz")


def head_per_symbol(df: DataFrame, n: int = 52_000) -> DataFrame:
    """First ``n`` rows of each symbol by time, then by all other columns (a feature of the document build, not a work cap).

    For small ``n`` a rank limit: every task keeps its first ``n`` rows per
    symbol before the shuffle.  Beyond, row numbers in the same order come from
    the series layout, so a symbol holding most rows is not ranked in one task.
    """
    from tickwise.operators import chunking

    if "rn" in df.columns:
        return df.filter(F.col("rn") <= n)
    if n <= RANK_LIMIT:
        oldest = Window.partitionBy("symbol").orderBy("ts", *chunking.tie_columns(df))
        return df.withColumn("_r", F.row_number().over(oldest)).filter(F.col("_r") <= n).drop("_r")
    # chunks of n rows: in the plain layout every symbol has at most n rows;
    # a filter on the global row number needs no halo rows
    lay = chunking.layout(df, max(n, 1), halo=0, ties=True)
    return lay.own(lay.numbered().filter(F.col("rn") <= n)).drop("rn", "n_sym")


def conform(df: DataFrame, cols: list[str]) -> DataFrame:
    """C14: reorder to ``cols``; missing columns are an error (checked at plan time)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*cols)


def profile(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Total rows, rows matching ``predicate`` and whether any match."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(p).alias("matching")).withColumn(
        "exists", F.col("matching") > 0
    )
