"""Aggregations, set operations, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rows_per_symbol(df: DataFrame) -> DataFrame:
    """G1: batch size per symbol."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


def symbol_set(df: DataFrame) -> DataFrame:
    """Exact distinct symbol count and the sorted list (one row; the list is bounded by the symbols)."""
    return df.agg(F.count_distinct("symbol").alias("symbols"), F.sort_array(F.collect_set("symbol")).alias("symbol_list"))


def date_range(df: DataFrame, col: str = "ts") -> DataFrame:
    """First and last time."""
    return df.agg(F.min(col).alias("first_ts"), F.max(col).alias("last_ts"), F.count(F.lit(1)).alias("rows"))


def count_in_range(df: DataFrame, start, end, by: str = "symbol", col: str = "ts") -> DataFrame:
    """Rows per ``by`` with ``start <= ts < end`` (post-write verification; rows, not fields)."""
    t = F.col(col)
    return df.filter((t >= F.lit(start)) & (t < F.lit(end))).groupBy(by).agg(F.count(F.lit(1)).alias("rows"))


def first_record(df: DataFrame, col: str = "ts") -> DataFrame:
    """Earliest record over all time and the all-time count."""
    order = F.struct(col, *[c for c in df.columns if c != col])  # ties by the other columns
    return df.agg(F.min_by(F.struct(*df.columns), order).alias("first"), F.count(F.lit(1)).alias("rows")).select("first.*", "rows")


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def rows_missing_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose keys are absent from ``right`` (anti join)."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """Global top-k (the limit is the feature)."""
    return df.orderBy(*order).limit(k)


def tail_per_symbol(df: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows per symbol by time (bounded trim).

    A rank limit: every task keeps its ``n`` newest rows per symbol before the
    shuffle, so a hot symbol does not reach one task whole.
    """
    if "rn" in df.columns and "n_sym" in df.columns:
        return df.filter(F.col("rn") > F.col("n_sym") - F.lit(n))
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"), *[F.desc(c) for c in df.columns if c not in ("symbol", "ts")])
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def keep_last(arr: str, n: int):
    """I7 on arrays: the last ``n`` elements."""
    return F.slice(F.col(arr), F.greatest(F.size(arr) - F.lit(n - 1), F.lit(1)), F.lit(n))
