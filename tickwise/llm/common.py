"""Helpers shared by the training-data operators.

* ``table`` reads one table of a data folder with Spark's own reader.
* ``stash`` cuts lineage: the frame is written once as Parquet below
  ``spark.checkpoint.dir`` and read back, so a lost executor costs no replay.
* ``is_hot`` / ``hot_keys`` / ``salted_join`` join a skewed side to a side that is unique
  per key: keys with at least 1/200 of the rows (so at most 200 of them) get
  64 copies on the unique side and a hash salt of the row's other columns on
  the other, so a task that is run again deals its rows as before.
* ``text_slices`` cuts Arrow batches to a bounded number of text bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a key is hot from this share of the rows on; so there are at most SHARE hot keys
SHARE = 200
SALTS = 64
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickwise-"))
    return spark.sparkContext.getCheckpointDir()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def barrier(df: DataFrame) -> DataFrame:
    """The same rows; filters on them stay above.

    A filter that is pushed below a projection repeats its expressions, and an
    array expression inside a lambda would run once per element.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from; rows without an id never are."""
    return F.coalesce(fold_of(doc_id) != 1, F.lit(False))


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with at least 1/SHARE of the rows of ``df``: at most SHARE rows, safe to broadcast."""
    rows = df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= max(200, rows // SHARE)).select(*keys, F.lit(True).alias("_hot"))


def is_hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key has enough rows of ``df`` to be in :func:`hot_keys`."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.agg(F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    return (found["most"] or 0) >= max(200, (found["rows"] or 0) // SHARE)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, on: Column | None = None) -> DataFrame:
    """``many`` join ``one`` on ``keys`` and, if given, the condition ``on``; hot keys of ``many`` are salted.

    Without a hot key it is a plain join, whose plan is much smaller; ``hot`` are the hot keys, where they are known.
    Rows of ``one`` with a hot key are copied SALTS times, so it should have few of them.
    Rows of ``many`` that are equal in all columns share a salt, so they should differ in some.
    """
    salted = hot is not None or is_hot(many, keys)
    if not salted and on is None:
        return many.join(one, keys, how)
    rest = [c for c in many.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int") if rest else F.lit(0)
    left, right, at = many, one, keys
    if salted:
        hot = F.broadcast(hot_keys(many, keys) if hot is None else hot)
        left = (
            many.join(hot, keys, "left")
            .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0))
            .drop("_hot")
        )
        right = (
            one.join(hot, keys, "left")
            .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
            .drop("_hot")
        )
        at = [*keys, "_salt"]
    if on is None:
        return left.join(right, at, how).drop("_salt")
    right = right.select(*[F.col(c).alias(f"_r_{c}" if c in at else c) for c in right.columns])
    same = on
    for c in at:
        same = same & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(right, same, how).drop("_salt", "_r__salt", *[f"_r_{c}" for c in keys])


def text_slices(batches: Iterable[pa.RecordBatch], column: str, target: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in order, cut so that a slice holds about ``target`` bytes of ``column`` or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(sizes):
            if i > start and size + n > target:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)


def appended(df: DataFrame, added: list[tuple[str, pa.DataType, str]]):
    """Kept input columns and Spark's schema text when ``added`` columns replace input columns of the same name."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    names = {n for n, _, _ in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    fields = kept + [StructField(n, _parse_datatype_string(s)) for n, _, s in added]
    return [f.name for f in kept], StructType(fields)


def with_columns(batch: pa.RecordBatch, kept: list[str], added: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [a for _, a in added], names=kept + [n for n, _ in added])
