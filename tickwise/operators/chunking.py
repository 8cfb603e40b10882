"""Skew-safe layout for per-symbol trailing windows.

Window partitions cannot be split by AQE, so one symbol holding a large share
of all bars would land in one task.  Here each symbol's time line is cut into
chunks of about ``chunk_rows`` rows; every chunk also receives the ``halo``
rows before it, windows run over ``(symbol, chunk)``, and halo rows are
dropped afterwards.  Trailing frames of at most ``halo + 1`` rows (the 60-row
indicator frames feeding the 60-row signal frames need 118) are then exact.

Global row numbers come from a small table of counts per (symbol, time
bucket): ``rn = rows in earlier buckets + row number inside the bucket``.
Chunks are whole buckets (``chunk = floor(rows before bucket / chunk_rows)``);
with ``chunk_rows >= halo`` a bucket is halo for at most two later chunks, so
no row is copied more than twice.  Everything stays one shuffle of the bars,
on ``(symbol, chunk)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.sizing import broadcast_if_small
from tickwise.operators.series import PLAIN, SeriesSpec
from tickwise.session import configure, cut_lineage, written

SIGNAL_HALO = 118
DEFAULT_CHUNK_ROWS = 2_000_000


@dataclass
class Layout:
    rows: DataFrame          # bars (plus halo copies) ready for the operators
    spec: SeriesSpec         # window spec to hand to the operators
    chunked: bool
    ties: tuple[str, ...] = ()   # columns that order rows of equal time

    def numbered(self) -> DataFrame:
        """The rows with ``rn``, their number in the symbol by time and ``ties``."""
        if "rn" in self.rows.columns:
            return self.rows
        order = Window.partitionBy(*self.spec.part).orderBy("ts", *self.ties)
        return self.rows.withColumn("rn", F.row_number().over(order).cast("long"))

    def own(self, df: DataFrame) -> DataFrame:
        """Drop halo copies (identity for the plain layout)."""
        if not self.chunked:
            return df
        return df.filter(self.is_own()).drop("chunk", "_own_chunk", "_bucket")

    def is_own(self):
        """True for the row's own copy (always true for the plain layout)."""
        return F.lit(True) if not self.chunked else F.col("chunk") == F.col("_own_chunk")


def tie_columns(df: DataFrame) -> list[str]:
    """Columns that tell rows of one symbol and time apart, in a fixed order."""
    return sorted(f.name for f in df.schema.fields if f.name not in ("symbol", "ts") and f.dataType.typeName() not in ("map", "variant"))


def bucket_counts(bars: DataFrame, unit: str = "hour") -> DataFrame:
    """Rows per (symbol, time bucket) with rows before the bucket and symbol totals."""
    counts = bars.groupBy("symbol", F.date_trunc(unit, "ts").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("symbol").orderBy("_bucket")
    return counts.withColumn(
        "_cum", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    ).withColumn("n_sym", F.sum("_n").over(Window.partitionBy("symbol")).cast("long"))


def chunk_plan(counts: DataFrame, chunk_rows: int, halo: int, ahead: int = 0) -> DataFrame:
    """Per bucket: its own chunk, the (at most two) later chunks it is halo for,
    and - when ``ahead`` rows after a chunk are needed (``lead``) - the
    previous chunk if the bucket holds one of the first ``ahead`` rows of its chunk."""
    c = counts.withColumn("_own_chunk", F.floor(F.col("_cum") / F.lit(chunk_rows)).cast("long"))
    starts = c.groupBy("symbol", "_own_chunk").agg(F.min("_cum").alias("_start"))
    ws = Window.partitionBy("symbol").orderBy("_own_chunk")
    starts = (
        starts.withColumn("_c1", F.lead("_own_chunk", 1).over(ws)).withColumn("_s1", F.lead("_start", 1).over(ws))
        .withColumn("_c2", F.lead("_own_chunk", 2).over(ws)).withColumn("_s2", F.lead("_start", 2).over(ws))
        .withColumn("_p1", F.lag("_own_chunk", 1).over(ws))
    )
    c = c.join(starts, ["symbol", "_own_chunk"])
    end = F.col("_cum") + F.col("_n")
    targets = F.array_compact(
        F.array(
            F.col("_own_chunk"),
            F.when(F.col("_s1") - F.lit(halo) < end, F.col("_c1")),
            F.when(F.col("_s2") - F.lit(halo) < end, F.col("_c2")),
            F.when(F.col("_cum") - F.col("_start") < F.lit(ahead), F.col("_p1")),
        )
    )
    return c.select("symbol", "_bucket", "_cum", "n_sym", "_own_chunk", targets.alias("_targets"))


def layout(bars: DataFrame, chunk_rows: int | None = DEFAULT_CHUNK_ROWS, halo: int = SIGNAL_HALO,
           unit: str = "hour", force: bool = False, ahead: int = 0, ties: bool = False) -> Layout:
    """Choose the plain or chunked layout from measured per-symbol sizes.

    ``chunk_rows=None`` always uses the plain layout.  Otherwise the symbols'
    rows are counted (one aggregation pass, map-side combined) and the chunked
    layout is used when some symbol holds more than ``chunk_rows`` rows, or
    when ``force`` is set; only then are rows counted per bucket.  With ``ties`` rows of equal time are
    numbered by their other columns, in both layouts.
    """
    configure(bars.sparkSession)
    by = tuple(tie_columns(bars)) if ties else ()
    if chunk_rows is None:
        return Layout(bars, PLAIN, False, by)
    if chunk_rows < halo:
        raise ValueError(f"chunk_rows ({chunk_rows}) must be >= halo ({halo})")
    # The bars are read twice (sizes, then the windows): materialise them once
    # in the shared checkpoint folder (survives executor loss, no cached blocks
    # left behind in a long-running application).
    bars = written(bars, "bars")
    if not force:
        biggest = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if biggest <= chunk_rows:
            return Layout(bars, PLAIN, False, by)
    counts = cut_lineage(bucket_counts(bars, unit))
    plan, _ = broadcast_if_small(cut_lineage(chunk_plan(counts, chunk_rows, halo, ahead)))
    rows = (
        bars.withColumn("_bucket", F.date_trunc(unit, "ts"))
        .join(plan, ["symbol", "_bucket"])
        .withColumn("chunk", F.explode("_targets"))
        .drop("_targets")
        .repartition("symbol", "chunk")
    )
    in_bucket = Window.partitionBy("symbol", "chunk", "_bucket").orderBy("ts", *by)
    rows = rows.withColumn("rn", (F.col("_cum") + F.row_number().over(in_bucket)).cast("long")).drop("_cum")
    return Layout(rows, SeriesSpec(part=("symbol", "chunk"), order=("ts",)), True, by)
