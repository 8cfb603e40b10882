"""Technical indicators over trailing windows.

Row ``r`` of a symbol is computed over rows ``[max(1, r-59) .. r]`` - the
reference recomputes on the newest 60 rows of its history - so exponential
averages are seeded at the first row of that 60-row frame.  All work is window
functions over one hash exchange on the series key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.exprs import (
    ema_fold_sql,
    ema_outputs,
    nan_to_null,
    tdiv,
)
from tickwise.operators.series import PLAIN, SeriesSpec

HISTORY = 60          # rows kept per symbol by the reference's state
FIRST_EMITTED = 35    # first row number returned once a symbol is warm
SIGNAL_READY = 94     # first row whose 60-row window is entirely enriched

BAR_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume", "date", "time"]
INDICATOR_COLS = [
    "sma_5", "sma_10", "ema_7", "ema_11", "macd_line", "macd_signal", "atr_14", "momentum",
    "bb_upper", "bb_lower", "vma_10", "volume_ratio", "rsi_14", "price_change", "price_change_pct",
]


def last_present_rn(x: str, spec: SeriesSpec):
    """Row number of the newest row (up to this one) where ``x`` is present.

    A running frame (O(1) per row) instead of a sliding count: ``x`` has a
    value in the last ``n`` rows iff ``rn - last_present_rn < n``.
    """
    return F.max(F.when(F.col(x).isNotNull(), F.col("rn"))).over(spec.rows(Window.unboundedPreceding, 0))


def full_frame(x: str, spec: SeriesSpec, n: int):
    """``count(x)`` over the last ``n`` rows equals ``n`` (pandas ``min_periods = n``).

    Equivalent to: at least ``n`` rows so far in the partition and no missing
    ``x`` among the last ``n``; both are O(1) per row (row number and a running
    max of the row number of the last missing value).
    """
    last_missing = F.max(F.when(F.col(x).isNull(), F.col("rn"))).over(spec.rows(Window.unboundedPreceding, 0))
    rows_so_far = F.row_number().over(spec.base())
    return (rows_so_far >= n) & (last_missing.isNull() | (F.col("rn") - last_missing >= n))


def _min_periods_avg(x: str, spec: SeriesSpec, n: int):
    """pandas ``rolling(n, min_periods=n).mean()``."""
    return F.when(full_frame(x, spec, n), F.avg(F.col(x)).over(spec.last(n)))


def sma(df: DataFrame, n: int, src: str = "close", name: str | None = None, spec: SeriesSpec = PLAIN) -> DataFrame:
    """Simple moving average with ``min_periods = n``."""
    return df.withColumn(name or f"sma_{n}", _min_periods_avg(src, spec, n))


def true_range(df: DataFrame, spec: SeriesSpec = PLAIN, name: str = "tr") -> DataFrame:
    """max(h-l, |h-prev c|, |l-prev c|); nulls skipped like pandas ``max(axis=1)``."""
    prev = F.lag("close", 1).over(spec.base())
    return df.withColumn(
        name,
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
    )


def with_history(df: DataFrame, spec: SeriesSpec = PLAIN, n: int = HISTORY, src: str = "close", name: str = "_h") -> DataFrame:
    """The trailing ``n``-row frame as ``array<double>``; a missing value is kept as NaN
    so positions survive (``collect_list`` would drop nulls)."""
    v = F.coalesce(F.col(src), F.lit(float("nan")))
    return df.withColumn(name, F.collect_list(v).over(spec.last(n)))


EMA_METHOD = "arrow"


def ema_macd(df: DataFrame, spec: SeriesSpec = PLAIN, method: str | None = None, with_e2: bool = False, rank: str | None = None,
             middle: tuple[str, int] | None = None, only: str | None = None) -> DataFrame:
    """EMA 7/11 and MACD line/signal over the 60-row frame.

    ``"arrow"`` (default) is one pass over the sorted series
    (:mod:`tickwise.functions.ewm_arrow`): a row brings one close, its frame is
    a view over those before it.  In the same pass ``with_e2`` gives
    ``signal_2_macd``, ``rank`` the place of a column's value in its frame and
    ``middle`` a running median, so no window has to run after it; rows whose
    column ``only`` is not true are left out of the result.  The input is
    sorted already where a window ran on the series before, and then Spark
    plans no sort.  ``method="fold"`` evaluates the recurrence as a JVM
    higher-order ``aggregate`` over collected frames.  Both give the same
    doubles.
    """
    method = method or EMA_METHOD
    if method == "fold":
        df = with_history(df, spec).withColumn("_acc", F.expr(ema_fold_sql("_h")))
        for name, sql in ema_outputs("_acc").items():
            df = df.withColumn(name, F.expr(sql))
        return df.drop("_acc", "_h")
    from pyspark.sql.types import DoubleType, StructField, StructType

    from tickwise.functions.ewm_arrow import make_mapper, out_columns

    keep = df.columns
    schema = StructType(list(df.schema.fields) + [StructField(c, DoubleType()) for c in out_columns(with_e2, rank, middle)])
    mapper = make_mapper("close", HISTORY, keep, list(spec.part), with_e2, rank, middle, only)
    return df.sortWithinPartitions(*spec.part, *spec.order).mapInArrow(mapper, schema)


def rsi_stream(df: DataFrame, spec: SeriesSpec = PLAIN, n: int = 14, name: str = "rsi_14") -> DataFrame:
    """Simple-mean RSI; zero average loss gives null.

    The first row's undefined change counts as gain 0 / loss 0 (pandas
    ``where`` fills it), so the value exists from row ``n``.
    """
    prev = F.lag("close", 1).over(spec.base())
    delta = F.col("close") - prev
    gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
    loss = F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    w = spec.last(n)
    out = df.withColumn("_gain", gain).withColumn("_loss", loss)
    avg_gain = F.when(full_frame("_gain", spec, n), F.avg("_gain").over(w))
    avg_loss = F.when(full_frame("_loss", spec, n), F.avg("_loss").over(w))
    out = out.withColumn("_ag", avg_gain).withColumn("_al", avg_loss)
    rs = tdiv(F.col("_ag"), F.nullif(F.col("_al"), F.lit(0.0)))
    return out.withColumn(name, F.lit(100.0) - tdiv(F.lit(100.0), F.lit(1.0) + rs)).drop("_gain", "_loss", "_ag", "_al")


def price_change(df: DataFrame, spec: SeriesSpec = PLAIN, frame: int = HISTORY) -> DataFrame:
    """Absolute change and percent change.

    pandas ``pct_change`` pads gaps forward, and the reference only sees the
    newest 60 rows, so a missing close is replaced by the last present close
    at most 59 rows back.  Two running (unbounded-preceding) frames give the
    last present close and its row number in O(1) per row.
    """
    prev = F.lag("close", 1).over(spec.base())
    present_rn = F.when(F.col("close").isNotNull(), F.col("rn"))
    upto = spec.rows(Window.unboundedPreceding, 0)
    before = spec.rows(Window.unboundedPreceding, -1)
    back = frame - 1
    out = (
        df.withColumn("_lc", F.last("close", ignorenulls=True).over(upto))
        .withColumn("_lr", F.max(present_rn).over(upto))
        .withColumn("_pc", F.last("close", ignorenulls=True).over(before))
        .withColumn("_pr", F.max(present_rn).over(before))
    )
    filled = F.when(F.col("rn") - F.col("_lr") <= back, F.col("_lc"))
    filled_prev = F.when(F.col("rn") - F.col("_pr") <= back, F.col("_pc"))
    return (
        out.withColumn("price_change", F.col("close") - prev)
        .withColumn("price_change_pct", (tdiv(filled, filled_prev) - F.lit(1.0)) * F.lit(100.0))
        .drop("_lc", "_lr", "_pc", "_pr")
    )


def bollinger(df: DataFrame, spec: SeriesSpec = PLAIN, n: int = 20, k: float = 2.0) -> DataFrame:
    """sma(n) +- k * sample std(n)."""
    w = spec.last(n)
    full = full_frame("close", spec, n)
    mid = F.when(full, F.avg("close").over(w))
    sd = F.when(full, F.stddev_samp("close").over(w))
    return (
        df.withColumn("_mid", mid).withColumn("_sd", sd)
        .withColumn("bb_upper", F.col("_mid") + F.lit(k) * F.col("_sd"))
        .withColumn("bb_lower", F.col("_mid") - F.lit(k) * F.col("_sd"))
        .drop("_mid", "_sd")
    )


def enrich(bars: DataFrame, spec: SeriesSpec = PLAIN, ema_method: str | None = None, with_ema: bool = True,
           signals: bool = False, newest: bool = False, dealt: bool = False) -> DataFrame:
    """The 15 stream indicators (no gate; see :func:`warm_rows`).

    Adds ``rn`` (row number in the series) unless present, and ``n_sym`` (rows
    in the symbol) unless present.  All indicators come from one Arrow pass
    over the sorted series (:mod:`tickwise.functions.frames_arrow`), so the
    plan has a single exchange + sort on the series key.  With ``signals`` the
    same pass goes on to the signals and scores, and returns the rows that
    :func:`tickwise.operators.signals.signal_table` keeps (with ``newest`` only
    the last of each series and batch, for :func:`tickwise.operators.signals.latest_signal`); rows that
    are ``dealt`` by series already are then not shuffled again.  With
    ``ema_method="fold"``, and with ``with_ema=False``, which stops before the
    EMA step, every frame is a window sharing one partition/order spec.
    """
    df = bars
    if with_ema and (ema_method or EMA_METHOD) == "arrow":
        return _enrich_arrow(df, spec, signals, newest, dealt)
    if "rn" not in df.columns:
        df = df.withColumn("rn", F.row_number().over(spec.base()).cast("long"))
    if "n_sym" not in df.columns:
        df = df.withColumn("n_sym", F.count(F.lit(1)).over(spec.whole()).cast("long"))
    df = sma(df, 5, spec=spec)
    df = sma(df, 10, spec=spec)
    df = true_range(df, spec)
    df = df.withColumn("atr_14", _min_periods_avg("tr", spec, 14))
    df = df.withColumn("momentum", tdiv(F.col("close") - F.col("sma_10"), F.col("sma_10")))
    df = bollinger(df, spec)
    df = sma(df, 10, src="volume", name="vma_10", spec=spec)
    df = df.withColumn("volume_ratio", tdiv(F.col("volume"), F.col("vma_10")))
    df = rsi_stream(df, spec)
    df = price_change(df, spec)
    if with_ema:   # last: the map's output is no longer known to be partitioned
        df = ema_macd(df, spec, method=ema_method)
    for c in INDICATOR_COLS:           # C2: NaN / Inf never leave the operator
        if c in df.columns:
            df = df.withColumn(c, nan_to_null(F.col(c)))
    df = df.withColumn(
        "is_enriched", (F.col("rn") >= FIRST_EMITTED) & (F.col("n_sym") >= HISTORY)
    )
    return df.drop("tr")


def _enrich_arrow(df: DataFrame, spec: SeriesSpec, signals: bool, newest: bool, dealt: bool) -> DataFrame:
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    from tickwise.functions import frames_arrow as fa
    from tickwise.operators import signals as sg

    added = [*fa.SIGNAL_INDICATORS, *fa.SIGNALS] if signals else list(fa.INDICATORS)
    number = "rn" not in df.columns      # the pass counts them: no window, whose frame would look at every row once more
    if number and (signals or "n_sym" in df.columns):
        df = df if dealt else df.repartition(*spec.part)
    elif "n_sym" not in df.columns and not signals:      # over the sorted rows, so there is one sort
        every = spec.rows(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumn("n_sym", F.count(F.lit(1)).over(every).cast("long"))
    kept = [f for f in df.schema.fields if f.name not in added]
    if number:
        kept.append(StructField("rn", LongType()))
    schema = StructType(kept + [StructField(c, StringType() if c == "regime" else DoubleType()) for c in added])
    ready = (SIGNAL_READY, sg.WINDOW_CHECKED, sg.REGIME_WEIGHTS) if signals else None
    mapper = fa.make_mapper([f.name for f in kept], list(spec.part), ready, newest, number)
    df = df.sortWithinPartitions(*spec.part, *spec.order).mapInArrow(mapper, schema)
    if signals:
        return df
    return df.withColumn("is_enriched", (F.col("rn") >= FIRST_EMITTED) & (F.col("n_sym") >= HISTORY))


def warm_rows(enriched: DataFrame, warmup: int = HISTORY, first: int = FIRST_EMITTED) -> DataFrame:
    """Rows the stream emits - row number >= ``first`` in a symbol holding >= ``warmup`` rows."""
    return enriched.filter((F.col("rn") >= first) & (F.col("n_sym") >= warmup))
