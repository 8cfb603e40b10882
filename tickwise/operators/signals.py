"""Six bounded trading signals, volatility regime and score.

The reference evaluates each signal on the newest 60 enriched rows of a
symbol; here every quantity is a trailing window over the enriched series, so
a signal row exists for every bar whose 60-row window is entirely enriched
(row number >= 94).  ``iloc[-k]`` of the reference is ``lag(k-1)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.functions.exprs import EPS_PERCENT, EPS_SMALL, EPS_VOLUME, clip, nan_to_null, tdiv
from tickwise.operators.indicators import HISTORY, SIGNAL_READY, full_frame, last_present_rn
from tickwise.operators.series import PLAIN, SeriesSpec

MEDIAN_ROWS = 15      # rows of the volume median (E5)
SIGNAL_COLS = [
    "signal_1_momentum", "signal_2_macd", "signal_3_rsi",
    "signal_4_bollinger", "signal_5_volume", "signal_6_trend_quality",
]
REQUIRED_COLS = [
    "close", "volume", "sma_10", "macd_line", "macd_signal", "atr_14", "momentum",
    "bb_upper", "bb_lower", "volume_ratio", "rsi_14", "price_change", "price_change_pct",
]
# MACD columns are not window-checked: when the current row's value is
# missing, E2 is missing and the row is dropped anyway (C9); when it is present
# the 60-row window is not entirely null.  This lets the MACD come last.
WINDOW_CHECKED = [c for c in REQUIRED_COLS if c not in ("macd_line", "macd_signal")]
SIGNAL_OUT = (
    ["symbol", "ts", "date", "time", "open", "high", "low", "close", "volume",
     "sma_10", "macd_line", "macd_signal", "atr_14", "momentum", "bb_upper", "bb_lower",
     "volume_ratio", "rsi_14", "price_change", "price_change_pct"]
    + SIGNAL_COLS
    + ["regime", "regime_confidence", "marker_raw_score", "marker_adjusted_score", "marker_final_score"]
)

# Fixed values that must equal the reference: regime -> weight of signals 1..6.
REGIME_WEIGHTS = {
    "EXPLOSIVE": (0.30, 0.15, 0.03, 0.07, 0.20, 0.25),
    "TRENDING": (0.25, 0.20, 0.08, 0.10, 0.17, 0.20),
    "NEUTRAL": (0.1667, 0.1667, 0.1667, 0.1667, 0.1667, 0.1665),
    "MEAN_REVERSION": (0.08, 0.15, 0.32, 0.28, 0.12, 0.05),
}


def regime_weights(spark: SparkSession) -> DataFrame:
    """The 4-row regime weight table (fixed size, safe to broadcast)."""
    rows = [(k, *v) for k, v in REGIME_WEIGHTS.items()]
    return spark.createDataFrame(rows, "regime string, w1 double, w2 double, w3 double, w4 double, w5 double, w6 double")


def _lag(c: str, k: int, spec: SeriesSpec):
    return F.lag(c, k).over(spec.base())


def momentum_strength(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """E1 (+D25): acceleration of close-vs-sma over the last 10 rows, tanh-squashed."""
    m = tdiv(F.col("close") - F.col("sma_10"), F.col("sma_10") + F.lit(EPS_PERCENT))
    df = df.withColumn("_m", m)
    early = F.avg("_m").over(spec.rows(-9, -5))
    late = F.avg("_m").over(spec.rows(-4, 0))
    vol = F.stddev_samp("_m").over(spec.last(10))
    z = tdiv(late - early, vol + F.lit(EPS_SMALL))
    return df.withColumn("signal_1_momentum", clip(F.tanh(z / F.lit(1.5)), -1, 1)).drop("_m")


def macd_alignment(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """E2 (+D17, D18): MACD velocity over 10 rows vs its 15-row range, and line-signal position."""
    w15 = spec.last(15)
    rng = F.greatest(F.max("macd_line").over(w15) - F.min("macd_line").over(w15), F.lit(EPS_SMALL))
    velocity = tdiv(F.col("macd_line") - _lag("macd_line", 9, spec), rng)
    df = df.withColumn("_gap", F.abs(F.col("macd_line") - F.col("macd_signal")))
    position = tdiv(F.col("macd_line") - F.col("macd_signal"), F.max("_gap").over(w15) + F.lit(EPS_SMALL))
    combined = F.lit(0.6) * velocity + F.lit(0.4) * position
    return df.withColumn("signal_2_macd", clip(combined, -1, 1)).drop("_gap")


def rsi_reversion(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """RSI extremes, reversal boost and momentum filter; null RSI gives 0."""
    rsi = F.col("rsi_14")
    r4 = _lag("rsi_14", 4, spec)
    r9 = _lag("rsi_14", 9, spec)
    extreme = (
        F.when(rsi < 20, 1.0).when(rsi < 30, 0.7).when(rsi < 40, 0.3)
        .when(rsi > 80, -1.0).when(rsi > 70, -0.7).when(rsi > 60, -0.3).otherwise(0.0)
    )
    change = rsi - r4
    boost = (
        F.when((r9 < 30) & (r4 < 35) & (rsi > 35) & (change > 0), 0.5)
        .when((r9 > 70) & (r4 > 65) & (rsi < 65) & (change < 0), -0.5)
        .otherwise(0.0)
    )
    mom = F.col("momentum")
    mfilter = F.when(F.abs(mom) > 0.02, F.signum(mom) * F.lit(0.3)).otherwise(F.lit(0.0))
    raw = extreme + boost + mfilter
    return df.withColumn("signal_3_rsi", F.when(rsi.isNull(), F.lit(0.0)).otherwise(clip(raw, -1, 1)))


def bollinger_dynamics(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """%B position, velocity towards the bands over 4 rows, width change."""
    c, u, lo = F.col("close"), F.col("bb_upper"), F.col("bb_lower")
    width = (u - lo) + F.lit(EPS_SMALL)
    pb = clip(tdiv(c - lo, width), -0.1, 1.1)
    c4, u4, l4 = _lag("close", 4, spec), _lag("bb_upper", 4, spec), _lag("bb_lower", 4, spec)
    w4 = u4 - l4
    v_up = tdiv((u4 - c4) - (u - c), width + F.lit(EPS_SMALL))
    v_low = tdiv((c4 - l4) - (c - lo), width + F.lit(EPS_SMALL))
    wchange = tdiv(width - w4, w4 + F.lit(EPS_SMALL))
    df = df.withColumn("_pb", pb).withColumn("_vu", v_up).withColumn("_vl", v_low).withColumn("_wc", wchange)
    pb, v_up, v_low, wchange = F.col("_pb"), F.col("_vu"), F.col("_vl"), F.col("_wc")
    position = (
        F.when(pb > 0.95, F.when(v_up > 0.05, 0.8).when(v_up < -0.05, -0.7).otherwise(0.0))
        .when(pb < 0.05, F.when(v_low > 0.05, -0.8).when(v_low < -0.05, 0.7).otherwise(0.0))
        .when((pb >= 0.45) & (pb <= 0.55), 0.0)
        .otherwise((pb - F.lit(0.5)) * F.lit(0.5))
    )
    df = df.withColumn("_pos", position)
    adj = (
        F.when(wchange > 0.1, F.when(F.abs(F.col("_pos")) > 0.5, 1.2).otherwise(1.0))
        .when(wchange < -0.1, 0.7)
        .otherwise(1.0)
    )
    return df.withColumn("signal_4_bollinger", clip(F.col("_pos") * adj, -1, 1)).drop("_pb", "_vu", "_vl", "_wc", "_pos")


def volume_parts(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """Inputs of E5 but the median (+D21): net % move and share of busy rows in the last 10."""
    w10 = spec.last(10)
    net = F.when(full_frame("price_change_pct", spec, 10), F.sum("price_change_pct").over(w10))
    return df.withColumn("_net", net).withColumn("_busy", F.count_if(F.col("volume_ratio") > 1.2).over(w10) / F.lit(10.0))


def running_median(df: DataFrame, spec: SeriesSpec = PLAIN, n: int = MEDIAN_ROWS, name: str = "_median") -> DataFrame:
    """D19 as a collected frame: the path without the Arrow pass."""
    df = df.withColumn("_s", F.array_sort(F.collect_list("volume_ratio").over(spec.last(n))))
    size = F.size("_s")
    mid = (size / 2).cast("int")
    median = (
        F.when(size == 0, F.lit(None).cast("double"))
        .when(size % 2 == 1, F.element_at("_s", ((size + 1) / 2).cast("int")))
        .otherwise((F.element_at("_s", mid) + F.element_at("_s", mid + 1)) / F.lit(2.0))
    )
    return df.withColumn(name, median).drop("_s")


def volume_conviction(df: DataFrame) -> DataFrame:
    """E5: net % move of 10 rows scaled by the volume surge over the 15-row median."""
    baseline = F.greatest("_median", F.lit(0.5))
    surge = tdiv(F.col("volume_ratio"), baseline) - F.lit(1.0)
    net = F.col("_net")
    align = F.abs(net) * surge * F.signum(net)
    adjusted = F.when(F.col("_busy") > 0.6, align * F.lit(1.3)).otherwise(align)
    return df.withColumn("signal_5_volume", clip(F.tanh(adjusted * F.lit(2.0)), -1, 1)).drop("_net", "_busy", "_median")


def trend_quality(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """E6 (+D22): direction consistency, path efficiency and magnitude steadiness over 10 rows."""
    w10 = spec.last(10)
    d = F.signum("price_change")
    df = df.withColumn("_d", d).withColumn("_ad", F.abs("price_change"))
    share = F.greatest(
        F.count_if(F.col("_d") > 0).over(w10), F.count_if(F.col("_d") < 0).over(w10), F.count_if(F.col("_d") == 0).over(w10)
    ) / F.lit(10.0)
    net_move = F.col("close") - _lag("close", 9, spec)
    efficiency = tdiv(F.abs(net_move), F.sum("_ad").over(w10) + F.lit(EPS_SMALL))
    steadiness = clip(F.lit(1.0) - tdiv(F.stddev_samp("_ad").over(w10), F.avg("_ad").over(w10) + F.lit(EPS_SMALL)), 0, 1)
    quality = (share + efficiency + steadiness) / F.lit(3.0)
    raw = quality * F.signum(net_move) * F.lit(2.0) - F.lit(1.0)
    return df.withColumn("signal_6_trend_quality", clip(raw, -1, 1)).drop("_d", "_ad")


def atr_rate(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """Input of E7: change of the ATR over 4 rows."""
    a4 = _lag("atr_14", 4, spec)
    return df.withColumn("_rate", tdiv(F.col("atr_14") - a4, a4 + F.lit(EPS_SMALL)))


def rank_in_frame(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """D20 as a collected frame: the path without the Arrow pass."""
    w60 = spec.last(HISTORY)
    df = df.withColumn("_ah", F.collect_list("atr_14").over(w60)).withColumn("_rows", F.count(F.lit(1)).over(w60).cast("double"))
    return df.withColumn("_below", F.size(F.filter(F.col("_ah"), lambda x: x < F.col("atr_14"))).cast("double")).drop("_ah")


def volatility_regime(df: DataFrame) -> DataFrame:
    """Strict percentile rank of ATR in its 60-row window (``_below`` of ``_rows``) and its 4-row change."""
    df = df.withColumn("_p", F.col("_below") / F.col("_rows") * F.lit(100.0))
    p, r = F.col("_p"), F.col("_rate")
    regime = (
        F.when((p > 75) & (r > 0.15), "EXPLOSIVE").when(p > 55, "TRENDING").when(p < 35, "MEAN_REVERSION").otherwise("NEUTRAL")
    )
    conf = (
        F.when((p > 75) & (r > 0.15), (p - F.lit(75.0)) / F.lit(25.0))
        .when(p > 55, (p - F.lit(55.0)) / F.lit(45.0))
        .when(p < 35, (F.lit(35.0) - p) / F.lit(35.0))
        .otherwise(F.lit(0.5))
    )
    return df.withColumn("regime", regime).withColumn("regime_confidence", conf).drop("_below", "_rows", "_p", "_rate")


def volume_stats(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """Inputs of E10: 60-row mean and sample std of the volume ratio."""
    w60 = spec.last(HISTORY)
    return df.withColumn("_vr_mean", F.avg("volume_ratio").over(w60)).withColumn(
        "_vr_std", F.stddev_samp("volume_ratio").over(w60)
    )


def ready_flags(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """C6 + C7: window fully enriched and no required column entirely null in it.

    "Some value in the last 60 rows" is ``rn - (row number of the newest
    present value) < 60``: one running max per column (O(1) per row) instead
    of 13 sliding 60-row counts.
    """
    ok = F.col("rn") >= SIGNAL_READY
    for c in REQUIRED_COLS:
        if c in WINDOW_CHECKED:
            ok = ok & (F.col("rn") - last_present_rn(c, spec) < HISTORY)
    return df.withColumn("_ready", ok)


def quality_flags(df: DataFrame) -> DataFrame:
    """Warnings of the reference as columns (rows are not dropped)."""
    rsi = F.col("rsi_14")
    flags = F.array_compact(
        F.array(
            F.when(F.col("volume") < 100, F.lit("low_volume")),
            F.when(F.col("atr_14") <= 0, F.lit("bad_atr")),
            F.when(F.col("bb_upper") <= F.col("bb_lower"), F.lit("bad_bands")),
            F.when(rsi.isNull() | (rsi < 0) | (rsi > 100), F.lit("bad_rsi")),
        )
    )
    return df.withColumn("quality_flags", flags)


def score(df: DataFrame, weights: DataFrame) -> DataFrame:
    """E8-E10 (+H5): regime weights by broadcast join, weighted raw score, volume-confidence adjustment."""
    joined = df.join(F.broadcast(weights), on="regime", how="left")
    raw = (
        F.col("signal_1_momentum") * F.col("w1") + F.col("signal_2_macd") * F.col("w2")
        + F.col("signal_3_rsi") * F.col("w3") + F.col("signal_4_bollinger") * F.col("w4")
        + F.col("signal_5_volume") * F.col("w5") + F.col("signal_6_trend_quality") * F.col("w6")
    )
    z = tdiv(F.col("volume_ratio") - F.col("_vr_mean"), F.col("_vr_std") + F.lit(EPS_VOLUME))
    conf = (
        F.when(z > 2.0, 1.4).when(z > 1.0, 1.2).when(z > 0, 1.05)
        .when(z < -2.0, 0.4).when(z < -1.0, 0.6).otherwise(0.85)
    )
    out = joined.withColumn("marker_raw_score", raw).withColumn("_conf", conf)
    adjusted = F.signum("marker_raw_score") * F.pow(F.abs("marker_raw_score"), F.lit(1.0) / F.col("_conf"))
    out = out.withColumn("marker_adjusted_score", nan_to_null(adjusted))
    return out.withColumn("marker_final_score", F.col("marker_adjusted_score") + F.lit(1.0)).drop(
        "_conf", "w1", "w2", "w3", "w4", "w5", "w6"
    )


def signal_table(enriched: DataFrame, spec: SeriesSpec = PLAIN, extra: tuple[str, ...] = (),
                 ema_method: str | None = None) -> DataFrame:
    """SIGNAL rows for every ready bar; rows with any missing signal are dropped.

    ``enriched`` is the ungated output of :func:`tickwise.operators.indicators.enrich`
    with ``signals=True``: its one Arrow pass has made the signals and scores
    of all ready rows.  With ``with_ema=False`` (all rows, so windows can look
    back) the windows run first and an Arrow pass over the sorted series gives
    the EMA/MACD, E2, the ATR's rank and the volume median, so the plan keeps
    one exchange on the series key.  A frame that already has the MACD columns
    is also accepted.
    """
    from tickwise.operators import indicators as ind

    spark = enriched.sparkSession
    if "marker_raw_score" in enriched.columns:      # from the Arrow pass of ``enrich``
        return enriched.select(*SIGNAL_OUT, *extra)
    df = ready_flags(enriched, spec)
    df = momentum_strength(df, spec)
    df = rsi_reversion(df, spec)
    df = bollinger_dynamics(df, spec)
    df = volume_parts(df, spec)
    df = trend_quality(df, spec)
    df = atr_rate(df, spec)
    df = volume_stats(df, spec)
    method = ema_method or ind.EMA_METHOD
    if "macd_line" in df.columns or method == "fold":
        df = rank_in_frame(running_median(df, spec), spec)
        if "macd_line" not in df.columns:
            df = ind.ema_macd(df, spec, method=method)
            for c in ("ema_7", "ema_11", "macd_line", "macd_signal"):
                df = df.withColumn(c, nan_to_null(F.col(c)))
        df = macd_alignment(df, spec)
    else:
        # every row passes, since frames reach back over rows that are not ready; only ready ones come out
        df = df.select(*[c for c in df.columns if c not in ("n_sym", "sma_5", "vma_10", "is_enriched")])
        df = ind.ema_macd(df, spec, method=method, with_e2=True, rank="atr_14", middle=("volume_ratio", MEDIAN_ROWS), only="_ready")
        for c in ("ema_7", "ema_11", "macd_line", "macd_signal"):
            df = df.withColumn(c, nan_to_null(F.col(c)))
    df = volatility_regime(volume_conviction(df))
    for c in SIGNAL_COLS:
        df = df.withColumn(c, nan_to_null(F.col(c)))
    df = df.filter(F.col("_ready"))
    df = df.dropna(subset=SIGNAL_COLS)
    df = score(df, regime_weights(spark))
    return df.select(*SIGNAL_OUT, *extra)


def latest_signal(signals: DataFrame) -> DataFrame:
    """Newest signal per symbol (upsert by key)."""
    cols = [c for c in signals.columns if c != "symbol"]
    return (
        signals.groupBy("symbol")
        .agg(F.max_by(F.struct(*cols), F.col("ts")).alias("s"))
        .select("symbol", "s.*")
    )


def summary_label(score_col="marker_final_score"):
    """Label scale of the signal summary (1.5 / 1.1 / 0.9 / 0.5)."""
    s = F.col(score_col)
    return (
        F.when(s >= 1.5, "STRONG BUY").when(s >= 1.1, "WEAK BUY").when(s >= 0.9, "HOLD")
        .when(s >= 0.5, "WEAK SELL").otherwise("STRONG SELL")
    )


def ranked_summary(latest: DataFrame) -> DataFrame:
    """Latest score per symbol with label, best first (ties by symbol)."""
    return latest.select(
        "symbol", "close", "volume", "regime", "marker_final_score", summary_label().alias("label")
    ).orderBy(F.desc("marker_final_score"), F.asc("symbol"))
