"""Leakage-free training-data preparation and evaluation.

The ML path computes indicators over each symbol's *whole* history (unlike the
stream's 60-row frames): EMAs are seeded at the first row and have no minimum
periods, RSI has no zero-loss guard, momentum and volume ratio use 20 rows,
and ``target`` is the next bar's percent change.

Split, fit and transform happen in that order per symbol: scalers only ever
see training rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.functions.exprs import tdiv
from tickwise.functions.sizing import broadcast_if_small
from tickwise.operators import chunking
from tickwise.operators.indicators import full_frame
from tickwise.operators.series import PLAIN, SeriesSpec
from tickwise.session import cut_lineage

FEATURES = [
    "open", "high", "low", "close", "volume",
    "sma_5", "sma_10", "ema_7", "ema_11",
    "macd", "macd_signal", "macd_histogram",
    "atr_14", "momentum",
    "bb_upper", "bb_lower",
    "volume_ratio", "volume_ma_15",
    "rsi", "price_change", "price_change_pct",
]
LOOKBACK = 60
# The longest frame has 20 rows; whatever reaches further back (EMAs, last
# present values) goes from chunk to chunk as a folded state.
ML_HALO = 20
SCALE_EPS = 10 * np.finfo(np.float64).eps
EWM_OUT = ["ema_7", "ema_11", "macd", "macd_signal", "macd_histogram"]
SPANS = (7, 11, 12, 26)
SIGNAL_SPAN = 9
#: what a chunk starts from: the EMAs, the MACD signal and the rows since the last present close
SEEDS = [f"_ema{n}" for n in SPANS] + ["_signal", "_gap"]
#: nulls after which the weight of the value before them is 0.0 in double precision for every span
FORGOTTEN = 20_000


def _full_avg(x: str, spec: SeriesSpec, n: int):
    return F.when(full_frame(x, spec, n), F.avg(F.col(x)).over(spec.last(n)))


def window_features(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """D1, D7-D12, D14-D16 over whole history (all frames <= 20 rows)."""
    prev = F.lag("close", 1).over(spec.base())
    df = df.withColumn("sma_5", _full_avg("close", spec, 5)).withColumn("sma_10", _full_avg("close", spec, 10))
    df = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    df = df.withColumn("atr_14", _full_avg("_tr", spec, 14))
    df = df.withColumn("_sma20", _full_avg("close", spec, 20))
    df = df.withColumn("momentum", tdiv(F.col("close") - F.col("_sma20"), F.col("_sma20")))
    w20 = spec.last(20)
    sd = F.when(full_frame("close", spec, 20), F.stddev_samp("close").over(w20))
    df = df.withColumn("_sd20", sd)
    df = df.withColumn("bb_upper", F.col("_sma20") + F.col("_sd20") * F.lit(2.0)).withColumn(
        "bb_lower", F.col("_sma20") - F.col("_sd20") * F.lit(2.0)
    )
    df = df.withColumn("volume_ratio", tdiv(F.col("volume"), _full_avg("volume", spec, 20)))
    df = df.withColumn("volume_ma_15", _full_avg("volume", spec, 15))
    delta = F.col("close") - prev
    df = df.withColumn("_g", F.when(delta > 0, delta).otherwise(F.lit(0.0))).withColumn(
        "_l", F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    )
    df = df.withColumn("_ag", _full_avg("_g", spec, 14)).withColumn("_al", _full_avg("_l", spec, 14))
    # No guard - gain/0 is +inf so RSI = 100; 0/0 stays undefined.
    rsi = F.when(F.col("_al") == 0, F.when(F.col("_ag") > 0, F.lit(100.0))).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("_ag") / F.col("_al"))
    )
    df = df.withColumn("rsi", rsi)
    upto = spec.rows(Window.unboundedPreceding, 0)
    before = spec.rows(Window.unboundedPreceding, -1)
    # before the first present close of a chunk: the last one of the chunks before
    carried = F.col("_close0") if "_close0" in df.columns else F.lit(None).cast("double")
    filled = F.coalesce(F.last("close", ignorenulls=True).over(upto), carried)
    filled_prev = F.coalesce(F.last("close", ignorenulls=True).over(before), carried)
    df = df.withColumn("price_change", F.col("close") - prev)
    df = df.withColumn("price_change_pct", (tdiv(filled, filled_prev) - F.lit(1.0)) * F.lit(100.0))
    df = df.withColumn("target", F.lead("price_change_pct", 1).over(spec.base()))   # D16
    return df.drop("_tr", "_sma20", "_sd20", "_g", "_l", "_ag", "_al")


def _alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def _ema(x: np.ndarray, span: int, seed: float = np.nan, gap: int = 0) -> np.ndarray:
    """pandas ``ewm(adjust=False)`` of ``x`` that goes on from ``seed``, ``gap`` missing rows ago."""
    head = np.full(0 if np.isnan(seed) else 1 + min(gap, FORGOTTEN), np.nan)
    head[:1] = seed
    return pd.Series(np.concatenate([head, x])).ewm(span=span, adjust=False).mean().to_numpy()[len(head):]


def _ewm_mapper(part: list[str], keep: list[str], chunked: bool):
    """D3 + D6 in one Arrow pass over sorted rows: EMAs from a series' seeds on, none for halo rows.

    A series that goes on in the next batch goes on from its last values; the
    other columns pass untouched.
    """
    import pyarrow as pa

    from tickwise.functions.ewm_arrow import Carry

    def column(b, name):
        return b.column(b.schema.get_field_index(name))

    def numbers(b, name):
        return column(b, name).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)

    def run(batches):
        carry = Carry()
        for b in batches:
            if b.num_rows == 0:
                continue
            before = carry.before([column(b, c) for c in part])
            close = numbers(b, "close")
            own = numbers(b, "_own_chunk") >= numbers(b, "chunk") if chunked else np.ones(len(close), bool)
            seeds = {c: numbers(b, c) for c in SEEDS} if chunked else {}
            out = {c: np.full(len(close), np.nan) for c in EWM_OUT}
            starts = np.flatnonzero(before == 0).tolist()
            for at, end in zip([0, *starts] if 0 not in starts else starts, [*(starts if 0 not in starts else starts[1:]), len(close)]):
                if before[at] == 0:
                    carry.values = {c: float(seeds[c][at]) if chunked else np.nan for c in SEEDS}
                    carry.values["_gap"] = 0.0 if np.isnan(carry.values["_gap"]) else carry.values["_gap"]
                place = np.arange(at, end)[own[at:end]]
                if not len(place):
                    continue
                x, state = close[place], carry.values
                ema = {n: _ema(x, n, state[f"_ema{n}"], int(state["_gap"])) for n in SPANS}
                line = ema[12] - ema[26]
                signal = _ema(line, SIGNAL_SPAN, state["_signal"])
                for c, v in zip(EWM_OUT, (ema[7], ema[11], line, signal, line - signal)):
                    out[c][place] = v
                seen = np.flatnonzero(~np.isnan(x))
                gap = len(x) - 1 - int(seen[-1]) if len(seen) else 0 if np.isnan(ema[7][-1]) else int(state["_gap"]) + len(x)
                carry.values = {f"_ema{n}": float(ema[n][-1]) for n in SPANS} | {"_signal": float(signal[-1]), "_gap": float(gap)}
            arrays = [column(b, c) for c in keep] + [pa.array(v, mask=np.isnan(v), type=pa.float64()) for v in out.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + list(out))

    return run


def _chunk_end(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row that says how a chunk changes the state; pdf holds its own rows.

    From its first present close on every EMA is linear in what it has there:
    ``e`` if that is the close itself, and ``p`` times any difference to it.
    The signal adds the responses ``r*`` to those parts of the MACD line.
    """
    pdf = pdf.sort_values("ts", kind="mergesort")
    close = pdf["close"].astype("float64").to_numpy()
    given = np.flatnonzero(pdf["_given"].to_numpy(dtype=bool))
    seen = np.flatnonzero(~np.isnan(close))
    out = {c: pdf[c].iloc[0] for c in ("symbol", "chunk")}
    out |= {c: np.nan for c in _END_DOUBLES} | {"rows": len(close), "lead": len(close), "tail": 0, "given": len(given) > 0}
    if len(given):
        out["last"] = close[given[-1]]
    if len(seen):
        x = close[seen[0]:]
        at = seen - seen[0]
        out |= {"lead": int(seen[0]), "tail": len(x) - 1 - int(at[-1]), "first": x[0]}
        e, p = {}, {}
        for n in SPANS:
            old = (1.0 - _alpha(n)) ** np.diff(at)
            factor = np.ones(len(x))
            factor[at[1:]] = old / (old + _alpha(n))
            e[n], p[n] = _ema(x, n), np.cumprod(factor)
            out[f"e{n}"], out[f"p{n}"] = e[n][-1], p[n][-1]
        response = lambda y: _ema(np.concatenate([[0.0], y[1:]]), SIGNAL_SPAN)[-1]
        out |= {"r": response(e[12] - e[26]), "r12": response(p[12]), "r26": response(p[26])}
    return pd.DataFrame([out])[["symbol", "chunk", *_END_LONGS, "given", *_END_DOUBLES]]


_END_LONGS = ["rows", "lead", "tail"]
_END_DOUBLES = ["first", "last", *[f"{k}{n}" for n in SPANS for k in "ep"], "r", "r12", "r26"]


def _fold_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk of one symbol the state that the chunks before it leave."""
    ema, signal, gap, close0 = {n: np.nan for n in SPANS}, np.nan, 0, np.nan
    keep = 1.0 - _alpha(SIGNAL_SPAN)
    out = []
    for c in pdf.sort_values("chunk").to_dict("records"):
        out.append([c["symbol"], c["chunk"], *[ema[n] for n in SPANS], signal, float(gap), close0])
        if c["given"]:
            close0 = c["last"]
        line = ema[12] - ema[26]
        signal = line + (signal - line) * keep ** c["lead"]     # rows without a close repeat the line
        if c["lead"] == c["rows"]:
            gap += 0 if np.isnan(line) else c["rows"]
            continue
        d = {}
        for n in SPANS:
            old = (1.0 - _alpha(n)) ** (gap + c["lead"] + 1)
            d[n] = 0.0 if np.isnan(line) else old / (old + _alpha(n)) * (ema[n] - c["first"])
            ema[n] = c[f"e{n}"] + d[n] * c[f"p{n}"]
        start = 0.0 if np.isnan(line) else keep * signal + _alpha(SIGNAL_SPAN) * (d[12] - d[26])
        signal = keep ** (c["rows"] - c["lead"] - 1) * start + c["r"] + d[12] * c["r12"] - d[26] * c["r26"]
        gap = c["tail"]
    return pd.DataFrame(out, columns=["symbol", "chunk", *SEEDS, "_close0"])


def chunk_seeds(lay: chunking.Layout, chunk_rows: int) -> DataFrame:
    """(symbol, chunk, seeds): one row per chunk of the symbols that have several, folded per symbol in chunk order.

    A symbol of at most ``chunk_rows`` rows is one chunk, which starts from nothing.
    """
    key = [f for f in lay.rows.schema.fields if f.name in ("symbol", "chunk")]
    key.sort(key=lambda f: f.name, reverse=True)
    several = lay.rows.filter(lay.is_own() & (F.col("n_sym") > F.lit(chunk_rows)))
    own = several.select("symbol", "chunk", "ts", "close", F.col("close").isNotNull().alias("_given"))
    ends = T.StructType(key + [T.StructField(c, T.LongType()) for c in _END_LONGS] + [T.StructField("given", T.BooleanType())]
                        + [T.StructField(c, T.DoubleType()) for c in _END_DOUBLES])
    seeds = T.StructType(key + [T.StructField(c, T.DoubleType()) for c in [*SEEDS, "_close0"]])
    return own.groupBy("symbol", "chunk").applyInPandas(_chunk_end, ends).groupBy("symbol").applyInPandas(_fold_ends, seeds)


def ewm_features(df: DataFrame, spec: SeriesSpec = PLAIN) -> DataFrame:
    """Unbounded EMAs and MACD in one Arrow pass over the sorted series or chunks.

    The windows before have dealt and sorted the rows by the same key, so Spark plans neither again.
    """
    schema = T.StructType(list(df.schema.fields) + [T.StructField(c, T.DoubleType()) for c in EWM_OUT])
    run = _ewm_mapper(list(spec.part), df.columns, "_own_chunk" in df.columns)
    return df.sortWithinPartitions(*spec.part, *spec.order).mapInArrow(run, schema)


def ml_features(bars: DataFrame, chunk_rows: int | None = chunking.DEFAULT_CHUNK_ROWS, force_chunks: bool = False):
    """The 21 features + target for every bar.  Returns ``(frame, layout)``;
    the frame still carries halo copies (use ``layout.is_own()``).

    Every size takes the chunked layout, a short symbol as one chunk, and every
    chunk starts from the state that the rows before it leave (``chunk_seeds``).
    ``chunk_rows=None`` keeps each symbol whole.
    """
    lay = chunking.layout(bars, chunk_rows, halo=ML_HALO, force=True, ahead=1)
    df = lay.rows
    if "rn" not in df.columns:
        df = df.withColumn("rn", F.row_number().over(lay.spec.base()).cast("long"))
    if lay.chunked:
        seeds, _ = broadcast_if_small(cut_lineage(chunk_seeds(lay, chunk_rows)))
        df = df.join(seeds, ["symbol", "chunk"], "left")
    df = window_features(df, lay.spec).drop("_close0")
    df = ewm_features(df, lay.spec).drop(*SEEDS)
    for c in FEATURES + ["target"]:      # C2: inf / NaN never leave the operator
        df = df.withColumn(c, F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)))
    return df, lay


def clean_features(df: DataFrame, method: str = "drop", spec: SeriesSpec = PLAIN) -> DataFrame:
    """C11 (drop rows with a missing feature or target) / C12 (carry features forward, drop missing target)."""
    if method == "drop":
        return df.dropna(subset=FEATURES + ["target"])
    if method == "fill":
        upto = spec.rows(Window.unboundedPreceding, 0)
        if "chunk" not in spec.part:
            for c in FEATURES:
                df = df.withColumn(c, F.last(c, ignorenulls=True).over(upto))
            return df.dropna(subset=["target"])
        # a chunk goes on from the last present values of the chunks before; its halo rows are in those
        df = cut_lineage(df)
        present = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rn")))
        ends = df.filter("chunk = _own_chunk").groupBy("symbol", "chunk").agg(*[present(c).alias(c) for c in FEATURES])
        earlier = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("symbol", "chunk", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_0{c}") for c in FEATURES])
        carried, _ = broadcast_if_small(cut_lineage(carried))
        df = df.join(carried, ["symbol", "chunk"])
        for c in FEATURES:
            here = F.when(F.col("_own_chunk") >= F.col("chunk"), F.col(c))
            df = df.withColumn(c, F.coalesce(F.last(here, ignorenulls=True).over(upto), F.col(f"_0{c}")))
        return df.drop(*[f"_0{c}" for c in FEATURES]).dropna(subset=["target"])
    raise ValueError("method must be 'drop' or 'fill'")


def clean_report(features: DataFrame, method: str = "drop") -> DataFrame:
    """Rows before / after / removed / % removed as one aggregate over the feature frame."""
    cols = FEATURES + ["target"] if method == "drop" else ["target"]
    kept = F.lit(True)
    for c in cols:
        kept = kept & F.col(c).isNotNull()
    out = features.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"))
    out = out.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
    return out.withColumn(
        "pct_removed",
        F.when(F.col("rows_before") > 0, F.col("rows_removed") / F.col("rows_before") * F.lit(100.0)).otherwise(F.lit(0.0)),
    )


def chronological_split(df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """L1: per symbol, rows 0..int(0.7 n)-1 train, next int(0.15 n) val, the rest test.

    ``df`` carries ``rn`` (1-based position among the symbol's rows) and
    ``n_sym`` (rows of the symbol), as produced by the series layout.
    """
    if not np.isclose(train + val + test, 1.0):
        raise ValueError("train + val + test must equal 1.0")
    pos = F.col("rn") - F.lit(1)
    n_train = F.floor(F.col("n_sym") * F.lit(float(train))).cast("long")
    n_val = F.floor(F.col("n_sym") * F.lit(float(val))).cast("long")
    split = F.when(pos < n_train, "train").when(pos < n_train + n_val, "val").otherwise("test")
    start = F.when(pos < n_train, F.lit(0).cast("long")).when(pos < n_train + n_val, n_train).otherwise(n_train + n_val)
    return df.withColumn("position", pos).withColumn("split", split).withColumn("split_pos", pos - start)


def series_positions(df: DataFrame, chunk_rows: int | None, halo: int, force: bool = False):
    """Re-lay a (filtered) series so ``rn``/``n_sym`` count its remaining rows."""
    base = df.drop(*[c for c in ("rn", "n_sym") if c in df.columns])
    lay = chunking.layout(base, chunk_rows, halo=halo, force=force)
    rows = lay.rows
    if "rn" not in rows.columns:
        rows = rows.withColumn("rn", F.row_number().over(lay.spec.base()).cast("long"))
        rows = rows.withColumn("n_sym", F.count(F.lit(1)).over(lay.spec.whole()).cast("long"))
    return rows, lay


def fit_scalers(train_rows: DataFrame, method: str = "standard") -> DataFrame:
    """G8 + L2/L3 fit: per symbol and feature center/scale from training rows only.

    Long table ``(symbol, feature, center, scale, method, mean, std, min, max)``:
    standard = (mean, population std or 1 if ~0); minmax = (min, range or 1 if 0).
    """
    aggs = []
    for c in FEATURES:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    wide = train_rows.groupBy("symbol").agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`" for c in FEATURES)
    long = wide.selectExpr("symbol", f"stack({len(FEATURES)}, {stack}) AS (feature, mean, std, min, max)")
    if method == "standard":
        center, scale = F.col("mean"), F.when(F.col("std") < SCALE_EPS, F.lit(1.0)).otherwise(F.col("std"))
    elif method == "minmax":
        rng = F.col("max") - F.col("min")
        center, scale = F.col("min"), F.when(rng < SCALE_EPS, F.lit(1.0)).otherwise(rng)
    else:
        raise ValueError("method must be 'standard' or 'minmax'")
    return long.withColumn("center", center).withColumn("scale", scale).withColumn("method", F.lit(method))


def apply_scalers(df: DataFrame, scalers: DataFrame) -> DataFrame:
    """L2/L3 transform (+H6): join the per-symbol scaler (size-checked broadcast), (x - center) / scale.

    A symbol without a fitted scaler is an error, as in the reference.
    """
    wide = scalers.groupBy("symbol").agg(
        *[F.first(F.when(F.col("feature") == c, F.struct("center", "scale")), ignorenulls=True).alias(f"_s_{c}") for c in FEATURES]
    )
    wide, _ = broadcast_if_small(cut_lineage(wide.withColumn("_fitted", F.lit(True))))
    out = df.join(wide, "symbol", "left")
    for c in FEATURES:
        scaled = (F.col(c) - F.col(f"_s_{c}.center")) / F.col(f"_s_{c}.scale")
        out = out.withColumn(c, F.when(F.coalesce("_fitted", F.lit(False)), scaled).otherwise(
            F.raise_error(F.concat(F.lit("no scaler fitted for symbol "), F.coalesce("symbol", F.lit("null"))))))
    return out.drop("_fitted", *[f"_s_{c}" for c in FEATURES])


def sequences(df: DataFrame, spec: SeriesSpec = PLAIN, lookback: int = LOOKBACK) -> DataFrame:
    """L4 (+D24): X = features of rows i-60..i-1 in the same split and symbol, y = target[i]."""
    w = Window.partitionBy(*spec.part, "split").orderBy("ts").rowsBetween(-lookback, -1)
    x = F.collect_list(F.array(*[F.col(c) for c in FEATURES])).over(w)
    out = df.withColumn("X", x).withColumn("y", F.col("target"))
    return out.filter((F.col("split_pos") >= lookback) & (F.size("X") == lookback))


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per (symbol, split) with the share of the symbol's rows."""
    c = df.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("rows"))
    return c.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("symbol")))


def target_stats(df: DataFrame) -> DataFrame:
    """Target mean and sample std per split."""
    return df.groupBy("split").agg(F.avg("target").alias("target_mean"), F.stddev_samp("target").alias("target_std"),
                                   F.count(F.lit(1)).alias("rows"))


def inference_windows(scaled: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """The newest ``lookback`` scaled rows per symbol as one sequence (row numbers
    ``> n - lookback``, no whole-symbol window); ``ready`` is false when the
    symbol has fewer rows (the reference raises)."""
    last = scaled.filter(F.col("rn") > F.col("n_sym") - F.lit(lookback))
    g = last.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("ts", F.array(*[F.col(c) for c in FEATURES]).alias("x")))).alias("_rows")
    )
    return g.select("symbol", F.transform("_rows", lambda r: r["x"]).alias("X"), (F.size("_rows") == lookback).alias("ready"))


def naive_last_change_model(feature_index: int):
    """Test model for L6: predicts the last step's value of one feature."""
    def model(batch: np.ndarray) -> np.ndarray:
        return batch[:, -1, feature_index]
    return model


def score(df: DataFrame, model, x_col: str = "X", name: str = "prediction") -> DataFrame:
    """Batch scoring of ``array<array<double>>`` sequences with a supplied numpy model.

    The model sees a ``(n, steps, features)`` array: the flat values of an
    Arrow batch, reshaped once.  Sequences of a batch have one shape; a null
    sequence has a null score.
    """
    import pyarrow as pa

    keep = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches):
        for b in batches:
            x = b.column(b.schema.get_field_index(x_col))
            out = np.full(len(x), np.nan)
            given = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            if len(given):
                rows = x.flatten()
                flat = rows.flatten().to_numpy(zero_copy_only=False)
                steps = len(rows) // len(given)
                out[given] = np.asarray(model(flat.reshape(len(given), steps, -1)), dtype="float64")
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(out, mask=np.isnan(out))]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + [name])

    return df.mapInArrow(run, schema)


def regression_metrics(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE, MAPE (1e-10 added to y, not absolute)."""
    err = F.col(y) - F.col(p)
    out = df.agg(
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.abs(err / (F.col(y) + F.lit(1e-10)))) * F.lit(100.0)).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("rmse", F.sqrt("mse"))


def sample_errors(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """Per-sample error and error % (1e-8, absolute)."""
    return df.withColumn("error", F.col(p) - F.col(y)).withColumn(
        "error_pct", F.abs(F.col(p) - F.col(y)) / (F.abs(F.col(y)) + F.lit(1e-8)) * F.lit(100.0)
    )


def error_histogram(df: DataFrame, bins: int = 50, err: str = "error") -> DataFrame:
    """Counts in ``bins`` equal-width bins over [min, max] of the error, empty bins included.

    The errors are materialised once; bounds and bins are one-row and
    ``bins``-row tables.  Without errors there are no bins.
    """
    errors = cut_lineage(df.select(F.col(err).alias("_e")).where("_e IS NOT NULL"))
    bounds = errors.agg(F.min("_e").alias("lo"), F.max("_e").alias("hi")).where("lo IS NOT NULL")
    bounds = F.broadcast(bounds.select("lo", ((F.col("hi") - F.col("lo")) / F.lit(bins)).alias("width")))
    place = F.when(F.col("width") > 0, F.least(F.floor((F.col("_e") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = errors.join(bounds).select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(bounds)
    return every.join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).cast("long").alias("count"), (F.col("lo") + F.col("width") * F.col("bin")).alias("bin_start"))


def prepare(bars: DataFrame, chunk_rows: int | None = chunking.DEFAULT_CHUNK_ROWS, method: str = "standard",
            missing: str = "drop", force_chunks: bool = False) -> dict[str, DataFrame]:
    """Load -> D28 -> C11 -> L1 -> L2 -> L4.

    Features run on the series layout with a 20-row halo and folded state; the
    cleaned rows are laid out again (60-row halo) so positions, splits and sequences see only
    kept rows and no task holds a whole hot symbol.
    """
    feats, lay = ml_features(bars, chunk_rows, force_chunks=force_chunks)
    # Materialise the cleaned features once: later stages reuse them several
    # times, and the shallow plan keeps the optimizer fast.
    clean = cut_lineage(lay.own(clean_features(feats, missing, lay.spec)))
    rows, lay2 = series_positions(clean, chunk_rows, LOOKBACK, force_chunks)
    split = chronological_split(rows)
    scalers = cut_lineage(fit_scalers(split.filter(lay2.is_own() & (F.col("split") == "train")), method))
    scaled = apply_scalers(split, scalers)
    seqs = lay2.own(sequences(scaled, lay2.spec))
    return {
        "features": lay.own(feats), "clean": clean, "split": lay2.own(split),
        "scalers": scalers, "scaled": lay2.own(scaled), "sequences": seqs,
    }


def _ship_by_value():
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
