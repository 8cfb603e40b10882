"""Registry of the queries checked by the driver: Spark plan + DuckDB oracle SQL.

Each entry is ``key -> (fn(spark, sf_dir) -> DataFrame, sql | None)``.  Keys
follow SURVEY 7.1: lower-case operator ID plus a name.  Every query reads the
shared tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwise.functions.exprs import round_doubles
from tickwise.operators import chunking
from tickwise.operators import indicators as ind
from tickwise.operators import signals as sg
from tickwise.plans import flows
from tickwise.plans import sqlgen as q
from tickwise.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def r6_select(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"{q.r6(c)} AS {c}" if c in doubles else c for c in cols)


BAR_DOUBLES = {"open", "high", "low", "close", "volume"}
ENR_COLS = ind.BAR_COLS + ind.INDICATOR_COLS + ["rn", "is_enriched"]
ENR_DOUBLES = BAR_DOUBLES | set(ind.INDICATOR_COLS)
SIG_DOUBLES = {c for c in sg.SIGNAL_OUT if c not in ("symbol", "ts", "date", "time", "regime")}


# ---------------------------------------------------------------------------
# Shared Spark building blocks
# ---------------------------------------------------------------------------

def daily_bars(spark, sf_dir, text=True):
    """Daily bars, and whether they come dealt by symbol: where no supplier has more lines than a chunk has rows."""
    short = fx.most_lines(spark, sf_dir) <= chunking.DEFAULT_CHUNK_ROWS
    return fx.bars_daily(spark, sf_dir, by_symbol=short, text=text), short


def daily_enriched(spark, sf_dir):
    bars, short = daily_bars(spark, sf_dir, text=False)     # the text need not go through the Arrow pass
    return fx.text_cols(flows.enriched_bars(bars, chunk_rows=None if short else chunking.DEFAULT_CHUNK_ROWS))


def daily_signals(spark, sf_dir, newest=False):
    bars, short = daily_bars(spark, sf_dir)
    return flows.signals(bars, chunk_rows=None if short else chunking.DEFAULT_CHUNK_ROWS, newest=newest, dealt=short)


def hourly_signals(spark, sf_dir):
    return flows.signals(fx.bars_hourly(spark, sf_dir))


# ---------------------------------------------------------------------------
# Fixtures (2.A scans feeding everything else)
# ---------------------------------------------------------------------------

@register("a00_bars_hourly", f"SELECT symbol, ts, {r6_select(['open','high','low','close','volume'], BAR_DOUBLES)}, date, time FROM ({q.BARS_HOURLY})")
def a00_bars_hourly(spark, sf_dir):
    return round_doubles(fx.bars_hourly(spark, sf_dir))


@register("a00_bars_daily", f"SELECT symbol, ts, {r6_select(['open','high','low','close','volume'], BAR_DOUBLES)}, date, time FROM ({q.BARS_DAILY})")
def a00_bars_daily(spark, sf_dir):
    return round_doubles(fx.bars_daily(spark, sf_dir))


# ---------------------------------------------------------------------------
# 2.D indicators
# ---------------------------------------------------------------------------

@register(
    "d27_enriched_bars",
    f"WITH {q.enriched_ctes(q.BARS_DAILY)} SELECT {r6_select(ENR_COLS, ENR_DOUBLES)} FROM enr WHERE rn >= 35 AND n_sym >= 60",
)
def d27_enriched_bars(spark, sf_dir):
    return round_doubles(ind.warm_rows(daily_enriched(spark, sf_dir)).select(*ENR_COLS))


@register(
    "d27_enriched_hourly",
    f"WITH {q.enriched_ctes(q.BARS_HOURLY)} SELECT {r6_select(ENR_COLS, ENR_DOUBLES)} FROM enr WHERE rn >= 35 AND n_sym >= 60",
)
def d27_enriched_hourly(spark, sf_dir):
    return round_doubles(ind.warm_rows(flows.enriched_bars(fx.bars_hourly(spark, sf_dir))).select(*ENR_COLS))


@register("d27_enriched_hourly_chunked", ORACLE["d27_enriched_hourly"])
def d27_enriched_hourly_chunked(spark, sf_dir):
    """Same result as ``d27_enriched_hourly`` through the hot-symbol layout (small chunks)."""
    enr = flows.enriched_bars(fx.bars_hourly(spark, sf_dir), chunk_rows=150, force_chunks=True)
    return round_doubles(ind.warm_rows(enr).select(*ENR_COLS))


# ---------------------------------------------------------------------------
# 2.E signals
# ---------------------------------------------------------------------------

@register(
    "e11_signal_table",
    f"WITH {q.enriched_ctes(q.BARS_DAILY)}, {q.signal_ctes()} SELECT {r6_select(sg.SIGNAL_OUT, SIG_DOUBLES)} FROM sig",
)
def e11_signal_table(spark, sf_dir):
    return round_doubles(daily_signals(spark, sf_dir))


@register(
    "e11_signal_table_hourly",
    f"WITH {q.enriched_ctes(q.BARS_HOURLY)}, {q.signal_ctes()} SELECT {r6_select(sg.SIGNAL_OUT, SIG_DOUBLES)} FROM sig",
)
def e11_signal_table_hourly(spark, sf_dir):
    return round_doubles(hourly_signals(spark, sf_dir))


@register("e11_signal_table_hourly_chunked", ORACLE["e11_signal_table_hourly"])
def e11_signal_table_hourly_chunked(spark, sf_dir):
    """Same result as ``e11_signal_table_hourly`` with every symbol split into ~150-row chunks."""
    return round_doubles(flows.signals(fx.bars_hourly(spark, sf_dir), chunk_rows=150, force_chunks=True))


@register(
    "e12_latest_signal",
    f"WITH {q.enriched_ctes(q.BARS_DAILY)}, {q.signal_ctes()} "
    f"SELECT {r6_select(sg.SIGNAL_OUT, SIG_DOUBLES)} FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
)
def e12_latest_signal(spark, sf_dir):
    return round_doubles(sg.latest_signal(daily_signals(spark, sf_dir, newest=True)).select(*sg.SIGNAL_OUT))


@register(
    "e13_ranked_summary",
    f"WITH {q.enriched_ctes(q.BARS_HOURLY)}, {q.signal_ctes()}, "
    "lat AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) "
    f"SELECT symbol, {q.r6('close')} AS close, {q.r6('volume')} AS volume, regime, {q.r6('marker_final_score')} AS marker_final_score, "
    "CASE WHEN marker_final_score >= 1.5 THEN 'STRONG BUY' WHEN marker_final_score >= 1.1 THEN 'WEAK BUY' "
    "WHEN marker_final_score >= 0.9 THEN 'HOLD' WHEN marker_final_score >= 0.5 THEN 'WEAK SELL' ELSE 'STRONG SELL' END AS label "
    "FROM lat ORDER BY marker_final_score DESC, symbol",
)
def e13_ranked_summary(spark, sf_dir):
    return round_doubles(sg.ranked_summary(sg.latest_signal(hourly_signals(spark, sf_dir))))


# ---------------------------------------------------------------------------
# 2.F portfolio rebalancing (hourly signals, all customers as portfolios)
# ---------------------------------------------------------------------------

from tickwise.operators import portfolio as pf  # noqa: E402

_PF_SQL = f"WITH {q.enriched_ctes(q.BARS_HOURLY)}, {q.signal_ctes()}, {q.portfolio_ctes()} "


def rebalance_all(spark, sf_dir):
    return pf.rebalance(fx.portfolios(spark, sf_dir), fx.positions(spark, sf_dir), hourly_signals(spark, sf_dir))


FRESH_COLS = ["cycle_ts", "cycle", "symbol", "signal_ts", "close", "atr_14", "marker_final_score", "regime",
              "regime_confidence", "volume", "history_len", "confidence", "signal_strength", "signal_class"]


@register(
    "h08_fresh_signals_by_cycle",
    _PF_SQL + "SELECT cycle_ts, cycle, symbol, signal_ts, "
    + ", ".join(q.r6(c) + " AS " + c for c in ["close", "atr_14", "marker_final_score"]) + ", regime, "
    + ", ".join(q.r6(c) + " AS " + c for c in ["regime_confidence", "volume"]) + ", CAST(history_len AS INTEGER) AS history_len, "
    + q.r6("confidence") + " AS confidence, " + q.r6("signal_strength") + " AS signal_strength, "
    "CASE WHEN marker_final_score >= 1.5 THEN 'STRONG_BUY' WHEN marker_final_score >= 1.1 THEN 'WEAK_BUY' "
    "WHEN marker_final_score >= 0.9 THEN 'HOLD' WHEN marker_final_score >= 0.7 THEN 'WEAK_SELL' ELSE 'STRONG_SELL' END AS signal_class FROM fresh",
)
def h08_fresh_signals_by_cycle(spark, sf_dir):
    """C10 + H8 + D26 + F1 + F6 + F7: as-of signal per cycle with confidence and strength."""
    fresh = pf.score_history(pf.number_cycles(pf.fresh_signals(hourly_signals(spark, sf_dir))))
    fresh = fresh.withColumn("signal_strength", pf.strength()).withColumn("signal_class", pf.signal_class())
    fresh = fresh.withColumn("history_len", F.size("signal_history"))
    return round_doubles(fresh.select(*FRESH_COLS))


_ASOF_SQL = (
    f"WITH {q.enriched_ctes(q.BARS_HOURLY)}, {q.signal_ctes()}, m AS MATERIALIZED (SELECT symbol, ts, close, marker_final_score FROM sig), "
    "c AS (SELECT unnest(generate_series((SELECT min(ts) FROM m), (SELECT max(ts) FROM m) + INTERVAL 2 DAY, INTERVAL {period} SECOND)) AS cycle_ts), "
    "cs AS (SELECT cycle_ts, symbol FROM c CROSS JOIN (SELECT DISTINCT symbol FROM m)) "
    "SELECT cs.cycle_ts, cs.symbol, m.ts AS signal_ts, " + q.r6("m.close") + " AS close, " + q.r6("m.marker_final_score") + " AS marker_final_score "
    "FROM cs ASOF JOIN m ON m.symbol = cs.symbol AND cs.cycle_ts >= m.ts WHERE cs.cycle_ts - m.ts <= INTERVAL {age} SECOND"
)


def _asof(spark, sf_dir, period, age):
    found = pf.fresh_signals(hourly_signals(spark, sf_dir), age, period)
    return round_doubles(found.select("cycle_ts", "symbol", "signal_ts", "close", "marker_final_score"))


@register("h08_asof_5min", _ASOF_SQL.replace("{period}", "300").replace("{age}", "9000"))
def h08_asof_5min(spark, sf_dir):
    """C10 + H8: cycles every 300 s that see signals of up to two and a half hours."""
    return _asof(spark, sf_dir, 300, 9000)


@register("h08_asof_days_old", _ASOF_SQL.replace("{period}", "7200").replace("{age}", "100000").replace("(SELECT min(ts) FROM m)", "(SELECT date_trunc('day', min(ts)) FROM m)"))
def h08_asof_days_old(spark, sf_dir):
    """C10 + H8: an age of more than a day, beyond the end of the signals too."""
    return _asof(spark, sf_dir, 7200, 100_000)


@register("k05_rebalance_triggers", _PF_SQL + "SELECT " + r6_select(pf.ORDER_COLS, {"price", "dollar_amount", "target_weight", "current_weight", "signal_score", "signal_strength", "confidence"}) + " FROM ords WHERE cycle = 3")
def k05_rebalance_triggers(spark, sf_dir):
    """K5 + B12 + B13: three triggers, each one cycle from the state before; the pending orders are the third's."""
    from tickwise.session import cut_lineage, shared_path
    from tickwise.streaming import engine

    run = engine.Rebalancer(shared_path(spark, "rebalance"), period_s=pf.DAY_S, max_age_s=pf.DEFAULT_MAX_AGE_S)
    run.begin(fx.portfolios(spark, sf_dir), fx.positions(spark, sf_dir))
    day = F.ceil(pf.epoch_micros("ts") / F.lit(float(pf.DAY_S * 1_000_000))).cast("long")
    signals = cut_lineage(hourly_signals(spark, sf_dir).withColumn("_day", day))
    young = cut_lineage(pf.fresh_signals(signals).select("cycle_ts").distinct().orderBy("cycle_ts"))
    days = [r[0] for r in young.select(F.floor(pf.epoch_micros("cycle_ts") / F.lit(pf.DAY_S * 1_000_000))).limit(3).collect()]   # three cycles are the feature
    for n, d in enumerate(sorted(days)):
        run(signals.where(F.col("_day") == d).drop("_day"), n)
    return round_doubles(spark.read.parquet(f"{run.root}/pending").select(*pf.ORDER_COLS))


@register(
    "b13_portfolio_state",
    f"WITH pos AS ({q.POSITIONS}), pf AS ({q.PORTFOLIOS}) SELECT portfolio_id, symbol, shares, {q.r6('avg_price')} AS avg_price, {q.r6('cash')} AS cash, "
    "CAST(0 AS BIGINT) AS trades_used, CAST(7 AS BIGINT) AS cycle FROM pf LEFT JOIN pos USING (portfolio_id)",
)
def b13_portfolio_state(spark, sf_dir):
    """Portfolios with their positions stored and loaded again; those without positions too."""
    from tickwise.session import shared_path

    path = shared_path(spark, "state")
    history = spark.createDataFrame([], "symbol string, signal_history array<double>, price double")
    sk.save_state(fx.portfolios(spark, sf_dir), fx.positions(spark, sf_dir), history, path, 7)
    back = sk.load_state(spark, path)
    out = back["portfolios"].join(back["positions"], "portfolio_id", "left")
    return round_doubles(out.select("portfolio_id", "symbol", "shares", "avg_price", "cash", "trades_used", "cycle"))


@register(
    "f03_portfolio_valuation",
    _PF_SQL + "SELECT portfolio_id, cycle, " + q.r6("cash") + " AS cash, " + q.r6("total_value") + " AS total_value, position_count, "
    + q.r6("CASE WHEN total_value > 0 THEN cash / total_value ELSE 1.0 END") + " AS cash_percentage FROM pval",
)
def f03_portfolio_valuation(spark, sf_dir):
    """F2 + F3 + F4: every portfolio at every cycle, positions marked to the freshest close."""
    out = rebalance_all(spark, sf_dir)["portfolios"]
    return round_doubles(out.select("portfolio_id", "cycle", "cash", "total_value", "position_count", "cash_percentage"))


@register(
    "f12_target_weights",
    _PF_SQL + "SELECT portfolio_id, cycle, symbol, bucket, " + ", ".join(
        q.r6(c) + " AS " + c for c in ["current_weight", "deployable", "target_weight"]) + " FROM cand",
)
def f12_target_weights(spark, sf_dir):
    """buy/hold/sell buckets, deployable capital and target weights."""
    c = rebalance_all(spark, sf_dir)["candidates"]
    return round_doubles(c.select("portfolio_id", "cycle", "symbol", "bucket", "current_weight", "deployable", "target_weight"))


ORDER_DOUBLES = {"price", "dollar_amount", "target_weight", "current_weight", "signal_score", "signal_strength", "confidence"}


@register("f21_rebalance_orders", _PF_SQL + "SELECT " + r6_select(pf.ORDER_COLS, ORDER_DOUBLES) + " FROM ords")
def f21_rebalance_orders(spark, sf_dir):
    """Validated, capped orders for every portfolio and cycle."""
    return round_doubles(rebalance_all(spark, sf_dir)["orders"].select(*pf.ORDER_COLS))


@register(
    "f16_position_order",
    f"WITH {q.enriched_ctes(q.BARS_HOURLY)}, {q.signal_ctes()}, {q.portfolio_ctes(numbered=True)} SELECT " + r6_select(pf.ORDER_COLS, ORDER_DOUBLES) + " FROM ords",
)
def f16_position_order(spark, sf_dir):
    """F16: sells numbered in the order in which the positions were opened."""
    out = pf.rebalance(fx.portfolios(spark, sf_dir), fx.positions(spark, sf_dir, numbered=True), hourly_signals(spark, sf_dir))
    return round_doubles(out["orders"].select(*pf.ORDER_COLS))


@register(
    "f19_order_summary",
    _PF_SQL + "SELECT portfolio_id, cycle, CAST(count_if(action = 'BUY') AS BIGINT) AS buy_orders, "
    + q.r6("coalesce(sum(CASE WHEN action = 'BUY' THEN dollar_amount END), 0.0)") + " AS buy_amount, "
    "CAST(count_if(action = 'SELL') AS BIGINT) AS sell_orders, "
    + q.r6("coalesce(sum(CASE WHEN action = 'SELL' THEN dollar_amount END), 0.0)") + " AS sell_amount, "
    + q.r6("coalesce(sum(CASE WHEN action = 'BUY' THEN dollar_amount END), 0.0) - coalesce(sum(CASE WHEN action = 'SELL' THEN dollar_amount END), 0.0)")
    + " AS net_flow FROM ords GROUP BY 1, 2",
)
def f19_order_summary(spark, sf_dir):
    return round_doubles(pf.order_summary(rebalance_all(spark, sf_dir)["orders"]))


# ---------------------------------------------------------------------------
# 2.L ML preparation (hourly bars; the bench runs the daily scale fixture)
# ---------------------------------------------------------------------------

from tickwise.operators import ml  # noqa: E402

_ML_SQL = f"WITH {q.ml_feature_ctes(q.BARS_HOURLY)} "
ML_DOUBLES = set(ml.FEATURES) | {"target"}


def hourly_prep(spark, sf_dir):
    return ml.prepare(fx.bars_hourly(spark, sf_dir))


@register("d28_ml_features", _ML_SQL + "SELECT symbol, ts, " + r6_select(ml.FEATURES + ["target"], ML_DOUBLES) + " FROM mlf")
def d28_ml_features(spark, sf_dir):
    """Whole-history features and next-bar target."""
    feats, lay = ml.ml_features(fx.bars_hourly(spark, sf_dir))
    return round_doubles(lay.own(feats).select("symbol", "ts", *ml.FEATURES, "target"))


@register(
    "c16_clean_report",
    _ML_SQL + "SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST((SELECT count(*) FROM mlc) AS BIGINT) AS rows_after, "
    "CAST(count(*) - (SELECT count(*) FROM mlc) AS BIGINT) AS rows_removed, "
    + q.r6("CAST(count(*) - (SELECT count(*) FROM mlc) AS DOUBLE) / count(*) * 100.0") + " AS pct_removed FROM mlf",
)
def c16_clean_report(spark, sf_dir):
    """C11 + C16: rows removed by dropping incomplete feature rows."""
    feats, lay = ml.ml_features(fx.bars_hourly(spark, sf_dir))
    return round_doubles(ml.clean_report(lay.own(feats)))


@register("l01_chronological_split", _ML_SQL + "SELECT symbol, ts, position, split, split_pos FROM mls")
def l01_chronological_split(spark, sf_dir):
    """L1: 70 / 15 / 15 split per symbol in time order over the cleaned rows."""
    return hourly_prep(spark, sf_dir)["split"].select("symbol", "ts", "position", "split", "split_pos")


@register(
    "g06_split_counts",
    _ML_SQL + "SELECT symbol, split, CAST(count(*) AS BIGINT) AS rows, "
    + q.r6("count(*) / sum(count(*)) OVER (PARTITION BY symbol)") + " AS share FROM mls GROUP BY 1, 2",
)
def g06_split_counts(spark, sf_dir):
    return round_doubles(ml.split_counts(hourly_prep(spark, sf_dir)["split"]))


@register(
    "g07_target_stats",
    _ML_SQL + "SELECT split, " + q.r6("avg(target)") + " AS target_mean, " + q.r6("stddev_samp(target)")
    + " AS target_std, CAST(count(*) AS BIGINT) AS rows FROM mls GROUP BY 1",
)
def g07_target_stats(spark, sf_dir):
    return round_doubles(ml.target_stats(hourly_prep(spark, sf_dir)["split"]))


@register(
    "g08_train_stats",
    _ML_SQL + "SELECT symbol, feature, " + ", ".join(q.r6(c) + " AS " + c for c in ["mean", "std", "min", "max"]) + " FROM mlst",
)
def g08_train_stats(spark, sf_dir):
    """G8 + L2 fit: per symbol and feature statistics of the training rows only."""
    s = hourly_prep(spark, sf_dir)["scalers"]
    return round_doubles(s.select("symbol", "feature", "mean", "std", "min", "max"))


@register("l02_scaled_features", _ML_SQL + "SELECT symbol, ts, split, " + r6_select(ml.FEATURES, set(ml.FEATURES)) + " FROM mlz")
def l02_scaled_features(spark, sf_dir):
    """L2 + H6: standard scaling per symbol with scalers fitted on the training split."""
    z = hourly_prep(spark, sf_dir)["scaled"]
    return round_doubles(z.select("symbol", "ts", "split", *ml.FEATURES))


_SEQ_SQL = (
    _ML_SQL + ", seq AS (SELECT *, list([" + ", ".join(ml.FEATURES) + "]) OVER (PARTITION BY symbol, split ORDER BY ts "
    "ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS X FROM mlz) "
)


@register(
    "l04_sequences",
    _SEQ_SQL + "SELECT symbol, split, ts, " + q.r6("target") + " AS y, CAST(len(X) AS INTEGER) AS steps, "
    + q.r6("X[1][4]") + " AS first_close, " + q.r6("X[60][4]") + " AS last_close, "
    + q.r6("list_reduce(flatten(X), lambda a, b: a + b, CAST(0.0 AS DOUBLE))") + " AS x_sum "
    "FROM seq WHERE split_pos >= 60 AND len(X) = 60",
)
def l04_sequences(spark, sf_dir):
    """L4 + D24: 60 x 21 windows inside each split (summarised: size, first/last close, sum of all values)."""
    s = hourly_prep(spark, sf_dir)["sequences"]
    ci = ml.FEATURES.index("close")
    return round_doubles(s.select(
        "symbol", "split", "ts", F.col("y"), F.size("X").alias("steps"),
        F.element_at(F.element_at("X", 1), ci + 1).alias("first_close"),
        F.element_at(F.element_at("X", -1), ci + 1).alias("last_close"),
        F.aggregate(F.flatten("X"), F.lit(0.0), lambda a, b: a + b).alias("x_sum"),
    ))


@register(
    "l05_inference_windows",
    _ML_SQL + "SELECT symbol, CAST(count(*) AS INTEGER) AS steps, count(*) = 60 AS ready, "
    + q.r6("arg_max(close, ts)") + " AS last_close FROM (SELECT * FROM mlz WHERE position >= n_sym - 60) GROUP BY symbol",
)
def l05_inference_windows(spark, sf_dir):
    """Newest 60 scaled rows per symbol."""
    w = ml.inference_windows(hourly_prep(spark, sf_dir)["scaled"])
    ci = ml.FEATURES.index("close")
    return round_doubles(w.select("symbol", F.size("X").alias("steps"), "ready",
                                  F.element_at(F.element_at("X", -1), ci + 1).alias("last_close")))


_PCT = ml.FEATURES.index("price_change_pct")
_EVAL_SQL = (
    _SEQ_SQL + ", pr AS (SELECT s.target AS y, X[60][" + str(_PCT + 1) + "] * (CASE WHEN t.std < "
    + q.d(10 * 2.220446049250313e-16) + " THEN 1.0 ELSE t.std END) + t.mean AS prediction "
    "FROM seq s JOIN mlst t ON t.symbol = s.symbol AND t.feature = 'price_change_pct' "
    "WHERE s.split = 'test' AND s.split_pos >= 60 AND len(s.X) = 60) "
)


def hourly_predictions(spark, sf_dir):
    """Naive model (last step's percent change, unscaled) on the test sequences."""
    prep = hourly_prep(spark, sf_dir)
    seqs = prep["sequences"].filter(F.col("split") == "test")
    scored = ml.score(seqs, ml.naive_last_change_model(_PCT), name="_p")
    sc = prep["scalers"].filter(F.col("feature") == "price_change_pct").select("symbol", "center", "scale")
    return scored.join(F.broadcast(sc), "symbol").withColumn("prediction", F.col("_p") * F.col("scale") + F.col("center"))


@register(
    "l07_regression_metrics",
    _EVAL_SQL + "SELECT " + q.r6("avg((y - prediction) * (y - prediction))") + " AS mse, " + q.r6("avg(abs(y - prediction))")
    + " AS mae, " + q.r6("avg(abs((y - prediction) / (y + 1e-10))) * 100.0") + " AS mape, CAST(count(*) AS BIGINT) AS n, "
    + q.r6("sqrt(avg((y - prediction) * (y - prediction)))") + " AS rmse FROM pr",
)
def l07_regression_metrics(spark, sf_dir):
    """L6 + L7 + G10: score the test split with the naive model and measure it."""
    return round_doubles(ml.regression_metrics(hourly_predictions(spark, sf_dir)))


@register(
    "g12_error_histogram",
    _EVAL_SQL + ", er AS (SELECT prediction - y AS error FROM pr), b AS (SELECT min(error) AS lo, max(error) AS hi FROM er) "
    "SELECT CAST(i AS INTEGER) AS bin, CAST(count(error) AS BIGINT) AS count FROM range(50) t(i) LEFT JOIN (SELECT error, "
    "least(floor((error - lo) / ((hi - lo) / 50.0)), 49) AS k FROM er, b) ON k = i GROUP BY 1",
)
def g12_error_histogram(spark, sf_dir):
    """G11 + G12: per-sample errors in 50 equal-width bins."""
    errs = ml.sample_errors(hourly_predictions(spark, sf_dir))
    return ml.error_histogram(errs).select("bin", "count")


# ---------------------------------------------------------------------------
# 2.A / 2.B / 2.C / 2.G / 2.I: documents, messages, sinks, reports
# ---------------------------------------------------------------------------

from tickwise.operators import clean as cl  # noqa: E402
from tickwise.operators import reports as rp  # noqa: E402
from tickwise.sources import ingest as ig  # noqa: E402
from tickwise.sources import sinks as sk  # noqa: E402

_MSG_SQL = (
    f"WITH bars AS ({q.BARS_HOURLY}), "
    "o AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS BIGINT) AS ordinal FROM bars), "
    "m AS (SELECT symbol, ts, open, high, low, close, volume, date, time, CAST(ordinal % 3 AS INTEGER) AS \"partition\", "
    "CAST(ordinal // 3 AS BIGINT) AS \"offset\", strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(ordinal), '%Y-%m-%dT%H:%M:%S') AS doc_ts FROM o) "
)
MSG_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume", "date", "time", "partition", "offset", "doc_ts"]


def hourly_messages(spark, sf_dir):
    """H7 -> B7 -> A2 -> A3: bars as wide documents, as messages, decoded and exploded again."""
    docs = ig.documents_wide(fx.bars_hourly(spark, sf_dir))
    return ig.explode_bars(ig.decode_messages(ig.to_messages(docs)))


@register("a03_explode_messages", _MSG_SQL + "SELECT " + r6_select(MSG_COLS, BAR_DOUBLES).replace("partition,", '"partition",').replace("offset,", '"offset",') + " FROM m")
def a03_explode_messages(spark, sf_dir):
    """H7 + B7 + A2 + A3: the document / message round trip returns every bar once."""
    return round_doubles(hourly_messages(spark, sf_dir).select(*MSG_COLS))


@register(
    "b01_latest_per_symbol",
    _MSG_SQL + "SELECT " + r6_select(MSG_COLS, BAR_DOUBLES).replace("partition,", '"partition",').replace("offset,", '"offset",')
    + ' FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, "partition" DESC, "offset" DESC) = 1',
)
def b01_latest_per_symbol(spark, sf_dir):
    """B1: newest bar per symbol, ties on time to the later arrival."""
    return round_doubles(sk.latest_per_symbol(hourly_messages(spark, sf_dir).select(*MSG_COLS)).select(*MSG_COLS))


@register(
    "b08_write_stats",
    _MSG_SQL + "SELECT CAST(count_if(ts IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL) AS BIGINT) AS accepted, "
    "CAST(count_if(NOT (ts IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL)) AS BIGINT) AS rejected, "
    "CAST(count(DISTINCT symbol) AS BIGINT) AS symbols, "
    + q.r6("count_if(ts IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL) / count(*) * 100.0") + " AS success_pct FROM m",
)
def b08_write_stats(spark, sf_dir):
    """Sink acceptance statistics of a decoded batch."""
    return round_doubles(sk.write_stats(hourly_messages(spark, sf_dir)))


@register("a14_list_symbols", f"SELECT DISTINCT symbol FROM ({q.BARS_DAILY}) ORDER BY symbol")
def a14_list_symbols(spark, sf_dir):
    return ig.list_symbols(fx.bars_daily(spark, sf_dir))


@register("g01_rows_per_symbol", f"SELECT symbol, CAST(count(*) AS BIGINT) AS rows FROM ({q.BARS_DAILY}) GROUP BY 1")
def g01_rows_per_symbol(spark, sf_dir):
    return rp.rows_per_symbol(fx.bars_daily(spark, sf_dir))


@register(
    "g02_symbol_set",
    f"SELECT CAST(count(DISTINCT symbol) AS BIGINT) AS symbols, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbol_list FROM ({q.BARS_DAILY})",
)
def g02_symbol_set(spark, sf_dir):
    s = rp.symbol_set(fx.bars_daily(spark, sf_dir))
    return s.select("symbols", F.array_join("symbol_list", ",").alias("symbol_list"))


@register("g03_date_range", f"SELECT min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS rows FROM ({q.BARS_DAILY})")
def g03_date_range(spark, sf_dir):
    return rp.date_range(fx.bars_daily(spark, sf_dir))


@register(
    "g04_count_in_range",
    f"SELECT symbol, CAST(count(*) AS BIGINT) AS rows FROM ({q.BARS_HOURLY}) WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1",
)
def g04_count_in_range(spark, sf_dir):
    """Rows of one day per symbol (the verification query after a write)."""
    import datetime as dt
    return rp.count_in_range(fx.bars_hourly(spark, sf_dir), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11))


@register(
    "g05_first_record",
    f"SELECT symbol, ts, {r6_select(['open','high','low','close','volume'], BAR_DOUBLES)}, date, time, (SELECT CAST(count(*) AS BIGINT) FROM ({q.BARS_HOURLY})) AS rows "
    f"FROM ({q.BARS_HOURLY}) ORDER BY ts, symbol LIMIT 1",
)
def g05_first_record(spark, sf_dir):
    return round_doubles(rp.first_record(fx.bars_hourly(spark, sf_dir)))


@register(
    "i05_top_volume_bars",
    f"SELECT symbol, ts, {q.r6('volume')} AS volume FROM ({q.BARS_DAILY}) ORDER BY volume DESC, symbol, ts LIMIT 5",
)
def i05_top_volume_bars(spark, sf_dir):
    """I4 + I5: top-k report (the limit is the feature)."""
    return round_doubles(rp.top_k(fx.bars_daily(spark, sf_dir).select("symbol", "ts", "volume"), 5, F.desc("volume"), "symbol", "ts"))


@register(
    "i06_tail_per_symbol",
    f"SELECT symbol, ts, {q.r6('close')} AS close FROM ({q.BARS_DAILY}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10",
)
def i06_tail_per_symbol(spark, sf_dir):
    """I6 + I7: newest 10 bars per symbol."""
    return round_doubles(rp.tail_per_symbol(fx.bars_daily(spark, sf_dir).select("symbol", "ts", "close"), 10))


@register(
    "c15_profile",
    f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count_if(volume < 100) AS BIGINT) AS matching, count_if(volume < 100) > 0 AS exists FROM ({q.BARS_HOURLY})",
)
def c15_profile(spark, sf_dir):
    """Filtered count / existence (low-volume hourly bars)."""
    return cl.profile(fx.bars_hourly(spark, sf_dir), "volume < 100")


@register(
    "f20_holdings_report",
    _PF_SQL + "SELECT m.portfolio_id, m.symbol, m.shares, " + ", ".join(q.r6(e) + " AS " + n for e, n in [
        ("m.current_price", "current_price"), ("m.market_value", "market_value"),
        (q.tdiv("m.market_value", "v.total_value"), "weight"), ("(m.current_price - m.avg_price) * CAST(m.shares AS DOUBLE)", "unrealized_pnl"),
        ("CASE WHEN m.avg_price > 0 THEN (m.current_price - m.avg_price) / m.avg_price ELSE 0.0 END", "unrealized_pnl_pct")])
    + " FROM posm m JOIN pval v ON v.portfolio_id = m.portfolio_id AND v.cycle = m.cycle WHERE m.cycle = (SELECT max(cycle) FROM cyc)",
)
def f20_holdings_report(spark, sf_dir):
    """F2 + F20: holdings at the last cycle with weight and unrealised P&L."""
    out = rebalance_all(spark, sf_dir)
    last = out["fresh"].agg(F.max("cycle")).first()[0]
    pos = pf.position_valuation(out["positions"].filter(F.col("cycle") == last))
    val = out["portfolios"].filter(F.col("cycle") == last).select("portfolio_id", "total_value")
    rep = pos.join(val, "portfolio_id").withColumn("weight", F.try_divide("market_value", "total_value"))
    return round_doubles(rep.select("portfolio_id", "symbol", "shares", "current_price", "market_value", "weight",
                                    "unrealized_pnl", "unrealized_pnl_pct"))


@register(
    "c08_quality_flags",
    f"WITH {q.enriched_ctes(q.BARS_HOURLY)} SELECT symbol, ts, concat_ws(',', "
    "CASE WHEN volume < 100 THEN 'low_volume' END, CASE WHEN atr_14 <= 0 THEN 'bad_atr' END, "
    "CASE WHEN bb_upper <= bb_lower THEN 'bad_bands' END, "
    "CASE WHEN rsi_14 IS NULL OR rsi_14 < 0 OR rsi_14 > 100 THEN 'bad_rsi' END) AS flags FROM enr WHERE rn >= 35 AND n_sym >= 60",
)
def c08_quality_flags(spark, sf_dir):
    """The reference's data warnings as a column (rows are kept)."""
    enr = ind.warm_rows(flows.enriched_bars(fx.bars_hourly(spark, sf_dir)))
    return sg.quality_flags(enr).select("symbol", "ts", F.array_join("quality_flags", ",").alias("flags"))


@register(
    "c13_head_per_symbol",
    f"SELECT symbol, ts, {q.r6('close')} AS close FROM ({q.BARS_TICK}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) <= 52000",
)
def c13_head_per_symbol(spark, sf_dir):
    """First 52,000 bars per symbol (the document build's per-file row limit)."""
    return round_doubles(cl.head_per_symbol(fx.bars_tick(spark, sf_dir).select("symbol", "ts", "close")))


@register(
    "h07_documents_wide",
    f"WITH bars AS ({q.BARS_HOURLY}), o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ordinal FROM bars) "
    "SELECT CAST(ordinal AS BIGINT) AS ordinal, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(ordinal) AS timestamp, "
    "CAST(count(*) AS INTEGER) AS entries, array_to_string(list_sort(list(symbol || '.csv')), ',') AS files, "
    + q.r6("sum(close)") + " AS close_sum FROM o GROUP BY ordinal",
)
def h07_documents_wide(spark, sf_dir):
    """H7: ordinal alignment of the symbol tables into wide documents (a short table has no entry)."""
    docs = ig.documents_wide(fx.bars_hourly(spark, sf_dir))
    closes = F.transform(F.array_sort(F.map_keys("bars")), lambda k: F.element_at(F.col("bars"), k)["close"])
    return round_doubles(docs.select(
        "ordinal", "timestamp", F.size("bars").alias("entries"),
        F.array_join(F.array_sort(F.map_keys("bars")), ",").alias("files"),
        F.aggregate(closes, F.lit(0.0), lambda a, x: a + x).alias("close_sum"),
    ))


@register(
    "b07_message_keys",
    f"WITH bars AS ({q.BARS_HOURLY}), o AS (SELECT DISTINCT row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ordinal FROM bars) "
    "SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(ordinal), '%Y-%m-%dT%H:%M:%S') AS key, "
    'CAST(ordinal % 3 AS INTEGER) AS "partition", CAST(ordinal // 3 AS BIGINT) AS "offset" FROM o',
)
def b07_message_keys(spark, sf_dir):
    """Message key (ISO time), partition and offset of every document."""
    return ig.to_messages(ig.documents_wide(fx.bars_hourly(spark, sf_dir))).select("key", "partition", "offset")


@register(
    "c01_normalized_bars",
    _MSG_SQL + "SELECT symbol, ts, coalesce(date, '') AS date, coalesce(time, '') AS time, "
    'coalesce("partition", 0) AS "partition", coalesce("offset", 0) AS "offset", strptime(doc_ts, \'%Y-%m-%dT%H:%M:%S\') AS doc_time FROM m',
)
def c01_normalized_bars(spark, sf_dir):
    """C1 + C3: normalised decoded bars and the document time parsed from ISO text."""
    out = cl.normalize_bars(hourly_messages(spark, sf_dir))
    return out.select("symbol", "ts", "date", "time", "partition", "offset", cl.parse_ts("doc_ts").alias("doc_time"))


# ---------------------------------------------------------------------------
# 2.K streaming: the stream must give the batch tables (same oracles)
# ---------------------------------------------------------------------------

MSG_SCHEMA = "key string, value string, partition int, offset long, timestamp timestamp_ntz"


def arrived(msgs, number):
    """Messages as the broker takes them in: partition, offset and time follow from the arrival ``number`` (from 0)."""
    taken = msgs.withColumn("_n", number)
    return taken.select("key", "value", (F.col("_n") % 3).cast("int").alias("partition"), F.floor(F.col("_n") / 3).cast("long").alias("offset"),
                        (F.lit(ig.DOC_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("_n").cast("double"))).alias("timestamp"))


def message_number():
    return F.col("offset") * 3 + F.col("partition")


def drained(spark, sf_dir, sinks, number=None, again=0, dedupe=False):
    """K1: the hourly bars' messages taken from a folder in two runs of one stream; the output folder.

    The first run takes what is there and ends, then the other messages come
    and the second run goes on from the checkpoint.  ``again`` messages of the
    first part come once more with the second.
    """
    from tickwise.session import cut_lineage, shared_path
    from tickwise.streaming import engine

    root = shared_path(spark, "stream")
    msgs = ig.to_messages(ig.documents_wide(fx.bars_hourly(spark, sf_dir)))
    msgs = cut_lineage(arrived(msgs, message_number() if number is None else number(message_number())))
    first = 75
    for low, high in ((0, first), (first, None)):
        part = msgs.where(message_number() >= low - (again if low else 0))
        (part.where(message_number() < high) if high else part).write.mode("append").parquet(f"{root}/messages")
        stream = engine.bars_from_messages(spark, f"{root}/messages", max_per_trigger=1000, schema=MSG_SCHEMA, dedupe=dedupe,
                                           watermark="1 hour" if dedupe else None)
        engine.start(stream, f"{root}/out", {"availableNow": True}, sinks, state_partitions=8).awaitTermination()
    return f"{root}/out"


@register("k02_stream_enriched_hourly", ORACLE["d27_enriched_hourly"])
def k02_stream_enriched_hourly(spark, sf_dir):
    """K1 + K2: rows released by the streaming warm-up gate equal the batch D27 rows."""
    out = drained(spark, sf_dir, ("enriched",))
    return round_doubles(spark.read.parquet(f"{out}/enriched").select(*ENR_COLS))


@register("k04_stream_signals_hourly", ORACLE["e11_signal_table_hourly"])
def k04_stream_signals_hourly(spark, sf_dir):
    """K4: signals produced by the stream equal the batch E11 table."""
    out = drained(spark, sf_dir, ("signals",))
    return round_doubles(spark.read.parquet(f"{out}/signals").select(*sg.SIGNAL_OUT))


def late(number):
    """Bars 70 and 71 of every symbol come after bar 79."""
    return F.when(number.isin(69, 70), number + 8).when(number.between(71, 78), number - 2).otherwise(number)


_LATE_BARS = (
    "SELECT symbol, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CASE WHEN n IN (69, 70) THEN n + 8 WHEN n BETWEEN 71 AND 78 THEN n - 2 ELSE n END) AS ts, "
    "open, high, low, close, volume, date, time FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM ({q.BARS_HOURLY}))"
)


def _own_time(cols):
    """The bars' own time again, which their text columns hold."""
    return cols.replace("ts,", "strptime(date || ' ' || time, '%Y%m%d %H:%M') AS ts,", 1)


@register(
    "k07_late_bars",
    f"WITH {q.enriched_ctes(_LATE_BARS)} SELECT {_own_time(r6_select(ENR_COLS, ENR_DOUBLES))} FROM enr WHERE rn >= 35 AND n_sym >= 60",
)
def k07_late_bars(spark, sf_dir):
    """K3 + K7: late bars take the next numbers, and the windows run over numbers."""
    out = drained(spark, sf_dir, ("enriched",), late)
    return round_doubles(spark.read.parquet(f"{out}/enriched").select(*ENR_COLS))


@register(
    "k07_late_signals",
    f"WITH {q.enriched_ctes(_LATE_BARS)}, {q.signal_ctes()} SELECT {_own_time(r6_select(sg.SIGNAL_OUT, SIG_DOUBLES))} FROM sig",
)
def k07_late_signals(spark, sf_dir):
    """K4 + K7: signals of a stream with late bars."""
    out = drained(spark, sf_dir, ("signals",), late)
    return round_doubles(spark.read.parquet(f"{out}/signals").select(*sg.SIGNAL_OUT))


@register("k09_duplicates", ORACLE["d27_enriched_hourly"])
def k09_duplicates(spark, sf_dir):
    """K9: 40 messages are delivered again after a restart; every bar counts once."""
    out = drained(spark, sf_dir, ("enriched",), again=40, dedupe=True)
    return round_doubles(spark.read.parquet(f"{out}/enriched").select(*ENR_COLS))


_FAN_SQL = (
    f"WITH {q.enriched_ctes(q.BARS_HOURLY)}, {q.signal_ctes()}, lb AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), "
    "ls AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), "
    "u AS (SELECT 'audit' AS sink, symbol, close FROM bars UNION ALL SELECT 'bar_points', symbol, close FROM bars UNION ALL SELECT 'bars', symbol, close FROM bars "
    "UNION ALL SELECT 'enriched', symbol, close FROM enr WHERE is_enriched UNION ALL SELECT 'latest_bar', symbol, close FROM lb "
    "UNION ALL SELECT 'latest_signal', symbol, close FROM ls UNION ALL SELECT 'signal_points', symbol, close FROM sig UNION ALL SELECT 'signals', symbol, close FROM sig) "
)


def sink_rows(spark, out):
    """(sink, symbol, close) of every table that a stream with all sinks has written."""
    latest = lambda name: spark.read.parquet(f"{out}/{name}").where(F.col("v") == F.lit(spark.read.parquet(f"{out}/{name}").agg(F.max("v")).first()[0]))
    audit = spark.read.text(f"{out}/audit").select(F.from_json("value", "data struct<symbol:string,close:double>").alias("j")).select("j.data.symbol", "j.data.close")
    tables = {n: spark.read.parquet(f"{out}/{n}") for n in ("enriched", "signals", "bar_points", "signal_points", "bars")}
    tables |= {n: latest(n) for n in ("latest_bar", "latest_signal")} | {"audit": audit}
    parts = [t.select(F.lit(n).alias("sink"), "symbol", "close") for n, t in sorted(tables.items())]
    return rp.union_all(*parts)


@register("k06_fan_out", _FAN_SQL + f"SELECT sink, symbol, CAST(count(*) AS BIGINT) AS rows, {q.r6('sum(floor(close * 1e6 + 0.5)) / 1e6')} AS close_sum FROM u GROUP BY 1, 2")
def k06_fan_out(spark, sf_dir):
    """K6 + B1-B6: one stream feeds every sink; rows and closes of each table by symbol."""
    from tickwise.streaming import engine

    rows = sink_rows(spark, drained(spark, sf_dir, engine.SINKS))
    whole = F.sum(F.floor(F.col("close") * 1e6 + 0.5)) / 1e6
    return round_doubles(rows.groupBy("sink", "symbol").agg(F.count(F.lit(1)).alias("rows"), whole.alias("close_sum")))


# ---------------------------------------------------------------------------
# 2.A file paths: bars written as the reference's raw lines / CSV and read back
# ---------------------------------------------------------------------------

def _raw_lines(bars):
    """BAR rows as the reference's 8-field text lines (Type,Date,Time,o,h,l,c,v)."""
    return bars.select("symbol", F.concat_ws(",", "symbol", "date", "time", *[F.col(c).cast("string") for c in
                                                                            ("open", "high", "low", "close", "volume")]).alias("value"))


@register(
    "a05_line_quality",
    f"SELECT symbol, CAST(count(*) AS BIGINT) AS valid_lines, CAST(3 * count(DISTINCT symbol) AS BIGINT) AS invalid_lines, CAST(CASE WHEN symbol IS NULL THEN 1 ELSE 0 END AS BIGINT) AS skipped_files FROM ({q.BARS_HOURLY}) GROUP BY ROLLUP (symbol)",
)
def a05_line_quality(spark, sf_dir):
    """A4 + A5 + G9: raw lines per symbol folder validated (exactly 8 fields), with a total row."""
    from tickwise.session import shared_path

    path = shared_path(spark, "lines")
    bars = fx.bars_hourly(spark, sf_dir)
    bad = F.array(F.concat("symbol", F.lit(",20240101,00:00,1,2,3,4")), F.concat("symbol", F.lit(",20240101,00:00,1,2,3,4,5,6")), F.lit(" "))
    _raw_lines(bars).unionByName(bars.select("symbol").distinct().select("symbol", F.explode(bad).alias("value"))).write.partitionBy("symbol").text(path)
    _empty_file(spark, f"{path}/symbol=click/none.txt")
    files = ig.line_quality(ig.read_bar_lines(spark, path), spark, path)
    symbol = F.when(F.col("file_path").isNotNull(), F.regexp_extract("file_path", r"/symbol=([^/]+)/", 1))
    return files.groupBy(symbol.alias("symbol")).agg(F.sum("valid_lines").alias("valid_lines"), F.sum("invalid_lines").alias("invalid_lines"),
                                                     F.sum("skipped_files").alias("skipped_files"))


def _empty_file(spark, path):
    hp, fs = sk._folder(spark, path)
    fs.create(hp).close()


def _symbol_texts(spark, sf_dir, path):
    """One text file per symbol (a line per bar: the symbol), and an empty file that bears the unwanted name."""
    lines = fx.bars_hourly(spark, sf_dir).select("symbol", F.col("symbol").alias("value"))
    lines.repartition("symbol").write.partitionBy("symbol").text(path)
    _empty_file(spark, f"{path}/symbol=none/x_NIFTY50_y.CSV")


@register(
    "a09_inventory",
    f"WITH f AS (SELECT 'txt' AS ext, symbol, sum(length(symbol) + 1) AS b, 0 AS m FROM ({q.BARS_HOURLY}) GROUP BY 2 UNION ALL SELECT 'csv', 'none', 0, 1) "
    "SELECT ext, CAST(count(*) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes, CAST(CASE WHEN ext IS NULL THEN sum(m) END AS BIGINT) AS matching, "
    f"CASE WHEN ext IS NULL THEN {q.r6('sum(m) / count(*) * 100.0')} END AS matching_pct FROM f GROUP BY ROLLUP (ext)",
)
def a09_inventory(spark, sf_dir):
    """Files, bytes and matching names in all and by extension; an empty file counts."""
    from tickwise.session import shared_path

    path = shared_path(spark, "inventory")
    _symbol_texts(spark, sf_dir, path)
    found = ig.file_inventory(spark, path)
    return round_doubles(rp.union_all(found["by_ext"], found["totals"]))


@register(
    "a11_provenance_names",
    f"SELECT 'in_symbol=' || symbol || '_part.txt' AS name FROM (SELECT DISTINCT symbol FROM ({q.BARS_HOURLY})) "
    "UNION ALL SELECT 'in_symbol=none_x_NIFTY50_y.CSV'",
)
def a11_provenance_names(spark, sf_dir):
    """Names of root folder, folders and file (the writer's own part of a name cut out)."""
    from tickwise.session import shared_path

    path = f"{shared_path(spark, 'names')}/in"
    _symbol_texts(spark, sf_dir, path)
    names = ig.provenance_names(ig.file_listing(spark, path, empty=True), path)
    return names.select(F.regexp_replace("new_name", r"part-.*\.txt$", "part.txt").alias("name"))


@register(
    "a08_csv_round_trip",
    f"SELECT symbol, ts, {r6_select(['open','high','low','close','volume'], BAR_DOUBLES)}, date, time FROM ({q.BARS_HOURLY})",
)
def a08_csv_round_trip(spark, sf_dir):
    """B9 + A6 + A8: bars as reference-layout CSV with header, header detected, ts from Date + Time."""
    from tickwise.session import shared_path

    path = shared_path(spark, "csv")
    bars = fx.bars_hourly(spark, sf_dir)
    ref = bars.select(F.col("symbol").alias("Type"), F.col("date").cast("long").alias("Date"), F.col("time").alias("Time"),
                      "open", "high", "low", "close", "volume")
    ref.write.option("header", "true").csv(path)
    back = ig.load_bars(ig.read_bars_csv(spark, path))
    return round_doubles(back)


_CSV_SQL = f"SELECT symbol, ts, {r6_select(['open','high','low','close','volume'], BAR_DOUBLES)}, date, time FROM ({q.BARS_HOURLY})"


def _csv_record(bars):
    return bars.select(F.col("symbol").alias("Type"), F.col("date").cast("long").alias("Date"), F.col("time").alias("Time"),
                       "open", "high", "low", "close", "volume")


@register("a06_mixed_headers", _CSV_SQL)
def a06_mixed_headers(spark, sf_dir):
    """A6 + A8: one folder of CSV files with and without a header; no bar is lost."""
    from tickwise.session import shared_path

    path = shared_path(spark, "mixed")
    bars = fx.bars_hourly(spark, sf_dir)
    for header in (True, False):
        part = bars.where((F.hour("ts") < 12) == F.lit(header))
        _csv_record(part).write.option("header", str(header).lower()).csv(f"{path}/header={header}")
    return round_doubles(ig.load_bars(ig.read_bars_csv(spark, path, "*.csv")))


def _ordered_csv(bars, path):
    """The same bars in three folders of CSV files whose headers name the columns in three orders."""
    record = _csv_record(bars).withColumn("note", F.lit("a, b"))
    orders = [record.columns, ["Date", "Time", "close", "Type", "volume", "low", "high", "open"], sorted(record.columns, reverse=True)]
    for k, order in enumerate(orders):
        record.where(F.pmod(F.hash("Time"), F.lit(3)) == k).select(*order).write.option("header", "true").csv(f"{path}/order={k}")


@register("a06_column_orders", _CSV_SQL)
def a06_column_orders(spark, sf_dir):
    """A6 + A8: columns go by the names in each file's header, whatever their order, and other columns are left out."""
    from tickwise.session import shared_path

    path = shared_path(spark, "orders")
    _ordered_csv(fx.bars_hourly(spark, sf_dir), path)
    return round_doubles(ig.load_bars(ig.read_bars_csv(spark, path, "*.csv")))


_TAKEN = ["click", "view", "NONE"]


@register(
    "a07_symbol_folders",
    f"SELECT s AS symbol, CAST(count(b.symbol) AS BIGINT) AS rows, {q.r6('coalesce(sum(b.close), 0.0)')} AS close_sum, count(b.symbol) = 0 AS missing "
    f"FROM (VALUES ('click'), ('view'), ('NONE')) t(s) LEFT JOIN ({q.BARS_HOURLY}) b ON b.symbol = s GROUP BY 1",
)
def a07_symbol_folders(spark, sf_dir):
    """Chosen symbol folders (``x.txt`` or ``x``, files also in subfolders), one with and one without headers, and the missing symbol."""
    from tickwise.session import shared_path

    path = shared_path(spark, "folders")
    bars = fx.bars_hourly(spark, sf_dir)
    for symbol, folder, header in (("click", "click.txt", "true"), ("view", "more/view", "false"), ("error", "error", "true")):
        own = bars.where(F.col("symbol") == symbol)
        for half in (0, 1):
            _csv_record(own.where((F.hour("ts") < 12) == F.lit(half == 0))).write.option("header", header).csv(f"{path}/{folder}/part {half}")
    found, missing = ig.read_symbol_folders(spark, path, _TAKEN)
    per = found.groupBy(F.col("folder_symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("close_sum"))
    none = missing.select(F.col("folder_symbol").alias("symbol"), F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("close_sum"))
    return round_doubles(per.withColumn("missing", F.lit(False)).unionByName(none.withColumn("missing", F.lit(True))))


@register(
    "a12_rows_per_file",
    f"SELECT CAST(count(*) AS BIGINT) AS rows, true AS every_file FROM ({q.BARS_HOURLY})",
)
def a12_rows_per_file(spark, sf_dir):
    """B9 + A12: per-symbol Parquet tables; the files' row counts add up and no file of equal name is merged."""
    from tickwise.session import shared_path

    path = shared_path(spark, "tables")
    sk.write_symbol_tables(fx.bars_hourly(spark, sf_dir), path)
    files = ig.rows_per_file(spark, path)
    listed = ig.file_listing(spark, path, "*.parquet").agg(F.count(F.lit(1)).alias("files"))
    got = files.agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("n"))
    return got.join(F.broadcast(listed)).select("rows", (F.col("n") == F.col("files")).alias("every_file"))


@register(
    "a10_exclude_sources",
    f"SELECT symbol, CAST(count(*) AS BIGINT) AS rows FROM ({q.BARS_HOURLY}) WHERE symbol NOT LIKE '%ie%' GROUP BY 1",
)
def a10_exclude_sources(spark, sf_dir):
    """A4 + A10: raw lines of files whose path names an unwanted source are left out."""
    from tickwise.session import shared_path

    path = shared_path(spark, "sources")
    _raw_lines(fx.bars_hourly(spark, sf_dir)).write.partitionBy("symbol").text(path)
    lines = ig.read_bar_lines(spark, path).withColumn("folder", F.element_at(F.split("file_path", "/"), -2))
    kept = ig.exclude_sources(lines, "IE", col="folder")
    return ig.parse_bar_lines(kept).groupBy(F.col("Type").alias("symbol")).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "b02_points",
    f"SELECT symbol, CAST(count(*) AS BIGINT) AS points, {q.r6('sum(close)')} AS close_sum, CAST(count(DISTINCT strftime(ts, '%Y-%m-%d')) AS BIGINT) AS days "
    f"FROM ({q.BARS_HOURLY}) GROUP BY 1",
)
def b02_points(spark, sf_dir):
    """B2: bar points appended by measurement and day, read back."""
    from tickwise.session import shared_path

    path = shared_path(spark, "points")
    sk.append_points(fx.bars_hourly(spark, sf_dir), path, "bars")
    back = spark.read.parquet(path).where("measurement = 'bars'")
    return round_doubles(back.groupBy("symbol").agg(F.count(F.lit(1)).alias("points"), F.sum("close").alias("close_sum"), F.count_distinct("day").alias("days")))


@register("b04_columnar", _CSV_SQL)
def b04_columnar(spark, sf_dir):
    """B4 + I3: bars appended to the columnar table clustered by symbol and time, read back without the ingest time."""
    from tickwise.session import shared_path

    path = shared_path(spark, "columnar")
    sk.append_columnar(fx.bars_hourly(spark, sf_dir), path)
    return round_doubles(spark.read.parquet(path).drop("inserted_at"))


@register(
    "b06_audit_lines",
    f"SELECT symbol, ts, {q.r6('close')} AS close, CAST(7 AS BIGINT) AS batch_id FROM ({q.BARS_HOURLY})",
)
def b06_audit_lines(spark, sf_dir):
    """B6 + C4: audit JSON lines written as text and parsed again."""
    from tickwise.session import shared_path

    path = shared_path(spark, "audit")
    sk.to_audit_json(fx.bars_hourly(spark, sf_dir), 7).write.text(path)
    schema = "data struct<symbol:string,ts:timestamp_ntz,close:double>, batch_id long"
    back = spark.read.text(path).select(F.from_json("value", schema).alias("j"))
    return round_doubles(back.select("j.data.symbol", "j.data.ts", "j.data.close", "j.batch_id"))


@register(
    "c13_first_hundred",
    f"SELECT symbol, ts, {q.r6('close')} AS close FROM ({q.BARS_DAILY}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) <= 100",
)
def c13_first_hundred(spark, sf_dir):
    """A limit that binds for every symbol."""
    return round_doubles(cl.head_per_symbol(fx.bars_daily(spark, sf_dir).select("symbol", "ts", "close"), 100))


@register(
    "g11_sample_errors",
    _EVAL_SQL + f" SELECT CAST(count(*) AS BIGINT) AS n, {q.r6('avg(prediction - y)')} AS mean_error, "
    f"{q.r6('avg(abs(prediction - y) / (abs(y) + 1e-8) * 100.0 > 50.0)')} AS over_half FROM pr".replace("avg(abs(", "avg(CAST((abs(").replace("> 50.0)", "> 50.0) AS DOUBLE))"),
)
def g11_sample_errors(spark, sf_dir):
    """Error and error percent of every sample."""
    errs = ml.sample_errors(hourly_predictions(spark, sf_dir))
    return round_doubles(errs.agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"),
                                  F.avg((F.col("error_pct") > 50.0).cast("double")).alias("over_half")))


@register(
    "i01_union_missing",
    f"SELECT symbol, CAST(count(*) AS BIGINT) AS rows FROM (SELECT symbol, ts FROM ({q.BARS_HOURLY}) UNION ALL SELECT symbol, ts FROM ({q.BARS_HOURLY}) "
    "WHERE volume < 300) GROUP BY 1",
)
def i01_union_missing(spark, sf_dir):
    """I1 + I2: the rows missing in a part, united by name with that part and one more copy of it."""
    bars = fx.bars_hourly(spark, sf_dir)
    part = bars.where("volume < 300")
    rest = rp.rows_missing_in(bars, part, ["symbol", "ts"])
    return rp.rows_per_symbol(rp.union_all(rest.drop("volume"), part, part.select("symbol", "ts")))


@register(
    "j03_sizes",
    "SELECT CAST(count(*) AS BIGINT) AS rows, '0.50 KB' IS NULL AS none, "
    "CASE WHEN sum(length(props)) < 1024 THEN printf('%.2f B', sum(length(props))) "
    "WHEN sum(length(props)) < 1024 * 1024 THEN printf('%.2f KB', sum(length(props)) / 1024.0) "
    "ELSE printf('%.2f MB', sum(length(props)) / 1048576.0) END AS size FROM events",
)
def j03_sizes(spark, sf_dir):
    """A total of bytes as text."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    total = events.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("props")).alias("b"))
    return total.select("rows", F.lit(False).alias("none"), ig.human_size("b").alias("size"))


# ---------------------------------------------------------------------------
# Operators behind other queries, each on its own
# ---------------------------------------------------------------------------

@register("d28_ml_features_chunked", ORACLE["d28_ml_features"])
def d28_ml_features_chunked(spark, sf_dir):
    """D3 + D6 + D28: every symbol in chunks of about 150 rows; EMA state and last closes go from chunk to chunk."""
    feats, lay = ml.ml_features(fx.bars_hourly(spark, sf_dir), chunk_rows=150, force_chunks=True)
    return round_doubles(lay.own(feats).select("symbol", "ts", *ml.FEATURES, "target"))


_BLANKED = "CASE WHEN hour(ts) % 5 < 3 THEN NULL ELSE {c} END"
_FILL_SQL = (
    _ML_SQL + "SELECT symbol, ts, "
    + ", ".join(q.r6(f"last({_BLANKED.format(c=c)} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
                + f" AS {c}" for c in ml.FEATURES)
    + f", {q.r6('target')} AS target FROM mlf QUALIFY target IS NOT NULL"
)


def _filled(spark, sf_dir, **how):
    feats, lay = ml.ml_features(fx.bars_hourly(spark, sf_dir), **how)
    for c in ml.FEATURES:       # three hours of five are missing
        feats = feats.withColumn(c, F.when(F.hour("ts") % 5 >= 3, F.col(c)))
    return round_doubles(lay.own(ml.clean_features(feats, "fill", lay.spec)).select("symbol", "ts", *ml.FEATURES, "target"))


@register("c12_filled_features", _FILL_SQL)
def c12_filled_features(spark, sf_dir):
    """Features carried forward over missing ones."""
    return _filled(spark, sf_dir)


@register("c12_filled_features_chunked", _FILL_SQL)
def c12_filled_features_chunked(spark, sf_dir):
    """C12 across chunks of about 150 rows."""
    return _filled(spark, sf_dir, chunk_rows=150, force_chunks=True)


@register(
    "l03_minmax_features",
    _ML_SQL + "SELECT m.symbol, m.ts, m.split, "
    + ", ".join(q.r6(f"(m.{c} - w.{c}__min) / (CASE WHEN w.{c}__max - w.{c}__min < {q.d(10 * 2.220446049250313e-16)} THEN 1.0 ELSE w.{c}__max - w.{c}__min END)") + f" AS {c}"
                for c in ml.FEATURES)
    + " FROM mls m JOIN mlw w ON w.symbol = m.symbol",
)
def l03_minmax_features(spark, sf_dir):
    """L3: min-max scaling per symbol with bounds of the training rows."""
    z = ml.prepare(fx.bars_hourly(spark, sf_dir), method="minmax")["scaled"]
    return round_doubles(z.select("symbol", "ts", "split", *ml.FEATURES))


@register(
    "a15_sequence_tables",
    _SEQ_SQL + "SELECT CAST(max(len(X)) AS INTEGER) AS lookback, CAST(max(len(X[1])) AS INTEGER) AS n_features, "
    "array_to_string(list_sort(list(DISTINCT symbol)), ',') AS markers, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, "
    "CAST(count(*) AS BIGINT) AS sequences FROM seq WHERE split_pos >= 60 AND len(X) = 60",
)
def a15_sequence_tables(spark, sf_dir):
    """A15 + B10: sequences stored by split and read again with their metadata."""
    from tickwise.session import shared_path

    path = shared_path(spark, "sequences")
    sk.write_sequences(hourly_prep(spark, sf_dir)["sequences"], path)
    _, meta = ig.read_sequences(spark, path)
    return meta.withColumn("markers", F.array_join("markers", ",")).withColumn("splits", F.array_join("splits", ","))


@register("b11_stored_scalers", ORACLE["g08_train_stats"])
def b11_stored_scalers(spark, sf_dir):
    """Scalers stored and loaded."""
    from tickwise.session import shared_path

    path = shared_path(spark, "scalers")
    sk.save_scalers(hourly_prep(spark, sf_dir)["scalers"], path)
    return round_doubles(sk.load_scalers(spark, path).select("symbol", "feature", "mean", "std", "min", "max"))


@register("a13_documents", f"WITH o AS (SELECT row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ordinal FROM ({q.BARS_HOURLY})) "
          "SELECT CAST(ordinal AS BIGINT) AS place, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(ordinal) AS timestamp, CAST(count(*) AS INTEGER) AS entries FROM o GROUP BY ordinal")
def a13_documents(spark, sf_dir):
    """Stored documents in the order of their time; ``place`` is that of the written rows."""
    from tickwise.session import shared_path

    path = shared_path(spark, "documents")
    ig.documents_wide(fx.bars_hourly(spark, sf_dir)).write.parquet(path)
    ig.read_documents(spark, path).select("timestamp", F.size("bars").alias("entries")).write.parquet(f"{path}-sorted")
    m = F.col("_metadata")
    rows = spark.read.parquet(f"{path}-sorted").select("timestamp", "entries", m["file_name"].alias("f"), m["row_index"].alias("i"))
    order = Window.orderBy("f", "i")      # a document per second of the range: the check of the order itself
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("place"), "timestamp", "entries")


_SIG_SQL = f"WITH {q.enriched_ctes(q.BARS_HOURLY)}, {q.signal_ctes()} "


@register("b03_signal_points", _SIG_SQL + f"SELECT symbol, regime, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS points, {q.r6('sum(marker_final_score)')} AS score_sum FROM sig GROUP BY 1, 2, 3")
def b03_signal_points(spark, sf_dir):
    """Signal points tagged with symbol and regime; a batch delivered twice stands once."""
    from tickwise.session import shared_path

    path = shared_path(spark, "signal-points")
    signals = hourly_signals(spark, sf_dir)
    for batch_id, late in ((0, False), (1, True), (1, True)):
        part = signals.where((F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")) == F.lit(late))
        sk.append_points(part, path, "trading_signals", tags=("symbol", "regime"), batch_id=batch_id)
    back = spark.read.parquet(path).where("measurement = 'trading_signals'")
    found = back.groupBy("symbol", "regime", F.col("day").cast("string").alias("day"))
    return round_doubles(found.agg(F.count(F.lit(1)).alias("points"), F.sum("marker_final_score").alias("score_sum")))


@register("b05_signal_columns", _SIG_SQL + f"SELECT {r6_select(sg.SIGNAL_OUT, SIG_DOUBLES)}, CAST(33 AS INTEGER) AS n_columns FROM sig")
def b05_signal_columns(spark, sf_dir):
    """The signal table with update and ingest time; a signal without event time takes its update time."""
    from tickwise.session import shared_path

    path = shared_path(spark, "signal-columns")
    signals = hourly_signals(spark, sf_dir).withColumn("last_updated", F.col("ts"))
    sk.append_columnar(signals.withColumn("ts", F.when(F.hour("ts") % 4 > 0, F.col("ts"))), path, fallback_ts="last_updated")
    back = spark.read.parquet(path).where("inserted_at IS NOT NULL")
    return round_doubles(back.select(*sg.SIGNAL_OUT, F.lit(len(back.columns)).alias("n_columns")))


@register("c04_extra_fields", f"SELECT symbol, ts, {q.r6('high - low')} AS spread, 'n' || CAST(CAST(volume AS BIGINT) AS VARCHAR) AS note FROM ({q.BARS_HOURLY})")
def c04_extra_fields(spark, sf_dir):
    """C4 + B6: fields beyond those of a bar go into the audit line and come back."""
    from tickwise.session import shared_path

    path = shared_path(spark, "extra")
    bars = fx.bars_hourly(spark, sf_dir).withColumn("spread", F.col("high") - F.col("low")).withColumn("note", F.concat(F.lit("n"), F.col("volume").cast("long").cast("string")))
    sk.to_audit_json(bars, 1).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "data struct<symbol:string,ts:timestamp_ntz,spread:double,note:string>").alias("j"))
    return round_doubles(back.select("j.data.*"))


@register("c14_conformed", f"SELECT symbol, {q.r6('close')} AS close, ts FROM ({q.BARS_HOURLY})")
def c14_conformed(spark, sf_dir):
    """C14: columns in the wanted order, the others left out."""
    return round_doubles(cl.conform(fx.bars_hourly(spark, sf_dir), ["close", "ts", "symbol"]))


@register("i03_sorted_tables", f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS out_of_order FROM ({q.BARS_DAILY})")
def i03_sorted_tables(spark, sf_dir):
    """I3 + B4: inside every file of the columnar table rows stand by symbol and time."""
    from tickwise.session import shared_path

    path = shared_path(spark, "sorted")
    sk.append_columnar(fx.bars_daily(spark, sf_dir), path)
    m = F.col("_metadata")
    rows = spark.read.parquet(path).select("symbol", "ts", m["file_path"].alias("f"), m["row_index"].alias("i"))
    before = F.lag(F.struct("symbol", "ts")).over(Window.partitionBy("f").orderBy("i"))
    return rows.select((before > F.struct("symbol", "ts")).alias("bad")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("out_of_order"))
