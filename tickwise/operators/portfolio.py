"""Portfolio rebalancing for many portfolios at once.

The reference runs one portfolio every 300 s.  Here every table is keyed by
``portfolio_id`` and a rebalancing ``cycle``, so all portfolios and cycles are
planned together and spread over the cluster.  By the reference's own rules
nothing executes an order: cash and shares never change; only prices (mark to
market), the score history and the lifetime trade counter move, so cycles are
independent given those three, which are windows over ``cycle``.

Sums the reference takes in a definite order (position order, signal order)
are taken in the same order here (ordered window frames / array folds), so
share counts truncated with ``int()`` do not depend on the plan.  Position
order is a column ``position_no`` of the positions, else the symbols' order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.sizing import broadcast_if_small
from tickwise.functions.exprs import tdiv
from tickwise.session import configure, cut_lineage

# Fixed values that must equal the reference (thresholds and limits).
STRONG_BUY, WEAK_BUY, NEUTRAL_LOW, WEAK_SELL = 1.5, 1.1, 0.9, 0.7
MAX_POSITION, MIN_POSITION = 0.20, 0.05
MIN_CASH_RESERVE = 0.10
SIGNAL_CHANGE, WEIGHT_CHANGE = 0.2, 0.03
MAX_TRADES = 30
CONFIDENCE_LOOKBACK, HISTORY_KEPT = 4, 20
MIN_CONFIDENCE, BASE_ALLOCATION = 0.3, 0.15
INITIAL_CAPITAL = 10_000_000.0
STRENGTH_RANGE = 2.0 - WEAK_BUY            # evaluated in double, as in the reference
DEFAULT_MAX_AGE_S = 6 * 3600               # reference: 60 s on 1 s bars
DAY_S = 86_400                             # cycle period; reference: 300 s


# ---------------------------------------------------------------------------
# Classification, freshness, as-of pick per cycle
# ---------------------------------------------------------------------------

def signal_class(score="marker_final_score"):
    """F1: five-level class (1.5 / 1.1 / 0.9 / 0.7)."""
    s = F.col(score)
    return (
        F.when(s >= STRONG_BUY, "STRONG_BUY").when(s >= WEAK_BUY, "WEAK_BUY").when(s >= NEUTRAL_LOW, "HOLD")
        .when(s >= WEAK_SELL, "WEAK_SELL").otherwise("STRONG_SELL")
    )


def with_flags(df: DataFrame, score: str = "marker_final_score") -> DataFrame:
    """F1 flags: bullish is strict ``> 1.1``, bearish ``< 0.9``."""
    s = F.col(score)
    return (
        df.withColumn("signal_class", signal_class(score))
        .withColumn("is_bullish", s > WEAK_BUY)
        .withColumn("is_bearish", s < NEUTRAL_LOW)
        .withColumn("is_neutral", ~(s > WEAK_BUY) & ~(s < NEUTRAL_LOW))
    )


EPOCH = "1970-01-01 00:00:00"


def epoch_micros(ts):
    """Microseconds of a zone-free time since the epoch (no session time zone in it)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    day = F.datediff(c.cast("date"), F.lit(EPOCH).cast("date")).cast("long") * F.lit(86_400)
    seconds = day + F.hour(c) * F.lit(3600) + F.minute(c) * F.lit(60)
    return seconds * F.lit(1_000_000) + (F.extract(F.lit("SECONDS"), c) * F.lit(1_000_000)).cast("long")


def fresh_signals(signals: DataFrame, max_age_s: int = DEFAULT_MAX_AGE_S, period_s: int = DAY_S) -> DataFrame:
    """C10 + H8: newest signal per (cycle time, symbol) no older than ``max_age_s``; cycles are the multiples of ``period_s``.

    The last signal before a cycle is the only one of its period that a cycle
    can see, so signals are first reduced to one per (symbol, period).  Each of
    them serves the cycles from its own up to its age, or to the next signal's
    first cycle: a sequence per row, for any period and age, without a range
    join.  Future signals never reach an earlier cycle.
    """
    keep = ["ts", "close", "atr_14", "marker_final_score", "regime", "regime_confidence", "volume"]
    s = signals.withColumn("_us", epoch_micros("ts"))
    period, age = period_s * 1_000_000, max_age_s * 1_000_000
    s = s.withColumn("_first", F.expr(f"_us div {period}L + if(pmod(_us, {period}L) = 0, 0L, if(_us > 0, 1L, 0L))"))
    s = s.groupBy("symbol", "_first").agg(F.max_by(F.struct(*keep, "_us"), F.col("ts")).alias("s"))
    later = F.lead("_first").over(Window.partitionBy("symbol").orderBy("_first"))
    end = f"(s._us + {age}L)"
    last = F.expr(f"({end} - pmod({end}, {period}L)) div {period}L")
    s = s.withColumn("_last", F.least(last, F.coalesce(later - 1, last))).where("_last >= _first")
    s = s.withColumn("_cycle", F.explode(F.sequence("_first", "_last")))
    time = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("_cycle") * F.lit(period_s)).cast("decimal(18,6)"))
    return s.select(time.alias("cycle_ts"), "symbol", *[F.col(f"s.{c}").alias("signal_ts" if c == "ts" else c) for c in keep])


def number_cycles(fresh: DataFrame) -> DataFrame:
    """Cycle numbers 1.. in time order over cycles that have at least one fresh signal.

    The table has one row per cycle (bounded by time span / period); its row
    count is checked before it is broadcast back.
    """
    cyc = fresh.select("cycle_ts").distinct()
    cyc = cyc.withColumn("cycle", F.row_number().over(Window.orderBy("cycle_ts")).cast("long"))
    cyc, _ = broadcast_if_small(cut_lineage(cyc))
    return fresh.join(cyc, "cycle_ts")


# ---------------------------------------------------------------------------
# Score history and confidence (per symbol and cycle)
# ---------------------------------------------------------------------------

def score_history(fresh: DataFrame) -> DataFrame:
    """D26 + F7: kept history (last 20 scores incl. this cycle) and confidence from the last 4."""
    w = Window.partitionBy("symbol").orderBy("cycle")
    return confidence(fresh.withColumn("signal_history", F.collect_list("marker_final_score").over(w.rowsBetween(-(HISTORY_KEPT - 1), 0))))


def confidence(df: DataFrame) -> DataFrame:
    """confidence from the last 4 scores of ``signal_history``."""
    start = F.greatest(F.size("signal_history") - F.lit(CONFIDENCE_LOOKBACK - 1), F.lit(1))
    df = df.withColumn("_h4", F.slice(F.col("signal_history"), start, F.lit(CONFIDENCE_LOOKBACK)))
    n = F.size("_h4").cast("double")
    df = df.withColumn("_mean", F.aggregate("_h4", F.lit(0.0), lambda a, x: a + x) / n)
    var = F.aggregate("_h4", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    std = F.sqrt(var)
    cv = F.when(F.col("_mean") > 0, tdiv(std, F.col("_mean"))).otherwise(F.lit(1.0))
    conf = F.greatest(F.lit(1.0) / (F.lit(1.0) + cv), F.lit(MIN_CONFIDENCE))
    df = df.withColumn("confidence", F.when(F.size("signal_history") < 2, F.lit(MIN_CONFIDENCE)).otherwise(conf))
    return df.drop("_h4", "_mean")


def strength(score="marker_final_score"):
    """(score - 1.1) / 0.9 clamped to [0, 1]; 0 at or below 1.1."""
    s = F.col(score)
    raw = (s - F.lit(WEAK_BUY)) / F.lit(STRENGTH_RANGE)
    return F.when(s <= WEAK_BUY, F.lit(0.0)).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def volatility_base(fresh: DataFrame) -> DataFrame:
    """F8 input: mean ATR of bullish signals with ATR > 0 per cycle (signal order)."""
    w = Window.partitionBy("cycle").orderBy("symbol").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    atr = F.when((F.col("marker_final_score") > WEAK_BUY) & (F.col("atr_14") > 0), F.col("atr_14"))
    return fresh.withColumn("_atr_mean", F.avg(atr).over(w))


def volatility_adjustment():
    """F8: mean ATR / own ATR clamped to [0.5, 2]; own ATR <= 0 -> 0.5; no ATRs -> 1."""
    adj = F.least(F.greatest(tdiv(F.col("_atr_mean"), F.col("atr_14")), F.lit(0.5)), F.lit(2.0))
    return F.when(F.col("_atr_mean").isNull(), F.lit(1.0)).when(F.col("atr_14") <= 0, F.lit(0.5)).otherwise(adj)


def concentration_penalty(weight="current_weight"):
    """max(1 - (w / 0.20)^2, 0)."""
    r = F.col(weight) / F.lit(MAX_POSITION)
    return F.greatest(F.lit(1.0) - r * r, F.lit(0.0))


def position_size():
    """clamp(0.15 * strength * confidence * volatility * concentration, 0.05, 0.20)."""
    raw = F.lit(BASE_ALLOCATION) * F.col("signal_strength") * F.col("confidence") * F.col("_vol_adj") * F.col("_penalty")
    return F.least(F.greatest(raw, F.lit(MIN_POSITION)), F.lit(MAX_POSITION))


# ---------------------------------------------------------------------------
# valuation
# ---------------------------------------------------------------------------

def carried_prices(fresh: DataFrame, n_cycles: int) -> DataFrame:
    """(symbol, cycle, price): the newest fresh close so far, carried over the cycles without one.

    A row per symbol and cycle, made once, not once per position.
    """
    later = F.lead("cycle").over(Window.partitionBy("symbol").orderBy("cycle"))
    span = F.sequence(F.col("cycle"), F.coalesce(F.col("_next") - 1, F.lit(n_cycles).cast("long")))
    return fresh.withColumn("_next", later).select("symbol", F.explode(span).alias("cycle"), F.col("close").alias("_px"))


def positions_by_cycle(positions: DataFrame, fresh: DataFrame, n_cycles: int) -> DataFrame:
    """F4 (+H1): every position at every cycle, marked to the newest fresh close so far.

    Positions are expanded over the cycle numbers with ``explode(sequence)``
    (a generator, not a join) and looked up in the carried prices.
    """
    pc = positions.withColumn("cycle", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_cycles).cast("long"))))
    prices, _ = broadcast_if_small(cut_lineage(carried_prices(fresh, n_cycles)))
    return marked(pc.join(prices, ["symbol", "cycle"], "left"))


def marked(pos: DataFrame) -> DataFrame:
    """Positions with ``_px`` valued at it, or at their average price where there is none."""
    pos = pos.withColumn("current_price", F.coalesce("_px", "avg_price")).drop("_px")
    return pos.withColumn("market_value", F.col("shares").cast("double") * F.col("current_price"))


def position_valuation(pos: DataFrame) -> DataFrame:
    """unrealised P&L and its percentage (0 when the average price is not positive)."""
    return pos.withColumn("unrealized_pnl", (F.col("current_price") - F.col("avg_price")) * F.col("shares").cast("double")).withColumn(
        "unrealized_pnl_pct",
        F.when(F.col("avg_price") > 0, (F.col("current_price") - F.col("avg_price")) / F.col("avg_price")).otherwise(F.lit(0.0)),
    )


def position_order(pos: DataFrame) -> list[str]:
    """Order of one portfolio's positions: ``position_no`` (then symbol) where there is one, else symbol."""
    return ["position_no", "symbol"] if "position_no" in pos.columns else ["symbol"]


def portfolio_valuation(portfolios: DataFrame, pos_cycle: DataFrame, keys=("portfolio_id", "cycle")) -> DataFrame:
    """total = cash + sum of market values (position order), cash share, position count."""
    w = Window.partitionBy(*keys).orderBy(*position_order(pos_cycle)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_pos = pos_cycle.withColumn("_mv_sum", F.sum("market_value").over(w))
    agg = per_pos.groupBy(*keys).agg(F.first("_mv_sum").alias("_mv_sum"), F.count(F.lit(1)).alias("position_count"))
    out = portfolios.join(agg, "portfolio_id", "left") if "cycle" not in portfolios.columns else portfolios.join(agg, list(keys), "left")
    out = out.withColumn("position_count", F.coalesce("position_count", F.lit(0)).cast("long"))
    out = out.withColumn("total_value", F.col("cash") + F.coalesce(F.col("_mv_sum"), F.lit(0.0))).drop("_mv_sum")
    return out.withColumn(
        "cash_percentage", F.when(F.col("total_value") > 0, F.col("cash") / F.col("total_value")).otherwise(F.lit(1.0))
    )


# ---------------------------------------------------------------------------
# Targets and orders
# ---------------------------------------------------------------------------

ORDER_COLS = [
    "portfolio_id", "cycle", "order_id", "symbol", "action", "shares", "price", "dollar_amount", "reason",
    "priority", "target_weight", "current_weight", "signal_score", "signal_strength", "confidence", "ts",
]


def _fmt2(x):
    return F.format_string("%.2f", F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0))


def _fmt_pct1(x):
    return F.concat(F.format_string("%.1f", F.floor(x * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(10.0)), F.lit("%"))


def rebalance(portfolios: DataFrame, positions: DataFrame, signals: DataFrame, max_age_s: int = DEFAULT_MAX_AGE_S,
              period_s: int = DAY_S) -> dict[str, DataFrame]:
    """all cycles for all portfolios.  Returns the intermediate tables and ``orders``.

    portfolios: portfolio_id, cash, trades_used; positions: portfolio_id, symbol,
    shares, avg_price, last_action_signal and, if their order counts,
    position_no; signals: SIGNAL rows (E11).
    """
    configure(signals.sparkSession)
    fresh = cut_lineage(fresh_signals(signals, max_age_s, period_s))      # signals are computed once
    fresh = cut_lineage(score_history(number_cycles(fresh)))
    fresh = volatility_base(fresh).withColumn("signal_strength", strength())
    n_cycles = max(1, fresh.agg(F.max("cycle")).first()[0] or 0)
    fresh = cut_lineage(fresh)

    pos_cycle = positions_by_cycle(positions, fresh, n_cycles)
    pcycle = portfolios.withColumn("cycle", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_cycles).cast("long"))))
    cycles_ts = fresh.select("cycle", "cycle_ts").distinct()
    cycles_ts, _ = broadcast_if_small(cut_lineage(cycles_ts))
    return orders_of(fresh, pos_cycle, pcycle.join(cycles_ts, "cycle"), portfolios)


def orders_of(fresh: DataFrame, pos_cycle: DataFrame, pcycle: DataFrame, portfolios: DataFrame) -> dict[str, DataFrame]:
    """F3, F5 - F18 for the cycles of ``pcycle`` (the ``portfolios`` with cycle and cycle_ts).

    ``fresh``: written rows (cycle, symbol) with confidence, strength and mean
    ATR; ``pos_cycle``: the positions valued at each cycle.
    """
    fresh_b, _ = broadcast_if_small(fresh)
    pval = portfolio_valuation(pcycle, pos_cycle)

    order = position_order(pos_cycle)

    # Candidates: every fresh signal of the cycle for every portfolio (F5), with ownership (H2).
    cand = pval.join(fresh_b.drop("cycle_ts"), "cycle").join(
        pos_cycle.select("portfolio_id", "cycle", "shares", "current_price", "market_value", "last_action_signal", *order),
        ["portfolio_id", "cycle", "symbol"], "left",
    )
    owned = F.col("shares").isNotNull()
    bull, bear = F.col("marker_final_score") > WEAK_BUY, F.col("marker_final_score") < NEUTRAL_LOW
    bucket = F.when(bull, "buy").when(~bear & owned, "hold").when(bear & owned, "sell")
    cand = cand.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull()).withColumn("owned", owned)
    cand = cand.withColumn("current_weight", F.when(owned, tdiv(F.col("market_value"), F.col("total_value"))).otherwise(F.lit(0.0)))

    # deployable capital per (portfolio, cycle); sells summed in signal order.
    kw = Window.partitionBy("portfolio_id", "cycle").orderBy("symbol").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sells_value = F.coalesce(F.sum(F.when(F.col("bucket") == "sell", F.col("market_value"))).over(kw), F.lit(0.0))
    cand = cand.withColumn("_available", F.col("cash") + sells_value)
    cand = cand.withColumn(
        "deployable", F.greatest(F.col("_available") - F.lit(MIN_CASH_RESERVE) * F.col("total_value"), F.lit(0.0))
    )
    # Buy sizes; F12: scaled to the deployable share.
    cand = cand.withColumn("_vol_adj", volatility_adjustment()).withColumn("_penalty", concentration_penalty())
    cand = cand.withColumn("_size", F.when(F.col("bucket") == "buy", position_size()))
    cand = cand.withColumn("_buy_total", F.sum("_size").over(kw))
    max_w = tdiv(F.col("deployable"), F.col("total_value"))
    scaled = F.when(F.col("_buy_total") > max_w, F.col("_size") * tdiv(max_w, F.col("_buy_total"))).otherwise(F.col("_size"))
    target = (
        F.when(F.col("bucket") == "sell", F.lit(0.0))
        .when(F.col("bucket") == "hold", F.col("current_weight"))
        .when(F.col("deployable") > 0, scaled)
    )
    cand = cand.withColumn("target_weight", target)

    # trade decision.
    t, w = F.coalesce(F.col("target_weight"), F.lit(0.0)), F.col("current_weight")

    def should_trade(tw):
        return (
            F.when(~owned & (tw > 0), True).when((tw == 0) & owned, True)
            .when(F.abs(tw - w) < WEIGHT_CHANGE, False)
            .when(owned & (F.abs(F.col("marker_final_score") - F.col("last_action_signal")) < SIGNAL_CHANGE), False)
            .otherwise(True)
        )

    # A candidate is a sell (target below weight) or a buy (above), so one pass over them serves both and nothing is written.
    # sells (held, fresh signal, target below weight; a missing target means 0).
    to_sell = F.when(t == 0, F.col("shares")).otherwise(
        F.least(((F.col("market_value") - t * F.col("total_value")) / F.col("current_price")).cast("long"), F.col("shares"))
    )
    sell = F.struct(
        F.lit("SELL").alias("action"), to_sell.alias("shares"), F.col("current_price").alias("price"),
        F.when(t == 0, F.concat(F.lit("EXIT: Signal "), _fmt2(F.col("marker_final_score")), F.lit(" bearish")))
        .otherwise(F.concat(F.lit("TRIM: Rebalance to "), _fmt_pct1(t))).alias("reason"),
        F.lit(1).alias("priority"), F.lit(0).alias("_side"),
        (F.col(order[0]) if len(order) > 1 else F.lit(0)).cast("long").alias("_place"),
    )
    # buys (target present and non-zero, above weight).
    tb = F.col("target_weight")
    to_buy = ((tb * F.col("total_value") - w * F.col("total_value")) / F.col("close")).cast("long")
    buy = F.struct(
        F.lit("BUY").alias("action"), to_buy.alias("shares"), F.col("close").alias("price"),
        F.when(owned, F.concat(F.lit("ADD: Signal "), _fmt2(F.col("marker_final_score")), F.lit(" strengthening")))
        .otherwise(F.concat(F.lit("ENTER: Signal "), _fmt2(F.col("marker_final_score")), F.lit(" bullish"))).alias("reason"),
        (F.lit(2) + ((F.lit(2.0) - F.col("marker_final_score")) * F.lit(10.0)).cast("int")).alias("priority"),
        F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_place"),
    )
    made = F.when(owned & (t < w) & should_trade(t), sell).when(tb.isNotNull() & (tb != 0) & (tb > w) & should_trade(tb), buy)
    raw = cand.withColumn("_o", made).filter(F.col("_o.shares") > 0).select(
        "portfolio_id", "cycle", "cycle_ts", "symbol", "cash", "_o.*", t.alias("target_weight"), w.alias("current_weight"),
        F.col("marker_final_score").alias("signal_score"), "signal_strength", "confidence",
    )
    raw = raw.withColumn("dollar_amount", F.col("shares").cast("double") * F.col("price"))
    # F16: ids in generation order (sells by position, buys by symbol).
    gen = Window.partitionBy("portfolio_id", "cycle").orderBy("_side", "_place", "symbol")
    raw = raw.withColumn("_seq", F.row_number().over(gen))
    raw = raw.withColumn("order_id", F.format_string("ORD-%04d-%03d", F.col("cycle"), F.col("_seq")))

    orders = validate_and_cap(raw, portfolios)
    return {"fresh": fresh, "positions": pos_cycle, "portfolios": pval, "candidates": cand, "orders": orders}


ORDER_FIELDS = ["priority", "_seq", "order_id", "symbol", "action", "shares", "price", "dollar_amount", "reason",
                "target_weight", "current_weight", "signal_score", "signal_strength", "confidence"]


def validate_and_cap(raw: DataFrame, portfolios: DataFrame, max_trades: int = MAX_TRADES) -> DataFrame:
    """F17 + F18: greedy cash validation per (portfolio, cycle) in (priority, generation) order,
    then the lifetime trade cap dropping from the tail.

    ``raw``: portfolio_id, cycle, cycle_ts, cash and ORDER_FIELDS.  A SELL adds
    its amount to the running cash; a BUY is kept only if the running cash
    covers it (an unaffordable BUY is skipped, later smaller ones may pass).
    The fold runs over one (portfolio, cycle)'s orders - at most one per symbol.
    """
    grouped = raw.groupBy("portfolio_id", "cycle", "cycle_ts", "cash").agg(
        F.array_sort(F.collect_list(F.struct(*ORDER_FIELDS))).alias("_orders")
    )
    # only rejected orders are written down, so the fold is linear in the orders that are kept
    init = F.struct(F.col("cash").alias("c"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("out"))

    def step(acc, o):
        sell = o["action"] == "SELL"
        ok = sell | (acc["c"] >= o["dollar_amount"])
        cash = F.when(sell, acc["c"] + o["dollar_amount"]).when(ok, acc["c"] - o["dollar_amount"]).otherwise(acc["c"])
        return F.struct(cash.alias("c"), (acc["i"] + 1).alias("i"), F.when(ok, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["i"]))).alias("out"))

    out = F.col("_out")
    val = grouped.withColumn("_out", F.aggregate("_orders", init, step)["out"])
    kept = F.when(F.size(out) == 0, F.col("_orders")).otherwise(F.filter("_orders", lambda o, i: ~F.array_contains(out, i)))
    val = val.withColumn("_kept", kept).withColumn("_n", F.size("_kept")).drop("_orders", "_out")
    # Lifetime cap: orders kept in earlier cycles count against it.
    pw = Window.partitionBy("portfolio_id").orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    val = val.join(portfolios.select("portfolio_id", "trades_used"), "portfolio_id")
    used = F.least(F.lit(max_trades), F.col("trades_used") + F.coalesce(F.sum("_n").over(pw), F.lit(0)))
    val = val.withColumn("_allowed", F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(max_trades) - used)).cast("int"))
    kept = val.select("portfolio_id", "cycle", "cycle_ts", F.posexplode(F.slice("_kept", 1, F.col("_allowed"))).alias("_pos", "o"))
    return kept.select(
        "portfolio_id", "cycle", "o.order_id", "o.symbol", "o.action", "o.shares", "o.price", "o.dollar_amount", "o.reason",
        "o.priority", "o.target_weight", "o.current_weight", "o.signal_score", "o.signal_strength", "o.confidence",
        F.col("cycle_ts").alias("ts"),
    )


def order_summary(orders: DataFrame) -> DataFrame:
    """count and amount per side and net flow, per (portfolio, cycle)."""
    buy, sell = F.col("action") == "BUY", F.col("action") == "SELL"
    return orders.groupBy("portfolio_id", "cycle").agg(
        F.count_if(buy).alias("buy_orders"), F.coalesce(F.sum(F.when(buy, F.col("dollar_amount"))), F.lit(0.0)).alias("buy_amount"),
        F.count_if(sell).alias("sell_orders"), F.coalesce(F.sum(F.when(sell, F.col("dollar_amount"))), F.lit(0.0)).alias("sell_amount"),
    ).withColumn("net_flow", F.col("buy_amount") - F.col("sell_amount"))


# ---------------------------------------------------------------------------
# K5: one cycle from stored state
# ---------------------------------------------------------------------------

def next_cycle(portfolios: DataFrame, positions: DataFrame, history: DataFrame, latest: DataFrame, cycle: int, cycle_ts,
               max_age_s: int = DEFAULT_MAX_AGE_S) -> dict[str, DataFrame]:
    """The cycle number ``cycle`` at ``cycle_ts`` from what the cycles before have left; equals that cycle of :func:`rebalance`.

    portfolios: portfolio_id, cash, trades_used; positions: portfolio_id,
    symbol, shares, avg_price, last_action_signal; history: symbol,
    signal_history (newest last), price (last fresh close); latest: the newest
    signal per symbol.  Returns ``orders`` of this cycle and the new
    ``portfolios`` and ``history``.
    """
    at = F.lit(cycle_ts).cast("timestamp_ntz")
    young = epoch_micros(at) - epoch_micros("ts") <= F.lit(max_age_s * 1_000_000)
    fresh = latest.where((F.col("ts") <= at) & young).withColumnRenamed("ts", "signal_ts")
    fresh = fresh.withColumn("cycle", F.lit(cycle).cast("long")).withColumn("cycle_ts", at)
    both = history.join(fresh.select("symbol", F.col("marker_final_score").alias("_s"), F.col("close").alias("_c")), "symbol", "full")
    scores = F.concat(F.coalesce("signal_history", F.array().cast("array<double>")), F.when(F.col("_s").isNotNull(), F.array("_s")).otherwise(F.array().cast("array<double>")))
    tail = F.slice(scores, F.greatest(F.size(scores) - F.lit(HISTORY_KEPT - 1), F.lit(1)), F.lit(HISTORY_KEPT))
    history = cut_lineage(both.select("symbol", tail.alias("signal_history"), F.coalesce("_c", "price").alias("price")))
    fresh = confidence(fresh.join(history.select("symbol", "signal_history"), "symbol"))
    fresh = cut_lineage(volatility_base(fresh).withColumn("signal_strength", strength()))
    pos = marked(positions.withColumn("cycle", F.lit(cycle).cast("long")).join(history.select("symbol", F.col("price").alias("_px")), "symbol", "left"))
    pcycle = portfolios.withColumn("cycle", F.lit(cycle).cast("long")).withColumn("cycle_ts", at)
    orders = cut_lineage(orders_of(fresh, pos, pcycle, portfolios)["orders"])
    made = orders.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("_n"))
    used = F.col("trades_used") + F.coalesce("_n", F.lit(0))
    portfolios = portfolios.join(made, "portfolio_id", "left").withColumn("trades_used", used).drop("_n")
    return {"orders": orders, "portfolios": portfolios, "history": history}
