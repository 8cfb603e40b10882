"""DuckDB SQL text for the oracle checks.

Spark's sliding-frame aggregates re-aggregate the frame from its oldest row
(sum: ``0.0 + x1 + x2 ...``; sample std: the online update
``n+=1; d=x-m; m+=d/n; q+=d*(d-d/n)``).  The helpers below state the same
folds with ``list_reduce`` so both engines produce the same doubles; every
output double is rounded with ``floor(x*1e6+0.5)/1e6`` on both sides.
"""

from __future__ import annotations


def d(v: float) -> str:
    """A double literal that parses to exactly ``v`` in both engines."""
    return f"CAST('{v!r}' AS DOUBLE)"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6 + 0.0)"


def frame(lo: int, hi: int = 0, part: str = "symbol", order: str = "ts") -> str:
    def b(k: int) -> str:
        if k == 0:
            return "CURRENT ROW"
        return f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {b(lo)} AND {b(hi)})"


def last(n: int, part: str = "symbol", order: str = "ts") -> str:
    return frame(-(n - 1), 0, part, order)


def nn(lst: str) -> str:
    return f"list_filter({lst}, lambda v: v IS NOT NULL)"


def lsum(lst: str) -> str:
    return f"list_reduce({nn(lst)}, lambda a, b: a + b, CAST(0.0 AS DOUBLE))"


def lcnt(lst: str) -> str:
    return f"len({nn(lst)})"


def lavg(lst: str) -> str:
    return f"({lsum(lst)} / nullif(CAST({lcnt(lst)} AS DOUBLE), 0))"


def lavg_full(lst: str, n: int) -> str:
    return f"(CASE WHEN {lcnt(lst)} = {n} THEN {lavg(lst)} END)"


def lsum_nullable(lst: str) -> str:
    """Spark ``sum``: null when no non-null value."""
    return f"(CASE WHEN {lcnt(lst)} > 0 THEN {lsum(lst)} END)"


def lstd(lst: str) -> str:
    """Spark ``stddev_samp`` over the list's non-null values."""
    acc = (
        f"list_reduce({nn(lst)}, lambda a, x: {{'n': a.n + 1.0, 'm': a.m + (x - a.m) / (a.n + 1.0), "
        f"'q': a.q + (x - a.m) * ((x - a.m) - (x - a.m) / (a.n + 1.0))}}, "
        f"{{'n': CAST(0.0 AS DOUBLE), 'm': CAST(0.0 AS DOUBLE), 'q': CAST(0.0 AS DOUBLE)}})"
    )
    return f"(CASE WHEN {lcnt(lst)} > 1 THEN sqrt(({acc}).q / (({acc}).n - 1.0)) END)"


def lmax(lst: str) -> str:
    return f"list_max({lst})"


def lmin(lst: str) -> str:
    return f"list_min({lst})"


def tdiv(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({d(lo)}, least({d(hi)}, ({x}))) END)"


def nan_null(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE ({x}) END)"


# ---------------------------------------------------------------------------
# Fixtures
# ---------------------------------------------------------------------------

BARS_HOURLY = """
SELECT symbol, ts, open, high, low, close, volume,
       strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H:%M') AS time
FROM (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close,
         sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
  FROM events GROUP BY 1, 2
) q
"""

BARS_DAILY = """
SELECT symbol, ts, open, high, low, close, volume,
       strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H:%M') AS time
FROM (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts,
         arg_min(l_extendedprice / nullif(l_quantity, 0), (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
         max(l_extendedprice / nullif(l_quantity, 0)) AS high,
         min(l_extendedprice / nullif(l_quantity, 0)) AS low,
         arg_max(l_extendedprice / nullif(l_quantity, 0), (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2
) q
"""

BARS_TICK = """
SELECT event_type AS symbol, ts, value AS open, value AS high, value AS low, value AS close,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
       strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H:%M') AS time
FROM events
"""

FIXTURES = {"bars_hourly": BARS_HOURLY, "bars_daily": BARS_DAILY, "bars_tick": BARS_TICK}

INDICATOR_COLS = [
    "sma_5", "sma_10", "ema_7", "ema_11", "macd_line", "macd_signal", "atr_14", "momentum",
    "bb_upper", "bb_lower", "vma_10", "volume_ratio", "rsi_14", "price_change", "price_change_pct",
]


def _ewm(mean: str, weight: str, x: str, span: int) -> tuple[str, str]:
    """Mean and weight after ``x``: no adjustment, a missing ``x`` only ages the weight of what came before."""
    a = d(2.0 / (span + 1.0))
    aged = f"({weight} * (1.0 - {a}))"
    new = f"(CASE WHEN {x} IS NULL THEN {mean} WHEN {mean} IS NULL OR {mean} = {x} THEN {x} ELSE ({aged} * {mean} + {a} * {x}) / ({aged} + {a}) END)"
    return new, f"(CASE WHEN {x} IS NULL AND {mean} IS NOT NULL THEN {aged} ELSE CAST(1.0 AS DOUBLE) END)"


def ema_states(values: str) -> str:
    """EMAs of a list of closes (7, 11, 12, 26), the MACD signal and their counts after its last value, stated apart from the library's."""
    spans = (7, 11, 12, 26)
    price = {s: _ewm(f"s.e{s}", f"s.w{s}", "x", s) for s in spans}
    n = "(s.n + CASE WHEN x IS NULL THEN 0 ELSE 1 END)"
    line = f"(CASE WHEN {n} >= 26 THEN {price[12][0]} - {price[26][0]} END)"
    signal, weight = _ewm("s.sig", "s.wsig", line, 9)
    step = {"n": n, "lines": f"(s.lines + CASE WHEN {n} >= 26 THEN 1 ELSE 0 END)", "sig": signal, "wsig": weight}
    start = {"n": "0", "lines": "0", "sig": "NULL", "wsig": "1.0"}
    for s in spans:
        step |= {f"e{s}": price[s][0], f"w{s}": price[s][1]}
        start |= {f"e{s}": "NULL", f"w{s}": "1.0"}
    typed = lambda fields: "{" + ", ".join(f"'{k}': CAST({v} AS {'BIGINT' if k in ('n', 'lines') else 'DOUBLE'})" for k, v in fields.items()) + "}"
    return f"list_reduce({values}, lambda s, x: {typed(step)}, {typed(start)})"


def enriched_ctes(bars_sql: str) -> str:
    """CTE chain ``bars`` -> ``enr`` with the 15 indicators, rn, n_sym, is_enriched."""
    return f"""
bars AS ({bars_sql}),
e1 AS (
  SELECT *,
    CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS rn,
    CAST(count(*) OVER (PARTITION BY symbol) AS BIGINT) AS n_sym,
    lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev_close,
    list(close) {last(60)} AS h,
    list(close) {last(5)} AS c5,
    list(close) {last(10)} AS c10,
    list(close) {last(20)} AS c20,
    list(volume) {last(10)} AS v10,
    last(close IGNORE NULLS) {last(60)} AS cf,
    last(close IGNORE NULLS) {frame(-59, -1)} AS cfp
  FROM bars
),
e2 AS (
  SELECT *,
    greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr,
    CASE WHEN close - prev_close > 0 THEN close - prev_close ELSE CAST(0.0 AS DOUBLE) END AS gain,
    CASE WHEN close - prev_close < 0 THEN -(close - prev_close) ELSE CAST(0.0 AS DOUBLE) END AS loss,
    {ema_states('h')} AS acc
  FROM e1
),
e3 AS (
  SELECT *,
    list(tr) {last(14)} AS tr14, list(gain) {last(14)} AS g14, list(loss) {last(14)} AS l14
  FROM e2
),
e4 AS (
  SELECT *,
    {lavg_full('c5', 5)} AS sma_5,
    {lavg_full('c10', 10)} AS sma_10,
    CASE WHEN acc.n >= 7 THEN acc.e7 END AS ema_7,
    CASE WHEN acc.n >= 11 THEN acc.e11 END AS ema_11,
    CASE WHEN acc.n >= 26 THEN acc.e12 - acc.e26 END AS macd_line,
    CASE WHEN acc.lines >= 9 THEN acc.sig END AS macd_signal,
    {lavg_full('tr14', 14)} AS atr_14,
    CASE WHEN {lcnt('c20')} = 20 THEN {lavg('c20')} END AS bb_mid,
    CASE WHEN {lcnt('c20')} = 20 THEN {lstd('c20')} END AS bb_sd,
    {lavg_full('v10', 10)} AS vma_10,
    {lavg_full('g14', 14)} AS avg_gain,
    {lavg_full('l14', 14)} AS avg_loss,
    close - prev_close AS price_change,
    ({tdiv('cf', 'cfp')} - 1.0) * 100.0 AS price_change_pct
  FROM e3
),
e5 AS (
  SELECT *,
    {tdiv('close - sma_10', 'sma_10')} AS momentum,
    bb_mid + 2.0 * bb_sd AS bb_upper,
    bb_mid - 2.0 * bb_sd AS bb_lower,
    {tdiv('volume', 'vma_10')} AS volume_ratio,
    100.0 - {tdiv('100.0', '1.0 + ' + tdiv('avg_gain', 'nullif(avg_loss, 0.0)'))} AS rsi_14
  FROM e4
),
enr AS (
  SELECT symbol, ts, open, high, low, close, volume, date, time, rn, n_sym,
    {', '.join(f'{nan_null(c)} AS {c}' for c in INDICATOR_COLS)},
    (rn >= 35 AND n_sym >= 60) AS is_enriched
  FROM e5
)"""


SIGNAL_COLS = [
    "signal_1_momentum", "signal_2_macd", "signal_3_rsi",
    "signal_4_bollinger", "signal_5_volume", "signal_6_trend_quality",
]
REQUIRED_COLS = [
    "close", "volume", "sma_10", "macd_line", "macd_signal", "atr_14", "momentum",
    "bb_upper", "bb_lower", "volume_ratio", "rsi_14", "price_change", "price_change_pct",
]
SIGNAL_OUT = (
    ["symbol", "ts", "date", "time", "open", "high", "low", "close", "volume",
     "sma_10", "macd_line", "macd_signal", "atr_14", "momentum", "bb_upper", "bb_lower",
     "volume_ratio", "rsi_14", "price_change", "price_change_pct"]
    + SIGNAL_COLS
    + ["regime", "regime_confidence", "marker_raw_score", "marker_adjusted_score", "marker_final_score"]
)


def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def signal_ctes() -> str:
    """CTE chain ``enr`` -> ``sig``."""
    from tickwise.operators.signals import REGIME_WEIGHTS

    ready = " AND ".join(f"count({c}) {last(60)} > 0" for c in REQUIRED_COLS)
    wrows = ", ".join(
        "(" + ", ".join([f"'{k}'"] + [d(x) for x in v]) + ")" for k, v in REGIME_WEIGHTS.items()
    )
    return f"""
s1 AS (
  SELECT *,
    (rn >= 94 AND {ready}) AS ready,
    {tdiv('close - sma_10', 'sma_10 + 0.01')} AS m,
    abs(macd_line - macd_signal) AS gap,
    CAST(sign(price_change) AS DOUBLE) AS dirn,
    abs(price_change) AS apc,
    {_lag('macd_line', 9)} AS macd_l9,
    {_lag('rsi_14', 4)} AS rsi_l4, {_lag('rsi_14', 9)} AS rsi_l9,
    {_lag('close', 4)} AS c_l4, {_lag('bb_upper', 4)} AS u_l4, {_lag('bb_lower', 4)} AS lo_l4,
    {_lag('close', 9)} AS c_l9, {_lag('atr_14', 4)} AS atr_l4,
    list(macd_line) {last(15)} AS macd15,
    list(price_change_pct) {last(10)} AS pct10,
    list(volume_ratio) {last(15)} AS vr15,
    list(volume_ratio) {last(10)} AS vr10,
    list(volume_ratio) {last(60)} AS vr60,
    list(atr_14) {last(60)} AS atr60,
    count(*) {last(60)} AS rows60
  FROM enr
),
s2 AS (
  SELECT *,
    list(m) {frame(-9, -5)} AS m_early, list(m) {frame(-4, 0)} AS m_late, list(m) {last(10)} AS m10,
    list(gap) {last(15)} AS gap15,
    list(dirn) {last(10)} AS dir10,
    list(apc) {last(10)} AS apc10,
    list_sort(list_filter(vr15, lambda v: v IS NOT NULL)) AS vs15
  FROM s1
),
s3 AS (
  SELECT *,
    {clip(f"tanh({tdiv(f'{lavg("m_late")} - {lavg("m_early")}', f'{lstd("m10")} + 1e-8')} / 1.5)", -1, 1)} AS signal_1_momentum,
    {clip(f"0.6 * {tdiv('macd_line - macd_l9', f'greatest({lmax("macd15")} - {lmin("macd15")}, 1e-8)')} + 0.4 * {tdiv('macd_line - macd_signal', f'{lmax("gap15")} + 1e-8')}", -1, 1)} AS signal_2_macd,
    CASE WHEN rsi_14 IS NULL THEN CAST(0.0 AS DOUBLE) ELSE {clip(
        "CAST(CASE WHEN rsi_14 < 20 THEN 1.0 WHEN rsi_14 < 30 THEN 0.7 WHEN rsi_14 < 40 THEN 0.3 "
        "WHEN rsi_14 > 80 THEN -1.0 WHEN rsi_14 > 70 THEN -0.7 WHEN rsi_14 > 60 THEN -0.3 ELSE 0.0 END AS DOUBLE) "
        "+ CAST(CASE WHEN rsi_l9 < 30 AND rsi_l4 < 35 AND rsi_14 > 35 AND rsi_14 - rsi_l4 > 0 THEN 0.5 "
        "WHEN rsi_l9 > 70 AND rsi_l4 > 65 AND rsi_14 < 65 AND rsi_14 - rsi_l4 < 0 THEN -0.5 ELSE 0.0 END AS DOUBLE) "
        "+ (CASE WHEN abs(momentum) > 0.02 THEN CAST(sign(momentum) AS DOUBLE) * 0.3 ELSE CAST(0.0 AS DOUBLE) END)", -1, 1)} END AS signal_3_rsi,
    {clip(tdiv('close - bb_lower', '(bb_upper - bb_lower) + 1e-8'), -0.1, 1.1)} AS pb,
    {tdiv('(u_l4 - c_l4) - (bb_upper - close)', '((bb_upper - bb_lower) + 1e-8) + 1e-8')} AS v_up,
    {tdiv('(c_l4 - lo_l4) - (close - bb_lower)', '((bb_upper - bb_lower) + 1e-8) + 1e-8')} AS v_low,
    {tdiv('((bb_upper - bb_lower) + 1e-8) - (u_l4 - lo_l4)', '(u_l4 - lo_l4) + 1e-8')} AS wchange,
    CASE WHEN {lcnt('pct10')} = 10 THEN {lsum('pct10')} END AS net10,
    CASE WHEN len(vs15) = 0 THEN NULL WHEN len(vs15) % 2 = 1 THEN vs15[CAST((len(vs15) + 1) // 2 AS INTEGER)]
         ELSE (vs15[CAST(len(vs15) // 2 AS INTEGER)] + vs15[CAST(len(vs15) // 2 AS INTEGER) + 1]) / 2.0 END AS vr_median,
    CAST(len(list_filter(vr10, lambda v: v > 1.2)) AS DOUBLE) / 10.0 AS vr_consistency,
    CAST(greatest(len(list_filter(dir10, lambda v: v > 0)), len(list_filter(dir10, lambda v: v < 0)), len(list_filter(dir10, lambda v: v = 0))) AS DOUBLE) / 10.0 AS dir_share,
    {tdiv('abs(close - c_l9)', f"{lsum_nullable('apc10')} + 1e-8")} AS efficiency,
    {clip(f"1.0 - {tdiv(lstd('apc10'), f'{lavg('apc10')} + 1e-8')}", 0, 1)} AS steadiness,
    len(list_filter(atr60, lambda v: v < atr_14)) / rows60 * 100.0 AS atr_pct,
    {tdiv('atr_14 - atr_l4', 'atr_l4 + 1e-8')} AS atr_rate,
    {lavg('vr60')} AS vr_mean, {lstd('vr60')} AS vr_std
  FROM s2
),
s4 AS (
  SELECT *,
    CAST(CASE WHEN pb > 0.95 THEN (CASE WHEN v_up > 0.05 THEN 0.8 WHEN v_up < -0.05 THEN -0.7 ELSE 0.0 END)
         WHEN pb < 0.05 THEN (CASE WHEN v_low > 0.05 THEN -0.8 WHEN v_low < -0.05 THEN 0.7 ELSE 0.0 END)
         WHEN pb >= 0.45 AND pb <= 0.55 THEN 0.0
         ELSE (pb - 0.5) * 0.5 END AS DOUBLE) AS pos,
    abs(net10) * ({tdiv('volume_ratio', 'greatest(vr_median, 0.5)')} - 1.0) * CAST(sign(net10) AS DOUBLE) AS align
  FROM s3
),
s5 AS (
  SELECT *,
    {clip("pos * CAST(CASE WHEN wchange > 0.1 THEN (CASE WHEN abs(pos) > 0.5 THEN 1.2 ELSE 1.0 END) WHEN wchange < -0.1 THEN 0.7 ELSE 1.0 END AS DOUBLE)", -1, 1)} AS signal_4_bollinger,
    {clip("tanh((CASE WHEN vr_consistency > 0.6 THEN align * 1.3 ELSE align END) * 2.0)", -1, 1)} AS signal_5_volume,
    {clip("((dir_share + efficiency + steadiness) / 3.0) * CAST(sign(close - c_l9) AS DOUBLE) * 2.0 - 1.0", -1, 1)} AS signal_6_trend_quality,
    CASE WHEN atr_pct > 75 AND atr_rate > 0.15 THEN 'EXPLOSIVE' WHEN atr_pct > 55 THEN 'TRENDING'
         WHEN atr_pct < 35 THEN 'MEAN_REVERSION' ELSE 'NEUTRAL' END AS regime,
    CASE WHEN atr_pct > 75 AND atr_rate > 0.15 THEN (atr_pct - 75.0) / 25.0 WHEN atr_pct > 55 THEN (atr_pct - 55.0) / 45.0
         WHEN atr_pct < 35 THEN (35.0 - atr_pct) / 35.0 ELSE 0.5 END AS regime_confidence,
    {tdiv('volume_ratio - vr_mean', 'vr_std + 1e-6')} AS vz
  FROM s4
),
s6 AS (
  SELECT s5.* REPLACE ({', '.join(f'{nan_null(c)} AS {c}' for c in SIGNAL_COLS)})
  FROM s5 WHERE ready
),
s7 AS (
  SELECT s6.*, w.w1, w.w2, w.w3, w.w4, w.w5, w.w6
  FROM s6 LEFT JOIN (VALUES {wrows}) w(regime, w1, w2, w3, w4, w5, w6) USING (regime)
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SIGNAL_COLS)}
),
s8 AS (
  SELECT *,
    signal_1_momentum * w1 + signal_2_macd * w2 + signal_3_rsi * w3 + signal_4_bollinger * w4
      + signal_5_volume * w5 + signal_6_trend_quality * w6 AS marker_raw_score,
    CAST(CASE WHEN vz > 2.0 THEN 1.4 WHEN vz > 1.0 THEN 1.2 WHEN vz > 0 THEN 1.05
         WHEN vz < -2.0 THEN 0.4 WHEN vz < -1.0 THEN 0.6 ELSE 0.85 END AS DOUBLE) AS vconf
  FROM s7
),
sig AS (
  SELECT {', '.join(c for c in SIGNAL_OUT if c not in ('marker_adjusted_score', 'marker_final_score'))},
    {nan_null('CAST(sign(marker_raw_score) AS DOUBLE) * pow(abs(marker_raw_score), 1.0 / vconf)')} AS marker_adjusted_score,
    {nan_null('CAST(sign(marker_raw_score) AS DOUBLE) * pow(abs(marker_raw_score), 1.0 / vconf)')} + 1.0 AS marker_final_score
  FROM s8
)"""


# ---------------------------------------------------------------------------
# Portfolio (2.F) on top of ``sig``
# ---------------------------------------------------------------------------

PORTFOLIOS = "SELECT c_custkey AS portfolio_id, c_acctbal * 1000.0 AS cash, CAST(0 AS BIGINT) AS trades_used FROM customer"
POSITIONS = """
SELECT user_id AS portfolio_id, event_type AS symbol,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS shares,
       floor(sum(floor(value * 100.0 + 0.5)) / count(*) + 0.5) / 100.0 AS avg_price,
       CAST(0.0 AS DOUBLE) AS last_action_signal
FROM events GROUP BY 1, 2
"""
POSITIONS_NUMBERED = f"""
SELECT p.*, row_number() OVER (PARTITION BY portfolio_id ORDER BY first_ts, symbol) AS position_no
FROM ({POSITIONS}) p JOIN (SELECT user_id AS portfolio_id, event_type AS symbol, min(ts) AS first_ts FROM events GROUP BY 1, 2)
  USING (portfolio_id, symbol)
"""


def _kw(order: str = "symbol") -> str:
    return f"OVER (PARTITION BY portfolio_id, cycle ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def portfolio_ctes(max_age_s: int = 6 * 3600, numbered: bool = False) -> str:
    """CTE chain ``sig`` -> fresh signals, valuation, candidates, ``ords`` (orders); ``numbered``: positions have an order of their own."""
    no, by_no = (", position_no", "position_no, symbol") if numbered else ("", "symbol")
    m_no, place = (", m.position_no", "position_no") if numbered else ("", "0")
    from tickwise.operators import portfolio as pf

    strength = (
        f"CASE WHEN marker_final_score <= 1.1 THEN CAST(0.0 AS DOUBLE) ELSE "
        f"least(greatest((marker_final_score - 1.1) / {d(pf.STRENGTH_RANGE)}, 0.0), 1.0) END"
    )
    cyc_w = "OVER (PARTITION BY cycle ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    should = lambda tw: (
        f"(CASE WHEN NOT owned AND {tw} > 0 THEN TRUE WHEN {tw} = 0 AND owned THEN TRUE "
        f"WHEN abs({tw} - current_weight) < 0.03 THEN FALSE "
        f"WHEN owned AND abs(marker_final_score - last_action_signal) < 0.2 THEN FALSE ELSE TRUE END)"
    )
    fmt2 = "printf('%.2f', floor(marker_final_score * 100.0 + 0.5) / 100.0)"
    return f"""
fa AS (
  SELECT *, CASE WHEN CAST(date_trunc('day', ts) AS TIMESTAMP) = ts THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
                 ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY END AS cycle_ts
  FROM sig
),
fb AS (
  SELECT cycle_ts, symbol, ts AS signal_ts, close, atr_14, marker_final_score, regime, regime_confidence, volume
  FROM fa WHERE cycle_ts - ts <= INTERVAL {max_age_s} SECOND
  QUALIFY row_number() OVER (PARTITION BY cycle_ts, symbol ORDER BY ts DESC) = 1
),
cyc AS (SELECT cycle_ts, CAST(row_number() OVER (ORDER BY cycle_ts) AS BIGINT) AS cycle FROM (SELECT DISTINCT cycle_ts FROM fb)),
fc AS (
  SELECT fb.*, cyc.cycle,
    list(marker_final_score) OVER (PARTITION BY symbol ORDER BY cycle ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS signal_history
  FROM fb JOIN cyc USING (cycle_ts)
),
fd AS (
  SELECT *, list_slice(signal_history, greatest(len(signal_history) - 3, 1), len(signal_history)) AS h4 FROM fc
),
fe AS (
  SELECT *, list_reduce(h4, lambda a, x: a + x, CAST(0.0 AS DOUBLE)) / CAST(len(h4) AS DOUBLE) AS hmean FROM fd
),
ff AS (
  SELECT *, sqrt(list_reduce(h4, lambda a, x: a + (x - hmean) * (x - hmean), CAST(0.0 AS DOUBLE)) / CAST(len(h4) AS DOUBLE)) AS hstd FROM fe
),
fresh AS (
  SELECT cycle_ts, cycle, symbol, signal_ts, close, atr_14, marker_final_score, regime, regime_confidence, volume,
    len(signal_history) AS history_len,
    CASE WHEN len(signal_history) < 2 THEN CAST(0.3 AS DOUBLE)
         ELSE greatest(1.0 / (1.0 + CASE WHEN hmean > 0 THEN {tdiv('hstd', 'hmean')} ELSE CAST(1.0 AS DOUBLE) END), 0.3) END AS confidence,
    {strength} AS signal_strength,
    {lavg(f"list(CASE WHEN marker_final_score > 1.1 AND atr_14 > 0 THEN atr_14 END) {cyc_w}")} AS atr_mean
  FROM ff
),
pf AS ({PORTFOLIOS}),
pos AS ({POSITIONS_NUMBERED if numbered else POSITIONS}),
ncyc AS (SELECT max(cycle) AS n FROM fresh),
posc AS (
  SELECT p.*, c.cycle, f.close AS px
  FROM pos p CROSS JOIN (SELECT DISTINCT cycle FROM cyc) c
  LEFT JOIN fresh f ON f.symbol = p.symbol AND f.cycle = c.cycle
),
posv AS (
  SELECT portfolio_id, symbol, cycle, shares, avg_price, last_action_signal{no},
    coalesce(last(px IGNORE NULLS) OVER (PARTITION BY portfolio_id, symbol ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), avg_price) AS current_price
  FROM posc
),
posm AS (SELECT *, CAST(shares AS DOUBLE) * current_price AS market_value FROM posv),
pagg AS (
  SELECT portfolio_id, cycle, list_reduce(list(market_value ORDER BY {by_no}), lambda a, b: a + b, CAST(0.0 AS DOUBLE)) AS mv_sum,
         CAST(count(*) AS BIGINT) AS position_count
  FROM posm GROUP BY 1, 2
),
pval AS (
  SELECT p.portfolio_id, c.cycle, c.cycle_ts, p.cash, p.trades_used,
    CAST(coalesce(a.position_count, 0) AS BIGINT) AS position_count,
    p.cash + coalesce(a.mv_sum, 0.0) AS total_value
  FROM pf p CROSS JOIN cyc c LEFT JOIN pagg a ON a.portfolio_id = p.portfolio_id AND a.cycle = c.cycle
),
ca AS (
  SELECT v.*, f.symbol, f.signal_ts, f.close, f.atr_14, f.marker_final_score, f.regime, f.confidence, f.signal_strength, f.atr_mean,
    m.shares, m.current_price, m.market_value, m.last_action_signal{m_no}, (m.shares IS NOT NULL) AS owned,
    CASE WHEN f.marker_final_score > 1.1 THEN 'buy'
         WHEN NOT f.marker_final_score < 0.9 AND m.shares IS NOT NULL THEN 'hold'
         WHEN f.marker_final_score < 0.9 AND m.shares IS NOT NULL THEN 'sell' END AS bucket
  FROM pval v JOIN fresh f ON f.cycle = v.cycle
  LEFT JOIN posm m ON m.portfolio_id = v.portfolio_id AND m.cycle = v.cycle AND m.symbol = f.symbol
),
cb AS (
  SELECT *, CASE WHEN owned THEN {tdiv('market_value', 'total_value')} ELSE CAST(0.0 AS DOUBLE) END AS current_weight,
    {lsum(f"list(CASE WHEN bucket = 'sell' THEN market_value END) {_kw()}")} AS sells_value
  FROM ca WHERE bucket IS NOT NULL
),
cc AS (
  SELECT *, greatest(cash + sells_value - 0.1 * total_value, 0.0) AS deployable,
    CASE WHEN atr_mean IS NULL THEN CAST(1.0 AS DOUBLE) WHEN atr_14 <= 0 THEN CAST(0.5 AS DOUBLE)
         ELSE least(greatest({tdiv('atr_mean', 'atr_14')}, 0.5), 2.0) END AS vol_adj,
    greatest(1.0 - (current_weight / 0.2) * (current_weight / 0.2), 0.0) AS penalty
  FROM cb
),
cd AS (
  SELECT *, CASE WHEN bucket = 'buy' THEN least(greatest(0.15 * signal_strength * confidence * vol_adj * penalty, 0.05), 0.2) END AS size
  FROM cc
),
ce AS (
  SELECT *, {lsum_nullable(f"list(size) {_kw()}")} AS buy_total, {tdiv('deployable', 'total_value')} AS max_w FROM cd
),
cand AS (
  SELECT *,
    CASE WHEN bucket = 'sell' THEN CAST(0.0 AS DOUBLE) WHEN bucket = 'hold' THEN current_weight
         WHEN deployable > 0 THEN (CASE WHEN buy_total > max_w THEN size * {tdiv('max_w', 'buy_total')} ELSE size END) END AS target_weight
  FROM ce
),
osell AS (
  SELECT portfolio_id, cycle, cycle_ts, symbol, cash, 'SELL' AS action,
    CASE WHEN coalesce(target_weight, 0.0) = 0 THEN shares
         ELSE least(CAST(trunc((market_value - coalesce(target_weight, 0.0) * total_value) / current_price) AS BIGINT), shares) END AS shares,
    current_price AS price,
    CASE WHEN coalesce(target_weight, 0.0) = 0 THEN 'EXIT: Signal ' || {fmt2} || ' bearish'
         ELSE 'TRIM: Rebalance to ' || printf('%.1f', floor(coalesce(target_weight, 0.0) * 1000.0 + 0.5) / 10.0) || '%' END AS reason,
    1 AS priority, coalesce(target_weight, 0.0) AS target_weight, current_weight,
    marker_final_score AS signal_score, signal_strength, confidence, 0 AS side, {place} AS place
  FROM cand WHERE owned AND coalesce(target_weight, 0.0) < current_weight AND {should('coalesce(target_weight, 0.0)')}
),
obuy AS (
  SELECT portfolio_id, cycle, cycle_ts, symbol, cash, 'BUY' AS action,
    CAST(trunc((target_weight * total_value - current_weight * total_value) / close) AS BIGINT) AS shares,
    close AS price,
    CASE WHEN owned THEN 'ADD: Signal ' || {fmt2} || ' strengthening' ELSE 'ENTER: Signal ' || {fmt2} || ' bullish' END AS reason,
    2 + CAST(trunc((2.0 - marker_final_score) * 10.0) AS INTEGER) AS priority, target_weight, current_weight,
    marker_final_score AS signal_score, signal_strength, confidence, 1 AS side, 0 AS place
  FROM cand WHERE target_weight IS NOT NULL AND target_weight <> 0 AND target_weight > current_weight AND {should('target_weight')}
),
oraw AS (
  SELECT *, CAST(shares AS DOUBLE) * price AS dollar_amount,
    row_number() OVER (PARTITION BY portfolio_id, cycle ORDER BY side, place, symbol) AS seq
  FROM (SELECT * FROM osell WHERE shares > 0 UNION ALL SELECT * FROM obuy WHERE shares > 0)
),
oid AS (SELECT *, printf('ORD-%04d-%03d', cycle, seq) AS order_id FROM oraw),
ogrp AS (
  SELECT portfolio_id, cycle, any_value(cash) AS cash,
    list_reduce(list({{'a': action, 'd': dollar_amount, 's': seq}} ORDER BY priority, seq),
      lambda acc, o: CASE WHEN o.a = 'SELL' THEN {{'c': acc.c + o.d, 'k': list_append(acc.k, o.s)}}
                          WHEN acc.c >= o.d THEN {{'c': acc.c - o.d, 'k': list_append(acc.k, o.s)}}
                          ELSE acc END,
      {{'c': any_value(cash), 'k': CAST([] AS BIGINT[])}}).k AS kept
  FROM oid GROUP BY 1, 2
),
ocap AS (
  SELECT g.*, len(kept) AS n,
    least(30, p.trades_used + coalesce(sum(len(kept)) OVER (PARTITION BY g.portfolio_id ORDER BY g.cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS used
  FROM ogrp g JOIN pf p USING (portfolio_id)
),
okeep AS (
  SELECT portfolio_id, cycle, unnest(list_slice(kept, 1, greatest(0, least(n, 30 - used)))) AS seq FROM ocap
),
ords AS (
  SELECT o.portfolio_id, o.cycle, o.order_id, o.symbol, o.action, o.shares, o.price, o.dollar_amount, o.reason, o.priority,
         o.target_weight, o.current_weight, o.signal_score, o.signal_strength, o.confidence, o.cycle_ts AS ts
  FROM oid o JOIN okeep k USING (portfolio_id, cycle, seq)
)"""


# ---------------------------------------------------------------------------
# ML preparation (2.L) on top of ``bars``
# ---------------------------------------------------------------------------

ML_FEATURES = [
    "open", "high", "low", "close", "volume", "sma_5", "sma_10", "ema_7", "ema_11",
    "macd", "macd_signal", "macd_histogram", "atr_14", "momentum", "bb_upper", "bb_lower",
    "volume_ratio", "volume_ma_15", "rsi", "price_change", "price_change_pct",
]


def _ew_ml(e: str, x: str, span: int) -> str:
    a = d(2.0 / (span + 1.0))
    return f"(CASE WHEN {e} IS NULL THEN {x} WHEN {e} <> {x} THEN ((1.0 - {a}) * {e} + {a} * {x}) / ((1.0 - {a}) + {a}) ELSE {e} END)"


def ml_ewm_fold(hist: str) -> str:
    """pandas ``ewm(adjust=False)`` from the first row (no gaps): EMA 7/11/12/26 and signal 9 of the line."""
    e12, e26 = _ew_ml("acc.e12", "x", 12), _ew_ml("acc.e26", "x", 26)
    line = f"(({e12}) - ({e26}))"
    step = (
        "{" + f"'e7': {_ew_ml('acc.e7', 'x', 7)}, 'e11': {_ew_ml('acc.e11', 'x', 11)}, 'e12': {e12}, 'e26': {e26}, "
        f"'sg': {_ew_ml('acc.sg', line, 9)}" + "}"
    )
    init = "{" + ", ".join(f"'{k}': CAST(NULL AS DOUBLE)" for k in ("e7", "e11", "e12", "e26", "sg")) + "}"
    return f"list_reduce({hist}, lambda acc, x: {step}, {init})"


def ml_feature_ctes(bars_sql: str) -> str:
    """``bars`` -> ``mlf`` (21 features + target, C2 applied), ``mlc`` (C11 drop),
    ``mls`` (L1 split), ``mlst`` (G8 train stats), ``mlz`` (L2 scaled)."""
    unb = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    unb1 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    feats = ", ".join(ML_FEATURES)
    stats = ", ".join(
        f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std, min({c}) AS {c}__min, max({c}) AS {c}__max" for c in ML_FEATURES
    )
    unpivot = " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS feature, {c}__mean AS mean, {c}__std AS std, {c}__min AS min, {c}__max AS max FROM mlw" for c in ML_FEATURES
    )
    scaled = ", ".join(
        f"(m.{c} - s_{c}.mean) / (CASE WHEN s_{c}.std < {d(10 * 2.220446049250313e-16)} THEN 1.0 ELSE s_{c}.std END) AS {c}"
        for c in ML_FEATURES
    )
    joins = " ".join(f"JOIN mlst s_{c} ON s_{c}.symbol = m.symbol AND s_{c}.feature = '{c}'" for c in ML_FEATURES)
    return f"""
bars AS ({bars_sql}),
m1 AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev_close,
    list(close) {last(5)} AS c5, list(close) {last(10)} AS c10, list(close) {last(20)} AS c20,
    list(volume) {last(20)} AS v20, list(volume) {last(15)} AS v15,
    list(close) {unb} AS hall,
    last(close IGNORE NULLS) {unb} AS cf, last(close IGNORE NULLS) {unb1} AS cfp
  FROM bars
),
m2 AS (
  SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr,
    CASE WHEN close - prev_close > 0 THEN close - prev_close ELSE CAST(0.0 AS DOUBLE) END AS g,
    CASE WHEN close - prev_close < 0 THEN -(close - prev_close) ELSE CAST(0.0 AS DOUBLE) END AS l,
    {ml_ewm_fold('hall')} AS acc
  FROM m1
),
m3 AS (SELECT *, list(tr) {last(14)} AS tr14, list(g) {last(14)} AS g14, list(l) {last(14)} AS l14 FROM m2),
m4 AS (
  SELECT *, {lavg_full('c5', 5)} AS sma_5, {lavg_full('c10', 10)} AS sma_10, {lavg_full('tr14', 14)} AS atr_14,
    {lavg_full('c20', 20)} AS sma20, CASE WHEN {lcnt('c20')} = 20 THEN {lstd('c20')} END AS sd20,
    {lavg_full('v20', 20)} AS vavg20, {lavg_full('v15', 15)} AS volume_ma_15,
    {lavg_full('g14', 14)} AS ag, {lavg_full('l14', 14)} AS al,
    close - prev_close AS price_change, ({tdiv('cf', 'cfp')} - 1.0) * 100.0 AS price_change_pct,
    acc.e7 AS ema_7, acc.e11 AS ema_11, acc.e12 - acc.e26 AS macd, acc.sg AS macd_signal, (acc.e12 - acc.e26) - acc.sg AS macd_histogram
  FROM m3
),
m5 AS (
  SELECT *, {tdiv('close - sma20', 'sma20')} AS momentum, sma20 + sd20 * 2.0 AS bb_upper, sma20 - sd20 * 2.0 AS bb_lower,
    {tdiv('volume', 'vavg20')} AS volume_ratio,
    CASE WHEN al = 0 THEN (CASE WHEN ag > 0 THEN CAST(100.0 AS DOUBLE) END) ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS rsi,
    lead(price_change_pct, 1) OVER (PARTITION BY symbol ORDER BY ts) AS target
  FROM m4
),
mlf AS (
  SELECT symbol, ts, {', '.join(f'{nan_null(c)} AS {c}' for c in ML_FEATURES + ['target'])} FROM m5
),
mlc AS (SELECT * FROM mlf WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ML_FEATURES + ['target'])}),
mls0 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS BIGINT) AS position,
    CAST(count(*) OVER (PARTITION BY symbol) AS BIGINT) AS n_sym
  FROM mlc
),
mls AS (
  SELECT *, CASE WHEN position < CAST(floor(n_sym * 0.7) AS BIGINT) THEN 'train'
                 WHEN position < CAST(floor(n_sym * 0.7) AS BIGINT) + CAST(floor(n_sym * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split,
    position - CASE WHEN position < CAST(floor(n_sym * 0.7) AS BIGINT) THEN 0
                    WHEN position < CAST(floor(n_sym * 0.7) AS BIGINT) + CAST(floor(n_sym * 0.15) AS BIGINT) THEN CAST(floor(n_sym * 0.7) AS BIGINT)
                    ELSE CAST(floor(n_sym * 0.7) AS BIGINT) + CAST(floor(n_sym * 0.15) AS BIGINT) END AS split_pos
  FROM mls0
),
mlw AS (SELECT symbol, {stats} FROM mls WHERE split = 'train' GROUP BY symbol),
mlst AS ({unpivot}),
mlz AS (SELECT m.symbol, m.ts, m.target, m.position, m.n_sym, m.split, m.split_pos, {scaled} FROM mls m {joins})"""
