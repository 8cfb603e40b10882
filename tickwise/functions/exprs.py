"""Column-expression helpers shared by all operators.

Everything here returns a ``Column`` built from built-in Spark functions, so it
stays inside the JVM and inside whole-stage code generation where Spark allows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

EPS_SMALL = 1e-8
EPS_VOLUME = 1e-6
EPS_PERCENT = 0.01


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def r6(c) -> Column:
    """Round to 6 decimals with plain IEEE arithmetic (``floor(x*1e6+0.5)/1e6``).

    The same formula is used in the SQL oracles, so both engines round every
    value to the same double; ``+ 0.0`` folds ``-0.0`` into ``0.0``.
    """
    c = col(c)
    return (F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)) + F.lit(0.0)


def tdiv(a, b) -> Column:
    """Division that yields null for a zero or null divisor (never throws under ANSI)."""
    return F.try_divide(col(a), col(b))


def clip(x, lo: float, hi: float) -> Column:
    """``np.clip`` semantics: null stays null (greatest/least would skip it)."""
    x = col(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    )


def sign(x) -> Column:
    return F.signum(col(x))


def nan_to_null(x) -> Column:
    """NaN and +-Inf become null."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def nan_to_null_all(df):
    """Apply :func:`nan_to_null` to every float/double column of ``df``."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            exprs.append(nan_to_null(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def round_doubles(df, skip: tuple[str, ...] = ()):
    """Round every double column with :func:`r6` (output boundary of a query)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType) and f.name not in skip:
            exprs.append(r6(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


# ---------------------------------------------------------------------------
# Windowed exponential smoothing as a fold over the frame's values.
#
# pandas ``ewm(span=n, adjust=False)`` (ignore_na=False) keeps a running value
# ``e`` and an old-weight ``w``.  For each position:
#   * value present, e known : w <- w*(1-a); e <- (w*e + a*x)/(w + a) unless e == x; w <- 1
#   * value missing, e known : w <- w*(1-a)
#   * e unknown              : e <- x (w stays 1)
# ``min_periods`` counts present values.  One fold computes EMA 7, EMA 11 and
# MACD (12/26 line, 9 signal over the line, the line starting once 26 closes
# have been seen).  The step is written once as SQL text and rendered for
# Spark (``aggregate``) and for DuckDB (``list_reduce``), so both engines do the
# same arithmetic in the same order.
# ---------------------------------------------------------------------------

def _alpha(span: int) -> str:
    return f"CAST('{2.0 / (span + 1.0)!r}' AS DOUBLE)"


def _ew_update(e: str, w: str, x: str, a: str, obs: str) -> tuple[str, str]:
    """SQL text for the new (e, w) after seeing value ``x`` (``obs`` = x present)."""
    w1 = f"({w} * (1.0 - {a}))"
    new_e = (
        f"CASE WHEN {e} IS NULL THEN {x} "
        f"WHEN {obs} THEN (CASE WHEN {e} <> {x} THEN ({w1} * {e} + {a} * {x}) / ({w1} + {a}) ELSE {e} END) "
        f"ELSE {e} END"
    )
    new_w = (
        f"CASE WHEN {e} IS NULL THEN {w} "
        f"WHEN {obs} THEN 1.0 ELSE {w1} END"
    )
    return new_e, new_w


def _line(acc: str) -> tuple[str, str]:
    """MACD line at the accumulator's last position and whether it exists."""
    return f"(CASE WHEN {acc}.n >= 26 THEN {acc}.e12 - {acc}.e26 END)", f"({acc}.n >= 26)"


def _signal_update(acc: str) -> tuple[str, str, str]:
    """Signal-EMA (e, w, count) after feeding the line of ``acc``'s last position."""
    line, line_obs = _line(acc)
    se, sw = _ew_update(f"{acc}.sg", f"{acc}.wg", line, _alpha(9), line_obs)
    seen = f"({acc}.p >= 1)"
    return (
        f"(CASE WHEN {seen} THEN {se} ELSE {acc}.sg END)",
        f"(CASE WHEN {seen} THEN {sw} ELSE {acc}.wg END)",
        f"({acc}.ng + CASE WHEN {seen} AND {line_obs} THEN 1 ELSE 0 END)",
    )


def ema_fold_step(acc: str = "acc", x: str = "x") -> list[tuple[str, str]]:
    """Field list (name, SQL) of the accumulator after one step.

    The signal EMA runs one position behind: a step first feeds the line of
    the previous position (stored e12/e26), then advances the price EMAs, so
    nothing is computed twice; :func:`ema_outputs` feeds the last line.
    """
    obs = f"({x} IS NOT NULL)"
    fields: list[tuple[str, str]] = [("p", f"({acc}.p + 1)"), ("n", f"({acc}.n + CASE WHEN {obs} THEN 1 ELSE 0 END)")]
    for span in (7, 11, 12, 26):
        e, w = _ew_update(f"{acc}.e{span}", f"{acc}.w{span}", x, _alpha(span), obs)
        fields.append((f"e{span}", e))
        fields.append((f"w{span}", w))
    sg, wg, ng = _signal_update(acc)
    fields += [("sg", sg), ("wg", wg), ("ng", ng)]
    return fields


_ACC_TYPES = {"p": "BIGINT", "n": "BIGINT", "ng": "BIGINT"}


def _init_fields() -> list[tuple[str, str]]:
    out = [("p", "0"), ("n", "0")]
    for span in (7, 11, 12, 26):
        out += [(f"e{span}", "NULL"), (f"w{span}", "1.0")]
    out += [("sg", "NULL"), ("wg", "1.0"), ("ng", "0")]
    return out


def _typed(name: str, sql: str) -> str:
    return f"CAST({sql} AS {_ACC_TYPES.get(name, 'DOUBLE')})"


def ema_fold_sql(hist: str) -> str:
    """SQL text folding ``hist`` (``array<double>``, NaN for a missing close, see ``with_history``) into the EMA accumulator."""
    missing = "nullif(x, CAST('NaN' AS DOUBLE))"
    mk = lambda fs: "named_struct(" + ", ".join(f"'{n}', {_typed(n, s)}" for n, s in fs) + ")"
    return f"aggregate({hist}, {mk(_init_fields())}, (acc, x) -> {mk(ema_fold_step(x=missing))})"


def ema_outputs(acc: str) -> dict[str, str]:
    """SQL text of the EMA / MACD outputs from a finished accumulator ``acc``."""
    sg, _, ng = _signal_update(acc)
    return {
        "ema_7": f"CASE WHEN {acc}.n >= 7 THEN {acc}.e7 END",
        "ema_11": f"CASE WHEN {acc}.n >= 11 THEN {acc}.e11 END",
        "macd_line": f"CASE WHEN {acc}.n >= 26 THEN {acc}.e12 - {acc}.e26 END",
        "macd_signal": f"CASE WHEN {ng} >= 9 THEN CAST({sg} AS DOUBLE) END",
    }
