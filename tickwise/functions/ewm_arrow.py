"""Trailing frames of sorted series in one Arrow pass (``mapInArrow``): EMA/MACD, MACD alignment, rank and median.

Rows come sorted by series and time, one value per row; a row's frame is a
sliding view over the values before it, and what a frame needs from an earlier
batch is carried along.  Nothing is collected into the rows.  The recurrence
of :mod:`tickwise.functions.exprs` runs column by column over the views of a
whole batch (left-padded with NaN: leading gaps do not change a pandas EWM),
with the same operations in the same order, so the doubles equal those of the
SQL fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPANS = (7, 11, 12, 26)
OUT_COLS = ("ema_7", "ema_11", "macd_line", "macd_signal")
E2_BACK = 14          # E2 looks at the MACD line of the current and 14 previous rows
E2_OUT = "signal_2_macd"


def _alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def _ew(e, w, x, a, obs):
    w1 = w * (1.0 - a)
    known = ~np.isnan(e)
    upd = np.where(e != x, (w1 * e + a * x) / (w1 + a), e)
    new_e = np.where(known, np.where(obs, upd, e), x)
    new_w = np.where(known, np.where(obs, 1.0, w1), w)
    return new_e, new_w


def sliding(values: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """``rows x width``: the values up to each of the last ``len(before)`` rows, NaN beyond its ``before`` predecessors."""
    rows = np.arange(len(before)) + len(values) - len(before)
    place = rows[:, None] + np.arange(1 - width, 1)
    out = values[np.maximum(place, 0)]
    out[np.arange(1 - width, 1) < -before[:, None]] = np.nan
    return out


def ema_macd_matrix(m: np.ndarray) -> dict[str, np.ndarray]:
    n_rows, width = m.shape
    e = {s: np.full(n_rows, np.nan) for s in SPANS}
    w = {s: np.ones(n_rows) for s in SPANS}
    nobs = np.zeros(n_rows, dtype=np.int64)
    sg, wg = np.full(n_rows, np.nan), np.ones(n_rows)
    ng = np.zeros(n_rows, dtype=np.int64)
    a9 = _alpha(9)
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(width):
            x = m[:, j]
            obs = ~np.isnan(x)
            nobs = nobs + obs
            for s in SPANS:
                e[s], w[s] = _ew(e[s], w[s], x, _alpha(s), obs)
            line_obs = nobs >= 26
            line = np.where(line_obs, e[12] - e[26], np.nan)
            sg, wg = _ew(sg, wg, line, a9, line_obs)
            ng = ng + line_obs
        return {
            "ema_7": np.where(nobs >= 7, e[7], np.nan),
            "ema_11": np.where(nobs >= 11, e[11], np.nan),
            "macd_line": np.where(nobs >= 26, e[12] - e[26], np.nan),
            "macd_signal": np.where(ng >= 9, sg, np.nan),
        }


def _clean_step(e, x, ax, w1, total):
    """One step of :func:`_ew` where the value and the average are known: the weight is 1, and so is ``total`` as a rule."""
    new = w1 * e
    new += ax
    if total != 1.0:
        new /= total
    np.copyto(new, e, where=e == x)
    return new


def _clean(cols: list[np.ndarray], seen: np.ndarray | int) -> dict[str, np.ndarray]:
    """EMA and MACD of frames without a missing value, the ``j``-th values of all frames in ``cols[j]``.

    Frames of fewer rows (``seen`` of them) have their first value repeated in
    front, which an average does not move from.
    """
    width = len(cols)
    const = {s: (1.0 * (1.0 - _alpha(s)), 1.0 * (1.0 - _alpha(s)) + _alpha(s)) for s in (*SPANS, 9)}
    e = {s: cols[0] for s in SPANS}
    start = width - seen + 25            # place of the first MACD line
    some = not np.isscalar(seen)
    sg = None
    for j in range(width):
        x = cols[j]
        if j:
            for s in SPANS:
                e[s] = _clean_step(e[s], x, _alpha(s) * x, *const[s])
        if some or j >= start:
            line = e[12] - e[26]
            if sg is None:
                sg = line
            else:
                new = _clean_step(sg, line, _alpha(9) * line, *const[9])
                sg = np.where(j > start, new, line) if some else new
    return {
        "ema_7": np.where(seen >= 7, e[7], np.nan), "ema_11": np.where(seen >= 11, e[11], np.nan),
        "macd_line": np.where(seen >= 26, e[12] - e[26], np.nan), "macd_signal": np.where(seen >= 34, sg, np.nan),
    }


#: beyond this a difference of two averages might not be finite
_SAFE = 1e300


def ema_macd_series(values: np.ndarray, before: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """:func:`ema_macd_matrix` over the frames of the last ``len(before)`` rows of ``values``, a shifted view at a time.

    Frames with a missing or huge value, which the plain steps do not cover,
    run through the matrix.
    """
    n, lead = len(before), len(values) - len(before)
    seen = np.minimum(before, width - 1) + 1
    odd = np.concatenate([[0], np.cumsum(~(np.abs(values) < _SAFE))])
    end = np.arange(n) + lead + 1
    clean = odd[end] == odd[np.maximum(end - seen, 0)]
    out = {c: np.full(n, np.nan) for c in OUT_COLS}
    skip = max(width - 1 - lead, 0)      # rows whose frame would begin before the first value
    if n > skip:
        at = lead + skip - width + 1
        whole = _clean([values[at + j : at + j + n - skip] for j in range(width)], width)
        for c in OUT_COLS:
            out[c][skip:] = whole[c]
    short = np.flatnonzero(clean & (seen < width))
    if len(short):
        place = np.maximum(np.arange(1 - width, 1)[:, None], 1 - seen[short]) + short + lead
        for c, v in _clean(list(values[place]), seen[short]).items():
            out[c][short] = v
    rest = np.flatnonzero(~clean)
    if len(rest):
        place = (rest + lead)[:, None] + np.arange(1 - width, 1)
        m = values[np.maximum(place, 0)]
        m[np.arange(1 - width, 1) < -before[rest][:, None]] = np.nan
        for c, v in ema_macd_matrix(m).items():
            out[c][rest] = v
    return out


def _masked(fn, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Row-wise max or min over valid, non-NaN entries; NaN when there is none."""
    ok = valid & ~np.isnan(x)
    fill = -np.inf if fn is np.max else np.inf
    return np.where(ok.any(axis=1), fn(np.where(ok, x, fill), axis=1), np.nan)


def macd_alignment(lines: np.ndarray, signals: np.ndarray, before: np.ndarray) -> np.ndarray:
    """E2 of the last ``len(before)`` rows: range of the 15 lines (at least 1e-8), velocity against the line 9
    rows back, line - signal against the largest gap."""
    back = E2_BACK
    line_view, signal_view = sliding(lines, before, back + 1), sliding(signals, before, back + 1)
    exists = np.arange(-back, 1) >= -before[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        hi, lo = _masked(np.max, line_view, exists), _masked(np.min, line_view, exists)
        rng = np.where(np.isnan(hi), 1e-8, np.maximum(hi - lo, 1e-8))
        line, sig = line_view[:, -1], signal_view[:, -1]
        velocity = (line - line_view[:, back - 9]) / rng
        den = _masked(np.max, np.abs(line_view - signal_view), exists) + 1e-8
        position = np.where(den == 0, np.nan, (line - sig) / den)
        combined = 0.6 * velocity + 0.4 * position
        return np.where(np.isnan(combined), np.nan, np.maximum(-1.0, np.minimum(1.0, combined)))


def below_last(view: np.ndarray) -> np.ndarray:
    """How many values of each frame are less than its last."""
    return (view < view[:, -1:]).sum(axis=1)


def median(view: np.ndarray) -> np.ndarray:
    """The middle of the values present in each frame, or the mean of the two; NaN without any."""
    ordered = np.sort(view, axis=1)              # NaN come last
    n = (~np.isnan(view)).sum(axis=1)
    row = np.arange(len(view))
    low, high = ordered[row, np.maximum(n - 1, 0) // 2], ordered[row, np.minimum(n // 2, view.shape[1] - 1)]
    return np.where(n % 2 == 1, low, (low + high) / 2.0)


class Carry:
    """The last values of the series that a batch ends in, for the next batch."""

    def __init__(self) -> None:
        self.key, self.run, self.values = None, 0, {}

    def before(self, keys: list[pa.Array]) -> np.ndarray:
        """Predecessors of each row of the batch in its series; forgets the carried values if a new series begins."""
        n = len(keys[0])
        start = np.zeros(n, bool)
        for k in keys:
            start[1:] |= ~pc.fill_null(pc.equal(k.slice(1), k.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        if self.key != tuple(k[0].as_py() for k in keys):
            start[0] = True
            self.run, self.values = 0, {}
        idx = np.arange(n)
        first = np.maximum.accumulate(np.where(start, idx, -1))
        before = np.where(first >= 0, idx - first, idx + self.run)
        self.key, self.run = tuple(k[-1].as_py() for k in keys), int(before[-1]) + 1
        return before

    def joined(self, name: str, x: np.ndarray, width: int) -> np.ndarray:
        """The carried values and the batch's; the last ``width`` are carried on."""
        both = np.concatenate([self.values.get(name, np.zeros(0)), x])
        self.values[name] = both[max(len(both) - width, 0):]
        return both


def _col(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


RANK_OUT, ROWS_OUT, MEDIAN_OUT = "_below", "_rows", "_median"


def make_mapper(close: str, width: int, keep: list[str], part: list[str], e2: bool = False, rank: str | None = None,
                middle: tuple[str, int] | None = None, only: str | None = None):
    """A ``mapInArrow`` function adding OUT_COLS over frames of ``width`` rows of ``close`` to the columns ``keep``.

    Rows must be sorted by the series key ``part`` and time.  ``e2`` adds the
    MACD alignment, ``rank`` the rank of a column's value in its frame
    (RANK_OUT of ROWS_OUT rows), ``middle`` the median of a column over so many
    rows (MEDIAN_OUT).  Rows whose column ``only`` is not true are read but not
    returned.
    """

    def doubles(b: pa.RecordBatch, name: str) -> np.ndarray:
        return pc.fill_null(_col(b, name), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)

    def mapper(batches):
        carry = Carry()
        for b in batches:
            if b.num_rows == 0:
                continue
            before = carry.before([_col(b, c) for c in part])
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                out = ema_macd_series(carry.joined("close", doubles(b, close), width), before, width)
            if e2:
                lines = carry.joined("line", out["macd_line"], E2_BACK + 1)
                signals = carry.joined("signal", out["macd_signal"], E2_BACK + 1)
                out[E2_OUT] = macd_alignment(lines, signals, before)
            if rank is not None:
                out[RANK_OUT] = below_last(sliding(carry.joined("rank", doubles(b, rank), width), before, width)).astype(np.float64)
                out[ROWS_OUT] = np.minimum(before + 1, width).astype(np.float64)
            if middle is not None:
                out[MEDIAN_OUT] = median(sliding(carry.joined("middle", doubles(b, middle[0]), middle[1]), before, middle[1]))
            arrays = [_col(b, c) for c in keep] + [pa.array(v, mask=np.isnan(v), type=pa.float64()) for v in out.values()]
            made = pa.RecordBatch.from_arrays(arrays, names=list(keep) + list(out))
            yield made if only is None else made.filter(pc.fill_null(_col(b, only), False))

    return mapper


def out_columns(e2: bool = False, rank: str | None = None, middle: tuple[str, int] | None = None) -> list[str]:
    """Names that :func:`make_mapper` adds, in order."""
    return [*OUT_COLS, *([E2_OUT] if e2 else []), *([RANK_OUT, ROWS_OUT] if rank else []), *([MEDIAN_OUT] if middle else [])]


def _ship_by_value():
    """Python workers may not have this package on their path: send the
    module's code with the task instead of a reference to it."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
