"""End-to-end flows composed from the operators (the reference's entry points).

* :func:`enriched_bars` / :func:`signals` - stream entry point A + B in batch form
  (bars -> D27 -> E11), on the skew-safe layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickwise.operators import chunking
from tickwise.operators import indicators as ind
from tickwise.operators import signals as sg


def enriched_bars(bars: DataFrame, chunk_rows: int | None = chunking.DEFAULT_CHUNK_ROWS, force_chunks: bool = False) -> DataFrame:
    """D27 for every bar (ungated), hot symbols split into chunks with a halo.

    ``chunk_rows=None`` is for bars known to have no hot symbol: they are neither written nor counted.
    """
    lay = chunking.layout(bars, chunk_rows, force=force_chunks)
    return lay.own(ind.enrich(lay.rows, lay.spec))


def signals(bars: DataFrame, chunk_rows: int | None = chunking.DEFAULT_CHUNK_ROWS, force_chunks: bool = False,
            newest: bool = False, dealt: bool = False) -> DataFrame:
    """E11 from bars: indicators and the frames of the signals in one pass per series.

    With ``newest`` every row is computed as well, but the pass returns the last
    SIGNAL row of each series and batch, among which E12 finds the newest.
    ``dealt``: the bars come dealt by symbol (with ``chunk_rows=None`` only).
    """
    lay = chunking.layout(bars, chunk_rows, force=force_chunks)
    enr = ind.enrich(lay.rows, lay.spec, signals=True, newest=newest, dealt=dealt and not lay.chunked)
    extra = ("chunk", "_own_chunk") if lay.chunked else ()
    return lay.own(sg.signal_table(enr, lay.spec, extra=extra))
