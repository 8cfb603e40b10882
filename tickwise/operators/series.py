"""Per-series window specification shared by indicator and signal operators.

A *series* is one symbol's bars in time order.  The plain layout windows over
``partitionBy(symbol).orderBy(ts)``.  The chunked layout (see
:mod:`tickwise.operators.chunking`) windows over ``(symbol, chunk)`` ordered by
the global per-symbol row number ``rn`` so one hot symbol is spread over many
tasks; operators do not care which one they get.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesSpec:
    part: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    def base(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*[F.col(c) for c in self.order])

    def rows(self, lo, hi=0) -> WindowSpec:
        return self.base().rowsBetween(lo, hi)

    def last(self, n: int) -> WindowSpec:
        """Frame of the last ``n`` rows ending at the current row."""
        return self.rows(-(n - 1), 0)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.part)


PLAIN = SeriesSpec()
