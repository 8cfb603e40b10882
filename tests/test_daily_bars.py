"""Daily bars go to the indicator pass by one shuffle of the lines; a hot supplier still takes the chunked layout."""

from __future__ import annotations

import os
import re

import pytest

from tickwise.operators import chunking
from tickwise.plans import catalog
from tickwise.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _written(spark) -> int:
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return sum(name.startswith("bars-") for name in os.listdir(at))


@pytest.mark.parametrize("name", ["d27_enriched_bars", "e11_signal_table", "e12_latest_signal"])
def test_one_shuffle_no_copy(spark, name):
    before = _written(spark)
    df = catalog.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert _written(spark) == before
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", plan)) == (2 if name.startswith("e12") else 1)
    assert "l_shipdate" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


@pytest.mark.parametrize("name", ["d27_enriched_bars", "e11_signal_table", "e12_latest_signal"])
def test_hot_supplier_is_chunked(spark, name, monkeypatch):
    plain = _rows(catalog.QUERIES[name](spark, SF))
    before = _written(spark)
    monkeypatch.setattr(chunking, "DEFAULT_CHUNK_ROWS", 150)
    assert fx.most_lines(spark, SF) > 150
    assert _rows(catalog.QUERIES[name](spark, SF)) == plain and plain
    assert _written(spark) > before


def test_bars_do_not_depend_on_how_lines_are_dealt(spark):
    assert _rows(fx.bars_daily(spark, SF, by_symbol=True)) == _rows(fx.bars_daily(spark, SF))
