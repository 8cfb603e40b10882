"""portfolios are valued without the candidates of every cycle being written first."""

from tests.conftest import SF001
from tickwise.operators import portfolio as pf
from tickwise.plans import catalog
from tickwise.sources import fixtures as fx


def test_valuation_writes_no_candidates(spark, monkeypatch):
    cut, real = [], pf.cut_lineage
    monkeypatch.setattr(pf, "cut_lineage", lambda df, *a: cut.append(df.columns) or real(df, *a))
    out = pf.rebalance(fx.portfolios(spark, SF001), fx.positions(spark, SF001), catalog.hourly_signals(spark, SF001))
    assert cut and not [c for c in cut if "portfolio_id" in c]
    assert out["orders"].count() > 0
