"""Joins are salted where a key is hot, and plain, with a small plan, elsewhere; the rows are the same."""

from pyspark.sql import functions as F

from tickwise.llm import neardup
from tickwise.llm.common import hot_keys, is_hot, salted_join


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_join_without_hot_key_is_plain(spark):
    many = spark.range(5000).select((F.col("id") % 1000).alias("key"), "id")
    one = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    assert not is_hot(many, ["key"]) and hot_keys(many, ["key"]).isEmpty()
    for out, rows in ((salted_join(many, one, ["key"]), 5000), (salted_join(many, one, ["key"], on=F.expr("v > 998")), 2500)):
        assert "_salt" not in _plan(out) and "Aggregate" not in _plan(out)  # before: two more joins and counts of the keys
        assert out.count() == rows and set(out.columns) == {"key", "id", "v"}
    assert not is_hot(many.limit(0), ["key"])


def test_join_with_hot_key_is_salted(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("key"), "id")
    one = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    assert is_hot(many, ["key"]) and "_salt" in _plan(salted_join(many, one, ["key"]))


def test_components_of_few_and_many_edges(spark, monkeypatch):
    """A star, whose centre is hot, a chain and a node of its own: the same roots on both ways."""
    edges = [(0, i) for i in range(1, 600)] + [(i, i + 1) for i in range(1000, 1040)]
    ends = sorted({x for e in edges for x in e} | {5000})
    nodes = spark.createDataFrame([(x,) for x in ends], "node long")
    links = spark.createDataFrame(edges, "a long, b long")
    for few in (10_000, 0):
        monkeypatch.setattr(neardup, "FEW_EDGES", few)
        found = {r["node"]: r["root"] for r in neardup.components(nodes, links).collect()}
        assert sorted(found) == ends
        assert len({found[x] for x in range(600)}) == 1 and len({found[x] for x in range(1000, 1041)}) == 1
        assert len(set(found.values())) == 3 and found[5000] == 5000
