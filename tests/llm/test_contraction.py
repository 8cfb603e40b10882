"""Near-dup's contraction works on what still has links; few pairs and nodes take fewer passes; the groups are the same."""

import pytest
from tickwise.llm import neardup


@pytest.fixture
def written(monkeypatch):
    """Names of the frames that near-dup writes."""
    names, stash = [], neardup.stash
    monkeypatch.setattr(neardup, "stash", lambda df, name: (names.append(name), stash(df, name))[1])
    return names


def test_all_nodes_meet_the_moves_once(spark, written, monkeypatch):
    """A chain takes some rounds; before, every round joined all nodes."""
    nodes = spark.range(500).select(neardup.F.col("id").alias("node"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 400)], "a long, b long")
    for few in (10_000, 0):
        monkeypatch.setattr(neardup, "FEW_EDGES", few)
        written.clear()
        found = {r["node"]: r["root"] for r in neardup.components(nodes, edges).collect()}
        assert written.count("to") > 2 and written.count("state") == 1
        assert sorted(found) == list(range(500)) and len(set(found.values())) == 500 - 200 - 99
        assert len({found[i] for i in range(201)}) == 1 and len({found[i] for i in range(300, 400)}) == 1
        assert all(found[v] == v for v in found.values())
    assert neardup.components(nodes, edges.limit(0)).where("node = root").count() == 500


def test_groups_of_few_and_many_rows(spark, written, monkeypatch):
    """A chain of texts, alike only from one to the next, near copies of one text and clean ones."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(40)]
    star = [(100 + i, " ".join([f"s{j}" for j in range(60)] + [f"t{i}"])) for i in range(40)]
    clean = [(200 + i, " ".join(f"c{i}x{j}" for j in range(30))) for i in range(10)]
    docs = spark.createDataFrame(chain + star + clean + [(300, chain[7][1]), (301, ""), (302, None)], "doc_id long, text string")
    want = {i: 0 for i, _ in chain} | {i: 100 for i, _ in star} | {i: i for i, _ in clean} | {300: 0, 301: 301, 302: 302}
    got = {r["id"]: r["component_id"] for r in neardup.groups(docs).collect()}
    assert got == want
    assert "near" not in written and "hot" not in written  # before: the sketches' pass was written for any number of pairs
    for name in ("FEW_PAIRS", "FEW_NODES", "FEW_EDGES"):
        monkeypatch.setattr(neardup, name, 0)
    assert {r["id"]: r["component_id"] for r in neardup.groups(docs).collect()} == want and "near" in written


def test_later_turns_link_components(spark, written):
    """A chain in one bucket: a pivot links its neighbours, later turns the components; before, each turn contracted all links anew."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(30)] + [(90, "else where")], "doc_id long, text string")
    nodes = neardup.stash(neardup.signatures(docs, "doc_id", "text", 2, full=True).drop("id"), "given")
    members = nodes.selectExpr("0 AS band", "5L AS h", "node")
    for few in (True, False):
        written.clear()
        sizes = neardup.linked(members, nodes, 80, few).groupBy("root").count().collect()
        assert sorted(r["count"] for r in sizes) == [1, 30]
        assert written.count("links") > 1 and written.count("state") <= neardup.STAR_ROUNDS + 1
