"""Chat rotation, URL verdicts, near duplicates, decontamination, quality rules and the pipeline against brute force."""

import collections
import hashlib
import re

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tickwise.llm import chatformat, decontam, neardup, quality, urlfilter
from tickwise.llm.common import hot_keys, salted_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w"), (2, "A B c d e f g h i j k l m n o p q r s t u v w x"), (3, None), (4, ""),
    (5, " \n"), (6, "one"), (7, "ONE"), (8, "one two"), (9, "a b c d e f g h i j k l m n o p q r s t u v w"), (10, "É one"), (11, "é one"),
    (12, "b c a " * 400), (13, "b c a " * 401), (14, "x\ny\nx\n\ny z\nx"), (14, "x\ny\nx\n\ny z\nx"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, -1, "?") for i, t in rows], "doc_id long, text string, n_words int, k string")


def brute_groups(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_groups_equal_brute_force(spark, sf_small):
    for size in (2, 5):
        got = sorted(tuple(r) for r in neardup.groups(frame(spark), size=size).collect())
        assert got == brute_groups(TEXTS, size, 80)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in neardup.groups(frame(spark, rows)).collect())
    assert got == brute_groups(rows, 2, 80)


def test_groups_of_a_chain_of_copies(spark):
    """Neighbours are similar, the ends are not: one component, found without all pairs."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(80)]
    got = sorted(tuple(r) for r in neardup.groups(frame(spark, rows)).collect())
    assert got == brute_groups(rows, 2, 80)
    assert neardup.groups(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_last_pairs_miss_none_between_components(spark):
    """The exact prefix filter: every similar pair of different components, once, none inside one; a leading component and minor ones."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**62, 60)
    sets = {}
    for i in range(120):
        keep = base[rng.random(60) > 0.06]
        sets[i] = np.unique(np.concatenate([keep, rng.integers(1, 2**62, 3)])).astype(np.int64)
    root = {i: 0 if i < 90 else i % 7 for i in sets}
    nodes = spark.createDataFrame([(i, len(v), bytearray(v.tobytes())) for i, v in sets.items()], "node long, n_shingles long, items binary")
    members = spark.createDataFrame([(0, 5, i, root[i]) for i in sets], "band int, h long, node long, root long")
    got = [tuple(r) for r in neardup.remaining_pairs(members, nodes, 80).collect()]
    alike = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    want = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and alike(a, b)}
    assert want and want <= set(got) and len(got) == len(set(got))
    assert all(a < b and root[a] != root[b] for a, b in got)


def test_sketch_coordinates_agree_as_the_sets_do():
    import numpy as np

    rng = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(x[:270]), np.unique(x[30:])  # 240 of 300 shared
        agree.append((neardup.sketch(a) == neardup.sketch(b)).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02
    assert not (neardup.sketch(np.array([7], np.uint64)) == np.iinfo(np.uint64).max).any()


def test_salts_do_not_depend_on_row_order(spark):
    """A task that is run again may read its rows in another order; no key may get another salt."""
    many = spark.range(4000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    one = spark.createDataFrame([(0, "x"), (1, "y")], "k long, w string")
    joined = salted_join(many.repartition(7, "v"), one, ["k"])
    assert "rand(" not in joined._jdf.queryExecution().optimizedPlan().toString().lower()
    assert joined.count() == 4000
    assert salted_join(many.select("k"), one, ["k"]).count() == 4000


def test_salted_join_keeps_every_row(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("key"), "id")
    one = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    assert hot_keys(many, ["key"]).collect()[0]["key"] == 1
    assert salted_join(many, one, ["key"]).count() == 5000
    assert salted_join(many, one, ["key"], on=F.expr("v > 2")).count() == 2000


def brute_hits(docs, bench):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = collections.defaultdict(set)
    for item, t in bench:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def ours(docs, bench):
    out = decontam.contamination(docs, bench).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    return sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated").collect())


def test_contamination_equals_brute_force(spark, sf_small):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text").collect()]
    make = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    assert ours(frame(spark, docs), make(bench)) == brute_hits(docs, bench)
    short = [(1, "b c a"), (2, "one"), (3, None), (4, "!!"), (5, "c d e f g h i j k l"), (6, "Q r s t"), (7, "d e f g h i j k l m n o")]
    assert ours(frame(spark), make(short)) == brute_hits(TEXTS, short)
    assert ours(frame(spark), make(short).limit(0)) == brute_hits(TEXTS, [])
    assert ours(frame(spark).limit(0), make(short)) == []


def test_items_of_every_length_a_shared_window_and_no_id(spark, sf_small):
    common = "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10"
    bench = [(100 + n, " ".join(f"q{n}x{i}" for i in range(n))) for n in range(1, 12)] + [(200 + i, f"{common} u{i} {common} v{i}") for i in range(40)]
    bench += [(None, "no id but ten words that mark their documents all the same"), (300, "q5x0 q5x1 q5x2 q5x3 q5x4 q5x0 q5x1 q5x2 q5x3 q5x4")]
    docs = [(n, f"a b {bench[n][1]} c " + " ".join(f"q{n + 1}x{i}" for i in range(n))) for n in range(11)]
    docs += [(50, f"x {common} y"), (51, common), (52, common[:-1]), (53, "z " * 3000 + bench[0][1]), (54, " ".join(t for _, t in bench[:11])), (55, bench[-1][1])]
    got = ours(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert got == brute_hits(docs, bench)
    # an item without an id marks words and is not counted
    text = bench[-2][1]
    assert ours(frame(spark, [(1, text)]), spark.createDataFrame([(None, text)], "item_id long, text string"))[0][1:4] == (12, 12, 0)


def test_contamination_leaves_other_columns(spark):
    docs = spark.createDataFrame([(1, "one", "mine", 7, "w"), (None, "one", "other", 8, "w")], "doc_id long, text string, k string, _K int, w string")
    out = decontam.contamination(docs, spark.createDataFrame([(1, "one")], "item_id long, text string"))
    assert out.columns[:5] == docs.columns
    assert sorted((r["k"], r["_K"], r["w"], r["n_hit"]) for r in out.collect()) == [("mine", 7, "w", 1), ("other", 8, "w", 1)]


def test_large_benchmark_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    short = [(1, "b c a"), (5, "c d e f g h i j k l")]
    assert ours(frame(spark), spark.createDataFrame(short, "item_id long, text string")) == brute_hits(TEXTS, short)


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, cover = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_equal_brute_force(spark, sf_small):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (docs, TEXTS + [(20, "a b c d e f g h i " * 2 + "# $ " * 9 + "\x1c x")]):
        out = quality.base_counts(frame(spark, rows)).select("doc_id", "text", *COUNTS).collect()
        assert len(out) == len(rows)
        for r in out:
            assert tuple(r[c] for c in COUNTS) == brute_counts(r["text"]), r["doc_id"]


def test_quality_keeps_clean_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    model = quality.fit(docs, quality.trusted_ids(labels))
    out = quality.judge(docs, model).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert out.agg(F.avg(F.col("kept").cast("int"))).first()[0] >= 0.97
    assert quality.fit(docs, quality.trusted_ids(labels.limit(0))) is None
    edge = {r["doc_id"]: r for r in quality.judge(frame(spark), model).collect()}
    assert edge[3]["base_failed"] and edge[3]["ratio"] == 0.0 and not edge[3]["kept"]


def test_trusted_ids_have_no_bound(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    many = spark.range(quality.MAX_TRUSTED + 1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_ids(many).count() == quality.MAX_TRUSTED + 1000
    model = quality.fit(docs, quality.trusted_ids(labels))
    monkeypatch.setattr(quality, "MAX_TRUSTED", 10)    # joined without broadcast
    joined = quality.fit(docs, quality.trusted_ids(labels))
    assert joined.ratios == model.ratios and abs(joined.mean - model.mean) < 1e-9


def test_rotation_equals_sql(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é\n"), (1, 3, "ann", "é\n"), (1, None, None, "?"),
        (2, 5, "user", ""), (None, 1, "eve", "alone"), (3, 1, "system", "no one"),
    ]
    rows += [(4, t, "ab"[t % 2], f"turn {t}") for t in range(2500)]  # more than one block
    columns = "conv_id long, turn long, role string, text string, name string"
    df = spark.createDataFrame([(*r, "x") for r in rows], columns)
    got = collections.Counter(tuple(r) for r in chatformat.rotate(df).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == collections.Counter(con.sql(chatformat.ORACLE).fetchall())
    assert chatformat.rotate(df.limit(0)).count() == 0


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_url_verdicts(spark):
    weights = urlfilter.fit(urlfilter.labelled_urls(spark))
    rows = {
        "https://A.Example.NET/en/1?x=/": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "http://m.example.com/de/1#f": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "http://x.org/fr": ("x.org", "/fr", None, "allow"),
        "ftp://x.org/fr/://y/": ("x.org", "/fr/://y/", "org/fr/", "allow"),
        "http://net": ("net", "", None, None),
        "no scheme/net/": ("", "", None, None),
        None: ("", "", None, None),
        "https://www.casino-bonus-bets.example.com/": ("www.casino-bonus-bets.example.com", "/", None, "block"),
        "https://city-museum.example.com/": ("city-museum.example.com", "/", None, "allow"),
    }
    df = spark.createDataFrame([(u, "mine") for u in rows] + [("http://net", "mine")], "url string, host string")
    out = urlfilter.judge(df, weights, RULES).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        host, path, rule, verdict = rows[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and 0 <= r["score"] <= 1
    inside = urlfilter.judge(urlfilter.labelled_urls(spark), weights, []).agg(F.avg(((F.col("verdict") == "block") == (F.col("label") == 1)).cast("int")))
    assert inside.first()[0] >= 0.97


def test_near_duplicates_by_id_and_text(spark):
    """Documents that share an id, or have none, are told apart by their texts."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(1, a), (1, b), (0, a), (None, c), (None, c), (None, d), (5, e), (5, e), (None, e), (7, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = collections.Counter(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == collections.Counter([(0, a), (1, b), (None, c), (None, d), (5, e), (7, None), (8, None)])


def test_pipeline_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_small).cache()
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count(), name
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf_small).collect()
    assert len(out) == before.count() and all(r["round_trip"] for r in out)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_small).count() == 0, name


CLASHES = {"k": "K", "items": "mine", "kept": "mine", "score": 9.5, "_key": "mine", "n_words": -1, "node": "n", "ids": "i", "lang": "en", "source": "s", "_in_3": 0, "a.b`c": 1}


def test_stages_keep_the_rows_and_columns_they_are_given(spark, sf_small):
    """Clashing names, null and repeated ids, null, empty and very long texts: rows go or stay, nothing is changed."""
    given = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    window = spark.read.parquet(f"{sf_small}/benchmark.parquet").first()["text"]
    good = next(r["text"] for r in given if 500 < len(r["text"] or "") < 2000)
    rows = [tuple(r) for r in given]
    rows += [(None, None), (None, ""), (None, good + " and a tail"), (70_000, good[::-1]), (70_000, good[::-1]), (70_001, None), (70_002, " \n ")]
    rows += [(70_003, good + "\n" + window), (70_004, " ".join(f"{w}{i}" for i in range(40_000) for w in ("alpha", "beta"))), (70_005, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASHES.items()})
    docs = docs.select("k", "text", *[F.col("`" + c.replace("`", "``") + "`") for c in CLASHES if c != "k"], "doc_id")
    there = collections.Counter(tuple(r) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_small)
        assert after.columns == docs.columns and after.schema == docs.schema, name
        left = collections.Counter(tuple(r) for r in after.collect())
        assert left <= there, name
        stays = {(r[-1], r[1]) for r in left}
        empty = [(None, None), (None, ""), (70_001, None), (70_002, " \n ")]
        kept = [e in stays for e in empty]
        assert kept in ([[True, False, True, True], [False, True, True, True]] if name == "neardup" else [[name != "quality"] * 4]), name
        assert (70_003, rows[-3][1]) not in stays or name != "decontam"
        twice = sum(n for r, n in left.items() if r[-1] == 70_000)
        assert twice == (1 if name == "neardup" else 2 if name != "quality" else twice) and twice in (0, 1, 2), name
    coded = {(r["doc_id"], r["source"]): r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()}
    assert all(r["round_trip"] and r["source"] == "s" and len(r["ids"]) == r["n_tokens"] for r in coded.values())
    assert coded[70_001, "s"]["n_tokens"] == 0 and coded[70_005, "s"]["n_tokens"] > 10_000
