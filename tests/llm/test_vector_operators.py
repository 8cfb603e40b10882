"""Vector codes, hard negatives and packing against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickwise.llm import hardneg, packing, queries, vqcodes
from tickwise.llm.packing import Plan

VECTORS = "vec_id long, embedding array<float>, label int, codes string, score string, rank string, extra int"
NAN, INF = float("nan"), float("inf")


def vector_rows(n=160, width=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (4, width))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.1, width)).astype(np.float32).tolist(), int(i % 4) if i % 9 else None) for i in range(n)]
    rows += [(n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, None, 1), (n + 4, [NAN] * width, 1), (n + 5, [INF] + [0.0] * (width - 1), 2)]
    rows += [(n + 6, [None] + [0.0] * (width - 1), 2), (None, rows[3][1], 3), rows[7], rows[30], (n + 7, [0.0] * width, 1), (n + 8, [-4.0] * width, 1), (n + 9, rows[1][1][:5], 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "mine", "mine", "mine", 1) for i, v, label in rows], VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows, parts, entries, rounds, scale):
    width = -(-max((len(v) for _, v, _ in rows if usable(v)), default=0) // parts)
    kept = [(i, [math.floor(scale * float(x)) for x in v] + [0] * (parts * width - len(v)), n) for i, v, n in rows if usable(v)]
    cut = lambda x: [tuple(x[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x)[p] for _, x, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, x, _ in kept:
                members[near(cut(x)[p], books[p])[1]].append(cut(x)[p])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if members[k] else e for k, e in enumerate(books[p])]
    out = []
    for i, x, _ in kept:
        found = [near(c, books[p]) for p, c in enumerate(cut(x))]
        out.append((i, [k for _, k in found], sum(d for d, _ in found)))
    return out, books


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("parts, entries, scale, n", [(8, 16, 4096, 160), (3, 4, 100, 160), (4, 300, 4096, 40), (2, 5, 2**30, 40)])
def test_codes_equal_brute_force(spark, parts, entries, scale, n):
    """Several widths and part counts, fewer rows than entries, and components whose squares leave 64 bits."""
    rows = vector_rows(n, 4 if scale > 5000 else 16)
    df = frame(spark, rows)
    books = vqcodes.fit(df, parts=parts, entries=entries, rounds=3, scale=scale)
    want, want_books = brute_codes(rows, parts, entries, 3, scale)
    assert books.entries.tolist() == [[list(e) for e in b] for b in want_books]
    coded = vqcodes.encode(df, books)
    assert coded.columns == ["vec_id", "embedding", "label", "score", "rank", "extra", "codes", "error"]
    got = [(r.vec_id, r.codes, r.error) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(((i, c, e) for i, c, e in want), key=key)
    restored = {r.vec_id: r.restored for r in vqcodes.decode(coded, books).collect()}
    i, codes, _ = want[0]
    assert restored[i] == [x / scale for p, c in enumerate(codes) for x in want_books[p][c]]


def test_transform_is_exact_and_in_sequency_order():
    signs = vqcodes.hadamard(np.eye(8, dtype=np.int64))
    assert [int((np.diff(c) != 0).sum()) for c in signs.T] == list(range(8))
    x = np.arange(-20, 20).reshape(8, 5)
    assert ((vqcodes.hadamard(vqcodes.padded(x)) ** 2).sum(axis=1) == 8 * (x**2).sum(axis=1)).all()


def test_codes_of_empty_tables(spark):
    df = frame(spark, [(1, None, 1), (2, [NAN], 2)])
    books = vqcodes.fit(df)
    assert books.text() == "" and vqcodes.encode(df, books).count() == 0
    none = frame(spark, [(1, [], 1), (2, [], 2)])
    assert [(r.codes, r.error) for r in vqcodes.encode(none, vqcodes.fit(none)).collect()] == [([0] * 8, 0)] * 2


def test_group_totals_join_nulls_and_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, None if i % 3 else i % 2, i) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, error long")
    want = {i: sum(e for _, m, e in rows if m == n) for i, n, _ in rows}
    for most in (100_000, 0):
        monkeypatch.setattr(vqcodes, "MAX_BROADCAST", most)
        found = vqcodes.with_group_total(df, "label", "error", "total")
        assert found.columns.count("label") == 1 and {r.vec_id: r.total for r in found.collect()} == want


def brute_negatives(rows, asks, positives, negatives, low, high, scale):
    kept = [(i, n, [math.floor(scale * float(x)) for x in v]) for i, v, n in rows if i is not None and n is not None and usable(v)]
    out = []
    for a, label, x in {(i, n, tuple(v)) for i, n, v in kept if asks(i)}:
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, n) for i, n, v in kept)
        for s, p in [(-s, i) for s, i, n in scored if n == label and i != a][:positives]:
            fit = [(i, -t) for t, i, n in scored if n != label and low * s <= 100 * -t <= high * s]
            out += [(a, p, k + 1, i, s, t) for k, (i, t) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("least, batch", [(4096, 64), (16, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, least, batch):
    """One block and many blocks; ties, repeated rows, repeated anchors, shorter vectors, nulls."""
    monkeypatch.setattr(hardneg, "MOST_BLOCK", least)
    monkeypatch.setattr(hardneg, "LEAST_BLOCK", least)
    rows = vector_rows()
    rows += [(200 + i, rows[5][1], 1) for i in range(30)] + [rows[10], (10, rows[3][1], 3)]
    df = frame(spark, rows)
    got = hardneg.mine(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 5 == 0, 5, 3, 50, 95, 256)


def test_negatives_of_empty_tables_and_lone_labels(spark):
    df = frame(spark, [(50, [1.0, 2.0], 1), (100, [1.0, 2.0], 2), (7, None, 2)])
    assert hardneg.mine(df, F.col("vec_id") % 50 == 0).count() == 0
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    wide = frame(spark, [(50, [1.0], 1), (51, [1.0, 9.0], 1), (52, [0.75, -9.0], 2), (53, [], 2)])
    got = [tuple(r) for r in hardneg.mine(wide, F.col("vec_id") == 50).collect()]
    assert got == [(50, 51, 1, 52, 65536, 49152)]


def test_scores_by_lookup_are_inner_products():
    rng = np.random.default_rng(1)
    for width in (1, 8, 13, 64):
        for most in (1, 2, 200, 2**24):
            x, a = rng.integers(-most, most + 1, (300, width)), rng.integers(-most, most + 1, (5, width))
            block = hardneg.Block(np.arange(300), np.zeros(300, int), x)
            assert (block.scored(a) == a @ x.T).all()


def bins_of(plan):
    bins = defaultdict(list)
    for x in plan.lines:
        for j in range(x.count):
            bins[x.first + j // x.each].append((x.offset + j % x.each * x.length, x.length))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=200))
def test_plans_place_every_piece_once_without_gaps(capacity, lengths):
    lengths = [min(n, capacity) for n in lengths]
    plan = Plan(Counter(lengths), capacity)
    bins = bins_of(plan)
    assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths) and sorted(bins) == list(range(plan.bins))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in b) <= 2
    large = sorted(n for n in lengths if 3 * n > capacity)
    if len(large) == len(lengths) and len(large) <= 8:
        assert plan.bins == fewest_pairs(large, capacity)


def fewest_pairs(lengths, capacity):
    """The least number of bins with at most two pieces in each, by trying all."""
    if not lengths:
        return 0
    *rest, a = lengths
    return 1 + min([fewest_pairs(rest, capacity)] + [fewest_pairs(rest[:i] + rest[i + 1 :], capacity) for i in range(len(rest)) if rest[i] + a <= capacity])


def test_plan_is_no_worse_than_best_fit():
    rng = random.Random(4)
    for _ in range(20):
        lengths = [rng.choice([rng.randint(1, 2048), rng.randint(1, 300), 700, 1024]) for _ in range(400)]
        gaps, bins = [], 0
        for n in sorted(lengths, reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                bins, fit = bins + 1, 2048
            else:
                gaps.remove(fit)
            gaps.append(fit - n)
        assert Plan(Counter(lengths), 2048).bins <= bins


TEXTS = [(1, "one two"), (2, None), (3, ""), (4, "a  b\n\n it's naïve 😀 <|endoftext|> 12345"), (5, "word " * 5000), (6, "x" * 3000), (6, "other"), (6, "other"),
         (None, "no id"), (None, None), (7, "zq9" * 40000), (8, " "), (9, "one two"), (10, "漢字かな交じり文" * 700)]


def plain_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, got, capacity):
    encode = plain_encoder()
    want = Counter()
    for i, text in rows:
        ids = encode(text)
        first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize("bucket, most", [(2_000, 100_000), (2, 0)])
def test_packing_equals_plain_encoding(spark, monkeypatch, bucket, most):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(packing, "MAX_BROADCAST", most)
    df = spark.createDataFrame([(i, t, "mine", -1) for i, t in TEXTS], "doc_id long, text string, length string, keep int")
    for capacity in (2048, 7):
        cut = packing.stash(packing.pieces(df, queries.VOCABULARY, capacity), "pieces")
        assert cut.columns == ["doc_id", "keep", "piece", "start", "length", "ids_crc32"]
        used, least = check_packing(TEXTS, packing.pack(cut, capacity).collect(), capacity)
        assert used <= least + 2
    ids = packing.pieces(df.where("doc_id = 4"), queries.VOCABULARY, ids=True).first().ids
    assert ids == plain_encoder()(TEXTS[3][1])
    assert packing.pack(packing.stash(packing.pieces(df.limit(0), queries.VOCABULARY), "none")).count() == 0


def test_packing_of_the_given_documents(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packing(rows, queries.op13_packing(spark, sf_small).collect(), 2048)
    assert used <= least * 1.002 + 1
