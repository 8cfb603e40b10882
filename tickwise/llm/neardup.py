"""Near-duplicate groups by fast similarity sketching (operator 6).

Every text becomes the set of its distinct word shingles (64-bit hashes).  The
sketch has ``BINS`` coordinates, filled in rounds: in round i every shingle is
thrown into one bin, and a bin keeps the least of (round, hash); after the
first ``BINS`` rounds round i aims at bin i alone, so no coordinate stays
empty.  Two sets agree in a coordinate with a probability of their Jaccard
similarity, concentrated as for independent hashes.  ``BANDS`` bands of
``ROWS`` coordinates give candidates: at similarity 0.8 all bands differ with
a probability of 5e-8.

Equal sets are one class, found by grouping; only class representatives (the
least id) are compared.  Within a bucket no pairs are listed at first: every
member is compared with the bucket's pivot, in rounds with other pivots.  Rows
that are linked by then share a component.  Where a bucket still holds several
components, exact prefix filtering on shingle frequencies finds the pairs
between them that can be similar at all; parity bits of both sets bound their
difference inside that join.  Links are confirmed on the full sets in integers, ``100 * both >= percent * either``.
Pairs whose sketches agree in fewer than ``AGREE`` coordinates are not
confirmed (at 0.8 the probability of so few is about 1e-7).
Components are contracted along random priorities, in about log(n) rounds; a
round works on the components that still have links, new links only between
those of the turn before, and all nodes meet the result once a turn.

Hot keys (buckets, pivots, sets with a great share of the rows) are salted;
they are not looked for where no key can have more than some thousand rows.

Defined results: a text with fewer words than a shingle has its whole sequence
as one shingle; without words or text the set is empty and linked with
nothing.  Every row is returned; rows with one id and equal texts are equal.
A null id is never a component's id unless all its rows have null ids.  Empty
tables give empty results, other columns are not looked at.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import SALTS, hot_keys, is_hot, salted_join, stash, text_slices

BINS, BANDS, ROWS = 128, 32, 4
#: least agreeing coordinates of a candidate pair
AGREE = 78
STAR_ROUNDS = 2
#: edges (of two ids) whose joins are not salted
FEW_EDGES = 10_000
#: candidate pairs whose sketches and sets are compared in one pass
FEW_PAIRS = 10_000
#: nodes whose joins by bucket, root or shingle, with one partner a row, are not salted
FEW_NODES = 2_000
#: 64-bit words of a set's parity bits
PARITY = 8
#: rows of 16 bytes that may be broadcast; beyond, they are shuffled
MAX_BROADCAST = 2_000_000
_U = np.uint64
_MULS = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _MULS[1]
    x = (x ^ (x >> _U(27))) * _MULS[2]
    return x ^ (x >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one whole text; A-Z is lower-cased, words end at ASCII white space."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, _U(n))
    for i in range(n):
        out = mix(out * _MULS[0] + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """BINS coordinates of a set that is not empty."""
    out = np.full(BINS, np.iinfo(np.uint64).max)
    for i in range(2 * BINS):
        h = mix(items + _U((i + 1) * int(_MULS[0]) % 2**64))
        value = (h >> _U(8)) | (_U(i % 256) << _U(56))
        if i < BINS:
            at = (h & _U(BINS - 1)).astype(np.int64)
            value = np.where(value == np.iinfo(np.uint64).max, value - _U(1), value)
            np.minimum.at(out, at, value)
        elif out[i - BINS] == np.iinfo(np.uint64).max:
            out[i - BINS] = value.min()
        if not (out == np.iinfo(np.uint64).max).any():
            break
    return out


def signatures(df: DataFrame, key: str, text: str, size: int, full: bool = False) -> DataFrame:
    """id, n_shingles, node (a digest of the set; null if empty) and the set's band hashes.

    With ``full`` the sketch bytes and the packed set instead of the bands.
    """

    def bands(s: np.ndarray) -> np.ndarray:
        part = sketch(s).reshape(BANDS, ROWS)
        band = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            band = mix(band * _MULS[0] + part[:, r])
        return band.astype(np.int64)

    def run(batches):
        words = WordHashes()
        for batch in text_slices(batches, "text"):
            if len(words) > 200_000:
                words.clear()
            sets = [shingle_set(t, words, size) for t in batch.column("text").to_pylist()]
            node = [np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) if len(s) else None for s in sets]
            out = {"id": batch.column("id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(node, pa.int64())}
            if full:
                out["agree"] = pa.array([mix(sketch(s)).astype(np.uint8).tobytes() if len(s) else b"" for s in sets], pa.binary())
                out["items"] = pa.array([s.tobytes() for s in sets], pa.binary())
            else:
                out["bands"] = pa.array([bands(s) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "id long, n_shingles long, node long, " + ("agree binary, items binary" if full else "bands array<long>")
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pair_filter(pairs: DataFrame, tests: dict) -> DataFrame:
    """Pairs (a, b, salt) of the rows for which every test of two packed columns holds, ``x_agree`` and ``y_agree`` for the key ``agree``."""

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for name, test in tests.items():
                x, y = batch.column(f"x_{name}"), batch.column(f"y_{name}")
                for i in np.flatnonzero(keep):
                    keep[i] = test(x[i].as_buffer(), y[i].as_buffer())
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(mask) for c in ("a", "b", "salt")})

    columns = [f"{s}_{name}" for name in tests for s in "xy"]
    return pairs.select("a", "b", "salt", *columns).mapInArrow(run, "a long, b long, salt int")


def sketches_agree(x, y) -> bool:
    return int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= AGREE


def similar(percent: int):
    def test(x, y) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    return test


def verify(pairs: DataFrame, nodes: DataFrame, percent: int, sketched: bool = True) -> DataFrame | None:
    """Links among candidate pairs (a, b), None without candidates; ``a`` may be hot and is salted once.

    Sizes, then (if ``sketched``) sketches, then the full sets decide; of few pairs in one pass.
    """
    pairs = stash(pairs, "pairs")
    n = pairs.count()
    if n == 0:
        return None
    salted = n > FEW_PAIRS and is_hot(pairs, ["a"])
    hot = stash(hot_keys(pairs, ["a"]), "hot") if salted else None
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0) if salted else F.lit(0)
    pairs = (pairs.join(F.broadcast(hot), "a", "left") if salted else pairs).select("a", "b", salt.alias("salt"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))

    def beside(pairs: DataFrame, columns: list[str]) -> DataFrame:
        one = lambda s, v: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{v}_{c}") for c in columns], F.col("n_shingles").alias(f"n_{s}"))
        left, at = one("a", "x"), ["a"]
        if salted:
            left, at = left.join(F.broadcast(hot), "a", "left").withColumn("salt", F.explode(salts)).drop("_hot"), ["a", "salt"]
        out = pairs.join(left, at).join(one("b", "y"), "b")
        return out.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    tests = {"agree": sketches_agree, "items": similar(percent)} if sketched else {"items": similar(percent)}
    if sketched and n > FEW_PAIRS:  # sets are many times as long as sketches, so only those of near pairs are moved
        pairs = stash(pair_filter(beside(pairs, ["agree"]), {"agree": tests.pop("agree")}), "near")
    return stash(pair_filter(beside(pairs, list(tests)), tests).select("a", "b"), "links")


def joined(many: DataFrame, one: DataFrame, key: str, few: bool, like: DataFrame | None = None) -> DataFrame:
    """``many`` join ``one``, salted if a key is hot; not looked for among ``few`` rows, as it would be a job for every join.

    ``like`` has the keys of ``many`` where those are quicker to count.
    """
    like = many if like is None else like
    if few or not is_hot(like, [key]):
        return many.join(one, key)
    return salted_join(many, one, [key], hot=hot_keys(like, [key]))


def contracted(edges: DataFrame) -> DataFrame | None:
    """(end, last): where the ends of ``edges`` (a, b) go, one row for each, if edges are contracted until none is left; None without edges.

    A node goes to the neighbour (or stays, if it leads) with most links, ties
    by a hash that changes with the round: a star is gone after one round, a
    chain loses about half of its nodes.  A round sees only nodes that still
    have edges; the rounds' moves are put together from the last to the first,
    so all of them join a small multiple of the first round's nodes.
    """
    moves = []
    while n := edges.count():
        met = partial(joined, few=n <= FEW_EDGES)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        itself = degree.select("a", F.col("a").alias("b"))
        rank = F.struct((-F.col("n")).alias("n"), F.xxhash64(F.lit(len(moves)), F.col("b")).alias("h"), F.col("b").alias("v"))
        ranked = met(both.unionByName(itself), degree.withColumnRenamed("a", "b"), "b", like=both.select("b"))
        to = stash(ranked.groupBy("a").agg(F.min(rank)["v"].alias("to")), "to")
        moved = met(edges, to, "a").select("b", F.col("to").alias("a"))
        moved = met(moved, to.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b", like=edges.select("b")).select("a", F.col("to_b").alias("b"))
        edges = stash(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates(), "edges")
        moves.append((to, n <= FEW_EDGES))
    found = None
    for to, few in reversed(moves):
        if found is None:
            found = to.select(F.col("a").alias("end"), F.col("to").alias("last"))
        else:
            further = found.select(F.col("end").alias("to"), "last")
            found = (to.join(further, "to", "left") if few else salted_join(to, further, ["to"], "left")).select(F.col("a").alias("end"), F.coalesce("last", "to").alias("last"))
    return found if len(moves) < 2 else stash(found, "ends")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every node, by edges (a, b)."""
    return moved_on(nodes.select("node", F.col("node").alias("root")), contracted(edges))


def moved_on(state: DataFrame, ends: DataFrame | None, few: bool = False) -> DataFrame:
    """(node, root) with the roots that ``ends`` moves."""
    if ends is None:
        return state
    ends = ends.select(F.col("end").alias("root"), "last")
    out = state.join(ends, "root", "left") if few else salted_join(state, ends, ["root"], "left")
    return stash(out.select("node", F.coalesce("last", "root").alias("root")), "state")


def met(many: DataFrame, one: DataFrame, keys: list[str], few: bool) -> DataFrame:
    return many.join(one, keys) if few else salted_join(many, one, keys)


def star_pairs(members: DataFrame, turn: int, few: bool = False) -> DataFrame:
    """Each bucket's members against its pivot, the least hash of (turn, node), where their components differ."""
    rank = F.struct(F.xxhash64(F.lit(turn), F.col("node")).alias("h"), F.col("node").alias("v"), F.col("root").alias("root"))
    pivots = members.groupBy("band", "h").agg(F.min(rank).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    pivots = pivots.where("lo <> hi").select("band", "h", F.col("p.v").alias("a"), F.col("p.root").alias("root_a"))
    pairs = met(members, pivots, ["band", "h"], few).where("root <> root_a")
    return pairs.select("a", F.col("node").alias("b")).dropDuplicates()


def tokens_of(nodes: DataFrame) -> DataFrame:
    """(node, root, n, token): the packed sets as rows."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("items")]
            for at in range(0, len(sets), 256):  # bounded output batches
                some = sets[at : at + 256]
                row = np.repeat(np.arange(at, at + len(some)), [len(x) for x in some])
                columns = [batch.column(c).take(pa.array(row)) for c in ("node", "root", "n_shingles")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(some))], names=["node", "root", "n", "token"])

    return nodes.select("node", "root", "n_shingles", "items").mapInArrow(run, "node long, root long, n long, token long")


def parity_of(nodes: DataFrame) -> DataFrame:
    """(node, p0 ...): bit i is the parity of the shingles that hash to i.

    A shingle that both sets hold changes neither parity, so two sets differ
    in at least as many shingles as their bits differ: a bound without error.
    """

    def run(batches):
        for batch in batches:
            bits = np.zeros((batch.num_rows, 64 * PARITY), np.uint8)
            for row, v in zip(bits, batch.column("items")):
                at = mix(np.frombuffer(v.as_buffer(), np.uint64)) % _U(64 * PARITY)
                row[:] = np.bincount(at.astype(np.int64), minlength=64 * PARITY) & 1
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *map(pa.array, words.T)], names=["node", *(f"p{i}" for i in range(PARITY))])

    return nodes.select("node", "items").mapInArrow(run, "node long, " + ", ".join(f"p{i} long" for i in range(PARITY)))


def remaining_pairs(members: DataFrame, nodes: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """Candidates among the nodes whose buckets still hold several components, none of them missed.

    Similar sets share a shingle among the first ``n - ceil(percent * n) + 1``
    of each in the order of rising frequency, and at its places enough
    shingles are left on both sides for the overlap that the sizes ask for.
    Of a pair in different components at least one is outside the component
    that leads a shingle, so only those rows are joined to all of its rows.
    ``100 * both >= percent * either`` bounds the shingles of one set alone by
    ``(100 - percent) / (100 + percent)`` of both sizes: more differing parity
    bits rule a pair out.
    """
    several = members.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "h")
    open_ = stash(met(members, several, ["band", "h"], few).select("node", "root").dropDuplicates(), "open")
    tokens = stash(tokens_of(nodes.join(open_, "node")), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "token")) - 1
    first = met(tokens, often, ["token"], few).withColumn("i", place)
    first = stash(first.where(f"df > 1 AND 100 * (i + 1) <= {100 - percent} * n + 100").select("node", "root", "n", "token", "i"), "first")
    share = first.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    lead = share.groupBy("token").agg(F.max(F.struct("c", "root"))["root"].alias("lead"), F.count(F.lit(1)).alias("roots"))
    first = met(first, lead.where("roots > 1").select("token", "lead"), ["token"], few)
    first = stash(first.join(parity_of(nodes.join(open_, "node", "left_semi")), "node"), "first")
    side = lambda s: [F.col(c).alias(f"{v}{s}") for c, v in [("root", "r"), ("n", "n"), ("i", "i"), *((f"p{i}", f"p{i}") for i in range(PARITY))]]
    x = first.select("token", "lead", F.col("node").alias("a"), *side("a"))
    y = first.where("root <> lead").select("token", F.col("node").alias("b"), *side("b"))
    fits = f"ra <> rb AND (ra = lead OR a < b) AND 100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb)"
    differ = " + ".join(f"bit_count(p{i}a ^ p{i}b)" for i in range(PARITY))
    fits += f" AND {100 + percent} * ({differ}) <= {100 - percent} * (na + nb)"
    pairs = salted_join(x, y, ["token"], on=F.expr(fits))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates()


def linked(members: DataFrame, nodes: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """(node, root) of ``nodes`` (one row per distinct set that shares a bucket); members are their buckets.

    ``few`` nodes make no bucket, root or shingle that must be salted.
    """
    state, links = nodes.select("node", F.col("node").alias("root")), False
    for turn in range(STAR_ROUNDS + 1):
        at = members.join(state, "node") if links else members.withColumn("root", F.col("node"))
        pairs = star_pairs(at, turn, few) if turn < STAR_ROUNDS else remaining_pairs(at, nodes, percent, few)
        found = verify(pairs, nodes, percent, sketched=turn < STAR_ROUNDS)  # the last pairs have passed an exact filter
        if found is None:
            continue
        if links:  # between the components so far
            for end in "ab":
                found = found.join(state.select(F.col("node").alias(end), "root"), end).drop(end).withColumnRenamed("root", end)
            found = stash(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates(), "edges")
        ends = contracted(found)
        state, links = moved_on(state, ends, few), links or ends is not None
    return state


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``df``; component_id is the least id that can be reached.

    Texts are read twice: for the sketches of all rows, and for the full sets
    of the rows that represent a set with a candidate.
    """
    sets = stash(signatures(df, key, text, size), "sets")
    slim = sets.select("id", "n_shingles", "node")
    classes = stash(slim.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least")), "classes")
    bands = sets.where("node IS NOT NULL").select("node", "bands").dropDuplicates(["node"])
    buckets = stash(bands.select("node", F.posexplode("bands").alias("band", "h")), "buckets")
    shared = buckets.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "h")
    members = stash(salted_join(buckets, shared, ["band", "h"]), "members")
    inside = stash(members.select("node").dropDuplicates().join(classes, "node"), "inside")
    n = inside.count()
    side = lambda d: F.broadcast(d) if n <= MAX_BROADCAST else d
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    ids = inside.select(F.col("least").alias("id"), F.lit(True).alias("y")).dropDuplicates()
    chosen = rows.join(side(ids), rows["id"].eqNullSafe(ids["id"]), "left_semi")
    full = signatures(chosen, "id", "text", size, full=True).join(side(inside.select("node")), "node", "left_semi")
    nodes = stash(full.select("node", "n_shingles", "agree", "items").dropDuplicates(["node"]), "nodes")
    state = linked(members, nodes, percent, n <= FEW_NODES)
    rooted = classes.join(state, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = stash(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stash(met(rooted, lowest, ["root"], n <= FEW_NODES).select("node", "component_id"), "final")
    some = salted_join(stash(slim.where("node IS NOT NULL"), "slim"), final, ["node"])
    none = slim.where("node IS NULL").withColumn("component_id", F.col("id"))
    cols = ["id", "n_shingles", "component_id"]
    return some.select(*cols).unionByName(none.select(*cols))
