"""Hard-negative mining (operator 12): exact integer scores by the method of the Four Russians.

For every anchor the 2**8 subset sums of each group of eight of its components
are laid into a table.  A candidate's components, as integers, are cut into
bit planes; the eight bits of a plane that belong to one group form a byte,
and that byte looks up the sum of the anchor's components whose bit is set.
From the highest plane down the score is doubled and the looked-up sums are
added (the sign plane is subtracted), which gives the whole inner product,
exactly and without a multiplication.

The anchors are a query set against all rows, so the work is a grid: rows are
dealt to blocks by a hash, every block receives all anchors (an anchor is
small and there are few blocks), its rows are held in memory as packed planes
and the anchors pass by in Arrow batches.  A block returns, per anchor, its
own best rows; Spark ranks those few.  Two passes are needed since the limits
of the negatives follow from the positives' scores.  Nothing is collected,
and memory is one block and one batch.

Defined results: a row without id or label, with a null vector or with a null
or non-finite component takes no part; ids name rows, so rows with the
anchor's id are never its positives, and a negative has another label anyway;
a repeated anchor is one anchor, other repeated rows count as often as they
stand; of vectors of different lengths the shorter ends in zeros; a positive
without negatives, and an anchor without positives, give no row; an empty
table gives none.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import stash
from tickwise.llm.vectors import floored, is_finite

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: rows of a block: as many as give every core some blocks, within these bounds
LEAST_BLOCK, MOST_BLOCK = 4096, 65536
#: anchors whose tables are laid at once, and rows that are looked up at once
ANCHORS, ROWS = 64, 4096


def to_planes(x: np.ndarray) -> np.ndarray:
    """planes[k, group, row]: the bytes of bit k of eight components each, in two's complement; the last plane holds the signs."""
    rows, width = x.shape
    groups = -(-width // 8)
    bits = max(int(x.max(initial=0)).bit_length(), int(-(x.min(initial=0) + 1)).bit_length() if x.min(initial=0) < 0 else 0) + 1
    out = np.zeros((bits, groups, rows), np.uint8)
    for k in range(bits):
        out[k] = np.packbits(((x >> k) & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """tables[group, byte, anchor]: for each byte the sum of the components whose bit is set, by doubling the table eight times."""
    n, width = anchors.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.int64)
    padded[:, :width] = anchors
    groups = padded.reshape(n, -1, 8).transpose(1, 2, 0)
    tables = np.zeros((groups.shape[0], 1, n), np.int64)
    for bit in range(8):
        tables = np.concatenate([tables, tables + groups[:, bit : bit + 1]], axis=1)
    return tables


def scores(tables: np.ndarray, planes: np.ndarray, most: int) -> np.ndarray:
    """scores[anchor, row] by shifts, adds and lookups; ``most`` bounds their magnitude."""
    if most >= 1 << 62:
        raise ValueError("vector components are too large for 64-bit scores")
    tables = np.ascontiguousarray(tables.astype(np.int32)) if most < 1 << 30 else tables
    bits, groups, rows = planes.shape
    out = np.empty((tables.shape[2], rows), tables.dtype)
    for start in range(0, rows, ROWS):
        block = planes[:, :, start : start + ROWS]
        total = np.zeros((block.shape[2], tables.shape[2]), tables.dtype)
        found = np.empty_like(total)
        for k in range(bits - 1, -1, -1):
            total += total
            for g in range(groups):
                np.take(tables[g], block[k, g], axis=0, out=found, mode="clip")
                if k == bits - 1:
                    total -= found
                else:
                    total += found
        out[:, start : start + ROWS] = total.T
    return out


class Block:
    """The rows of one block, by label and id, as packed planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.planes = to_planes(x[order])
        self.width, self.most = x.shape[1], int(np.abs(x).max(initial=0))

    def scored(self, anchors: np.ndarray) -> np.ndarray:
        width = max(self.width, anchors.shape[1])
        planes = self.planes
        if planes.shape[1] < -(-width // 8):
            planes = np.concatenate([planes, np.zeros((planes.shape[0], -(-width // 8) - planes.shape[1], planes.shape[2]), np.uint8)], axis=1)
        wide = np.zeros((len(anchors), planes.shape[1] * 8), np.int64)
        wide[:, : anchors.shape[1]] = anchors
        bits = planes.shape[0]
        most = int(np.abs(wide).astype(object).sum(axis=1).max(initial=0)) << bits if self.most else 0
        return scores(subset_sums(wide), planes, most)

    def same(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by smaller id; rows that tie with the last are compared by id, not cut."""
    if len(score) > n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        places = np.flatnonzero(score >= least)
    else:
        places = np.arange(len(score))
    return places[np.lexsort((ids[places], -score[places].astype(np.int64)))[:n]]


def positives_of(block: Block, anchor: dict, score: np.ndarray, n: int) -> list[tuple]:
    at = block.same(anchor["label"])
    ids, s = block.ids[at], score[at]
    other = ids != anchor["id"]
    ids, s = ids[other], s[other]
    return [(0, 0, 0, int(ids[i]), int(s[i])) for i in best(s, ids, n)]


def negatives_of(block: Block, anchor: dict, score: np.ndarray, n: int, low: int, high: int) -> list[tuple]:
    """The best ``n`` rows of another label within each positive's limits."""
    pos = anchor["positives"]
    floor = min(-(-low * p["score"] // 100) for p in pos)
    top = max(high * p["score"] // 100 for p in pos)
    fits = (score >= floor) & (score <= top)
    fits[block.same(anchor["label"])] = False
    places = np.flatnonzero(fits)
    order = places[np.lexsort((block.ids[places], -score[places].astype(np.int64)))]
    down = -score[order].astype(np.int64)
    out = []
    for place, p in enumerate(pos):
        a = np.searchsorted(down, -(high * p["score"] // 100), side="left")
        b = np.searchsorted(down, low * p["score"] // -100, side="right")
        out += [(place, p["id"], p["score"], int(block.ids[i]), int(score[i])) for i in order[a : max(min(a + n, b), a)]]
    return out


def graded(rows: DataFrame, anchors: DataFrame, blocks: int, pick, scale: int) -> DataFrame:
    """``pick(block, anchor, scores)`` for every anchor in every block of rows: (anchor, anchor_id, place, of, of_score, id, score)."""
    block_of = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")
    held = rows.select(block_of.alias("block"), F.lit(0).alias("side"), "id", "label", "vector", *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in ("anchor", "positives")])
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "id", "label", "vector", "anchor", "positives")
    dealt = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "side")
    names = ["anchor", "anchor_id", "place", "of", "of_score", "id", "score"]

    def run(batches):
        now, parts, block = None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for start, end in runs(numbers):
                if now != numbers[start]:
                    now, parts, block = numbers[start], [], None
                some = batch.slice(start, end - start)
                sides = some.column(1).to_numpy()
                cut = int(np.searchsorted(sides, 1))
                if cut:
                    parts.append(columns(some.slice(0, cut), scale))
                asked = some.slice(cut)
                if asked.num_rows and parts:
                    block, parts = Block(*merged(parts)), []
                if not asked.num_rows or block is None:
                    continue
                for at in range(0, asked.num_rows, ANCHORS):
                    few = asked.slice(at, ANCHORS)
                    ids, labels, x = columns(few, scale)
                    found = block.scored(x)
                    listed = few.column(6).to_pylist()
                    out = []
                    for i, key in enumerate(few.column(5).to_pylist()):
                        anchor = {"id": int(ids[i]), "label": int(labels[i]), "positives": listed[i]}
                        out += [(key, anchor["id"], *t) for t in pick(block, anchor, found[i])]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True]) if len(numbers) else np.array([0])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def columns(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(4)
    width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
    return batch.column(2).to_numpy(), batch.column(3).to_numpy(), floored(lists, scale, width)


def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(x.shape[1] for _, _, x in parts)
    wide = [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, _, x in parts]
    return np.concatenate([i for i, _, _ in parts]), np.concatenate([n for _, n, _ in parts]), np.concatenate(wide)


def ranked(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key by score and smaller id, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: str = "label", vector: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among the rows of ``df``.

    An anchor's positives are the ``positives`` best other rows of its label;
    for each, the ``negatives`` best rows of another label that score from
    ``low`` to ``high`` hundredths of the positive.  ``is_anchor`` is a
    condition on the columns of ``df``; labels are whole numbers.
    """
    usable = F.col(id_col).isNotNull() & F.col(label).isNotNull() & is_finite(vector)
    every = df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("asks"))
    rows = every.drop("asks")
    anchors = every.where("asks").drop("asks").distinct().withColumn("anchor", F.xxhash64("id", "label", "vector"))
    anchors = stash(anchors.withColumn("positives", F.lit(None).cast("array<struct<id: long, score: long>>")), "anchors")
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df.count()
    blocks = max(1, -(-n // min(max(n // (2 * cores), LEAST_BLOCK), MOST_BLOCK)))
    near = graded(rows, anchors, blocks, lambda b, a, s: positives_of(b, a, s, positives), scale)
    near = ranked(near, ["anchor", "anchor_id"], positives)
    lists = near.groupBy("anchor", F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))  # ``positives`` entries at most
    lists = lists.select("anchor", "id", F.transform("found", lambda r: F.struct(r["id"], r["score"])).alias("positives"))
    armed = stash(anchors.drop("positives").join(lists, ["anchor", "id"]), "armed")
    far = graded(rows, armed, blocks, lambda b, a, s: negatives_of(b, a, s, negatives, low, high), scale)
    far = ranked(far, ["anchor", "anchor_id", "place", "of", "of_score"], negatives)
    return far.select("anchor_id", F.col("of").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                      F.col("of_score").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
