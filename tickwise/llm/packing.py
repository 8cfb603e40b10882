"""Best-fit packing (operator 13): token sequences into bins of one capacity by large-item matching.

Pieces longer than a third of the capacity go at most two to a bin, so they
are matched: the longest with the longest that still fits beside it.  The
shorter pieces then fill the gaps from the longest down, each where it leaves
the least room; what fits nowhere opens a bin.

Only lengths matter to that, and there are at most ``capacity`` of them.  So
the plan is made on the number of pieces of each length, whatever the number
of documents: bins that are filled alike are one class with a range of
numbers, and a step moves a whole class.  The plan is a short table (length,
pieces before, first bin, pieces in a bin, offset); a piece finds its line by
its rank among the pieces of its length.  Ranks come from counts by length
and hash bucket, and a length has as many buckets as its number of pieces
needs, so one that a third of all pieces share is dealt over many tasks.

``pieces`` encodes with the ``tokenizers`` library, a pre-token that a worker
has seen before from memory.  Strings of special tokens in a text are ordinary
text there.

Defined results: a null text counts as empty and is one piece (its end mark);
a piece of full capacity is a bin of its own; ties are broken by document
number, piece and checksum, so equal rows may stand in for one another and a
null number comes first; an empty table gives no rows.  Extra columns are
kept by ``pieces`` (an added column replaces an input column of its name).
"""

from __future__ import annotations

import bisect
import os
import zlib
from codecs import charmap_decode
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.bpe import byte_table, char_classes, split_pieces
from tickwise.llm.common import appended, stash, text_slices, with_columns

CAPACITY = 2048
END = 0
#: pre-tokens kept per worker; the cache starts anew beyond this many
CACHE_PIECES = 200_000
#: pieces of a hash bucket of one length, about
BUCKET_ROWS = 2_000
#: beyond this many counts of (length, bucket) they are joined by a shuffle
MAX_BROADCAST = 100_000


class Encoder(dict):
    """A byte-level vocabulary file inside a Python worker: packed ids of the pre-tokens seen so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.model._resize_cache(0)  # what it has seen is kept here
        self.classes, self.chars = char_classes(), "".join(byte_table())
        self.packed = [i.to_bytes(4, "little") for i in range(1 + max(tokenizer.get_vocab().values()))]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        shown = charmap_decode(piece.encode(), "strict", self.chars)[0]
        ids = self[piece] = b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return b"".join(map(self.__getitem__, split_pieces(text, self.classes))) if text else b""


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones at the end, the first takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", ids: bool = False) -> DataFrame:
    """The columns of ``df`` but ``text``, a row per piece: ``piece``, ``start``, ``length``, ``ids_crc32`` and, with ``ids``, its ids."""
    added = [("piece", pa.int32(), "int"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long")]
    added += [("ids", pa.list_(pa.int32()), "array<int>")] if ids else []
    kept, schema = appended(df.drop(text), added)

    def run(batches):
        enc, end = encoder(path), END.to_bytes(4, "little")
        for batch in text_slices(batches, text):
            packed = [enc.encode(t) + end for t in batch.column(text).to_pylist()]
            rows = [(i, k, s, n, p[4 * s : 4 * (s + n)]) for i, p in enumerate(packed) for k, (s, n) in enumerate(cut(len(p) // 4, capacity))]
            out = [[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [zlib.crc32(r[4]) for r in rows]]
            out += [[np.frombuffer(r[4], "<i4") for r in rows]] if ids else []
            yield with_columns(batch.take(pa.array([r[0] for r in rows], pa.int64())), kept, [(n, pa.array(v, t)) for (n, t, _), v in zip(added, out)])

    return df.mapInArrow(run, schema)


@dataclass
class Line:
    """``count`` pieces of one length, from rank ``rank`` on, go ``each`` to a bin from bin ``first`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    offset: int


class Plan:
    """Bins for a number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.lines: list[Line] = []
        self.left = Counter({s: n for s, n in counts.items() if n})
        self.used: Counter[int] = Counter()
        self.gaps: list[int] = []  # sorted; bins with room, as ranges (first, number) by their gap
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.match_large()
        for size in sorted(self.left, reverse=True):
            self.fill(size)

    def take(self, size: int, count: int, first: int, each: int, offset: int) -> None:
        self.lines.append(Line(size, self.used[size], count, first, each, offset))
        self.used[size] += count
        self.left[size] -= count

    def leave(self, gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in self.open:
                bisect.insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((first, number))

    def match_large(self) -> None:
        """Two pieces above a third of the capacity to a bin: the longest with the longest that fits."""
        large = sorted(s for s in self.left if 3 * s > self.capacity)
        while large:
            a = large[-1]
            at = bisect.bisect_right(large, self.capacity - a) - 1
            b = large[at] if at >= 0 else 0
            n = self.left[a] // 2 if a == b else min(self.left[a], self.left[b]) if b else self.left[a]
            if not n:  # one left of a length that would pair with itself: try the next shorter one
                b = large[at - 1] if at else 0
                n = 1
            self.take(a, n, self.bins, 1, 0)
            if b:
                self.take(b, n, self.bins, 1, a)
            self.leave(self.capacity - a - b, self.bins, n)
            self.bins += n
            large = [s for s in large if self.left[s]]

    def fill(self, size: int) -> None:
        """All pieces of a length into the least gaps that hold them, then into new bins."""
        while n := self.left[size]:
            at = bisect.bisect_left(self.gaps, size)
            if at < len(self.gaps):
                gap = self.gaps[at]
                first, number = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap], self.gaps[at]
            else:
                gap, first, number = self.capacity, self.bins, -(-n // (self.capacity // size))
                self.bins += number
            each = gap // size
            whole = min(number, n // each)  # best fit goes on in the bin that it has made the tightest
            if whole:
                self.take(size, whole * each, first, each, self.capacity - gap)
                self.leave(gap - each * size, first, whole)
            rest = min(n - whole * each, each - 1) if whole < number else 0
            if rest:
                self.take(size, rest, first + whole, rest, self.capacity - gap)
                self.leave(gap - rest * size, first + whole, 1)
            self.leave(gap, first + whole + bool(rest), number - whole - bool(rest))


def ranked(df: DataFrame, counts: dict[int, int], length: str, order: list[str]) -> DataFrame:
    """``df`` with the place (from 0) of each row among the ``counts`` rows of its length."""
    rows = [(s, -(-n // BUCKET_ROWS)) for s, n in counts.items()]
    buckets = df.sparkSession.createDataFrame(rows, "_length long, _buckets long")
    keyed = df.join(F.broadcast(buckets), F.col(length) == F.col("_length")).drop("_length")
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets"))).drop("_buckets")
    found = keyed.groupBy(length, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash(found.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "starts")
    starts = F.broadcast(starts) if starts.count() <= MAX_BROADCAST else starts
    own = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*order)) - 1
    return keyed.withColumn("_own", own).join(starts, [length, "_bucket"]).withColumn("_rank", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_bucket")


def pack(df: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """The written pieces ``df`` with ``sequence_id`` and ``offset`` (the length's number of rows makes the plan).

    ``order`` must tell rows apart as far as they differ; lengths are from 1 to ``capacity``.
    """
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(length).count().collect()}  # ``capacity`` rows at most
    plan = Plan(counts, capacity)
    by_length: dict[int, list[Line]] = {}
    for line in plan.lines:
        by_length.setdefault(line.length, []).append(line)
    rows = [(s, [(x.rank, x.first, x.each, x.offset) for x in found]) for s, found in by_length.items()]
    lines = spark.createDataFrame(rows, "_length long, _lines array<struct<rank: long, first: long, each: long, offset: long>>")
    placed = ranked(df, counts, length, list(order)).join(F.broadcast(lines), F.col(length) == F.col("_length"))
    # the last line that starts at or before the rank
    line = F.element_at(F.filter("_lines", lambda x: x["rank"] <= F.col("_rank")), -1)
    placed = placed.withColumn("_line", line).withColumn("_at", F.col("_rank") - F.col("_line.rank"))
    return placed.withColumn("sequence_id", F.col("_line.first") + F.floor(F.col("_at") / F.col("_line.each"))).withColumn(
        "offset", F.col("_line.offset") + F.col("_at") % F.col("_line.each") * F.col(length)).drop("_length", "_lines", "_line", "_at", "_rank")
