"""Vector code compression (operator 11): product codes found with an integer Walsh-Hadamard transform.

A component x becomes floor(scale * x); a vector is cut into equal parts, and
each part position has a codebook.  Nearest entries are searched in the
transformed space: parts and entries are padded with zeros to a power of two
n and transformed with the Hadamard matrix of plus and minus ones, ordered by
sequency (the number of sign changes of a row).  The squared differences of
the coefficients sum to n times the squared distance, so they are accumulated
coefficient by coefficient, and an entry goes as soon as its sum exceeds that
of a complete one.  All of it is integer arithmetic: nothing is rounded, and
ties go to the lower index.

A round is one pass over the rows: every task returns the sums and counts of
its own parts (``parts * entries * (width + 1)`` numbers at most), Spark adds
them up, and only these totals reach the driver, which is as much as the
codebook itself, whatever the number of rows.

Defined results: a row whose vector is null or holds a null or non-finite
component is dropped; a null id stays and comes last in the order of ids; of
equal ids the smaller vector comes first; repeated rows are coded and counted
as often as they stand; vectors shorter than the longest end in zeros, as
does a width that the parts do not divide; with fewer rows than entries the
codebook has as many entries as rows; an empty table gives no rows.  Extra
columns are kept, and an added column replaces an input column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import appended, salted_join, with_columns
from tickwise.llm.vectors import exact, floored, is_finite

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: magnitudes below this many bits keep every sum of eight squared differences in 64 bits
SAFE_BITS = 24


@dataclass
class Codebooks:
    """entries[part, entry, place]: integers; ``scale`` as the vectors were scaled."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def text(self) -> str:
        """All components in decimal, by part, entry and place, joined by commas."""
        return ",".join(map(str, self.entries.reshape(-1).tolist()))


def hadamard(values: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis (a power of two), in sequency order."""
    n = values.shape[-1]
    out, step = values, 1
    while step < n:
        pairs = out.reshape(*values.shape[:-1], n // (2 * step), 2, step)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([a + b, a - b], axis=-2).reshape(values.shape)
        step *= 2
    return out[..., by_sequency(n)]


def by_sequency(n: int) -> np.ndarray:
    """Rows of the Hadamard matrix of size n in the order of their sign changes."""
    signs = np.array([[bin(i & j).count("1") & 1 for j in range(n)] for i in range(n)])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def padded(values: np.ndarray) -> np.ndarray:
    """Zeros behind the last axis up to a power of two."""
    width = values.shape[-1]
    n = 1 << max(width - 1, 0).bit_length()
    return np.concatenate([values, np.zeros((*values.shape[:-1], n - width), values.dtype)], axis=-1)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row and its squared distance."""
    bits = SAFE_BITS - max(part.shape[1] // 8, 1).bit_length()
    if exact(part, bits).dtype == object or exact(entries, bits).dtype == object:
        part, entries = part.astype(object), entries.astype(object)
    x, e = hadamard(padded(part)), hadamard(padded(entries))
    rows, n = x.shape
    first = x[:, :1] - e[None, :, 0]
    total = first * first
    guess = np.argmin(total, axis=1)  # one complete sum per row bounds all others
    rest = x[:, 1:] - e[guess, 1:]
    bound = total[np.arange(rows), guess] + (rest * rest).sum(axis=1)
    row, entry = np.nonzero(total <= bound[:, None])
    total = total[row, entry]
    for k in range(1, n):
        d = x[row, k] - e[entry, k]
        total = total + d * d
        stays = total <= bound[row]
        if not stays.all():
            row, entry, total = row[stays], entry[stays], total[stays]
    order = np.lexsort((entry, total, row)) if total.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], total[i], entry[i])), np.int64)
    row, entry, total = row[order], entry[order], total[order]
    best = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else order
    return entry[best], total[best] // n


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes[row, part] and the squared distance of each part."""
    found = [nearest(part, entries) for part, entries in zip(vectors.reshape(len(vectors), *books.shape[::2]).swapaxes(0, 1), books)]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def first_entries(kept: DataFrame, id_col: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the ``entries`` rows of smallest id."""
    rows = kept.orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).limit(entries).select(vector).collect()
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts)
    column = pa.array([r[0] for r in rows], pa.list_(pa.float64()))
    return floored(column, scale, parts * width).reshape(len(rows), parts, width).swapaxes(0, 1).copy()


def totals(kept: DataFrame, vector: str, books: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts of each entry by place, and their number; one pass, added up per task first."""
    parts, entries, width = books.shape
    names = ["part", "entry", "place", "total"]

    def run(batches):
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = floored(batch.column(0), scale, parts * width)
            codes, _ = assign(x, books)
            x = x.reshape(len(x), parts, width)
            for p in range(parts):
                # reduceat over the rows sorted by entry
                order = np.argsort(codes[:, p], kind="stable")
                used, start, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(exact(x[order, p], 40), start, axis=0)
                    counts[p, used] += n
        rows = [(p, e, w, int(v)) for p, e in np.argwhere(counts).tolist() for w, v in enumerate([*sums[p, e], counts[p, e]])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, names=names)

    found = kept.select(vector).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
    for p, e, w, v in found.groupBy(*names[:3]).agg(F.sum("total")).collect():  # as many rows as the codebook has numbers
        if w < width:
            sums[p, e, w] = v
        else:
            counts[p, e] = v
    return sums, counts


def fit(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all kept rows, from those of smallest id."""
    kept = df.where(is_finite(vector)).select(id_col, vector)
    books = first_entries(kept, id_col, vector, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        sums, counts = totals(kept, vector, books, scale)
        used = counts > 0
        books[used] = (sums[used] // counts[used, None].astype(object)).astype(np.int64)
    return Codebooks(books, scale)


def encode(df: DataFrame, codebooks: Codebooks, vector: str = "embedding") -> DataFrame:
    """The kept rows with all their columns, ``codes`` (one index per part) and ``error`` (the squared distance)."""
    kept, schema = appended(df, [("codes", pa.list_(pa.int32()), "array<int>"), ("error", pa.int64(), "long")])
    books, scale, width = codebooks.entries, codebooks.scale, codebooks.width

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes, far = assign(floored(batch.column(vector), scale, width), books)
            ends = pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32())
            column = pa.ListArray.from_arrays(ends, pa.array(codes.reshape(-1), pa.int32()))
            yield with_columns(batch, kept, [("codes", column), ("error", pa.array(far.sum(axis=1).tolist(), pa.int64()))])

    return df.where(is_finite(vector)).mapInArrow(run, schema)


def decode(df: DataFrame, codebooks: Codebooks, codes: str = "codes", out: str = "restored") -> DataFrame:
    """All columns of ``df`` and the entries that ``codes`` name, divided by the scale."""
    books = F.lit(codebooks.entries.astype(float).tolist()) if codebooks.entries.size else F.array()
    entry = F.flatten(F.transform(codes, lambda c, i: F.element_at(F.element_at(books, i + 1), c + 1)))
    return df.withColumn(out, F.transform(entry, lambda x: x / codebooks.scale))


#: beyond this many groups their totals are joined by a salted shuffle
MAX_BROADCAST = 100_000


def with_group_total(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` (written rows) with the sum of ``value`` over the rows of an equal ``key``; nulls are one group."""
    keyed = df.withColumn("_null", F.col(key).isNull()).withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    sums = keyed.groupBy("_null", "_key").agg(F.sum(value).alias(out))
    if sums.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        return keyed.join(F.broadcast(sums), ["_null", "_key"]).drop("_null", "_key")
    return salted_join(keyed, sums, ["_null", "_key"]).drop("_null", "_key")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The query in DuckDB SQL: brute-force distances, one step per round."""
    far = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"  # floor(s / n)
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM kept, range({parts}) p(part))",
        f"c0 AS MATERIALIZED (SELECT v.part, entry, v.x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) f USING (vec_id) WHERE entry < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, v.label, v.part, any_value(v.x) AS x, arg_min(c.entry, (d, c.entry)) AS entry, min(d) AS d "
                     f"FROM v JOIN c{r} c USING (part), LATERAL (SELECT {far} AS d) GROUP BY 1, 2, 3)")
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY 1, 2, 3), "
                f"m{r} AS (SELECT part, entry, list({mean} ORDER BY i) AS x FROM s{r} GROUP BY 1, 2), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m{r}.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} USING (part, entry))")
    steps.append(f"rows AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1, 2)")
    books = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM rows"


ORACLE = oracle()
