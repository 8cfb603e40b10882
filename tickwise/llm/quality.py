"""Quality rules: base counts and a hashed n-gram likelihood ratio (operator 10), with DataFrame functions alone.

Words end at ASCII white space.  The base counts of a text are exact; repeated
8-word windows are found by hash within the text.  Word 1- and 2-grams are
hashed into ``BUCKETS``; one pass over all documents counts them for the raw
corpus and for the trusted target, and

    ratio = mean over the text's n-grams of log p_target(bucket) - log p_raw(bucket)

is the length-normalised score; the target is smoothed towards the raw corpus
with ``PRIOR`` counts a bucket.  The trusted target are documents labelled as
good, all of them (beyond ``MAX_TRUSTED`` joined by a shuffle); the raw corpus is
every row.  A third of the trusted documents, by hash, is held back from the
counts.  They place the threshold: a document is kept if no base rule fails
and its ratio is not ``DEVIATIONS`` standard deviations (between documents,
and of a mean of so many n-grams) below theirs; equal texts get equal verdicts.

Defined results: a null or empty text has zero counts, ratio 0.0, and fails
the base rule on length.  With too few trusted documents to place a threshold
every ratio is 0.0 and the base rules decide.
Other columns are kept, added ones replace those of their name.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import barrier

BUCKETS = 1 << 16
PRIOR, DEVIATIONS, MIN_HELD = 2.0, 3.5, 20
#: labelled ids of the trusted target that are still broadcast
MAX_TRUSTED = 200_000
MIN_WORDS, MAX_REPEAT_PERCENT, SPAN = 20, 30, 8
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", "[#*$%&|<>]"
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
LONGS = "array<long>"


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def buckets(h: str) -> Column:
    """Buckets of the 1- and 2-grams of hashed words."""
    one = F.transform(F.col(h), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    starts = F.sequence(F.lit(0), F.size(h) - 2)
    two = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.get(F.col(h), i), F.get(F.col(h), i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.when(F.size(h) > 1, F.concat(one, two)).otherwise(one)


def windows(h: str, n: int) -> Column:
    starts = F.sequence(F.lit(0), F.size(h) - n)
    each = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(n)]))
    return F.when(F.size(h) >= n, each).otherwise(F.array().cast(LONGS))


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the trusted documents and whether they are ``held`` back from the counts to place the threshold."""
    good = labels.where("quality = 1").select(F.col(key).alias("_id")).where("_id IS NOT NULL").dropDuplicates()
    return good.withColumn("held", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(3)) == 0)


@dataclass
class Model:
    """Log ratio per bucket, and the held-back documents' mean ratio with its variances between and within documents."""

    ratios: list[float]
    mean: float = 0.0
    between: float = 0.0
    within: float = 0.0

    def floor(self, n: Column) -> Column:
        """Least ratio of a document with n n-grams that is kept."""
        return F.lit(self.mean) - DEVIATIONS * F.sqrt(F.lit(self.between) + F.lit(self.within) / F.greatest(n, F.lit(1)))


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """Model counted over all documents; None where fewer than MIN_HELD trusted documents place the threshold."""
    few = trusted.count() <= MAX_TRUSTED
    side = lambda d: F.broadcast(d) if few else d
    rows = docs.select(F.col(key).alias("_id"), word_hashes(F.col(text)).alias("h"))
    counted = trusted.where("NOT held").select("_id", F.lit(1).alias("_t"))
    grams = rows.join(side(counted), "_id", "left").select(F.coalesce("_t", F.lit(0)).alias("t"), F.explode(buckets("h")).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()  # at most BUCKETS rows
    raw, target = [1] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["b"]] += r["raw"]
        target[r["b"]] = r["target"]
    n_raw, n_target, prior = sum(raw), sum(target), PRIOR * BUCKETS
    if not n_target:
        return None
    ratios = [round(math.log((t + prior * r / n_raw) / (n_target + prior)) - math.log(r / n_raw), 4) for t, r in zip(target, raw)]
    held = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(side(trusted.where("held").select("_id")), "_id", "left_semi")
    held = scored(held.select(word_hashes(F.col("text")).alias("_h")), ratios)
    some = lambda c: F.when(F.col("_n") > 0, F.col(c))
    stats = held.agg(F.count(some("ratio")).alias("n"), F.avg(some("ratio")).alias("mean"), F.var_pop(some("ratio")).alias("between"), F.avg(some("_square")).alias("within")).first()
    if stats["n"] < MIN_HELD:
        return None
    return Model(ratios, stats["mean"], stats["between"], stats["within"])


def scored(rows: DataFrame, ratios: list[float]) -> DataFrame:
    """``rows`` with hashed words ``_h``: n-grams ``_n``, their mean ``ratio`` and mean square ``_square``."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(a: Column, b: Column) -> Column:
        x = F.element_at(table, b + 1)
        return F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))

    rows = rows.withColumn("_g", buckets("_h")).drop("_h")
    rows = rows.withColumn("_n", F.size("_g")).withColumn("_t", F.aggregate("_g", zero, add)).drop("_g")
    mean = lambda c: F.when(F.col("_n") > 0, F.col("_t")[c] / F.col("_n")).otherwise(0.0)
    return rows.withColumns({"ratio": mean("s"), "_square": mean("q")}).drop("_t")


def covered(starts: str, n: int) -> Column:
    """Positions inside the windows of n that begin at sorted distinct starts."""
    gaps = F.transform(F.col(starts), lambda p, i: F.least(F.coalesce(F.get(F.col(starts), i + 1) - p, F.lit(n)), F.lit(n)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the base counts and base_failed; ``_h`` holds the hashed words."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(*ADDED).withColumn("_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    out = out.withColumns(
        {
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
            "_lines": lines,
        }
    ).drop("_words")
    out = out.withColumns({"_w": windows("_h", SPAN), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    # only texts with a repeated window are sorted: equal windows become neighbours
    placed = F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    out = out.withColumn("_p", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed)).drop("_w")
    at = lambda j: F.get(F.col("_p"), j)
    twice = lambda x, j: F.coalesce(at(j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(at(j + 1)["w"] == x["w"], F.lit(False))
    out = out.withColumn("_s", F.sort_array(F.transform(F.filter("_p", twice), lambda x: x["i"]))).drop("_p")
    out = out.withColumn("n_repeat_words", F.coalesce(covered("_s", SPAN), F.lit(0).cast("long"))).drop("_s")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def judge(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the base counts, base_failed, ratio and kept."""
    out = base_counts(docs, text)
    if model is None:
        return barrier(out.drop("_h").withColumn("ratio", F.lit(0.0)).withColumn("kept", ~F.col("base_failed")))
    out = scored(out, model.ratios).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= model.floor(F.col("_n"))))
    return barrier(out.drop("_n", "_square"))
