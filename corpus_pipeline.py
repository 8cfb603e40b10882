"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a frame.  All but the last return rows of ``docs`` with exactly
its columns and values: whatever a column is called (``score``, ``items``,
``kept``, ``k`` ...), the operators see only ``doc_id`` and ``text`` under
their own names, the others step aside and come back.

Every stage has a defined result for every row.  A null or empty text has no
words: it is not toxic, poor (below the least number of words), in no group
and without benchmark windows, and it has no tokens.  Rows without an id take
part like others, except that no label can name them.  Repeated rows are
judged alike.  Texts of any length are read whole.  An empty table gives none.

Two settings bound memory (``BOUNDS``), where the session has none of its own:
texts go to Python in batches of some megabytes, and the driver keeps no plan
descriptions of any length (the quality model is a constant of its plan).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import bpe, decontam, neardup, quality, toxicity
from tickwise.llm.common import salted_join, shared_dir, stash, table
from tickwise.llm.queries import PATTERN, RANKS, toxic_field

#: words of a shingle of the near-duplicate stage
SHINGLE = 5
#: without the first a batch is 10,000 texts of any size
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.maxPlanStringLength": 100_000}
#: Spark's own value of the second, which stands for no bound
UNBOUND = str(2**31 - 16)


def bound(spark: SparkSession) -> None:
    for key, value in BOUNDS.items():
        if spark.conf.get(key, None) in (None, UNBOUND):
            spark.conf.set(key, str(value))


def give_back() -> None:
    """Return the driver's freed memory, as far as the C library can: a fitted model leaves much of it behind."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``doc_id`` and ``text`` under private names, and the way back."""
    bound(docs.sparkSession)
    names = {c: c if c in ("doc_id", "text") else f"_in_{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    hidden = docs.select(*[quoted(c).alias(n) for c, n in names.items()])
    return hidden, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the operator's threshold.

    The field is fitted on the labelled rows of ``docs`` that may be learned
    from; without toxic ones among them every row stays.
    """
    hidden, back = set_aside(docs)
    scored = toxicity.score(hidden, toxic_field(spark, sf_dir, docs), spans=False)
    give_back()
    return back(scored.where(F.col("score") < toxicity.REJECT))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; the raw corpus is what came in.

    Null, empty and short texts fail the base rules and go.
    """
    hidden, back = set_aside(docs)
    model = quality.fit(docs.select("doc_id", "text"), quality.trusted_ids(table(spark, sf_dir, "labels")))
    out = back(quality.judge(hidden, model).where("kept"))
    give_back()
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: that of least id, one without an id only if none has one.

    Rows are told apart by a 64-bit hash of id and text: rows that share an id
    but not the text are documents of their own, rows equal in both (also
    with a null id, a null text as an empty one) are one, of which one row
    stays.  Documents without words are in no group.
    """
    hidden, back = set_aside(docs)
    keyed = hidden.withColumn("_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = neardup.groups(keyed.select("_key", "text"), key="_key", size=SHINGLE).select("id", "component_id").dropDuplicates()
    ids = keyed.select(F.col("_key").alias("id"), "doc_id").dropDuplicates(["id"])
    members = stash(found.join(ids, "id"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "id"))["id"]
    stays = members.groupBy("component_id").agg(first.alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", "stays")
    lost = salted_join(members.select("id", "component_id"), stays, ["component_id"]).where("id <> stays")
    lost = stash(lost.select(F.col("id").alias("_key")), "lost")
    few = lost.count() <= decontam.MAX_BROADCAST
    kept = keyed.join(F.broadcast(lost) if few else lost, "_key", "left_anti")
    twice = stash(keyed.groupBy("_key").count().where("count > 1").select("_key"), "twice")
    if twice.isEmpty():
        return back(kept)
    single = kept.join(twice, "_key", "left_anti").drop("_key")
    return back(single.unionByName(kept.join(twice, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; those without words have none and stay."""
    hidden, back = set_aside(docs)
    found = decontam.contamination(hidden, table(spark, sf_dir, "benchmark"))
    return back(found.where("NOT contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and their number, and whether decoding gives the text back.

    A null text counts as empty: no ids, and the empty text comes back.
    Columns of ``docs`` beyond these end here.
    """
    bound(spark)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), RANKS, PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("neardup", drop_near_duplicates),
    ("decontam", drop_contaminated),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written below the shared folder and read back."""
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs


#: classifiers, sketches and the tokenizer cannot be expressed in SQL
ORACLE_SQL = None
