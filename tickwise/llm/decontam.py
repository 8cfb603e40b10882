"""Benchmark decontamination by winnowing (operator 8), with DataFrame functions alone.

Words are hashed once; of every ``WINDOW - GRAM + 1`` consecutive hashes of
``GRAM``-word runs the least is a fingerprint.  Two texts that share ``WINDOW``
words share a fingerprint inside them, so no shared window is missed.
Fingerprints of benchmark and documents are joined; each hit is extended to
the windows around it, whose full hashes are looked up among the benchmark's
windows.  Items of fewer words are one window of their own length; for those
lengths every run of that many words is a fingerprint.

The benchmark's side is broadcast only while it has at most ``MAX_BROADCAST``
rows, else it is shuffled.  Documents are read twice, for all item lengths at
once: first for fingerprints alone, then, for the documents with a hit, with
positions.  A window's items stay rows until they meet a document's windows.

Defined results: null and word-free texts have no words and no hit; items
without words have no window.  An item without an id marks words like any
other, but is in no list and not counted.  Rows that repeat a document get
equal results; a null id is kept.  Without items no document is contaminated.
Columns of ``docs`` called like a result are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import stash

WINDOW, GRAM = 10, 5
MAX_BROADCAST = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same runs in a text whose A-Z are not yet lower-cased
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a whole text, A-Z lower-cased."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(h: str, n: int) -> Column:
    """Hash of the n words from each position on; empty if there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(h) - n)
    each = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(n)]))
    return F.when(F.size(h) >= n, each).otherwise(F.array().cast("array<long>"))


def least_of(g: str, n: int) -> Column:
    """The least of each n consecutive values."""
    if n == 1:
        return F.col(g)
    starts = F.sequence(F.lit(0), F.size(g) - n)
    each = F.transform(starts, lambda i: F.least(*[F.get(F.col(g), i + k) for k in range(n)]))
    return F.when(F.size(g) >= n, each).otherwise(F.array().cast("array<long>"))


def near(df: DataFrame, side: DataFrame, rows: int, keys: list[str], how: str) -> DataFrame:
    """Join with the benchmark's side, broadcast where its counted size allows."""
    return df.join(F.broadcast(side) if rows <= MAX_BROADCAST else side, keys, how)


def row_key(doc: str, text: str) -> Column:
    """128 bits that tell rows apart by id and text."""
    return F.struct(F.xxhash64(doc, text).alias("a"), F.xxhash64(F.lit(1), text, doc).alias("b"))


def search(docs: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(k, doc_id, start, n, w): every position at which a benchmark window of n words and hash w occurs; and (w, item) rows.

    ``k`` tells rows with one id but different texts apart.
    """
    items = bench.select(F.col(item).cast("string").alias("item"), word_hashes(F.col(item_text)).alias("h")).where("size(h) > 0")
    items = items.withColumn("n", F.least(F.size("h"), F.lit(WINDOW)))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most WINDOW numbers
    if not lengths:
        empty = docs.sparkSession.createDataFrame
        return empty([], "k struct<a: long, b: long>, doc_id long, start int, n int, w long"), empty([], "w long, item string")
    short = [n for n in lengths if n < WINDOW]
    whole = WINDOW in lengths
    nothing = F.array().cast("array<long>")

    def with_runs(df: DataFrame) -> DataFrame:
        """g: hashes of the runs of GRAM words; m: the least of each window's; empty without items of full length."""
        df = df.withColumn("g", runs("h", GRAM) if whole else nothing)
        return df.withColumn("m", least_of("g", WINDOW - GRAM + 1) if whole else nothing)

    def prints(m: Column) -> Column:
        return F.array_distinct(F.concat(m, *[runs("h", n) for n in short]) if short else m)

    # an exploded plain column would get a filter on its size, pushed below the hashing of runs (see common.barrier)
    windows, marks = None, with_runs(items.where(F.col("n") == WINDOW)).select(F.explode(F.array_distinct("m")).alias("f"))
    for n in lengths:
        own = items.where(F.col("n") == n)
        rows = own.select("item", F.explode(runs("h", n)).alias("w"))
        windows = rows if windows is None else windows.unionByName(rows)
        if n < WINDOW:
            marks = marks.unionByName(own.select(F.explode(runs("h", n)).alias("f")))
    owners = stash(windows.dropDuplicates(), "windows")
    marks = stash(marks.dropDuplicates(), "marks")
    windows = owners.select("w").dropDuplicates()
    n_windows, n_marks = owners.count(), marks.count()

    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).withColumn("k", row_key("doc_id", "text"))
    first = with_runs(rows.select("k", word_hashes(F.col("text")).alias("h"))).select("k", F.explode(prints(F.col("m"))).alias("f"))
    # a document has a hit or not: partial aggregation leaves a row per document before the shuffle
    suspects = stash(near(first, marks, n_marks, ["f"], "left_semi").select("k").dropDuplicates(), "suspects")
    few = suspects.count() <= MAX_BROADCAST
    chosen = rows.join(F.broadcast(suspects) if few else suspects, "k", "left_semi").dropDuplicates(["k"])
    # words are hashed above the join: of suspects alone
    chosen = with_runs(chosen.select("k", "doc_id", word_hashes(F.col("text")).alias("h"))).withColumn("w", runs("h", WINDOW) if whole else nothing)
    spot = lambda n: lambda f, p: F.struct(F.lit(n).alias("n"), p.alias("p"), f.alias("f"))
    spots = [F.transform(F.col("g"), spot(WINDOW))] * whole + [F.transform(runs("h", n), spot(n)) for n in short]
    at = chosen.select("k", "doc_id", "w", F.inline(F.concat(*spots) if len(spots) > 1 else spots[0]))
    # a hit at p is extended to the windows that contain it; an inner join (marks are distinct), below
    # which the slice stays: the whole array w never leaves its document's row
    low = F.greatest(F.col("p") - (WINDOW - GRAM), F.lit(0))
    around = F.slice("w", low + 1, F.greatest(F.least(F.col("p") + 1, F.size("w")) - low, F.lit(0)))
    full = F.col("n") == WINDOW
    at = at.select("k", "doc_id", "n", F.when(full, low).otherwise(F.col("p")).alias("low"), "f", F.when(full, around).otherwise(F.array("f")).alias("ws"))
    wide = near(at, marks, n_marks, ["f"], "inner").select("k", "doc_id", "n", "low", F.posexplode(F.array_compact("ws")).alias("i", "w"))
    found = near(wide, windows, n_windows, ["w"], "inner").select("k", "doc_id", (F.col("low") + F.col("i")).alias("start"), "n", "w")
    return stash(found.dropDuplicates(["k", "start", "n"]), "hits"), owners


def covered(spans: str) -> Column:
    """Positions inside the union of spans (start, n), an array sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("to"))

    def add(a: Column, x: Column) -> Column:
        end = (x["start"] + x["n"]).cast("long")
        return F.struct((a["sum"] + F.greatest(end - F.greatest(a["to"], x["start"].cast("long")), F.lit(0).cast("long"))).alias("sum"), F.greatest(a["to"], end).alias("to"))

    return F.aggregate(F.col(spans), zero, add)["sum"]


def contamination(docs: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """All columns of ``docs``, n_words, n_hit, n_items, items (sorted as text) and contaminated."""
    found, owners = search(docs, bench, doc, text, **names)
    spans = found.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    owned = near(found.select("k", "w").dropDuplicates(), owners, owners.count(), ["w"], "inner")
    lists = owned.groupBy("k").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_doc = stash(spans.select("k", covered("spans").alias("n_hit")).join(lists, "k"), "contaminated")
    weight = per_doc.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    rows = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated")
    key = "_k"
    while key in {c.lower() for c in rows.columns}:
        key += "_"
    side = per_doc.withColumnRenamed("k", key)
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_ANY_CASE)).cast("long")
    out = rows.withColumn(key, row_key(doc, text)).withColumn("n_words", words)
    out = out.join(F.broadcast(side) if weight <= MAX_BROADCAST // 10 else side, key, "left").drop(key)
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
