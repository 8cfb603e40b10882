"""Scans and ingest: text lines, CSV folders, wide documents, messages.

Connectors are format names plus options: in deployment ``read_messages``
uses ``format("kafka")``; tests and the checked queries use files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.session import cut_lineage

# Fixed values that must equal the reference: bar record fields and defaults.
BAR_FIELDS = ["Type", "Date", "Time", "open", "high", "low", "close", "volume"]
BAR_CSV_SCHEMA = "Type string, Date long, Time string, open double, high double, low double, close double, volume double"
DOC_EPOCH = "2024-01-01 00:00:00"
SKIP_KEYS = ("_id", "timestamp")


# ---------------------------------------------------------------------------
# files
# ---------------------------------------------------------------------------

def read_bar_lines(spark: SparkSession, path: str, n_fields: int = 8) -> DataFrame:
    """A4: raw lines with a validity flag (trimmed, exactly ``n_fields`` comma-separated fields)."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path")
    )
    line = F.regexp_replace(F.col("value"), r"^[\s]+|[\s]+$", "")
    parts = F.split(line, ",")
    return raw.withColumn("line", line).withColumn("fields", parts).withColumn(
        "is_valid", (F.length("line") > 0) & (F.size("fields") == n_fields)
    )


def parse_bar_lines(lines: DataFrame) -> DataFrame:
    """Valid lines as typed bars (the 8 reference fields)."""
    f = F.col("fields")
    valid = lines.filter("is_valid")
    return valid.select(
        F.trim(f[0]).alias("Type"), F.trim(f[1]).cast("long").alias("Date"), F.trim(f[2]).alias("Time"),
        *[F.trim(f[i]).cast("double").alias(n) for i, n in enumerate(["open", "high", "low", "close", "volume"], start=3)],
        "file_name",
    )


def line_quality(lines: DataFrame, spark: SparkSession | None = None, path: str | None = None) -> DataFrame:
    """A5 + G9: valid / invalid lines per file (by path) and a total row (``file_path`` null).

    Zero-length files have no lines; pass ``path`` to count them as skipped.
    """
    per_file = lines.groupBy("file_path", "file_name").agg(
        F.count_if("is_valid").alias("valid_lines"), F.count_if(~F.col("is_valid")).alias("invalid_lines")
    )
    total = per_file.agg(F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("file_name"),
                         F.sum("valid_lines").alias("valid_lines"), F.sum("invalid_lines").alias("invalid_lines"))
    out = per_file.unionByName(total)
    if spark is not None and path is not None:
        skipped = count_empty_files(spark, path)
        out = out.withColumn("skipped_files", F.when(F.col("file_path").isNull(), F.lit(skipped)).otherwise(F.lit(0)).cast("long"))
    return out


def count_empty_files(spark: SparkSession, path: str) -> int:
    """Zero-length files under ``path``: those of Spark's own listing that its scan has no row for."""
    files = _listed(spark, path)
    return len(files.inputFiles()) - files.select("length").count()


def _listed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def file_listing(spark: SparkSession, path: str, glob: str | None = None, empty: bool = False) -> DataFrame:
    """File paths and sizes only (``binaryFile`` without touching the content column).

    A scan has no row for a zero-length file; with ``empty`` the names that only Spark's listing holds are added.
    """
    files = _listed(spark, path, glob)
    df = files.select("path", F.col("_metadata.file_path").alias("file_path"), "length")
    if empty:
        names = files.inputFiles()
        if len(names) > df.count():
            every = spark.createDataFrame([(re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):///", r"\1:/", n),) for n in names], "file_path string")
            plain = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
            df = df.unionByName(every.join(df, "file_path", "left_anti").select(plain.alias("path"), "file_path", F.lit(0).cast("long").alias("length")))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    return df.withColumn("file_name", name).withColumn("ext", ext)


def file_inventory(spark: SparkSession, path: str, pattern: str = "_nifty50_", top: int = 5) -> dict[str, DataFrame]:
    """Totals, top extensions and share of names matching ``pattern`` (case-insensitive)."""
    files = file_listing(spark, path, empty=True)
    match = F.lower("file_name").contains(pattern.lower())
    totals = files.agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_if(match).alias("matching"),
    ).withColumn("matching_pct", F.when(F.col("files") > 0, F.col("matching") / F.col("files") * 100.0).otherwise(0.0))
    by_ext = files.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return {"totals": totals, "by_ext": by_ext, "top_ext": by_ext.orderBy(F.desc("files"), "ext").limit(top)}


def exclude_sources(df: DataFrame, pattern: str = "_nifty50_", case_sensitive: bool = False, col: str = "file_name") -> DataFrame:
    """A10: drop rows from files whose name contains ``pattern`` (nothing is deleted)."""
    name = F.col(col) if case_sensitive else F.lower(F.col(col))
    pat = pattern if case_sensitive else pattern.lower()
    return df.filter(~name.contains(pat))


def provenance_names(files: DataFrame, root: str) -> DataFrame:
    """name = root folder and folder path joined with '_' + file name; repeats of a name get _1, _2 ...

    Files are grouped by their own name (extension included); numbering is by path within a group.
    """
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    root = re.sub(scheme, "", root).rstrip("/")
    path = F.regexp_replace("path", scheme, "")
    rel = F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 2**31 - 1)).otherwise(path)
    parts = F.split(rel, "/")
    base = F.element_at(parts, -1)
    name = F.concat_ws("_", F.lit(root.rsplit("/", 1)[-1]), F.slice(parts, 1, F.size(parts) - 1), base)
    df = files.withColumn("_base", base).withColumn("_name", name)
    k = (F.row_number().over(Window.partitionBy("_base", "_name").orderBy("path")) - 1).cast("string")
    numbered = F.when(F.instr("_name", ".") > 0, F.regexp_replace("_name", r"(\.[^.]*)$", F.concat(F.lit("_"), k, F.lit("$1"))))
    numbered = F.coalesce(numbered, F.concat("_name", F.lit("_"), k))
    return df.withColumn("new_name", F.when(k == "0", F.col("_name")).otherwise(numbered)).drop("_base", "_name")


def rows_per_file(spark: SparkSession, path: str) -> DataFrame:
    """Row count per Parquet file, by path."""
    m = F.col("_metadata")
    return spark.read.parquet(path).groupBy(m["file_path"].alias("file_path"), m["file_name"].alias("file_name")).count()


def human_size(size) -> Column:
    """A number of bytes as text with two decimals and a unit."""
    c = F.col(size) if isinstance(size, str) else size
    out = F.concat(F.format_string("%.2f", c / F.lit(1024.0**5)), F.lit(" PB"))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(c < 1024.0 ** (power + 1), F.concat(F.format_string("%.2f", c / F.lit(1024.0**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


# ---------------------------------------------------------------------------
# CSV folders
# ---------------------------------------------------------------------------

def csv_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Text lines of every file below ``path`` with their file and place."""
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    m = F.col("_metadata")
    return r.text(path).select(
        "value", m["file_path"].alias("file_path"), m["file_name"].alias("file_name"), m["file_block_start"].alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )


def csv_structure(lines: DataFrame) -> DataFrame:
    """Per file its first line, whether that is a header, and the column names.

    A header is present unless some field of the first line is all digits (a
    bar date); without one eight columns get the bar names, others ``col_i``.
    """
    first = lines.where("_block = 0").groupBy("file_path").agg(F.min_by("value", "_place").alias("first_line"))
    fields = F.transform(F.split("first_line", ","), lambda x: F.trim(x))
    generic = F.when(F.size(fields) == len(BAR_FIELDS), F.array(*map(F.lit, BAR_FIELDS))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(fields) - 1), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    header = ~F.exists(fields, lambda x: x.rlike("^[0-9]+$"))
    return first.withColumn("has_header", header).withColumn("columns", F.when(header, fields).otherwise(generic))


def csv_fields(line) -> Column:
    """The fields of a CSV line, without the quotes and white space around them; commas in quotes do not part."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda x: F.replace(F.regexp_replace(F.trim(x), r'^"|"$', ""), F.lit('""'), F.lit('"')))


def read_bars_csv(spark: SparkSession, path: str | list[str], glob: str | None = None, missing: str = "error") -> DataFrame:
    """Bar CSVs with and without headers, decided per file; columns go by the file's names (in any case and order).

    Only header lines are left out.  A file without one of the bar columns is
    an error; with ``missing="null"`` that column is null in its rows.
    """
    lines = csv_lines(spark, path, glob)
    names = F.transform("columns", lambda c: F.lower(F.regexp_replace(c, '"', "")))
    heads = csv_structure(lines).select("file_path", F.when(F.col("has_header"), F.col("first_line")).alias("_head"), names.alias("_names"))
    rows = lines.join(heads, "file_path").where(~F.coalesce(F.col("value") == F.col("_head"), F.lit(False)) & (F.length(F.trim("value")) > 0))
    rows = rows.withColumn("_fields", csv_fields(F.col("value")))

    def field(name: str, kind: str) -> Column:
        place = F.array_position("_names", F.lit(name.lower())).cast("int")
        value = F.get("_fields", place - 1)
        if missing == "error":
            value = F.when(place == 0, F.raise_error(F.concat(F.lit(f"column {name} is missing in "), "file_path"))).otherwise(value)
        return F.nullif(value, F.lit("")).try_cast(kind).alias(name)

    kinds = [c.split() for c in BAR_CSV_SCHEMA.split(", ")]
    return rows.select(*[field(n, k) for n, k in kinds], "file_path", "file_name")


def symbol_files(spark: SparkSession, root: str, symbols: list[str]) -> DataFrame:
    """The CSV files of the chosen symbols: (folder_symbol, folder, path, file_path).

    A symbol's folder bears its name, with or without ``.txt``; one directly
    below ``root`` comes before a deeper one, the plain name before ``.txt``.
    Its files may lie in subfolders.
    """
    files = file_listing(spark, root, "*.csv")
    base = "/" + root.split("://")[-1].split(":", 1)[-1].strip("/") + "/"
    below = F.element_at(F.split("path", re.escape(base).replace("/", "/+"), 2), -1)
    parts = F.split(below, "/+")
    dirs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d, i: F.struct(i.alias("depth"), d.alias("name")))
    each = files.select("path", "file_path", parts.alias("_parts"), F.explode(dirs).alias("_dir"))
    name = F.regexp_replace("_dir.name", r"\.txt$", "")
    wanted = spark.createDataFrame([(s,) for s in sorted({s.removesuffix(".txt") for s in symbols})], "folder_symbol string")
    each = each.withColumn("folder_symbol", name).join(wanted, "folder_symbol", "left_semi")
    folder = F.array_join(F.slice("_parts", 1, F.col("_dir.depth") + 1), "/")
    rank = F.struct((F.col("_dir.depth") > 0).alias("deep"), (F.col("_dir.name") != F.col("folder_symbol")).alias("txt"), folder.alias("folder"))
    each = each.select("folder_symbol", "path", "file_path", rank.alias("_rank"))
    best = each.groupBy("folder_symbol").agg(F.min("_rank").alias("_best"))   # a row per requested symbol
    return each.join(best, "folder_symbol").where("_rank = _best").select("folder_symbol", F.col("_rank.folder").alias("folder"), "path", "file_path")


def read_symbol_folders(spark: SparkSession, root: str, symbols: list[str]) -> tuple[DataFrame, DataFrame]:
    """CSV scan of the chosen symbols' folders and their subfolders (see :func:`symbol_files`); no other folder is read.

    Returns ``(bars, missing)`` where ``missing`` lists requested symbols without data.
    """
    files = cut_lineage(symbol_files(spark, root, symbols))
    folders = [r[0] for r in files.select("folder").distinct().collect()]   # at most one per requested symbol
    wanted = spark.createDataFrame([(s.removesuffix(".txt"),) for s in symbols], "folder_symbol string")
    missing = wanted.join(files.select("folder_symbol").distinct(), "folder_symbol", "left_anti")
    if not folders:
        empty = spark.createDataFrame([], f"{BAR_CSV_SCHEMA}, file_path string, file_name string, folder_symbol string")
        return empty, missing
    bars = read_bars_csv(spark, [f"{root.rstrip('/')}/{f}" for f in folders], "*.csv")
    return bars.join(files.select("file_path", "folder_symbol"), "file_path").select(*bars.columns, "folder_symbol"), missing


def load_bars(csv_bars: DataFrame) -> DataFrame:
    """BAR rows from CSV bars: symbol from ``Type`` or the file stem, ts from Date + Time."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "") if "file_name" not in csv_bars.columns else F.regexp_replace(F.col("file_name"), r"\.[^.]*$", "")
    symbol = F.coalesce(F.col("Type"), stem)
    ts = F.try_to_timestamp(F.concat_ws(" ", F.col("Date").cast("string"), F.col("Time")), F.lit("yyyyMMdd HH:mm"))
    return csv_bars.select(
        symbol.alias("symbol"), ts.cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume",
        F.col("Date").cast("string").alias("date"), F.col("Time").alias("time"),
    )


# ---------------------------------------------------------------------------
# Wide documents and messages
# ---------------------------------------------------------------------------

def bar_record(df: DataFrame) -> DataFrame:
    """BAR rows -> the reference's 8-field record (Date as yyyyMMdd number)."""
    return df.select(
        "symbol", "ts", *[c for c in ("rn",) if c in df.columns],
        F.struct(F.col("symbol").alias("Type"), F.col("date").cast("long").alias("Date"), F.col("time").alias("Time"),
                 "open", "high", "low", "close", "volume").alias("bar"),
    )


def documents_wide(bars: DataFrame, start: str = DOC_EPOCH, suffix: str = ".csv") -> DataFrame:
    """H7: align symbol tables by ordinal into one document per ordinal.

    ``documents(ordinal, timestamp, bars map<file, bar>)``; a short table simply
    has no entry.  The n-way full outer join of the reference is one shuffle
    on the ordinal here.
    """
    from tickwise.operators import chunking

    # ordinal = global row number - 1 from the series layout (no whole-symbol window)
    lay = chunking.layout(bars.drop(*[c for c in ("rn", "n_sym") if c in bars.columns]), halo=0, ties=True)
    rows = lay.numbered()
    rows = lay.own(rows)
    rec = bar_record(rows).withColumn("ordinal", (F.col("rn") - 1).cast("long"))
    docs = rec.groupBy("ordinal").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat("symbol", F.lit(suffix)), "bar"))).alias("bars")
    )
    return docs.withColumn(
        "timestamp", F.to_timestamp(F.lit(start)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("ordinal").cast("double"))
    )


def to_messages(docs: DataFrame, partitions: int = 3, now=None) -> DataFrame:
    """key = ISO time, value = JSON of the document (``timestamp`` + one key per file).

    ``now=None`` keeps event time (the reference re-stamps with wall time).
    """
    ts = F.col("timestamp") if now is None else F.lit(now).cast("timestamp_ntz")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    entries = F.when(F.size("bars") > 0, F.concat(F.lit(","), F.expr("substring(to_json(bars), 2)"))).otherwise(F.lit("}"))
    value = F.concat(F.lit('{"timestamp":"'), iso, F.lit('"'), entries)
    return docs.select(
        iso.alias("key"), value.alias("value"),
        (F.col("ordinal") % partitions).cast("int").alias("partition"),
        F.floor(F.col("ordinal") / F.lit(partitions)).cast("long").alias("offset"),
        ts.alias("timestamp"),
    )


def read_messages(spark: SparkSession, source: str, fmt: str = "kafka", max_per_trigger: int = 1000,
                  options: dict | None = None, schema: str | None = None) -> DataFrame:
    """A1: streaming message source.  Kafka options as in the reference (earliest
    offsets, tolerate data loss, max offsets per trigger); file formats for tests."""
    r = spark.readStream.format(fmt)
    if fmt == "kafka":
        r = r.option("subscribe", source).option("startingOffsets", "earliest").option("failOnDataLoss", "false").option(
            "maxOffsetsPerTrigger", max_per_trigger)
        for k, v in (options or {}).items():
            r = r.option(k, v)
        return r.load()
    if schema:
        r = r.schema(schema)
    r = r.option("maxFilesPerTrigger", max(1, max_per_trigger))
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load(source)


def decode_messages(msgs: DataFrame) -> DataFrame:
    """A2: key/value as text, carry partition, offset and broker time."""
    return msgs.select(
        F.col("key").cast("string").alias("message_key"), F.col("value").cast("string").alias("value"),
        F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"),
        F.col("timestamp").alias("source_ts"),
    )


def explode_bars(decoded: DataFrame, value_col: str = "value", strict: bool = False) -> DataFrame:
    """A3: one BAR row per symbol entry of each JSON document, no Python UDF.

    Skips ``_id`` / ``timestamp`` keys, null entries and entries without
    ``Type``; an unparsable document gives no rows; null prices stay null.
    ``strict=True`` drops the whole document when an entry has a bad number
    (the reference's UDF behaviour); it is decided inside the document, so it
    works in a stream.  Each entry is parsed once, as text.
    """
    text = T.StructType([T.StructField(n, T.StringType()) for n in BAR_FIELDS])
    prices = ["open", "high", "low", "close", "volume"]
    doc = decoded.withColumn("_doc", F.from_json(F.col(value_col), "map<string,string>"))
    kept = F.map_filter("_doc", lambda k, v: ~k.isin(*SKIP_KEYS) & v.isNotNull())
    entries = F.filter(F.transform(F.map_values(kept), lambda v: F.from_json(v, text)), lambda r: r["Type"].isNotNull())
    doc = doc.withColumn("_entries", entries)
    if strict:
        def good(r):
            ok = F.lit(True)
            for c in prices:
                ok = ok & (r[c].isNull() | r[c].try_cast("double").isNotNull())
            return ok

        doc = doc.withColumn("_entries", F.when(F.forall("_entries", good), F.col("_entries")))
    e = doc.select("*", F.explode("_entries").alias("_bar"))
    b = F.col("_bar")
    date = b["Date"].try_cast("long").cast("string")
    ts = F.try_to_timestamp(F.concat_ws(" ", date, b["Time"]), F.lit("yyyyMMdd HH:mm")).cast("timestamp_ntz")
    return e.select(
        b["Type"].alias("symbol"), ts.alias("ts"), *[b[c].try_cast("double").alias(c) for c in prices],
        date.alias("date"), b["Time"].alias("time"), "partition", "offset", "source_ts", F.col("_doc")["timestamp"].alias("doc_ts"),
    )


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored documents ordered by timestamp."""
    return spark.read.format(fmt).load(path).orderBy("timestamp")


def list_symbols(df: DataFrame) -> DataFrame:
    """Distinct keys of a state table, sorted."""
    return df.select("symbol").distinct().orderBy("symbol")


def read_sequences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored sequences plus a one-row metadata aggregate (lookback, features, markers, splits)."""
    seqs = spark.read.parquet(path)
    meta = seqs.agg(
        F.max(F.size("X")).alias("lookback"), F.max(F.size(F.element_at("X", 1))).alias("n_features"),
        F.sort_array(F.collect_set("symbol")).alias("markers"), F.sort_array(F.collect_set("split")).alias("splits"),
        F.count(F.lit(1)).alias("sequences"),
    )
    return seqs, meta
