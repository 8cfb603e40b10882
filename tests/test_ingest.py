"""Files, documents, messages and sinks."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tickwise.operators import clean as cl
from tickwise.sources import fixtures as fx
from tickwise.sources import ingest as ig
from tickwise.sources import sinks as sk


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_bar_lines_and_quality(spark, tmp_dir):
    good = "ACC_F1,20170801,09:16,1753.35,1753.35,1750,1752.3,8400\n"
    _write(f"{tmp_dir}/lines/ACC_F1.txt", good * 3 + "ACC_F1,20170801,09:17,1,2,3,4\n\n \tACC_F1,20170801,09:18,1,2,3,4,5,6\r\n")
    _write(f"{tmp_dir}/lines/X_nifty50_.txt", good)
    _write(f"{tmp_dir}/lines/empty.txt", "")
    lines = ig.read_bar_lines(spark, f"{tmp_dir}/lines")
    q = {r.file_name: (r.valid_lines, r.invalid_lines, r.skipped_files) for r in ig.line_quality(lines, spark, f"{tmp_dir}/lines").collect()}
    assert q["ACC_F1.txt"] == (3, 3, 0)
    assert q[None] == (4, 3, 1)
    bars = ig.parse_bar_lines(lines)
    assert bars.filter("Type = 'ACC_F1'").count() == 4
    assert ig.exclude_sources(bars).count() == 3


def test_csv_header_detection_and_load(spark, tmp_dir):
    _write(f"{tmp_dir}/h/ACC.csv", "Type,Date,Time,open,high,low,close,volume\nACC,20170801,09:16,1,2,0.5,1.5,10\n")
    _write(f"{tmp_dir}/n/ACC.csv", "ACC,20170801,09:16,1,2,0.5,1.5,10\n")
    _write(f"{tmp_dir}/g/x.csv", "a,1,b\n")
    found = {r.file_path.split("/")[-2]: r for r in ig.csv_structure(ig.csv_lines(spark, tmp_dir)).collect()}
    assert [found[k].has_header for k in "hng"] == [True, False, False]
    assert found["g"].columns == ["col_0", "col_1", "col_2"] and found["n"].columns[0] == "Type"
    assert ig.read_bars_csv(spark, tmp_dir, "ACC.csv").count() == 2
    for d in ("h", "n"):
        b = ig.load_bars(ig.read_bars_csv(spark, f"{tmp_dir}/{d}")).first()
        assert (b.symbol, str(b.ts), b.close) == ("ACC", "2017-08-01 09:16:00", 1.5)


def test_symbol_folders_and_provenance(spark, tmp_dir):
    row = "Type,Date,Time,open,high,low,close,volume\nA,20170801,09:16,1,2,0.5,1.5,10\n"
    _write(f"{tmp_dir}/root/AAA.txt/part.csv", row)
    _write(f"{tmp_dir}/root/BBB/part.csv", row)
    bars, missing = ig.read_symbol_folders(spark, f"{tmp_dir}/root", ["AAA", "BBB", "CCC"])
    assert sorted(r[0] for r in bars.select("folder_symbol").collect()) == ["AAA", "BBB"]
    assert [r[0] for r in missing.collect()] == ["CCC"]
    names = ig.provenance_names(ig.file_listing(spark, f"{tmp_dir}/root"), f"{tmp_dir}/root")
    assert sorted(r.new_name for r in names.collect()) == ["root_AAA.txt_part.csv", "root_BBB_part.csv"]


def test_csv_columns_go_by_name(spark, tmp_dir):
    """Three column orders, other columns, quotes and cases: one table; a missing column is an error."""
    _write(f"{tmp_dir}/in/a.csv", "Type,Date,Time,open,high,low,close,volume\nA,20170801,09:16,1,2,0.5,1.5,10\n")
    _write(f"{tmp_dir}/in/b.csv", 'Date,Time,"Type",volume,Close,low,high,open,note\n20170801,09:17,"B,1",10,1.5,0.5,2,1,"x, y"\n')
    _write(f"{tmp_dir}/in/c.csv", "close,low,high,open,volume,extra,Type,Time,Date\n1.5,0.5,2,1,10,,C,09:18,20170801\nbad,,2,1,10,7,C,09:19,20170801\n")
    got = sorted(tuple(r)[:8] for r in ig.read_bars_csv(spark, f"{tmp_dir}/in").collect())
    assert got[:3] == [("A", 20170801, "09:16", 1.0, 2.0, 0.5, 1.5, 10.0), ("B,1", 20170801, "09:17", 1.0, 2.0, 0.5, 1.5, 10.0),
                       ("C", 20170801, "09:18", 1.0, 2.0, 0.5, 1.5, 10.0)]
    assert got[3] == ("C", 20170801, "09:19", 1.0, 2.0, None, None, 10.0)
    _write(f"{tmp_dir}/in/d.csv", "Type,Date,Time,open\nD,20170801,09:16,1\n")
    with pytest.raises(Exception, match="column high is missing in .*d.csv"):
        ig.read_bars_csv(spark, f"{tmp_dir}/in").collect()
    assert ig.read_bars_csv(spark, f"{tmp_dir}/in", missing="null").where("Type = 'D' AND close IS NULL").count() == 1


def test_symbol_folders_are_searched_deep_and_alone(spark, tmp_dir):
    row = "Type,Date,Time,open,high,low,close,volume\n{},20170801,09:16,1,2,0.5,1.5,10\n"
    root = f"{tmp_dir}/my root"
    for place, name in [("AAA.txt/2024/x.csv", "a1"), ("AAA.txt/y.csv", "a2"), ("deep/AAA/z.csv", "no"), ("deep/er/BBB.txt/q/x.csv", "b1"),
                        ("BBBB/x.csv", "no"), ("CCC/x.csv", "c1"), ("CCC.txt/x.csv", "no")]:
        _write(f"{root}/{place}", row.format(name))
    _write(f"{root}/other/broken.csv", "no,columns\n1,2\n")     # never read
    bars, missing = ig.read_symbol_folders(spark, root, ["AAA", "BBB.txt", "CCC", "DDD"])
    assert sorted((r.folder_symbol, r.Type) for r in bars.collect()) == [("AAA", "a1"), ("AAA", "a2"), ("BBB", "b1"), ("CCC", "c1")]
    assert [r[0] for r in missing.collect()] == ["DDD"]
    none, missing = ig.read_symbol_folders(spark, root, ["X"])
    assert none.count() == 0 and missing.count() == 1 and none.columns == bars.columns


def test_inventory_counts_empty_files(spark, tmp_dir):
    for name, text in [("a b.csv", "123"), ("x/c.CSV", "12345"), ("x/e_NIFTY50_.txt", ""), ("none", "")]:
        _write(f"{tmp_dir}/in/{name}", text)
    inv = ig.file_inventory(spark, f"{tmp_dir}/in")
    assert tuple(inv["totals"].first()) == (4, 8, 1, 25.0)
    assert {r.ext: (r.files, r.bytes) for r in inv["by_ext"].collect()} == {"csv": (2, 8), "txt": (1, 0), "": (1, 0)}
    assert [r.ext for r in inv["top_ext"].collect()][0] == "csv" and ig.count_empty_files(spark, f"{tmp_dir}/in") == 2


def test_head_per_symbol_breaks_ties_alike(spark, monkeypatch):
    rows = [("A", "2024-01-01 00:00:00", float(i % 7), i % 3) for i in range(60)] + [("B", "2024-01-02 00:00:00", 1.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, t string, close double, x int").selectExpr("symbol", "cast(t as timestamp_ntz) ts", "close", "x")
    want = sorted(tuple(r) for r in cl.head_per_symbol(df, 25).collect())
    monkeypatch.setattr(cl, "RANK_LIMIT", 10)
    assert sorted(tuple(r) for r in cl.head_per_symbol(df, 25).collect()) == want and len(want) == 26


def test_explode_bad_documents(spark):
    vals = [
        '{"timestamp":"2024-01-01T00:00:00","a.csv":{"Type":"A","Date":20240101,"Time":"00:00","open":1,"high":2,"low":0.5,"close":1.5,"volume":10},'
        '"b.csv":null,"c.csv":{"Date":20240101},"_id":"x"}',
        "not json",
        '{"timestamp":"2024-01-01T00:00:01","d.csv":{"Type":"D","Date":20240101,"Time":"00:01","open":1,"high":2,"low":0.5,"close":null,"volume":10}}',
        '{"timestamp":"2024-01-01T00:00:02","e.csv":{"Type":"E","Date":20240101,"Time":"00:02","open":"bad","high":2,"low":0.5,"close":1,"volume":1},'
        '"f.csv":{"Type":"F","Date":20240101,"Time":"00:02","open":1,"high":2,"low":0.5,"close":1,"volume":1}}',
    ]
    msgs = spark.createDataFrame([(str(i), v, 0, i, None) for i, v in enumerate(vals)],
                                 "key string, value string, partition int, offset long, timestamp timestamp")
    out = ig.explode_bars(ig.decode_messages(msgs))
    got = {r.symbol: r for r in out.collect()}
    assert set(got) == {"A", "D", "E", "F"}
    assert got["D"].close is None and got["E"].open is None
    strict = {r.symbol for r in ig.explode_bars(ig.decode_messages(msgs), strict=True).collect()}
    assert strict == {"A", "D"}
    stats = sk.write_stats(out).first()
    assert (stats.accepted, stats.rejected, stats.symbols) == (2, 2, 4)


def test_documents_round_trip_and_latest(spark):
    bars = fx.bars_hourly(spark, SF001)
    docs = ig.documents_wide(bars)
    assert docs.count() == bars.groupBy("symbol").count().agg(F.max("count")).first()[0]
    back = ig.explode_bars(ig.decode_messages(ig.to_messages(docs)))
    assert back.count() == bars.count()
    latest = sk.latest_per_symbol(back)
    assert latest.count() == 5
    want = {r.symbol: r["max(ts)"] for r in bars.groupBy("symbol").agg(F.max("ts")).collect()}
    assert {r.symbol: r.ts for r in latest.collect()} == want


def test_parse_ts_and_conform(spark):
    df = spark.createDataFrame([("2024-01-01T10:11:12",), ("2024-01-01 10:11",), ("garbage",)], "s string")
    got = [r[0] for r in df.select(cl.parse_ts("s")).collect()]
    assert str(got[0]) == "2024-01-01 10:11:12" and str(got[1]) == "2024-01-01 10:11:00" and got[2] is None
    with pytest.raises(ValueError):
        cl.conform(df, ["s", "missing"])
