"""Keyed count window on Spark's own state (K2, K3, K7): the newest bars of every symbol.

``transformWithStateInPandas`` keeps, per symbol, the number of rows seen and
the last ``keep`` rows in arrival order.  For the symbols of a micro-batch it
returns these rows and the new ones, all numbered by arrival, with flags that
say which are new and which were released before; a count window of the batch
is then a row frame over that number, so the batch operators run on it as they
are.  State lives in the checkpoint (RocksDB): a restart goes on from it, and
a checkpoint that lost it fails to start instead of beginning anew.

Arrival is the broker's time, then partition and offset, whatever the bar's own
time: a late bar takes the next number and the windows run over numbers, as in
a history to which rows are appended as they come.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_ROWS = 118          # 59 rows for the indicator frames + 59 for the signal frames
BAR_FIELDS = [("ts", T.TimestampNTZType()), *[(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
              ("date", T.StringType()), ("time", T.StringType()), ("partition", T.IntegerType()), ("offset", T.LongType()),
              ("source_ts", T.TimestampNTZType())]
ARRIVAL = ["source_ts", "partition", "offset"]
STATE = T.StructType([T.StructField(n, t) for n, t in BAR_FIELDS] + [T.StructField("rn", T.LongType())])
OUTPUT = T.StructType([T.StructField("symbol", T.StringType()), *STATE.fields, T.StructField("is_new", T.BooleanType()),
                       T.StructField("released", T.BooleanType())])
COUNT = T.StructType([T.StructField("rows", T.LongType()), T.StructField("warm", T.BooleanType())])


class BarHistory(StatefulProcessor):
    """Count, last ``keep`` rows and whether the warm-up gate has opened, per symbol."""

    def __init__(self, keep: int = KEEP_ROWS, warmup: int = 60, first: int = 35):
        self.keep, self.warmup, self.first = keep, warmup, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", COUNT)
        self.last = handle.getListState("last", STATE)

    def handleInputRows(self, key, rows, timerValues):
        names = STATE.fieldNames()
        n, warm = self.seen.get() if self.seen.exists() else (0, False)
        kept = pd.DataFrame(list(self.last.get()) if n else [], columns=names)
        new = pd.concat(list(rows)).sort_values(ARRIVAL, kind="mergesort", na_position="first")
        new["rn"] = range(n + 1, n + len(new) + 1)
        new = new[names]
        both = pd.concat([kept, new], ignore_index=True) if len(kept) else new.reset_index(drop=True)
        total = n + len(new)
        both = both.astype({"rn": "int64"})
        out = both.assign(symbol=key[0], is_new=both["rn"] > n, released=(both["rn"] <= n) & warm & (both["rn"] >= self.first))
        self.seen.update((total, bool(warm or total >= self.warmup)))
        tail = both.iloc[-self.keep:].astype(object)
        self.last.put([tuple(None if pd.isna(v) else v for v in r) for r in tail.itertuples(index=False, name=None)])
        yield out[OUTPUT.fieldNames()]

    def close(self) -> None:
        pass


def with_history(bars: DataFrame, keep: int = KEEP_ROWS, warmup: int = 60, first: int = 35) -> DataFrame:
    """The stream of OUTPUT rows for a stream of bars (``symbol`` and BAR_FIELDS).

    A batch holds, of each of its symbols, at most ``keep`` rows and its new
    ones; the new rows of one symbol and batch are sorted in one task, so the
    source's limit per trigger bounds that task.
    """
    spark = bars.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)   # the operator runs on no other
    rows = bars.select("symbol", *[bars[n].cast(t).alias(n) for n, t in BAR_FIELDS])
    return rows.groupBy("symbol").transformWithStateInPandas(
        BarHistory(keep, warmup, first), outputStructType=OUTPUT, outputMode="append", timeMode="none")
