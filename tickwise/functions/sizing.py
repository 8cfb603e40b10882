"""Size-checked broadcast: broadcast a side only when its measured row count is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Return ``(df or broadcast(df), used_broadcast)``.

    ``df`` should already be materialised (checkpointed) since this counts it.
    Beyond the bound the caller gets a plain frame and Spark plans a shuffle
    join (AQE may still convert it at run time from real sizes).
    """
    n = df.count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False
