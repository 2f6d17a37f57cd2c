"""Broadcasts with a stated size bound.

Every explicit broadcast in the library goes through ``broadcast_bounded``,
which names the bound that makes it safe (a schema-fixed dimension, the role
domain, the file list, the partition count) and checks it while the query runs. Everything else is left to
Spark's own size-checked choice (``autoBroadcastJoinThreshold`` + AQE runtime
statistics), which falls back to a shuffle join when a side is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed bounds used by the library (rows).
NATION_ROWS = 25        # TPC-H nation dimension, fixed by the schema
ROLE_ROWS = 5           # the four roles + NULL (CHECK ruolo IN ('P','D','C','A'))


def broadcast_bounded(df: DataFrame, bound: int, why: str) -> DataFrame:
    """Broadcast ``df``, whose row count is at most ``bound`` because ``why``.

    The query fails if there are more rows: at most ``bound`` + 1 of them are
    gathered into one array, whose size is checked before anything is sent. The
    result's columns are new ones: refer to them through the returned DataFrame."""
    rows = df.limit(bound + 1).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    message = F.lit(f"more than {bound} rows to broadcast ({why})")
    checked = F.when(F.size("rows") <= bound, F.col("rows")).otherwise(F.raise_error(message))
    return F.broadcast(rows.select(F.inline(checked)))
