"""Writing tables (I1, I3, I6, M-series outputs).

- ``ensure_table``: create an empty table with its schema if absent (I6).
- ``write_table``: write a merged snapshot; season-partitioned tables use
  dynamic partition overwrite, so re-importing a season rewrites only it.
- ``append``: plain append (I1, I2, I3).
- ``materialize``: write to the cluster's shared checkpoint folder and read
  back, cutting the lineage of long jobs (never a machine-local folder).

A merge result must be written to a path other than the one it reads from:
Spark reads lazily, so overwriting the input in place would read a half
written table. Callers pass a new snapshot path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rosterlake.schemas import PARTITION_BY, schema_of
from rosterlake.session import ensure_checkpoint_dir, is_classic


def _exists(spark: SparkSession, path: str) -> bool:
    if is_classic(spark):
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)
    try:  # Spark Connect: no JVM handle on the client
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except Exception:  # noqa: BLE001
        return False


def ensure_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Create ``name`` at ``path`` empty if it does not exist, then read it."""
    if not _exists(spark, path):
        empty = spark.createDataFrame([], schema_of(name))
        writer = empty.write.mode("errorifexists")
        if name in PARTITION_BY:
            writer = writer.partitionBy(*PARTITION_BY[name])
        writer.parquet(path)
    return spark.read.schema(schema_of(name)).parquet(path)


def write_table(df: DataFrame, name: str, path: str) -> None:
    """Write a table snapshot; partitioned tables overwrite only touched partitions."""
    writer = df.write.mode("overwrite")
    if name in PARTITION_BY:
        writer = writer.partitionBy(*PARTITION_BY[name]).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def append(df: DataFrame, path: str, name: str | None = None) -> None:
    writer = df.write.mode("append")
    if name in PARTITION_BY:
        writer = writer.partitionBy(*PARTITION_BY[name])
    writer.parquet(path)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
