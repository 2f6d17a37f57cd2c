"""Session helpers.

The library never creates a global session: every operator takes DataFrames.
``get_session`` is for tests, the bench and scripts. On a cluster the session
comes from the launcher and only the missing settings are filled in.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are tuned for. Applied only when the key is unset, so a
# cluster's own values (shuffle partitions sized for the data, checkpoint dir on
# shared storage) always win.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rosterlake") -> SparkSession:
    """Build (or reuse) a session for local runs and tests."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.driver.memory", os.environ.get("ROSTERLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_classic(spark: SparkSession) -> bool:
    """True for a classic session (with a SparkContext), False for Spark Connect."""
    try:
        spark.sparkContext  # noqa: B018 - raises on Spark Connect
        return True
    except Exception:  # noqa: BLE001
        return False


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as is.
    A local scratch folder is only ever made for local runs (tests, bench).
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not is_classic(spark):
        if not current:
            raise RuntimeError("set spark.checkpoint.dir on the Spark Connect server")
        return current
    if not current:
        current = spark.sparkContext.getCheckpointDir() or None
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="rosterlake-ckpt-")   # one process: tests and the bench
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rosterlake`` importable by the Python workers (the equivalent of
    ``--py-files``): operators with Python code in tasks (``mapInPandas``,
    ``applyInPandas*``) call this once per SparkContext. A cluster that already
    ships the package (wheel, ``--py-files``) is unaffected."""
    classic = is_classic(spark)
    key = id(spark.sparkContext) if classic else id(spark)
    if key in _SHIPPED:
        return
    import zipfile
    from pathlib import Path

    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="rosterlake-pkg-")) / "rosterlake.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in pkg.rglob("*.py"):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    if classic:
        spark.sparkContext.addPyFile(str(out))
    else:
        spark.addArtifacts(str(out), pyfile=True)
    _SHIPPED.add(key)
