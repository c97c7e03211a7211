"""Session helpers: a local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _driver_memory(cap_gb: int = 16) -> str:
    """Heap for a local session: 60% of physical memory, at most ``cap_gb``."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    except (ValueError, OSError, AttributeError):
        return f"{cap_gb}g"
    return f"{max(1, min(cap_gb, int(total * 0.6)))}g"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pairlab") -> SparkSession:
    """Local session with the settings the library is tuned for.

    On a cluster, build the session from the cluster's own configuration
    instead; only the AQE flags below matter to the library's plans.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", _driver_memory())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir; set a scratch one only if unset.

    Clusters name a shared folder in ``spark.checkpoint.dir``; it is never
    overridden here.  Only a local-mode session without one gets a fresh temp
    folder (tests); a cluster session without one is an error, since a
    machine-local folder would not survive the loss of that machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's own setting applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder "
                           "(all executors must see it) before running this job")
    path = tempfile.mkdtemp(prefix="pairlab-ckpt-")
    sc.setCheckpointDir(path)
    return path


#: Session setting: where saved tables go while a ``scratch_scope`` is open.
SCRATCH_DIR = "pairlab.scratch.dir"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Saved tables of a job lie in a folder of their own, which goes when the scope ends.

    The folder is made under the checkpoint dir.  DataFrames made inside read
    these tables, so write or collect them before the end.  Scopes may be
    nested; each removes its own folder only, also when the job fails.
    """
    before = spark.conf.get(SCRATCH_DIR, None)
    path = f"{before or ensure_checkpoint_dir(spark)}/scope-{uuid.uuid4().hex}"
    spark.conf.set(SCRATCH_DIR, path)
    try:
        yield path
    finally:
        if before:
            spark.conf.set(SCRATCH_DIR, before)
        else:
            spark.conf.unset(SCRATCH_DIR)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table under the checkpoint dir (or in the
    open ``scratch_scope``) and read back: its lineage ends there, and later
    branches read only their columns."""
    spark = df.sparkSession
    path = f"{spark.conf.get(SCRATCH_DIR, None) or ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
