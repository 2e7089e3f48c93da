"""Spark session helpers.

Cluster jobs get their session from the platform; we only read settings from
it.  ``local_session`` is for tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "labelflow") -> SparkSession:
    """A local session tuned like the cluster defaults (AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LABELFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the platform sets it to a shared file system; only when it is
    unset (local tests) do we create one.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        path = jdir.get()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="labelflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not jdir.isDefined():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "labelflow", f"{name}-{uuid.uuid4().hex[:12]}")


def reuse(df: DataFrame) -> DataFrame:
    """Keep an intermediate that several branches of one plan read (memory,
    spilling to disk); lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage: the rows are written to the
    shared checkpoint folder (``spark.checkpoint.dir``), so later plans start
    from a scan instead of re-planning and re-running the whole history, and a
    lost executor does not force recomputation from the sources."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    lineage is cut, and joins see the real size of the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
