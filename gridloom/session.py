"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gridloom") -> SparkSession:
    """Local session for tests and benchmarks. A cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Packed lines are few bytes with much work each: do not squeeze them into fewer tasks than cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop)
    a temporary folder is made and remembered in the session. A cluster without that setting is an error: its
    machines would not see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gridloom.scratch", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.gridloom.scratch", root)
    return root


_open_jobs: list[list[str]] = []


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the intermediate tables written inside it.

    Results are lazy and read those tables: write or collect them inside. Without it the tables stay in the shared folder.
    """
    made: list[str] = []
    _open_jobs.append(made)
    try:
        yield
    finally:
        _open_jobs.remove(made)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage of iterative jobs, survives the loss of executors, and (unlike a reliable
    ``checkpoint()``) evaluates the plan only once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    if _open_jobs:
        _open_jobs[-1].append(path)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
