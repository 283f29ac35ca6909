"""Result tables that grow run by run.

A store is a folder with ``data/<table>/batch=<batch>/...``, ``finished/batch=<batch>`` (the volumes of a batch) and
``commits/batch=<batch>`` (one row, written last by one task). Readers go by the commits alone: what a killed run has left
is not seen, and the next run of that batch replaces it. A batch that is committed already is not written again, and
volumes that are finished are left out of later batches, so repeating a run changes nothing; ``recompute`` writes them
anew, and readers then take each volume from its latest batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

_COMMIT = StructType([StructField("at", TimestampType()), StructField("tables", StringType()), StructField("batch", StringType())])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, in whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _replace_batch(df: DataFrame, path: str, batch: str, by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Write one batch's partition and leave the others; an earlier try of the same batch is replaced as a whole."""
    (df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("header", True).partitionBy("batch", *by).format(fmt).save(path))


def _remove_batch(spark: SparkSession, path: str, batch: str) -> None:
    """What an earlier try may have left in partitions that this one has no rows for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(at, tables, batch): one row per committed batch."""
    place = f"{path}/commits"
    return spark.read.schema(_COMMIT).parquet(place) if exists(spark, place) else spark.createDataFrame([], _COMMIT)


def _runs(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """(key, at, batch) of every committed run of every volume."""
    if not exists(spark, f"{path}/finished"):
        return None
    done = spark.read.parquet(f"{path}/finished")
    done = spark.read.schema(_with_batch(done.drop("batch").schema)).parquet(f"{path}/finished")
    return done.join(commits(spark, path).select("batch", "at"), "batch").select(key, "at", "batch")


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("batch", StringType())])


def finished(spark: SparkSession, path: str, key: str = "vol_id") -> DataFrame | None:
    """(key, at, batch): each finished volume with its latest batch; None if the store has none."""
    runs = _runs(spark, path, key)
    if runs is None:
        return None
    return runs.groupBy(key).agg(F.max(F.struct("at", "batch")).alias("_last")).select(key, "_last.*")


def pending(spark: SparkSession, path: str, volumes: DataFrame, key: str = "vol_id") -> DataFrame:
    """Rows of ``volumes`` whose volume is not finished in the store."""
    done = finished(spark, path, key)
    return volumes if done is None else volumes.join(done.select(key), key, "left_anti")


def write_batch(tables: dict[str, DataFrame], path: str, batch: str | None = None,
                volumes: DataFrame | Callable[[], DataFrame] | None = None, *, recompute: bool = False, key: str = "vol_id",
                partition_by: dict[str, Sequence[str]] | None = None, formats: dict[str, str] | None = None,
                before_commit: Callable[[], None] | None = None) -> bool:
    """Add the tables of one run to the store; whether anything was written.

    ``batch`` names the run; without a name it gets a new one. ``volumes`` are the volumes that the run covers, those of
    the first table by default, also such without rows; as a function it is asked once the tables are written. All
    tables must have the column ``key`` and none called batch. ``before_commit`` is called when the tables are written;
    if it raises, the run leaves nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    batch = batch or uuid.uuid4().hex
    if "=" in batch or "/" in batch:
        raise ValueError(f"a batch is a folder's name, had {batch}")
    if any("batch" in df.columns for df in tables.values()):
        raise ValueError("a table of a store must not have a column called batch")
    log = commits(spark, path).where(F.col("batch") == batch)
    if not log.isEmpty():
        return False
    done = None if recompute else finished(spark, path, key)
    if volumes is None:
        volumes = next(iter(tables.values())).select(key).distinct()
    again = None
    if done is not None and isinstance(volumes, DataFrame):
        again = volumes.join(done.select(key), key, "left_semi").select(key).distinct()
        if again.isEmpty():
            again = None
        else:
            volumes = volumes.join(done.select(key), key, "left_anti")
            if volumes.isEmpty():
                return False
    described = {}
    for name, df in tables.items():
        fmt, by = (formats or {}).get(name, "parquet"), list((partition_by or {}).get(name, ()))
        place = f"{path}/data/{name}"
        if again is not None:
            df = df.join(again, key, "left_anti")
        _remove_batch(spark, place, batch)
        _replace_batch(df, place, batch, by, fmt)
        described[name] = {"format": fmt, "by": by, "schema": df.schema.jsonValue()}
    if before_commit is not None:
        before_commit()
    covered = volumes() if callable(volumes) else volumes
    _replace_batch(covered.select(key).distinct(), f"{path}/finished", batch)
    commit = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(json.dumps(described)).alias("tables"))
    _replace_batch(commit.coalesce(1), f"{path}/commits", batch)
    return True


def read_table(spark: SparkSession, path: str, name: str, key: str = "vol_id") -> DataFrame:
    """All rows of a table: of committed batches, each volume from its latest one, without the column batch."""
    log = [(r.at, r.batch, json.loads(r.tables)) for r in commits(spark, path).collect()]
    known = [t[name] for _, _, t in sorted(log, key=lambda r: r[:2]) if name in t]
    if not known:
        raise ValueError(f"no finished run has written a table {name} to {path}")
    schema = StructType.fromJson(known[-1]["schema"])
    place = f"{path}/data/{name}"
    batches = [b for _, b, t in log if name in t]
    if not exists(spark, place):
        return spark.createDataFrame([], schema)
    stored = StructType([f for f in schema.fields if f.name not in known[-1]["by"]])
    parts = StructType([f for f in schema.fields if f.name in known[-1]["by"]])
    full = StructType([*stored.fields, StructField("batch", StringType()), *parts.fields])
    rows = spark.read.format(known[-1]["format"]).option("header", True).schema(full).load(place)
    rows = rows.where(F.col("batch").isin(batches))  # a pruned list of folders: one name per run
    runs = _runs(spark, path, key)
    last = finished(spark, path, key).withColumnRenamed("batch", "_last").drop("at")
    stale = runs.join(last, key).where("batch <> _last").select(key, "batch").distinct()
    return rows.join(stale, [key, "batch"], "left_anti").select(*schema.names)
