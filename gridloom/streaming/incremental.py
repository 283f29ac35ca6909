"""Skip-existing over a growing folder, as a stream that runs once per call.

A file source remembers in its checkpoint which files it has read. With the available-now trigger a call handles the
files that are new since the last call and stops: the same meaning as listing the folder and skipping finished items.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.cohort import cohort_report
from gridloom.sources.ingest import write_images
from gridloom.sources.store import pending, write_batch

MANIFEST = "path string, length bigint"


def run_new(spark: SparkSession, source: str, checkpoint: str, handle: Callable[[DataFrame, int], None],
            schema: str = MANIFEST, fmt: str = "parquet", files_per_batch: int = 1000) -> None:
    """Pass every not yet processed item of ``source`` to ``handle(batch, batch_id)`` and stop.

    ``handle`` should overwrite by batch id, so that a batch repeated after a failure gives the same result.
    """
    stream = (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(source))
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_new_volumes(spark: SparkSession, folder: str, checkpoint: str, out: str, glob: str = "*.{nii.gz,nii,mgz,npz}") -> None:
    """Add the image files that arrived since the last call to the store ``out``, one batch of it per batch of files."""
    stream = (spark.readStream.format("binaryFile").option("pathGlobFilter", glob)
              .schema("path string, modificationTime timestamp, length bigint, content binary").load(folder))
    query = (stream.writeStream.foreachBatch(lambda files, i: write_images(files.select("path", "content"), out, f"{i:010d}"))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def write_report(todo: DataFrame, given: dict[str, DataFrame], out: str, batch: str, labels: Sequence[int], **options) -> bool:
    """Add the report on the volumes of ``todo`` that the store ``out`` does not have yet: tables seg, posteriors,
    volumes, errors, and qc and scores if ``given`` has qc_scores and gt beside posteriors and meta."""
    spark = todo.sparkSession
    todo = pending(spark, out, todo)
    if todo.isEmpty():
        return False
    none = spark.createDataFrame([], "path string")
    tables = cohort_report(todo, none, given["posteriors"], given["meta"], labels, given.get("qc_scores"), given.get("gt"),
                           recompute=True, **options)
    tables = {"volumes": tables["volumes"], **tables}
    reported = todo.select("vol_id").distinct().join(tables["errors"].select("vol_id"), "vol_id", "left_anti")
    return write_batch(tables, out, batch, reported)


def run_new_reports(spark: SparkSession, source: str, checkpoint: str, out: str, load: Callable[[DataFrame], dict[str, DataFrame]],
                    labels: Sequence[int], schema: str = "vol_id bigint, path string", files_per_batch: int = 1000, **options) -> None:
    """Report on the volumes whose manifest rows arrived in the Parquet folder ``source`` since the last call.

    ``load(volumes)`` gives the tables for ``write_report``; its rows of other volumes are left out. Each batch of
    the stream is one of the store, so a batch that is replayed after a failure changes nothing.
    """
    def handle(arrived: DataFrame, batch_id: int) -> None:
        todo = arrived.dropDuplicates(["vol_id"])
        given = {k: d.join(todo.select("vol_id"), "vol_id", "left_semi") for k, d in load(todo).items()}
        write_report(todo, given, out, f"{batch_id:010d}", labels, **options)

    run_new(spark, source, checkpoint, handle, schema, files_per_batch=files_per_batch)
