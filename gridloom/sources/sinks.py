"""Result tables in the form in which users read them, and adding them to a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.store import write_batch


def region_table(df: DataFrame, labels: Sequence[int], names: Sequence[str] | None = None, last_first: bool = False,
                 skip_first: bool = True, subject: str = "vol_id", value: str = "volume") -> DataFrame:
    """One row per subject, one column per structure, sorted by label; background dropped, values to 3 decimals.

    ``last_first`` puts the last column, the total, first. The pivot values are given, so no extra pass finds them.
    """
    order = sorted(range(len(labels)), key=lambda i: labels[i])
    keep = [labels[i] for i in order]
    titles = [names[i] for i in order] if names is not None else [str(v) for v in keep]
    if skip_first:
        keep, titles = keep[1:], titles[1:]
    wide = df.groupBy(subject).pivot("label", [int(v) for v in keep]).agg(F.first(F.bround(value, 3)))
    columns = [F.col(f"`{v}`").alias(t) for v, t in zip(keep, titles)]
    if last_first:
        columns = [columns[-1]] + columns[:-1]
    return wide.select(F.col(subject).alias("subject"), *columns)


def write_region_csv(df: DataFrame, path: str, labels: Sequence[int], batch: str | None = None, recompute: bool = False,
                     **options) -> bool:
    """Add the subjects of ``df`` to the CSV table ``regions`` of a store; whether there were new ones."""
    table = region_table(df, labels, **options)
    return write_batch({"regions": table}, path, batch, key="subject", recompute=recompute, formats={"regions": "csv"})


def write_score_matrix(scores: DataFrame, path: str, batch: str | None = None, recompute: bool = False) -> bool:
    """Add long scores (vol_id, label, metric, value) to the table ``scores`` of a store, one folder per batch and metric."""
    return write_batch({"scores": scores}, path, batch, recompute=recompute, partition_by={"scores": ["metric"]})


def score_matrix(scores: DataFrame, labels: Sequence[int], metric: str = "dice") -> DataFrame:
    """Wide form of one metric: a row per subject, however many there are, and a column per listed label."""
    return (scores.where(F.col("metric") == metric).groupBy("vol_id").pivot("label", [int(v) for v in labels])
            .agg(F.first("value")))


def typed_voxels(df: DataFrame, dtype: str = "int", value: str = "value") -> DataFrame:
    """Cast voxel values; integers are rounded half to even first."""
    integral = dtype in ("tinyint", "smallint", "int", "bigint")
    return df.withColumn(value, (F.bround(value) if integral else F.col(value)).cast(dtype))


def write_voxels(df: DataFrame, meta: DataFrame | None, path: str, dtype: str = "int", value: str = "value",
                 batch: str | None = None, recompute: bool = False) -> bool:
    """Add volumes to the tables ``voxels`` (by batch and dataset) and ``meta`` of a store.

    With ``meta`` its volumes are the ones that the run covers, so that a volume without voxels is finished, too.
    """
    tables = {"voxels": typed_voxels(df, dtype, value)}
    if meta is not None:
        tables["meta"] = meta
    by = {"voxels": ["dataset"] if "dataset" in df.columns else []}
    volumes = meta.select("vol_id") if meta is not None else None
    return write_batch(tables, path, batch, volumes, recompute=recompute, partition_by=by)
