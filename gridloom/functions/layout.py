"""Joining voxels with facts of their volume without gathering a volume in one task.

Voxels belong to slabs of x planes. A table of one row per volume is repeated for every slab and joined by (vol_id, slab), so
that shuffled voxels of one volume go to as many tasks as it has slabs. Tables written by ``write_slabs`` are bucketed by
that pair: their voxels stay where they are, through any number of such joins, as the slab a voxel was stored under
travels with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x planes in a slab, and slabs of a volume; beyond that many, slabs share a number.
WIDTH, SLABS = 16, 16
SLAB = "_slab"


def with_slab(df: DataFrame) -> DataFrame:
    """Voxels with their slab; one that is there already is kept, also where x has changed since."""
    return df if SLAB in df.columns else df.withColumn(SLAB, F.expr(f"CAST(pmod(x DIV {WIDTH}, {SLABS}) AS INT)"))


def by_sort(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that both sides sort for, never broadcast.

    Spark sees neither how many rows an exploded list makes nor how far equal values shrink in a file, so a table that
    grows with the volumes may look small enough to be gathered in the driver and copied to every executor.
    """
    return df.hint("merge")


def by_volume(df: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Voxels beside the row of ``facts`` of their vol_id; ``how`` as in a join. Columns: those of both, and the slab."""
    repeated = facts.withColumn(SLAB, F.explode(F.sequence(F.lit(0), F.lit(SLABS - 1))))
    return with_slab(df).join(by_sort(repeated), ["vol_id", SLAB], how)


def write_slabs(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store voxels as a table bucketed by (vol_id, slab), in ``path`` if given; as many ``buckets`` as tasks are wanted."""
    writer = (with_slab(df).repartition(buckets, "vol_id", SLAB).write.mode("overwrite").format("parquet")
              .bucketBy(buckets, "vol_id", SLAB))
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
