"""Clean-up of soft label probabilities: rows (vol_id, x, y, z, label, p), absent rows are p = 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.layout import by_sort
from gridloom.operators.labels import literal_map
from gridloom.operators.lines import attach_shape
from gridloom.operators.morphology import largest_component
from gridloom.operators.neighbourhood import gaussian_blur

VOXEL = ["vol_id", "x", "y", "z"]


def keep_biggest(df: DataFrame, background: int = 0, threshold: float = 0.25) -> DataFrame:
    """Zero (drop) non-background probabilities outside the largest region where their sum exceeds the threshold.

    A volume without such a region keeps nothing but background.
    """
    fg = df.where(F.col("label") != background).groupBy(*VOXEL).agg(F.sum("p").alias("_s"))
    region = largest_component(fg.where(F.col("_s") > threshold).select(*VOXEL))
    kept = df.where(F.col("label") != background).join(by_sort(region), VOXEL, "left_semi")
    return kept.unionByName(df.where(F.col("label") == background).select(*kept.columns))


def keep_biggest_per_class(df: DataFrame, classes: dict[int, int], threshold: float = 0.25) -> DataFrame:
    """For every topology class but the first: zero the labels of the class outside the largest region where any of
    them exceeds the threshold. All classes of all volumes go through one component job."""
    first = min(classes.values())
    tagged = df.withColumn("_class", literal_map(list(classes), list(classes.values()))[F.col("label")])
    free = tagged.where(F.coalesce(F.col("_class"), F.lit(first)) == first).drop("_class")
    bound = tagged.where(F.col("_class") != first)
    keys = ["vol_id", "_class"]
    region = largest_component(bound.where(F.col("p") > threshold).select(*keys, "x", "y", "z").distinct(), keys=keys)
    return free.unionByName(bound.join(by_sort(region), [*keys, "x", "y", "z"], "left_semi").select(*free.columns))


def drop_low(df: DataFrame, background: int = 0, threshold: float = 0.2) -> DataFrame:
    return df.where((F.col("label") == background) | (F.col("p") > threshold))


def normalise(df: DataFrame, p: str = "p") -> DataFrame:
    """Divide by the sum over labels of a voxel (the group is one voxel). A voxel without any mass stays 0."""
    total = F.sum(p).over(Window.partitionBy(*VOXEL))
    return df.withColumn(p, F.when(total != 0, F.col(p) / total).otherwise(0.0))


def argmax_label(df: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    """Label of the largest p per voxel; ties go to the first label in channel order (ascending without a list)."""
    order = F.col("label") if labels is None else literal_map(list(labels), list(range(len(labels))))[F.col("label")]
    best = F.max(F.struct(F.col("p"), (-order).alias("o"), F.col("label")))
    return df.groupBy(*VOXEL).agg(best["label"].alias("label"))


def replace_background(df: DataFrame, inside: DataFrame, all_voxels: DataFrame, background: int = 0) -> DataFrame:
    """Background p := 0 on the voxels of ``inside`` and := 1 on the other voxels of ``all_voxels``."""
    outside = all_voxels.select(*VOXEL).join(by_sort(inside.select(*VOXEL)), VOXEL, "left_anti")
    return (df.where(F.col("label") != background).select(*VOXEL, "label", "p")
            .unionByName(outside.select(*VOXEL, F.lit(background).alias("label"), F.lit(1.0).alias("p"))))


def strict_group_mask(df: DataFrame, mask: DataFrame, background: int = 0) -> DataFrame:
    """Background 1 outside the mask and 0 inside, then renormalised."""
    voxels = df.select(*VOXEL).distinct()
    return normalise(replace_background(df, mask, voxels, background))


def merge_parcellation(seg: DataFrame, parcels: DataFrame, cortex: Sequence[int] = (3, 42),
                       background: int = 0) -> tuple[DataFrame, DataFrame]:
    """Split the cortex of ``seg`` (vol_id, x, y, z, label) by parcel probabilities: (label map, parcel posteriors)."""
    ribbon = seg.where(F.col("label").isin(list(cortex))).select(*VOXEL)
    soft = normalise(replace_background(parcels, ribbon, seg, background))
    hard = argmax_label(soft).withColumnRenamed("label", "_parcel")
    in_ribbon = F.col("label").isin(list(cortex))
    out = seg.join(by_sort(hard), VOXEL, "left")
    merged = out.select(*VOXEL, F.when(in_ribbon, F.coalesce("_parcel", F.lit(background)))
                        .otherwise(F.col("label")).cast("int").alias("label"))
    return merged, soft


def flip_average(df: DataFrame, flipped: DataFrame, nx, swap: dict[int, int]) -> DataFrame:
    """Average of the direct posteriors and those of the mirrored image, mirrored back with left and right swapped.

    One aggregate over the union replaces a full outer join.
    """
    width = nx if isinstance(nx, Column) else F.lit(int(nx))
    back = flipped.select("vol_id", (width - 1 - F.col("x")).alias("x"), "y", "z",
                          F.coalesce(literal_map(list(swap), list(swap.values()))[F.col("label")], F.col("label"))
                          .alias("label"), "p")
    both = df.select(*VOXEL, "label", "p").unionByName(back)
    return both.groupBy(*VOXEL, "label").agg((0.5 * F.sum("p")).alias("p"))


def soft_sums(df: DataFrame, meta: DataFrame | None = None, background: int = 0) -> DataFrame:
    """Sum of p per non-background label times the voxel volume."""
    sums = df.where(F.col("label") != background).groupBy("vol_id", "label").agg(F.sum("p").alias("volume"))
    return _sized(sums, meta)


def soft_volumes(df: DataFrame, meta: DataFrame | None = None, background: int = 0) -> DataFrame:
    """The same to 3 decimals."""
    return tidy(soft_sums(df, meta, background))


def tidy(volumes: DataFrame) -> DataFrame:
    """Volumes to 3 decimals. The noise of a distributed sum is rounded off first, so that a half stays a half in
    whatever order partial sums arrive."""
    return volumes.withColumn("volume", F.bround(F.round("volume", 9), 3))


def _sized(sums: DataFrame, meta: DataFrame | None) -> DataFrame:
    if meta is None:
        return sums
    size = meta.select("vol_id", (F.col("rx") * F.col("ry") * F.col("rz")).alias("_vv"))
    return sums.join(size, "vol_id").withColumn("volume", F.col("volume") * F.col("_vv")).drop("_vv")


def total_intracranial(df: DataFrame, meta: DataFrame | None = None, background: int = 0,
                       total_label: int | None = None) -> DataFrame:
    """Soft volumes with the total of each volume as one more row: label NULL, or ``total_label``.

    Per-label sums come first, so the total adds a handful of rows per volume.
    """
    per_label = (df.where(F.col("label") != background)
                 .groupBy("vol_id", "label").agg(F.sum("p").alias("_s")))
    rows = per_label.rollup("vol_id", "label").agg(F.sum("_s").alias("volume")).where("vol_id IS NOT NULL")
    if total_label is not None:
        rows = rows.withColumn("label", F.coalesce("label", F.lit(total_label)))
    return tidy(_sized(rows, meta))


def rescale_parcels(parcels: DataFrame, volumes: DataFrame, cortex: Sequence[int] = (3, 42)) -> DataFrame:
    """Scale parcel volumes (vol_id, label, volume) so that they add up to the cortical volume."""
    target = (volumes.where(F.col("label").isin(list(cortex)))
              .groupBy("vol_id").agg(F.sum("volume").alias("_t")))
    total = parcels.groupBy("vol_id").agg(F.sum("volume").alias("_p"))
    return (parcels.join(target.join(total, "vol_id"), "vol_id")
            .select("vol_id", "label", F.when(F.col("_p") != 0, F.col("volume") / F.col("_p") * F.col("_t"))
                    .otherwise(0.0).alias("volume")))


def smooth_posteriors(df: DataFrame, shape, sigma: float = 0.5) -> DataFrame:
    """Gaussian smoothing of each label's map with zeros beyond the grid. Only non-zero results are kept."""
    return gaussian_blur(df, sigma, shape, "p", "zero", keys=["vol_id", "label"]).where("p <> 0")


def qc_relabel(df: DataFrame, labels: Sequence[int], qc_labels: Sequence[int]) -> DataFrame:
    """Hard labels mapped to QC groups, as sparse one-hot rows (label = QC group, p = 1)."""
    hard = argmax_label(df, labels)
    group = F.coalesce(literal_map(list(labels), list(qc_labels))[F.col("label")], F.lit(0))
    return hard.select(*VOXEL, group.alias("label"), F.lit(1.0).alias("p"))


def harden(df: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    """Posteriors to one-hot rows of the most likely label."""
    return argmax_label(df, labels).withColumn("p", F.lit(1.0))
