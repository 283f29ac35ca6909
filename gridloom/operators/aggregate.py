"""Region volumes, atlases, intensity statistics and dataset checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numbers import ras_axes
from gridloom.functions.layout import by_sort
from gridloom.functions.order import exact_percentiles
from gridloom.operators.geometry import align_plan
from gridloom.operators.intensity import rescale
from gridloom.operators.lines import attach_shape
from gridloom.operators.labels import check_classes, correct_labels, group_classes, literal_map
from gridloom.session import materialize

VOXEL = ["vol_id", "x", "y", "z"]
MAD_SCALE = 1.4826


def _listed(volumes: DataFrame, values: Sequence[int], name: str) -> DataFrame:
    """Every volume with every listed value: an explode, not a join."""
    return volumes.select("*", F.explode(F.array(*[F.lit(int(v)) for v in values])).alias(name))


def hard_volumes(df: DataFrame, labels: Sequence[int] | None = None, voxel_volume: float = 1.0,
                 skip_background: bool = True, label: str = "label", volumes: DataFrame | None = None) -> DataFrame:
    """Voxel count per volume and label times the voxel volume. Listed labels that are absent give 0; the first listed
    label (0 without a list) is the background. ``volumes`` (vol_id) names all volumes, so that those without a single
    voxel row get their zeros as well."""
    counts = df.groupBy("vol_id", F.col(label).alias("label")).agg(F.count("*").alias("_n"))
    if labels is None:
        rows = counts.where("label <> 0") if skip_background else counts
    else:
        wanted = list(labels)[1:] if skip_background else list(labels)
        every = (counts if volumes is None else volumes).select("vol_id").distinct()
        rows = _listed(every, wanted, "label").join(counts, ["vol_id", "label"], "left")
    return rows.select("vol_id", "label", (F.coalesce("_n", F.lit(0)) * float(voxel_volume)).alias("volume"))


def hard_volumes_dataset(df: DataFrame, meta: DataFrame, labels: Sequence[int] | None = None,
                         skip_background: bool = True, label: str = "label") -> DataFrame:
    """The same for a dataset, each volume with its own voxel volume, to 3 decimals."""
    vols = hard_volumes(df, labels, 1.0, skip_background, label, meta)
    size = meta.select("vol_id", (F.col("rx") * F.col("ry") * F.col("rz")).alias("_vv"))
    return vols.join(size, "vol_id").select("vol_id", "label", F.bround(F.col("volume") * F.col("_vv"), 3).alias("volume"))


# Labels merged or removed before an atlas is built.
ATLAS_WRONG = [31, 63, 72]
ATLAS_RIGHT = [4, 43, 0]


def build_atlas(df: DataFrame, labels: Sequence[int], shape, new_shape: Sequence[int] | None = None,
                centre: bool = False, margin: int = 15, n_maps: int | None = None, label: str = "label") -> DataFrame:
    """Probability of each label per cell over all maps: x, y, z, label, p (only p > 0).

    With ``centre`` every map is first shifted by its truncated foreground centroid and cut to +-margin. Background 0 is
    listed only where ``df`` lists it. A map enters the denominator if it has any row. ``shape``: a tuple for all maps, or
    a table (vol_id, nx, ny, nz); each map is centred in ``new_shape`` by its own.
    """
    fixed = correct_labels(df, ATLAS_WRONG, ATLAS_RIGHT, label)
    fixed = fixed.withColumn("_ord", F.coalesce(
        literal_map([int(v) for v in labels], list(range(len(labels))))[F.col(label)], F.lit(0)))
    if new_shape is not None:
        columns = fixed.columns
        fixed, dims = attach_shape(fixed, shape)
        for i, a in enumerate("xyz"):
            n, new = F.lit(int(dims[i])) if dims else F.col(f"n{a}"), int(new_shape[i])
            # Half of what is missing before, or half of what is too much away.
            shift = F.when(n <= new, F.floor((new - n) / 2)).otherwise(-F.floor((n - new) / 2)).cast("int")
            fixed = fixed.withColumn(a, F.col(a) + shift).where((F.col(a) >= 0) & (F.col(a) < new))
        fixed = fixed.select(*columns)
    if centre:
        middle = (fixed.where("_ord > 0").groupBy("vol_id")
                  .agg(*[F.avg(a).cast("int").alias(f"_c{a}") for a in "xyz"]))
        fixed = fixed.join(middle, "vol_id")
        for a in "xyz":
            fixed = (fixed.withColumn(a, F.col(a) - F.col(f"_c{a}") + margin)
                     .where((F.col(a) >= 0) & (F.col(a) < 2 * margin)))
    total = F.lit(n_maps) if n_maps is not None else df.agg(F.count_distinct("vol_id")).scalar()
    back = F.element_at(F.array(*[F.lit(int(v)) for v in labels]), F.col("_ord") + 1)
    return (fixed.groupBy("x", "y", "z", "_ord").agg(F.count("*").alias("_n"))
            .select("x", "y", "z", back.alias("label"), (F.col("_n") / total).alias("p")))


def intensity_stats(df: DataFrame, labels: Sequence[int], classes: Sequence[int] | None = None,
                    positive: bool = True, keys: Sequence[str] = ("vol_id",), scale: float = MAD_SCALE,
                    value: str = "value", label: str = "label") -> DataFrame:
    """Median and scaled median absolute deviation per class: keys, class_id, median, mad.

    ``df`` holds image and label of each voxel. Class 0 keeps zeros, the others only positive values; NaN is ignored;
    a class without voxels gives 0 and 0. Both medians are exact and never gather a class in one task.
    """
    classes = list(range(len(labels))) if classes is None else list(classes)
    k = check_classes(classes)
    data = group_classes(df, labels, classes, label).select(*keys, "class_id", F.col(value).alias("_v"))
    if positive:
        data = data.where((F.col("class_id") == 0) | (F.col("_v") > 0))
    data = data.where(~F.isnan("_v"))
    group = [*keys, "class_id"]
    # Four passes read these narrow rows: write them once instead of repeating the join that made them.
    data = materialize(data)
    med = exact_percentiles(data, group, "_v", [0.5], ["median"]).drop("n")
    dev = data.join(by_sort(med), group).withColumn("_d", F.abs(F.col("_v") - F.col("median")))
    mad = exact_percentiles(dev, group, "_d", [0.5], ["mad"]).drop("n")
    every = _listed(df.select(*keys).distinct(), range(k), "class_id")
    found = med.join(by_sort(mad), group)
    return every.join(by_sort(found), group, "left").select(
        *group, F.coalesce("median", F.lit(0.0)).alias("median"),
        F.coalesce(F.col("mad") * scale, F.lit(0.0)).alias("mad"))


def intensity_priors(df: DataFrame, labels: Sequence[int], classes: Sequence[int] | None = None, rescale_first: bool = True,
                     dataset: Sequence[str] = (), value: str = "value", label: str = "label") -> DataFrame:
    """Mean and population deviation over images of the per-image medians and MADs, per channel and class.

    ``dataset`` names further key columns (several datasets or modalities in one job).
    """
    keys = [*dataset, "vol_id"] + (["channel"] if "channel" in df.columns else [])
    # The percentiles, the scaling and the list of volumes read these narrow rows: written once.
    df = materialize(df.select(*keys, value, label))
    data = rescale(df, value=value, keys=keys) if rescale_first else df
    stats = intensity_stats(data, labels, classes, keys=keys, value=value, label=label)
    group = [c for c in keys if c != "vol_id"] + ["class_id"]
    return stats.groupBy(*group).agg(
        F.avg("median").alias("mean_of_mean"), F.stddev_pop("median").alias("std_of_mean"),
        F.avg("mad").alias("mean_of_std"), F.stddev_pop("mad").alias("std_of_std"))


def _cut2(c):
    """Two decimals: rounded, then truncated at the second digit."""
    return (F.bround(c, 2) * 100).cast("int") / 100


def check_volumes(meta: DataFrame, values: DataFrame | None = None, keep_unique: bool = True) -> DataFrame:
    """Distinct shapes, aligned affines, resolutions, axes (and value sets) of a dataset: (property, value).

    ``values``: voxel rows with a label column, to compare label sets. With keep_unique=False one row per volume.
    """
    aligned = align_plan(meta).select("vol_id", "nx", "ny", "nz", "rx", "ry", "rz", "affine")
    axes = meta.select("vol_id", ras_axes(F.col("affine")).alias("_axes"))
    df = aligned.join(axes, "vol_id")
    text = lambda cols: F.array_join(F.array(*[c.cast("string") for c in cols]), ",")
    items = [
        F.struct(F.lit("shape").alias("property"), text([F.col("nx"), F.col("ny"), F.col("nz")]).alias("value")),
        F.struct(F.lit("res").alias("property"), text([_cut2(F.col(f"r{a}")) for a in "xyz"]).alias("value")),
        F.struct(F.lit("axes").alias("property"), text([F.col("_axes")[i] for i in range(3)]).alias("value")),
        F.struct(F.lit("affine").alias("property"), text(
            [_cut2(F.col("affine")[i][j]) for i in range(3) for j in range(3)]).alias("value")),
    ]
    rows = df.select("vol_id", F.explode(F.array(*items)).alias("_i")).select("vol_id", "_i.property", "_i.value")
    if values is not None:
        sets = unique_labels(values).select("vol_id", F.lit("values").alias("property"),
                                            F.array_join(F.col("labels").cast("array<string>"), ",").alias("value"))
        rows = rows.unionByName(sets)
    return rows.select("property", "value").distinct() if keep_unique else rows


def check_pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (same vol_id) whose affine, to 2 decimals, or shape differ: vol_id, aff_mismatch, shape_mismatch."""
    pair = images.alias("a").join(labels.alias("b"), "vol_id")
    aff = F.lit(False)
    for i in range(4):
        for j in range(4):
            aff = aff | (F.bround(F.col("a.affine")[i][j], 2) != F.bround(F.col("b.affine")[i][j], 2))
    shape = F.lit(False)
    for a in "xyz":
        shape = shape | (F.col(f"a.n{a}") != F.col(f"b.n{a}"))
    return (pair.select("vol_id", aff.alias("aff_mismatch"), shape.alias("shape_mismatch"))
            .where("aff_mismatch OR shape_mismatch"))


def unique_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted label set of each volume."""
    return df.groupBy("vol_id").agg(F.sort_array(F.collect_set(label)).alias("labels"))


def foreground_count(df: DataFrame, label: str = "label", volumes: DataFrame | None = None) -> DataFrame:
    """Labelled voxels per volume, 0 for those of ``volumes`` (vol_id) without a row."""
    counts = df.groupBy("vol_id").agg(F.count_if(F.col(label) > 0).alias("n_foreground"))
    if volumes is None:
        return counts
    return (volumes.select("vol_id").distinct().join(counts, "vol_id", "left")
            .select("vol_id", F.coalesce("n_foreground", F.lit(0).cast("bigint")).alias("n_foreground")))
