"""Voxel-wise filters and intensity normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.layout import by_sort
from gridloom.functions.order import exact_percentiles
from gridloom.operators.morphology import dilate_runs, erode_runs, fill_holes, from_runs, to_runs

EPSILON = 1e-7


def _volume_keys(df: DataFrame) -> list[str]:
    return ["vol_id", "channel"] if "channel" in df.columns else ["vol_id"]


def mask_volume(df: DataFrame, shape=None, threshold: float = 0.1, mask: DataFrame | None = None, dilate: int = 0,
                erode: int = 0, holes: bool = False, fill: float = 0.0, value: str = "value") -> DataFrame:
    """Values outside the mask become ``fill``. The mask is value >= threshold (per channel) or the voxels of ``mask``
    (vol_id, x, y, z; applied to all channels), then dilated, eroded and filled in that order."""
    keys = _volume_keys(df) if mask is None else ["vol_id"]
    if mask is None and not (dilate or erode or holes):
        return df.withColumn(value, F.when(F.col(value) >= threshold, F.col(value)).otherwise(F.lit(fill)))
    region = df.where(F.col(value) >= threshold) if mask is None else mask
    region = region.select(*keys, "x", "y", "z")
    if dilate or erode:
        runs = to_runs(region, keys)
        if dilate:
            runs = dilate_runs(runs, keys, dilate, shape)
        if erode:
            runs = erode_runs(runs, keys, erode)
        region = from_runs(runs)
    if holes:
        region = fill_holes(region, shape, keys)
    at = [*keys, "x", "y", "z"]
    hit = df.join(region.withColumn("_m", F.lit(True)), at, "left")
    out = hit.withColumn(value, F.when(F.col("_m"), F.col(value)).otherwise(F.lit(fill)))
    return out.select(*df.columns)


def rescale(df: DataFrame, new_min: float = 0.0, new_max: float = 255.0, pmin: float = 2.0, pmax: float = 98.0,
            positive_only: bool = False, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Clip each volume (and channel) to two exact percentiles and map them linearly to [new_min, new_max]; a constant
    volume becomes 0. The limits are one row per volume and come back by a join on the volume."""
    keys = keys or _volume_keys(df)
    source = df.where(F.col(value) > 0) if positive_only else df
    limits = exact_percentiles(source, keys, value, [pmin / 100, pmax / 100], ["_lo", "_hi"]).drop("n")
    clipped = F.greatest(F.least(F.col(value), F.col("_hi")), F.col("_lo"))
    scaled = F.lit(float(new_min)) + (clipped - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * float(new_max - new_min)
    out = df.join(by_sort(limits), keys)
    return out.withColumn(value, F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(scaled)).select(*df.columns)


def clip(value: Column, low: float = 0.0, high: float = 80.0) -> Column:
    """Clamp; the default is the CT window in Hounsfield units."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def normalise_minmax(df: DataFrame, perc: tuple[float, float] | None = (0.0, 1.0), joint: bool = False,
                     value: str = "value") -> DataFrame:
    """Clip to two order statistics (index int(perc * n), no interpolation), then (v - m) / (M - m + eps). Per channel,
    or over all channels of a volume with ``joint``; without ``perc`` plain minimum and maximum."""
    keys = ["vol_id"] if joint else _volume_keys(df)
    if perc is None:
        ends = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    else:
        ends = exact_percentiles(df, keys, value, list(perc), ["_low", "_high"], interpolate=False).drop("n")
    v = F.greatest(F.least(F.col(value), F.col("_high")), F.col("_low"))
    return (df.join(ends, keys).withColumn(value, (v - F.col("_low")) / (F.col("_high") - F.col("_low") + EPSILON))
            .select(*df.columns))


def nan_to_zero(value: Column) -> Column:
    return F.nanvl(value, F.lit(0.0))


def stack_channels(*channels: DataFrame) -> DataFrame:
    """One multi-channel table from single-channel tables whose volumes are already paired by vol_id."""
    out = None
    for i, c in enumerate(channels):
        part = c.withColumn("channel", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def first_channel(df: DataFrame) -> DataFrame:
    return df.where("channel = 0")


def minmax_unit(df: DataFrame, value: str = "value") -> DataFrame:
    """(v - min) / (max - min + eps) over the whole batch: two scalar subqueries, no join."""
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    return df.withColumn(value, (F.col(value) - low) / (high - low + EPSILON))
