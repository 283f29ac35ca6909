"""Interpolation on voxel grids.

Grid-to-grid changes are separable and run as one-axis passes on packed lines. General affine warps go brick by brick
(``warp``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.layout import by_volume
from gridloom.functions.numbers import apply_affine, blur_sigma, inverse_affine, matmul, matrix
from gridloom.operators.geometry import align
from gridloom.operators.lines import Pass, attach_shape, fold, separable
from gridloom.operators.warp import affine_reads

VOXEL = ["vol_id", "x", "y", "z"]
AXES = ("x", "y", "z")


def sample_pass(position: str, length: str, method: str) -> Pass:
    """Read each line at ``position`` (SQL in i and n), clamped to the line."""
    def element(i, n, ref):
        p = f"least(greatest({position.format(i=i, n=n)}, 0D), CAST({n} - 1 AS DOUBLE))"
        if method == "nearest":
            return ref(f"CAST(bround({p}) AS INT)")
        lo, hi = f"CAST(floor({p}) AS INT)", f"least(CAST(floor({p}) AS INT) + 1, {n} - 1)"
        return f"({ref(lo)} * (1 - ({p} - floor({p}))) + {ref(hi)} * ({p} - floor({p})))"
    return Pass(element, lambda n: f"CAST({length.format(n=n)} AS INT)")


def half_down_pass(position: str, length: str) -> Pass:
    """Nearest neighbour that takes the lower sample at exactly one half."""
    def element(i, n, ref):
        p = f"least(greatest({position.format(i=i, n=n)}, 0D), CAST({n} - 1 AS DOUBLE))"
        return ref(f"CAST(ceil({p} - 0.5D) AS INT)")
    return Pass(element, lambda n: f"CAST({length.format(n=n)} AS INT)")


def adaptive_blur_pass(sigma: str, edge: str) -> Pass:
    """Gaussian whose sigma is a column; sigma 0 leaves the line alone."""
    def element(i, n, ref):
        r = f"CAST(4 * {sigma} + 0.5 AS INT)"
        w = f"exp(-0.5D * o * o / ({sigma} * {sigma}))"
        value = ref(fold(f"({i} + o)", n, edge))
        return (f"CASE WHEN {sigma} = 0 THEN {ref(i)} ELSE "
                f"aggregate(sequence(-{r}, {r}), 0D, (s, o) -> s + {w} * {value}) / "
                f"aggregate(sequence(-{r}, {r}), 0D, (s, o) -> s + {w}) END")
    return Pass(element)


def resample(df: DataFrame, meta: DataFrame, voxel_size: Sequence[float], method: str = "linear", blur: bool = True,
             value: str = "value", keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Resize voxels to ``voxel_size`` (mm, per axis): (dense voxels, meta).

    On axes that get coarser the image is first blurred with sigma 0.25/factor, mirrored at the borders. Samples lie
    at -(f-1)/(2f) + i/f, clamped to the grid, so that the field of view stays centred.
    """
    keys = keys or ["vol_id"]
    plan = meta.withColumns({f"f{a}": F.col(f"r{a}") / float(s) for a, s in zip(AXES, voxel_size)})
    plan = plan.withColumns({f"g{a}": F.when(F.col(f"f{a}") > 1, 0.0).otherwise(0.25 / F.col(f"f{a}")) for a in AXES})
    carry = [f"f{a}" for a in AXES] + [f"g{a}" for a in AXES]
    passes = {}
    for a in AXES:
        steps = [adaptive_blur_pass(f"g{a}", "reflect")] if blur else []
        nearest_or_linear = half_down_pass if method == "nearest" else (lambda p, l: sample_pass(p, l, "linear"))
        steps.append(nearest_or_linear(f"(-(f{a} - 1) / (2 * f{a}) + {{i}} / f{a})", f"ceil({{n}} * f{a})"))
        passes[a] = steps
    joined = by_volume(df, plan.select("vol_id", "nx", "ny", "nz", *carry))
    out = separable(joined, keys, value, None, passes, carry=carry).select(*keys, *AXES, value)
    new = plan
    if "affine" in meta.columns:
        col = lambda i, j: F.col("affine")[i][j] / F.col(f"f{AXES[j]}")
        rows = [[col(i, 0), col(i, 1), col(i, 2),
                 F.col("affine")[i][3] - sum((col(i, j) * 0.5 * (F.col(f"f{AXES[j]}") - 1) for j in (1, 2)),
                                             col(i, 0) * 0.5 * (F.col("fx") - 1))] for i in range(3)]
        new = new.withColumn("_affine", matrix(rows + [[0, 0, 0, 1]])).withColumn("affine", F.col("_affine"))
    new = new.withColumns({f"n{a}": F.ceil(F.col(f"n{a}") * F.col(f"f{a}")).cast("int") for a in AXES})
    new = new.withColumns({f"r{a}": F.lit(float(s)) for a, s in zip(AXES, voxel_size)})
    return out, new.select(*meta.columns)


def needs_resampling(target: Sequence[float] = (1.0, 1.0, 1.0), tolerance: float = 0.05) -> Column:
    """True where a resolution is off the target by more than the tolerance on any axis."""
    test = F.lit(False)
    for a, t in zip(AXES, target):
        test = test | (F.col(f"r{a}") > t + tolerance) | (F.col(f"r{a}") < t - tolerance)
    return test


def resize_grid(df: DataFrame, shape, new_shape: Sequence[int], method: str = "linear", value: str = "value",
                keys: list[str] | None = None) -> DataFrame:
    """Sample at i / zoom with clamped edges; nearest rounds half to even."""
    keys = keys or ["vol_id"]
    df, dims = attach_shape(df, shape)
    # Widths are literals or columns; the input length is the {n} of the pass.
    passes = {a: [sample_pass(f"({{i}} * {{n}} / {float(s)}D)", str(int(s)), method)] for a, s in zip(AXES, new_shape)}
    return separable(df, keys, value, dims, passes)


def resample_like(source: DataFrame, source_meta: DataFrame, ref_meta: DataFrame, method: str = "linear",
                  value: str = "value") -> DataFrame:
    """Reslice onto the grid of ``ref_meta`` (same vol_id) through the two affines; 0 outside the source."""
    grids = (ref_meta.select("vol_id", "nx", "ny", "nz", F.col("affine").alias("_ref"))
             .join(source_meta.select("vol_id", F.col("affine").alias("_flo"), F.col("nx").alias("sx"),
                                      F.col("ny").alias("sy"), F.col("nz").alias("sz")), "vol_id")
             .withColumn("t", matmul(inverse_affine(F.col("_flo")), F.col("_ref"))))
    return affine_reads(grids.drop("_ref", "_flo"), source, method, "zero", value)


def apply_affine_warp(df: DataFrame, volumes: DataFrame, shape: Sequence[int], affine: Column,
                      method: str = "linear", value: str = "value") -> DataFrame:
    """Warp about the grid centre: the output at v reads the input at A (v - c) + c, clamped to the grid."""
    centre = [(n - 1) / 2 for n in shape]
    grids = volumes.withColumn("_a", affine)
    moved = apply_affine(F.col("_a"), *[F.lit(-c) for c in centre])  # where A sends -c
    rows = [[F.col("_a")[i][j] for j in range(3)] + [moved[i] + centre[i]] for i in range(3)]
    sizes = [F.lit(int(n)).alias(f"{p}{a}") for p in "ns" for a, n in zip(AXES, shape)]
    return affine_reads(grids.select("vol_id", *sizes, matrix(rows).alias("t")), df, method, "clamp", value)


def upsample_labels(df: DataFrame, meta: DataFrame, res: Sequence[float], label: str = "label") -> DataFrame:
    """Interpolate the mask of each label and take the label of the largest value, the smallest label on ties.

    Background must be listed in ``df``.
    """
    masks = df.select(*VOXEL, F.col(label).alias("label"), F.lit(1.0).alias("p"))
    soft, _ = resample(masks, meta, res, "linear", blur=False, value="p", keys=["vol_id", "label"])
    best = F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("label")).alias("l")))
    return soft.where("p > 0").groupBy(*VOXEL).agg((-best["l"]).alias(label))


def downsample_images(df: DataFrame, meta: DataFrame, res: Sequence[float], thickness: Sequence[float] | None = None,
                      value: str = "value", label_map: bool = False):
    """Align, blur for the target resolution, pick nearest samples, and interpolate back to the aligned grid:
    (coarse voxels, coarse meta, fine voxels). A label map is not blurred, and read back by nearest samples."""
    aligned, ameta = align(df, meta)
    if label_map:
        coarse, cmeta = resample(aligned.select(*VOXEL, value), ameta, res, "nearest", blur=False, value=value)
        fine = resample_like(coarse, cmeta, ameta, "nearest", value)
        kind = df.schema[value].dataType
        return (*(d.withColumn(value, F.col(value).cast(kind)) if i != 1 else d for i, d in enumerate((coarse, cmeta, fine))),)
    sig = ameta
    for i, a in enumerate(AXES):
        t = F.lit(float(thickness[i])) if thickness is not None else None
        s = blur_sigma(F.col(f"r{a}"), F.lit(float(res[i])), t)
        sig = sig.withColumn(f"g{a}", F.when(F.col(f"r{a}") == float(res[i]), 0.0).otherwise(s))
    carry = ["gx", "gy", "gz"]
    blurred = separable(by_volume(aligned, sig.select("vol_id", "nx", "ny", "nz", *carry)), ["vol_id"], value, None,
                        {a: [adaptive_blur_pass(f"g{a}", "nearest")] for a in AXES}, carry=carry)
    coarse, cmeta = resample(blurred.select(*VOXEL, value), ameta, res, "nearest", blur=False, value=value)
    fine = resample_like(coarse, cmeta, ameta, value=value)
    return coarse, cmeta, fine
