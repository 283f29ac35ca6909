"""Smoothing, gradients, majority filters and distance maps on voxel neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.layout import by_sort, by_volume
from gridloom.operators import blocks
from gridloom.operators.lines import Pass, attach_shape, distance_to, fold, separable
from gridloom.operators.morphology import complement_runs, face_neighbours, from_runs, inside_grid, outer_rim, to_runs
from gridloom.session import materialize

VOXEL = ["vol_id", "x", "y", "z"]


def gaussian_weights(sigma: float, edge: str) -> list[tuple[int, float]]:
    """(offset, weight). 'zero' uses the short kernel of the network layers, the others reach 4 sigma."""
    if edge == "zero":
        radius = int(math.ceil(2.5 * sigma) / 2)
    else:
        radius = int(4 * sigma + 0.5)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [(k, w / sum(raw)) for k, w in zip(range(-radius, radius + 1), raw)]


def weighted_pass(weights: list[tuple[int, float]], edge: str) -> Pass:
    def element(i, n, ref):
        terms = []
        for k, w in weights:
            if edge == "zero":
                j = f"{i} + {k}"
                terms.append(f"CASE WHEN {j} BETWEEN 0 AND {n} - 1 THEN {w!r}D * {ref(j)} ELSE 0D END")
            else:
                terms.append(f"{w!r}D * {ref(fold(f'({i} + {k})', n, edge))}")
        return "(" + " + ".join(terms) + ")"
    return Pass(element)


def gaussian_passes(sigma: Sequence[float], edge: str) -> dict[str, list[Pass]]:
    return {a: [weighted_pass(gaussian_weights(s, edge), edge)] for a, s in zip("xyz", sigma) if s > 0}


def gaussian_blur(df: DataFrame, sigma, shape, value: str = "value", edge: str = "nearest",
                  mask: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Separable Gaussian. ``edge``: 'nearest', 'reflect' or 'zero'.

    ``mask`` (a column): divide by the blurred mask + 1e-6 and put 0 where the mask is not positive. The result is
    dense over each grid.
    """
    keys = keys or ["vol_id"]
    sigma = [float(sigma)] * 3 if isinstance(sigma, (int, float)) else [float(s) for s in sigma]
    df, dims = attach_shape(df, shape)
    passes = gaussian_passes(sigma, edge)
    blurred = separable(df.where(F.col(value) != 0), keys, value, dims, passes)
    if mask is None:
        return blurred
    soft = separable(df.where(F.col(mask) > 0).withColumn("_m", F.lit(1.0)), keys, "_m", dims, passes)
    inside = df.where(F.col(mask) > 0).select(*keys, "x", "y", "z", F.lit(True).alias("_in"))
    on = [*keys, "x", "y", "z"]
    return (soft.join(by_sort(blurred), on, "left").join(by_sort(inside), on, "left")
            .select(*on, F.when(F.col("_in"), F.coalesce(value, F.lit(0.0)) / (F.col("_m") + 1e-6)).otherwise(0.0)
                    .alias(value)))


def smooth_labels(df: DataFrame, shape, labels: Sequence[int] | None = None, cube: bool = False,
                  label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Majority label among the face neighbours and the voxel itself (or the 3x3x3 cube), mirrored at the borders.

    Ties go to the first label of the list (ascending without a list). With a list, voxels of other labels stay as
    they are and only listed labels are counted. Background 0 is implicit and need not be in ``df``; its votes are the
    rest of the neighbourhood. Output: non-background voxels.

    Votes are pushed from voxels to neighbours. The input is first laid out by slabs of x, so that partial
    aggregation merges almost all votes before the shuffle.
    """
    keys = keys or ["vol_id"]
    at = [*keys, "x", "y", "z"]
    df, dims = attach_shape(df.select(*at, F.col(label).alias("_l")), shape)
    n = dict(zip("xyz", [str(d) for d in dims] if dims else ["nx", "ny", "nz"]))
    size = 27 if cube else 7
    reach = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)
             if cube or abs(a) + abs(b) + abs(c) <= 1]
    offsets = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a, b, c in reach])
    # A neighbour mirrored at a border reads the border voxel: such votes return to a border target, never leave it.
    target = [F.expr(f"least(greatest({a} + _o.{a}, 0), {n[a]} - 1)").alias(a) for a in "xyz"]
    votes = (
        df.where("_l <> 0").withColumn("_slab", F.expr("x DIV 16")).repartition(*keys, "_slab")
        .withColumn("_o", F.explode(offsets))
        .select(*keys, *target, "_l").groupBy(*at, "_l").agg(F.count("*").alias("_c"))
    )
    if labels is not None:
        order = F.array_position(F.array(*[F.lit(int(v)) for v in labels]), F.col("_l"))
        votes = votes.where(F.col("_l").isin(list(labels)))
    else:
        order = F.col("_l")
    zero_listed = labels is None or 0 in labels
    zero_order = 0 if labels is None else (list(labels).index(0) + 1 if 0 in labels else 0)
    best = F.max(F.struct(F.col("_c").alias("c"), (-order).alias("o"), F.col("_l").alias("l")))
    tally = votes.groupBy(*at).agg(best.alias("_b"), F.sum("_c").alias("_n"))
    if labels is not None and zero_listed:
        # Voxels of unlisted labels also vote, but for nobody.
        others = df.where(~F.col("_l").isin([0, *labels])).withColumn("_o", F.explode(offsets)) \
            .select(*keys, *target).groupBy(*at).agg(F.count("*").alias("_other"))
        tally = tally.join(by_sort(others), at, "left")
        zero_votes = F.lit(size) - F.col("_n") - F.coalesce("_other", F.lit(0))
    else:
        zero_votes = F.lit(size) - F.col("_n")
    win_zero = (zero_votes > F.col("_b.c")) | ((zero_votes == F.col("_b.c")) & (F.lit(-zero_order) > F.col("_b.o")))
    winner = F.when(win_zero, 0).otherwise(F.col("_b.l")) if zero_listed else F.col("_b.l")
    voted = tally.select(*at, winner.alias("_w"))
    if labels is None:
        return voted.where("_w <> 0").select(*at, F.col("_w").alias(label))
    current = df.select(*at, "_l")
    joined = current.join(by_sort(voted), at, "full")
    listed = F.coalesce("_l", F.lit(0)).isin(list(labels))
    return (joined.select(*at, F.when(listed, F.coalesce("_w", F.lit(0))).otherwise(F.coalesce("_l", F.lit(0)))
                          .alias(label)).where(F.col(label) != 0))


def edt(mask: DataFrame, shape, keys: list[str] | None = None) -> DataFrame:
    """Exact Euclidean distance of every true voxel to the nearest false voxel of its grid (0 elsewhere, not listed).

    Without any false voxel in the grid the distance is infinite. Volumes of one small block are solved whole (``blocks``).
    """
    keys = keys or ["vol_id"]
    packed = blocks.give_shape(blocks.pack(mask, keys), shape)
    whole, rest = blocks.split(packed, keys, " OR ".join([blocks.LARGE, blocks.OUTSIDE, blocks.TWICE]))

    def work(g: blocks.Grids):
        # The nearest false voxel shares a face with a true one.
        d2 = blocks.distances_to(~g.mask() & g.there())[g.cell(g.row, g.at)]
        return g.row, *g.at.T, np.where(d2 < blocks.NONE, np.sqrt(d2.astype(float)), np.inf)

    near = blocks.solve(whole, keys, [*[(a, T.IntegerType()) for a in "xyz"], ("distance", T.DoubleType())], blocks.box_and_rim, work)
    return near.unionByName(_edt_planes(blocks.unpack(rest, keys), shape, keys))


def _edt_planes(mask: DataFrame, shape, keys: list[str]) -> DataFrame:
    rim = materialize(inside_grid(outer_rim(mask, keys), shape))
    return (distance_to(mask.select(*keys, "x", "y", "z"), rim, keys, "_d2")
            .select(*keys, "x", "y", "z",
                    F.coalesce(F.sqrt(F.col("_d2").cast("double")), F.lit(float("inf"))).alias("distance")))


def signed_distance(df: DataFrame, shape, labels: Sequence[int] | None = None, label: str = "label") -> DataFrame:
    """Dense map: distance - 0.5 inside the listed (or all positive) labels, 0.5 - distance outside."""
    keys = ["vol_id"]
    keep = F.col(label).isin(list(labels)) if labels is not None else F.col(label) > 0
    packed = blocks.give_shape(blocks.pack(df.where(keep), keys), shape)
    cells = " * ".join(f"CAST(_n[{i}] AS BIGINT)" for i in range(3))
    whole, rest = blocks.split(packed, keys, " OR ".join([blocks.LARGE, blocks.OUTSIDE, blocks.TWICE, f"{cells} > {blocks.MOST}",
                                                          *[f"_n[{i}] > {blocks.LONGEST}" for i in range(3)]]))

    def work(g: blocks.Grids):
        mask, there = g.mask(), g.there()
        at = g.cell(g.row, g.at)
        inner = blocks.distances_to(~mask & there)[at]
        row, out = g.voxels(~mask & there)
        outer = blocks.distances_to(mask)[g.cell(row, out)]
        near = np.r_[np.where(inner < blocks.NONE, np.sqrt(inner.astype(float)), np.inf) - 0.5, 0.5 - np.sqrt(outer.astype(float))]
        return np.r_[g.row, row], *np.r_[g.at, out].T, near

    near = blocks.solve(whole, keys, [*[(a, T.IntegerType()) for a in "xyz"], ("distance", T.DoubleType())], blocks.whole_grid, work)
    return near.unionByName(_signed_planes(blocks.unpack(rest, keys), shape))


def _signed_planes(mask: DataFrame, shape) -> DataFrame:
    keys = ["vol_id"]
    inside = _edt_planes(mask, shape, keys).select(*VOXEL, (F.col("distance") - 0.5).alias("distance"))
    outside = from_runs(complement_runs(to_runs(mask, keys), keys, mask.select("vol_id").distinct(), shape))
    inner = F.col("xm") & F.col("xp") & F.col("ym") & F.col("yp") & F.col("zm") & F.col("zp")
    surface = materialize(face_neighbours(mask, keys).where(~inner).select(*VOXEL))
    out = distance_to(outside.select(*VOXEL), surface, keys, "_d2")
    return inside.unionByName(out.select(*VOXEL, (0.5 - F.sqrt(F.col("_d2").cast("double"))).alias("distance")))


def signed_distance_cropped(df: DataFrame, shape, crop_margin: int, labels: Sequence[int] | None = None,
                            label: str = "label") -> DataFrame:
    """The same inside the box of all positive labels grown by ``crop_margin``; elsewhere the smallest value of it."""
    from gridloom.operators.geometry import crop_to_box, dense_grid, region_box
    keep = df.where(F.col(label) > 0)
    boxes = region_box(keep, shape, margin=crop_margin).select("vol_id", "lo", "hi")
    local = crop_to_box(df, boxes)
    size = boxes.select("vol_id", *[(F.col("hi")[i] - F.col("lo")[i]).alias(f"n{a}") for i, a in enumerate("xyz")])
    inner = signed_distance(local, size, labels, label)
    back = by_volume(inner, boxes).select(
        "vol_id", *[(F.col(a) + F.col("lo")[i]).alias(a) for i, a in enumerate("xyz")], "distance")
    low = inner.groupBy("vol_id").agg(F.min("distance").alias("_min"))
    grid = dense_grid(low, shape)
    return (grid.join(by_sort(back), VOXEL, "left")
            .select(*VOXEL, F.coalesce("distance", "_min").alias("distance")))


def nearest_label(points: DataFrame, seeds: DataFrame, keys: list[str], most: int = 1 << 20) -> DataFrame:
    """points with _d2, the squared distance to the nearest seed of their keys, and _new, its label ``_cand``.

    Any label numbers do: the transform carries their place in the order of all distinct labels, so that ties still go to
    the smallest. More than ``most`` distinct labels are an error.
    """
    seeds = materialize(seeds)
    place = F.row_number().over(Window.orderBy("_cand")) - 1
    names = seeds.select("_cand").distinct().withColumn("_place", place)
    names = names.withColumn("_place", F.when(F.col("_place") < most, F.col("_place")).otherwise(
        F.raise_error(F.lit("too many distinct labels")).cast("int")))
    coded = seeds.join(names, "_cand").drop("_cand").withColumnRenamed("_place", "_cand")
    near = distance_to(points, coded, keys, "_d2", "_cand", most, "_at")
    return near.join(names.select(F.col("_place").alias("_at"), F.col("_cand").alias("_new")), "_at", "left").drop("_at")


def erode_labels(df: DataFrame, labels: Sequence[int], factors: Sequence[float], shape,
                 label: str = "label") -> DataFrame:
    """Shrink the listed labels one after the other. An integer factor is the radius of a ball; a fraction keeps the
    voxels where the blurred mask (sigma 1) exceeds it. Removed voxels take the nearest other label (the smallest on
    ties), searched in the box around the removed voxels with a margin of 3. Dense input: background rows count."""
    from gridloom.operators.geometry import region_box
    from gridloom.operators.morphology import erode
    out = df
    for lab, factor in zip(labels, factors):
        mask = out.where(F.col(label) == lab).select(*VOXEL)
        if float(factor) == int(factor):
            kept = erode(mask, int(factor))
        else:
            soft = gaussian_blur(mask.withColumn("value", F.lit(1.0)), 1.0, shape)
            kept = soft.where(F.col("value") > float(factor)).select(*VOXEL)
        # Read for the boxes and twice for the distances: written once.
        lost = materialize(mask.join(by_sort(kept), VOXEL, "left_anti"))
        boxes = region_box(lost, shape, margin=3).select("vol_id", "lo", "hi")
        near_by = by_volume(out, boxes).where(" AND ".join(
            f"{a} >= lo[{i}] AND {a} < hi[{i}]" for i, a in enumerate("xyz"))).where(F.col(label) != lab)
        near = nearest_label(lost, near_by.select(*VOXEL, F.col(label).alias("_cand")), ["vol_id"])
        near = near.where("_d2 IS NOT NULL").select(*VOXEL, "_new")
        out = (out.join(by_sort(near), VOXEL, "left")
               .withColumn(label, F.coalesce("_new", F.col(label))).drop("_new"))
    return out


def gradients(df: DataFrame, kind: str = "sobel", value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """gx, gy, gz and magnitude of a dense image. 'sobel': [1, 0, -1] along the axis and [1, 2, 1] across, zeros
    beyond the border; 'step': forward difference, 0 at the last voxel. The z and y windows share an exchange."""
    keys = keys or ["vol_id"]
    wins = {"z": Window.partitionBy(*keys, "x", "y").orderBy("z"), "y": Window.partitionBy(*keys, "x", "z").orderBy("y"),
            "x": Window.partitionBy(*keys, "y", "z").orderBy("x")}
    prev = lambda c, a: F.coalesce(F.lag(c).over(wins[a]), F.lit(0.0))
    nxt = lambda c, a: F.coalesce(F.lead(c).over(wins[a]), F.lit(0.0))
    df = df.select(*keys, "x", "y", "z", F.col(value).cast("double").alias("_v")).repartition(*keys, "x")
    if kind == "step":
        step = lambda a: F.coalesce(F.lead("_v").over(wins[a]) - F.col("_v"), F.lit(0.0))
        out = df.withColumn("gz", step("z")).withColumn("gy", step("y")).withColumn("gx", step("x"))
    else:
        diff = lambda c, a: prev(c, a) - nxt(c, a)
        sm = lambda c, a: prev(c, a) + 2 * F.col(c) + nxt(c, a)
        out = df.withColumns({"_d": diff("_v", "z"), "_s": sm("_v", "z")})
        out = out.withColumns({"_dz": sm("_d", "y"), "_dy": diff("_s", "y"), "_ss": sm("_s", "y")})
        out = out.withColumns({"gz": sm("_dz", "x"), "gy": sm("_dy", "x"), "gx": diff("_ss", "x")})
    return out.select(*keys, "x", "y", "z", "gx", "gy", "gz",
                      F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2).alias("magnitude"))


def boundary_weight(df: DataFrame, shape, distance: int = 1, weight: float = 1.0, value: str = "p",
                    keys: list[str] | None = None, skip_label: int | None = None) -> DataFrame:
    """1 + weight near region borders: where the mean of ``value`` in the (2d+1) cube, counting only cells of the
    grid, lies strictly between 0 and 1/3 - 1e-4. Dense output with column ``weight``."""
    keys = keys or ["vol_id", "label"]

    def element(i, n, ref):
        terms = [f"CASE WHEN {i} + {k} BETWEEN 0 AND {n} - 1 THEN {ref(f'{i} + {k}')} ELSE 0D END"
                 for k in range(-distance, distance + 1)]
        count = f"(least({i} + {distance}, {n} - 1) - greatest({i} - {distance}, 0) + 1)"
        return "(" + " + ".join(terms) + f") / {count}"

    df, dims = attach_shape(df, shape)
    mean = separable(df, keys, value, dims, {a: [Pass(element)] for a in "xyz"})
    near = (F.col(value) > 0) & (F.col(value) < 1.0 / 3 - 1e-4)
    if skip_label is not None:
        near = near & (F.col("label") != skip_label)
    return mean.select(*keys, "x", "y", "z", (1.0 + weight * near.cast("double")).alias("weight"))
