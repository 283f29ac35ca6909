"""Overlap, distance and cohort scores between two labelings.

Pairs of maps enter as one row per voxel: (vol_id, x, y, z, gt, seg). ``pair_maps`` builds them from two tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.layout import by_sort
from gridloom.functions.order import beside, running_total
from gridloom.operators import blocks
from gridloom.operators.geometry import align, crop_to_box, region_box
from gridloom.operators.labels import correct_labels, correct_labels_nearest
from gridloom.operators.lines import attach_shape, distance_to
from gridloom.operators.morphology import from_words, surface_words, to_words
from gridloom.session import materialize

VOXEL = ["vol_id", "x", "y", "z"]
EPSILON = 1e-7


def pair_maps(gt: DataFrame, seg: DataFrame, label: str = "label") -> DataFrame:
    """One row per voxel present in either map, absent = 0. One aggregate over the union, partly done before the
    shuffle where both maps share a partition, instead of a full outer join."""
    a = gt.select(*VOXEL, F.col(label).alias("gt"), F.lit(None).cast("int").alias("seg"))
    b = seg.select(*VOXEL, F.lit(None).cast("int").alias("gt"), F.col(label).alias("seg"))
    return (a.unionByName(b).groupBy(*VOXEL)
            .agg(F.coalesce(F.max("gt"), F.lit(0)).alias("gt"), F.coalesce(F.max("seg"), F.lit(0)).alias("seg")))


_CELLS = "ARRAY<STRUCT<gt: INT, seg: INT, n: BIGINT>>"


def contingency(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cells): the counts of a volume's value pairs as one list of (gt, seg, n), at most labels^2 long."""
    counts = pairs.groupBy(*keys, F.col("gt").cast("int").alias("gt"), F.col("seg").cast("int").alias("seg")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.collect_list(F.struct("gt", "seg", "n")).alias("cells"))


def whole_grid(table: DataFrame, keys: Sequence[str], shape) -> DataFrame:
    """Contingency lists with the voxels that neither map lists added to cell (0, 0).

    ``shape``: a tuple for all volumes, or a table (vol_id, nx, ny, nz); every volume of that table is listed then,
    where ``keys`` is the volume alone.
    """
    if isinstance(shape, DataFrame):
        size = shape.select("vol_id", F.expr("CAST(nx AS BIGINT) * ny * nz").alias("_all"))
        table = table.join(by_sort(size), "vol_id", "right" if list(keys) == ["vol_id"] else "inner")
    else:
        table = table.withColumn("_all", F.lit(prod(int(n) for n in shape)).cast("bigint"))
    cells = F.coalesce("cells", F.expr(f"CAST(array() AS {_CELLS})")).alias("cells")
    rest = "array(named_struct('gt', 0, 'seg', 0, 'n', _all - aggregate(cells, 0L, (s, c) -> s + c.n)))"
    return table.select(*keys, "_all", cells).select(*keys, F.expr(f"concat(cells, {rest})").alias("cells"))


def _marginals(table: DataFrame, keys: Sequence[str], labels: Sequence[int], within: tuple[int, int] | None = None) -> DataFrame:
    """Per listed label: voxels in both (i), in gt (a), in seg (b); only of cells with both values ``within`` a range."""
    listed = ", ".join(str(int(v)) for v in labels)
    low, high = within or (0, 0)
    used = f"filter(cells, c -> c.gt BETWEEN {low} AND {high} AND c.seg BETWEEN {low} AND {high})" if within else "cells"
    sides = (f"concat(transform({used}, c -> named_struct('label', c.gt, 'i', IF(c.gt = c.seg, c.n, 0L), 'a', c.n, 'b', 0L)), "
             f"transform({used}, c -> named_struct('label', c.seg, 'i', 0L, 'a', 0L, 'b', c.n)), "
             f"transform(array({listed}), v -> named_struct('label', v, 'i', 0L, 'a', 0L, 'b', 0L)))")
    rows = table.select(*keys, F.explode(F.expr(sides)).alias("_s")).select(*keys, "_s.*").where(f"label IN ({listed})")
    return rows.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("i", "a", "b")])


def dice_by_label(pairs: DataFrame, labels: Sequence[int], keys: Sequence[str] = ("vol_id",), shape=None) -> DataFrame:
    """Dice of every listed label: keys, label, dice.

    Only voxels where both values lie within the range of the list count, and 1e-5 is added below the bar. A list of
    one label uses the plain binary form instead. One aggregation for all labels of all volumes. Sparse maps need
    ``shape`` (see ``whole_grid``) for the score of the background and for volumes without any row.
    """
    return dice_of_counts(contingency(pairs, keys), labels, keys, shape)


def dice_of_counts(table: DataFrame, labels: Sequence[int], keys: Sequence[str] = ("vol_id",), shape=None) -> DataFrame:
    """``dice_by_label`` from contingency lists; entries of one cell add up."""
    if shape is not None:
        table = whole_grid(table, keys, shape)
    labels = [int(v) for v in labels]
    if len(labels) == 1:
        total = F.col("a") + F.col("b")
        return _marginals(table, keys, labels).select(
            *keys, "label", F.when(total == 0, float("nan")).otherwise(2 * F.col("i") / total).alias("dice"))
    m = _marginals(table, keys, labels, (min(labels), max(labels)))
    return m.select(*keys, "label", (2 * F.col("i") / (F.col("a") + F.col("b") + 1e-5)).alias("dice"))


def dice_binary(pairs: DataFrame, keys: Sequence[str] = ("vol_id",)) -> DataFrame:
    """Dice of two boolean columns gt and seg, without epsilon; NaN when both are empty."""
    agg = pairs.groupBy(*keys).agg(F.count_if(F.col("gt") & F.col("seg")).alias("i"), F.count_if("gt").alias("a"),
                                   F.count_if("seg").alias("b"))
    total = F.col("a") + F.col("b")
    return agg.select(*keys, F.when(total == 0, float("nan")).otherwise(2 * F.col("i") / total).alias("dice"))


def dice_whole(pairs: DataFrame, keys: Sequence[str] = ("vol_id",)) -> DataFrame:
    """Dice of everything labelled."""
    return dice_binary(pairs.select(*keys, (F.col("gt") > 0).alias("gt"), (F.col("seg") > 0).alias("seg")), keys)


def dice_voxel_epsilon(pairs: DataFrame, labels: Sequence[int], n_voxels: int | Column,
                       keys: Sequence[str] = ("vol_id",)) -> DataFrame:
    """Dice whose epsilon is added once per voxel of the grid (``n_voxels``)."""
    m = _marginals(contingency(pairs, keys), keys, labels)
    n = n_voxels if isinstance(n_voxels, Column) else F.lit(int(n_voxels))
    return m.select(*keys, "label", (2 * F.col("i") / (F.col("a") + F.col("b") + EPSILON * n)).alias("dice"))


# ---- surface distances ----------------------------------------------------------------------------------------------

def mask_points(pairs: DataFrame, labels: Sequence[int] | None, whole: bool = False) -> DataFrame:
    """Voxels of both masks (``side``) of every (vol, label).

    ``labels`` None takes everything labelled as one structure (label -1); ``whole`` adds that one to the listed.
    """
    masks = []
    for c, s in (("gt", 0), ("seg", 1)):
        if labels is not None:
            masks.append(F.when(F.col(c).isin([int(v) for v in labels]), F.struct(F.col(c).alias("label"), F.lit(s).alias("side"))))
        if labels is None or whole:
            masks.append(F.when(F.col(c) > 0, F.struct(F.lit(-1).alias("label"), F.lit(s).alias("side"))))
    both = F.filter(F.array(*masks), lambda s: s.isNotNull())
    return pairs.where("vol_id IS NOT NULL").select(*VOXEL, F.explode(both).alias("_s")).select(
        "vol_id", "_s.label", "_s.side", "x", "y", "z")


def structures(pairs: DataFrame, labels: Sequence[int] | None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """``mask_points``: (packed ones of small structures, rows of the others)."""
    keys = ["vol_id", "label"]
    small, rest = blocks.split(blocks.pack(mask_points(pairs, labels, whole), keys, "side"), keys, blocks.LARGE)
    return small, blocks.unpack(rest, keys, "side").withColumn("side", F.col("side").cast("int"))


class Edges:
    """Edge voxels of both masks of packed structures: ``row``, ``at``, ``side`` and ``d2``, the squared distance to the nearest
    edge voxel of the other mask (NONE or more without); ``both``: which rows have both masks, ``extent``: the largest side of the joint box."""

    def __init__(self, g: blocks.Grids, inclusive: bool):
        room = g.own - (0 if inclusive else 1)
        inside = np.ones((g.rows, *g.size), bool)
        for i, n in enumerate(g.size):
            inside &= (np.arange(n) < room[:, i, None]).reshape([g.rows, *[n if j == i else 1 for j in range(3)]])
        masks = [g.mask(g.value == s) for s in (0, 1)]
        self.both = masks[0].any(axis=(1, 2, 3)) & masks[1].any(axis=(1, 2, 3))
        self.extent = room.max(axis=1)
        edges = []
        for mask in masks:
            # A voxel of the box without the mask makes its face neighbours edges.
            out, near = inside & ~mask, np.zeros_like(mask)
            for axis in (1, 2, 3):
                a, b = np.moveaxis(near, axis, 0), np.moveaxis(out, axis, 0)
                a[1:] |= b[:-1]
                a[:-1] |= b[1:]
            edges.append(mask & inside & near & self.both[:, None, None, None])
        found = []
        for side in (0, 1):
            row, at = g.voxels(edges[side])
            found.append((row, at, np.full(len(row), side), blocks.distances_to(edges[1 - side])[g.cell(row, at)]))
        self.row, self.at, self.side, self.d2 = (np.concatenate(c) for c in zip(*found))
        self.far = self.d2 >= blocks.NONE


def surface_points(pairs: DataFrame, labels: Sequence[int] | None, shape, inclusive: bool = False, whole: bool = False):
    """Edge voxels of both masks of every (vol, label): (words of edges with column ``side`` and ``label``, box table).

    ``labels`` and ``whole``: as in ``mask_points``. The joint box is [min, max) unless ``inclusive``; an edge voxel has a face neighbour inside the box that is not in its mask.
    """
    return surface_words_of(mask_points(pairs, labels, whole), inclusive)


def surface_words_of(points: DataFrame, inclusive: bool):
    """``surface_points`` of voxels (vol_id, label, side, x, y, z)."""
    keys = ["vol_id", "label"]
    # Words of 64 cells are merged before the first shuffle and serve the boxes and all neighbours.
    words = to_words(points, [*keys, "side"])
    ends = words.groupBy(*keys).agg(
        (F.max("side") - F.min("side")).alias("_both"),
        *[F.min(c).alias(f"_l{a}") for a, c in zip("xyz", ("x", "y", "z0"))],
        *[F.max(c).alias(f"_h{a}") for a, c in zip("xyz", ("x", "y", "z1"))])
    grow = 1 if inclusive else 0
    boxes = ends.where("_both = 1").select(
        *keys, F.array("_lx", "_ly", "_lz").alias("lo"),
        F.array(*[F.col(f"_h{a}") + grow for a in "xyz"]).alias("hi"))
    boxes = boxes.withColumn("extent", F.greatest(*[F.col("hi")[i] - F.col("lo")[i] for i in range(3)]))
    # Bits of the word that lie in [lo, hi) along z, and those that have room below and above.
    since = lambda n: f"CASE WHEN {n} <= w * 64 THEN -1L WHEN {n} > w * 64 + 63 THEN 0L ELSE shiftleft(-1L, CAST({n} - w * 64 AS INT)) END"
    within = lambda low, high: F.expr(f"({since(low)}) & ~({since(high)})")
    inside = (words.join(by_sort(boxes.select(*keys, "lo", "hi")), keys)
              .where("x >= lo[0] AND x < hi[0] AND y >= lo[1] AND y < hi[1]")
              .withColumn("bits", F.col("bits").bitwiseAND(within("lo[2]", "hi[2]"))).where("bits <> 0")
              .select(*keys, "side", "x", "y", "w", "bits", within("lo[2] + 1", "hi[2]").alias("_zm"), within("lo[2]", "hi[2] - 1").alias("_zp"),
                      F.expr("IF(x > lo[0], 1, 0) + IF(x < hi[0] - 1, 2, 0) + IF(y > lo[1], 4, 0) + IF(y < hi[1] - 1, 8, 0)").alias("_sides")))
    room = {"zm": "_zm", "zp": "_zp", **{c: f"IF(_sides & {1 << i} = 0, 0L, -1L)" for i, c in enumerate(("xm", "xp", "ym", "yp"))}}
    edges = surface_words(inside, [*keys, "side"], room).where("bits <> 0")
    # Both surfaces are read as points and as targets: written once.
    return materialize(edges), boxes.select(*keys, "extent")


def surface_to_surface(edges: DataFrame) -> DataFrame:
    """Each edge voxel of those words with ``d2``, the squared distance to the nearest edge voxel of the other mask (NULL without)."""
    keys = ["vol_id", "label", "side"]
    other = edges.select("vol_id", "label", (1 - F.col("side")).alias("side"), "x", "y", "w", "bits")
    return distance_to(from_words(edges), other, keys, "d2")


def surface_distances(pairs: DataFrame, labels: Sequence[int] | None, shape, percentiles: Sequence[float] = (100, 99, 95),
                      inclusive: bool = False, whole: bool = False) -> DataFrame:
    """vol_id, label, mean_distance and one hausdorff_<p> per percentile; a ``shape`` table lists all volumes.

    Distances of both surfaces are pooled for the percentiles; the mean averages the two one-sided means. If a label
    is missing in either map every score is the largest side of the grid; if a surface is missing in the joint box its
    score is the largest side of the box. Squared distances are integers and few, so they are counted first and the
    exact percentile of a structure works on its distinct values. Small structures are solved whole (``blocks``).
    """
    keys = ["vol_id", "label"]
    small, points = structures(pairs, labels, whole)
    scores = [("extent", T.IntegerType()), *[(c, T.DoubleType()) for c in ("_m0", "_m1", *[f"_h{i}" for i in range(len(percentiles))])]]

    def score(g: blocks.Grids):
        e = Edges(g, inclusive)
        rows = np.flatnonzero(e.both)
        row, side, d = e.row[~e.far], e.side[~e.far], np.sqrt(e.d2[~e.far].astype(float))
        some = lambda v, n: pa.array(v, pa.float64(), mask=n[rows] == 0)
        means = []
        for s in (0, 1):
            n = np.bincount(row[side == s], minlength=g.rows)
            means.append(some((np.bincount(row[side == s], d[side == s], minlength=g.rows) / np.maximum(n, 1))[rows], n))
        d = np.r_[d[np.lexsort((d, row))], 0.0]
        n = np.bincount(row, minlength=g.rows)
        first, ranks = (np.cumsum(n) - n)[rows], []
        for p in percentiles:
            at = np.maximum(n[rows] - 1, 0) * (p / 100)
            low, high = np.floor(at), np.ceil(at)
            a, b = (np.where(n[rows] > 0, d[np.minimum(first + i.astype(int), len(d) - 1)], 0) for i in (low, high))
            ranks.append(some(np.where(a == b, a, (high - at) * a + (at - low) * b), n))
        return rows, e.extent[rows], *means, *ranks

    solved = blocks.solve(small, keys, scores, blocks.box, score)
    edges, boxes = surface_words_of(points, inclusive)
    hist = surface_to_surface(edges).groupBy(*keys, "side", "d2").agg(F.count("*").alias("c"))
    hist = hist.withColumn("d", F.sqrt(F.col("d2").cast("double")))
    stats = hist.groupBy(*keys).agg(
        *[(F.sum(F.when((F.col("side") == s) & F.col("d").isNotNull(), F.col("d") * F.col("c"))) /
           F.sum(F.when((F.col("side") == s) & F.col("d").isNotNull(), F.col("c")))).alias(f"_m{s}") for s in (0, 1)],
        *[F.percentile("d", p / 100, F.col("c")).alias(f"_h{i}") for i, p in enumerate(percentiles)])
    ids = [int(v) for v in labels or []] + ([-1] if labels is None or whole else [])
    listed = isinstance(shape, DataFrame)
    volumes, dims = (shape, None) if listed else attach_shape(pairs.select("vol_id").distinct(), shape)
    largest = F.lit(max(dims)) if dims else F.greatest("nx", "ny", "nz")
    every = volumes.select("vol_id", largest.cast("double").alias("_far"),
                           F.explode(F.array(*[F.lit(v) for v in ids])).alias("label"))
    named = [*keys, *[c for c, _ in scores]]
    solved = solved.unionByName(boxes.join(by_sort(stats), keys, "left").select(*named))
    out = every.join(by_sort(solved), keys, "left")
    fallback = F.coalesce(F.col("extent").cast("double"), F.col("_far"))
    mean = F.when(F.col("extent").isNull(), F.col("_far")).otherwise(
        (F.coalesce("_m0", fallback) + F.coalesce("_m1", fallback)) / 2)
    return out.select(*keys, mean.alias("mean_distance"), *[
        F.coalesce(f"_h{i}", fallback).alias(f"hausdorff_{p:g}") for i, p in enumerate(percentiles)])


def hausdorff_location(pairs: DataFrame, labels: Sequence[int] | None, shape, inclusive: bool = False) -> DataFrame:
    """Voxels where the Hausdorff distance is reached: of the gt surface if it holds any, else of the other (all ties).

    Small structures are solved whole (``blocks``).
    """
    keys = ["vol_id", "label"]
    small, points = structures(pairs, labels)

    def farthest(g: blocks.Grids):
        e = Edges(g, inclusive)
        order = np.where(e.far, -1, e.d2.astype(np.int64) * 2 + 1 - e.side)
        top = np.zeros(g.rows, np.int64)
        np.maximum.at(top, e.row, order)
        hit = order == top[e.row]
        return e.row[hit], e.side[hit], *e.at[hit].T, np.sqrt(e.d2[hit].astype(float))

    columns = [*[(c, T.IntegerType()) for c in ("side", "x", "y", "z")], ("distance", T.DoubleType())]
    solved = blocks.solve(small, keys, columns, blocks.box, farthest)
    edges, _ = surface_words_of(points, inclusive)
    far = surface_to_surface(edges).where("d2 IS NOT NULL")

    def leaders(frames):
        # What a batch outdoes cannot be a maximum: it need not be shuffled.
        for f in frames:
            yield f[f["d2"] == f.groupby([*keys, "side"], dropna=False)["d2"].transform("max")]

    far = far.mapInPandas(leaders, far.schema)
    top = far.groupBy(*keys).agg(F.max(F.struct("d2", (-F.col("side")).alias("s"))).alias("_t"))
    hit = far.join(by_sort(top), keys).where((F.col("d2") == F.col("_t.d2")) & (F.col("side") == -F.col("_t.s")))
    return solved.unionByName(hit.select(*keys, "side", "x", "y", "z", F.sqrt(F.col("d2").cast("double")).alias("distance")))


def evaluate_dataset(gt: DataFrame, seg: DataFrame, labels: Sequence[int], shape, mask: DataFrame | None = None,
                     crop_margin: int = 10, wrong: Sequence[int] | None = None, right: Sequence[int] | None = None,
                     use_nearest: bool = False, whole: bool = True, distances: bool = True,
                     gt_meta: DataFrame | None = None, seg_meta: DataFrame | None = None) -> DataFrame:
    """All scores of all pairs as long rows (vol_id, label, metric, value); label -1 is the whole structure.

    ``gt_meta`` and ``seg_meta`` (vol_id, shape, resolution, affine) turn both maps (the mask with the ground truth) to
    the identity orientation first; ``shape`` is that of the turned ground truth then and may be None. Masked voxels get the value max(labels) + 1 in both maps, pairs are cropped to the box of the ground truth with a
    margin, wrong labels of ``seg`` are corrected, then Dice and surface distances are computed.
    """
    if gt_meta is not None:
        gt, turned = align(gt, gt_meta)
        shape = turned if shape is None else shape
        mask = mask if mask is None else align(mask, gt_meta)[0]
    if seg_meta is not None:
        seg, _ = align(seg, seg_meta)
    masked = int(max(labels)) + 1
    if mask is not None:
        hit = materialize(mask.select(*VOXEL, F.lit(True).alias("_m")))
        grow = lambda d: (pair_with_mask(d, hit, masked))
        gt, seg = grow(gt), grow(seg)
    if crop_margin > 0:
        # Read for the boxes, the volumes and the pairs: written once.
        gt = materialize(gt.select(*VOXEL, "label"))
        boxes = region_box(gt.where("label > 0"), shape, margin=crop_margin)
        gt, seg = crop_to_box(gt, boxes), crop_to_box(seg, boxes)
        volumes, dims = attach_shape(gt.select("vol_id").distinct(), shape)
        n = [F.lit(d) for d in dims] if dims else [F.col("nx"), F.col("ny"), F.col("nz")]
        sized = volumes.join(by_sort(boxes), "vol_id", "left")
        shape = sized.select("vol_id", *[F.coalesce(F.col("hi")[i] - F.col("lo")[i], n[i]).alias(f"n{a}")
                                         for i, a in enumerate("xyz")])
    if wrong is not None:
        seg = correct_labels_nearest(seg, wrong) if use_nearest else correct_labels(seg, wrong, right)
    # Overlaps and surfaces read the pairs: written once, after the mask, the crop and the correction.
    pairs = materialize(pair_maps(gt, seg))
    rows = dice_by_label(pairs, labels, shape=shape).select("vol_id", "label", F.lit("dice").alias("metric"), F.col("dice").alias("value"))
    if whole:
        w = dice_whole(pairs).select("vol_id", F.lit(-1).alias("label"), F.lit("dice").alias("metric"),
                                     F.col("dice").alias("value"))
        rows = rows.unionByName(w)
    if distances:
        d = surface_distances(pairs, list(labels), shape, whole=whole)
        names = [c for c in d.columns if c not in ("vol_id", "label")]
        rows = rows.unionByName(d.unpivot(["vol_id", "label"], names, "metric", "value"))
    return rows


def pair_with_mask(df: DataFrame, mask: DataFrame, value: int) -> DataFrame:
    """Masked voxels take ``value``, also where the map has no row (background)."""
    both = df.select(*VOXEL, "label").join(by_sort(mask), VOXEL, "full")
    return both.select(*VOXEL, F.when(F.col("_m"), value).otherwise(F.col("label")).alias("label"))


# ---- cohort statistics ----------------------------------------------------------------------------------------------

def _upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: rational-exponential approximation of erfc, relative error below 1.2e-7."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # Published Chebyshev coefficients of ln(erfc(x) / t) + x^2.
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
            -0.82215223, 0.17087277]
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = F.lit(c) + t * poly
    return 0.5 * t * F.exp(-x * x + poly)


def _signed_rank_counts(n: int) -> list[int]:
    """Number of sign patterns of ranks 1..n for each rank sum."""
    ways = [1]
    for r in range(1, n + 1):
        ways = [a + b for a, b in zip(ways + [0] * r, [0] * r + ways)]
    return ways


def wilcoxon_paired(scores: DataFrame, alternative: str = "two-sided", structure: str = "structure",
                    subject: str = "subject", ref: str = "ref", cmp: str = "cmp", with_average: bool = True,
                    exact_below: int = 25, mode: str = "auto") -> DataFrame:
    """Signed-rank test per structure and, as structure 'average', on the per-subject means over structures.

    Output: structure, n, r_plus, r_minus, z, p_value, exact. Zero differences are dropped and ties get their average
    rank. ``mode``: 'auto' gives the exact p for n <= ``exact_below`` without ties or zeros, else the normal approximation
    with tie term; 'approx' always approximates; 'exact' leaves p NULL where the exact one is not defined or not tabled.
    Equal differences are counted first; ranks come from a distributed running total of the counts.
    """
    if mode not in ("auto", "exact", "approx"):
        raise ValueError(f"mode should be auto, exact or approx, had {mode}")
    rows = scores.select(F.col(structure).cast("string").alias("structure"), F.col(subject).alias("_s"),
                         F.col(ref).alias("_a"), F.col(cmp).alias("_b"))
    if with_average:
        mean = rows.groupBy("_s").agg(F.avg("_a").alias("_a"), F.avg("_b").alias("_b"))
        rows = rows.unionByName(mean.select(F.lit("average").alias("structure"), "_s", "_a", "_b"))
    d = rows.select("structure", (F.col("_a") - F.col("_b")).alias("_d"))
    counts = d.groupBy("structure", F.abs("_d").alias("_abs")).agg(
        F.count("*").alias("_c"), F.count_if(F.col("_d") > 0).alias("_plus"))
    zeros = counts.groupBy("structure").agg(F.sum(F.when(F.col("_abs") == 0, F.col("_c")).otherwise(0)).alias("_zeros"))
    ranked = running_total(counts.where("_abs > 0"), ["structure"], ["_abs"], F.col("_c"), "_cum")
    rank = F.col("_cum") - (F.col("_c") - 1) / 2
    c = F.col("_c").cast("double")
    stat = ranked.groupBy("structure").agg(
        F.sum("_c").alias("n"), F.sum(rank * F.col("_plus")).alias("r_plus"),
        F.sum(rank * (F.col("_c") - F.col("_plus"))).alias("r_minus"), F.sum(c * c * c - c).alias("_ties"))
    stat = beside(stat, zeros, ["structure"])
    n = F.col("n").cast("double")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * F.col("_ties")) / 24)
    t = F.least("r_plus", "r_minus") if alternative == "two-sided" else F.col("r_plus")
    stat = stat.withColumn("z", (t - n * (n + 1) / 4) / se)
    tail = _upper_tail(F.abs("z"))
    upper = F.when(F.col("z") >= 0, tail).otherwise(1 - tail)
    approx = {"two-sided": 2 * tail, "greater": upper, "less": 1 - upper}[alternative]
    is_exact = F.lit(mode != "approx") & (F.col("n") <= exact_below) & (F.col("_ties") == 0) & (F.col("_zeros") == 0)
    # Tail probabilities of small samples, one literal array per n, made from the counting rule above.
    lower, upper_tail = [], []
    for k in range(1, exact_below + 1):
        ways = _signed_rank_counts(k)
        below = list(accumulate(ways))
        lower.append([v / 2.0 ** k for v in below])
        upper_tail.append([(2 ** k - v + w) / 2.0 ** k for v, w in zip(below, ways)])
    spark = scores.sparkSession
    table = spark.createDataFrame([(k + 1, lower[k], upper_tail[k]) for k in range(exact_below)],
                                  "n bigint, _below array<double>, _above array<double>")
    at = (F.when(is_exact, t).otherwise(0)).cast("int")
    exact = {"two-sided": F.least(F.lit(1.0), 2 * F.col("_below")[at]), "greater": F.col("_above")[at],
             "less": F.col("_below")[at]}[alternative]
    return (stat.join(table, "n", "left")
            .select("structure", "n", "r_plus", "r_minus", "z", F.when(is_exact, exact).otherwise(F.lit(None) if mode == "exact" else approx).alias("p_value"),
                    is_exact.alias("exact")))


def cohens_d(scores: DataFrame, group: str = "structure", x: str = "ref", y: str = "cmp") -> DataFrame:
    """Effect size per group; pooled from population variances weighted by n - 1."""
    a = scores.groupBy(F.col(group).alias(group)).agg(
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
        F.count(x).alias("_nx"), F.count(y).alias("_ny"))
    dof = F.col("_nx") + F.col("_ny") - 2
    pooled = F.sqrt(F.try_divide((F.col("_nx") - 1) * F.col("_vx") + (F.col("_ny") - 1) * F.col("_vy"), dof))
    return a.select(group, F.try_divide(F.col("_mx") - F.col("_my"), pooled).alias("cohens_d"))


# ---- soft scores ----------------------------------------------------------------------------------------------------

def pair_posteriors(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(vol_id, x, y, z, label, g, p) from two sparse posterior tables; absent = 0."""
    at = [*VOXEL, "label"]
    a = gt.select(*at, F.col("p").alias("g"), F.lit(0.0).alias("p"))
    b = pred.select(*at, F.lit(0.0).alias("g"), "p")
    return a.unionByName(b).groupBy(*at).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def _checked(pairs: DataFrame, log_safe: bool = False) -> DataFrame:
    w = Window.partitionBy(*VOXEL)
    g = F.col("g") / (F.sum("g").over(w) + EPSILON)
    p = F.col("p") / (F.sum("p").over(w) + EPSILON)
    low, high = (EPSILON, 1 - EPSILON) if log_safe else (0.0, 1.0)
    return pairs.withColumns({"g": F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0)),
                              "p": F.least(F.greatest(p, F.lit(low)), F.lit(high))})


def _weighted(pairs: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Attach boundary weights (vol_id, label, x, y, z, weight); 1 where none is given."""
    if weights is None:
        return pairs.withColumn("weight", F.lit(1.0))
    return pairs.join(by_sort(weights), [*VOXEL, "label"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def soft_dice(pairs: DataFrame, checks: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """Per volume and label: dice = (sum 2gp + eps) / (sum g^2 + p^2 + eps), loss = 1 - dice, gt_volume."""
    df = _weighted(_checked(pairs) if checks else pairs, weights)
    w, g, p = F.col("weight"), F.col("g"), F.col("p")
    return df.groupBy("vol_id", "label").agg(
        ((F.sum(2 * g * p * w) + EPSILON) / (F.sum((g * g + p * p) * w) + EPSILON)).alias("dice"),
        F.sum(g * w).alias("gt_volume")).withColumn("loss", 1 - F.col("dice"))


def weighted_loss(per_label: DataFrame, class_weights: dict[int, float] | int | None = None,
                  loss: str = "loss") -> DataFrame:
    """Loss per volume: mean over labels, or weighted by ``class_weights`` (-1: inverse gt volume), normalised."""
    if class_weights is None:
        return per_label.groupBy("vol_id").agg(F.avg(loss).alias(loss))
    if class_weights == -1:
        w = F.try_divide(F.lit(1.0), F.col("gt_volume"))
    else:
        w = F.create_map(*[F.lit(v) for kv in class_weights.items() for v in (int(kv[0]), float(kv[1]))])[F.col("label")]
    return (per_label.withColumn("_w", w).groupBy("vol_id")
            .agg(F.try_divide(F.sum(F.col(loss) * F.col("_w")), F.sum("_w")).alias(loss)))


def cross_entropy(pairs: DataFrame, n_voxels: int | Column | None = None, weights: DataFrame | None = None,
                  class_weights: dict[int, float] | None = None, checks: bool = True) -> DataFrame:
    """Mean over voxels of -g log p, p clipped away from 0 and 1. ``n_voxels`` defaults to the voxels that have rows.

    Rows with g = 0 add nothing, so sparse input is exact.
    """
    df = _weighted(_checked(pairs, True) if checks else pairs, weights)
    term = F.when(F.col("g") > 0, -F.col("g") * F.ln("p") * F.col("weight")).otherwise(0.0)
    if class_weights is not None:
        total = float(sum(class_weights.values()))
        cw = F.create_map(*[F.lit(v) for k, x in class_weights.items() for v in (int(k), float(x) / total)])
        term = term * cw[F.col("label")]
    per_voxel = df.groupBy(*VOXEL).agg(F.sum(term).alias("_t"))
    n = F.count("*") if n_voxels is None else (n_voxels if isinstance(n_voxels, Column) else F.lit(int(n_voxels)))
    return per_voxel.groupBy("vol_id").agg((F.sum("_t") / n).alias("cross_entropy"))


def centroid_distance(pairs: DataFrame) -> DataFrame:
    """Distance between the probability-weighted centroids of each label."""
    sums = pairs.groupBy("vol_id", "label").agg(
        *[F.sum(F.col(s) * F.col(a)).alias(f"_{s}{a}") for s in ("g", "p") for a in "xyz"],
        F.sum("g").alias("gt_volume"), F.sum("p").alias("_p"))
    total = None
    for a in "xyz":
        d = F.col(f"_g{a}") / (F.col("gt_volume") + EPSILON) - F.col(f"_p{a}") / (F.col("_p") + EPSILON)
        total = d * d if total is None else total + d * d
    return sums.select("vol_id", "label", F.sqrt(total).alias("distance"), "gt_volume")


# ---- quality scores -------------------------------------------------------------------------------------------------

def qc_difference(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Predicted score minus true Dice per volume and label: (vol_id, label, score) and (vol_id, label, dice)."""
    return pred.join(true, ["vol_id", "label"]).select("vol_id", "label", (F.col("score") - F.col("dice")).alias("difference"))


def qc_clip_round(df: DataFrame, background: int = 0, score: str = "score") -> DataFrame:
    """Drop the background score, clip to 0..1, 4 decimals."""
    clipped = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    return df.where(F.col("label") != background).withColumn(score, F.bround(clipped, 4))


def epoch_of(folder: Column) -> Column:
    return F.regexp_replace(folder, "[^0-9]", "").cast("int")


def validation_curve(scores: DataFrame, group: Sequence[str] = (), score: str = "score", best: str = "max",
                     rows: Sequence | None = None, row: str = "structure") -> DataFrame:
    """Mean absolute score per epoch folder, flagged where it is the best ('max' or 'min'; first epoch on ties).

    ``rows``: the score rows to average, by their value in column ``row``; all without it.
    """
    if rows is not None:
        scores = scores.where(F.col(row).isin(list(rows)))
    curve = (scores.withColumn("epoch", epoch_of(F.col("epoch_dir")))
             .groupBy(*group, "epoch").agg(F.avg(F.abs(score)).alias("mean_score")))
    order = F.col("mean_score").desc() if best == "max" else F.col("mean_score").asc()
    # One row per epoch: the window sorts a validation history, never scores.
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(order, F.col("epoch"))
    return curve.withColumn("is_best", F.row_number().over(w) == 1)
