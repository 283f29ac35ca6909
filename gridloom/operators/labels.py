"""Label dictionaries and relabelling.

Dictionaries given as Python lists are small by construction (the lists a user types) and become literal maps or
CASE expressions inside the scan stage: no join, no shuffle. Dictionaries given as tables are joined, and Spark
broadcasts them only if their size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.layout import by_sort
from gridloom.operators import blocks
from gridloom.operators.lines import distance_to
from gridloom.operators.morphology import component_runs, from_runs, outer_rim, to_runs
from gridloom.operators.neighbourhood import nearest_label, smooth_labels
from gridloom.session import materialize

VOXEL = ["vol_id", "x", "y", "z"]

# Sides of the label numbers; neutral ones one by one, the others as closed ranges.
NEUTRAL_LABELS = [
    0, 14, 15, 16, 21, 22, 23, 24, 72, 77, 80, 85, 100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 165, 200, 201,
    202, 203, 204, 205, 206, 207, 208, 209, 210, 251, 252, 253, 254, 255, 258, 259, 260, 331, 332, 333, 334, 335,
    336, 337, 338, 339, 340, 502, 506, 507, 508, 509, 511, 512, 514, 515, 516, 517, 530, 531, 532, 533, 534, 535,
    536, 537,
]
LEFT_RANGES = [(1, 13), (17, 20), (25, 39), (136, 138), (865, 865), (1000, 1035), (20101, 20109)]
RIGHT_RANGES = [(40, 71), (139, 139), (163, 164), (866, 866), (2000, 2035), (20001, 20009)]

# The 33 segmentation labels in posterior channel order, with their structure names.
STRUCTURES = [
    (0, "background"), (2, "left cerebral white matter"), (3, "left cerebral cortex"), (4, "left lateral ventricle"),
    (5, "left inferior lateral ventricle"), (7, "left cerebellum white matter"), (8, "left cerebellum cortex"),
    (10, "left thalamus"), (11, "left caudate"), (12, "left putamen"), (13, "left pallidum"), (14, "3rd ventricle"),
    (15, "4th ventricle"), (16, "brain-stem"), (17, "left hippocampus"), (18, "left amygdala"),
    (26, "left accumbens area"), (24, "CSF"), (28, "left ventral DC"), (41, "right cerebral white matter"),
    (42, "right cerebral cortex"), (43, "right lateral ventricle"), (44, "right inferior lateral ventricle"),
    (46, "right cerebellum white matter"), (47, "right cerebellum cortex"), (49, "right thalamus"),
    (50, "right caudate"), (51, "right putamen"), (52, "right pallidum"), (53, "right hippocampus"),
    (54, "right amygdala"), (58, "right accumbens area"), (60, "right ventral DC"),
]


def _in_ranges(label: Column, ranges) -> Column:
    test = F.lit(False)
    for lo, hi in ranges:
        test = test | label.between(lo, hi)
    return test


def side_of(label: Column) -> Column:
    """'neutral', 'left', 'right', or NULL for a number without a side."""
    return (F.when(label.isin(NEUTRAL_LABELS), "neutral")
            .when(_in_ranges(label, LEFT_RANGES), "left").when(_in_ranges(label, RIGHT_RANGES), "right"))


def label_dictionary(spark) -> DataFrame:
    """(ord, label, name, side) of the segmentation labels."""
    rows = [(i, lab, name) for i, (lab, name) in enumerate(STRUCTURES)]
    return spark.createDataFrame(rows, "ord int, label int, name string").withColumn("side", side_of(F.col("label")))


def label_list(*maps: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels over all maps; partial aggregation keeps one row per label and task before the shuffle."""
    out = maps[0].select(F.col(label).alias("label"))
    for m in maps[1:]:
        out = out.union(m.select(F.col(label)))
    return out.distinct()


def sort_by_side(labels: DataFrame) -> DataFrame:
    """Order labels neutral, left, right. Adds side, ord and n_neutral (all labels if one side is missing).

    Works on a label list, a few hundred rows at most; an unknown number raises an error.
    """
    side = side_of(F.col("label"))
    known = labels.select("label").distinct().withColumn("side", F.coalesce(side, F.raise_error(
        F.concat(F.lit("label not in the classification: "), F.col("label").cast("string")))))
    rank = F.when(F.col("side") == "neutral", 0).when(F.col("side") == "left", 1).otherwise(2)
    everything = Window.partitionBy(F.lit(1))
    count = lambda s: F.count(F.when(F.col("side") == s, 1)).over(everything)
    both_or_none = (count("left") > 0) == (count("right") > 0)
    return (
        known.withColumn("n_neutral", F.when(both_or_none, count("neutral")).otherwise(F.count("*").over(everything)))
        .withColumn("ord", F.row_number().over(everything.orderBy(rank, "label")) - 1)
        .select("ord", "label", "side", "n_neutral")
    )


def literal_map(source: Sequence, target: Sequence) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(zip(source, target))])


def convert_labels(df: DataFrame, source: Sequence[int], target: Sequence[int] | None = None,
                   label: str = "label", on_missing: str = "zero") -> DataFrame:
    """Value map; the default target is the position in the list. A label outside ``source`` becomes 0, or raises an
    error above the largest source value, or always with on_missing='error'."""
    target = list(range(len(source))) if target is None else list(target)
    found = literal_map([int(s) for s in source], [int(t) for t in target])[F.col(label)]
    problem = F.raise_error(F.concat(F.lit("label outside the list: "), F.col(label).cast("string"))).cast("int")
    if on_missing == "error":
        missing = problem
    else:
        missing = F.when(F.col(label) > int(max(source)), problem).otherwise(F.lit(0))
    return df.withColumn(label, F.coalesce(found, missing))


def convert_labels_by_table(df: DataFrame, table: DataFrame, label: str = "label") -> DataFrame:
    """Same with a (source, target) table of any size."""
    found = df.join(table.select(F.col("source").alias(label), F.col("target").alias("_t")), label, "left")
    return found.withColumn(label, F.coalesce("_t", F.lit(0))).drop("_t")


def reset_labels(df: DataFrame, values: Sequence[int], label: str = "label") -> DataFrame:
    return df.withColumn(label, F.when(F.col(label).isin(list(values)), 0).otherwise(F.col(label)))


def keep_labels(df: DataFrame, values: Sequence[int], fill: int = 0, label: str = "label",
                mask: str | None = None) -> DataFrame:
    """Labels outside ``values`` become ``fill``; ``mask`` adds the 0/1 mask under that name."""
    keep = F.col(label).isin(list(values))
    if mask:
        df = df.withColumn(mask, keep.cast("int"))
    return df.withColumn(label, F.when(keep, F.col(label)).otherwise(fill))


def correct_labels(df: DataFrame, wrong: Sequence[int], right: Sequence[int], label: str = "label",
                   smooth_shape=None) -> DataFrame:
    """Replace values, always judged on the input map. ``smooth_shape``: grid shape, to smooth afterwards with the
    full 3x3x3 neighbourhood."""
    new = F.coalesce(literal_map([int(v) for v in wrong], [int(v) for v in right])[F.col(label)], F.col(label))
    out = df.withColumn(label, new)
    return smooth_labels(out, smooth_shape, cube=True, label=label) if smooth_shape is not None else out


def correct_labels_candidates(df: DataFrame, wrong: int, candidates: Sequence[int], label: str = "label",
                              smooth_shape=None) -> DataFrame:
    """Every ``wrong`` voxel takes the candidate with the nearest voxel in its volume, the first one on ties.

    Candidate voxels that cannot be nearest, the inner ones, are dropped before the transform. A volume without any
    candidate keeps its value. ``smooth_shape``: as in ``correct_labels``.
    """
    ordinal = literal_map([int(c) for c in candidates], list(range(len(candidates))))
    voxels = df.select(*VOXEL, F.col(label).alias("_label"))
    seeds = materialize(surface_of(voxels.where(F.col("_label").isin(list(candidates))), ["vol_id", "_label"])
                        .withColumn("_ord", ordinal[F.col("_label")]))
    bad = voxels.where(F.col("_label") == wrong).select(*VOXEL)
    near = distance_to(bad, seeds, ["vol_id"], "_d2", "_ord", len(candidates), "_best")
    fixed = F.element_at(F.array(*[F.lit(int(c)) for c in candidates]), F.col("_best") + 1)
    near = near.select(*VOXEL, F.when(F.col("_d2").isNotNull(), fixed).alias("_new"))
    out = df.join(by_sort(near), VOXEL, "left").withColumn(label, F.coalesce("_new", F.col(label))).drop("_new")
    return smooth_labels(out, smooth_shape, cube=True, label=label) if smooth_shape is not None else out


def surface_of(mask: DataFrame, keys: list[str]) -> DataFrame:
    """True voxels with a false face neighbour; only they can be the nearest true voxel of an outside point."""
    from gridloom.operators.morphology import face_neighbours
    inner = F.col("xm") & F.col("xp") & F.col("ym") & F.col("yp") & F.col("zm") & F.col("zp")
    return face_neighbours(mask, keys).where(~inner).drop("xm", "xp", "ym", "yp", "zm", "zp")


def correct_labels_nearest(df: DataFrame, wrong: Sequence[int], remove_zero: bool = False, label: str = "label",
                           smooth_shape=None) -> DataFrame:
    """Each connected region of a wrong label takes, voxel by voxel, the nearest other label found in its box.

    The box reaches one voxel below the region and ends at its last voxel. Labels listed in ``wrong`` (and 0 with
    ``remove_zero``) are no candidates; without any candidate the result is -1. Ties go to the smallest label. Where
    boxes of one label overlap, the later region in raster order decides. ``df`` must hold the background as rows
    if 0 is to be a candidate. ``smooth_shape``: as in ``correct_labels``. Small volumes are corrected whole (``blocks``).
    """
    wrong = [int(w) for w in wrong]
    kind = df.schema[label].dataType
    if {*df.columns} == {*VOXEL, label} and isinstance(kind, (T.IntegerType, T.LongType)):
        packed = blocks.pack(df, ["vol_id"], label)
        listed = ", ".join(f"{w}L" for w in wrong) or "NULL"
        packed = packed.withColumn("_w", F.expr(f"size(filter(_v, v -> v IN ({listed}))) * CAST(size(_v) AS BIGINT)"))
        whole, rest = blocks.split(packed, ["vol_id"], f"{blocks.LARGE} OR {blocks.TWICE} OR array_min(_lo) < 0 OR _w > {blocks.PAIRS}")
        solved = blocks.solve(whole, ["vol_id"], [*[(a, T.IntegerType()) for a in "xyz"], (label, T.LongType())], blocks.box,
                              lambda g: _nearest_whole(g, wrong, [*wrong, *([0] if remove_zero else [])]))
        far = blocks.unpack(rest, ["vol_id"], label).withColumn(label, F.col(label).cast(kind)).unionByName(
            df.where("x IS NULL OR y IS NULL OR z IS NULL"))
        out = solved.withColumn(label, F.col(label).cast(kind)).unionByName(_correct_by_rows(far, wrong, remove_zero, label)).select(*df.columns)
    else:
        out = _correct_by_rows(df, wrong, remove_zero, label)
    return smooth_labels(out, smooth_shape, cube=True, label=label) if smooth_shape is not None else out


def _nearest_whole(g: blocks.Grids, wrong: list[int], barred: list[int]):
    """Voxels of small volumes, each listed once, with their corrected label."""
    new, null = g.value.copy(), g.value == blocks.NULL
    for w in wrong:
        bad = g.value == w
        label = blocks.components(g.mask(bad), 6)
        cells = int(np.prod(label.shape[1:]))
        points = np.flatnonzero(bad)
        if not len(points):
            continue
        # Components in raster order within their row, their boxes, and the row they belong to.
        ids, comp = np.unique(g.row[points] * cells + label[g.cell(g.row[points], g.at[points])], return_inverse=True)
        order = np.argsort(comp, kind="stable")
        first = np.searchsorted(comp[order], np.arange(len(ids)))
        low = np.maximum(np.minimum.reduceat(g.at[points][order], first) - 1, 0)
        high = np.maximum.reduceat(g.at[points][order], first)
        row = ids // cells
        # Every component beside every voxel of its row.
        start = np.cumsum(g.count) - g.count
        of = np.repeat(np.arange(len(ids)), g.count[row])
        voxel = np.arange(len(of)) - np.repeat(np.cumsum(g.count[row]) - g.count[row], g.count[row]) + start[row][of]
        inside = ((g.at[voxel] >= low[of]) & (g.at[voxel] <= high[of])).all(axis=1)
        of, voxel = of[inside], voxel[inside]
        # The last region whose box holds a voxel owns it.
        mine = bad[voxel]
        owner = np.full(len(g.row), -1)
        np.maximum.at(owner, voxel[mine], of[mine])
        candidate = ~np.isin(g.value[voxel], barred) & ~null[voxel]
        seed_of, seed = of[candidate], voxel[candidate]
        many = np.bincount(seed_of, minlength=len(ids))
        at = np.cumsum(many) - many
        each = many[owner[points]]
        point = np.repeat(points, each)
        other = seed[np.arange(len(point)) - np.repeat(np.cumsum(each) - each, each) + at[owner[point]]]
        d2 = ((g.at[point] - g.at[other]) ** 2).sum(axis=1)
        values, rank = np.unique(g.value[other], return_inverse=True)
        best = np.full(len(g.row), np.iinfo(np.int64).max)
        np.minimum.at(best, point, d2 << 32 | rank)
        new[points] = -1
        hit = points[each > 0]
        new[hit] = values[best[hit] & 0xFFFFFFFF]
    return g.row, *g.at.T, pa.array(new, pa.int64(), mask=null)


def _correct_by_rows(df: DataFrame, wrong: list[int], remove_zero: bool, label: str) -> DataFrame:
    """``correct_labels_nearest`` by joins of rows, without smoothing."""
    voxels = df.select(*VOXEL, F.col(label).alias("_label"))
    bad = voxels.where(F.col("_label").isin(wrong))
    runs = component_runs(to_runs(bad, ["vol_id", "_label"]), ["vol_id", "_label"], 6)
    boxes = runs.groupBy("vol_id", "_label", "comp").agg(
        *[F.greatest(F.min(c) - 1, F.lit(0)).alias(f"_{n}0") for n, c in (("x", "x"), ("y", "y"), ("z", "z0"))],
        *[F.max(c).alias(f"_{n}1") for n, c in (("x", "x"), ("y", "y"), ("z", "z1"))])
    # Boxes as lines, so that the containment join is an equi-join on (vol, x, y) with a z-range left over.
    lines = (boxes.select("vol_id", F.col("_label").alias("_wrong"), "comp", "_y0", "_y1", "_z0", "_z1",
                          F.explode(F.sequence("_x0", "_x1")).alias("x"))
             .select("vol_id", "_wrong", "comp", "x", F.explode(F.sequence("_y0", "_y1")).alias("y"), "_z0", "_z1"))
    # Read for the regions and for the candidates: written once.
    inside = materialize(voxels.join(by_sort(lines), ["vol_id", "x", "y"]).where(F.col("z").between(F.col("_z0"), F.col("_z1")))
                         .drop("_z0", "_z1"))
    owner = (inside.where(F.col("_label") == F.col("_wrong"))
             .groupBy(*VOXEL, "_wrong").agg(F.max("comp").alias("comp")))
    not_candidate = wrong + ([0] if remove_zero else [])
    seeds = inside.where(~F.col("_label").isin(not_candidate))
    near = nearest_label(owner.select(*VOXEL, "_wrong", "comp"), seeds.withColumnRenamed("_label", "_cand")
                       .select("vol_id", "_wrong", "comp", "x", "y", "z", "_cand"),
                       ["vol_id", "_wrong", "comp"])
    near = near.select(*VOXEL, F.when(F.col("_d2").isNull(), -1).otherwise(F.col("_new")).alias("_new"))
    return df.join(by_sort(near), VOXEL, "left").withColumn(label, F.coalesce("_new", F.col(label))).drop("_new")


def check_classes(classes: Sequence[int]) -> int:
    """Number of classes; they must be exactly 0..K-1."""
    unique = sorted(set(classes))
    if unique != list(range(len(unique))):
        raise ValueError(f"classes should be exactly 0..K-1, had {unique}")
    return len(unique)


def group_classes(df: DataFrame, labels: Sequence[int], classes: Sequence[int], label: str = "label") -> DataFrame:
    """Keep voxels of the listed labels and add their ``class_id``."""
    check_classes(classes)
    return (df.where(F.col(label).isin(list(labels)))
            .withColumn("class_id", literal_map([int(v) for v in labels], [int(c) for c in classes])[F.col(label)]))


def flip_pairs(labels: DataFrame) -> DataFrame:
    """(label, flipped): left and right labels of a side-sorted list are paired by rank, neutral ones by themselves."""
    ranked = labels.withColumn("_r", F.row_number().over(Window.partitionBy("side").orderBy("label")))
    left = ranked.where("side = 'left'").select("_r", F.col("label").alias("l"))
    right = ranked.where("side = 'right'").select("_r", F.col("label").alias("r"))
    pairs = left.join(right, "_r")
    return (pairs.select(F.col("l").alias("label"), F.col("r").alias("flipped"))
            .unionByName(pairs.select(F.col("r").alias("label"), F.col("l").alias("flipped")))
            .unionByName(ranked.where("side = 'neutral'").select("label", F.col("label").alias("flipped"))))


def flip_pairs_literal(ordered: Sequence[int], n_neutral: int) -> dict[int, int]:
    """The same for a typed list ordered neutral, left, right."""
    half = (len(ordered) - n_neutral) // 2
    left, right = ordered[n_neutral:n_neutral + half], ordered[n_neutral + half:]
    out = {v: v for v in ordered[:n_neutral]}
    out.update(zip(left, right))
    out.update(zip(right, left))
    return out


def name_labels(labels: DataFrame, dictionary: DataFrame, total_name: str = "total intracranial") -> DataFrame:
    """Attach names to a label list and append the pseudo-label max+1 for the total."""
    named = labels.join(dictionary.select("label", "name"), "label", "left")
    total = labels.agg((F.max("label") + 1).cast("int").alias("label")).withColumn("name", F.lit(total_name))
    return named.select("label", "name").unionByName(total)


def one_hot(df: DataFrame, labels: Sequence[int], label: str = "label", sparse: bool = True) -> DataFrame:
    """Hard labels to posteriors. The sparse form keeps only rows with p = 1."""
    rest = [c for c in df.columns if c != label]
    if sparse:
        return (df.where(F.col(label).isin(list(labels)))
                .select(*rest, F.col(label).alias("label"), F.lit(1.0).alias("p")))
    listed = F.explode(F.array(*[F.lit(int(v)) for v in labels]))
    return (df.withColumn("_hard", F.col(label)).select(*rest, "_hard", listed.alias("label"))
            .select(*rest, "label", (F.col("label") == F.col("_hard")).cast("double").alias("p")))


def labels_to_keep(df: DataFrame, listed: Sequence[int], label: str = "label") -> DataFrame:
    """Labels of each volume that are not in the list."""
    return df.where(~F.col(label).isin(list(listed))).select("vol_id", F.col(label).alias("label")).distinct()
