"""Small volumes solved whole: the same results as slab by slab, and hardly a row moved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import blocks
from gridloom.operators import evaluate as ev
from gridloom.operators import geometry as ge
from gridloom.operators import labels as lb
from gridloom.operators import morphology as mo
from gridloom.operators import neighbourhood as nb

V = ["vol_id", "x", "y", "z"]
SHAPE = (9, 8, 7)


@pytest.fixture(scope="module")
def small(spark):
    """Random masks of three volumes."""
    noise = np.random.default_rng(5).random((3, *SHAPE)) < 0.8
    rows = [(int(v), int(x), int(y), int(z)) for v, x, y, z in np.argwhere(noise)]
    return noise, spark.createDataFrame(rows, "vol_id long, x int, y int, z int").repartition(5)


def rows_moved(df) -> int:
    """Rows that the shuffles of a plan wrote when it ran."""
    df.collect()

    def count(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return count(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return count(plan.plan())
        metric = plan.metrics().get("shuffleRecordsWritten")
        own = metric.get().value() if metric.isDefined() else 0
        children = plan.children()
        return own + sum(count(children.apply(i)) for i in range(children.size()))
    return count(df._jdf.queryExecution().executedPlan())


def listed(df, *more) -> list[tuple]:
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*V, *more).collect())


def brute(mask: np.ndarray) -> np.ndarray:
    """Distance of each cell to the nearest false one."""
    out = np.argwhere(~mask)
    cells = np.argwhere(np.ones_like(mask))
    d2 = ((cells[:, None] - out[None]) ** 2).sum(axis=2).min(axis=1)
    return np.sqrt(d2).reshape(mask.shape)


def test_voxels_are_packed_and_unpacked(spark):
    rows = [(1, 0, 0, 0, 5), (1, 15, -3, 70, None), (1, 16, 2, 3, -7), (1, -1, 9, 1 << 20, 0), (None, 3, 3, 3, 1), (None, 3, 3, 3, 1), (2, 5, 5, 5, 2)]
    df = spark.createDataFrame(rows, "vol_id long, x int, y int, z int, v int").repartition(3)
    packed = blocks.pack(df, ["vol_id"], "v")
    assert packed.count() == 5
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, blocks.unpack(packed, ["vol_id"], "v").collect()), key=key) == sorted(rows, key=key)
    whole, rest = blocks.split(packed, ["vol_id"], blocks.LARGE)
    assert {r.vol_id for r in whole.collect()} == {2} and {r.vol_id for r in rest.collect()} == {None, 1}


def test_holes_of_small_volumes_are_filled_where_they_are(small):
    noise, mask = small
    out = mo.fill_holes(mask, SHAPE)
    assert rows_moved(out) == 0
    assert listed(out) == listed(mo._fill_linked(mask, SHAPE, ["vol_id"])) != listed(mask)


def test_holes_by_size_of_the_volume(spark, small):
    """One job with volumes solved whole, one that spans slabs, and a table of shapes that does not list them all."""
    noise, mask = small
    hollow = np.ones((20, 5, 5), bool)
    hollow[2:18, 2, 2] = False
    wide = spark.createDataFrame([(7, *map(int, p)) for p in np.argwhere(hollow)], "vol_id long, x int, y int, z int")
    shape = spark.createDataFrame([(0, *SHAPE), (7, 20, 5, 5)], "vol_id long, nx int, ny int, nz int")
    got = listed(mo.fill_holes(mask.where("vol_id = 0").unionByName(wide), shape))
    assert [r for r in got if r[0] == 7] == [(7, *map(int, p)) for p in np.argwhere(np.ones_like(hollow))]
    assert [r for r in got if r[0] == 0] == listed(mo.fill_holes(mask.where("vol_id = 0"), SHAPE))


def test_distances_of_small_volumes_are_found_where_they_are(small):
    noise, mask = small
    out = nb.edt(mask, SHAPE)
    assert rows_moved(out) == 0
    want = [(v, x, y, z, round(float(brute(noise[v])[x, y, z]), 6)) for v, x, y, z in listed(mask)]
    assert listed(out, "distance") == want


def test_signed_distances_of_small_volumes_are_found_where_they_are(small):
    noise, mask = small
    out = nb.signed_distance(mask.withColumn("label", F.lit(3)), SHAPE)
    assert rows_moved(out) == 0
    want = [(v, *map(int, p), round(float(brute(noise[v])[tuple(p)] - 0.5 if noise[v][tuple(p)] else 0.5 - brute(~noise[v])[tuple(p)]), 6))
            for v in range(3) for p in np.argwhere(np.ones(SHAPE, bool))]
    assert listed(out, "distance") == want


def test_long_lines_take_the_envelope(spark):
    mask = spark.createDataFrame([(1, 0, y, 0) for y in range(10, 91)], "vol_id long, x int, y int, z int")
    got = {r.y: r.distance for r in nb.edt(mask, (1, 100, 1)).collect()}
    assert got == {y: min(y - 9, 91 - y) for y in range(10, 91)}
    whole = nb.edt(mask, (1, 91, 1)).where("y = 90").head().distance
    assert whole == 81


def test_surfaces_of_small_structures_are_met_where_they_are(spark):
    """Equal to the words, slab by slab; also where one map lacks the label, the box has no inside, or a pair comes twice."""
    rng = np.random.default_rng(3)
    gt, seg = (rng.choice([0, 1, 2], (4, *SHAPE), p=[0.4, 0.4, 0.2]) for _ in range(2))
    gt[1][gt[1] == 2] = 0
    gt[2], seg[2] = 0, 0
    gt[2][3, 3, 3] = seg[2][3, 3, 3] = 1
    rows = [(int(v), int(x), int(y), int(z), int(gt[v, x, y, z]), int(seg[v, x, y, z])) for v, x, y, z in np.ndindex(gt.shape)]
    pairs = spark.createDataFrame(rows + rows[:100], "vol_id long, x int, y int, z int, gt int, seg int").repartition(5)
    wide = lambda d: d.withColumn("x", F.col("x") + 12)  # in two slabs: nothing is solved whole
    for inclusive in (False, True):
        score = lambda d: sorted(tuple(round(v, 9) for v in r) for r in ev.surface_distances(d, [1, 2], SHAPE, inclusive=inclusive, whole=True).collect())
        assert score(pairs) == score(wide(pairs)) and len(score(pairs)) == 12
        place = lambda d, by: sorted((r.vol_id, r.label, r.side, r.x - by, r.y, r.z, r.distance) for r in ev.hausdorff_location(d, [1, 2], SHAPE, inclusive).collect())
        assert place(pairs, 0) == place(wide(pairs), 12) != []


def test_surfaces_of_small_structures_are_not_shuffled(spark, small):
    pairs = small[1].selectExpr("vol_id", "x", "y", "z", "1 AS gt", "IF(x > 2, 1, 0) AS seg")
    assert rows_moved(ev.hausdorff_location(pairs, [1], SHAPE)) == 0
    # Beside what lists the volumes, one row of scores for each structure.
    assert rows_moved(ev.surface_distances(pairs, [1], SHAPE)) <= rows_moved(pairs.select("vol_id").distinct()) + 3 + 3


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_of_grids(connectivity):
    """Noise, a snake through a whole grid, and an empty row."""
    noise = np.random.default_rng(2).random((4, 6, 7, 8)) < 0.35
    noise[1] = False
    noise[1, 0::2] = True
    noise[1, 1::4, -1, -1] = noise[1, 3::4, 0, 0] = True
    noise[2] = False
    from test_grids import flood
    got = blocks.components(noise, connectivity)
    for mask, label in zip(noise, got):
        own, comps = flood(mask, connectivity)
        want = {p: np.ravel_multi_index(comps[c][0], mask.shape) for p, c in own.items()} if isinstance(own, dict) else {
            tuple(p): np.ravel_multi_index(comps[own[tuple(p)]][0], mask.shape) for p in np.argwhere(mask)}
        assert {tuple(p): label[tuple(p)] for p in np.argwhere(mask)} == want
        assert (label[~mask] == mask.size).all()


@pytest.fixture(scope="module")
def labelled(spark):
    """Noise on grids of two sizes, the voxels of one volume listed twice, meta with turned axes and one volume listed twice."""
    rng = np.random.default_rng(11)
    label = rng.choice([0, 3, 5], (5, *SHAPE), p=[0.75, 0.15, 0.1])
    rows = [(int(v), int(x), int(y), int(z), int(label[v, x, y, z])) for v, x, y, z in np.ndindex(label.shape)]
    rows += [r for r in rows if r[0] == 1]
    df = spark.createDataFrame(rows, "vol_id long, x int, y int, z int, label int").repartition(5)
    axes = [[[0, -1, 0], [2, 0, 0], [0, 0, 1]], [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[0, 0, -1], [0, 3, 0], [-1, 0, 0]], [[-1, 0, 0], [0, 0, 1], [0, 1, 0]]]
    meta = [(v, *(SHAPE if v != 3 else (20, 9, 9)), [[*map(float, r), 1.0] for r in axes[v]] + [[0.0, 0.0, 0.0, 1.0]]) for v in range(4)]
    return df, spark.createDataFrame(meta + meta[2:3], "vol_id long, nx int, ny int, nz int, affine array<array<double>>").coalesce(1)


def both_ways(monkeypatch, run):
    """Results with small volumes solved whole, and with none."""
    whole = run()
    with monkeypatch.context() as m:
        m.setattr(blocks, "LARGE", "true")
        return whole, run()


def test_crops_to_one_size_are_the_same_both_ways(monkeypatch, labelled):
    """Volumes without meta are left out, and those listed twice come as often as before."""
    df, meta = labelled
    def run():
        out, boxes, _ = ge.crop_same_size(df, meta, 1)
        return listed(out, "label"), sorted(map(tuple, boxes.collect()))
    whole, slabs = both_ways(monkeypatch, run)
    assert whole == slabs and {r[0] for r in whole[0]} == {0, 1, 2, 3}


def test_crops_of_small_volumes_are_not_shuffled(labelled):
    df, meta = labelled
    once = df.where("vol_id = 0")
    assert rows_moved(ge.crop_divisible(once, SHAPE, 4)[0]) == 0
    # One row per volume, of its turned axes, and the common size.
    assert rows_moved(ge.crop_same_size(once, meta.where("vol_id = 0"), 1)[0]) <= 5


def test_divisible_crops_are_the_same_both_ways(monkeypatch, labelled):
    df, meta = labelled
    for shape in (SHAPE, meta):
        def run():
            out, boxes = ge.crop_divisible(df, shape, 4, 1)
            return listed(out, "label"), sorted(map(tuple, boxes.collect()))
        whole, slabs = both_ways(monkeypatch, run)
        assert whole == slabs and len(whole[0]) > 100


def test_nearest_labels_are_the_same_both_ways(monkeypatch, spark, labelled):
    """Two wrong labels, regions whose boxes overlap, volumes without candidates, null and repeated rows."""
    df = labelled[0]
    odd = [(8, 1, 1, 1, 3), (8, 1, 1, 2, None), (9, 2, 2, 2, 5), (9, 2, 1, 2, None), (9, 1, 2, 2, 7), (9, 2, 2, 1, 6), (None, 1, 1, 1, 3), (None, 1, 1, 2, 7)]
    df = df.unionByName(spark.createDataFrame(odd, df.schema)).unionByName(df.selectExpr("vol_id + 20 AS vol_id", "x", "y", "z", "label + 4 AS label").where("vol_id <> 21"))
    for wrong, remove_zero in (([3, 5], True), ([5], False), ([7], True)):
        run = lambda: sorted((tuple((v is None, v or 0) for v in r) for r in lb.correct_labels_nearest(df, wrong, remove_zero).select(*V, "label").collect()))
        whole, slabs = both_ways(monkeypatch, run)
        assert whole == slabs and len(whole) == df.count()


def test_nearest_labels_of_small_volumes_are_found_where_they_are(labelled):
    assert rows_moved(lb.correct_labels_nearest(labelled[0].where("vol_id = 0"), [3], True)) == 0
