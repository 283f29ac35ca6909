"""Grid operators against brute force on small random volumes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import numbers as num
from gridloom.functions.order import exact_percentiles, running_total
from gridloom.operators import evaluate as ev
from gridloom.operators import geometry as ge
from gridloom.operators import intensity as it
from gridloom.operators import labels as lb
from gridloom.operators import lines as li
from gridloom.operators import morphology as mo
from gridloom.operators import neighbourhood as nb
from gridloom.operators import resample as rs

SHAPE = (5, 6, 7)
V = ["vol_id", "x", "y", "z"]


def rows_of(volumes):
    return [(i, *map(int, p), v[tuple(p)].item()) for i, v in enumerate(volumes) for p in np.argwhere(np.ones(v.shape, bool))]


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(7)
    return [rng.random(SHAPE) < p for p in (0.3, 0.6)]


@pytest.fixture(scope="module")
def mask(spark, noise):
    rows = [(i, *map(int, p)) for i, v in enumerate(noise) for p in np.argwhere(v)]
    return spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int").cache()


def to_masks(df, n=2, shape=SHAPE):
    out = [np.zeros(shape, bool) for _ in range(n)]
    for row in df.select(*V).collect():
        assert not out[row.vol_id][row.x, row.y, row.z], "duplicate voxel"
        out[row.vol_id][row.x, row.y, row.z] = True
    return out


def ball_test(volume, radius, combine):
    ball = [d for d in itertools.product(range(-radius, radius + 1), repeat=3) if sum(c * c for c in d) <= radius * radius]
    out = np.zeros(volume.shape, bool)
    for p in np.ndindex(*volume.shape):
        near = [tuple(np.add(p, d)) for d in ball]
        out[p] = combine(volume[q] if all(0 <= q[i] < volume.shape[i] for i in range(3)) else False for q in near)
    return out


@pytest.mark.parametrize("radius", [1, 2])
def test_dilate_and_erode(mask, noise, radius):
    for got, v in zip(to_masks(mo.dilate(mask, radius, SHAPE)), noise):
        assert np.array_equal(got, ball_test(v, radius, any))
    for got, v in zip(to_masks(mo.erode(mask, radius)), noise):
        assert np.array_equal(got, ball_test(v, radius, all))


def test_erode_with_true_outside(spark):
    full = np.ones(SHAPE, bool)
    full[2, 3, 3] = False
    df = spark.createDataFrame([(0, *map(int, p)) for p in np.argwhere(full)], "vol_id bigint, x int, y int, z int")
    got = to_masks(mo.erode(df, 1, SHAPE, outside=True), 1)[0]
    assert got.sum() == full.size - 7 and got[0, 0, 0]


def flood(volume, connectivity):
    label, comps = -np.ones(volume.shape, int), []
    for p in np.ndindex(*volume.shape):
        if volume[p] and label[p] < 0:
            label[p], stack, comp = len(comps), [p], [p]
            while stack:
                q = stack.pop()
                for d in itertools.product((-1, 0, 1), repeat=3):
                    w = tuple(np.add(q, d))
                    if (connectivity == 26 or sum(map(abs, d)) == 1) and all(0 <= w[i] < volume.shape[i] for i in range(3)) \
                            and volume[w] and label[w] < 0:
                        label[w] = len(comps)
                        stack.append(w)
                        comp.append(w)
            comps.append(comp)
    return label, comps


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components(mask, noise, connectivity):
    out = mo.connected_components(mask, connectivity).withColumn("id", mo.raster_id(F.col("comp"), 6, 7)).collect()
    assert len(out) == sum(v.sum() for v in noise)
    truth = [flood(v, connectivity) for v in noise]
    for row in out:
        label, comps = truth[row.vol_id]
        assert row.id == np.ravel_multi_index(comps[label[row.x, row.y, row.z]][0], SHAPE)


def test_largest_component_and_holes(mask, noise):
    for got, v in zip(to_masks(mo.largest_component(mask)), noise):
        big = max(flood(v, 6)[1], key=len)
        assert {tuple(map(int, p)) for p in np.argwhere(got)} == {tuple(map(int, p)) for p in big}
    for got, v in zip(to_masks(mo.fill_holes(mask, SHAPE)), noise):
        want = v.copy()
        for comp in flood(~v, 6)[1]:
            if not any(p[i] in (0, SHAPE[i] - 1) for p in comp for i in range(3)):
                for p in comp:
                    want[p] = True
        assert np.array_equal(got, want)


def test_components_do_not_depend_on_partitions(spark, mask):
    key = lambda df: sorted(map(tuple, df.collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(key(mo.connected_components(mask)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_edt(mask, noise):
    for row in nb.edt(mask, SHAPE).collect():
        holes = np.argwhere(~noise[row.vol_id])
        assert row.distance == pytest.approx(np.sqrt(((holes - [row.x, row.y, row.z]) ** 2).sum(1).min()))


def test_edt_without_false_voxel_is_infinite(spark):
    full = spark.createDataFrame([(0, *p) for p in np.ndindex(2, 2, 2)], "vol_id bigint, x int, y int, z int")
    assert {r.distance for r in nb.edt(full, (2, 2, 2)).collect()} == {float("inf")}


def test_signed_distance_cropped(spark):
    df = spark.createDataFrame([(0, 5, 5, 5, 1), (0, 5, 5, 6, 1), (0, 6, 6, 7, 1)], "vol_id bigint, x int, y int, z int, label int")
    out = {(r.x, r.y, r.z): r.distance for r in nb.signed_distance_cropped(df, (12, 12, 12), 2).collect()}
    assert len(out) == 12 ** 3 and out[(5, 5, 5)] == 0.5 and out[(5, 5, 4)] == -0.5
    assert out[(0, 0, 0)] == min(out.values())


@pytest.fixture(scope="module")
def label_noise(spark):
    rng = np.random.default_rng(3)
    vols = [rng.choice([0, 2, 3, 5], SHAPE, p=[0.4, 0.2, 0.2, 0.2]) for _ in range(2)]
    return vols, spark.createDataFrame(rows_of(vols), "vol_id bigint, x int, y int, z int, label int").cache()


def test_correct_labels_candidates(label_noise):
    vols, df = label_noise
    for row in lb.correct_labels_candidates(df, 5, [3, 2]).collect():
        v = vols[row.vol_id]
        if v[row.x, row.y, row.z] != 5:
            assert row.label == v[row.x, row.y, row.z]
            continue
        d = [((np.argwhere(v == c) - [row.x, row.y, row.z]) ** 2).sum(1).min() for c in (3, 2)]
        assert row.label == [3, 2][int(np.argmin(d))]


def test_correct_labels_nearest(label_noise):
    vols, df = label_noise
    got = {tuple(r)[:4]: r.label for r in lb.correct_labels_nearest(df, [5], True).select(*V, "label").collect()}
    for i, v in enumerate(vols):
        want = v.copy()
        for comp in flood(v == 5, 6)[1]:
            lo = np.maximum(np.min(comp, 0) - 1, 0)
            hi = np.max(comp, 0) + 1
            box = tuple(slice(a, b) for a, b in zip(lo, hi))
            cand = [c for c in np.unique(v[box]) if c not in (0, 5)]
            for p in np.argwhere(v[box] == 5):
                d = [((np.argwhere(v[box] == c) - p) ** 2).sum(1).min() for c in cand]
                want[tuple(p + lo)] = cand[int(np.argmin(d))] if cand else -1
        for p in np.ndindex(*SHAPE):
            assert got[(i, *p)] == want[p]


@pytest.mark.parametrize("radius,shape", [(0, None), (1, None), (2.5, None), (3, (5, 4, 2))])
def test_ball_offsets(spark, radius, shape):
    half = [s // 2 for s in shape] if shape else [int(radius)] * 3
    ends = [(h if not shape or s % 2 else h - 1) for h, s in zip(half, shape or (1, 1, 1))]
    want = {p for p in itertools.product(*[range(-h, e + 1) for h, e in zip(half, ends)]) if sum(c * c for c in p) <= radius ** 2}
    assert {tuple(r) for r in mo.ball_offsets(spark, radius, shape).collect()} == want


def test_corrections_are_smoothed(label_noise):
    df, shape = label_noise[1], SHAPE
    rows = lambda d: sorted(map(tuple, d.select(*V, "label").collect()))
    for plain, smooth in ((lb.correct_labels_candidates(df, 5, [3, 2]), lb.correct_labels_candidates(df, 5, [3, 2], smooth_shape=shape)),
                          (lb.correct_labels_nearest(df, [5], True), lb.correct_labels_nearest(df, [5], True, smooth_shape=shape))):
        assert rows(smooth) == rows(lb.smooth_labels(plain, shape, cube=True)) != rows(plain)


def test_smooth_labels(label_noise):
    vols, df = label_noise
    got = {tuple(r)[:4]: r.label for r in nb.smooth_labels(df, SHAPE).select(*V, "label").collect()}
    for i, v in enumerate(vols):
        pad = np.pad(v, 1, mode="symmetric")
        for p in np.ndindex(*SHAPE):
            q = np.array(p) + 1
            near = [pad[tuple(q)]] + [pad[tuple(q + s * np.eye(3, dtype=int)[a])] for a in range(3) for s in (-1, 1)]
            values, counts = np.unique(near, return_counts=True)
            assert got.get((i, *p), 0) == values[int(np.argmax(counts))]


def test_gaussian_blur_modes(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=SHAPE)
    df = spark.createDataFrame(rows_of([v]), "vol_id bigint, x int, y int, z int, value double")
    for edge, pad_mode in (("nearest", "edge"), ("reflect", "symmetric"), ("zero", "constant")):
        want = v
        for axis in range(3):
            w = dict(nb.gaussian_weights(0.8, edge))
            r = max(w)
            pads = [(r, r) if a == axis else (0, 0) for a in range(3)]
            p = np.pad(want, pads, mode=pad_mode)
            want = sum(wk * np.take(p, range(k + r, k + r + v.shape[axis]), axis=axis) for k, wk in w.items())
        got = np.zeros(SHAPE)
        for row in nb.gaussian_blur(df, 0.8, SHAPE, edge=edge).collect():
            got[row.x, row.y, row.z] = row.value
        assert np.allclose(got, want)


def test_smoothing_of_constant_image(spark):
    df = spark.createDataFrame(rows_of([np.full(SHAPE, 3.0)]), "vol_id bigint, x int, y int, z int, value double")
    assert all(abs(r.value - 3) < 1e-9 for r in nb.gaussian_blur(df, (0.5, 1.0, 0.0), SHAPE).collect())


# ---- geometry -------------------------------------------------------------------------------------------------------

def test_flip_twice_is_identity(label_noise):
    _, df = label_noise
    once = ge.flip(df, SHAPE, 1)
    assert sorted(map(tuple, ge.flip(once, SHAPE, 1).collect())) == sorted(map(tuple, df.collect()))


def test_flip_swaps_labels(spark):
    # one neutral label, sides 1 and 2: reversing a line also swaps its sides
    df = spark.createDataFrame([(0, 0, 0, z, v) for z, v in enumerate([0, 1, 1, 2])], "vol_id bigint, x int, y int, z int, label int")
    out = {r.z: r.label for r in ge.flip(df, (1, 1, 4), 2, "label", lb.flip_pairs_literal([0, 1, 2], 1)).collect()}
    assert [out[z] for z in range(4)] == [1, 2, 2, 0]


def test_reset_labels(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3)], "label int")
    assert [r.label for r in lb.reset_labels(df, [1, 3]).collect()] == [0, 0, 2, 0]


def test_get_dims(spark):
    shapes = [([150, 150, 150], (3, 1)), ([150, 150, 150, 3], (3, 3)), ([150, 150, 150, 15], (4, 1))]
    df = spark.createDataFrame([(s,) for s, _ in shapes], "shape array<int>")
    assert [tuple(r.d) for r in df.select(num.get_dims(F.col("shape")).alias("d")).collect()] == [d for _, d in shapes]


def test_pad_then_crop_is_identity(spark, label_noise):
    _, df = label_noise
    meta = spark.createDataFrame([(i, *SHAPE, np.eye(4).tolist()) for i in range(2)],
                                 "vol_id bigint, nx int, ny int, nz int, affine array<array<double>>")
    padded, pmeta, boxes = ge.pad(df, meta, (8, 9, 7), fill=0, value="label")
    back = ge.crop_to_box(padded, boxes)
    assert sorted(map(tuple, back.select(*V, "label").collect())) == sorted(map(tuple, df.collect()))
    row = ge.crop_meta(pmeta, boxes).head()
    assert (row.nx, row.ny, row.nz) == SHAPE and np.allclose(row.affine, np.eye(4))
    assert padded.count() == 2 * 8 * 9 * 7


def test_align_to_reference_and_back(spark):
    rng = np.random.default_rng(5)
    vol = rng.integers(0, 9, (2, 3, 4))
    affine = np.array([[0, 0, -2.0, 5], [1.5, 0, 0, 1], [0, -1.0, 0, 2], [0, 0, 0, 1]])
    df = spark.createDataFrame(rows_of([vol]), "vol_id bigint, x int, y int, z int, label bigint")
    meta = spark.createDataFrame([(0, 2, 3, 4, affine.tolist())], "vol_id bigint, nx int, ny int, nz int, affine array<array<double>>")
    out, ometa = ge.align(df, meta)
    row = ometa.head()
    got = np.zeros((row.nx, row.ny, row.nz), int)
    for r in out.collect():
        got[r.x, r.y, r.z] = r.label
    # new axes are the old 1, 2, 0, and those with a negative direction are reversed
    direction = [affine[0, 2], affine[1, 0], affine[2, 1]]
    want = np.transpose(vol, (2, 0, 1))
    assert np.array_equal(got, np.flip(want, [i for i in range(3) if direction[i] < 0]))
    a = np.array(row.affine)
    assert np.all(np.diag(a)[:3] > 0)
    back, bmeta = ge.align(out, ometa.join(meta.select("vol_id", F.col("affine").alias("native")), "vol_id"), ref="native")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert np.allclose(bmeta.head().affine, affine)


def test_resample_identity_and_like(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3, 4, 5))
    df = spark.createDataFrame(rows_of([v]), "vol_id bigint, x int, y int, z int, value double")
    meta = spark.createDataFrame([(0, 3, 4, 5, 1.0, 1.0, 1.0, np.eye(4).tolist())],
                                 "vol_id bigint, nx int, ny int, nz int, rx double, ry double, rz double, affine array<array<double>>")
    same = {tuple(r)[1:4]: r.value for r in rs.resample(df, meta, (1, 1, 1), blur=False)[0].collect()}
    like = {tuple(r)[1:4]: r.value for r in rs.resample_like(df, meta, meta).collect()}
    for p in np.ndindex(3, 4, 5):
        assert same[p] == pytest.approx(v[p]) and like[p] == pytest.approx(v[p])


def test_affine_matrix_and_ras_axes(spark):
    a = np.array([[0, 1.5, 0.2, 3], [0, 0.1, 2, 4], [-1, 0, 0, 5], [0, 0, 0, 1.0]])
    df = spark.createDataFrame([(a.tolist(),)], "a array<array<double>>")
    row = df.select(num.inverse_affine(F.col("a")).alias("i"), num.ras_axes(F.col("a")).alias("r"),
                    num.matmul(F.col("a"), F.col("a")).alias("m")).head()
    assert np.allclose(row.i, np.linalg.inv(a)) and np.allclose(row.m, a @ a)
    assert list(row.r) == list(np.argmax(np.abs(np.linalg.inv(a)[:3, :3]), axis=0))


# ---- order statistics -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 64, 5000])
def test_exact_percentiles(spark, n):
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 0.3, 0.0, rng.normal(size=n) ** 3)
    df = spark.createDataFrame([(int(i % 2 if n > 2 else 0), float(x)) for i, x in enumerate(v)], "k int, v double")
    fr = [0.02, 0.5, 0.98, 0.0, 1.0]
    for row in exact_percentiles(df, ["k"], "v", fr, list("abcde")).collect():
        part = v[np.arange(n) % 2 == row.k] if n > 2 else v
        assert np.allclose([row.a, row.b, row.c, row.d, row.e], np.percentile(part, [100 * f for f in fr]))


def test_percentiles_ignore_nan(spark):
    df = spark.createDataFrame([(0, float("nan")), (0, 1.0), (0, 3.0)], "k int, v double")
    assert exact_percentiles(df, ["k"], "v", [0.5], ["m"]).head().m == 2.0


def test_running_total(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    for r in running_total(df, ["k"], ["id"], F.lit(1), "rank").collect():
        assert r["rank"] == r.id // 3 + 1


def test_rescale_constant_volume(spark):
    df = spark.createDataFrame([(0, 0, 0, z, 5.0) for z in range(4)], "vol_id bigint, x int, y int, z int, value double")
    assert {r.value for r in it.rescale(df).collect()} == {0.0}


# ---- distances ------------------------------------------------------------------------------------------------------

def pairs(spark, gt, seg):
    rows = [(0, *map(int, p), int(gt[tuple(p)]), int(seg[tuple(p)])) for p in np.argwhere((gt > 0) | (seg > 0))]
    return spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int, gt int, seg int")


def test_identical_maps(spark):
    g = np.zeros((8, 8, 8), int)
    g[2:6, 2:6, 2:6] = 3
    p = pairs(spark, g, g)
    assert ev.dice_by_label(p, [3, 4]).where("label = 3").head().dice == pytest.approx(1, abs=1e-6)
    row = ev.surface_distances(p, [3], (8, 8, 8), inclusive=True).head()
    # the inclusive box holds no false voxel at all: no surface, so the largest side of the box
    assert row.mean_distance == 4
    row = ev.surface_distances(p, None, (8, 8, 8)).head()
    assert row.label == -1


def test_distance_of_missing_structure(spark):
    g = np.zeros((6, 5, 4), int)
    g[1, 1, 1] = 7
    row = ev.surface_distances(pairs(spark, g, np.zeros_like(g)), [7], (6, 5, 4)).head()
    assert row.mean_distance == 6 and row.hausdorff_100 == 6


def test_contingency_by_hand(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 2, 2), (0, 2, 9)], "vol_id bigint, gt int, seg int")
    out = {r.label: r.dice for r in ev.dice_by_label(df, [1, 2]).collect()}
    # the pair (2, 9) lies outside the range of the list and is not counted
    assert out[1] == pytest.approx(2 * 1 / (2 + 1 + 1e-5)) and out[2] == pytest.approx(2 * 1 / (1 + 2 + 1e-5))


def test_surface_distances_brute_force(spark):
    rng = np.random.default_rng(9)
    g, s = [(rng.random((7, 8, 6)) < 0.5).astype(int) for _ in range(2)]
    lo = np.minimum(*[np.argwhere(v).min(0) for v in (g, s)])
    hi = np.maximum(*[np.argwhere(v).max(0) for v in (g, s)])
    box = tuple(slice(a, b) for a, b in zip(lo, hi))

    def edge(v):
        c = v[box]
        out = []
        for p in np.argwhere(c):
            near = [p + d for d in np.vstack([np.eye(3, dtype=int), -np.eye(3, dtype=int)])]
            if any(all(0 <= q[i] < c.shape[i] for i in range(3)) and not c[tuple(q)] for q in near):
                out.append(p)
        return np.array(out)

    a, b = edge(g), edge(s)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    da, db = d.min(1), d.min(0)
    row = ev.surface_distances(pairs(spark, g, s), [1], (7, 8, 6)).head()
    pooled = np.concatenate([da, db])
    assert row.mean_distance == pytest.approx((da.mean() + db.mean()) / 2)
    assert row.hausdorff_100 == pytest.approx(pooled.max()) and row.hausdorff_99 == pytest.approx(np.percentile(pooled, 99))
    assert row.hausdorff_95 == pytest.approx(np.percentile(pooled, 95))


def test_wilcoxon_small_sample(spark):
    diffs = [1.1, -0.4, 2.3, 3.1, -1.7, 4.2, 0.9]
    df = spark.createDataFrame([("a", i, 5.0 + d, 5.0) for i, d in enumerate(diffs)], "structure string, subject int, ref double, cmp double")
    ranks = np.argsort(np.argsort(np.abs(diffs))) + 1
    plus = ranks[np.array(diffs) > 0].sum()
    sums = [sum(r for r, k in zip(ranks, bits) if k) for bits in itertools.product((0, 1), repeat=len(diffs))]
    for alternative, want in (("two-sided", min(1, 2 * np.mean(np.array(sums) <= min(plus, ranks.sum() - plus)))),
                              ("greater", np.mean(np.array(sums) >= plus)), ("less", np.mean(np.array(sums) <= plus))):
        row = ev.wilcoxon_paired(df, alternative, with_average=False).head()
        assert row.exact and row.r_plus == plus and row.p_value == pytest.approx(want)


def test_surfaces_across_words_and_slabs(spark):
    """Lines of several 64-cell words, and volumes of several slabs, against brute force."""
    rng = np.random.default_rng(5)
    sides = {c: rng.random((40, 3, 150)) < 0.9 for c in ("gt", "seg")}
    for m in sides.values():
        m[2:20, :, 60:70] = True
    cells = [(1, *map(int, at), *(int(sides[c][at]) for c in ("gt", "seg"))) for at in np.ndindex(40, 3, 150)]
    pairs = spark.createDataFrame(cells, "vol_id long, x int, y int, z int, gt int, seg int")
    got = {(r.side, r.x, r.y, r.z): r.d2 for r in ev.surface_to_surface(ev.surface_points(pairs, [1], (40, 3, 150))[0]).collect()}
    ends = [np.argwhere(m) for m in sides.values()]
    lo, hi = np.min([e.min(0) for e in ends], 0), np.max([e.max(0) for e in ends], 0)
    edges = []
    for m in sides.values():
        m = m[lo[0]:hi[0], lo[1]:hi[1], lo[2]:hi[2]]
        around = np.pad(m, 1, constant_values=True)
        full = np.all([np.roll(around, s, a)[1:-1, 1:-1, 1:-1] for a in range(3) for s in (1, -1)], 0)
        edges.append(np.argwhere(m & ~full) + lo)
    want = {(s, *map(int, p)): int(((edges[1 - s] - p) ** 2).sum(1).min()) for s in (0, 1) for p in edges[s]}
    assert got == want
