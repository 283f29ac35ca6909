"""Affine warps against plain numpy, on grids of several bricks."""

import numpy as np
import pytest

from gridloom.operators.warp import SIDE, affine_reads

GRIDS = "vol_id bigint, nx int, ny int, nz int, sx int, sy int, sz int, t array<array<double>>"


def by_numpy(vol, shape, t, method, outside):
    out = np.zeros(shape)
    s = np.array(vol.shape)
    for q in np.ndindex(*shape):
        p = np.round(t[:, :3] @ q + t[:, 3], 9)
        if outside == "zero" and ((p < 0) | (p > s - 1)).any():
            continue
        p = np.clip(p, 0, s - 1)
        if method == "nearest":
            out[q] = vol[tuple(np.ceil(p - 0.5).astype(int))]
            continue
        f = np.floor(p).astype(int)
        for c in np.ndindex(2, 2, 2):
            w = np.where(c, p - f, 1 - (p - f)).prod()
            if w:
                out[q] += w * vol[tuple(f + c)]
    return out


def rotation(angle):
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])


@pytest.mark.parametrize("method,outside", [("linear", "zero"), ("linear", "clamp"), ("nearest", "zero"), ("nearest", "clamp")])
def test_warps(spark, method, outside):
    rng = np.random.default_rng(0)
    cases = {1: ((20, 18, 17), (19, 21, 18), np.c_[np.eye(3), [0, 0, 0]]),
             2: ((33, 5, 18), (18, 20, 34), np.c_[rotation(0.7) * [1, 1, 0.5], [3.25, -4.0, 1.5]]),
             3: ((17, 17, 17), (20, 20, 20), np.c_[-np.eye(3), [16, 16, 16]]),
             4: ((3, 2, 1), (35, 4, 4), np.c_[np.eye(3) * 0.05, [1.0, -9.0, 0]]),
             5: ((SIDE + 1, SIDE, 2 * SIDE), (9, 9, 9), np.c_[np.eye(3) * 2.0, [0.5, 0, 100.0]])}
    rows, grids, want = [], [], {}
    for v, (source, target, t) in cases.items():
        vol = np.where(rng.random(source) < 0.7, rng.normal(size=source), 0)
        rows += [(v, *map(int, p), float(vol[p])) for p in np.ndindex(*source) if vol[p]]
        grids.append((v, *target, *source, t.tolist()))
        want[v] = by_numpy(vol, target, t, method, outside)
    df = spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int, value double")
    # One grid without a single voxel.
    out = affine_reads(spark.createDataFrame([*grids, (9, 3, 3, 3, 2, 2, 2, np.eye(3, 4).tolist())], GRIDS), df, method, outside).toPandas()
    assert not out.duplicated(["vol_id", "x", "y", "z"]).any() and (out[out.vol_id == 9].value == 0).sum() == 27
    for v, grid in want.items():
        got = out[out.vol_id == v]
        assert len(got) == grid.size
        assert np.allclose(got.value, grid[got.x, got.y, got.z], atol=1e-9)


def test_voxels_are_shuffled_once(spark):
    df = spark.range(10).selectExpr("id AS vol_id", "0 AS x", "0 AS y", "0 AS z", "1.0D AS value")
    grids = spark.createDataFrame([(1, 4, 4, 4, 4, 4, 4, np.eye(3, 4).tolist())], GRIDS)
    plan = affine_reads(grids, df)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "_v" in line for line in plan.splitlines()) <= 1
