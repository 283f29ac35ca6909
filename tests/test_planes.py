"""The data source of planes: the same numbers as the decoder, many tasks per file, headers without voxels."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import planes
from test_jobs import folder, nifti  # noqa: F401


def test_same_voxels_as_the_decoder(spark, folder):  # noqa: F811
    src, vols, _, _ = folder
    rows, errors = planes.read_planes(spark, str(src), split_bytes=2000)
    assert [r.path.rsplit("/", 1)[1] for r in errors.collect()] == ["broken.nii"]
    seen = {}
    for r in planes.planes_to_voxels(rows).collect():
        v = vols[r.path.rsplit("/", 1)[1]]
        assert r.value == pytest.approx(float(v[r.x, r.y, r.z] if v.ndim == 3 else v[r.x, r.y, r.z, r.channel]))
        seen[r.path.rsplit("/", 1)[1]] = seen.get(r.path.rsplit("/", 1)[1], 0) + 1
    assert seen == {n: v.size for n, v in vols.items()}


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.nii").write_bytes(nifti(np.arange(20 * 10 * 40, dtype="f4").reshape(20, 10, 40), np.eye(4)))
    rows, _ = planes.read_planes(spark, str(tmp_path), split_bytes=8000)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("z").alias("n")).collect()
    assert len(tasks) >= 4 and sum(r.n for r in tasks) == 40
    total = rows.select(F.sum(F.aggregate("vals", F.lit(0.0), lambda a, v: a + v))).first()[0]
    assert total == sum(range(20 * 10 * 40))


def test_headers_without_voxels(spark, tmp_path):
    grid, affine = np.zeros((11, 12, 13, 2), "f4"), np.diag([2.0, 1.0, 1.5, 1.0])
    whole = nifti(grid, affine)
    (tmp_path / "cut.nii").write_bytes(whole[:352])  # nothing but the header
    packed = gzip.compress(whole)
    (tmp_path / "a.nii.gz").write_bytes(packed)
    np.savez(tmp_path / "b.npz", vol_data=np.zeros((11, 1, 12)))
    (tmp_path / "c.mgz").write_bytes(b"xx")
    meta, errors = planes.read_headers(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in meta.collect()}
    assert got["cut.nii"].shape == [11, 12, 13, 2] and got["cut.nii"].n_channels == 2 and got["cut.nii"].affine[2][2] == 1.5
    assert got["a.nii.gz"].shape == [11, 12, 13, 2] and got["b.npz"].shape == [11, 12, 1]
    assert [(r.path.rsplit("/", 1)[1], r.message[:10]) for r in errors.collect()] == [("c.mgz", "ValueError")]
    rows, errors = planes.read_planes(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in errors.collect()) == ["c.mgz", "cut.nii"]
