"""Files, streams, sinks and whole-cohort jobs."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import posteriors as po
from gridloom.plans import cohort
from gridloom.sources import ingest, manifest as mf, sinks
from gridloom.streaming.incremental import run_new, run_new_volumes


def nifti(vol, affine):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, vol.ndim, *vol.shape, *([1] * (7 - vol.ndim)))
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.asarray(affine)[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(vol, "<f4").tobytes(order="F")


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(0)
    vols = {"a.nii.gz": rng.normal(size=(11, 12, 13)).astype("f4"), "b.nii": rng.normal(size=(11, 12, 13, 2)).astype("f4"),
            "c.npz": rng.integers(0, 5, (11, 11, 11))}
    affine = np.array([[-1, 0, 0, 3], [0, 2, 0, 1], [0, 0, 1.5, 0], [0, 0, 0, 1]])
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.nii.gz").write_bytes(gzip.compress(nifti(vols["a.nii.gz"], affine)))
    (src / "b.nii").write_bytes(nifti(vols["b.nii"], affine))
    np.savez(src / "c.npz", vol_data=vols["c.npz"])
    (src / "broken.nii").write_bytes(b"not an image")
    (src / "note.txt").write_text("skip me")
    return src, vols, affine, tmp_path


def test_ingest(spark, folder):
    src, vols, affine, tmp = folder
    lines, meta, errors = ingest.ingest_volumes(spark, str(src), str(tmp / "out"))
    assert [r.path.rsplit("/", 1)[1] for r in errors.collect()] == ["broken.nii"]
    info = {r.path.rsplit("/", 1)[1]: r for r in meta.collect()}
    assert set(info) == set(vols) and info["b.nii"].n_channels == 2 and info["a.nii.gz"].n_dims == 3
    assert np.allclose(info["a.nii.gz"].affine, affine)
    for r in ingest.lines_to_voxels(lines).collect():
        v = vols[r.path.rsplit("/", 1)[1]]
        assert r.value == pytest.approx(float(v[r.x, r.y, r.z] if v.ndim == 3 else v[r.x, r.y, r.z, r.channel]))
    rounded = ingest.lines_to_voxels(lines, dtype="int").where("path LIKE '%c.npz'")
    assert rounded.schema["value"].dataType.simpleString() == "int" and rounded.count() == 11 ** 3


def test_scan_folder(spark, folder):
    src = folder[0]
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(mf.scan_folder(spark, str(src))) == ["a.nii.gz", "b.nii", "broken.nii", "c.npz"]
    assert names(mf.scan_folder(spark, str(src), ["b", "nii"], "and")) == ["b.nii", "broken.nii"]
    with pytest.raises(FileNotFoundError):
        mf.scan_folder(spark, str(src), ["nothing"])


def test_manifest_text(spark, tmp_path):
    (tmp_path / "list.txt").write_text("/d/z.nii\n\n/d/a.nii\n/d/m.nii\n")
    rows = mf.read_manifest_text(spark, str(tmp_path / "list.txt")).orderBy("ord").collect()
    assert [(r.ord, r.path) for r in rows] == [(0, "/d/z.nii"), (1, "/d/a.nii"), (2, "/d/m.nii")]


def test_pairing_checks_counts(spark):
    a = spark.createDataFrame([("x1",), ("x2",), ("x3",)], "path string")
    b = spark.createDataFrame([("y2",), ("y1",)], "path string")
    with pytest.raises(ValueError):
        mf.pair_by_order(a, b)
    rows = sorted(map(tuple, mf.pair_by_order(a, b, strict=False).collect()))
    assert rows == [(0, "x1", "y1"), (1, "x2", "y2")]


def test_stream_handles_new_files_once(spark, tmp_path):
    src, seen = tmp_path / "src", tmp_path / "seen"
    handle = lambda batch, i: batch.write.mode("overwrite").parquet(f"{seen}/batch={i}")
    add = lambda *names: spark.createDataFrame([(n, 1) for n in names], "path string, length bigint").coalesce(1).write.mode("append").parquet(str(src))
    add("a", "b")
    run_new(spark, str(src), str(tmp_path / "cp"), handle)
    add("c")
    run_new(spark, str(src), str(tmp_path / "cp"), handle)
    run_new(spark, str(src), str(tmp_path / "cp"), handle)
    rows = spark.read.parquet(str(seen)).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in rows} == {"a": 1, "b": 1, "c": 1}


def test_stream_of_volumes(spark, folder):
    src, vols, _, tmp = folder
    for _ in range(2):
        run_new_volumes(spark, str(src), str(tmp / "cp"), str(tmp / "vols"))
    _, meta, errors = ingest.read_images(spark, str(tmp / "vols"))
    assert meta.count() == len(vols) and errors.count() == 1


def test_posteriors_sum_to_one(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 0.2), (0, 0, 0, 0, 2, 0.3), (0, 0, 0, 1, 2, 0.4)],
                               "vol_id bigint, x int, y int, z int, label int, p double")
    sums = po.normalise(df).groupBy("vol_id", "x", "y", "z").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_cohort_report_reports_missing(spark):
    manifest = spark.createDataFrame([(1, "/in/1", "/out/1"), (2, "/in/2", "/out/2")], "vol_id bigint, path string, out_seg string")
    done = spark.createDataFrame([], "path string")
    post = spark.createDataFrame([(1, x, y, 0, lab, p) for x in range(3) for y in range(3) for lab, p in ((0, 0.1), (3, 0.9))],
                                 "vol_id bigint, x int, y int, z int, label int, p double")
    meta = spark.createDataFrame([(v, 3, 3, 1, 1.0, 1.0, 1.0, np.eye(4).tolist()) for v in (1, 2)],
                                 "vol_id bigint, nx int, ny int, nz int, rx double, ry double, rz double, affine array<array<double>>")
    out = cohort.cohort_report(manifest, done, post, meta, [0, 3], fast=True)
    assert [r.vol_id for r in out["errors"].collect()] == [2]
    assert {(r.label, r.volume) for r in out["volumes"].collect()} == {(3, 8.1), (4, 8.1)}


def test_prepare_and_finish_are_inverse_in_space(spark):
    """Crop and pad boxes made on the way in bring labels back to the native grid on the way out."""
    affine = np.array([[0, -1.0, 0, 0], [1.0, 0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1]])
    meta = spark.createDataFrame([(1, 5, 6, 4, 1.0, 1.0, 1.0, affine.tolist())],
                                 "vol_id bigint, nx int, ny int, nz int, rx double, ry double, rz double, affine array<array<double>>")
    rng = np.random.default_rng(1)
    vol = rng.random((5, 6, 4)) + 1
    df = spark.createDataFrame([(1, *map(int, p), float(vol[tuple(p)])) for p in np.ndindex(5, 6, 4)], "vol_id bigint, x int, y int, z int, value double")
    out, pmeta, crop, padb, _ = cohort.prepare_volumes(df, meta, crop=(4, 4, 4), min_pad=8, levels=2)
    row = pmeta.head()
    assert (row.nx, row.ny, row.nz) == (8, 8, 8) and out.count() == 64
    post = out.select("vol_id", "x", "y", "z", F.lit(3).alias("label"), F.lit(1.0).alias("p"))
    seg, soft, volumes = cohort.finish_posteriors(post, [0, 3], meta, padb, crop, fast=True)
    cells = {(r.x, r.y, r.z) for r in seg.where("label = 3").collect()}
    assert len(cells) == 64 and all(0 <= x < 5 and 0 <= y < 6 and 0 <= z < 4 for x, y, z in cells)
    assert soft.count() == 5 * 6 * 4
    assert {r.label: r.volume for r in volumes.collect()} == {3: 64.0, 4: 64.0}


def test_a_job_removes_its_intermediate_tables(spark):
    from pathlib import Path

    from gridloom.session import checkpoint_root, job, materialize
    root = Path(checkpoint_root(spark))
    before = {p.name for p in root.iterdir()}
    kept = materialize(spark.range(3))
    with job(spark):
        assert materialize(spark.range(5)).count() == 5
        with job(spark):
            materialize(spark.range(2))
        assert len({p.name for p in root.iterdir()} - before) == 2
    assert len({p.name for p in root.iterdir()} - before) == 1 and kept.count() == 3
