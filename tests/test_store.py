"""Result tables over several runs: other subjects, repeated runs, killed runs, recomputing."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import ingest, sinks, store
from test_jobs import nifti

REGIONS = "vol_id string, label int, volume double"


def volumes(spark, *names, add=0.0):
    return spark.createDataFrame([(n, v, v + add + 0.12345) for n in names for v in (2, 3, 4)], REGIONS)


def region_rows(spark, path):
    return sorted(map(tuple, store.read_table(spark, path, "regions", "subject").collect()))


def test_region_csv_keeps_earlier_subjects(spark, tmp_path):
    path, options = str(tmp_path), {"names": ["bg", "left", "right", "total"], "last_first": True}
    assert sinks.write_region_csv(volumes(spark, "s1"), path, [0, 2, 3, 4], batch="001", **options)
    assert sinks.write_region_csv(volumes(spark, "s2", "s3"), path, [0, 2, 3, 4], batch="002", **options)
    want = [(s, 4.123, 2.123, 3.123) for s in ("s1", "s2", "s3")]
    assert region_rows(spark, path) == want
    text = "".join(p.read_text() for p in tmp_path.glob("data/regions/batch=001/*.csv"))
    assert text.splitlines() == ["subject,total,left,right", "s1,4.123,2.123,3.123"]
    # The same batch again, the same subjects under a new name, and one of them beside a new one.
    assert not sinks.write_region_csv(volumes(spark, "s2", add=1.0), path, [0, 2, 3, 4], batch="002", **options)
    assert not sinks.write_region_csv(volumes(spark, "s1", "s3", add=1.0), path, [0, 2, 3, 4], **options)
    assert sinks.write_region_csv(volumes(spark, "s1", "s4", add=1.0), path, [0, 2, 3, 4], **options)
    assert region_rows(spark, path) == [*want, ("s4", 5.123, 3.123, 4.123)]
    assert sinks.write_region_csv(volumes(spark, "s1", add=2.0), path, [0, 2, 3, 4], recompute=True, **options)
    assert region_rows(spark, path)[0] == ("s1", 6.123, 4.123, 5.123) and len(region_rows(spark, path)) == 4


def test_scores_by_metric(spark, tmp_path):
    path = str(tmp_path)
    scores = lambda v: spark.createDataFrame([(v, 2, "dice", 0.5), (v, 2, "mean_distance", 1.5)], "vol_id int, label int, metric string, value double")
    for v in (1, 2, 1):
        sinks.write_score_matrix(scores(v), path)
    assert len(list(tmp_path.glob("data/scores/batch=*/metric=dice"))) == 2
    rows = store.read_table(spark, path, "scores")
    assert rows.columns == ["vol_id", "label", "metric", "value"]
    assert sorted((r.vol_id, r.metric) for r in rows.collect()) == [(v, m) for v in (1, 2) for m in ("dice", "mean_distance")]


def voxels(spark, vol, value, n=4):
    return spark.createDataFrame([("d", vol, 0, 0, z, value) for z in range(n)], "dataset string, vol_id int, x int, y int, z int, value double")


def test_killed_run_leaves_no_half_subject(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    meta = lambda v: spark.createDataFrame([(v, 1, 1, 4)], "vol_id int, nx int, ny int, nz int")
    assert sinks.write_voxels(voxels(spark, 1, 2.5), meta(1), path, batch="a")

    broken = voxels(spark, 2, 1.0).withColumn("value", F.when(F.col("z") == 3, F.raise_error(F.lit("killed")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="killed"):
        sinks.write_voxels(broken, meta(2), path, batch="b").collect()
    real = store._replace_batch

    def stops(df, place, *rest):
        if place.endswith("commits"):
            raise KeyboardInterrupt
        real(df, place, *rest)

    monkeypatch.setattr(store, "_replace_batch", stops)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_voxels(voxels(spark, 3, 7.0, 6), meta(3), path, batch="c")
    monkeypatch.undo()
    seen = lambda: sorted((r.vol_id, r.value) for r in store.read_table(spark, path, "voxels").collect())
    assert seen() == [(1, 2)] * 4 and store.read_table(spark, path, "meta").count() == 1
    assert [r.vol_id for r in store.pending(spark, path, meta(1).unionByName(meta(3))).collect()] == [3]
    # The next run of the killed batch replaces what it left, also partitions without rows now.
    assert sinks.write_voxels(voxels(spark, 3, 8.0).withColumn("dataset", F.lit("e")), meta(3), path, batch="c")
    assert seen() == [(1, 2)] * 4 + [(3, 8)] * 4


def test_volume_without_voxels_is_finished(spark, tmp_path):
    meta = spark.createDataFrame([(1, 4), (2, 4)], "vol_id int, nz int")
    assert sinks.write_voxels(voxels(spark, 1, 2.0), meta, str(tmp_path))
    assert not sinks.write_voxels(voxels(spark, 1, 3.0), meta, str(tmp_path))
    assert store.pending(spark, str(tmp_path), meta).isEmpty()


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(ValueError):
        store.read_table(spark, path, "errors")
    errors = spark.createDataFrame([], "vol_id int, message string")
    store.write_batch({"errors": errors}, path, "x", spark.createDataFrame([(1,)], "vol_id int"))
    assert store.read_table(spark, path, "errors").collect() == [] and store.finished(spark, path).count() == 1
    with pytest.raises(ValueError):
        store.write_batch({"errors": errors.withColumn("batch", F.lit(1))}, path)


def test_ingest_adds_new_files(spark, tmp_path):
    src, out, affine = tmp_path / "in", str(tmp_path / "out"), np.eye(4)
    src.mkdir()
    grid = lambda i: np.full((11, 11, 12), i, "f4")
    (src / "a.nii").write_bytes(nifti(grid(1), affine))
    (src / "b.nii.gz").write_bytes(b"not yet complete")
    _, meta, errors = ingest.ingest_volumes(spark, str(src), out)
    assert meta.count() == 1 and errors.count() == 1
    (src / "b.nii.gz").write_bytes(gzip.compress(nifti(grid(2), affine)))
    (src / "c.nii").write_bytes(nifti(grid(3), affine))
    for _ in range(2):
        lines, meta, errors = ingest.ingest_volumes(spark, str(src), out)
        assert errors.count() == 0
        total = lines.groupBy("path").agg(F.sum(F.aggregate("vals", F.lit(0.0), lambda a, v: a + v)).alias("s")).collect()
        assert {r.path.split("/")[-1].split(".")[0]: r.s for r in total} == {"a": 1452.0, "b": 2904.0, "c": 4356.0}


def test_ingest_counts_and_failure_limit(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n in "ab":
        (src / f"{n}.nii").write_bytes(nifti(np.zeros((11, 11, 12), "f4"), np.eye(4)))
    for n in "cde":
        (src / f"{n}.nii").write_bytes(b"broken")
    files = lambda: spark.read.format("binaryFile").load(str(src)).select("path", "content")
    for batch in ("x", "y"):
        with pytest.raises(Exception, match="could not be read"):
            ingest.write_images(files().repartition(5, "path"), out, batch, most_failed=2)
    assert store.finished(spark, out, "path") is None
    assert ingest.write_images(files(), out, "x", most_failed=3) == {"good": 2, "failed": 3, "skipped": 0}
    assert ingest.write_images(files(), out, "x", most_failed=3) is None
    (src / "c.nii").write_bytes(nifti(np.zeros((11, 11, 12), "f4"), np.eye(4)))
    assert ingest.write_images(files(), out, "z") == {"good": 1, "failed": 2, "skipped": 2}
    _, meta, errors = ingest.read_images(spark, out)
    assert meta.count() == 3 and errors.count() == 2


META = "vol_id bigint, nx int, ny int, nz int, rx double, ry double, rz double, affine array<array<double>>"


def test_reports_of_three_arrivals_equal_one_run(spark, tmp_path):
    from gridloom.streaming.incremental import run_new_reports, write_report
    rng = np.random.default_rng(0)
    rows = []
    for v in (1, 2, 3, 4, 5):
        for x, y, z in np.ndindex(4, 3, 2):
            p = rng.dirichlet([1, 1, 1])
            rows += [(v, x, y, z, lab, float(q)) for lab, q in zip((0, 2, 3), p)]
    posteriors = spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int, label int, p double")
    meta = spark.createDataFrame([(v, 4, 3, 2, 1.0, 1.0, 2.0, np.eye(4).tolist()) for v in range(1, 7)], META)
    gt = spark.createDataFrame([(v, x, 0, 0, 2) for v in range(1, 7) for x in range(4)], "vol_id bigint, x int, y int, z int, label int")
    qc = spark.createDataFrame([(v, 2, 0.5 + v / 100) for v in range(1, 7)], "vol_id bigint, label int, score double")
    given = {"posteriors": posteriors, "meta": meta, "gt": gt, "qc_scores": qc}
    manifest = lambda *ids: spark.createDataFrame([(v, f"/in/{v}") for v in ids], "vol_id bigint, path string")
    whole, parts, src = str(tmp_path / "whole"), str(tmp_path / "parts"), str(tmp_path / "src")
    assert write_report(manifest(1, 2, 3, 4, 5, 6), given, whole, "all", [0, 2, 3], fast=True)
    for ids in ((1, 2), (3, 6), (4, 5, 1)):
        manifest(*ids).coalesce(1).write.mode("append").parquet(src)
        run_new_reports(spark, src, str(tmp_path / "cp"), parts, lambda todo: given, [0, 2, 3], fast=True)

    def tables(path):
        found = {}
        for name in ("seg", "posteriors", "volumes", "errors", "qc", "scores"):
            df = store.read_table(spark, path, name)
            found[name] = sorted(map(repr, df.select(*sorted(df.columns)).collect()))
        return found

    want = tables(whole)
    assert all(want.values()) and "vol_id=6" in want["errors"][0]
    assert tables(parts) == want
    # A replayed batch: the same stream from the start, and a batch by hand.
    run_new_reports(spark, src, str(tmp_path / "cp2"), parts, lambda todo: given, [0, 2, 3], fast=True)
    assert not write_report(manifest(1, 2), given, parts, "0000000000", [0, 2, 3], fast=True)
    assert tables(parts) == want
