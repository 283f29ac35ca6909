"""Cases that once lost or changed data."""

import re

import numpy as np
import pytest

from gridloom.operators import aggregate as ag
from gridloom.operators import evaluate as ev
from gridloom.operators import morphology
from gridloom.operators.lines import distance_to
from gridloom.operators.neighbourhood import erode_labels
from gridloom.operators.sampling import weighted_draws
from gridloom.plans import cohort
from gridloom.sources import manifest as mf


@pytest.mark.parametrize("other", [-1, (1 << 20) + 5])
def test_any_label_number_survives_erosion(spark, other):
    rows = [(1, x, 0, 0, 7 if 2 <= x <= 4 else other) for x in range(8)]
    df = spark.createDataFrame(rows, "vol_id long, x int, y int, z int, label int")
    got = {r.label for r in erode_labels(df, [7], [1], (8, 1, 1)).collect()}
    assert got <= {7, other} and other in got


def test_every_draw_meets_a_subject(spark):
    w = np.random.default_rng(0).random(300)
    ends = np.cumsum(w) / w.sum()
    us = [float(u) for e in ends for u in (np.nextafter(e, 0), e, np.nextafter(e, 2)) if u < 1]
    subjects = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "subject int, weight double")
    draws = spark.createDataFrame(list(enumerate(us)), "draw_id int, u double")
    got = [r.draw_id for r in weighted_draws(subjects, draws).collect()]
    assert sorted(got) == list(range(len(us)))


def test_background_counts_whole_grid(spark):
    pairs = lambda cells: spark.createDataFrame([(1, x, 0, 0, g, s) for x, g, s in cells], "vol_id long, x int, y int, z int, gt int, seg int")
    sparse = [(0, 2, 2), (1, 2, 0)]
    dense = sparse + [(x, 0, 0) for x in range(2, 10)]
    got = [{r.label: r.dice for r in ev.dice_by_label(pairs(c), [0, 2], shape=(10, 1, 1)).collect()} for c in (sparse, dense)]
    assert got[0] == got[1] and got[0][0] == pytest.approx(16 / 17, abs=1e-5)


def test_empty_volumes_have_rows(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 2)], "vol_id long, x int, y int, z int, label int")
    both = spark.createDataFrame([(1, 4, 1, 1), (2, 4, 1, 1)], "vol_id long, nx int, ny int, nz int")
    assert {(r.vol_id, r.volume) for r in ag.hard_volumes(df, [0, 2], volumes=both).collect()} == {(1, 1.0), (2, 0.0)}
    assert {tuple(r) for r in ag.foreground_count(df, volumes=both).collect()} == {(1, 1), (2, 0)}
    pairs = ev.pair_maps(df, df)
    scores = {(r.vol_id, r.label): r.dice for r in ev.dice_by_label(pairs, [0, 2], shape=both).collect()}
    assert scores[2, 0] == pytest.approx(1, abs=1e-5) and scores[2, 2] == 0
    assert {r.vol_id: r.mean_distance for r in ev.surface_distances(pairs, [2], both).collect()}[2] == 4


def test_null_keys_stay(spark):
    rows = [(s, i, float(i * i % 7), float(i)) for s in ("a", None) for i in range(9)]
    scores = spark.createDataFrame(rows, "structure string, subject int, ref double, cmp double")
    got = {r.structure: r.n for r in ev.wilcoxon_paired(scores, with_average=False).collect()}
    assert got.keys() == {"a", None} and got["a"] == got[None]
    assert all(r.p_value is None or r.exact for r in ev.wilcoxon_paired(scores, mode="exact").collect())


def test_signed_rank_known_values(spark):
    """Published table of the signed-rank test: n = 8 has P(T <= 3) = 5 / 256 on one side."""
    d = [1, 2, -3, 4, 5, 6, 7, 8]
    scores = spark.createDataFrame([("a", i, float(x), 0.0) for i, x in enumerate(d)], "structure string, subject int, ref double, cmp double")
    row = ev.wilcoxon_paired(scores, with_average=False).head()
    assert row.r_minus == 3 and row.p_value == pytest.approx(2 * 5 / 256)


def test_planes_of_a_volume_stay_apart(spark):
    """Without broadcasts no exchange below the plane work is keyed by the volume alone."""
    df = spark.createDataFrame([(1, x, 0, 0) for x in range(9)], "vol_id long, x int, y int, z int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = distance_to(df, df.where("x < 3"), ["vol_id"])._jdf.queryExecution().executedPlan().toString()
        # The wanted rows are repeated for the slabs between the first seed and the last, not for a fixed number of parts.
        assert re.search(r"Generate explode\(sequence\(.*_x0", plan)
        assert "SortMergeJoin [vol_id" in plan and re.search(r"SortMergeJoin \[vol_id#\d+L, _part#\d+\]", plan)
        assert [r.d2 for r in distance_to(df, df.where("x < 3"), ["vol_id"]).orderBy("x").collect()] == [0, 0, 0, 1, 4, 9, 16, 25, 36]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_refuse_what_would_collide(spark):
    df = spark.createDataFrame([(1, -1, 0, 0), (1, 0, 0, 0)], "vol_id long, x int, y int, z int")
    with pytest.raises(Exception, match="2097151"):
        morphology.largest_component(df).collect()


def test_repetition_is_asked_for(spark):
    a = spark.createDataFrame([("x1",), ("x2",)], "path string")
    b = spark.createDataFrame([("y1",)], "path string")
    with pytest.raises(ValueError):
        mf.pair_by_order(a, b)
    assert sorted(map(tuple, mf.pair_by_order(a, b, repeat=True).collect())) == [(0, "x1", "y1"), (1, "x2", "y1")]
    assert [tuple(r) for r in mf.unpaired(a, b).collect()] == [(1, "x2", None)]
    assert mf.pair_by_order(a, a, mask=a).orderBy("ord").collect()[1].path_mask == "x2"


def test_models_leave_truth_out(spark):
    """A model that predicts one of two labelled voxels is scored against both."""
    gt = spark.createDataFrame([(1, x, 0, 0, 2) for x in range(2)], "vol_id long, x int, y int, z int, label int")
    pred = spark.createDataFrame([("m", 1, 0, 0, 0, 2), ("m", 1, 5, 0, 0, 2)], "model string, vol_id long, x int, y int, z int, label int")
    got = {r.label: r.dice for r in cohort.evaluate_models(pred, gt, [0, 2], shape=(10, 1, 1)).collect()}
    assert got[2] == pytest.approx(2 / 4, abs=1e-5) and got[0] == pytest.approx(14 / 16, abs=1e-5)


def _counted(spark, rows, schema):
    """A table, and an accumulator of the rows of it that have been made."""
    made, df = spark.sparkContext.accumulator(0), spark.createDataFrame(rows, schema)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f
    return df.mapInPandas(count, df.schema), made


def test_priors_make_their_voxels_once(spark):
    rows = [(1 + x % 2, x, 0, 0, float(x), x % 2) for x in range(20)]
    df, made = _counted(spark, rows, "vol_id long, x int, y int, z int, value double, label int")
    assert len(ag.intensity_priors(df, [0, 1]).collect()) == 2 and made.value == len(rows)


def test_finished_posteriors_are_made_once(spark):
    eye = [[float(i == j) for j in range(4)] for i in range(4)]
    meta = spark.createDataFrame([(1, 8, 1, 1, 1.0, 1.0, 1.0, eye)], "vol_id long, nx int, ny int, nz int, rx double, ry double, rz double, affine array<array<double>>")
    rows = [(1, x, 0, 0, 2 * (x % 3 > 0), 1.0) for x in range(8)]
    df, made = _counted(spark, rows, "vol_id long, x int, y int, z int, label int, p double")
    seg, _, _ = cohort.finish_posteriors(df, [0, 2], meta)
    assert seg.where("label = 2").count() == 2 and made.value == len(rows)


def test_truth_is_made_once(spark):
    rows = [(1, x, y, z, 2) for x in range(3) for y in range(3) for z in range(3)]
    gt, made = _counted(spark, rows, "vol_id long, x int, y int, z int, label int")
    seg = spark.createDataFrame(rows, "vol_id long, x int, y int, z int, label int")
    got = {(r.label, r.metric): r.value for r in ev.evaluate_dataset(gt, seg, [0, 2], (5, 5, 5), crop_margin=1).collect()}
    assert got[2, "dice"] == pytest.approx(1, abs=1e-5) and made.value == len(rows)
