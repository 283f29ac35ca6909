"""No operator on voxels and facts of their volume gathers a volume: plans with broadcasts off, and results."""

import re

import numpy as np
import pytest

from gridloom.functions import layout
from gridloom.operators import geometry as ge

META = "vol_id bigint, nx int, ny int, nz int, rx double, ry double, rz double, affine array<array<double>>"


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    path = str(tmp_path_factory.mktemp("voxels") / "all")
    affine = np.array([[0, -1.0, 0, 0], [1.0, 0, 0, 0], [0, 0, -1.0, 0], [0, 0, 0, 1]]).tolist()
    rows = [(v, int(x), int(y), int(z), float(rng.integers(0, 9))) for v in (1, 2) for x, y, z in np.ndindex(40, 3, 4)]
    spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int, value double").write.parquet(path)
    meta = spark.createDataFrame([(v, 40, 3, 4, 1.0, 1.0, 1.0, affine) for v in (1, 2)], META)
    return spark.read.parquet(path), meta


def operators(df, meta):
    boxes = ge.centre_crop_box(meta, shape=(30, 2, 3))
    size = meta.select("vol_id", "nx", "ny", "nz")
    return {
        "D1": ge.centre_crop(df, meta, shape=(30, 2, 3))[0], "D3": ge.crop_to_box(df, boxes), "D4": ge.pad(df, meta, [44, 4, 6])[0],
        "D5": ge.flip(df, size, 0), "D5 by direction": ge.flip_direction(df, meta, "ap"), "D7": ge.align(df, meta)[0],
        "D12": ge.pad_to_max_shape(df, meta, 3)[0], "D18": ge.paste_back(df, boxes, value="value"),
        "D13": ge.crop_to_common_min(df.withColumn("label", df.value.cast("int")), meta, df)[1],
    }


def exchanges(plan):
    """(partitioning, columns) of every exchange below."""
    found = []

    def walk(node):
        if node.nodeName() == "Exchange":
            found.append((node.outputPartitioning().toString(), node.output().mkString(",")))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_voxels_are_not_shuffled_by_volume_alone(cohort, no_broadcast):
    for name, out in operators(*cohort).items():
        voxels = [p for p, columns in exchanges(out._jdf.queryExecution().executedPlan()) if "value#" in columns]
        assert voxels and all("_slab#" in p for p in voxels), (name, voxels)


def test_stored_slabs_are_not_shuffled_at_all(spark, cohort, no_broadcast, tmp_path):
    df, meta = cohort
    want = {name: sorted(map(tuple, out.select("vol_id", "x", "y", "z", "value").collect())) for name, out in operators(df, meta).items()}
    spark.sql("DROP TABLE IF EXISTS slabs_test")
    try:
        stored = layout.write_slabs(df, "slabs_test", 4, str(tmp_path / "slabs"))
        for name, out in operators(stored, meta).items():
            moved = [p for p, columns in exchanges(out._jdf.queryExecution().executedPlan()) if "value#" in columns]
            assert not moved, (name, moved)
            assert sorted(map(tuple, out.select("vol_id", "x", "y", "z", "value").collect())) == want[name]
        # The slab goes along, so that a chain of operators needs no exchange either.
        chain = ge.flip(ge.pad(ge.crop_to_box(stored, ge.centre_crop_box(meta, shape=(30, 2, 3))), meta, [44, 4, 6])[0],
                        meta.select("vol_id", "nx", "ny", "nz"), 1)
        assert not [p for p, columns in exchanges(chain._jdf.queryExecution().executedPlan()) if "value#" in columns]
    finally:
        spark.sql("DROP TABLE IF EXISTS slabs_test")


@pytest.mark.parametrize("name", ["connected_components", "correct_labels_nearest", "crop_to_box", "crop_to_common_min", "crop_same_size", "erode_labels",
                                  "largest_component", "signed_distance", "crop_divisible", "edt", "fill_holes", "intensity_priors_multi"])
def test_no_table_that_grows_is_broadcast(spark, name):
    """Exploded and well compressed tables look small to the planner; only the list of distinct labels is."""
    import __spark_entry__ as entry
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert "SortMergeJoin" in plan and not [line for line in joins if not re.search("_cand|_at|_place", line)]


def test_posteriors_are_made_in_one_shuffle_of_a_given_number_of_tasks(spark):
    """No join, and tasks that coalescing cannot make fewer: what groups by voxel next holds its share of the voxels only."""
    import __spark_entry__ as entry
    plan = entry.queries()["cross_entropy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if re.search(r"\bExchange ", line)]
    assert "Join" not in plan and len(moved) == 3
    assert sum("REPARTITION_BY_NUM" in line for line in moved) == 2
