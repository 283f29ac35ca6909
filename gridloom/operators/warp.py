"""Affine warps brick by brick.

Source voxels are shuffled once, to the brick that holds them (and, on a lower face, to the brick before as well, since a
position reads the next voxel, too). Targets are never rows before they have their value: a target brick is a row of
three numbers, sent to the source bricks that its image meets, and a task writes out those of its voxels whose position
lies in the source brick at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Voxels along each side of a brick, and target bricks that are handled together.
SIDE, TOGETHER = 16, 4
AXES = ("x", "y", "z")
#: Decimals of a position that count: grid points stay grid points through an inverse.
DECIMALS = 9


def _bricks(n: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / SIDE).cast("int"))


def _target_bricks(grids: DataFrame) -> DataFrame:
    """(vol_id, bx, by, bz, tx, ty, tz): which target bricks may read which source bricks, by the corners of their image."""
    df = grids.where(reduce(lambda a, b: a & b, [F.col(f"n{a}") > 0 for a in AXES]))
    for a in AXES:
        df = df.withColumn(f"t{a}", F.explode(_bricks(F.col(f"n{a}"))))
    for i, a in enumerate(AXES):
        low = high = F.col("t")[i][3]
        for j, b in enumerate(AXES):
            first = F.col("t")[i][j] * F.col(f"t{b}") * SIDE
            last = F.col("t")[i][j] * F.least((F.col(f"t{b}") + 1) * SIDE - 1, F.col(f"n{b}") - 1)
            low, high = low + F.least(first, last), high + F.greatest(first, last)
        inside = lambda p: F.floor(F.least(F.greatest(p, F.lit(0.0)), (F.col(f"s{a}") - 1).cast("double")) / SIDE).cast("int")
        df = df.withColumn(f"b{a}", F.explode(F.sequence(inside(low - 1e-6), inside(high + 1e-6))))
    return df


def _source_bricks(source: DataFrame, value: str) -> DataFrame:
    """(vol_id, bx, by, bz, at, v): each brick's voxels by their place in it, the first planes of the next one included."""
    df = source.select("vol_id", *AXES, F.col(value).cast("double").alias("_v")).where("_v <> 0")
    place = F.lit(0)
    for a in AXES:
        own = F.floor(F.col(a) / SIDE).cast("int")
        df = df.withColumn(f"b{a}", F.explode(F.when((F.col(a) % SIDE == 0) & (F.col(a) > 0), F.array(own, own - 1)).otherwise(F.array(own))))
        place = place * (SIDE + 1) + F.col(a) - F.col(f"b{a}") * SIDE
    return df.groupBy("vol_id", "bx", "by", "bz").agg(F.collect_list(F.struct(place.cast("int").alias("at"), "_v")).alias("_s"))


def affine_reads(grids: DataFrame, source: DataFrame, method: str = "linear", outside: str = "zero", value: str = "value") -> DataFrame:
    """(vol_id, x, y, z, value) on every cell of ``grids``: (vol_id, nx, ny, nz, sx, sy, sz, t).

    A target cell reads the ``source`` (sparse, a missing voxel is 0) of sx * sy * sz voxels at the affine image of its
    coordinates, ``t`` being the rows of the map (a fourth one is not read). 'linear' or 'nearest' (the lower voxel at exactly one half).
    ``outside``: 'zero' gives 0 beyond the source grid, 'clamp' repeats the border.
    """
    if method not in ("linear", "nearest") or outside not in ("zero", "clamp"):
        raise ValueError(f"unknown method {method} or outside {outside}")
    brick = ["vol_id", "bx", "by", "bz"]
    facts = ["nx", "ny", "nz", "sx", "sy", "sz", "t"]
    together = [F.floor(F.col(f"t{a}") / TOGETHER) for a in AXES]
    wanted = (_target_bricks(grids).groupBy(*brick, *together)
              .agg(*[F.first(c).alias(c) for c in facts], F.collect_list(F.array(*[f"t{a}" for a in AXES])).alias("_t")))
    bricks = wanted.join(_source_bricks(source, value), brick, "left").select(
        *brick, *facts, F.flatten("_t").alias("_t"), F.col("_s.at").alias("_at"), F.col("_s._v").alias("_v"))
    schema = f"vol_id {source.schema['vol_id'].dataType.simpleString()}, x int, y int, z int, {value} double"
    return bricks.mapInArrow(_read_bricks(method, outside == "zero", value), schema)


def _read_bricks(method: str, zero: bool, value: str):
    inner = np.stack(np.meshgrid(*[np.arange(SIDE)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)

    def read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        get = lambda c: batch[c][i].as_py()
        n, s, low = (np.array([get(f"{p}{a}") for a in AXES]) for p in ("n", "s", "b"))
        low = low * SIDE
        t = np.array(get("t")[:3], float)
        targets = np.asarray(batch["_t"][i].values, np.int64).reshape(-1, 1, 3) * SIDE + inner
        targets = targets.reshape(-1, 3)
        targets = targets[(targets < n).all(axis=1)]
        p = np.round(targets @ t[:, :3].T + t[:, 3], DECIMALS)
        held = np.clip(p, 0, s - 1)
        floor = np.floor(held).astype(np.int64)
        mine = (floor // SIDE * SIDE == low).all(axis=1)
        targets, p, held, floor = targets[mine], p[mine], held[mine], floor[mine]
        cells = np.zeros((SIDE + 1) ** 3)
        if batch["_at"][i].is_valid:
            cells[np.asarray(batch["_at"][i].values)] = np.asarray(batch["_v"][i].values)
        cells = cells.reshape((SIDE + 1,) * 3)
        at = floor - low
        if method == "nearest":
            at = np.ceil(held - 0.5).astype(np.int64) - low
            out = cells[at[:, 0], at[:, 1], at[:, 2]]
        else:
            w = held - floor
            out = np.zeros(len(at))
            for c in np.ndindex(2, 2, 2):
                part = np.where(c, w, 1 - w).prod(axis=1)
                out += part * cells[tuple((at + c).T)]
        if zero:
            out[((p < 0) | (p > s - 1)).any(axis=1)] = 0.0
        return targets, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vol_id", *AXES, value]
        for batch in batches:
            found, owners, held = [], [], 0
            for i in range(batch.num_rows):
                targets, out = read(batch, i)
                found.append((targets, out))
                owners.append(np.full(len(out), i))
                held += len(out)
                if held >= 1 << 18 or i == batch.num_rows - 1:
                    at = np.concatenate([t for t, _ in found]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch["vol_id"].take(pa.array(np.concatenate(owners))), *(pa.array(np.ascontiguousarray(at[:, j])) for j in range(3)),
                         pa.array(np.concatenate([v for _, v in found]))], names)
                    found, owners, held = [], [], 0
    return run
