"""Small volumes solved whole: the voxels of a volume in one slab of x planes travel as one row of numbers.

Voxels are merged into such rows before their only shuffle, by (keys, slab). Volumes with more than one slab, with more cells
than a block may have, or with voxels outside their grid are left to the operators that keep the planes of a volume apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.layout import WIDTH, by_sort
from gridloom.operators.lines import lower_envelope
from gridloom.session import materialize

AXES = ("x", "y", "z")
#: A number holds the plane in its slab and y and z counted from -HALF; its bits: 4, 30 and 30.
HALF = 1 << 29
#: Most cells of a whole volume, most on one of its axes, and cells of the grids that are worked on at once.
MOST, LONGEST, TOGETHER = 1 << 18, 1024, 1 << 18
#: Pairs that are compared at once.
PAIRS = 1 << 21
#: The number that stands for no value, and a payload that stands for null.
NONE, NULL = np.int32(1) << 29, np.iinfo(np.int64).min


def pack(rows: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """(keys, _part, _c, _lo, _hi[, _v]): one row per slab of a volume, written once.

    ``_c`` are the voxels as numbers, as often as they are listed, ``_lo`` and ``_hi`` their ends per axis, ``_v`` the integer column ``value``.
    """
    fields = [*keys, *AXES, *([value] if value else [])]
    named = rows.where(" AND ".join(f"{a} IS NOT NULL" for a in AXES)).select(
        *keys, *[F.col(a).cast("int").alias(a) for a in AXES], *([F.col(value).cast("bigint").alias(value)] if value else []))
    ends = [f"_{side}{a}" for side in ("l", "h") for a in AXES]
    schema = T.StructType([named.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("_part", *ends)] + [
        T.StructField(c, T.ArrayType(T.LongType())) for c in ("_c", *(["_v"] if value else []))])
    packed = named.select(*fields).mapInArrow(_merge(keys, value, [f.name for f in schema]), schema)
    whole = lambda c: F.flatten(F.collect_list(c)).alias(c)
    # Few bytes, much work: a given number of tasks is not coalesced, and as many files are read in as many tasks as there are cores.
    dealt = packed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_part")
    return materialize(dealt.groupBy(*keys, "_part").agg(
        whole("_c"), *([whole("_v")] if value else []),
        F.array(*[F.min(f"_l{a}") for a in AXES]).alias("_lo"), F.array(*[F.max(f"_h{a}") for a in AXES]).alias("_hi")))


def _merge(keys: list[str], value: str | None, names: list[str]):
    """Voxels in, one row per (keys, slab) of their batch out."""
    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y, z = (np.asarray(batch[a], np.int64) for a in AXES)
        if min(y.min(), z.min()) < -HALF or max(y.max(), z.max()) >= HALF:
            raise ValueError(f"y and z of a voxel should lie in {-HALF}..{HALF - 1}")
        part = x // WIDTH
        group = part - part.min()
        for k in keys:
            place = np.asarray(pc.fill_null(batch[k].dictionary_encode().indices, -1), np.int64)
            group = np.unique(group, return_inverse=True)[1] * (place.max() + 2) + place + 1
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int32()), pa.array(v))
        low, high = ([pa.array(f.reduceat(c[order], first), pa.int32()) for c in (x, y, z)] for f in (np.minimum, np.maximum))
        code = (x % WIDTH << 60) | (y + HALF << 30) | (z + HALF)
        more = [lists(np.asarray(pc.fill_null(batch[value], NULL), np.int64)[order])] if value else []
        head = [batch[k].take(pa.array(order[first])) for k in keys]
        return pa.RecordBatch.from_arrays([*head, pa.array(part[order[first]], pa.int32()), *low, *high, lists(code[order]), *more], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (merge(b) for b in batches if b.num_rows)
    return run


def unpack(blocks: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """The voxels of ``pack``."""
    at = f"inline(arrays_zip(_c{', _v' if value else ''}))"
    return blocks.select(*keys, "_part", F.expr(at)).select(
        *keys, F.expr(f"_part * {WIDTH} + CAST(shiftrightunsigned(_c, 60) AS INT)").alias("x"),
        F.expr(f"CAST((shiftright(_c, 30) & {2 * HALF - 1}) - {HALF} AS INT)").alias("y"),
        F.expr(f"CAST((_c & {2 * HALF - 1}) - {HALF} AS INT)").alias("z"),
        *([F.expr(f"nullif(_v, {NULL + 1}L - 1L)").alias(value)] if value else []))


def give_shape(blocks: DataFrame, shape) -> DataFrame:
    """Blocks with _n, the size of their grid; null where a table of shapes does not list the volume once."""
    if isinstance(shape, DataFrame):
        size = shape.groupBy("vol_id").agg(*[F.first(f"n{a}").cast("int").alias(f"n{a}") for a in AXES], F.count("*").alias("_m"))
        return blocks.join(by_sort(size.select("vol_id", F.when(F.col("_m") == 1, F.array(*[f"n{a}" for a in AXES])).alias("_n"))), "vol_id", "left")
    return blocks.withColumn("_n", F.array(*[F.lit(int(n)) for n in shape]))


#: Blocks whose volume may reach into other slabs, or that are too large; and blocks with voxels outside their grid.
LARGE = (f"_part <> 0 OR {' OR '.join(f'_hi[{i}] - _lo[{i}] >= {LONGEST}' for i in range(3))} OR "
         f"{' * '.join(f'(CAST(_hi[{i}] AS BIGINT) - _lo[{i}] + 3)' for i in range(3))} > {MOST}")
#: Blocks with a voxel listed more than once: neighbours and runs count its rows, so they stay with the operators on rows.
TWICE = "size(array_distinct(_c)) < size(_c)"
OUTSIDE = "_n IS NULL OR " + " OR ".join(f"_lo[{i}] < 0 OR _hi[{i}] >= _n[{i}]" for i in range(3))


def split(blocks: DataFrame, keys: list[str], odd: str) -> tuple[DataFrame, DataFrame]:
    """(blocks of volumes to solve whole, blocks of the others): a volume with one block that is ``odd``, or with a null key, is one of the others."""
    odd = f"coalesce({odd}, true) OR {' OR '.join(f'{k} IS NULL' for k in keys)}"
    marked = materialize(blocks.where(odd).select(*[F.col(k).alias(f"_of_{k}") for k in keys]).distinct())
    if marked.isEmpty():
        return blocks, blocks.where(odd)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return blocks.join(by_sort(marked), same, "left_anti"), materialize(blocks.join(by_sort(marked), same, "left_semi"))


class Grids:
    """Dense grids of the blocks of a record batch: all start at ``low`` (rows, 3) and have one size."""

    def __init__(self, batch: pa.RecordBatch, low: np.ndarray, size: np.ndarray):
        self.batch, self.low, self.size, self.own = batch, low, size.max(axis=0), size
        self.rows = batch.num_rows
        self.count = np.asarray(pc.list_value_length(batch["_c"]), np.int64)
        code = np.asarray(batch["_c"].flatten(), np.int64)
        self.row = np.repeat(np.arange(self.rows), self.count)
        part = np.asarray(batch["_part"], np.int64)[self.row]
        self.at = np.stack([(code >> 60 & 15) + part * WIDTH, (code >> 30 & 2 * HALF - 1) - HALF, (code & 2 * HALF - 1) - HALF], axis=1)
        self.value = np.asarray(batch["_v"].flatten(), np.int64) if "_v" in batch.schema.names else None
        if "perm" in batch.schema.names:
            perm, flip, n = _turn(batch)
            turned = np.take_along_axis(self.at, perm[self.row], axis=1)
            self.at = np.where(flip[self.row], n[self.row] - 1 - turned, turned)

    def cell(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        return (row, *(at - self.low[row]).T)

    def mask(self, some=slice(None)) -> np.ndarray:
        grid = np.zeros((self.rows, *self.size), bool)
        grid[self.cell(self.row[some], self.at[some])] = True
        return grid

    def there(self) -> np.ndarray:
        """Cells that a block has: the grids of smaller blocks end earlier."""
        inside = np.ones((self.rows, *self.size), bool)
        for i, n in enumerate(self.size):
            shape = [self.rows, 1, 1, 1]
            shape[i + 1] = n
            inside &= (np.arange(n) < self.own[:, i, None]).reshape(shape)
        return inside

    def voxels(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and coordinates of the true cells."""
        row, *at = np.nonzero(grid)
        return row, np.stack(at, axis=1) + self.low[row]


def ends(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch[c].flatten(), np.int64).reshape(-1, 3) for c in names]


def solve(blocks: DataFrame, keys: list[str], columns: list[tuple[str, T.DataType]], bounds: Callable, work: Callable) -> DataFrame:
    """Apply ``work`` to the blocks: Grids to (row of each result, values of ``columns``); ``bounds`` gives their low ends and sizes.

    A column _w of the blocks is the number of pairs that ``work`` holds at once for a block.
    """
    schema = T.StructType([blocks.schema[k] for k in keys] + [T.StructField(c, t) for c, t in columns])
    types = [pa.int32() if isinstance(t, T.IntegerType) else pa.float64() for _, t in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low, size = bounds(batch)
            weight = np.asarray(batch["_w"], np.int64) if "_w" in batch.schema.names else np.zeros(batch.num_rows, np.int64)
            order = np.argsort(size.prod(axis=1), kind="stable")
            while len(order):
                most = np.maximum.accumulate(size[order], axis=0).prod(axis=1) * np.arange(1, len(order) + 1)
                fit = min(np.searchsorted(most, TOGETHER, "right"), np.searchsorted(np.cumsum(weight[order]), PAIRS, "right"))
                now = order[:max(1, int(fit))]
                order = order[len(now):]
                part = batch.take(pa.array(now))
                row, *values = work(Grids(part, low[now], size[now]))
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part[k].take(of) for k in keys), *(pa.array(v, t) if not isinstance(v, pa.Array) else v for v, t in zip(values, types))],
                                                 [f.name for f in schema])
    return blocks.mapInArrow(run, schema)


def box(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The box of the voxels."""
    low, high = ends(batch, "_lo", "_hi")
    return low, high - low + 1


def _turn(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """perm, flip and size of the turned grid (``geometry.align_plan``)."""
    perm, n = ends(batch, "perm", "_n")
    return perm, np.asarray(batch["flip"].flatten().cast(pa.int64())).reshape(-1, 3) > 0, n


def turned_box(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The box of the voxels after their axes are permuted and reversed."""
    perm, flip, n = _turn(batch)
    low, size = (np.take_along_axis(c, perm, axis=1) for c in box(batch))
    return np.where(flip, n - low - size, low), size


def box_and_rim(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The box of the voxels and a cell more on each side that the grid has."""
    low, high, n = ends(batch, "_lo", "_hi", "_n")
    low, high = np.maximum(low - 1, 0), np.minimum(high + 1, n - 1)
    return low, high - low + 1


def whole_grid(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n, = ends(batch, "_n")
    return np.zeros_like(n), n


def squared_distances(f: np.ndarray, axes=(1, 2, 3), scale: int = 1) -> np.ndarray:
    """min over cells of f + scale * squared distance, along the given axes of (rows, x, y, z); NONE or more where there is nothing."""
    for axis in axes:
        n = f.shape[axis]
        f = np.moveaxis(f, axis, 0)
        if n <= 32:
            f = np.ascontiguousarray(f)
            out = f.copy()
            for step in range(1, n):
                add = f.dtype.type(scale * step * step)
                np.minimum(out[step:], f[:-step] + add, out=out[step:])
                np.minimum(out[:-step], f[step:] + add, out=out[:-step])
        else:
            far = np.iinfo(f.dtype).max // 2 + 1 if f.dtype == np.int64 else int(NONE)
            wide = np.where(f >= far, np.int64(1) << 61, f.astype(np.int64)).reshape(n, -1)
            out = np.minimum(lower_envelope(wide, scale), far).astype(f.dtype).reshape(f.shape)
        f = np.moveaxis(out, 0, axis)
    return f


def distances_to(seeds: np.ndarray) -> np.ndarray:
    """Squared distance of every cell to the nearest true one; NONE or more without any."""
    return squared_distances(np.where(seeds, np.int32(0), NONE))


def components(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """For each true cell the first cell of its component, as a number in raster order within its row; elsewhere their count."""
    cells = int(np.prod(mask.shape[1:]))
    label = np.where(mask, np.arange(cells, dtype=np.int32).reshape(mask.shape[1:]), np.int32(cells))
    live = np.arange(len(mask))
    while len(live):
        was, m = label[live], mask[live]
        low = was.copy()
        for axis in (1, 2, 3):
            # Face neighbours are those of the cells themselves; the full neighbourhood goes on from axis to axis.
            a = np.moveaxis(was if connectivity == 6 else low.copy(), axis, 0)
            b = np.moveaxis(low, axis, 0)
            np.minimum(b[1:], a[:-1], out=b[1:])
            np.minimum(b[:-1], a[1:], out=b[:-1])
        low[~m] = cells
        flat = np.concatenate([low.reshape(len(live), -1), np.full((len(live), 1), cells, np.int32)], axis=1)
        label[live] = np.take_along_axis(flat, low.reshape(len(live), -1), axis=1).reshape(low.shape)
        live = live[(label[live] != was).any(axis=(1, 2, 3))]
    return label


def in_largest(g: Grids, connectivity: int) -> np.ndarray:
    """Which voxels lie in the largest component of their row; the first one in raster order on ties."""
    label = components(g.mask(), connectivity)
    cells = int(np.prod(label.shape[1:]))
    own = label[g.cell(g.row, g.at)]
    best = np.bincount(g.row * cells + own, minlength=g.rows * cells).reshape(g.rows, cells).argmax(axis=1)
    return own == best[g.row]


def holes(mask: np.ndarray, there: np.ndarray) -> np.ndarray:
    """False cells that no path of false cells leads to from the faces of a block; ``there``: cells of the block."""
    free = ~mask & there
    outer = np.zeros_like(free)
    for axis in (1, 2, 3):
        a, inside = np.moveaxis(outer, axis, 0), np.moveaxis(there, axis, 0)
        a[0] = True
        a[-1] = True
        a[:-1] |= ~inside[1:]
    outer &= free
    live = np.arange(len(free))
    while len(live):
        o, f = outer[live], free[live]
        before = o.sum(axis=(1, 2, 3))
        for axis in (1, 2, 3):
            a, b = np.moveaxis(o, axis, 0), np.moveaxis(f, axis, 0)
            for q in range(1, len(a)):
                a[q] |= a[q - 1] & b[q]
            for q in range(len(a) - 2, -1, -1):
                a[q] |= a[q + 1] & b[q]
        outer[live] = o
        live = live[o.sum(axis=(1, 2, 3)) > before]
    return free & ~outer
