"""One-axis passes over packed grid lines, and the exact Euclidean distance built on the same layout.

A volume enters as voxel rows (sparse rows are fine: a missing voxel has the fill value). Rows are shuffled once by
(keys, x): grouping by (keys, x, y) and then by (keys, x) needs no further exchange, so the z pass and the y pass run
inside one stage on arrays. The x pass needs a second exchange by (keys, y), of packed lines instead of voxel rows.
Every group is one plane of a volume, however many voxels a single volume or key owns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.layout import SLAB, WIDTH, by_sort, by_volume

AXES = ("x", "y", "z")
#: Cells of a block of lines, and the number that stands for no value.
CELLS, FAR = 1 << 20, np.int64(1) << 61
# A pass maps (index i, length n, ref) to the SQL of output element i; ref(j) is the SQL of input element j.
Element = Callable[[str, str, Callable[[str], str]], str]


class Pass:
    """One step along an axis: ``element`` SQL and, where the length changes, ``length`` SQL."""

    def __init__(self, element: Element, length: Callable[[str], str] | None = None):
        self.element = element
        self.length = length or (lambda n: n)


def shape_sql(shape) -> tuple[dict[str, str], list[str]]:
    """(axis -> SQL length, columns that must be carried) for a literal shape or 'columns nx, ny, nz'."""
    if shape is None:
        return {a: f"n{a}" for a in AXES}, [f"n{a}" for a in AXES]
    return {a: str(int(n)) for a, n in zip(AXES, shape)}, []


def attach_shape(df: DataFrame, shape) -> tuple[DataFrame, tuple | None]:
    """Give voxel rows their grid size. ``shape``: a tuple for all volumes, a table (vol_id, nx, ny, nz), or
    None where the columns nx, ny, nz are there already."""
    if isinstance(shape, DataFrame):
        size = shape.select("vol_id", "nx", "ny", "nz")
        return by_volume(df, size).drop(*{SLAB} - {*df.columns}) if "x" in df.columns else df.join(by_sort(size), "vol_id"), None
    return df, None if shape is None else tuple(shape)


def separable(df: DataFrame, keys: list[str], value: str, shape, passes: dict[str, list[Pass]],
              fill: str = "0D", carry: list[str] | None = None) -> DataFrame:
    """Run one-axis passes over every grid. ``shape``: tuple, or None for columns nx, ny, nz of ``df``.

    ``carry`` names further columns that are constant per key and used by the passes. The result is dense:
    keys, carry, x, y, z and ``value``; grids without a single row give none.
    """
    n, dims = shape_sql(shape)
    group = [*keys, *dims, *(carry or [])]
    dense = lambda entries, size, missing: bind("m", f"map_from_entries(collect_list({entries}))",
                                                f"transform(sequence(0, {size} - 1), i -> coalesce(m[i], {missing}))")
    lines = (
        df.select(*group, "x", "y", "z", F.col(value).alias("_v"))
        .repartition(*keys, "x")
        .groupBy(*group, "x", "y").agg(F.expr(dense("struct(z, _v)", n["z"], fill)).alias("_a"))
    )
    size = dict(n)
    for step in passes.get("z", []):
        out = step.length(size["z"])
        body = step.element("i", size["z"], lambda j: f"a[{j}]")
        lines = lines.withColumn("_a", F.expr(bind("a", "_a", f"transform(sequence(0, {out} - 1), i -> {body})")))
        size["z"] = out
    empty = f"array_repeat({fill}, CAST({size['z']} AS INT))"
    planes = lines.groupBy(*group, "x").agg(F.expr(dense("struct(y, _a)", n["y"], empty)).alias("_a"))
    planes = _plane_passes(planes, passes.get("y", []), size, "y")
    rows = planes.select(*group, "x", F.posexplode("_a").alias("y", "_a"))
    stacks = rows.groupBy(*group, "y").agg(F.expr(dense("struct(x, _a)", n["x"], empty)).alias("_a"))
    stacks = _plane_passes(stacks, passes.get("x", []), size, "x")
    return (
        stacks.select(*group, "y", F.posexplode("_a").alias("x", "_a"))
        .select(*group, "x", "y", F.posexplode("_a").alias("z", value))
        .select(*keys, *(carry or []), "x", "y", "z", value)
    )


def bind(name: str, expression: str, body: str) -> str:
    """SQL that evaluates ``expression`` once and uses it as ``name`` in ``body``.

    A plain column would do the same on paper, but the optimizer may push its definition into a lambda of the next
    projection, where it is computed again for every element.
    """
    return f"transform(array({expression}), {name} -> {body})[0]"


def _plane_passes(planes: DataFrame, steps: list[Pass], size: dict[str, str], axis: str) -> DataFrame:
    for step in steps:
        out = step.length(size[axis])
        body = step.element("i", size[axis], lambda j: f"a[{j}][k]")
        planes = planes.withColumn("_a", F.expr(bind(
            "a", "_a", f"transform(sequence(0, {out} - 1), i -> transform(sequence(0, {size['z']} - 1), k -> {body}))")))
        size[axis] = out
    return planes


def fold(j: str, n: str, edge: str) -> str:
    """SQL of a grid index pulled back inside [0, n): edge value, mirror, or NULL outside."""
    if edge == "nearest":
        return f"least(greatest({j}, 0), {n} - 1)"
    if edge == "reflect":
        p = f"pmod({j}, 2 * {n})"
        return f"CASE WHEN {p} < {n} THEN {p} ELSE 2 * {n} - 1 - {p} END"
    raise ValueError(f"edge should be nearest or reflect, had {edge}")


def distance_to(points: DataFrame, seeds: DataFrame, keys: list[str], out: str = "d2",
                payload: str | None = None, payload_size: int = 1, payload_out: str = "payload") -> DataFrame:
    """Exact squared Euclidean distance from every point to the nearest seed with the same keys.

    Separable lower envelopes: Spark groups the seeds by plane (keys, x), and the plane results by (keys, y) with the
    points of that row; each pass takes the lower envelope of the parabolas on a line, for all lines of an Arrow batch
    at once, in time proportional to the cells. Only rows some point asks for are passed on.
    ``seeds`` are voxels, or words of 64 cells (``morphology.to_words``); they are read twice, so a costly table of them is better materialized.
    ``payload``: an integer column of the seeds in [0, payload_size); the payload of the nearest seed is returned
    too, the smallest one on ties. It rides in the low digits of the minimised number, so one transform serves all
    candidate labels. Points whose key has no seed get NULL.
    """
    k = int(payload_size)
    order = F.expr(f"CAST({payload} AS BIGINT)" if payload else "0L")
    # Planes lie by (keys, slab of x), and each volume's few wanted rows are repeated for the slabs between its first and
    # last seed, so that the join keeps the planes of a volume apart and a small volume has one such row.
    slab = lambda x: F.floor(F.col(x) / WIDTH).cast("int")
    part = slab("x")
    dealt = seeds.withColumn("_part", part).repartition(*keys, "_part")
    if "bits" in seeds.columns:
        from gridloom.operators.morphology import from_words
        dealt = from_words(dealt)
    planes = (
        dealt.select(*keys, "x", "_part", F.struct("y", "z", order.alias("o")).alias("_s"))
        .groupBy(*keys, "_part", "x").agg(F.collect_list("_s").alias("_s"))
    )
    # What the points need: the y rows, and the z range, of each key.
    rest = [c for c in points.columns if c not in {*keys, "y"}]
    packed = points.groupBy(*keys, "y").agg(F.collect_list(F.struct(*rest)).alias("_p"))
    wanted = points.groupBy(*keys, "y").agg(F.min("z").alias("_z0"), F.max("z").alias("_z1"))
    span = wanted.groupBy(*keys).agg(F.min("_z0").alias("_z0"), F.max("_z1").alias("_z1"),
                                     F.array_sort(F.collect_list("y")).alias("_ys"))
    reach = seeds.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    span = span.join(by_sort(reach), keys).withColumn("_part", F.explode(F.sequence(slab("_x0"), slab("_x1")))).drop("_x0", "_x1")
    kept = [*keys, "x", "_z0"]
    located = planes.join(by_sort(span), [*keys, "_part"]).select(
        *kept, "_z1", "_ys", F.col("_s.y").alias("_y"), F.col("_s.z").alias("_z"), F.col("_s.o").alias("_o"))
    schema = T.StructType([located.schema[c] for c in kept] + [
        T.StructField("y", T.IntegerType()), T.StructField("a", T.ArrayType(T.LongType()))])
    stacks = (
        located.mapInArrow(_plane_rows(kept, k), schema)
        .groupBy(*keys, "y").agg(F.min("_z0").alias("_z0"), F.collect_list(F.struct("x", "a")).alias("_r"))
    )
    rows = packed.join(by_sort(stacks), [*keys, "y"], "left").select(
        *keys, "y", "_z0", F.col("_r.x").alias("_x"), F.flatten("_r.a").alias("_a"), "_p")
    flat = T.StructType([points.schema[c] for c in [*keys, "y", *rest]] + [T.StructField("_b", T.LongType())])
    result = rows.mapInArrow(_stack_points([*keys, "y"], rest, k), flat)
    result = result.withColumn(out, F.expr(f"_b DIV {k}L"))
    if payload:
        result = result.withColumn(payload_out, F.expr(f"CAST(_b % {k}L AS INT)"))
    return result.select(*points.columns, out, *([payload_out] if payload else []))


def lower_envelope(f: np.ndarray, scale: int) -> np.ndarray:
    """min over p of f[p] + scale * (q - p)^2 for every q, for each column of ``f`` (n, m); FAR where there is no value.

    One sweep stacks, per column, the parabolas that are lowest somewhere and where each begins to be; a second one
    reads the values off. Both work on all columns at once, a block of bounded size at a time.
    """
    n, m = f.shape
    out = np.empty_like(f)
    step = max(1, CELLS // max(1, n))
    for a in range(0, m, step):
        out[:, a:a + step] = _envelope_block(f[:, a:a + step], scale)
    return out


def _envelope_block(f: np.ndarray, scale: int) -> np.ndarray:
    n, m = f.shape
    vertex, start = np.zeros((n, m), np.int32), np.zeros((n, m), np.int32)
    top = np.full(m, -1)
    for q in range(n):
        cols = np.flatnonzero(f[q] < FAR)
        begins = np.zeros(len(cols), np.int64)
        rest = np.arange(len(cols))
        while len(rest):
            rest = rest[top[cols[rest]] >= 0]  # with nothing below, the new one is lowest from the start
            c = cols[rest]
            p = vertex[top[c], c].astype(np.int64)
            ahead = f[q, c] - f[p, c] + scale * (q * q - p * p)
            first = -(-ahead // (2 * scale * (q - p)))  # where the new one is as low as the last
            hidden = first <= start[top[c], c]
            begins[rest[~hidden]] = first[~hidden]
            top[c[hidden]] -= 1
            rest = rest[hidden]
            begins[rest] = 0
        seen = begins < n
        c = cols[seen]
        top[c] += 1
        vertex[top[c], c], start[top[c], c] = q, begins[seen]
    out = np.full((n, m), FAR)
    c = np.flatnonzero(top >= 0)
    last, at = top[c], np.zeros(len(c), np.int64)
    for q in range(n):
        after = np.minimum(at + 1, last)
        at = np.where((at < last) & (start[after, c] <= q), after, at)
        p = vertex[at, c].astype(np.int64)
        out[q, c] = f[p, c] + scale * (q - p) ** 2
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists (0 for null ones), and all their numbers in a row."""
    return _lists_sizes(column), np.asarray(column.flatten().cast(pa.int64()), np.int64)


def _ends(sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of each list; none may be empty."""
    starts = np.cumsum(sizes) - sizes
    return np.minimum.reduceat(flat, starts), np.maximum.reduceat(flat, starts)


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows of the given sizes laid end to end: the row of each element, and its place in it."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _chunks(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CELLS cells together, or of one row."""
    at = 0
    while at < len(cells):
        upto = at + max(1, int(np.searchsorted(np.cumsum(cells[at:]), CELLS, "right")))
        yield at, upto
        at = upto


def _plane_rows(kept: list[str], scale: int):
    """Planes in, their solved rows out: per wanted row y the least o + scale * squared distance within the plane."""
    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_seeds, y = _lists(batch["_y"])
        z, o = _lists(batch["_z"])[1], _lists(batch["_o"])[1]
        n_rows, rows = _lists(batch["_ys"])
        z0, z1 = (np.asarray(batch[c], np.int64) for c in ("_z0", "_z1"))
        (y_low, y_high), (r_low, r_high), (z_low, z_high) = _ends(n_seeds, y), _ends(n_rows, rows), _ends(n_seeds, z)
        y_low, z_low = np.minimum(y_low, r_low), np.minimum(z_low, z0)
        height = int((np.maximum(y_high, r_high) - y_low).max()) + 1
        depth = int((np.maximum(z_high, z1) - z_low).max()) + 1
        width = z1 - z0 + 1
        widest = int(width.max())
        # Along z, one column per line that holds a seed.
        plane = np.repeat(np.arange(len(n_seeds)), n_seeds)
        lines, line = np.unique(plane * height + y - y_low[plane], return_inverse=True)
        f = np.full((depth, len(lines)), FAR)
        np.minimum.at(f, (z - z_low[plane], line), o)
        f = lower_envelope(f, scale)
        owner = lines // height
        cut = np.minimum((z0 - z_low)[owner] + np.arange(widest)[:, None], depth - 1)
        f = np.take_along_axis(f, cut, axis=0)
        # Along y, one column per wanted z of each plane.
        g = np.full((height, len(n_seeds), widest), FAR)
        g[lines % height, owner] = f.T
        g = lower_envelope(g.reshape(height, -1), scale).reshape(g.shape)
        of = np.repeat(np.arange(len(n_rows)), n_rows)
        values = g[rows - y_low[of], of]
        size = width[of]
        flat = values[np.arange(widest) < size[:, None]]
        a = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(of)) for c in kept), pa.array(rows, pa.int32()), a], [*kept, "y", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_rows, rows = _lists(batch["_ys"])
                low, high = _ends(n_rows, rows)
                deep = np.asarray(batch["_z1"], np.int64) - np.asarray(batch["_z0"], np.int64) + 1
                yield from (solve(batch.slice(a, b - a)) for a, b in _chunks((high - low + 1) * deep))
    return run


def _stack_points(keys: list[str], rest: list[str], scale: int):
    """Rows (keys, y) with their planes and points in, one row per point out: min over planes of value + scale * dx^2."""
    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        fields = dict(zip(rest, batch["_p"].flatten().flatten()))
        n_points = _lists_sizes(batch["_p"])
        row = np.repeat(np.arange(batch.num_rows), n_points)
        px, pz = (np.asarray(fields[c], np.int64) for c in ("x", "z"))
        n_planes, planes = _lists(batch["_x"])
        n_values, values = _lists(batch["_a"])
        best = np.full(len(row), FAR)
        if len(planes):
            width = n_values // np.maximum(n_planes, 1)
            z0 = np.asarray(pc.fill_null(batch["_z0"], 0), np.int64)
            low, high = np.full(batch.num_rows, np.iinfo(np.int32).max, np.int64), np.full(batch.num_rows, -1)
            of = np.repeat(np.arange(batch.num_rows), n_planes)
            for owner, x in ((of, planes), (row, px)):
                np.minimum.at(low, owner, x)
                np.maximum.at(high, owner, x)
            f = np.full((int((high - low).max()) + 1, batch.num_rows, int(width.max())), FAR)
            plane, z = _places(width[of])
            f[planes[plane] - low[of[plane]], of[plane], z] = values
            f = lower_envelope(f.reshape(f.shape[0], -1), scale).reshape(f.shape)
            some = n_planes[row] > 0
            best[some] = f[(px - low[row])[some], row[some], (pz - z0[row])[some]]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [*(batch[c].take(take) for c in keys), *(fields[c] for c in rest), pa.array(best, pa.int64(), mask=best >= FAR)], [*keys, *rest, "_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.maximum(_lists_sizes(batch["_a"]), _lists_sizes(batch["_p"]))
                yield from (solve(batch.slice(a, b - a)) for a, b in _chunks(cells))
    return run


def _lists_sizes(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
