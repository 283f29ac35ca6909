"""Binary masks: neighbours, dilation, erosion, hole filling and connected components.

Masks are sparse voxel rows (keys, x, y, z), or *runs*: maximal z-intervals (keys, x, y, z0, z1) of true voxels, the
working form of everything below. A solid region needs far fewer runs than voxels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.layout import by_sort
from gridloom.functions.numbers import linear_index
from gridloom.operators import blocks
from gridloom.operators.lines import attach_shape
from gridloom.session import materialize


def to_runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps and islands along z; one shuffle of the true voxels."""
    w = Window.partitionBy(*keys, "x", "y").orderBy("z")
    return (
        mask.select(*keys, "x", "y", "z").withColumn("_island", F.col("z") - F.row_number().over(w))
        .groupBy(*keys, "x", "y", "_island").agg(F.min("z").alias("z0"), F.max("z").alias("z1")).drop("_island")
    )


def from_runs(runs: DataFrame) -> DataFrame:
    cols = [c for c in runs.columns if c not in ("z0", "z1")]
    return runs.select(*cols, F.explode(F.sequence("z0", "z1")).alias("z"))


def ball_offsets(spark, radius: float, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Offsets (dx, dy, dz) of the Euclidean ball, optionally inside a smaller bounding shape."""
    half = [int(s / 2) for s in shape] if shape else [int(radius)] * 3
    odd = [s % 2 for s in shape] if shape else [1] * 3
    seqs = [f"explode(sequence({-h}, {h if o else h - 1}))" for h, o in zip(half, odd)]
    return (
        spark.range(1).select(F.expr(seqs[0]).alias("dx")).select("dx", F.expr(seqs[1]).alias("dy"))
        .select("dx", "dy", F.expr(seqs[2]).alias("dz"))
        .where(F.expr(f"dx * dx + dy * dy + dz * dz <= {radius * radius}"))
    )


def _disk(radius: float) -> list[tuple[int, int, int]]:
    """(dx, dy, h): the ball of this radius as columns of half-height h."""
    r = int(radius)
    return [(dx, dy, int(math.floor(math.sqrt(radius * radius - dx * dx - dy * dy))))
            for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= radius * radius]


def _coverage(runs: DataFrame, keys: list[str], radius: float, sign: int, need: int) -> DataFrame:
    """Shift every run by each column of the ball, growing (+1) or shrinking (-1) it, and keep the stretches of a line
    covered at least ``need`` times. The cover count is a running sum of +1/-1 events, which are pre-aggregated."""
    disk = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(h).alias("h"))
                     for a, b, h in _disk(radius)])
    moved = (
        runs.withColumn("_o", F.explode(disk))
        .select(*keys, (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"),
                (F.col("z0") - sign * F.col("_o.h")).alias("z0"), (F.col("z1") + sign * F.col("_o.h")).alias("z1"))
        .where("z0 <= z1")
    )
    events = moved.select(*keys, "x", "y", F.explode(F.array(
        F.struct(F.col("z0").alias("z"), F.lit(1).alias("d")),
        F.struct((F.col("z1") + 1).alias("z"), F.lit(-1).alias("d")))).alias("_e")) \
        .groupBy(*keys, "x", "y", F.col("_e.z").alias("z")).agg(F.sum("_e.d").alias("_d"))
    line = Window.partitionBy(*keys, "x", "y").orderBy("z")
    covered = events.withColumn("_on", F.sum("_d").over(line.rowsBetween(Window.unboundedPreceding, 0)) >= need)
    edges = covered.withColumn("_was", F.coalesce(F.lag("_on").over(line), F.lit(False))).where("_on <> _was")
    return (edges.withColumn("z1", F.lead("z").over(line) - 1).where("_on")
            .select(*keys, "x", "y", F.col("z").alias("z0"), "z1"))


def _clip_to_grid(runs: DataFrame, shape) -> DataFrame:
    runs, dims = attach_shape(runs, shape)
    n = [F.lit(d) for d in dims] if dims else [F.col("nx"), F.col("ny"), F.col("nz")]
    cols = [c for c in runs.columns if c not in ("z0", "z1", "nx", "ny", "nz")]
    return (
        runs.where((F.col("x") >= 0) & (F.col("x") < n[0]) & (F.col("y") >= 0) & (F.col("y") < n[1]))
        .select(*cols, F.greatest("z0", F.lit(0)).alias("z0"), F.least(F.col("z1"), n[2] - 1).alias("z1"))
        .where("z0 <= z1")
    )


def dilate_runs(runs: DataFrame, keys: list[str], radius: float, shape) -> DataFrame:
    return _clip_to_grid(_coverage(runs, keys, radius, +1, 1), shape)


def erode_runs(runs: DataFrame, keys: list[str], radius: float) -> DataFrame:
    return _coverage(runs, keys, radius, -1, len(_disk(radius)))


def dilate(mask: DataFrame, radius: float, shape, keys: list[str] | None = None) -> DataFrame:
    """True where a true voxel lies within the ball."""
    keys = keys or ["vol_id"]
    return from_runs(dilate_runs(to_runs(mask, keys), keys, radius, shape))


def erode(mask: DataFrame, radius: float, shape=None, keys: list[str] | None = None,
          outside: bool = False) -> DataFrame:
    """True where the whole ball is true. ``outside``: whether voxels beyond the grid count as true."""
    keys = keys or ["vol_id"]
    if not outside:
        return from_runs(erode_runs(to_runs(mask, keys), keys, radius))
    # Outside true: a voxel goes if a false voxel of the grid lies within the ball.
    holes = complement_runs(to_runs(mask, keys), keys, mask.select(*keys).distinct(), shape)
    lost = dilate(from_runs(holes), radius, shape, keys)
    return mask.join(by_sort(lost), [*keys, "x", "y", "z"], "left_anti")


def complement_runs(runs: DataFrame, keys: list[str], volumes: DataFrame, shape) -> DataFrame:
    """Runs of false voxels of every grid in ``volumes`` (a table of keys)."""
    grids, dims = attach_shape(volumes, shape)
    n = {a: str(d) for a, d in zip("xyz", dims)} if dims else {a: f"n{a}" for a in "xyz"}
    lines = (grids.select(*keys, F.expr(f"explode(sequence(0, {n['x']} - 1))").alias("x"),
                          F.expr(n["y"]).alias("_ny"), F.expr(n["z"]).alias("_nz"))
             .select(*keys, "x", F.expr("explode(sequence(0, _ny - 1))").alias("y"), "_nz"))
    # Every line gets two sentinel runs, before and behind the grid; the gaps between neighbours are the complement.
    bounds = lines.select(*keys, "x", "y", F.explode(F.array(
        F.struct(F.lit(-1).alias("z0"), F.lit(-1).alias("z1")),
        F.struct(F.col("_nz").alias("z0"), F.col("_nz").alias("z1")))).alias("_b")) \
        .select(*keys, "x", "y", "_b.z0", "_b.z1")
    line = Window.partitionBy(*keys, "x", "y").orderBy("z0")
    both = runs.select(*keys, "x", "y", "z0", "z1").unionByName(bounds)
    return (both.withColumn("_next", F.lead("z0").over(line)).where("_next IS NOT NULL AND _next > z1 + 1")
            .select(*keys, "x", "y", (F.col("z1") + 1).alias("z0"), (F.col("_next") - 1).alias("z1")))


def face_neighbours(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Add booleans xm, xp, ym, yp, zm, zp: is the face neighbour on that side in the mask too?

    The z and y windows share one exchange by (keys, x); only the x window needs a second one.
    """
    df = mask.repartition(*keys, "x")
    for axis, others in (("z", ("x", "y")), ("y", ("x", "z")), ("x", ("y", "z"))):
        w = Window.partitionBy(*keys, *others).orderBy(axis)
        df = df.withColumns({f"{axis}m": F.coalesce(F.lag(axis).over(w) == F.col(axis) - 1, F.lit(False)),
                             f"{axis}p": F.coalesce(F.lead(axis).over(w) == F.col(axis) + 1, F.lit(False))})
    return df


def to_words(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, w, bits, z0, z1): one row per 64 cells of a line, bit z of word w for a true voxel; z0 and z1 are the ends."""
    return (mask.groupBy(*keys, "x", "y", F.expr("shiftright(z, 6)").alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(z & 63 AS INT)))").alias("bits"), F.min("z").alias("z0"), F.max("z").alias("z1")))


def from_words(words: DataFrame, bits: str = "bits") -> DataFrame:
    """A voxel row for each set bit; ``bits`` and ``w`` give way to z."""
    rest = [c for c in words.columns if c not in ("w", bits)]
    ones = F.expr(f"transform(filter(sequence(0, 63), i -> shiftrightunsigned({bits}, i) & 1 = 1), i -> shiftleft(w, 6) + i)")
    return words.where(F.col(bits) != 0).select(*rest, F.explode(ones).alias("z"))


def surface_words(words: DataFrame, keys: list[str], room: dict[str, str]) -> DataFrame:
    """(keys, x, y, w, bits): the voxels of ``words`` with a false face neighbour on a side where they have room.

    ``room``: SQL per side xm, xp, ym, yp, zm, zp of a word whose set bits count that side. The z and y windows share one
    exchange by (keys, x); only the x window needs a second one, of the bits, those found so far and the columns x needs.
    """
    df = words.withColumn("_open", F.lit(0).cast("bigint")).repartition(*keys, "x")
    for axis, others in (("w", ("x", "y")), ("y", ("x", "w")), ("x", ("y", "w"))):
        order = Window.partitionBy(*keys, *others).orderBy(axis)
        side = lambda move, step: F.when(move(axis).over(order) == F.col(axis) + step, move("bits").over(order)).otherwise(F.lit(0).cast("bigint"))
        df = df.withColumns({"_m": side(F.lag, -1), "_p": side(F.lead, 1)})
        if axis == "w":
            axis = "z"
            df = df.withColumns({"_m": F.expr("shiftleft(bits, 1) | shiftrightunsigned(_m, 63)"),
                                 "_p": F.expr("shiftrightunsigned(bits, 1) | shiftleft(_p, 63)")})
        df = df.withColumn("_open", F.expr(f"_open | (({room[axis + 'm']}) & ~_m) | (({room[axis + 'p']}) & ~_p)")).drop("_m", "_p")
    return df.select(*keys, "x", "y", "w", F.expr("bits & _open").alias("bits"))


def outer_rim(mask: DataFrame, keys: list[str]) -> DataFrame:
    """False voxels that share a face with a true voxel, beyond the grid included.

    The nearest false voxel of any true voxel is always one of them.
    """
    steps = [(a, s, d) for a in "xyz" for s, d in (("m", -1), ("p", 1))]
    sides = F.array(*[
        F.when(~F.col(f"{a}{s}"), F.struct(*[(F.col(b) + (d if a == b else 0)).alias(b) for b in "xyz"]))
        for a, s, d in steps])
    return (face_neighbours(mask.select(*keys, "x", "y", "z"), keys)
            .select(*keys, F.explode(F.filter(sides, lambda v: v.isNotNull())).alias("_v"))
            .select(*keys, "_v.x", "_v.y", "_v.z").distinct())


def inside_grid(df: DataFrame, shape) -> DataFrame:
    df, dims = attach_shape(df, shape)
    n = [F.lit(d) for d in dims] if dims else [F.col("nx"), F.col("ny"), F.col("nz")]
    ok = None
    for a, size in zip("xyz", n):
        test = (F.col(a) >= 0) & (F.col(a) < size)
        ok = test if ok is None else ok & test
    return df.where(ok).drop("nx", "ny", "nz")


# Forward line neighbours for face connectivity and for the full 3x3x3 neighbourhood.
_FORWARD = {6: ((1, 0), (0, 1)), 26: ((1, 0), (0, 1), (1, 1), (1, -1))}


def component_runs(runs: DataFrame, keys: list[str], connectivity: int = 6, max_rounds: int = 60) -> DataFrame:
    """Label connected runs; adds ``comp``, the smallest run id of the component.

    Runs are nodes and touching runs of neighbouring lines are edges. Edges are first contracted inside compact
    batches, then across them by alternating large-star and small-star steps, each written once to the shared
    checkpoint folder. Only the answer whether any grid is left reaches the driver.
    """
    slack = 0 if connectivity == 6 else 1
    nodes = materialize(runs.select(*keys, "x", "y", "z0", "z1").withColumn("id", _run_id("x", "y", "z0")))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in _FORWARD[connectivity]])
    probe = nodes.withColumn("_o", F.explode(steps)).select(
        *keys, (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"),
        F.col("z0").alias("_a0"), F.col("z1").alias("_a1"), F.col("id").alias("u"))
    edges = (
        probe.join(by_sort(nodes.withColumnRenamed("id", "v")), [*keys, "x", "y"])
        .where((F.col("_a0") <= F.col("z1") + slack) & (F.col("z0") <= F.col("_a1") + slack))
        .select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    edges = materialize(_contract_locally(edges, keys))
    settled = None
    for _ in range(max_rounds):
        # Only the grids that are not yet all stars go through another round.
        open_keys = materialize(_unsettled(edges, keys))
        done = edges.join(by_sort(open_keys), keys, "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if open_keys.isEmpty():
            break
        edges = materialize(_small_star(_large_star(edges.join(by_sort(open_keys), keys, "left_semi"), keys), keys))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = settled.select(*keys, F.col("u").alias("id"), F.col("v").alias("_root"))
    return (nodes.join(by_sort(roots), [*keys, "id"], "left")
            .select(*keys, "x", "y", "z0", "z1", F.coalesce("_root", "id").alias("comp")))


def _run_id(x: str, y: str, z: str) -> Column:
    """Run id that sorts in raster order; coordinates outside 0..2^21 - 1 would collide and raise an error."""
    wide = [F.col(c).cast("bigint") for c in (x, y, z)]
    fits = F.expr(" AND ".join(f"`{c}` BETWEEN 0 AND {(1 << 21) - 1}" for c in (x, y, z)))
    stop = F.raise_error(F.lit("coordinates of components should lie in 0..2097151")).cast("bigint")
    return F.when(fits, F.shiftleft(wide[0], 42) + F.shiftleft(wide[1], 21) + wide[2]).otherwise(stop)


def _contract_locally(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Replace edges by stars within batches of neighbouring edges.

    Edges are laid out by (keys, slab of x) and sorted, so a batch is a compact piece of one volume or many small
    volumes. What a batch cannot see is left to the rounds; the result is right for any layout.
    """
    slab = F.expr("shiftright(u, 42) DIV 64")
    laid_out = edges.withColumn("_slab", slab).repartition(*keys, "_slab").drop("_slab").sortWithinPartitions(*keys, "u")
    schema = laid_out.schema

    def contract(frames):
        for frame in frames:
            volume = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(frame), int)
            ids, place = np.unique(np.concatenate([frame["u"], frame["v"]]), return_inverse=True)
            node, where = np.unique(np.tile(volume, 2) * len(ids) + place, return_inverse=True)
            a, b = where[:len(frame)], where[len(frame):]
            parent = np.arange(len(node))
            while True:
                low = np.minimum(parent[a], parent[b])
                new = parent.copy()
                np.minimum.at(new, parent[a], low)
                np.minimum.at(new, parent[b], low)
                new = new[new]
                if np.array_equal(new, parent):
                    break
                parent = new
            child = np.flatnonzero(parent != np.arange(len(node)))
            # One row of each volume gives back its key values.
            first = frame[keys].iloc[np.unique(volume, return_index=True)[1]].reset_index(drop=True)
            out = first.iloc[node[child] // len(ids)].reset_index(drop=True)
            out["u"], out["v"] = ids[node[child] % len(ids)], ids[node[parent[child]] % len(ids)]
            yield out[[f.name for f in schema]]

    return laid_out.mapInPandas(contract, schema)


def _unsettled(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with a child that has two parents or a parent that is itself a child."""
    roles = edges.select(*keys, F.explode(F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("child")),
        F.struct(F.col("v").alias("id"), F.lit(0).alias("child")))).alias("_r")).select(*keys, "_r.id", "_r.child")
    mixed = (roles.groupBy(*keys, "id").agg(F.sum("child").alias("c"), F.count("*").alias("n"))
             .where("c > 1 OR (c = 1 AND n > 1)"))
    return mixed.select(*keys).distinct()


def _neighbour_minimum(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys, "u").agg(F.min("v").alias("_m"))


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = _neighbour_minimum(both, keys).select(*keys, "u", F.least("u", "_m").alias("_m"))
    return (both.where("v > u").join(by_sort(low), [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).where("u <> v"))


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The smaller neighbours of a node, and the node itself, are tied to the smallest of them."""
    low = _neighbour_minimum(edges, keys)
    tied = edges.join(by_sort(low), [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
    own = low.select(*keys, "u", F.col("_m").alias("v"))
    return tied.unionByName(own).where("u <> v").distinct()


def connected_components(mask: DataFrame, connectivity: int = 6, keys: list[str] | None = None) -> DataFrame:
    """Voxel rows with ``comp``, an id that sorts by the first voxel of the component."""
    keys = keys or ["vol_id"]
    return from_runs(component_runs(to_runs(mask, keys), keys, connectivity))


def largest_component_runs(runs: DataFrame, keys: list[str], connectivity: int = 6) -> DataFrame:
    """Runs of the largest component of each key; ties go to the first one in raster order."""
    labelled = component_runs(runs, keys, connectivity)
    sizes = labelled.groupBy(*keys, "comp").agg(F.sum(F.col("z1") - F.col("z0") + 1).alias("_n"))
    # max by (size, first in raster order) as an aggregate: one row per component goes in, no window over a group
    winner = sizes.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("_n"), "comp")).alias("_w")) \
        .select(*keys, F.col("_w.comp").alias("comp"))
    return labelled.join(by_sort(winner), [*keys, "comp"], "left_semi").drop("comp")


def largest_component(mask: DataFrame, connectivity: int = 6, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["vol_id"]
    return from_runs(largest_component_runs(to_runs(mask, keys), keys, connectivity))


def fill_holes(mask: DataFrame, shape, keys: list[str] | None = None) -> DataFrame:
    """Add the background components (face neighbours) that do not touch the border of the grid.

    Volumes of one small block are filled whole (``blocks``); of the others, runs of the background are linked.
    """
    keys = keys or ["vol_id"]
    packed = blocks.give_shape(blocks.pack(mask, keys), shape)
    whole, rest = blocks.split(packed, keys, " OR ".join([blocks.LARGE, blocks.OUTSIDE, blocks.TWICE]))

    def fill(g: blocks.Grids):
        # All around the box of the mask is false and leads to the border.
        row, at = g.voxels(blocks.holes(g.mask(), g.there()))
        return np.r_[g.row, row], *np.r_[g.at, at].T

    filled = blocks.solve(whole, keys, [(a, T.IntegerType()) for a in "xyz"], blocks.box, fill)
    return filled.unionByName(_fill_linked(blocks.unpack(rest, keys), shape, keys))


def _fill_linked(mask: DataFrame, shape, keys: list[str]) -> DataFrame:
    runs = to_runs(mask, keys)
    holes = component_runs(complement_runs(runs, keys, mask.select(*keys).distinct(), shape), keys, 6)
    holes, dims = attach_shape(holes, shape)
    n = [F.lit(d) for d in dims] if dims else [F.col("nx"), F.col("ny"), F.col("nz")]
    border = ((F.col("x") == 0) | (F.col("x") == n[0] - 1) | (F.col("y") == 0) | (F.col("y") == n[1] - 1)
              | (F.col("z0") == 0) | (F.col("z1") == n[2] - 1))
    outer = holes.where(border).select(*keys, "comp").distinct()
    inner = holes.join(by_sort(outer), [*keys, "comp"], "left_anti").select(*keys, "x", "y", "z0", "z1")
    return from_runs(inner.unionByName(runs))


def raster_id(comp: Column, ny: int, nz: int) -> Column:
    """Component id as the linear index of its first voxel."""
    low = lambda c: c.bitwiseAND(F.lit((1 << 21) - 1))
    return linear_index(F.shiftright(comp, 42), low(F.shiftright(comp, 21)), low(comp), ny, nz)
