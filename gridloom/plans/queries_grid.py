"""Queries on grid geometry, interpolation and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numbers as num
from gridloom.operators import geometry as ge
from gridloom.operators import labels as lb
from gridloom.operators import morphology as mo
from gridloom.operators import neighbourhood as nb
from gridloom.operators import resample as rs
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import with_
from gridloom.plans.queries_tables import _BALL, components_sql, r
from gridloom.plans.registry import query

V = ["vol_id", "x", "y", "z"]


def volumes(spark, d, name: str, key: str):
    return fx.table(spark, d, name).select(F.col(key).alias("vol_id"))


# ---- boxes ----------------------------------------------------------------------------------------------------------

@query("crop_centre", with_("maps") + "SELECT vol_id, x - 1 AS x, y, z - 1 AS z, gt AS label FROM maps "
       "WHERE x >= 1 AND x < 6 AND z >= 1 AND z < 5")
def _(spark, d):
    return ge.centre_crop(fx.label_map(spark, d), fx.meta(spark, d), (5, 8, 4))[0].select(*V, "label")


@query("crop_margin", with_("maps") + "SELECT vol_id, x - 3 AS x, y - 2 AS y, z, gt AS label FROM maps "
       "WHERE x BETWEEN 3 AND 4 AND y BETWEEN 2 AND 5")
def _(spark, d):
    return ge.centre_crop(fx.label_map(spark, d), fx.meta(spark, d), margin=(3, 2, 4))[0].select(*V, "label")


# Column k of the affine of ``meta`` has one entry, sign * resolution, in row perm[k].
_PERM = "CASE perm_id WHEN 0 THEN [0,1,2] WHEN 1 THEN [0,2,1] WHEN 2 THEN [1,0,2] WHEN 3 THEN [1,2,0] WHEN 4 THEN [2,0,1] ELSE [2,1,0] END"


@query("crop_affine", with_("axes", extra=f"p AS (SELECT *, {_PERM} AS p FROM axes)") + "SELECT vol_id, 5 AS nx, 8 AS ny, 4 AS nz, " +
       ", ".join("CAST(" + " + ".join(f"(CASE WHEN p[{k + 1}] = {row} THEN (CASE WHEN f[{k + 1}] THEN -1 ELSE 1 END) * r[{k + 1}] * {lo} "
                                      "ELSE 0 END)" for k, lo in enumerate((1, 0, 1))) + f" AS DOUBLE) AS origin_{row}"
                 for row in range(3)) + " FROM p")
def _(spark, d):
    meta = ge.centre_crop(fx.label_map(spark, d), fx.meta(spark, d), (5, 8, 4))[1]
    return meta.select("vol_id", "nx", "ny", "nz", *[(F.col("affine")[i][3] + 0.0).alias(f"origin_{i}") for i in range(3)])


def _box_sql(size: str, mode: str) -> str:
    """Box per axis from min m, max h: SQL of lo, hi, pad_lo, pad_hi. ``size`` uses s = h - m."""
    parts = []
    for a in "xyz":
        s = f"(max({a}) - min({a}))"
        t = size.replace("s", s) if size != "s" else s
        parts.append(f"CAST(min({a}) - ceil(({t} - {s}) / 2.0) AS INT) AS from_{a}, CAST(max({a}) + floor(({t} - {s}) / 2.0) AS INT) AS to_{a}")
    cols = {"lo": [], "hi": [], "pad_lo": [], "pad_hi": []}
    for a in "xyz":
        u, o = f"greatest(-from_{a}, 0)", f"greatest(to_{a} - 12, 0)"
        if mode == "shift-padding":
            lo = f"CASE WHEN {u} = 0 AND {o} > 0 THEN CASE WHEN from_{a} - {o} >= 0 THEN from_{a} - {o} ELSE 0 END ELSE greatest(from_{a}, 0) END"
            hi = f"CASE WHEN {u} > 0 AND {o} = 0 THEN least(to_{a} + {u}, 12) ELSE least(to_{a}, 12) END"
            pl = (f"CASE WHEN {u} > 0 AND {o} = 0 THEN CASE WHEN to_{a} + {u} <= 12 THEN 0 ELSE {u} - (12 - to_{a}) END ELSE {u} END")
            ph = f"CASE WHEN {u} = 0 AND {o} > 0 THEN CASE WHEN from_{a} - {o} >= 0 THEN 0 ELSE {o} - from_{a} END ELSE {o} END"
        elif mode == "shift-strict":
            lo, hi, pl, ph = f"greatest(from_{a} - {o}, 0)", f"least(to_{a} + {u}, 12)", "0", "0"
        else:
            keep = mode == "padding"
            lo, hi, pl, ph = f"greatest(from_{a}, 0)", f"least(to_{a}, 12)", u if keep else "0", o if keep else "0"
        for k, v in zip(cols, (lo, hi, pl, ph)):
            cols[k].append(f"CAST({v} AS INT) AS {k}_{a}")
    names = ", ".join(", ".join(v) for v in cols.values())
    return (with_("solids", extra=f"e AS (SELECT vol_id, {', '.join(parts)} FROM solids WHERE seg > 0 GROUP BY vol_id)") +
            f"SELECT vol_id, {names} FROM e")


def _flat_box(boxes):
    return boxes.select("vol_id", *[F.col(c)[i].cast("int").alias(f"{c}_{a}") for c in ("lo", "hi", "pad_lo", "pad_hi")
                                    for i, a in enumerate("xyz")])


def _register_box(name, size_sql, mode, **options):
    @query(name, _box_sql(size_sql, mode))
    def _(spark, d):
        return _flat_box(ge.region_box(fx.solid(spark, d, "seg"), fx.SOLID_SHAPE, overflow=mode, **options))


_register_box("bounding_box", "s", "strict")
_register_box("bounding_box_margin", "(s + 4)", "padding", margin=2)
_register_box("bounding_box_shape", "11", "shift-strict", crop_shape=(11, 11, 11))
_register_box("bounding_box_divisible", "(ceil(s / 4.0) * 4)", "shift-padding", div_by=4)


@query("crop_to_box", with_("solids", extra="b AS (SELECT vol_id, greatest(min(x) - 1, 0) AS x0, greatest(min(y) - 1, 0) AS y0, "
       "greatest(min(z) - 1, 0) AS z0, least(max(x) + 1, 12) AS x1, least(max(y) + 1, 12) AS y1, least(max(z) + 1, 12) AS z1 "
       "FROM solids WHERE gt = 53 GROUP BY 1)") + "SELECT vol_id, CAST(x - x0 AS INT) AS x, CAST(y - y0 AS INT) AS y, "
       "CAST(z - z0 AS INT) AS z, seg FROM solids JOIN b USING (vol_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 "
       "AND z >= z0 AND z < z1")
def _(spark, d):
    s = fx.solids(spark, d)
    return ge.crop_to_box(s, ge.region_box(s.where("gt = 53"), fx.SOLID_SHAPE, margin=1)).select(*V, "seg")


@query("pad", with_("images", "image_meta") + "SELECT m.vol_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z, "
       "coalesce(i.value, -1.0) AS value FROM image_meta m CROSS JOIN range(7) t(a) CROSS JOIN range(6) u(b) CROSS JOIN range(4) w(c) "
       "LEFT JOIN images i ON i.vol_id = m.vol_id AND i.x = a - 1 AND i.y = b - 1 AND i.z = c")
def _(spark, d):
    return ge.pad(fx.images(spark, d), fx.image_meta(spark, d), (7, 6, 3), fill=-1.0)[0].select(*V, "value")


_FLAT = "x, y, z"


@query("flip_axis", with_("maps") + "SELECT vol_id, 7 - x AS x, y, z, CASE gt WHEN 2 THEN 41 WHEN 41 THEN 2 WHEN 3 THEN 42 WHEN 42 "
       "THEN 3 ELSE gt END AS label FROM maps")
def _(spark, d):
    swap = lb.flip_pairs_literal([0, 24, 2, 3, 41, 42], 2)
    return ge.flip(fx.label_map(spark, d), fx.MAP_SHAPE, 0, "label", swap).select(*V, "label")


@query("flip_direction", with_("maps", "axes") + "SELECT vol_id, CASE WHEN o1 = 0 THEN nx - 1 - x ELSE x END AS x, CASE WHEN o1 = 1 "
       "THEN ny - 1 - y ELSE y END AS y, CASE WHEN o1 = 2 THEN nz - 1 - z ELSE z END AS z, gt AS label FROM maps JOIN axes USING (vol_id)")
def _(spark, d):
    return ge.flip_direction(fx.label_map(spark, d), fx.meta(spark, d), "ap").select(*V, "label")


@query("ras_axes", with_("axes") + "SELECT vol_id, o0 AS axis_0, o1 AS axis_1, o2 AS axis_2 FROM axes")
def _(spark, d):
    m = fx.meta(spark, d).withColumn("_a", num.ras_axes(F.col("affine")))
    return m.select("vol_id", *[F.col("_a")[i].alias(f"axis_{i}") for i in range(3)])


def _aligned(i):
    c = f"[x, y, z][o{i} + 1]"
    return f"CAST(CASE WHEN f[o{i} + 1] THEN n[o{i} + 1] - 1 - {c} ELSE {c} END AS INT)"


@query("align", with_("maps", "axes") + f"SELECT vol_id, {_aligned(0)} AS x, {_aligned(1)} AS y, {_aligned(2)} AS z, gt AS label "
       "FROM maps JOIN axes USING (vol_id)")
def _(spark, d):
    return ge.align(fx.label_map(spark, d), fx.meta(spark, d))[0].select(*V, "label")


@query("align_meta", with_("axes") + "SELECT vol_id, " + ", ".join(f"n[o{i} + 1] AS n{a}, r[o{i} + 1] AS r{a}, "
       f"CASE WHEN f[o{i} + 1] THEN -r[o{i} + 1] * (n[o{i} + 1] - 1) ELSE 0.0 END AS origin_{i}" for i, a in enumerate("xyz")) + " FROM axes")
def _(spark, d):
    m = ge.align(fx.label_map(spark, d), fx.meta(spark, d))[1]
    return m.select("vol_id", "nx", "ny", "nz", "rx", "ry", "rz", *[(F.col("affine")[i][3] + 0.0).alias(f"origin_{i}") for i in range(3)])


@query("pad_to_max_shape", with_("maps", extra="s AS (SELECT vol_id, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM maps WHERE gt > 2 "
       "GROUP BY 1), t AS (SELECT max(nx) AS mx, max(ny) AS my, max(nz) AS mz FROM s)") +
       "SELECT m.vol_id, CAST(m.x + (mx - nx) // 2 AS INT) AS x, CAST(m.y + (my - ny) // 2 AS INT) AS y, CAST(m.z + (mz - nz) // 2 AS INT) "
       "AS z, m.gt AS label FROM maps m JOIN s USING (vol_id), t WHERE gt > 2")
def _(spark, d):
    from gridloom.sources.ingest import volume_info
    m = fx.label_map(spark, d).where("label > 2")
    return ge.pad_to_max_shape(m, volume_info(m))[0].select(*V, "label")


@query("crop_to_common_min", with_("solids", extra="b AS (SELECT vol_id, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, "
       "max(z) AS z1 FROM solids WHERE gt > 0 GROUP BY 1), t AS (SELECT max(x1 - x0) + 4 AS mx, max(y1 - y0) + 4 AS my, max(z1 - z0) + 4 AS mz "
       "FROM b)") + "SELECT vol_id, CAST(x - x0 + (mx - x1 + x0) // 2 AS INT) AS x, CAST(y - y0 + (my - y1 + y0) // 2 AS INT) AS y, "
       "CAST(z - z0 + (mz - z1 + z0) // 2 AS INT) AS z, gt AS label FROM solids JOIN b USING (vol_id), t WHERE gt > 0 AND x < x1 AND y < y1 AND z < z1")
def _(spark, d):
    s = fx.solid(spark, d)
    meta = volumes(spark, d, "part", "p_partkey").select("vol_id", *[F.lit(12).alias(f"n{a}") for a in "xyz"])
    return ge.crop_to_common_min(s, meta, margin=2)[0].select(*V, "label")


def _solid_meta(spark, d):
    eye = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    return volumes(spark, d, "part", "p_partkey").select("vol_id", *[F.lit(12).alias(f"n{a}") for a in "xyz"],
                                                         num.matrix(eye).alias("affine"))


def _main_sql(extra: str) -> str:
    """Largest 26-connected region of seg > 0 as ``big``, then ``extra``."""
    return with_("solids", recursive=True, extra=components_sql("SELECT vol_id, x, y, z FROM solids WHERE seg > 0", 12, 12, 26) +
                 ", sz AS (SELECT vol_id, id, count(*) AS n FROM cc GROUP BY 1, 2), "
                 "top AS (SELECT vol_id, arg_min(id, -n * 10000 + id) AS id FROM sz GROUP BY 1), "
                 "big AS (SELECT cc.* FROM cc JOIN top USING (vol_id, id)), "
                 "b AS (SELECT vol_id, " + ", ".join(f"min({a}) AS l{a}, max({a}) AS h{a}" for a in "xyz") + " FROM big GROUP BY 1)" + extra)


def _shift_sql(size, margin=0):
    """Start of the centred inclusive box on one axis, before clipping."""
    return lambda a: (f"(greatest(l{a} - {margin}, 0) - CAST(ceil(({size(a)} - (least(h{a} + 1 + {margin}, 12) - greatest(l{a} - {margin}, 0)))"
                      " / 2.0) AS INT))")


@query("crop_same_size", _main_sql(", t AS (SELECT " + ", ".join(f"max(h{a} - l{a}) + 1 AS m{a}" for a in "xyz") + " FROM b)") +
       "SELECT s.vol_id, " + ", ".join(f"CAST(s.{a} - {_shift_sql(lambda a: f'm{a}', 1)(a)} AS INT) AS {a}" for a in "xyz") +
       ", s.seg AS label FROM solids s JOIN big USING (vol_id, x, y, z) JOIN b USING (vol_id), t WHERE " + " AND ".join(
           f"s.{a} >= {_shift_sql(lambda a: f'm{a}', 1)(a)} AND s.{a} < {_shift_sql(lambda a: f'm{a}', 1)(a)} + m{a}" for a in "xyz"))
def _(spark, d):
    return ge.crop_same_size(fx.solid(spark, d, "seg"), _solid_meta(spark, d), 1)[0].select(*V, "label")


_DIV = lambda a: f"(ceil((h{a} + 1 - l{a}) / 4.0) * 4)"


@query("crop_divisible", _main_sql("") + "SELECT s.vol_id, " + ", ".join(f"CAST(s.{a} - {_shift_sql(_DIV)(a)} AS INT) AS {a}" for a in "xyz") +
       ", s.seg AS label FROM solids s JOIN big USING (vol_id, x, y, z) JOIN b USING (vol_id)")
def _(spark, d):
    return ge.crop_divisible(fx.solid(spark, d, "seg"), fx.SOLID_SHAPE, 4)[0].select(*V, "label")


@query("tile_patches", with_("maps", extra="c AS (SELECT vol_id, x - 1 AS x, y, CAST(z - 0 AS INT) AS z, gt FROM maps WHERE x >= 1 AND x < 7 AND z < 6), "
       "t AS (SELECT vol_id, x // 3 AS tx, y // 4 AS ty, z // 2 AS tz FROM c GROUP BY ALL HAVING max(gt) > 0), "
       "k AS (SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY tx, ty, tz) AS patch FROM t)") +
       "SELECT vol_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(tz AS INT) AS tz, CAST(patch AS INT) AS patch, CAST(x % 3 AS INT) AS px, "
       "CAST(y % 4 AS INT) AS py, CAST(z % 2 AS INT) AS pz, gt AS label FROM c JOIN k USING (vol_id) WHERE x // 3 = tx AND y // 4 = ty AND z // 2 = tz")
def _(spark, d):
    return ge.tile_patches(fx.label_map(spark, d), fx.MAP_SHAPE, (3, 4, 2), full_background=False)


@query("qc_box", with_("solids", extra="b AS (SELECT vol_id, " + ", ".join(f"min({a}) AS l{a}, max({a}) AS h{a}" for a in "xyz") +
       " FROM solids WHERE (seg > 0 AND seg <> 17) OR gt = 53 GROUP BY 1)") + "SELECT vol_id, " + ", ".join(
           f"CAST(greatest({_shift_sql(lambda a: '9')(a)}, 0) AS INT) AS lo_{a}, CAST(least({_shift_sql(lambda a: '9')(a)} + 9, 12) AS INT) AS hi_{a}, "
           f"CAST(greatest(-{_shift_sql(lambda a: '9')(a)}, 0) AS INT) AS pad_lo_{a}, CAST(greatest({_shift_sql(lambda a: '9')(a)} + 9 - 12, 0) AS INT) "
           f"AS pad_hi_{a}" for a in "xyz") + " FROM b")
def _(spark, d):
    s = fx.solids(spark, d).withColumn("gt", F.when(F.col("gt") == 53, 53).otherwise(0))
    return _flat_box(ge.qc_box(s, fx.SOLID_SHAPE, 9, pred="seg", ignore=(17,)))


@query("paste_back", with_("posteriors", "meta") + "SELECT vol_id, x, y, z, label, round(p, 6) AS p FROM posteriors WHERE x >= 2 AND x < 6 "
       "AND y >= 2 AND y < 6 UNION ALL SELECT vol_id, CAST(a AS INT), CAST(b AS INT), CAST(c AS INT), 0, 1.0 FROM meta, range(8) t(a), range(8) u(b), "
       "range(2) w(c) WHERE NOT (a >= 2 AND a < 6 AND b >= 2 AND b < 6)")
def _(spark, d):
    meta = fx.meta(spark, d, fx.POST_SHAPE)
    cropped, _, boxes = ge.centre_crop(fx.posteriors(spark, d), meta, (4, 4, 2))
    return ge.paste_back(cropped, boxes, full=meta, background=0).select(*V, "label", r("p", 6))


@query("shape_plan", with_("meta") + "SELECT vol_id, " + ", ".join(
       f"CAST(round_even(o{a} / (r{a} / 1.0), 0) AS INT) AS crop_{a}, CAST(o{a} AS INT) AS out_{a}" for a in "xyz") +
       " FROM (SELECT *, " + ", ".join(f"least(CAST(floor(n{a} * r{a}) AS INT), 11) // 2 * 2 AS o{a}" for a in "xyz") + " FROM meta) t")
def _(spark, d):
    return ge.shape_plan(fx.meta(spark, d), (1.0, 1.0, 1.0), (11, 11, 11), 2)


@query("acquisition_distance", with_("meta") + "SELECT vol_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, round(sqrt("
       "pow(least(x * 5 / 8.0 - floor(x * 5 / 8.0), ceil(x * 5 / 8.0) - x * 5 / 8.0) * 1.5, 2) + "
       "pow(least(z * 3 / 7.0 - floor(z * 3 / 7.0), ceil(z * 3 / 7.0) - z * 3 / 7.0) * 3.0, 2)), 4) AS distance "
       "FROM meta, range(8) a(x), range(8) b(y), range(7) c(z)")
def _(spark, d):
    sizes = {"nx": 8, "ny": 8, "nz": 7, "dx": 5, "dy": 8, "dz": 3, "rx": 1.5, "ry": 1.0, "rz": 3.0}
    grids = fx.meta(spark, d).select("vol_id", *[F.lit(v).alias(k) for k, v in sizes.items()])
    return ge.acquisition_distance(grids).select(*V, r("distance"))


def mixed_grids(spark, d):
    """Grids of nine sizes, acquired at six, one per supplier."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    sizes = {"nx": 6 + s % 3, "ny": F.lit(8), "nz": 5 + n % 3, "dx": 3 + s % 2, "dy": F.lit(8), "dz": 2 + n % 2}
    return fx.table(spark, d, "supplier").select(s.alias("vol_id"), *[v.cast("int").alias(k) for k, v in sizes.items()],
                                                 F.lit(1.5).alias("rx"), F.lit(1.0).alias("ry"), (1.0 + s % 3).alias("rz"))


MIXED_SQL = ("WITH g AS (SELECT s_suppkey AS vol_id, 6 + s_suppkey % 3 AS nx, 8 AS ny, 5 + s_nationkey % 3 AS nz, 3 + s_suppkey % 2 AS dx, 8 AS dy, 2 + s_nationkey % 2 AS dz, "
             "1.5 AS rx, 1.0 AS ry, 1.0 + s_suppkey % 3 AS rz FROM supplier), c AS (SELECT g.*, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z "
             "FROM g, range(8) i(x), range(8) j(y), range(7) k(z) WHERE x < nx AND y < ny AND z < nz)")


def _from_sample(a: str) -> str:
    u = f"({a} / (n{a} / CAST(d{a} AS DOUBLE)))"
    return f"pow(least({u} - floor({u}), ceil({u}) - {u}) * r{a}, 2)"


@query("acquisition_distance_mixed", MIXED_SQL + f" SELECT vol_id, x, y, z, round(sqrt({' + '.join(map(_from_sample, 'xyz'))}), 4) AS distance FROM c")
def _(spark, d):
    return ge.acquisition_distance(mixed_grids(spark, d)).select(*V, r("distance"))


@query("reliability_map", with_("meta", extra="w AS (SELECT c, round(sum(v), 6) AS v FROM (SELECT CAST(floor(k * 8 / 5.0) AS INT) AS c, "
       "1 - (k * 8 / 5.0 - floor(k * 8 / 5.0)) AS v FROM range(5) t(k) UNION ALL SELECT CAST(least(floor(k * 8 / 5.0) + 1, 7) AS INT), "
       "k * 8 / 5.0 - floor(k * 8 / 5.0) FROM range(5) t(k)) u GROUP BY c)") + "SELECT vol_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, "
       "CAST(z AS INT) AS z, round(coalesce(w.v, 0.0), 4) AS value FROM meta CROSS JOIN range(8) a(x) CROSS JOIN range(8) b(y) "
       "CROSS JOIN range(7) c(z) LEFT JOIN w ON w.c = x")
def _(spark, d):
    sizes = {"nx": 8, "ny": 8, "nz": 7, "dx": 5, "dy": 8, "dz": 7}
    return ge.reliability_map(fx.meta(spark, d).select("vol_id", *[F.lit(v).alias(k) for k, v in sizes.items()])).select(*V, r("value"))


@query("reliability_map_mixed", MIXED_SQL + ", pr AS (" + " UNION ".join(f"SELECT n{a} AS n, d{a} AS d FROM g" for a in "xyz") + "), "
       "sm AS (SELECT n, d, k * (n / CAST(d AS DOUBLE)) AS u FROM pr, range(16) t(k) WHERE k < ceil(n / (n / CAST(d AS DOUBLE)))), "
       "w AS (SELECT n, d, i, sum(v) AS v FROM (SELECT n, d, floor(u) AS i, 1 - (u - floor(u)) AS v FROM sm UNION ALL SELECT n, d, least(floor(u) + 1, n - 1), u - floor(u) FROM sm) q GROUP BY 1, 2, 3) "
       "SELECT vol_id, x, y, z, round(coalesce(wx.v, 0) * coalesce(wy.v, 0) * coalesce(wz.v, 0), 4) AS value FROM c " +
       " ".join(f"LEFT JOIN w AS w{a} ON w{a}.n = n{a} AND w{a}.d = d{a} AND w{a}.i = {a}" for a in "xyz"))
def _(spark, d):
    return ge.reliability_map(mixed_grids(spark, d)).select(*V, r("value"))


# ---- interpolation --------------------------------------------------------------------------------------------------

def _hat(p: str, i: str) -> str:
    return f"greatest(1 - abs({p} - {i}), 0)"


def _resample_weights() -> str:
    """Per factor f: weights from input sample j to output sample i on a line of 4, blur and interpolation together."""
    return ("fs AS (SELECT DISTINCT f FROM (SELECT rx / 1.0 AS f FROM image_meta UNION SELECT ry / 2.0 FROM image_meta UNION SELECT rz / 1.5 FROM "
            "image_meta) t), bl AS (SELECT f, k AS m, o - 5 AS o, CASE WHEN f > 1 THEN CAST(o = 5 AS DOUBLE) WHEN abs(o - 5) > "
            "floor(4 * 0.25 / f + 0.5) THEN 0.0 ELSE exp(-0.5 * (o - 5) * (o - 5) / (0.25 / f * 0.25 / f)) END AS g FROM fs, range(4) t(k), range(11) u(o)), "
            "bn AS (SELECT f, m, CASE WHEN (m + o + 80) % 8 < 4 THEN (m + o + 80) % 8 ELSE 7 - (m + o + 80) % 8 END AS j, "
            "g / sum(g) OVER (PARTITION BY f, m) AS g FROM bl), "
            "ip AS (SELECT f, i, m, greatest(1 - abs(least(greatest(-(f - 1) / (2 * f) + i / f, 0), 3) - m), 0) AS h FROM fs, range(8) t(i), range(4) u(m) "
            "WHERE i < ceil(4 * f)), "
            "w AS (SELECT ip.f, i, j, sum(h * g) AS w FROM ip JOIN bn ON bn.f = ip.f AND bn.m = ip.m GROUP BY 1, 2, 3 HAVING sum(h * g) > 0)")


@query("resample", with_("images", "image_meta", extra=_resample_weights()) + "SELECT v.vol_id, CAST(wx.i AS INT) AS x, CAST(wy.i AS INT) AS y, "
       "CAST(wz.i AS INT) AS z, round(sum(v.value * wx.w * wy.w * wz.w), 4) AS value FROM images v JOIN image_meta m USING (vol_id) "
       "JOIN w wx ON wx.f = rx / 1.0 AND wx.j = v.x JOIN w wy ON wy.f = ry / 2.0 AND wy.j = v.y JOIN w wz ON wz.f = rz / 1.5 AND wz.j = v.z "
       "GROUP BY 1, 2, 3, 4")
def _(spark, d):
    out, _ = rs.resample(fx.images(spark, d), fx.image_meta(spark, d), (1.0, 2.0, 1.5))
    return out.select(*V, r("value"))


@query("resample_like", with_("images", "image_meta") + "SELECT m.vol_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z, round(sum(CASE WHEN "
       "(a - 0.5) / rx BETWEEN 0 AND 3 AND b / ry BETWEEN 0 AND 3 AND (0.75 * c) / rz BETWEEN 0 AND 3 THEN "
       f"v.value * {_hat('(a - 0.5) / rx', 'v.x')} * {_hat('b / ry', 'v.y')} * {_hat('(0.75 * c) / rz', 'v.z')} ELSE 0 END), 4) AS value FROM image_meta m "
       "CROSS JOIN range(6) t(a) CROSS JOIN range(4) u(b) CROSS JOIN range(5) w(c) JOIN images v ON v.vol_id = m.vol_id GROUP BY 1, 2, 3, 4")
def _(spark, d):
    meta = fx.image_meta(spark, d)
    ref = meta.select("vol_id", F.lit(6).alias("nx"), F.lit(4).alias("ny"), F.lit(5).alias("nz"), num.matrix(
        [[1, 0, 0, -0.5], [0, 1, 0, 0], [0, 0, 0.75, 0], [0, 0, 0, 1]]).alias("affine"))
    return rs.resample_like(fx.images(spark, d), meta, ref).select(*V, r("value"))


@query("resize_grid", with_("images") + "SELECT vol_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z, round(sum(value * " +
       _hat("least(a * 4 / 6.0, 3)", "x") + " * " + _hat("least(b * 4 / 4.0, 3)", "y") + " * " + _hat("least(c * 4 / 3.0, 3)", "z") +
       "), 4) AS value FROM images, range(6) t(a), range(4) u(b), range(3) w(c) GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return rs.resize_grid(fx.images(spark, d), (4, 4, 4), (6, 4, 3)).select(*V, r("value"))


@query("resize_nearest", with_("images") + "SELECT vol_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z, value FROM images, range(6) t(a), "
       "range(2) u(b), range(5) w(c) WHERE x = least(round_even(a * 4 / 6.0, 0), 3) AND y = least(round_even(b * 4 / 2.0, 0), 3) "
       "AND z = least(round_even(c * 4 / 5.0, 0), 3)")
def _(spark, d):
    return rs.resize_grid(fx.images(spark, d), (4, 4, 4), (6, 2, 5), "nearest").select(*V, "value")


@query("affine_warp", with_("images", "image_meta", extra="q AS (SELECT vol_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z, "
       "least(greatest(1.1 * (a - 1.5) * cos(radians(30)) - 0.9 * (b - 1.5) * sin(radians(30)) + 1.5 + 0.25, 0), 3) AS px, "
       "least(greatest(1.1 * (a - 1.5) * sin(radians(30)) + 0.9 * (b - 1.5) * cos(radians(30)) + 1.5, 0), 3) AS py, "
       "least(greatest(c - 1.5 + 1.5 - 0.5, 0), 3) AS pz FROM image_meta, range(4) t(a), range(4) u(b), range(4) w(c))") +
       f"SELECT q.vol_id, q.x, q.y, q.z, round(sum(v.value * {_hat('px', 'v.x')} * {_hat('py', 'v.y')} * {_hat('pz', 'v.z')}), 4) AS value "
       "FROM q JOIN images v ON v.vol_id = q.vol_id GROUP BY 1, 2, 3, 4")
def _(spark, d):
    warp = num.affine_matrix(scaling=(1.1, 0.9, 1.0), rotation=(0, 0, 30), translation=(0.25, 0, -0.5))
    return rs.apply_affine_warp(fx.images(spark, d), volumes(spark, d, "embeddings", "vec_id"), (4, 4, 4), warp).select(*V, r("value"))


_UP = lambda i, f, n: f"least(greatest(-({f} - 1) / (2 * {f}) + {i} / {f}, 0), {n} - 1)"


@query("upsample_labels", with_("images", "image_meta", extra="m AS (SELECT vol_id, x, y, z, CASE WHEN value > 0.1 THEN 2 WHEN value > -0.05 THEN 1 ELSE 0 "
       "END AS label FROM images), f AS (SELECT vol_id, rx / 0.75 AS fx, ry AS fy, rz AS fz FROM image_meta), "
       "s AS (SELECT m.vol_id, a, b, c, label, round(sum(" + " * ".join(_hat(_UP(i, f"f{a}", 4), a) for i, a in zip("abc", "xyz")) + "), 9) AS p "
       "FROM m JOIN f USING (vol_id) CROSS JOIN range(11) t(a) CROSS JOIN range(4) u(b) CROSS JOIN range(8) w(c) WHERE a < ceil(4 * fx) AND c < ceil(4 * fz) "
       "GROUP BY ALL)") + "SELECT vol_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z, first(label ORDER BY p DESC, label) AS label "
       "FROM s WHERE p > 0 GROUP BY 1, 2, 3, 4")
def _(spark, d):
    m = fx.images(spark, d).withColumn("label", F.when(F.col("value") > 0.1, 2).when(F.col("value") > -0.05, 1).otherwise(0))
    return rs.upsample_labels(m, fx.image_meta(spark, d), (0.75, 1.0, 1.0)).select(*V, "label")


def _down_and_up_sql() -> str:
    """Per axis resolution r and target t: weights from input sample j to output sample i on a line of 4, by way of the
    blur, the nearest coarse samples, and the interpolation between those."""
    return ("sg AS (SELECT r, t, r / t AS f, CASE WHEN r = t THEN 0.0 ELSE 0.75 * t / r END AS g FROM (SELECT rx AS r, 2.0 AS t FROM image_meta UNION SELECT ry, 1.0 FROM image_meta "
            "UNION SELECT rz, 2.0 FROM image_meta) q), bl AS (SELECT r, t, m, o - 8 AS o, CASE WHEN g = 0 THEN CAST(o = 8 AS DOUBLE) WHEN abs(o - 8) > floor(4 * g + 0.5) THEN 0.0 "
            "ELSE exp(-0.5 * (o - 8) * (o - 8) / (g * g)) END AS w FROM sg, range(4) a(m), range(17) b(o)), "
            "bn AS (SELECT r, t, m, least(greatest(m + o, 0), 3) AS j, w / sum(w) OVER (PARTITION BY r, t, m) AS w FROM bl), "
            "pk AS (SELECT r, t, k, ceil(least(greatest(-(f - 1) / (2 * f) + k / f, 0), 3) - 0.5) AS m FROM sg, range(8) a(k) WHERE k < ceil(4 * f)), "
            "fi AS (SELECT r, t, i, round(f * i + 0.5 * (f - 1), 9) AS q, ceil(4 * f) - 1 AS top FROM sg, range(4) a(i)), "
            "w AS (SELECT fi.r, fi.t, i, j, sum(greatest(1 - abs(q - k), 0) * bn.w) AS w FROM fi JOIN pk ON pk.r = fi.r AND pk.t = fi.t JOIN bn ON bn.r = fi.r AND bn.t = fi.t AND bn.m = pk.m "
            "WHERE q BETWEEN 0 AND top GROUP BY 1, 2, 3, 4)")


@query("downsample_images", with_("images", "image_meta", extra=_down_and_up_sql()) + "SELECT g.vol_id, g.x, g.y, g.z, round(coalesce(sum(v.value * wx.w * wy.w * wz.w), 0), 4) AS value FROM "
       "(SELECT image_meta.*, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z FROM image_meta, range(4) t(a), range(4) u(b), range(4) s(c)) g " +
       " ".join(f"LEFT JOIN w AS w{a} ON w{a}.r = r{a} AND w{a}.t = {t} AND w{a}.i = g.{a}" for a, t in zip("xyz", ("2.0", "1.0", "2.0"))) +
       " LEFT JOIN images v ON v.vol_id = g.vol_id AND v.x = wx.j AND v.y = wy.j AND v.z = wz.j GROUP BY 1, 2, 3, 4")
def _(spark, d):
    _, _, fine = rs.downsample_images(fx.images(spark, d), fx.image_meta(spark, d), (2.0, 1.0, 2.0))
    return fine.select(*V, r("value"))


def _nearest_sample(a: str, target: str) -> str:
    f = f"(r{a} / {target})"
    return f"{a} = ceil(least(greatest(-({f} - 1) / (2 * {f}) + i{a} / {f}, 0), 3) - 0.5) AND i{a} < ceil(4 * {f})"


@query("downsample_labels", with_("images", "image_meta") + "SELECT vol_id, CAST(ix AS INT) AS x, CAST(iy AS INT) AS y, CAST(iz AS INT) AS z, CASE WHEN value > 0.1 THEN 2 WHEN value > -0.05 THEN 1 ELSE 0 END AS label "
       f"FROM images JOIN image_meta USING (vol_id), range(8) t(ix), range(8) u(iy), range(8) s(iz) WHERE {_nearest_sample('x', '2.0')} AND {_nearest_sample('y', '1.0')} AND {_nearest_sample('z', '2.0')}")
def _(spark, d):
    m = fx.images(spark, d).withColumn("label", F.when(F.col("value") > 0.1, 2).when(F.col("value") > -0.05, 1).otherwise(0))
    coarse, _, _ = rs.downsample_images(m, fx.image_meta(spark, d), (2.0, 1.0, 2.0), value="label", label_map=True)
    return coarse.select(*V, "label")


# ---- neighbourhoods -------------------------------------------------------------------------------------------------

def _kernel_sql(sigma: float, radius: int, edge: str, n: int) -> str:
    """k(i, j, w): weights from input j to output i."""
    j = {"nearest": f"least(greatest(i + o - {radius}, 0), {n - 1})", "zero": f"i + o - {radius}"}[edge]
    return (f"g AS (SELECT o, exp(-0.5 * (o - {radius}) * (o - {radius}) / {sigma * sigma}) AS g FROM range({2 * radius + 1}) t(o)), "
            f"k AS (SELECT i, {j} AS j, sum(g / (SELECT sum(g) FROM g)) AS w FROM g, range({n}) u(i) GROUP BY ALL)")


_CONV = ("SELECT v.vol_id, CAST(kx.i AS INT) AS x, CAST(ky.i AS INT) AS y, CAST(kz.i AS INT) AS z, {0} FROM {1} v JOIN k kx ON kx.j = v.x "
         "JOIN k ky ON ky.j = v.y JOIN k kz ON kz.j = v.z GROUP BY 1, 2, 3, 4")


@query("gaussian_blur", with_("images", extra=_kernel_sql(0.7, 3, "nearest", 4)) +
       _CONV.format("round(sum(v.value * kx.w * ky.w * kz.w), 4) AS value", "images"))
def _(spark, d):
    return nb.gaussian_blur(fx.images(spark, d), 0.7, (4, 4, 4)).select(*V, r("value"))


@query("gaussian_blur_masked", with_("images", extra=_kernel_sql(0.7, 3, "nearest", 4) + ", s AS (" + _CONV.format(
       "sum(v.value * kx.w * ky.w * kz.w) AS b, sum(CAST(v.value > 0 AS INT) * kx.w * ky.w * kz.w) AS m", "images") + ")") +
       "SELECT vol_id, x, y, z, round(CASE WHEN i.value > 0 THEN b / (m + 1e-6) ELSE 0.0 END, 4) AS value FROM s JOIN images i USING (vol_id, x, y, z)")
def _(spark, d):
    im = fx.images(spark, d).withColumn("m", (F.col("value") > 0).cast("int"))
    return nb.gaussian_blur(im, 0.7, (4, 4, 4), mask="m").select(*V, r("value"))


@query("blur_sigma", with_("meta") + "SELECT vol_id, " + ", ".join(
       f"round(CASE WHEN least({t}, {h}) = r{a} THEN 0.5 ELSE 0.75 * least({t}, {h}) / r{a} END, 6) AS sigma_{a}"
       for a, t, h in (("x", 2.0, 1.5), ("y", 1.0, 4.0), ("z", 3.0, 3.0))) + " FROM meta")
def _(spark, d):
    return fx.meta(spark, d).select("vol_id", *[F.round(num.blur_sigma(F.col(f"r{a}"), F.lit(t), F.lit(h)), 6).alias(f"sigma_{a}")
                                                for a, t, h in (("x", 2.0, 1.5), ("y", 1.0, 4.0), ("z", 3.0, 3.0))])


def _ball_sql(rad: int) -> str:
    w = 2 * rad + 1
    return (f"o AS (SELECT CAST(a - {rad} AS INT) AS dx, CAST(b - {rad} AS INT) AS dy, CAST(c - {rad} AS INT) AS dz FROM range({w}) t(a), range({w}) u(b), "
            f"range({w}) v(c) WHERE (a-{rad})*(a-{rad}) + (b-{rad})*(b-{rad}) + (c-{rad})*(c-{rad}) <= {rad * rad})")


@query("dilate", with_("solids", extra=_ball_sql(2)) + "SELECT DISTINCT vol_id, x + dx AS x, y + dy AS y, z + dz AS z FROM solids, o WHERE seg = 17 "
       "AND x + dx BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND 11 AND z + dz BETWEEN 0 AND 11")
def _(spark, d):
    return mo.dilate(fx.solids(spark, d).where("seg = 17"), 2, fx.SOLID_SHAPE).select(*V)


@query("erode", with_("solids", extra=_ball_sql(1)) + "SELECT vol_id, x - dx AS x, y - dy AS y, z - dz AS z FROM solids, o WHERE seg > 0 "
       "GROUP BY ALL HAVING count(*) = 7")
def _(spark, d):
    return mo.erode(fx.solids(spark, d).where("seg > 0"), 1).select(*V)


@query("fill_holes", with_("solids") + "SELECT vol_id, x, y, z FROM solids WHERE gt = 17")
def _(spark, d):
    hollow = fx.solids(spark, d).where("gt = 17 AND NOT (x = 4 AND y = 5 AND z BETWEEN 5 AND 7)")
    return mo.fill_holes(hollow, fx.SOLID_SHAPE).select(*V)


def _votes_sql(cube: bool) -> str:
    near = "(SELECT a-1 AS dx, b-1 AS dy, c-1 AS dz FROM range(3) t(a), range(3) u(b), range(3) v(c))" if cube else _BALL
    return (f"o AS {near}, cells AS (SELECT DISTINCT vol_id, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(c AS INT) AS z FROM (SELECT DISTINCT vol_id FROM maps) m, "
            "range(8) t(a), range(8) u(b), range(7) w(c)), lab AS (SELECT c.*, coalesce(m.gt, 0) AS l FROM cells c LEFT JOIN maps m USING (vol_id, x, y, z)), "
            "votes AS (SELECT c.vol_id, c.x, c.y, c.z, s.l, count(*) AS n FROM cells c, o JOIN lab s ON s.vol_id = c.vol_id AND "
            "s.x = least(greatest(c.x + dx, 0), 7) AND s.y = least(greatest(c.y + dy, 0), 7) AND s.z = least(greatest(c.z + dz, 0), 6) GROUP BY ALL)")


@query("smooth_labels", with_("maps", extra=_votes_sql(False)) + "SELECT * FROM (SELECT vol_id, x, y, z, arg_min(l, -n * 1000 + l) AS label FROM votes "
       "GROUP BY 1, 2, 3, 4) t WHERE label <> 0")
def _(spark, d):
    return nb.smooth_labels(fx.label_map(spark, d), fx.MAP_SHAPE).select(*V, "label")


@query("smooth_labels_listed", with_("maps", extra=_votes_sql(True) + ", best AS (SELECT vol_id, x, y, z, arg_min(l, -n * 1000 + CASE l WHEN 42 THEN 0 ELSE 1 END) "
       "AS w FROM votes WHERE l IN (42, 3) GROUP BY 1, 2, 3, 4)") + "SELECT vol_id, x, y, z, CASE WHEN l IN (42, 3) THEN coalesce(w, 0) ELSE l END AS label "
       "FROM lab LEFT JOIN best USING (vol_id, x, y, z) WHERE l <> 0")
def _(spark, d):
    return nb.smooth_labels(fx.label_map(spark, d), fx.MAP_SHAPE, [42, 3], cube=True).select(*V, "label")


@query("correct_labels_smooth", with_("maps", extra=_votes_sql(True).replace("coalesce(m.gt, 0)", "CASE coalesce(m.gt, 0) WHEN 24 THEN 2 ELSE coalesce(m.gt, 0) END")) +
       "SELECT * FROM (SELECT vol_id, x, y, z, arg_min(l, -n * 1000 + l) AS label FROM votes GROUP BY 1, 2, 3, 4) t WHERE label <> 0")
def _(spark, d):
    return lb.correct_labels(fx.label_map(spark, d), [24], [2], smooth_shape=fx.MAP_SHAPE).select(*V, "label")


@query("erode_labels", with_("solids", extra=_ball_sql(1) + ", kept AS (SELECT vol_id, x - dx AS x, y - dy AS y, z - dz AS z FROM solids, o WHERE gt = 17 "
       "GROUP BY ALL HAVING count(*) = 7), lost AS (SELECT vol_id, x, y, z FROM solids WHERE gt = 17 EXCEPT SELECT * FROM kept), "
       "b AS (SELECT vol_id, " + ", ".join(f"greatest(min({a}) - 3, 0) AS l{a}, least(max({a}) + 3, 12) AS h{a}" for a in "xyz") + " FROM lost GROUP BY 1), "
       "c AS (SELECT s.vol_id, s.x, s.y, s.z FROM solids s JOIN b USING (vol_id) WHERE gt = 53 AND " + " AND ".join(
           f"s.{a} >= l{a} AND s.{a} < h{a}" for a in "xyz") + "), "
       "n AS (SELECT DISTINCT l.vol_id, l.x, l.y, l.z, 53 AS label FROM lost l JOIN c USING (vol_id))") +
       "SELECT s.vol_id, s.x, s.y, s.z, coalesce(n.label, s.gt) AS label FROM solids s LEFT JOIN n USING (vol_id, x, y, z) WHERE s.gt <> 0")
def _(spark, d):
    return nb.erode_labels(fx.solid(spark, d), [17], [1], fx.SOLID_SHAPE).select(*V, "label")


@query("edt", with_("solids", extra="m AS (SELECT vol_id, x, y, z FROM solids WHERE gt > 0), o AS (SELECT CAST(i AS INT) AS i FROM range(12) t(i))") +
       "SELECT m.vol_id, m.x, m.y, m.z, round(sqrt(min((m.x - a.i) * (m.x - a.i) + (m.y - b.i) * (m.y - b.i) + (m.z - c.i) * (m.z - c.i))), 4) AS distance "
       "FROM m JOIN o a ON abs(a.i - m.x) <= 4 JOIN o b ON abs(b.i - m.y) <= 4 JOIN o c ON abs(c.i - m.z) <= 4 WHERE NOT EXISTS (SELECT 1 FROM m t WHERE "
       "t.vol_id = m.vol_id AND t.x = a.i AND t.y = b.i AND t.z = c.i) GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return nb.edt(fx.solid(spark, d).select(*V), fx.SOLID_SHAPE).select(*V, r("distance"))


@query("signed_distance", with_("solids", extra="o AS (SELECT CAST(i AS INT) AS i FROM range(12) t(i)), v AS (SELECT DISTINCT vol_id FROM solids WHERE gt = 17), "
       "g AS (SELECT vol_id, a.i AS x, b.i AS y, c.i AS z FROM v, o a, o b, o c), m AS (SELECT vol_id, x, y, z FROM solids WHERE gt = 17), "
       "f AS (SELECT * FROM g EXCEPT SELECT * FROM m), "
       "rim AS (SELECT DISTINCT f.* FROM f JOIN m USING (vol_id) WHERE abs(f.x - m.x) + abs(f.y - m.y) + abs(f.z - m.z) = 1)") +
       "SELECT m.vol_id, m.x, m.y, m.z, round(sqrt(min((m.x-r.x)*(m.x-r.x)+(m.y-r.y)*(m.y-r.y)+(m.z-r.z)*(m.z-r.z))) - 0.5, 4) AS distance "
       "FROM m JOIN rim r USING (vol_id) GROUP BY 1, 2, 3, 4 UNION ALL SELECT f.vol_id, f.x, f.y, f.z, "
       "round(0.5 - sqrt(min((m.x-f.x)*(m.x-f.x)+(m.y-f.y)*(m.y-f.y)+(m.z-f.z)*(m.z-f.z))), 4) FROM f JOIN m USING (vol_id) GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return nb.signed_distance(fx.solid(spark, d), fx.SOLID_SHAPE, [17]).select(*V, r("distance"))


@query("connected_components", with_("solids", recursive=True, extra=components_sql("SELECT vol_id, x, y, z FROM solids WHERE seg > 0", 12, 12)) +
       "SELECT vol_id, x, y, z, CAST(id AS BIGINT) AS comp FROM cc")
def _(spark, d):
    out = mo.connected_components(fx.solids(spark, d).where("seg > 0"))
    return out.select(*V, mo.raster_id(F.col("comp"), 12, 12).alias("comp"))


@query("largest_component", with_("solids", recursive=True, extra=components_sql("SELECT vol_id, x, y, z FROM solids WHERE seg > 0", 12, 12) +
       ", sz AS (SELECT vol_id, id, count(*) AS n FROM cc GROUP BY 1, 2), top AS (SELECT vol_id, arg_min(id, -n * 10000 + id) AS id FROM sz GROUP BY 1)") +
       "SELECT cc.vol_id, x, y, z FROM cc JOIN top USING (vol_id, id)")
def _(spark, d):
    return mo.largest_component(fx.solids(spark, d).where("seg > 0")).select(*V)


def _sobel(a: str, var: str, along: bool) -> str:
    return f"CASE v.{a} - {var} WHEN -1 THEN 1 WHEN 1 THEN {'-1' if along else '1'} ELSE {'0' if along else '2'} END"


@query("gradients_sobel", with_("images", extra="o AS (SELECT CAST(i AS INT) AS i FROM range(4) t(i)), s AS (SELECT v.vol_id, a.i AS x, b.i AS y, c.i AS z, " +
       ", ".join("sum(v.value * " + " * ".join(_sobel(axis, f"{n}.i", axis == main) for axis, n in zip("xyz", "abc")) + f") AS g{main}" for main in "xyz") +
       " FROM images v JOIN o a ON abs(v.x - a.i) <= 1 JOIN o b ON abs(v.y - b.i) <= 1 JOIN o c ON abs(v.z - c.i) <= 1 GROUP BY 1, 2, 3, 4)") +
       "SELECT vol_id, x, y, z, round(gx, 4) AS gx, round(gy, 4) AS gy, round(gz, 4) AS gz, round(sqrt(gx*gx + gy*gy + gz*gz), 4) AS magnitude FROM s")
def _(spark, d):
    return nb.gradients(fx.images(spark, d)).select(*V, *[r(c) for c in ("gx", "gy", "gz", "magnitude")])


@query("gradients_step", with_("images", extra="s AS (SELECT vol_id, x, y, z, " + ", ".join(
       f"coalesce(lead(value) OVER (PARTITION BY vol_id, {o} ORDER BY {a}) - value, 0) AS g{a}" for a, o in (("x", "y, z"), ("y", "x, z"), ("z", "x, y"))) +
       " FROM images)") + "SELECT vol_id, x, y, z, round(gx, 4) AS gx, round(gy, 4) AS gy, round(gz, 4) AS gz, "
       "round(sqrt(gx*gx + gy*gy + gz*gz), 4) AS magnitude FROM s")
def _(spark, d):
    return nb.gradients(fx.images(spark, d), "step").select(*V, *[r(c) for c in ("gx", "gy", "gz", "magnitude")])


@query("boundary_weight", with_("posteriors", extra="h AS (SELECT vol_id, label, x, y, z FROM posteriors WHERE p > 0.5), o AS (SELECT CAST(i AS INT) AS i FROM range(8) t(i)), "
       "g AS (SELECT DISTINCT vol_id, label, a.i AS x, b.i AS y, c.i AS z FROM (SELECT DISTINCT vol_id, label FROM h) k, o a, o b, o c WHERE c.i < 2), "
       "s AS (SELECT g.vol_id, g.label, g.x, g.y, g.z, count(h.label) AS n FROM g LEFT JOIN h ON h.vol_id = g.vol_id AND h.label = g.label AND "
       "abs(h.x - g.x) <= 1 AND abs(h.y - g.y) <= 1 AND abs(h.z - g.z) <= 1 GROUP BY ALL)") +
       "SELECT vol_id, label, x, y, z, CASE WHEN n > 0 AND n / ((least(x + 1, 7) - greatest(x - 1, 0) + 1) * (least(y + 1, 7) - greatest(y - 1, 0) + 1) * "
       "2.0) < 1 / 3.0 - 1e-4 THEN 3.0 ELSE 1.0 END AS weight FROM s")
def _(spark, d):
    hard = fx.posteriors(spark, d).where("p > 0.5").withColumn("p", F.lit(1.0))
    return nb.boundary_weight(hard, fx.POST_SHAPE, 1, 2.0).select("vol_id", "label", "x", "y", "z", "weight")
