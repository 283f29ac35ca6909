"""Queries on posteriors, region statistics, evaluation, sampling and whole-cohort jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numbers as num
from gridloom.operators import aggregate as ag
from gridloom.operators import evaluate as ev
from gridloom.operators import geometry as ge
from gridloom.operators import labels as lb
from gridloom.operators import posteriors as po
from gridloom.operators.neighbourhood import boundary_weight
from gridloom.operators.sampling import weighted_draws
from gridloom.plans import cohort
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import with_
from gridloom.plans.queries_grid import _CONV, _hat, _kernel_sql, volumes
from gridloom.plans.queries_tables import LABELS, components_sql, r
from gridloom.plans.registry import query

V = ["vol_id", "x", "y", "z"]
VL = [*V, "label"]
SWAP = lb.flip_pairs_literal([0, 24, 2, 3, 41, 42], 2)
SWAP_SQL = "CASE label WHEN 2 THEN 41 WHEN 3 THEN 42 WHEN 41 THEN 2 WHEN 42 THEN 3 ELSE label END"


def clean(column: str, digits: int = 4):
    """Rounded, NaN and infinities as NULL."""
    c = F.col(column)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, digits)).alias(column)


# ---- posteriors -----------------------------------------------------------------------------------------------------

BIG_SQL = (components_sql("SELECT vol_id, x, y, z FROM posteriors WHERE label <> 0 GROUP BY ALL HAVING sum(p) > 0.25", 8, 2) +
           ", sz AS (SELECT vol_id, id, count(*) AS n FROM cc GROUP BY 1, 2), top AS (SELECT vol_id, arg_min(id, -n * 10000 + id) AS id FROM sz "
           "GROUP BY 1), big AS (SELECT vol_id, x, y, z FROM cc JOIN top USING (vol_id, id)), "
           "kept AS (SELECT * FROM posteriors WHERE label = 0 OR (vol_id, x, y, z) IN (SELECT (vol_id, x, y, z) FROM big))")


@query("keep_biggest", with_("posteriors", recursive=True, extra=BIG_SQL) + "SELECT vol_id, x, y, z, label, round(p, 6) AS p FROM kept")
def _(spark, d):
    return po.keep_biggest(fx.posteriors(spark, d)).select(*VL, r("p", 6))


CLASSES = {0: 0, 2: 1, 41: 1, 3: 2, 42: 2, 24: 3}
CLASS_SQL = "CASE WHEN label IN (2, 41) THEN 1 WHEN label IN (3, 42) THEN 2 WHEN label = 24 THEN 3 ELSE 0 END"


def class_sql(source: str) -> str:
    return (components_sql(f"SELECT DISTINCT vol_id, {CLASS_SQL} AS k, x, y, z FROM {source} WHERE label <> 0 AND p > 0.25", 8, 2, keys="vol_id, k")
            .replace("cc(", "cl(").replace("FROM cc c", "FROM cl c").replace("recurring.cc", "recurring.cl").replace("off(", "offk(")
            .replace("off o", "offk o") + ", szk AS (SELECT vol_id, k, id, count(*) AS n FROM cl GROUP BY 1, 2, 3), topk AS (SELECT vol_id, k, "
            "arg_min(id, -n * 10000 + id) AS id FROM szk GROUP BY 1, 2), bigk AS (SELECT vol_id, k, x, y, z FROM cl JOIN topk USING (vol_id, k, id)), "
            f"keptk AS (SELECT * FROM {source} WHERE label = 0 OR (vol_id, {CLASS_SQL}, x, y, z) IN (SELECT (vol_id, k, x, y, z) FROM bigk))")


@query("keep_biggest_per_class", with_("posteriors", recursive=True, extra=class_sql("posteriors")) +
       "SELECT vol_id, x, y, z, label, round(p, 6) AS p FROM keptk")
def _(spark, d):
    return po.keep_biggest_per_class(fx.posteriors(spark, d), CLASSES).select(*VL, r("p", 6))


@query("drop_low", with_("posteriors") + "SELECT vol_id, x, y, z, label, round(p, 6) AS p FROM posteriors WHERE label = 0 OR p > 0.2")
def _(spark, d):
    return po.drop_low(fx.posteriors(spark, d)).select(*VL, r("p", 6))


_NORM = "p / sum(p) OVER (PARTITION BY vol_id, x, y, z)"


@query("normalise_posteriors", with_("posteriors") + f"SELECT vol_id, x, y, z, label, round({_NORM}, 6) AS p FROM posteriors WHERE label <> 24")
def _(spark, d):
    return po.normalise(fx.posteriors(spark, d).where("label <> 24")).select(*VL, r("p", 6))


@query("argmax_label", with_("posteriors") + "SELECT vol_id, x, y, z, first(label ORDER BY p DESC, label) AS label FROM posteriors GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return po.argmax_label(fx.posteriors(spark, d), LABELS).select(*VL)


_HARD = "hard AS (SELECT vol_id, x, y, z, first(label ORDER BY p DESC, label) AS label FROM posteriors GROUP BY 1, 2, 3, 4)"


@query("merge_parcellation", with_("posteriors", extra=_HARD + ", parc AS (SELECT vol_id, x, y, z, CASE label WHEN 0 THEN 0 WHEN 2 THEN 1001 "
       "WHEN 3 THEN 1002 WHEN 24 THEN 1003 WHEN 41 THEN 2001 ELSE 2002 END AS label, p FROM posteriors), "
       "win AS (SELECT vol_id, x, y, z, first(label ORDER BY p DESC, label) AS w FROM parc WHERE label <> 0 GROUP BY 1, 2, 3, 4)") +
       "SELECT h.vol_id, h.x, h.y, h.z, CASE WHEN h.label IN (3, 42) THEN coalesce(w, 0) ELSE h.label END AS label FROM hard h LEFT JOIN win "
       "USING (vol_id, x, y, z)")
def _(spark, d):
    seg = po.argmax_label(fx.posteriors(spark, d), LABELS)
    return po.merge_parcellation(seg, parcels(spark, d))[0].select(*VL)


def parcels(spark, d):
    """Parcel posteriors made from the label posteriors by renaming."""
    rename = lb.literal_map([0, 2, 3, 24, 41, 42], [0, 1001, 1002, 1003, 2001, 2002])
    return fx.posteriors(spark, d).withColumn("label", rename[F.col("label")])


@query("strict_group_mask", with_("posteriors", extra="m AS (SELECT DISTINCT vol_id, x, y, z FROM posteriors WHERE p > 0.6), "
       "t AS (SELECT vol_id, x, y, z, label, p FROM posteriors WHERE label <> 0 UNION ALL SELECT DISTINCT vol_id, x, y, z, 0, 1.0 FROM posteriors "
       "WHERE (vol_id, x, y, z) NOT IN (SELECT (vol_id, x, y, z) FROM m))") + f"SELECT vol_id, x, y, z, label, round({_NORM}, 6) AS p FROM t")
def _(spark, d):
    p = fx.posteriors(spark, d)
    return po.strict_group_mask(p, p.where("p > 0.6").select(*V).distinct()).select(*VL, r("p", 6))


@query("flip_average", with_("posteriors", extra=f"b AS (SELECT vol_id, x, y, z, label, p FROM posteriors UNION ALL SELECT vol_id, 7 - x, y, z, "
       f"{SWAP_SQL}, p FROM posteriors)") + "SELECT vol_id, x, y, z, label, round(0.5 * sum(p), 6) AS p FROM b GROUP BY ALL")
def _(spark, d):
    p = fx.posteriors(spark, d)
    return po.flip_average(p, p, 8, SWAP).select(*VL, r("p", 6))


@query("soft_volumes", with_("posteriors", "meta") + "SELECT vol_id, label, round_even(round(sum(p) * any_value(rx * ry * rz), 9), 3) AS volume FROM posteriors "
       "JOIN meta USING (vol_id) WHERE label <> 0 GROUP BY 1, 2")
def _(spark, d):
    return po.soft_volumes(fx.posteriors(spark, d), fx.meta(spark, d)).select("vol_id", "label", "volume")


@query("total_intracranial", with_("posteriors", "meta") + "SELECT vol_id, label, round_even(round(sum(p) * any_value(rx * ry * rz), 9), 3) AS volume FROM posteriors "
       "JOIN meta USING (vol_id) WHERE label <> 0 GROUP BY GROUPING SETS ((vol_id, label), (vol_id))")
def _(spark, d):
    return po.total_intracranial(fx.posteriors(spark, d), fx.meta(spark, d)).select("vol_id", "label", "volume")


@query("rescale_parcels", with_("posteriors", extra="s AS (SELECT vol_id, label, sum(p) AS v FROM posteriors WHERE label <> 0 GROUP BY 1, 2)") +
       "SELECT vol_id, label, round(v / sum(v) OVER (PARTITION BY vol_id) * (SELECT sum(t.v) FROM s t WHERE t.vol_id = s.vol_id AND t.label IN (3, 42)), 2) AS volume FROM s")
def _(spark, d):
    v = fx.posteriors(spark, d).where("label <> 0").groupBy("vol_id", "label").agg(F.sum("p").alias("volume"))
    return po.rescale_parcels(v, v).select("vol_id", "label", r("volume", 2))


@query("smooth_posteriors", with_("posteriors", extra="g AS (SELECT o, exp(-0.5 * (o - 1) * (o - 1) / 0.25) AS g FROM range(3) t(o)), "
       "k AS (SELECT i, i + o - 1 AS j, g / (SELECT sum(g) FROM g) AS w FROM g, range(8) u(i))") +
       "SELECT v.vol_id, CAST(kx.i AS INT) AS x, CAST(ky.i AS INT) AS y, CAST(kz.i AS INT) AS z, label, round(sum(v.p * kx.w * ky.w * kz.w), 6) AS p "
       "FROM posteriors v JOIN k kx ON kx.j = v.x JOIN k ky ON ky.j = v.y JOIN k kz ON kz.j = v.z WHERE kz.i < 2 GROUP BY 1, 2, 3, 4, 5")
def _(spark, d):
    return po.smooth_posteriors(fx.posteriors(spark, d), fx.POST_SHAPE).select(*VL, r("p", 6))


@query("qc_relabel", with_("posteriors", extra=_HARD) + "SELECT vol_id, x, y, z, CASE WHEN label IN (2, 41) THEN 1 WHEN label IN (3, 42) THEN 2 WHEN label = 24 "
       "THEN 3 ELSE 0 END AS label, 1.0 AS p FROM hard")
def _(spark, d):
    return po.qc_relabel(fx.posteriors(spark, d), LABELS, [0, 1, 2, 3, 1, 2]).select(*VL, "p")


@query("harden", with_("posteriors", extra=_HARD) + "SELECT vol_id, x, y, z, label, 1.0 AS p FROM hard")
def _(spark, d):
    return po.harden(fx.posteriors(spark, d)).select(*VL, "p")


# ---- aggregations ---------------------------------------------------------------------------------------------------

_ALL_LABELS = "(SELECT CAST(unnest([2, 3, 24, 41, 42, 77]) AS INT) AS label) l"


@query("hard_volumes", with_("maps") + f"SELECT v.vol_id, l.label, count(m.gt) * 1.5 AS volume FROM (SELECT DISTINCT vol_id FROM maps) v CROSS JOIN {_ALL_LABELS} "
       "LEFT JOIN maps m ON m.vol_id = v.vol_id AND m.gt = l.label GROUP BY 1, 2")
def _(spark, d):
    return ag.hard_volumes(fx.label_map(spark, d), [0, 2, 3, 24, 41, 42, 77], 1.5)


@query("hard_volumes_dataset", with_("maps", "meta") + "SELECT vol_id, gt AS label, round(count(*) * any_value(rx * ry * rz), 3) AS volume FROM maps JOIN meta "
       "USING (vol_id) WHERE gt <> 0 GROUP BY 1, 2")
def _(spark, d):
    return ag.hard_volumes_dataset(fx.label_map(spark, d), fx.meta(spark, d))


@query("build_atlas", with_("maps") + "SELECT CAST(x + 1 AS INT) AS x, CAST(y - 1 AS INT) AS y, z, CASE WHEN gt IN (2, 3, 41, 42) THEN gt ELSE 0 END AS label, "
       "round(count(*) / (SELECT count(DISTINCT vol_id) FROM maps), 6) AS p FROM maps WHERE y >= 1 AND y < 7 GROUP BY ALL")
def _(spark, d):
    atlas = ag.build_atlas(fx.label_map(spark, d), [0, 2, 3, 41, 42], fx.MAP_SHAPE, (10, 6, 7))
    return atlas.select("x", "y", "z", "label", r("p", 6))


@query("build_atlas_mixed", with_("maps") + "SELECT CAST(x + CASE WHEN vol_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS x, CAST(y - 1 AS INT) AS y, z, CASE WHEN gt IN (2, 3, 41, 42) THEN gt ELSE 0 END AS label, "
       "round(count(*) / (SELECT count(DISTINCT vol_id) FROM maps), 6) AS p FROM maps WHERE y >= 1 AND y < 7 GROUP BY ALL")
def _(spark, d):
    shapes = fx.meta(spark, d).select("vol_id", (8 + F.col("vol_id") % 3).cast("int").alias("nx"), "ny", "nz")
    atlas = ag.build_atlas(fx.label_map(spark, d), [0, 2, 3, 41, 42], shapes, (10, 6, 7))
    return atlas.select("x", "y", "z", "label", r("p", 6))


@query("build_atlas_centred", with_("solids", extra="c AS (SELECT vol_id, CAST(trunc(avg(x)) AS INT) AS cx, CAST(trunc(avg(y)) AS INT) AS cy, CAST(trunc(avg(z)) AS INT) AS cz "
       "FROM solids WHERE gt > 0 GROUP BY 1)") + "SELECT CAST(x - cx + 4 AS INT) AS x, CAST(y - cy + 4 AS INT) AS y, CAST(z - cz + 4 AS INT) AS z, gt AS label, "
       "round(count(*) / (SELECT count(DISTINCT vol_id) FROM solids WHERE gt > 0), 6) AS p FROM solids JOIN c USING (vol_id) WHERE gt > 0 AND x - cx BETWEEN -4 AND 3 "
       "AND y - cy BETWEEN -4 AND 3 AND z - cz BETWEEN -4 AND 3 GROUP BY ALL")
def _(spark, d):
    atlas = ag.build_atlas(fx.solid(spark, d), [0, 17, 53], fx.SOLID_SHAPE, centre=True, margin=4)
    return atlas.select("x", "y", "z", "label", r("p", 6))


STAT_LABELS, STAT_CLASSES = [0, 2, 41, 3, 42, 24, 77], [0, 1, 1, 2, 2, 3, 4]


def stats_sql(source: str, keys: str, label: str = "gt") -> str:
    cls = f"CASE WHEN {label} = 0 THEN 0 WHEN {label} IN (2, 41) THEN 1 WHEN {label} IN (3, 42) THEN 2 WHEN {label} = 24 THEN 3 END"
    return (f"c AS (SELECT {keys}, {cls} AS class_id, value FROM {source} WHERE {label} = 0 OR value > 0), "
            f"med AS (SELECT {keys}, class_id, median(value) AS m FROM c GROUP BY ALL), "
            f"st AS (SELECT {keys}, class_id, any_value(m) AS m, 1.4826 * median(abs(value - m)) AS s FROM c JOIN med USING ({keys}, class_id) GROUP BY ALL), "
            f"st0 AS (SELECT {', '.join('v.' + k for k in keys.split(', '))}, CAST(k AS INT) AS class_id, coalesce(m, 0.0) AS m, coalesce(s, 0.0) AS s FROM "
            f"(SELECT DISTINCT {keys} FROM {source}) v CROSS JOIN range(5) t(k) LEFT JOIN st ON st.class_id = k AND "
            f"{' AND '.join(f'st.{k} = v.{k}' for k in keys.split(', '))})")


@query("intensity_stats", with_("maps", extra=stats_sql("maps", "vol_id")) + "SELECT vol_id, class_id, round(m, 3) AS median, round(s, 3) AS mad FROM st0")
def _(spark, d):
    s = ag.intensity_stats(fx.maps(spark, d), STAT_LABELS, STAT_CLASSES, label="gt")
    return s.select("vol_id", "class_id", r("median", 3), r("mad", 3))


_SCALED = ("lim AS (SELECT vol_id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM maps GROUP BY 1), "
           "im AS (SELECT {0} maps.vol_id, {1} AS gt, CASE WHEN lo = hi THEN 0.0 ELSE (greatest(least(value, hi), lo) - lo) / (hi - lo) * 255 END AS value "
           "FROM maps JOIN lim USING (vol_id) {2})")
_PRIOR = ("round(avg(m), 3) AS mean_of_mean, round(stddev_pop(m), 3) AS std_of_mean, round(avg(s), 3) AS mean_of_std, round(stddev_pop(s), 3) AS std_of_std")
_PRIORS = ("mean_of_mean", "std_of_mean", "mean_of_std", "std_of_std")


@query("intensity_priors", with_("maps", extra=_SCALED.format("", "gt", "") + ", " + stats_sql("im", "vol_id")) +
       f"SELECT class_id, {_PRIOR} FROM st0 GROUP BY 1")
def _(spark, d):
    s = ag.intensity_priors(fx.maps(spark, d), STAT_LABELS, STAT_CLASSES, label="gt")
    return s.select("class_id", *[r(c, 3) for c in _PRIORS])


@query("intensity_priors_multi", with_("maps", extra=_SCALED.format("side AS dataset,", "CASE side WHEN 'gt' THEN gt ELSE seg END",
       "CROSS JOIN (SELECT unnest(['gt', 'seg']) AS side) t") + ", " + stats_sql("im", "dataset, vol_id")) +
       f"SELECT dataset, class_id, {_PRIOR} FROM st0 GROUP BY 1, 2")
def _(spark, d):
    sides = F.explode(F.array(F.struct(F.lit("gt").alias("dataset"), F.col("gt").alias("label")),
                              F.struct(F.lit("seg").alias("dataset"), F.col("seg").alias("label"))))
    both = fx.maps(spark, d).select(*V, "value", sides.alias("_s")).select(*V, "value", "_s.dataset", "_s.label")
    s = ag.intensity_priors(both, STAT_LABELS, STAT_CLASSES, dataset=["dataset"])
    return s.select("dataset", "class_id", *[r(c, 3) for c in _PRIORS])


@query("check_volumes", with_("axes", extra="a AS (SELECT *, [n[o0 + 1], n[o1 + 1], n[o2 + 1]] AS m, [r[o0 + 1], r[o1 + 1], r[o2 + 1]] AS q FROM axes)") +
       "SELECT 'shape' AS property, array_to_string(m, ',') AS value FROM a UNION SELECT 'res', array_to_string(q, ',') FROM a UNION "
       "SELECT 'axes', array_to_string([o0, o1, o2], ',') FROM a UNION SELECT 'affine', array_to_string([q[1], 0.0, 0.0, 0.0, q[2], 0.0, 0.0, 0.0, q[3]], ',') FROM a")
def _(spark, d):
    return ag.check_volumes(fx.meta(spark, d))


@query("check_pairs", with_("meta") + "SELECT vol_id, rx > 1.5 AS aff_mismatch, rz > 1 AS shape_mismatch FROM meta WHERE rx > 1.5 OR rz > 1")
def _(spark, d):
    m = fx.meta(spark, d)
    moved = F.transform("affine", lambda row, i: F.when((i == 1) & (F.col("rx") > 1.5), F.transform(row, lambda v, j: F.when(j == 3, v + 0.3).otherwise(v)))
                        .otherwise(row))
    other = m.select("vol_id", "nx", "ny", F.when(F.col("rz") > 1, F.col("nz") + 1).otherwise(F.col("nz")).alias("nz"), moved.alias("affine"))
    return ag.check_pairs(m, other)


@query("unique_labels", with_("maps") + "SELECT vol_id, array_to_string(list_sort(list(DISTINCT gt)), ',') AS labels FROM maps GROUP BY 1")
def _(spark, d):
    u = ag.unique_labels(fx.label_map(spark, d))
    return u.select("vol_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("foreground_count", with_("maps") + "SELECT vol_id, count(*) FILTER (gt > 0) AS n_foreground FROM maps GROUP BY 1")
def _(spark, d):
    return ag.foreground_count(fx.label_map(spark, d))


# ---- evaluation -----------------------------------------------------------------------------------------------------

def dice_sql(source: str = "maps", keys: str = "vol_id", digits: int = 6) -> str:
    rest = "max(CAST(l = 0 AS INT)) * (8 * 8 * 7 - count(*))"  # background that the sparse maps do not list
    return (f"SELECT {keys}, CAST(l AS INT) AS label, round(2.0 * (count(*) FILTER (gt = l AND seg = l) + {rest}) / (count(*) FILTER (gt = l) + count(*) FILTER (seg = l) + 2 * {rest} + 1e-5), {digits}) "
            f"AS dice FROM {source}, (SELECT unnest([0, 2, 3, 24, 41, 42]) AS l) t GROUP BY ALL")


def dice(spark, d):
    return ev.dice_by_label(fx.maps(spark, d), LABELS, shape=fx.MAP_SHAPE).select("vol_id", "label", r("dice", 6))


@query("dice_by_label", with_("maps") + dice_sql())
def _(spark, d):
    return dice(spark, d)


@query("dice_single_label", with_("maps") + "SELECT vol_id, 3 AS label, round(2.0 * count(*) FILTER (gt = 3 AND seg = 3) / nullif(count(*) FILTER (gt = 3) + "
       "count(*) FILTER (seg = 3), 0), 6) AS dice FROM maps GROUP BY 1")
def _(spark, d):
    return ev.dice_by_label(fx.maps(spark, d), [3]).select("vol_id", "label", clean("dice", 6))


@query("dice_binary", with_("maps") + "SELECT vol_id, round(2.0 * count(*) FILTER (gt IN (2, 41) AND seg IN (2, 41)) / nullif(count(*) FILTER (gt IN (2, 41)) + "
       "count(*) FILTER (seg IN (2, 41)), 0), 6) AS dice FROM maps GROUP BY 1")
def _(spark, d):
    m = fx.maps(spark, d).select("vol_id", F.col("gt").isin(2, 41).alias("gt"), F.col("seg").isin(2, 41).alias("seg"))
    return ev.dice_binary(m).select("vol_id", clean("dice", 6))


@query("dice_whole", with_("maps") + "SELECT vol_id, round(2.0 * count(*) FILTER (gt > 0 AND seg > 0) / nullif(count(*) FILTER (gt > 0) + count(*) FILTER (seg > 0), 0), 6) "
       "AS dice FROM maps GROUP BY 1")
def _(spark, d):
    return ev.dice_whole(fx.maps(spark, d)).select("vol_id", clean("dice", 6))


@query("qc_true_dice", with_("maps") + "SELECT vol_id, CAST(l AS INT) AS label, round(2.0 * count(*) FILTER (gt = l AND seg = l) / (count(*) FILTER (gt = l) + "
       "count(*) FILTER (seg = l) + 448 * 1e-7), 6) AS dice FROM maps, (SELECT unnest([2, 3, 24, 41, 42]) AS l) t GROUP BY ALL")
def _(spark, d):
    return ev.dice_voxel_epsilon(fx.maps(spark, d), LABELS[1:], 448).select("vol_id", "label", r("dice", 6))


def surface_sql(pairs: str, labels: str, far: int, whole: bool = False) -> str:
    """sd(vol_id, label, mean_distance, hausdorff_100, _99, _95) and the tables behind it, by brute force."""
    every = (f" UNION ALL SELECT vol_id, -1, 0, x, y, z FROM {pairs} WHERE gt > 0 UNION ALL SELECT vol_id, -1, 1, x, y, z FROM {pairs} WHERE seg > 0" if whole else "")
    listed = "[" + labels.strip("()") + (", -1" if whole else "") + "]"
    near = " + ".join(
        f"CAST(EXISTS (SELECT 1 FROM ins t WHERE t.vol_id = i.vol_id AND t.label = i.label AND t.side = i.side AND t.{a} = i.{a} {s} 1 AND "
        f"t.{b} = i.{b} AND t.{c} = i.{c}) AS INT)" for a, b, c in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y")) for s in "+-")
    room = " + ".join(f"CAST(i.{a} > l{a} AS INT) + CAST(i.{a} < h{a} - 1 AS INT)" for a in "xyz")
    return (f"pt AS (SELECT vol_id, gt AS label, 0 AS side, x, y, z FROM {pairs} WHERE gt IN {labels} UNION ALL SELECT vol_id, seg, 1, x, y, z FROM {pairs} WHERE seg IN {labels}{every}), "
            "bx AS (SELECT vol_id, label, " + ", ".join(f"min({a}) AS l{a}, max({a}) AS h{a}" for a in "xyz") + " FROM pt GROUP BY 1, 2 HAVING count(DISTINCT side) = 2), "
            "ins AS MATERIALIZED (SELECT pt.* FROM pt JOIN bx USING (vol_id, label) WHERE " + " AND ".join(f"{a} >= l{a} AND {a} < h{a}" for a in "xyz") + "), "
            f"ed AS MATERIALIZED (SELECT i.* FROM ins i JOIN bx USING (vol_id, label) WHERE {near} < {room}), "
            "ds AS MATERIALIZED (SELECT a.vol_id, a.label, a.side, a.x, a.y, a.z, sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS d FROM ed a "
            "LEFT JOIN ed b ON a.vol_id = b.vol_id AND a.label = b.label AND a.side <> b.side GROUP BY 1, 2, 3, 4, 5, 6), "
            "ag AS (SELECT vol_id, label, avg(d) FILTER (side = 0) AS m0, avg(d) FILTER (side = 1) AS m1, quantile_cont(d, 1.0) AS h100, quantile_cont(d, 0.99) AS h99, "
            "quantile_cont(d, 0.95) AS h95 FROM ds GROUP BY 1, 2), "
            f"ev AS (SELECT vol_id, CAST(unnest({listed}) AS INT) AS label FROM (SELECT DISTINCT vol_id FROM {pairs}) v), "
            f"fb AS (SELECT ev.vol_id, ev.label, bx.lx IS NULL AS none, coalesce(greatest(hx - lx, hy - ly, hz - lz), {far}) AS f FROM ev LEFT JOIN bx USING (vol_id, label)), "
            f"sd AS (SELECT vol_id, label, CASE WHEN none THEN {far} ELSE (coalesce(m0, f) + coalesce(m1, f)) / 2 END AS mean_distance, coalesce(h100, f) AS hausdorff_100, "
            "coalesce(h99, f) AS hausdorff_99, coalesce(h95, f) AS hausdorff_95 FROM fb LEFT JOIN ag USING (vol_id, label))")


_SCORES = ("mean_distance", "hausdorff_100", "hausdorff_99", "hausdorff_95")


@query("surface_distances", with_("solids", extra=surface_sql("solids", "(17, 53)", 12)) + "SELECT vol_id, label, " +
       ", ".join(f"round({c}, 4) AS {c}" for c in _SCORES) + " FROM sd")
def _(spark, d):
    out = ev.surface_distances(fx.solids(spark, d), [17, 53], fx.SOLID_SHAPE)
    return out.select("vol_id", "label", *[r(c) for c in _SCORES])


@query("hausdorff_location", with_("solids", extra=surface_sql("solids", "(17, 53)", 12) + ", tp AS (SELECT vol_id, label, max(d) AS m FROM ds GROUP BY 1, 2), "
       "ht AS (SELECT ds.* FROM ds JOIN tp USING (vol_id, label) WHERE d = m)") + "SELECT vol_id, label, side, x, y, z, round(d, 4) AS distance FROM ht "
       "WHERE side = (SELECT min(side) FROM ht h WHERE h.vol_id = ht.vol_id AND h.label = ht.label)")
def _(spark, d):
    return ev.hausdorff_location(fx.solids(spark, d), [17, 53], fx.SOLID_SHAPE).select("vol_id", "label", "side", "x", "y", "z", r("distance"))


_EVALUATED = (", " + surface_sql("m", "(2, 3, 24, 41, 42)", 8, whole=True) +
       " SELECT vol_id, label, metric, round(value, 4) AS value FROM (SELECT vol_id, label, metric, value FROM (UNPIVOT (SELECT vol_id, label, " +
       ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SCORES) + " FROM sd) ON " + ", ".join(_SCORES) + " INTO NAME metric VALUE value) u UNION ALL "
       "SELECT vol_id, CAST(l AS INT), 'dice', 2.0 * count(*) FILTER (gt = l AND seg = l) / (count(*) FILTER (gt = l AND seg <= 42 AND seg >= 2) + count(*) FILTER (seg = l AND gt "
       "BETWEEN 2 AND 42) + 1e-5) FROM m, (SELECT unnest([2, 3, 24, 41, 42]) AS l) t GROUP BY 1, 2 UNION ALL "
       "SELECT vol_id, -1, 'dice', 2.0 * count(*) FILTER (gt > 0 AND seg > 0) / (count(*) FILTER (gt > 0) + count(*) FILTER (seg > 0)) FROM m GROUP BY 1) q")


@query("evaluate_dataset", with_("maps", extra="m AS (SELECT vol_id, x, y, z, CASE WHEN value > 90000 THEN 43 ELSE gt END AS gt, CASE WHEN value > 90000 THEN 43 WHEN seg = 41 "
       "THEN 2 WHEN seg = 42 THEN 3 ELSE seg END AS seg FROM maps)") + _EVALUATED)
def _(spark, d):
    m = fx.maps(spark, d)
    gt = m.select(*V, F.col("gt").alias("label"))
    seg = m.select(*V, F.col("seg").alias("label"))
    out = ev.evaluate_dataset(gt, seg, LABELS[1:], fx.MAP_SHAPE, mask=m.where("value > 90000"), wrong=[41, 42], right=[2, 3])
    return out.select("vol_id", "label", "metric", r("value"))


@query("evaluate_dataset_turned", with_("maps", "axes", extra="t AS (SELECT vol_id, gt, value, " + ", ".join(
       f"CAST(CASE WHEN f[o{i} + 1] THEN n[o{i} + 1] - 1 - [x, y, z][o{i} + 1] ELSE [x, y, z][o{i} + 1] END AS INT) AS {a}" for i, a in enumerate("xyz")) + " FROM maps JOIN axes USING (vol_id)), "
       "m AS MATERIALIZED (SELECT vol_id, x, y, z, CASE WHEN value > 90000 THEN 43 ELSE coalesce(gt, 0) END AS gt, CASE WHEN value > 90000 THEN 43 WHEN seg = 41 THEN 2 WHEN seg = 42 THEN 3 ELSE coalesce(seg, 0) END AS seg "
       "FROM t FULL JOIN (SELECT vol_id, x, y, z, seg FROM maps JOIN axes USING (vol_id) WHERE " + " AND ".join(f"{a} < n[o{i} + 1]" for i, a in enumerate("xyz")) + ") s USING (vol_id, x, y, z))") + _EVALUATED)
def _(spark, d):
    m = fx.maps(spark, d)
    native = fx.meta(spark, d).drop("perm_id", "flip_bits")
    straight = native.withColumn("affine", num.matrix([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]))
    gt = m.select(*V, F.col("gt").alias("label"))
    seg = m.select(*V, F.col("seg").alias("label"))
    out = ev.evaluate_dataset(gt, seg, LABELS[1:], None, mask=m.where("value > 90000"), wrong=[41, 42], right=[2, 3],
                              gt_meta=native, seg_meta=straight)
    return out.select("vol_id", "label", "metric", r("value"))


def _wilcoxon_sql(alternative: str) -> str:
    t = "least(r_plus, r_minus)" if alternative == "two-sided" else "r_plus"
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = repr(coef[-1])
    for c in reversed(coef[:-1]):
        poly = f"({c!r} + t * {poly})"
    p = {"two-sided": "2 * q", "greater": "CASE WHEN z >= 0 THEN q ELSE 1 - q END", "less": "CASE WHEN z >= 0 THEN 1 - q ELSE q END"}[alternative]
    return (with_("scores", extra="a AS (SELECT structure, subject, ref, cmp FROM scores UNION ALL SELECT 'average', subject, avg(ref), avg(cmp) FROM scores GROUP BY subject), "
            "dd AS (SELECT structure, ref - cmp AS d FROM a WHERE ref <> cmp), rk AS (SELECT structure, d, rank() OVER w + (count(*) OVER (PARTITION BY structure, abs(d)) - 1) / 2.0 AS r, "
            "count(*) OVER (PARTITION BY structure, abs(d)) AS c FROM dd WINDOW w AS (PARTITION BY structure ORDER BY abs(d))), "
            "s AS (SELECT structure, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS r_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS r_minus, "
            "sum((c * c * c - c) / c) AS ties FROM rk GROUP BY 1), "
            f"zz AS (SELECT *, ({t} - n * (n + 1) / 4.0) / sqrt((n * (n + 1.0) * (2 * n + 1) - 0.5 * ties) / 24) AS z FROM s), "
            "tt AS (SELECT *, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t, abs(z) / sqrt(2) AS x FROM zz), "
            f"qq AS (SELECT *, 0.5 * t * exp(-x * x + {poly}) AS q FROM tt)") +
            f"SELECT structure, n, r_plus, r_minus, round(z, 4) AS z, round({p}, 6) AS p_value FROM qq")


def _register_wilcoxon(name, alternative):
    @query(name, _wilcoxon_sql(alternative))
    def _(spark, d):
        out = ev.wilcoxon_paired(fx.scores(spark, d), alternative)
        return out.select("structure", F.col("n").cast("bigint").alias("n"), "r_plus", "r_minus", r("z"), r("p_value", 6))


_register_wilcoxon("wilcoxon_paired", "two-sided")
_register_wilcoxon("wilcoxon_greater", "greater")
_register_wilcoxon("wilcoxon_less", "less")


@query("cohens_d", with_("scores") + "SELECT structure, round((avg(ref) - avg(cmp)) / sqrt(((count(*) - 1) * var_pop(ref) + (count(*) - 1) * var_pop(cmp)) / "
       "(2 * count(*) - 2)), 6) AS cohens_d FROM scores GROUP BY 1")
def _(spark, d):
    return ev.cohens_d(fx.scores(spark, d)).select("structure", r("cohens_d", 6))


PAIR_SQL = (_HARD + ", pr AS (SELECT p.vol_id, p.x, p.y, p.z, p.label, CAST(h.label IS NOT NULL AS DOUBLE) AS g, p.p FROM posteriors p LEFT JOIN hard h ON h.vol_id = p.vol_id AND "
            "h.x = p.x AND h.y = p.y AND h.z = p.z AND h.label = p.label)")


def soft_pairs(spark, d):
    p = fx.posteriors(spark, d)
    return ev.pair_posteriors(po.harden(p), p)


@query("soft_dice", with_("posteriors", extra=PAIR_SQL) + "SELECT vol_id, label, round((sum(2 * g * p) + 1e-7) / (sum(g * g + p * p) + 1e-7), 6) AS dice, round(sum(g), 4) AS gt_volume, "
       "round(1 - (sum(2 * g * p) + 1e-7) / (sum(g * g + p * p) + 1e-7), 6) AS loss FROM pr GROUP BY 1, 2")
def _(spark, d):
    return ev.soft_dice(soft_pairs(spark, d)).select("vol_id", "label", r("dice", 6), r("gt_volume"), r("loss", 6))


@query("soft_dice_loss", with_("posteriors", extra=PAIR_SQL + ", sd AS (SELECT vol_id, label, 1 - (sum(2 * g * p) + 1e-7) / (sum(g * g + p * p) + 1e-7) AS loss, sum(g) AS v FROM pr GROUP BY 1, 2)") +
       "SELECT vol_id, round(sum(loss / nullif(v, 0)) / sum(1 / nullif(v, 0)), 6) AS loss FROM sd GROUP BY 1")
def _(spark, d):
    return ev.weighted_loss(ev.soft_dice(soft_pairs(spark, d)), -1).select("vol_id", r("loss", 6))


@query("soft_dice_boundary", with_("posteriors", extra=PAIR_SQL + ", nb AS (SELECT p.vol_id, p.x, p.y, p.z, p.label, count(h.label) / any_value((least(p.x + 1, 7) - greatest(p.x - 1, 0) + 1) * "
       "(least(p.y + 1, 7) - greatest(p.y - 1, 0) + 1) * (least(p.z + 1, 1) - greatest(p.z - 1, 0) + 1)) AS mean FROM pr p LEFT JOIN hard h ON h.vol_id = p.vol_id AND h.label = p.label AND "
       "abs(h.x - p.x) <= 1 AND abs(h.y - p.y) <= 1 AND abs(h.z - p.z) <= 1 GROUP BY 1, 2, 3, 4, 5), "
       "cl AS (SELECT vol_id, x, y, z, label, g / (sum(g) OVER (PARTITION BY vol_id, x, y, z) + 1e-7) AS g, p / (sum(p) OVER (PARTITION BY vol_id, x, y, z) + 1e-7) AS p, "
       "1 + 2.0 * CAST(mean > 0 AND mean < 1.0 / 3 - 1e-4 AS INT) AS w FROM pr JOIN nb USING (vol_id, x, y, z, label))") +
       "SELECT vol_id, label, round((sum(2 * g * p * w) + 1e-7) / (sum((g * g + p * p) * w) + 1e-7), 6) AS dice FROM cl GROUP BY 1, 2")
def _(spark, d):
    p = fx.posteriors(spark, d)
    weights = boundary_weight(po.harden(p), fx.POST_SHAPE, 1, 2.0)
    return ev.soft_dice(soft_pairs(spark, d), True, weights).select("vol_id", "label", r("dice", 6))


@query("cross_entropy", with_("posteriors", extra=PAIR_SQL) + "SELECT vol_id, round(sum(CASE WHEN g > 0 THEN -g / (1 + 1e-7) * ln(least(greatest(p / (1 + 1e-7), 1e-7), 1 - 1e-7)) ELSE 0 END) / "
       "count(DISTINCT (x, y, z)), 6) AS cross_entropy FROM pr GROUP BY 1")
def _(spark, d):
    return ev.cross_entropy(soft_pairs(spark, d)).select("vol_id", r("cross_entropy", 6))


@query("centroid_distance", with_("posteriors", extra=PAIR_SQL) + "SELECT vol_id, label, round(sqrt(" + " + ".join(
       f"pow(sum(g * {a}) / (sum(g) + 1e-7) - sum(p * {a}) / (sum(p) + 1e-7), 2)" for a in "xyz") + "), 4) AS distance FROM pr GROUP BY 1, 2")
def _(spark, d):
    return ev.centroid_distance(soft_pairs(spark, d)).select("vol_id", "label", r("distance"))


def predicted_qc(spark, d):
    """Predicted quality scores per volume and label: mean probability of the label where it occurs, scaled."""
    p = fx.posteriors(spark, d)
    return p.groupBy("vol_id", "label").agg((F.avg("p") * 1.4 - 0.1).alias("score"))


_QC = "qc AS (SELECT vol_id, label, avg(p) * 1.4 - 0.1 AS score FROM posteriors GROUP BY 1, 2)"


@query("qc_difference", with_("posteriors", "maps", extra=_QC + f", di AS ({dice_sql(digits=12)})") + "SELECT vol_id, label, round(score - dice, 5) AS difference FROM qc JOIN di USING (vol_id, label)")
def _(spark, d):
    return ev.qc_difference(predicted_qc(spark, d), ev.dice_by_label(fx.maps(spark, d), LABELS, shape=fx.MAP_SHAPE)).select("vol_id", "label", r("difference", 5))


@query("qc_clip_round", with_("posteriors", extra=_QC) + "SELECT vol_id, label, round_even(least(greatest(score, 0), 1), 4) AS score FROM qc WHERE label <> 0")
def _(spark, d):
    return ev.qc_clip_round(predicted_qc(spark, d)).select("vol_id", "label", "score")


@query("validation_curve", with_("epochs", extra="e AS (SELECT CAST(regexp_replace(epoch_dir, '[^0-9]', '', 'g') AS INT) AS epoch, avg(abs(score)) AS s FROM epochs GROUP BY 1)") +
       "SELECT epoch, round(s, 6) AS mean_score, row_number() OVER (ORDER BY s DESC, epoch) = 1 AS is_best FROM e")
def _(spark, d):
    return ev.validation_curve(fx.epochs(spark, d)).select("epoch", r("mean_score", 6), "is_best")


@query("validation_curve_by_structure", with_("epochs", extra="e AS (SELECT structure, CAST(regexp_replace(epoch_dir, '[^0-9]', '', 'g') AS INT) AS epoch, avg(abs(score)) AS s FROM epochs GROUP BY 1, 2)") +
       "SELECT structure, epoch, round(s, 6) AS mean_score, row_number() OVER (PARTITION BY structure ORDER BY s, epoch) = 1 AS is_best FROM e")
def _(spark, d):
    return ev.validation_curve(fx.epochs(spark, d), ["structure"], best="min").select("structure", "epoch", r("mean_score", 6), "is_best")


@query("validation_curve_rows", with_("epochs", extra="e AS (SELECT CAST(regexp_replace(epoch_dir, '[^0-9]', '', 'g') AS INT) AS epoch, avg(abs(score)) AS s FROM epochs WHERE structure IN ('A', 'R') GROUP BY 1)") +
       "SELECT epoch, round(s, 6) AS mean_score, row_number() OVER (ORDER BY s DESC, epoch) = 1 AS is_best FROM e")
def _(spark, d):
    return ev.validation_curve(fx.epochs(spark, d), rows=["A", "R"]).select("epoch", r("mean_score", 6), "is_best")


# ---- sampling -------------------------------------------------------------------------------------------------------

@query("weighted_draws", with_("weights", "draws", extra="c AS (SELECT subject, (sum(weight) OVER (ORDER BY subject) - weight) / sum(weight) OVER () AS lo, "
       "sum(weight) OVER (ORDER BY subject) / sum(weight) OVER () AS hi FROM weights)") + "SELECT draw_id, round(u, 6) AS u, subject FROM draws JOIN c ON u >= lo AND u < hi")
def _(spark, d):
    return weighted_draws(fx.weights(spark, d), fx.draws(spark, d)).select("draw_id", r("u", 6), "subject")


# ---- whole-cohort jobs ----------------------------------------------------------------------------------------------

@query("prepare_volumes", with_("maps", "axes", extra="im AS (SELECT vol_id, " + ", ".join(
       f"CASE WHEN f[o{i} + 1] THEN n[o{i} + 1] - 1 - [x, y, z][o{i} + 1] ELSE [x, y, z][o{i} + 1] END AS {a}, n[o{i} + 1] AS n{a}" for i, a in enumerate("xyz")) +
       ", least(greatest(value / 1000, 0), 80) AS v FROM maps JOIN axes USING (vol_id)), "
       "cr AS (SELECT vol_id, " + ", ".join(f"{a} - (n{a} - least(n{a}, 4)) // 2 AS {a}" for a in "xyz") + ", v FROM im WHERE " +
       " AND ".join(f"{a} >= (n{a} - 4) // 2 AND {a} < (n{a} - 4) // 2 + 4" for a in "xyz") + "), "
       "l AS (SELECT vol_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM cr GROUP BY 1)") +
       "SELECT vol_id, CAST(x + 2 AS INT) AS x, CAST(y + 2 AS INT) AS y, CAST(z + 2 AS INT) AS z, round(CASE WHEN lo = hi THEN 0.0 ELSE (greatest(least(v, hi), lo) - lo) / (hi - lo) END, 4) AS value "
       "FROM cr JOIN l USING (vol_id)")
def _(spark, d):
    im = fx.maps(spark, d).select(*V, (F.col("value") / 1000).alias("value"))
    meta = fx.meta(spark, d).drop("perm_id", "flip_bits")
    out = cohort.prepare_volumes(im, meta, target_res=None, crop=(4, 4, 4), ct=True, min_pad=8, levels=2)[0]
    return out.select(*V, r("value"))


FINISH_SQL = (BIG_SQL + ", " + class_sql("kept") + f", nm AS (SELECT vol_id, x, y, z, label, {_NORM} AS p FROM keptk)")


@query("finish_posteriors", with_("posteriors", "meta", recursive=True, extra=FINISH_SQL + ", vs AS (SELECT vol_id, label, sum(p) * any_value(rx * ry * rz) AS v FROM nm "
       "JOIN meta USING (vol_id) WHERE label <> 0 GROUP BY 1, 2)") + "SELECT vol_id, label, round_even(round(v, 9), 3) AS volume FROM vs UNION ALL SELECT vol_id, 43, round_even(round(sum(v), 9), 3) FROM vs GROUP BY 1")
def _(spark, d):
    meta = fx.meta(spark, d, fx.POST_SHAPE).drop("perm_id", "flip_bits")
    return cohort.finish_posteriors(fx.posteriors(spark, d), LABELS, meta, classes=CLASSES)[2].select("vol_id", "label", "volume")


@query("finish_posteriors_labels", with_("posteriors", "axes", recursive=True, extra=BIG_SQL + f", lw AS (SELECT * FROM kept WHERE label = 0 OR p > 0.2), "
       f"nm AS (SELECT vol_id, x, y, z, label, {_NORM} AS p FROM lw), hd AS (SELECT vol_id, [x, y, z] AS c, first(label ORDER BY p DESC, label) AS label FROM nm GROUP BY vol_id, x, y, z), "
       "sh AS (SELECT *, [8, 8, 2] AS ns FROM axes), nat AS (SELECT vol_id, label, " + ", ".join(
           f"(CASE o0 WHEN {k} THEN 1 ELSE CASE o1 WHEN {k} THEN 2 ELSE 3 END END) AS j{k}" for k in range(3)) + ", c, f, ns FROM hd JOIN sh USING (vol_id))") +
       "SELECT vol_id, " + ", ".join(f"CAST(CASE WHEN f[{k + 1}] THEN ns[{k + 1}] - 1 - c[j{k}] ELSE c[j{k}] END AS INT) AS {a}" for k, a in enumerate("xyz")) + ", label FROM nat")
def _(spark, d):
    meta = fx.meta(spark, d, fx.POST_SHAPE).drop("perm_id", "flip_bits")
    return cohort.finish_posteriors(fx.posteriors(spark, d), LABELS, meta, fast=True)[0].select(*VL)


@query("cohort_report", with_("posteriors", "meta", recursive=True, extra="done AS (SELECT s_suppkey AS vol_id FROM supplier WHERE s_acctbal > 5000), " +
       BIG_SQL + f", lw AS (SELECT * FROM kept WHERE label = 0 OR p > 0.2), nm AS (SELECT vol_id, x, y, z, label, {_NORM} AS p FROM lw), "
       "vs AS (SELECT vol_id, label, sum(p) * any_value(rx * ry * rz) AS v FROM nm JOIN meta USING (vol_id) WHERE label <> 0 AND vol_id NOT IN (SELECT vol_id FROM done) GROUP BY 1, 2), " + _QC) +
       "SELECT 'volume' AS kind, vol_id, label, round_even(round(v, 9), 3) AS value FROM vs UNION ALL SELECT 'volume', vol_id, 43, round_even(round(sum(v), 9), 3) FROM vs GROUP BY vol_id UNION ALL "
       "SELECT 'qc', vol_id, label, round_even(least(greatest(score, 0), 1), 4) FROM qc WHERE label <> 0 AND vol_id NOT IN (SELECT vol_id FROM done)")
def _(spark, d):
    sup = fx.table(spark, d, "supplier")
    manifest = sup.select(F.col("s_suppkey").alias("vol_id"), F.concat(F.lit("/in/"), F.col("s_suppkey").cast("string")).alias("path"),
                          F.concat(F.lit("/out/"), F.col("s_suppkey").cast("string")).alias("out_seg"))
    done = sup.where("s_acctbal > 5000").select(F.concat(F.lit("/out/"), F.col("s_suppkey").cast("string")).alias("path"))
    meta = fx.meta(spark, d, fx.POST_SHAPE).drop("perm_id", "flip_bits")
    out = cohort.cohort_report(manifest, done, fx.posteriors(spark, d), meta, LABELS, qc_scores=predicted_qc(spark, d), fast=True)
    volumes_ = out["volumes"].select(F.lit("volume").alias("kind"), "vol_id", "label", F.col("volume").alias("value"))
    return volumes_.unionByName(out["qc"].select(F.lit("qc").alias("kind"), "vol_id", "label", F.col("score").alias("value")))


_REPORTED = "vol_id NOT IN (SELECT vol_id FROM done) AND vol_id % 10 <> 0"
_TURNED = ("sh AS (SELECT *, [8, 8, 2] AS ns FROM axes), tp AS (SELECT vol_id, label, p, " + ", ".join(
           f"CAST(CASE WHEN f[{k + 1}] THEN ns[{k + 1}] - 1 - [x, y, z][j{k}] ELSE [x, y, z][j{k}] END AS INT) AS {a}" for k, a in enumerate("xyz")) +
           " FROM (SELECT *, " + ", ".join(f"CASE o0 WHEN {k} THEN 1 ELSE CASE o1 WHEN {k} THEN 2 ELSE 3 END END AS j{k}" for k in range(3)) +
           f" FROM nm JOIN sh USING (vol_id)) q WHERE {_REPORTED})")


@query("cohort_report_tables", with_("posteriors", "maps", "axes", recursive=True, extra="done AS (SELECT s_suppkey AS vol_id FROM supplier WHERE s_acctbal > 5000), " +
       BIG_SQL + f", lw AS (SELECT * FROM kept WHERE label = 0 OR p > 0.2), nm AS (SELECT vol_id, x, y, z, label, {_NORM} AS p FROM lw), {_TURNED}, "
       "sg AS (SELECT vol_id, x, y, z, first(label ORDER BY p DESC, label) AS label FROM tp GROUP BY 1, 2, 3, 4), "
       "vs AS (SELECT vol_id, label, sum(p) * any_value(rx * ry * rz) AS v FROM tp JOIN meta USING (vol_id) WHERE label <> 0 GROUP BY 1, 2), "
       f"pr AS (SELECT vol_id, coalesce(gt, 0) AS gt, coalesce(label, 0) AS seg FROM (SELECT vol_id, x, y, z, gt FROM maps WHERE z < 2 AND {_REPORTED}) g FULL JOIN sg USING (vol_id, x, y, z)), "
       "cells AS (SELECT vol_id, gt, seg, count(*) AS n FROM pr GROUP BY 1, 2, 3 UNION ALL SELECT vol_id, 0, 0, 128 - count(*) FROM pr GROUP BY 1), "
       f"sc AS (SELECT vol_id, CAST(l AS INT) AS label, 2.0 * sum(CASE WHEN gt = l AND seg = l THEN n ELSE 0 END) / (sum(CASE WHEN gt = l THEN n ELSE 0 END) + sum(CASE WHEN seg = l THEN n ELSE 0 END) + 1e-5) AS v "
       f"FROM cells, (SELECT unnest({LABELS}) AS l) t GROUP BY 1, 2), " + _QC) +
       "SELECT 'seg' AS kind, vol_id, x, y, z, label, CAST(NULL AS DOUBLE) AS value FROM sg UNION ALL SELECT 'posterior', vol_id, x, y, z, label, round(p, 6) FROM tp UNION ALL "
       "SELECT 'volume', vol_id, NULL, NULL, NULL, label, round_even(round(v, 9), 3) FROM vs UNION ALL SELECT 'volume', vol_id, NULL, NULL, NULL, 43, round_even(round(sum(v), 9), 3) FROM vs GROUP BY vol_id UNION ALL "
       f"SELECT 'qc', vol_id, NULL, NULL, NULL, label, round_even(least(greatest(score, 0), 1), 4) FROM qc WHERE label <> 0 AND vol_id NOT IN (SELECT vol_id FROM done) UNION ALL "
       "SELECT 'score', vol_id, NULL, NULL, NULL, label, round(v, 6) FROM sc UNION ALL SELECT 'error', s_suppkey, NULL, NULL, NULL, NULL, NULL FROM supplier "
       "WHERE s_suppkey NOT IN (SELECT vol_id FROM done) AND (s_suppkey % 10 = 0 OR s_suppkey NOT IN (SELECT vol_id FROM posteriors))")
def _(spark, d):
    sup = fx.table(spark, d, "supplier")
    name = lambda folder: F.concat(F.lit(folder), F.col("s_suppkey").cast("string"))
    manifest = sup.select(F.col("s_suppkey").alias("vol_id"), name("/in/").alias("path"), name("/out/").alias("out_seg"))
    done = sup.where("s_acctbal > 5000").select(name("/out/").alias("path"))
    meta = fx.meta(spark, d, fx.POST_SHAPE).drop("perm_id", "flip_bits")
    out = cohort.cohort_report(manifest, done, fx.posteriors(spark, d).where("vol_id % 10 <> 0"), meta, LABELS,
                               qc_scores=predicted_qc(spark, d), gt=fx.label_map(spark, d).where("z < 2"), fast=True)
    kinds = {"seg": ("seg", None), "posteriors": ("posterior", r("p", 6)), "volumes": ("volume", F.col("volume")), "qc": ("qc", F.col("score")),
             "scores": ("score", r("dice", 6)), "errors": ("error", None)}
    rows = None
    for table_, (kind, value) in kinds.items():
        df = out[table_]
        there = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("int")
        part = df.select(F.lit(kind).alias("kind"), "vol_id", *[there(c).alias(c) for c in "xyz"], there("label").alias("label"),
                         (F.lit(None) if value is None else value).cast("double").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("evaluate_models", with_("maps", extra="p AS (SELECT concat('dice_', CAST(q AS VARCHAR)) AS model, * FROM maps WHERE q IN (0, 2, 4)), "
       "g AS (SELECT m.model, t.vol_id, t.gt, CASE WHEN t.q = m.q THEN t.seg ELSE 0 END AS seg FROM (SELECT DISTINCT model, q, vol_id FROM p) m JOIN maps t USING (vol_id))") +
       dice_sql("g", "model, vol_id"))
def _(spark, d):
    m = fx.maps(spark, d)
    predictions = m.select(F.concat(F.lit("dice_"), F.col("q").cast("string")).alias("model"), *V, F.col("seg").alias("label"))
    gt = m.select(*V, F.col("gt").alias("label"))
    return cohort.evaluate_models(predictions, gt, LABELS, 2, shape=fx.MAP_SHAPE).select("model", "vol_id", "label", r("dice", 6))
