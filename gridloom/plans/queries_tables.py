"""Queries on listings, label dictionaries, intensities and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numbers as num
from gridloom.functions import paths
from gridloom.operators import aggregate as ag
from gridloom.operators import intensity as it
from gridloom.operators import labels as lb
from gridloom.operators.geometry import dense_grid
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import with_
from gridloom.plans.registry import query
from gridloom.sources import ingest, manifest as mf, sinks

LABELS = [0, 2, 3, 24, 41, 42]
IS_IMAGE = ("(path LIKE '%.nii.gz' OR path LIKE '%.nii' OR path LIKE '%.mgz' OR path LIKE '%.npz')")
BASE = "list_extract(string_split(path, '/'), -1)"


def r(column: str, digits: int = 4):
    return F.round(column, digits).alias(column)


# ---- sources and sinks ----------------------------------------------------------------------------------------------

@query("list_volumes", with_("manifest") + f"SELECT path, length FROM manifest WHERE {IS_IMAGE} AND "
       f"(contains({BASE}, '_aseg') OR contains({BASE}, '_norm'))")
def _(spark, d):
    return mf.list_volumes(fx.manifest(spark, d), ["_aseg", "_norm"]).select("path", "length")


@query("list_subfolders", with_("manifest") +
       f"SELECT DISTINCT left(path, length(path) - length({BASE}) - 1) AS path FROM manifest WHERE {IS_IMAGE}")
def _(spark, d):
    return mf.list_subfolders(mf.list_volumes(fx.manifest(spark, d)))


@query("volume_lines", with_("images") + "SELECT vol_id, x, y, count(*) AS n, round(sum(value), 4) AS total, "
       "round(sum(value * z), 4) AS moment FROM images GROUP BY ALL")
def _(spark, d):
    lines = ingest.voxels_to_lines(fx.images(spark, d), ["vol_id"])
    back = ingest.lines_to_voxels(lines, "vol_id")
    return back.groupBy("vol_id", "x", "y").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"),
                                                F.round(F.sum(F.col("value") * F.col("z")), 4).alias("moment"))


@query("volume_info", with_("maps") + "SELECT vol_id, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz, "
       "count(*) AS n_voxels, CASE WHEN max(z) + 1 <= 10 THEN 2 ELSE 3 END AS n_dims, "
       "CASE WHEN max(z) + 1 <= 10 THEN max(z) + 1 ELSE 1 END AS n_channels FROM maps GROUP BY vol_id")
def _(spark, d):
    return ingest.volume_info(fx.maps(spark, d))


def _renamed(suffix: str) -> str:
    s = BASE
    for ext in (".nii", ".mgz", ".npz"):
        s = f"replace({s}, '{ext}', '_{suffix}{ext}')"
    return f"concat('/out/', {s})"


@query("derive_output_paths", with_("manifest") + f"SELECT path, {_renamed('seg')} AS out_seg, {_renamed('posteriors')} AS "
       f"out_posteriors, '/out/volumes.csv' AS out_volumes FROM manifest WHERE {IS_IMAGE}")
def _(spark, d):
    files = mf.list_volumes(fx.manifest(spark, d)).select("path")
    return mf.derive_output_paths(files, "/out", {"out_seg": "seg", "out_posteriors": "posteriors"},
                                  {"out_volumes": "/out/volumes"})


def planned(spark, d):
    """Outputs of the whole listing, and those taken as done: large files have both, middle ones only the first."""
    files = mf.list_volumes(fx.manifest(spark, d))
    todo = mf.derive_output_paths(files, "/out", {"out_seg": "seg", "out_posteriors": "posteriors"})
    done = todo.where("length > 300").select(F.col("out_seg").alias("path")).unionByName(
        todo.where("length > 1500").select(F.col("out_posteriors").alias("path")))
    return todo, done


@query("skip_existing", with_("manifest") + f"SELECT path FROM manifest WHERE {IS_IMAGE} AND length <= 1500")
def _(spark, d):
    todo, done = planned(spark, d)
    return mf.skip_existing(todo, done, ["out_seg", "out_posteriors"]).select("path")


@query("quarantine_errors", with_("maps", extra="bad AS (SELECT vol_id FROM maps WHERE value > 104000 GROUP BY 1)") +
       "SELECT vol_id, 'error' AS status, 'value out of range' AS message, CAST(0 AS BIGINT) AS n FROM bad UNION ALL "
       "SELECT vol_id, 'ok', '', count(*) FROM maps WHERE vol_id NOT IN (SELECT vol_id FROM bad) GROUP BY vol_id")
def _(spark, d):
    good, bad = ingest.quarantine(fx.maps(spark, d), F.when(F.col("value") > 104000, F.lit("value out of range")))
    ok = good.groupBy("vol_id").agg(F.lit("ok").alias("status"), F.lit("").alias("message"), F.count("*").alias("n"))
    return bad.select("vol_id", F.lit("error").alias("status"), "message", F.lit(0).cast("bigint").alias("n")).unionByName(ok)


NAMES = dict(lb.STRUCTURES)


@query("region_table", with_("maps") + "SELECT vol_id AS subject, " + ", ".join(
       f"CAST(count(*) FILTER (gt = {v}) * 1.5 AS DOUBLE) AS \"{NAMES[v]}\"" for v in LABELS[1:]) + " FROM maps GROUP BY vol_id")
def _(spark, d):
    vols = ag.hard_volumes(fx.label_map(spark, d), LABELS, 1.5)
    return sinks.region_table(vols, LABELS, [NAMES[v] for v in LABELS])


@query("score_matrix", with_("maps") + "SELECT vol_id, " + ", ".join(
       f"CAST(count(*) FILTER (gt = {v}) AS DOUBLE) AS \"{v}\"" for v in LABELS) + " FROM maps GROUP BY vol_id")
def _(spark, d):
    vols = ag.hard_volumes(fx.label_map(spark, d), LABELS, skip_background=False)
    scores = vols.select("vol_id", "label", F.lit("volume").alias("metric"), F.col("volume").alias("value"))
    return sinks.score_matrix(scores, LABELS, "volume")


@query("typed_voxels", with_("images") + "SELECT vol_id, x, y, z, CAST(round_even(value * 4, 0) AS INT) AS value FROM images")
def _(spark, d):
    scaled = fx.images(spark, d).withColumn("value", F.col("value") * 4)
    return sinks.typed_voxels(scaled, "int").select("vol_id", "x", "y", "z", "value")


@query("pair_by_order", with_("manifest", extra=f"l AS (SELECT path, concat('/labels/', {BASE}) AS other FROM manifest WHERE "
       f"{IS_IMAGE}), a AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS ord FROM l), "
       "b AS (SELECT other, row_number() OVER (ORDER BY other) - 1 AS ord FROM l)") +
       "SELECT a.ord, a.path AS path_a, b.other AS path_b FROM a JOIN b USING (ord)")
def _(spark, d):
    images = mf.list_volumes(fx.manifest(spark, d)).select("path")
    other = images.select(F.concat(F.lit("/labels/"), paths.basename(F.col("path"))).alias("path"))
    return mf.pair_by_order(images, other)


@query("pair_with_single", with_("manifest") + f"SELECT row_number() OVER (ORDER BY path) - 1 AS ord, path AS path_a, "
       f"(SELECT max(path) FROM manifest) AS path_b FROM manifest WHERE {IS_IMAGE}")
def _(spark, d):
    listing = fx.manifest(spark, d)
    return mf.pair_by_order(mf.list_volumes(listing).select("path"), listing.agg(F.max("path").alias("path")), repeat=True)


# ---- labels ---------------------------------------------------------------------------------------------------------

@query("label_list", with_("maps") + "SELECT gt AS label FROM maps UNION SELECT seg FROM maps")
def _(spark, d):
    m = fx.maps(spark, d)
    return lb.label_list(m.select(F.col("gt").alias("label")), m.select(F.col("seg").alias("label")))


_SIDE = "CASE WHEN label IN (0, 24) THEN 'neutral' WHEN label IN (2, 3) THEN 'left' ELSE 'right' END"


@query("sort_by_side", with_("maps", extra="l AS (SELECT gt AS label FROM maps UNION SELECT seg FROM maps), "
       f"s AS (SELECT label, {_SIDE} AS side FROM l)") +
       "SELECT CAST(row_number() OVER (ORDER BY CASE side WHEN 'neutral' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, label) - 1 AS INT) "
       "AS ord, label, side, (SELECT count(*) FROM s WHERE side = 'neutral') AS n_neutral FROM s")
def _(spark, d):
    m = fx.maps(spark, d)
    return lb.sort_by_side(lb.label_list(m.select(F.col("gt").alias("label")), m.select(F.col("seg").alias("label"))))


@query("convert_labels", with_("maps") + "SELECT vol_id, x, y, z, CASE seg WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 42 THEN 3 ELSE 0 END "
       "AS label FROM maps")
def _(spark, d):
    return lb.convert_labels(fx.label_map(spark, d, "seg"), [0, 2, 3, 42])


@query("convert_labels_by_table", with_("maps") + "SELECT vol_id, x, y, z, CASE seg WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 41 THEN 42 "
       "WHEN 42 THEN 41 ELSE seg END AS label FROM maps")
def _(spark, d):
    m = fx.label_map(spark, d, "seg")
    swap = {2: 3, 3: 2, 41: 42, 42: 41}
    table = lb.label_list(m).select(F.col("label").alias("source"), F.coalesce(
        lb.literal_map(list(swap), list(swap.values()))[F.col("label")], F.col("label")).alias("target"))
    return lb.convert_labels_by_table(m, table).select("vol_id", "x", "y", "z", "label")


@query("reset_labels", with_("maps") + "SELECT vol_id, x, y, z, CASE WHEN gt IN (2, 41) THEN 0 ELSE gt END AS label FROM maps")
def _(spark, d):
    return lb.reset_labels(fx.label_map(spark, d), [2, 41])


@query("keep_labels", with_("maps") + "SELECT vol_id, x, y, z, CASE WHEN gt IN (3, 42) THEN gt ELSE -1 END AS label, "
       "CAST(gt IN (3, 42) AS INT) AS kept FROM maps")
def _(spark, d):
    return lb.keep_labels(fx.label_map(spark, d), [3, 42], -1, mask="kept")


@query("correct_labels", with_("maps") + "SELECT vol_id, x, y, z, CASE seg WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 24 THEN 0 ELSE seg END "
       "AS label FROM maps")
def _(spark, d):
    return lb.correct_labels(fx.label_map(spark, d, "seg"), [2, 3, 24], [3, 2, 0])


@query("correct_labels_candidates", with_("maps", extra="b AS (SELECT vol_id, x, y, z FROM maps WHERE gt = 24), "
       "c AS (SELECT vol_id, x, y, z, gt, CASE gt WHEN 42 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS o FROM maps WHERE gt IN (2, 41, 42)), "
       "n AS (SELECT b.vol_id, b.x, b.y, b.z, arg_min(c.gt, ((b.x-c.x)*(b.x-c.x)+(b.y-c.y)*(b.y-c.y)+(b.z-c.z)*(b.z-c.z))*10+c.o) "
       "AS label FROM b JOIN c USING (vol_id) GROUP BY 1, 2, 3, 4)") +
       "SELECT m.vol_id, m.x, m.y, m.z, coalesce(n.label, m.gt) AS label FROM maps m LEFT JOIN n USING (vol_id, x, y, z)")
def _(spark, d):
    return lb.correct_labels_candidates(fx.label_map(spark, d), 24, [42, 2, 41]).select("vol_id", "x", "y", "z", "label")


def components_sql(mask: str, ny: int, nz: int, connectivity: int = 6, keys: str = "vol_id") -> str:
    """Recursive definition of cc(keys, x, y, z, id): id is the first voxel of the component."""
    near = ("(values (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1))" if connectivity == 6 else
            "(SELECT a - 1, b - 1, c - 1 FROM range(3) t(a), range(3) u(b), range(3) v(c))")
    same = " AND ".join(f"m.{k} = c.{k}" for k in keys.split(", "))
    return (f"off(dx, dy, dz) AS ({near}), cc({keys}, x, y, z, id) USING KEY ({keys}, x, y, z) AS ("
            f"SELECT {keys}, x, y, z, (x * {ny} + y) * {nz} + z FROM ({mask}) UNION "
            f"SELECT {', '.join('m.' + k for k in keys.split(', '))}, m.x, m.y, m.z, min(c.id) FROM cc c, off o, recurring.cc m "
            f"WHERE {same} AND m.x = c.x + o.dx AND m.y = c.y + o.dy AND m.z = c.z + o.dz AND c.id < m.id GROUP BY ALL)")


@query("correct_labels_nearest", with_("solids", recursive=True, extra=components_sql(
       "SELECT vol_id, x, y, z FROM solids WHERE gt = 53", 12, 12) +
       ", b AS (SELECT vol_id, id, greatest(min(x) - 1, 0) AS x0, max(x) AS x1, greatest(min(y) - 1, 0) AS y0, max(y) AS y1, "
       "greatest(min(z) - 1, 0) AS z0, max(z) AS z1 FROM cc GROUP BY 1, 2), "
       "own AS (SELECT c.vol_id, c.x, c.y, c.z, max(b.id) AS id FROM cc c JOIN b ON b.vol_id = c.vol_id AND c.x BETWEEN x0 AND x1 "
       "AND c.y BETWEEN y0 AND y1 AND c.z BETWEEN z0 AND z1 GROUP BY 1, 2, 3, 4), "
       "cand AS (SELECT b.vol_id, b.id, s.x, s.y, s.z, s.gt FROM b JOIN solids s ON s.vol_id = b.vol_id AND s.x BETWEEN x0 AND x1 "
       "AND s.y BETWEEN y0 AND y1 AND s.z BETWEEN z0 AND z1 WHERE s.gt NOT IN (0, 53)), "
       "n AS (SELECT o.vol_id, o.x, o.y, o.z, arg_min(c.gt, ((o.x-c.x)*(o.x-c.x)+(o.y-c.y)*(o.y-c.y)+(o.z-c.z)*(o.z-c.z))*100+c.gt) "
       "AS label FROM own o JOIN cand c ON c.vol_id = o.vol_id AND c.id = o.id GROUP BY 1, 2, 3, 4)") +
       "SELECT s.vol_id, s.x, s.y, s.z, CASE WHEN s.gt = 53 THEN coalesce(n.label, -1) ELSE s.gt END AS label "
       "FROM solids s LEFT JOIN n USING (vol_id, x, y, z) WHERE s.gt <> 0")
def _(spark, d):
    return lb.correct_labels_nearest(fx.solid(spark, d), [53], remove_zero=True).select("vol_id", "x", "y", "z", "label")


@query("group_classes", with_("maps") + "SELECT vol_id, x, y, z, gt AS label, CASE WHEN gt = 0 THEN 0 WHEN gt IN (2, 41) THEN 1 "
       "ELSE 2 END AS class_id FROM maps WHERE gt IN (0, 2, 3, 41, 42)")
def _(spark, d):
    return lb.group_classes(fx.label_map(spark, d), [0, 2, 41, 3, 42], [0, 1, 1, 2, 2])


@query("flip_label_pairs", with_("maps", extra="l AS (SELECT DISTINCT gt AS label FROM maps)") +
       "SELECT label, CASE label WHEN 2 THEN 41 WHEN 3 THEN 42 WHEN 41 THEN 2 WHEN 42 THEN 3 ELSE label END AS flipped FROM l")
def _(spark, d):
    return lb.flip_pairs(lb.sort_by_side(lb.label_list(fx.label_map(spark, d))))


@query("name_labels", with_("maps", extra="l AS (SELECT DISTINCT gt AS label FROM maps)") + "SELECT label, CASE label " +
       " ".join(f"WHEN {v} THEN '{NAMES[v]}'" for v in LABELS) + " END AS name FROM l UNION ALL "
       "SELECT max(label) + 1, 'total intracranial' FROM l")
def _(spark, d):
    return lb.name_labels(lb.label_list(fx.label_map(spark, d)), lb.label_dictionary(spark))


@query("one_hot", with_("maps") + "SELECT vol_id, x, y, z, CAST(l AS INT) AS label, CAST(gt = l AS DOUBLE) AS p FROM maps, "
       "(SELECT unnest([0, 2, 3, 24, 41, 42]) AS l) t")
def _(spark, d):
    return lb.one_hot(fx.label_map(spark, d), LABELS, sparse=False).select("vol_id", "x", "y", "z", "label", "p")


@query("labels_to_keep", with_("maps") + "SELECT DISTINCT vol_id, gt AS label FROM maps WHERE gt NOT IN (0, 2, 3)")
def _(spark, d):
    return lb.labels_to_keep(fx.label_map(spark, d), [0, 2, 3])


# ---- intensities ----------------------------------------------------------------------------------------------------

@query("mask_volume", with_("images") + "SELECT vol_id, x, y, z, CASE WHEN value >= 0.1 THEN value ELSE -9.0 END AS value FROM images")
def _(spark, d):
    return it.mask_volume(fx.images(spark, d), fill=-9.0).select("vol_id", "x", "y", "z", "value")


_BALL = "(SELECT a-1 AS dx, b-1 AS dy, c-1 AS dz FROM range(3) t(a), range(3) u(b), range(3) v(c) WHERE abs(a-1)+abs(b-1)+abs(c-1) <= 1)"


@query("mask_volume_closed", with_("images", extra="m AS (SELECT vol_id, x, y, z FROM images WHERE value >= 0.1), "
       f"o AS {_BALL}, dil AS (SELECT DISTINCT vol_id, x + dx AS x, y + dy AS y, z + dz AS z FROM m, o WHERE x + dx BETWEEN 0 AND 3 "
       "AND y + dy BETWEEN 0 AND 3 AND z + dz BETWEEN 0 AND 3), ero AS (SELECT vol_id, x - dx AS x, y - dy AS y, z - dz AS z "
       "FROM dil, o GROUP BY ALL HAVING count(*) = 7)") +
       "SELECT vol_id, x, y, z, CASE WHEN e.vol_id IS NULL THEN 0.0 ELSE value END AS value FROM images LEFT JOIN ero e "
       "USING (vol_id, x, y, z)")
def _(spark, d):
    return it.mask_volume(fx.images(spark, d), (4, 4, 4), dilate=1, erode=1).select("vol_id", "x", "y", "z", "value")


@query("mask_volume_external", with_("images") + "SELECT vol_id, x, y, z, channel, CASE WHEN (x + y + z + vol_id) % 3 > 0 THEN value ELSE -1.0 END AS value FROM "
       "(SELECT vol_id, x, y, z, 0 AS channel, value FROM images UNION ALL SELECT vol_id, x, y, z, 1, 2 * value FROM images) c")
def _(spark, d):
    a = fx.images(spark, d).select("vol_id", "x", "y", "z", "value")
    both = it.stack_channels(a, a.withColumn("value", 2 * F.col("value")))
    region = a.where("(x + y + z + vol_id) % 3 > 0").select("vol_id", "x", "y", "z")
    return it.mask_volume(both, mask=region, fill=-1.0).select("vol_id", "x", "y", "z", "channel", "value")


def _limits(p0, p1, where=""):
    return (f"l AS (SELECT vol_id, quantile_cont(value, {p0}) AS lo, quantile_cont(value, {p1}) AS hi FROM images {where} "
            "GROUP BY vol_id)")


@query("rescale", with_("images", extra=_limits(0.02, 0.98)) + "SELECT vol_id, x, y, z, round(CASE WHEN lo = hi THEN 0.0 ELSE "
       "(greatest(least(value, hi), lo) - lo) / (hi - lo) * 255 END, 4) AS value FROM images JOIN l USING (vol_id)")
def _(spark, d):
    return it.rescale(fx.images(spark, d)).select("vol_id", "x", "y", "z", r("value"))


@query("rescale_positive", with_("images", extra=_limits(0.005, 0.995, "WHERE value > 0")) + "SELECT vol_id, x, y, z, "
       "round(CASE WHEN lo = hi THEN 0.0 ELSE (greatest(least(value, hi), lo) - lo) / (hi - lo) END, 4) AS value "
       "FROM images JOIN l USING (vol_id)")
def _(spark, d):
    return it.rescale(fx.images(spark, d), 0, 1, 0.5, 99.5, True).select("vol_id", "x", "y", "z", r("value"))


@query("clip_intensity", with_("images") + "SELECT vol_id, x, y, z, greatest(0.0, least(0.5, value)) AS value FROM images")
def _(spark, d):
    return fx.images(spark, d).select("vol_id", "x", "y", "z", it.clip(F.col("value"), 0.0, 0.5).alias("value"))


@query("normalise_minmax", with_("images", extra="k AS (SELECT vol_id, value, row_number() OVER (PARTITION BY vol_id ORDER BY value) "
       "- 1 AS i FROM images), l AS (SELECT vol_id, max(value) FILTER (i = 6) AS lo, max(value) FILTER (i = 57) AS hi FROM k GROUP BY 1)") +
       "SELECT vol_id, x, y, z, round((greatest(least(value, hi), lo) - lo) / (hi - lo + 1e-7), 4) AS value FROM images JOIN l USING (vol_id)")
def _(spark, d):
    return it.normalise_minmax(fx.images(spark, d), (0.1, 0.9)).select("vol_id", "x", "y", "z", r("value"))


@query("normalise_minmax_joint", with_("images", extra="c AS (SELECT vol_id, x, y, z, 0 AS channel, value FROM images UNION ALL SELECT vol_id, x, y, z, 1, 2 * value FROM images), "
       "k AS (SELECT vol_id, value, row_number() OVER (PARTITION BY vol_id ORDER BY value) - 1 AS i FROM c), l AS (SELECT vol_id, max(value) FILTER (i = 12) AS lo, max(value) FILTER (i = 115) AS hi FROM k GROUP BY 1)") +
       "SELECT vol_id, x, y, z, channel, round((greatest(least(value, hi), lo) - lo) / (hi - lo + 1e-7), 4) AS value FROM c JOIN l USING (vol_id)")
def _(spark, d):
    a = fx.images(spark, d).select("vol_id", "x", "y", "z", "value")
    both = it.stack_channels(a, a.withColumn("value", 2 * F.col("value")))
    return it.normalise_minmax(both, (0.1, 0.9), joint=True).select("vol_id", "x", "y", "z", "channel", r("value"))


@query("nan_to_zero", with_("images") + "SELECT vol_id, x, y, z, CASE WHEN value < -0.1 THEN 0.0 ELSE value END AS value FROM images")
def _(spark, d):
    broken = fx.images(spark, d).withColumn("value", F.when(F.col("value") < -0.1, float("nan")).otherwise(F.col("value")))
    return broken.select("vol_id", "x", "y", "z", it.nan_to_zero(F.col("value")).alias("value"))


@query("stack_channels", with_("images") + "SELECT vol_id, x, y, z, value, 0 AS channel FROM images UNION ALL "
       "SELECT vol_id, x, y, z, value * value, 1 FROM images")
def _(spark, d):
    a = fx.images(spark, d).select("vol_id", "x", "y", "z", "value")
    return it.stack_channels(a, a.withColumn("value", F.col("value") * F.col("value")))


@query("first_channel", with_("images") + "SELECT vol_id, x, y, z, value FROM images")
def _(spark, d):
    a = fx.images(spark, d).select("vol_id", "x", "y", "z", "value")
    return it.first_channel(it.stack_channels(a, a.withColumn("value", -F.col("value")))).drop("channel")


@query("minmax_unit", with_("images", extra="l AS (SELECT min(value) AS lo, max(value) AS hi FROM images)") +
       "SELECT vol_id, x, y, z, round((value - lo) / (hi - lo + 1e-7), 6) AS value FROM images, l")
def _(spark, d):
    return it.minmax_unit(fx.images(spark, d)).select("vol_id", "x", "y", "z", r("value", 6))


# ---- scalar functions -----------------------------------------------------------------------------------------------

def _nested(column: str, pairs) -> str:
    for a, b in pairs:
        column = f"replace({column}, '{a}', '{b}')"
    return column


@query("strip_extension", with_("manifest") + f"SELECT path, {_nested('path', [(e, '') for e in paths.EXTENSIONS])} AS stem, "
       "CASE WHEN path LIKE '%.nii.gz' THEN 'nii.gz' WHEN path LIKE '%.nii' THEN 'nii' WHEN path LIKE '%.mgz' THEN 'mgz' "
       "WHEN path LIKE '%.npz' THEN 'npz' END AS extension FROM manifest")
def _(spark, d):
    p = F.col("path")
    return fx.manifest(spark, d).select("path", paths.strip_extension(p).alias("stem"), paths.image_extension(p).alias("extension"))


@query("strip_suffix", with_("manifest") + f"SELECT path, {_nested(BASE, paths.SUFFIX_REPLACEMENTS)} AS name FROM manifest")
def _(spark, d):
    return fx.manifest(spark, d).select("path", paths.strip_suffix(paths.basename(F.col("path"))).alias("name"))


@query("subject_id", with_("manifest") + f"SELECT path, replace({BASE}, '.nii.gz', '') AS subject FROM manifest")
def _(spark, d):
    return fx.manifest(spark, d).select("path", paths.subject_id(F.col("path")).alias("subject"))


_TEXTS = "SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(n_chars AS VARCHAR) WHEN n_chars > 900 THEN 'True' ELSE source END AS text FROM documents"


@query("infer", "SELECT doc_id, TRY_CAST(text AS DOUBLE) AS number, CASE WHEN TRY_CAST(text AS DOUBLE) IS NULL AND text = 'True' "
       "THEN 1 END AS flag, CASE WHEN TRY_CAST(text AS DOUBLE) IS NULL AND text <> 'True' THEN text END AS text FROM "
       f"({_TEXTS}) t")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    text = (F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).when(F.col("n_chars") > 900, "True")
            .otherwise(F.col("source")))
    return docs.select("doc_id", paths.infer(text).alias("_i")).select("doc_id", "_i.number", F.col("_i.flag").cast("int").alias("flag"), "_i.text")


@query("closest_multiple", "SELECT doc_id, n_chars // 7 * 7 AS lower, (n_chars + 6) // 7 * 7 AS higher, "
       "(n_chars + 3) // 7 * 7 AS closer FROM documents")
def _(spark, d):
    n = F.col("n_chars")
    return fx.table(spark, d, "documents").select("doc_id", *[num.closest_multiple(n, 7, m).alias(m)
                                                              for m in ("lower", "higher", "closer")])


@query("dense_grid", with_("meta") + "SELECT vol_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, "
       "CAST((x * ny + y) * nz + z AS BIGINT) AS lin FROM meta, range(8) a(x), range(8) b(y), range(7) c(z)")
def _(spark, d):
    grid = dense_grid(fx.meta(spark, d).select("vol_id"), fx.MAP_SHAPE)
    return grid.withColumn("lin", num.linear_index(F.col("x"), F.col("y"), F.col("z"), 8, 7))
