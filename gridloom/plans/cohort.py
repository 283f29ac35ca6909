"""User-level jobs over a whole cohort, made of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numbers import closest_multiple
from gridloom.operators import evaluate as ev
from gridloom.operators import posteriors as po
from gridloom.operators.geometry import align, align_plan, centre_crop, crop_to_box, pad, paste_back
from gridloom.operators.intensity import clip, first_channel, rescale
from gridloom.operators.resample import needs_resampling, resample
from gridloom.session import materialize
from gridloom.sources.manifest import skip_existing

VOXEL = ["vol_id", "x", "y", "z"]


def prepare_volumes(df: DataFrame, meta: DataFrame, target_res: Sequence[float] | None = (1.0, 1.0, 1.0),
                    crop: Sequence[int] | None = None, ct: bool = False, min_pad: int | None = None, levels: int = 5,
                    label_map: bool = False, value: str = "value"):
    """First channel, resample where a resolution is off by more than 0.05 mm, align to the identity, centre-crop to a
    multiple of 2^levels, clip (CT), rescale 0.5/99.5 percentiles to 0..1, pad to a multiple and a minimum.

    Returns (voxels, meta, crop boxes or None, pad boxes, aligned meta): what the way back needs. A label map skips
    the resampling blur and the intensity steps.
    """
    if "channel" in df.columns:
        df = first_channel(df).drop("channel")
    df = df.select(*VOXEL, value)
    if target_res is not None:
        off = needs_resampling(target_res)
        todo = meta.where(off)
        changed, changed_meta = resample(df, todo, target_res, "nearest" if label_map else "linear", not label_map, value)
        df = df.join(todo.select("vol_id"), "vol_id", "left_anti").unionByName(changed.select(*VOXEL, value))
        meta = meta.where(~off).unionByName(changed_meta)
    df, aligned = align(df, meta)
    meta, crop_boxes = aligned, None
    unit = 2 ** levels
    up = lambda n: -(-int(n) // unit) * unit
    if crop is not None:
        df, meta, crop_boxes = centre_crop(df, meta, [up(c) for c in crop])
    if not label_map:
        if ct:
            df = df.withColumn(value, clip(F.col(value)))
        df = rescale(df, 0.0, 1.0, 0.5, 99.5, value=value)
    target = [closest_multiple(F.col(f"n{a}"), unit, "higher") for a in "xyz"]
    if min_pad is not None:
        target = [F.greatest(t, F.lit(up(min_pad))) for t in target]
    df, meta, pad_boxes = pad(df, meta, target)
    return df, meta, crop_boxes, pad_boxes, aligned


def finish_posteriors(df: DataFrame, labels: Sequence[int], meta: DataFrame, pad_boxes: DataFrame | None = None,
                      crop_boxes: DataFrame | None = None, fast: bool = False, classes: dict[int, int] | None = None,
                      parcels: DataFrame | None = None, mask: DataFrame | None = None, keep_largest: bool = True):
    """Posteriors to (label map, posteriors, volumes): largest component, topology or threshold, renormalise, argmax,
    parcels, paste back, native orientation, soft volumes with total.

    ``meta``: native (vol_id, shape, resolution, affine). Background is ``labels[0]``. Returned label maps are sparse
    (background implicit where a crop is pasted back).
    """
    background = int(labels[0])
    # Regions, their complement and the background read the posteriors: written once.
    df = materialize(df)
    uncrop = lambda d: crop_to_box(d, pad_boxes) if pad_boxes is not None else d
    by_class = classes is not None and not fast
    if not by_class:
        df = uncrop(df)
    if mask is not None:
        df = po.strict_group_mask(df, mask, background)
    else:
        if keep_largest:
            df = po.keep_biggest(df, background)
        df = uncrop(po.keep_biggest_per_class(df, classes)) if by_class else po.drop_low(df, background)
        df = po.normalise(df)
    # Labels, volumes and the posteriors themselves read the cleaned rows: written once.
    df = materialize(df)
    # Pasting and turning move no probability, so volumes are summed before; parcels are scaled before they are rounded.
    volumes = po.total_intracranial(df, meta, background, int(max(labels)) + 1)
    seg = po.argmax_label(df, labels)
    if parcels is not None:
        seg, soft_parcels = po.merge_parcellation(seg, uncrop(parcels), background=background)
        scaled = po.rescale_parcels(po.soft_sums(soft_parcels, None, background), po.soft_sums(df, meta, background))
        volumes = volumes.unionByName(po.tidy(scaled).select(*volumes.columns))
    plan = align_plan(meta)
    aligned = plan.select(*meta.columns)
    if crop_boxes is not None:
        seg = paste_back(seg, crop_boxes)
        df = paste_back(df, crop_boxes, full=aligned, background=background)
    back = aligned.join(meta.select("vol_id", F.col("affine").alias("_native")), "vol_id")
    seg, _ = align(seg, back, ref="_native")
    df, _ = align(df, back, ref="_native")
    return seg, df, volumes


def cohort_report(manifest: DataFrame, done: DataFrame, posteriors: DataFrame, meta: DataFrame, labels: Sequence[int],
                  qc_scores: DataFrame | None = None, gt: DataFrame | None = None, recompute: bool = False, **options):
    """All results of a cohort in one plan: dict of tables seg, volumes, qc, scores, errors.

    ``manifest`` (vol_id, path, out_...) minus items whose outputs exist; items without posteriors are reported as
    errors and the others go on. ``options`` go to ``finish_posteriors``. Scores are those of the label maps against
    ``gt`` in its native orientation, over each volume's whole grid.
    """
    outputs = [c for c in manifest.columns if c.startswith("out_")]
    todo = skip_existing(manifest, done, outputs, recompute)
    ids = todo.select("vol_id")
    present = posteriors.select("vol_id").distinct()
    errors = todo.join(present, "vol_id", "left_anti").select("vol_id", F.lit("no posteriors").alias("message"))
    seg, soft, volumes = finish_posteriors(posteriors.join(ids, "vol_id", "left_semi"), labels, meta, **options)
    result = {"seg": seg, "posteriors": soft, "volumes": volumes, "errors": errors}
    if qc_scores is not None:
        result["qc"] = ev.qc_clip_round(qc_scores.join(ids, "vol_id", "left_semi"))
    if gt is not None:
        mine = gt.join(ids, "vol_id", "left_semi")
        grid = meta.join(ids, "vol_id", "left_semi").join(errors.select("vol_id"), "vol_id", "left_anti")
        result["scores"] = ev.dice_by_label(ev.pair_maps(mine, seg), labels, shape=grid.select("vol_id", "nx", "ny", "nz"))
    return result


def evaluate_models(predictions: DataFrame, gt: DataFrame, labels: Sequence[int], step: int = 1,
                    scored: DataFrame | None = None, shape=None) -> DataFrame:
    """Scores of every ``step``-th model (sorted by name), without the models already in ``scored``: one job for all.

    ``predictions``: (model, vol_id, x, y, z, label). Output: model, vol_id, label, dice; ``shape`` as in ``dice_by_label``.
    Only predicted voxels meet the truth. What a model leaves out is the truth's count per label, taken once per volume,
    less what the model's voxels met; cells per model and volume are at most labels^2.
    """
    from gridloom.sources.manifest import ordinal
    models = ordinal(predictions.select("model").distinct(), ["model"]).where(F.col("ord") % step == 0).select("model")
    if scored is not None:
        models = models.join(scored.select("model").distinct(), "model", "left_anti")
    chosen = predictions.join(models, "model", "left_semi")
    keys = ["model", "vol_id"]
    truth = gt.select(*VOXEL, F.col("label").cast("int").alias("gt"))
    met = (chosen.select("model", *VOXEL, F.col("label").cast("int").alias("seg")).join(truth, VOXEL, "left")
           .groupBy(*keys, "gt", "seg").agg(F.count("*").alias("n"))
           .groupBy(*keys).agg(F.collect_list(F.struct("gt", "seg", "n")).alias("_met")))
    totals = (truth.groupBy("vol_id", "gt").agg(F.count("*").alias("n"))
              .groupBy("vol_id").agg(F.collect_list(F.struct("gt", "n")).alias("_all")))
    cells = F.expr("""concat(
        transform(_met, c -> named_struct('gt', coalesce(c.gt, 0), 'seg', c.seg, 'n', c.n)),
        transform(coalesce(_all, CAST(array() AS ARRAY<STRUCT<gt: INT, n: BIGINT>>)), c -> named_struct('gt', c.gt, 'seg', 0, 'n', c.n)),
        transform(filter(_met, c -> c.gt IS NOT NULL), c -> named_struct('gt', c.gt, 'seg', 0, 'n', -c.n)))""")
    table = met.join(totals, "vol_id", "left").select(*keys, cells.alias("cells"))
    return ev.dice_of_counts(table, labels, keys, shape)
