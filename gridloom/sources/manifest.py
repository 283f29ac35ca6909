"""File listings, output paths, pairing and skip-existing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.order import running_total
from gridloom.functions.paths import basename, derived_path, image_extension, with_csv_extension


def match_name(path: Column, expr: Sequence[str], cond: str = "or") -> Column:
    """Basename contains any ('or') or all ('and') of the given strings."""
    tests = [basename(path).contains(e) for e in expr]
    return reduce((lambda a, b: a | b) if cond == "or" else (lambda a, b: a & b), tests)


def list_volumes(files: DataFrame, expr: Sequence[str] | None = None, cond: str = "or") -> DataFrame:
    """Image files of a listing (any table with a ``path`` column)."""
    out = files.where(image_extension(F.col("path")).isNotNull())
    return out.where(match_name(F.col("path"), list(expr), cond)) if expr else out


def scan_folder(spark: SparkSession, folder: str, expr: Sequence[str] | None = None, cond: str = "or",
                check_if_empty: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the images of a folder; the file contents are never read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{nii.gz,nii,mgz,npz}").load(folder)
             .select("path", "length", "modificationTime"))
    out = list_volumes(files, expr, cond)
    if check_if_empty and out.isEmpty():
        raise FileNotFoundError(f"no .nii, .nii.gz, .mgz or .npz image could be found in {folder}")
    return out


def list_subfolders(files: DataFrame, expr: Sequence[str] | None = None, cond: str = "or") -> DataFrame:
    """Distinct parent folders of a listing, filtered on their own name."""
    folder = F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
    out = files.select(folder.alias("path")).distinct()
    return out.where(match_name(F.col("path"), list(expr), cond)) if expr else out


def read_manifest_text(spark: SparkSession, path: str) -> DataFrame:
    """(ord, path) of a text file with one path per line; blank lines are dropped.

    Lines keep their place by the start of their file block and their position in it.
    """
    lines = spark.read.text(path).select(F.col("value").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_line"))
    kept = running_total(lines.where("path <> ''"), [], ["_block", "_line"], F.lit(1), "ord")
    return kept.select((F.col("ord") - 1).alias("ord"), "path")


def derive_output_paths(files: DataFrame, folder: str, suffixes: dict[str, str], csv: dict[str, str] | None = None) -> DataFrame:
    """Add one column per output kind: ``suffixes`` = {column: suffix}; ``csv`` = {column: file} shared by all."""
    out = files
    for column, suffix in suffixes.items():
        out = out.withColumn(column, derived_path(F.col("path"), folder, suffix))
    for column, name in (csv or {}).items():
        out = out.withColumn(column, with_csv_extension(F.lit(name)))
    return out


def skip_existing(todo: DataFrame, done: DataFrame, outputs: Sequence[str], recompute: bool = False) -> DataFrame:
    """Items with at least one output path that is not in ``done(path)``: one anti join over all output kinds."""
    if recompute:
        return todo
    wanted = todo.select("path", F.explode(F.array(*[F.col(c) for c in outputs])).alias("_out"))
    missing = wanted.where("_out IS NOT NULL").join(done.select(F.col("path").alias("_out")), "_out", "left_anti")
    return todo.join(missing.select("path").distinct(), "path", "left_semi")


def ordinal(files: DataFrame, order: Sequence[str] = ("path",), keys: Sequence[str] = ()) -> DataFrame:
    """0-based position in sorted order (per keys), without sorting everything in one task."""
    out = running_total(files, list(keys), list(order), F.lit(1), "ord")
    return out.withColumn("ord", F.col("ord") - 1)


def pair_by_order(a: DataFrame, b: DataFrame, strict: bool = True, repeat: bool = False,
                  mask: DataFrame | None = None) -> DataFrame:
    """Positional zip of two sorted listings: (ord, path_a, path_b), and path_mask with a third one.

    Unequal counts raise an error. With strict=False only what has a partner is paired; ``unpaired`` lists the rest.
    ``repeat`` sets the only item of ``b`` beside every item of ``a``.
    """
    n_a = a.count() if strict else None
    for other in [b] * (repeat or strict) + [mask] * (strict and mask is not None):
        n, most = other.count(), 1 if repeat and other is b else n_a
        if n != most:
            raise ValueError(f"listings should have the same number of items (one, if repeated), had {n_a} and {n}")
    left = ordinal(a.select("path")).select("ord", F.col("path").alias("path_a"))
    if repeat:
        pairs = left.withColumn("path_b", b.agg(F.max("path")).scalar())
    else:
        pairs = left.join(ordinal(b.select("path")).select("ord", F.col("path").alias("path_b")), "ord")
    if mask is not None:
        pairs = pairs.join(ordinal(mask.select("path")).select("ord", F.col("path").alias("path_mask")), "ord")
    return pairs


def unpaired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of either listing whose position the other lacks: (ord, path_a, path_b), one of them NULL."""
    sides = [ordinal(d.select("path")).select("ord", F.col("path").alias(c)) for d, c in ((a, "path_a"), (b, "path_b"))]
    return sides[0].join(sides[1], "ord", "full").where("path_a IS NULL OR path_b IS NULL")
