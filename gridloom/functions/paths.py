"""String functions on image paths (columns in, columns out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions, longest first.
EXTENSIONS = [".nii.gz", ".nii", ".mgz", ".npz"]

# Substrings removed from a file name, applied one after the other in this order.
SUFFIX_REPLACEMENTS = [
    ("_aseg", ""), ("aseg", ""), (".aseg", ""), ("_aseg_1", ""), ("_aseg_2", ""), ("aseg_1_", ""), ("aseg_2_", ""),
    ("_orig", ""), ("orig", ""), (".orig", ""), ("_norm", ""), ("norm", ""), (".norm", ""), ("_talairach", ""),
    ("GSP_FS_4p5", "GSP"), (".nii_crispSegmentation", ""), ("_crispSegmentation", ""),
    ("_seg", ""), (".seg", ""), ("seg", ""), ("_seg_1", ""), ("_seg_2", ""), ("seg_1_", ""), ("seg_2_", ""),
]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_extension(path: Column) -> Column:
    return reduce(lambda c, ext: F.replace(c, F.lit(ext), F.lit("")), EXTENSIONS, path)


def image_extension(path: Column) -> Column:
    """``nii.gz``, ``nii``, ``mgz`` or ``npz``; NULL for anything else."""
    return F.coalesce(*[F.when(path.endswith(ext), F.lit(ext[1:])) for ext in EXTENSIONS])


def strip_suffix(path: Column) -> Column:
    """Sequential replacement in a fixed order; some later entries can no longer match, as in the original rules."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), SUFFIX_REPLACEMENTS, path)


def subject_id(path: Column) -> Column:
    """Row name used in result tables: basename without ``.nii.gz``."""
    return F.replace(basename(path), F.lit(".nii.gz"), F.lit(""))


def derived_path(path: Column, folder: str, suffix: str) -> Column:
    """``a/b.nii.gz`` -> ``<folder>/b_<suffix>.nii.gz`` (same for .nii, .mgz, .npz)."""
    name = basename(path)
    for ext in (".nii", ".mgz", ".npz"):
        name = F.replace(name, F.lit(ext), F.lit(f"_{suffix}{ext}"))
    return F.concat(F.lit(folder.rstrip("/") + "/"), name)


def with_csv_extension(path: Column) -> Column:
    return F.when(path.endswith(".csv"), path).otherwise(F.concat(path, F.lit(".csv")))


def infer(text: Column) -> Column:
    """Parse to the first type that fits: struct(number, flag, text) with one non-NULL field."""
    number = text.try_cast("double")
    flag = F.when(text == "True", True).when(text == "False", False)
    return F.struct(
        number.alias("number"),
        F.when(number.isNull(), flag).alias("flag"),
        F.when(number.isNull() & flag.isNull(), text).alias("text"),
    )
