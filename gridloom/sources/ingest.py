"""Reading image files into line tables.

The codec is a small per-file helper; Spark lists the files, spreads them over tasks, and writes the result once, split
into lines, headers and errors. A file that cannot be read becomes an error row and the job goes on.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.numbers import get_dims, let
from gridloom.sources.store import pending, read_table, write_batch

SCHEMA = ("kind string, path string, x int, y int, channel int, vals array<double>, shape array<int>, "
          "affine array<array<double>>, res array<double>, message string")

# NIfTI-1 data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


@dataclass(frozen=True)
class Header:
    """What a NIfTI-1 header says of the numbers that follow ``offset`` bytes from the start."""

    shape: tuple[int, ...]
    kind: str
    offset: int
    slope: float
    inter: float
    affine: np.ndarray
    res: np.ndarray

    def scaled(self, data: np.ndarray) -> np.ndarray:
        data = data.astype(float)
        if self.slope not in (0.0, 1.0) or self.inter != 0.0:
            if self.slope == self.slope and self.slope != 0.0:
                data = data * self.slope + self.inter
        return data


#: Bytes of a header.
HEADER_BYTES = 352


def nifti_header(raw: bytes) -> Header:
    """Header of an uncompressed NIfTI-1 file from its first bytes."""
    if len(raw) < 348:
        raise ValueError("not a NIfTI-1 file")
    end = "<" if np.frombuffer(raw[:4], "<i4")[0] == 348 else ">"
    if np.frombuffer(raw[:4], end + "i4")[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    field = lambda at, kind, n: np.frombuffer(raw, end + kind, n, at)
    dim = field(40, "i2", 8)
    shape = tuple(int(v) for v in dim[1:dim[0] + 1])
    code = int(field(70, "i2", 1)[0])
    if code not in NIFTI_TYPES:
        raise ValueError(f"unsupported NIfTI data type {code}")
    pixdim = field(76, "f4", 8).astype(float)
    offset, slope, inter = (float(v) for v in field(108, "f4", 3))
    affine = np.eye(4)
    qform, sform = (int(v) for v in field(252, "i2", 2))
    if sform > 0:
        affine[:3] = field(280, "f4", 12).reshape(3, 4)
    elif qform > 0:
        b, c, d = field(256, "f4", 3).astype(float)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        rot = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        handed = -1.0 if pixdim[0] < 0 else 1.0
        affine[:3, :3] = rot * np.array([pixdim[1], pixdim[2], pixdim[3] * handed])
        affine[:3, 3] = field(268, "f4", 3)
    else:
        zoom = np.array([-pixdim[1], pixdim[2], pixdim[3]])
        full = np.array((list(shape) + [1, 1, 1])[:3])
        affine[:3, :3] = np.diag(zoom)
        affine[:3, 3] = -zoom * (full - 1) / 2
    return Header(shape, end + NIFTI_TYPES[code], int(offset), slope, inter, affine, pixdim[1:4])


def decode_nifti(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(volume, affine, resolution) of an uncompressed NIfTI-1 file held in memory."""
    head = nifti_header(raw)
    data = np.frombuffer(raw, head.kind, int(np.prod(head.shape)), head.offset).reshape(head.shape, order="F")
    return head.scaled(data), head.affine, head.res


def decode(path: str, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if path.endswith(".npz"):
        with np.load(io.BytesIO(raw)) as z:
            return np.asarray(z["vol_data"], dtype=float), np.eye(4), np.ones(3)
    if path.endswith(".nii.gz"):
        return decode_nifti(gzip.decompress(raw))
    if path.endswith(".nii"):
        return decode_nifti(raw)
    raise ValueError(f"unsupported file type: {path}")


def _decode_files(most_failed: int | None = None):
    """Task function: (path, content) to rows of SCHEMA."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for frame in _decoded(frames):
            failed += int((frame["kind"] == "error").sum())
            if most_failed is not None and failed > most_failed:
                raise TooManyFailures(f"more than {most_failed} files of one task could not be read")
            yield frame
    return run


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    blank = {part.split()[0]: None for part in SCHEMA.split(", ")}
    for frame in frames:
        for path, raw in zip(frame["path"], frame["content"]):
            try:
                vol, affine, res = decode(path, raw)
                vol = np.squeeze(vol)
                while vol.ndim < 3:
                    vol = vol[..., np.newaxis]
                if vol.ndim > 4:
                    raise ValueError(f"too many dimensions: {vol.shape}")
                shape = [int(n) for n in vol.shape]
                grid = vol if vol.ndim == 4 else vol[..., np.newaxis]
            except Exception as problem:
                yield pd.DataFrame([{**blank, "kind": "error", "path": path,
                                     "message": f"{type(problem).__name__}: {problem}"}])
                continue
            yield pd.DataFrame([{**blank, "kind": "meta", "path": path, "shape": shape, "affine": affine.tolist(),
                                 "res": [float(r) for r in res]}])
            # One x plane at a time keeps the Arrow batches small.
            for x in range(grid.shape[0]):
                yield pd.DataFrame([{**blank, "kind": "line", "path": path, "x": x, "y": y, "channel": c,
                                     "vals": grid[x, y, :, c]} for y in range(grid.shape[1]) for c in range(grid.shape[3])])


class TooManyFailures(RuntimeError):
    pass


def write_images(files: DataFrame, out: str, batch: str | None = None, most_failed: int | None = None) -> dict[str, int] | None:
    """Decode (path, content) into the table ``images`` of a store; files that could be read are finished then.

    Each file is decoded exactly once, by the write, which also counts the files: returns how many are good, failed and
    skipped (finished before), or None where the batch was committed already. A file that could not be read is
    tried again by the next run. With more than ``most_failed`` failed files the run ends and leaves nothing; a task that
    alone has so many does not go on to its other files.
    """
    spark, batch = files.sparkSession, batch or uuid.uuid4().hex
    given, result = Observation(), Observation()

    def readable() -> DataFrame:
        written = spark.read.schema(f"{SCHEMA}, batch string").parquet(f"{out}/data/images")
        return written.where(F.col("batch") == batch).where("kind = 'meta'").select("path")

    def check() -> None:
        if most_failed is not None and result.get["failed"] > most_failed:
            raise TooManyFailures(f"{result.get['failed']} files could not be read, more than {most_failed}")

    listed = files.observe(given, F.count(F.lit(1)).alias("n"))
    decoded = (pending(spark, out, listed, "path").mapInPandas(_decode_files(most_failed), SCHEMA)
               .observe(result, F.count_if(F.col("kind") == "meta").alias("good"), F.count_if(F.col("kind") == "error").alias("failed")))
    if not write_batch({"images": decoded}, out, batch, readable, key="path", partition_by={"images": ["kind"]}, before_commit=check):
        return None
    counts = {k: int(v) for k, v in result.get.items()}
    return {**counts, "skipped": int(given.get["n"]) - sum(counts.values())}


def read_images(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, meta, errors) of a store of images; errors of files that a later run could read are dropped."""
    table = read_table(spark, out, "images", "path")
    lines = table.where("kind = 'line'").select("path", "x", "y", "channel", "vals")
    meta = table.where("kind = 'meta'").select("path", "shape", "affine", "res")
    dims = get_dims(F.col("shape"))
    meta = meta.withColumns({"n_dims": dims["n_dims"], "n_channels": dims["n_channels"]})
    errors = table.where("kind = 'error'").select("path", "message").distinct()
    return lines, meta, errors.join(meta.select("path"), "path", "left_anti")


def ingest_volumes(spark: SparkSession, folder: str, out: str, batch: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decode the images of a folder that the store ``out`` does not have yet; (lines, meta, errors) of all it has."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{nii.gz,nii,mgz,npz}").load(folder)
             .select("path", "content"))
    write_images(files, out, batch)
    return read_images(spark, out)


def lines_to_voxels(lines: DataFrame, key: str = "path", dtype: str = "double") -> DataFrame:
    """Explode packed lines; integer types are rounded half to even first."""
    rows = lines.select(key, "x", "y", *([c for c in ["channel"] if c in lines.columns]), F.posexplode("vals").alias("z", "value"))
    if dtype != "double":
        rows = rows.withColumn("value", F.bround("value").cast(dtype))
    return rows


def voxels_to_lines(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Pack dense voxel rows into one row per z-line."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("z", F.col(value).alias("v")))), lambda s: s["v"])
    return df.groupBy(*keys, "x", "y").agg(packed.alias("vals"))


def volume_info(df: DataFrame, max_channels: int = 10) -> DataFrame:
    """Shape and dimensions from voxel rows (vol_id, x, y, z): a last axis of at most ``max_channels`` is channels."""
    ends = df.groupBy("vol_id").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "xyz"], F.count("*").alias("n_voxels"))
    ends = ends.withColumn("_d", get_dims(F.array("nx", "ny", "nz"), max_channels))
    return ends.select("vol_id", "nx", "ny", "nz", "n_voxels", F.col("_d.n_dims").alias("n_dims"),
                       F.col("_d.n_channels").alias("n_channels"))


def quarantine(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows by an error message column expression: (good rows, errors(vol_id, message)).

    A volume with any bad row is set aside as a whole and reported once; the other volumes go on.
    """
    bad = (df.withColumn("_e", problem).where("_e IS NOT NULL")
           .groupBy("vol_id").agg(F.min("_e").alias("message")))
    return df.join(bad.select("vol_id"), "vol_id", "left_anti"), bad
