"""Image files as a data source that reads ranges of planes.

An uncompressed NIfTI-1 file holds its x lines in order of y, then z, then channel. Such a file is cut into as many parts as
its size asks for; each task reads the header and its own planes, one at a time. Compressed and npz files can only be read
from the start and are one part each. Headers alone are a few bytes per file. Folders may lie wherever pyarrow's file
systems reach; ``ingest`` reads through Spark's own file source instead.
"""

from __future__ import annotations

import gzip
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.functions.numbers import get_dims
from gridloom.sources.ingest import HEADER_BYTES, decode, nifti_header

NAME = "volume_planes"
PLANES = "path string, y int, z int, channel int, vals array<double>, message string"
HEADERS = "path string, shape array<int>, affine array<array<double>>, res array<double>, message string"
SUFFIXES = (".nii.gz", ".nii", ".mgz", ".npz")
#: Bytes of a part of a file, and files whose headers are one task.
SPLIT_BYTES, HEADER_FILES = 64 << 20, 64


def _kept(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Shape without axes of length 1, filled up to three axes."""
    kept = tuple(n for n in shape if n != 1)
    if len(kept) > 4:
        raise ValueError(f"too many dimensions: {shape}")
    return (*kept, *(1,) * (3 - len(kept)))


@dataclass
class Part(InputPartition):
    """Part ``index`` of ``count`` of each of the files."""

    paths: list[str]
    index: int = 0
    count: int = 1


def _open(path: str):
    from pyarrow import fs
    system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(place)


def list_files(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the image files below a folder."""
    from pyarrow import fs
    system, place = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    scheme = f"{folder.split('://')[0]}://" if "://" in folder else "file://"
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted((f"{scheme}{f.path}", f.size) for f in found if f.is_file and f.path.endswith(SUFFIXES))


def read_header(path: str) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """(shape, affine, resolution) from the first bytes of a file."""
    with _open(path) as f:
        if path.endswith(".npz"):
            with zipfile.ZipFile(f) as z, z.open("vol_data.npy") as array:
                version = np.lib.format.read_magic(array)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                return read(array)[0], np.eye(4), np.ones(3)
        if path.endswith(".nii.gz"):
            head = nifti_header(gzip.GzipFile(fileobj=f).read(HEADER_BYTES))
        elif path.endswith(".nii"):
            head = nifti_header(f.read(HEADER_BYTES))
        else:
            raise ValueError(f"unsupported file type: {path}")
    return head.shape, head.affine, head.res


def _planes(path: str, index: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, values as (y, x)) of the planes of one part of a file."""
    with _open(path) as f:
        if not path.endswith(".nii"):
            vol = np.squeeze(decode(path, f.read())[0])
            vol = vol.reshape(_kept(vol.shape))
            flat = vol.reshape(*vol.shape[:2], -1, order="F")
            yield from ((p, flat[:, :, p].T) for p in range(flat.shape[2]))
            return
        head = nifti_header(f.read(HEADER_BYTES))
        nx, ny, *rest = _kept(head.shape)
        n, width = int(np.prod(rest)), np.dtype(head.kind).itemsize * nx * ny
        for p in range(n * index // count, n * (index + 1) // count):
            raw = f.read_at(width, head.offset + p * width)
            yield p, head.scaled(np.frombuffer(raw, head.kind, nx * ny)).reshape(ny, nx)


class PlaneReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.headers = str(options.get("headers", "false")).lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Part]:
        files = list_files(self.folder)
        if self.headers:
            return [Part([p for p, _ in files[a:a + HEADER_FILES]]) for a in range(0, len(files), HEADER_FILES)]
        parts = []
        for path, size in files:
            count = -(-size // self.split) if path.endswith(".nii") else 1
            parts += [Part([path], i, max(1, count)) for i in range(max(1, count))]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        return self._headers(partition) if self.headers else self._rows(partition)

    def _headers(self, part: Part) -> Iterator[tuple]:
        for path in part.paths:
            try:
                shape, affine, res = read_header(path)
                yield path, [int(n) for n in _kept(shape)], affine.tolist(), [float(r) for r in res], None
            except Exception as problem:
                yield path, None, None, None, f"{type(problem).__name__}: {problem}"

    def _rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        path = part.paths[0]
        names = [c.split()[0] for c in PLANES.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()]
        try:
            nz = _kept(read_header(path)[0])[2]
            for p, plane in _planes(path, part.index, part.count):
                ny, nx = plane.shape
                vals = pa.ListArray.from_arrays(pa.array(np.arange(ny + 1, dtype=np.int32) * nx), pa.array(np.ascontiguousarray(plane).ravel()))
                columns = [pa.array([path] * ny), pa.array(np.arange(ny, dtype=np.int32)), pa.array(np.full(ny, p % nz, np.int32)),
                           pa.array(np.full(ny, p // nz, np.int32)), vals, pa.nulls(ny, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)
        except Exception as problem:
            if part.index == 0:
                error = [[path], [None], [None], [None], [None], [f"{type(problem).__name__}: {problem}"]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(error, kinds)], names)


class PlaneSource(DataSource):
    """``spark.read.format("volume_planes").load(folder)``; options headers and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return HEADERS if str(self.options.get("headers", "false")).lower() == "true" else PLANES

    def reader(self, schema) -> PlaneReader:
        return PlaneReader(dict(self.options))


def read_planes(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): x lines (path, y, z, channel, vals) of all images of a folder, and (path, message) of unreadable ones."""
    spark.dataSource.register(PlaneSource)
    table = spark.read.format(NAME).option("splitBytes", split_bytes).load(folder)
    return table.where("message IS NULL").drop("message"), table.where("message IS NOT NULL").select("path", "message")


def read_headers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(meta, errors): shape, affine, resolution, n_dims and n_channels of all images of a folder; no voxel is read."""
    spark.dataSource.register(PlaneSource)
    table = spark.read.format(NAME).option("headers", "true").load(folder)
    meta = table.where("message IS NULL").drop("message")
    dims = get_dims(F.col("shape"))
    return (meta.withColumns({"n_dims": dims["n_dims"], "n_channels": dims["n_channels"]}),
            table.where("message IS NOT NULL").select("path", "message"))


def planes_to_voxels(rows: DataFrame, key: str = "path") -> DataFrame:
    """(path, x, y, z, channel, value) from x lines."""
    return rows.select(key, "y", "z", "channel", F.posexplode("vals").alias("x", "value")).select(key, "x", "y", "z", "channel", "value")
