"""Vector compression to product codes, with an exact nearest-entry search by slices and bitmasks.

Each part's codebook keeps, for every dimension, its entries' coordinates in order and the masks (of unsigned 64-bit
words) of the first 0, 1, 2, ... entries in that order. A part of a vector gets an initial radius from a few entries with
a similar component sum; in each dimension two binary searches cut the slice of entries within the radius, whose mask is the difference
of two prefix masks. The AND of all dimensions' masks holds every entry that can be nearest; those are compared exactly.

All arithmetic is on integers: 64-bit ones where no squared distance can leave them, else Python's. A round is one
aggregation of one row per (part, entry, dimension) and task; codebooks are the only thing that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.order import beside
from gridloom.llm.common import table
from gridloom.plans.registry import query
from gridloom.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries tried for the initial radius, rows compared at a time, and rows of a label that meet its total together.
PROBES, CHUNK, SALTS = 8, 128, 32
#: Sums travel in pieces of so many bits, so that adding them over any number of tasks stays within 64.
LIMB = 40
LONG = 1 << 63


def _integers(x: np.ndarray, scale: int, dim: int) -> np.ndarray:
    """Floors of scale * x as 64-bit integers where squared distances fit those, else as Python's."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if y.size == 0 or np.abs(y).max() <= safe_size(dim):
        return y.astype(np.int64)
    # From 2^53 on a double is an integer, and so is its multiple.
    return np.array([[int(np.floor(c * scale)) if abs(c) < 2.0 ** 53 else int(c) * scale for c in row] for row in x.tolist()], object)


def safe_size(dim: int) -> int:
    """Largest component whose squared distances over ``dim`` components stay within 62 bits."""
    return isqrt((1 << 60) // max(1, dim))


class Book:
    """Codebook of one part: ``entries`` is (number, dimensions), of 64-bit or Python integers."""

    def __init__(self, entries: np.ndarray):
        n, dim = entries.shape
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        words = -(-n // 64)
        bits = np.zeros((n, words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.prefix = np.zeros((dim, n + 1, words), np.uint64)
        for j in range(dim):
            self.prefix[j, 1:] = np.bitwise_or.accumulate(bits[order[:, j]], axis=0)
        sums = entries.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        d = x - self.entries.take(which, axis=0)
        return (d * d).sum(axis=-1) if d.dtype == object else np.einsum("...i,...i->...", d, d)

    def _radius2(self, x: np.ndarray) -> np.ndarray:
        """Least squared distance to a few entries whose component sums are next to that of x."""
        probes = min(PROBES, len(self.entries))
        at = np.searchsorted(self.sums, x.sum(axis=1)) - probes // 2
        near = self.by_sum[np.clip(at, 0, len(self.entries) - probes)[:, None] + np.arange(probes)]
        return self.distances(x[:, None, :], near).min(axis=1)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """(rows, words): the entries that no dimension shows to be beyond the radius."""
        r2 = self._radius2(x)
        if x.dtype == object:
            r = np.array([isqrt(v) for v in r2], object)
        else:
            r = np.sqrt(r2.astype(np.float64)).astype(np.int64) + 1  # never too small; one too large does no harm
        out = np.full((len(x), self.prefix.shape[2]), ~np.uint64(0))
        for j, (coordinates, masks) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(coordinates, x[:, j] - r, "left")
            high = np.searchsorted(coordinates, x[:, j] + r, "right")
            out &= masks[high] ^ masks[low]
        if not len(self.prefix):
            out[:] = np.bitwise_or.reduce(np.uint64(1) << np.arange(min(64, len(self.entries)), dtype=np.uint64))
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the first of equals, and the squared distance."""
        if x.dtype != self.entries.dtype:
            x = x.astype(object)
            if self.entries.dtype != object:
                return Book(self.entries.astype(object)).nearest(x)
        index, least = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
        for a in range(0, len(x), CHUNK):
            part = x[a:a + CHUNK]
            masks = np.ascontiguousarray(self.candidates(part).astype("<u8"))
            rows, cols = np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little"))
            d = self.distances(part.take(rows, axis=0), cols)
            starts = np.searchsorted(rows, np.arange(len(part)))
            best = np.minimum.reduceat(d, starts)
            first = np.flatnonzero(d == best[rows])  # per row in order of entries
            first = first[np.searchsorted(rows[first], np.arange(len(part)))]
            index[a:a + CHUNK], least[a:a + CHUNK] = cols[first], best
        return index, least


class Codebooks:
    """One codebook per part; ``entries`` are lists of integers by part and entry. Vectors are ``dim`` long."""

    def __init__(self, entries: list[list[list[int]]], scale: int = SCALE):
        self.entries, self.scale, self.parts = entries, scale, len(entries)
        self.width = len(entries[0][0])
        self.dim = self.parts * self.width
        most = max((abs(c) for part in entries for e in part for c in e), default=0)
        kind = np.int64 if most <= safe_size(self.width) else object
        self.books = [Book(np.array(part, kind).reshape(len(part), self.width)) for part in entries]

    def parts_of(self, column: pa.Array) -> list[np.ndarray]:
        """The integer parts of a batch of vectors; what a shorter vector lacks reads as 0."""
        sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
        flat = np.asarray(column.flatten().cast(pa.float64()))
        if (sizes == self.dim).all():
            x = flat.reshape(len(column), self.dim)
        else:
            x = np.zeros((len(column), self.dim))
            x[np.arange(self.dim) < sizes[:, None]] = flat
        x = _integers(x, self.scale, self.width)
        return [x[:, p * self.width:(p + 1) * self.width] for p in range(self.parts)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.entries for e in part for c in e).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the vectors that hold neither nulls nor non-finite components."""
    v = F.col(vector_col)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, position, limb, value): sums of the parts nearest to each entry; their number at position -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((books.parts, len(books.entries[0]), books.width), np.int64)
        large: dict[tuple, int] = {}  # what may not fit 64 bits, by (part, entry, position)
        counts = np.zeros(sums.shape[:2], np.int64)
        for batch in batches:
            for p, x in enumerate(books.parts_of(batch.column(0))):
                nearest, _ = books.books[p].nearest(x)
                counts[p] += np.bincount(nearest, minlength=counts.shape[1])
                if x.dtype != object:
                    np.add.at(sums[p], nearest, x)
                    continue
                for e, row in zip(nearest.tolist(), x.tolist()):
                    for j, c in enumerate(row):
                        large[p, e, j] = large.get((p, e, j), 0) + c
        out = [(p, e, -1, 0, n) for (p, e), n in np.ndenumerate(counts) if n]
        for p, e in zip(*np.nonzero(counts)):
            for j in range(books.width):
                total = int(sums[p, e, j]) + large.get((p, e, j), 0)
                sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
                while rest:
                    out.append((p, e, j, limb, sign * (rest & ((1 << LIMB) - 1))))
                    rest, limb = rest >> LIMB, limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["part", "entry", "position", "limb", "value"])

    return (rows.select("v").mapInArrow(run, "part long, entry long, position long, limb long, value long")
            .groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")))


def fit_codebooks(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``rows`` (id, v) after the given rounds; None without rows.

    They start as the parts of the vectors with the smallest ids (nulls last, equal ids by vector); fewer rows make
    fewer entries. Vectors are as long as the longest, filled up with zeros to a multiple of ``parts``.
    """
    longest = rows.agg(F.max(F.size("v")).alias("n")).first().n
    if longest is None:
        return None
    first = rows.select("v", "id").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    width = -(-longest // parts)
    start = np.zeros((len(first), parts * width))
    for i, r in enumerate(first):
        start[i, :len(r.v)] = r.v
    ints = _integers(start, scale, max(1, width)).tolist()
    books = Codebooks([[row[p * width:(p + 1) * width] for row in ints] for p in range(parts)], scale)
    for _ in range(rounds):
        found: dict[tuple, int] = {}
        for r in _sums(rows, books).collect():  # a row per (part, entry, position), however many vectors there are
            key = (r.part, r.entry, r.position)
            found[key] = found.get(key, 0) + (r.value << (LIMB * r.limb))
        books = Codebooks([[[found.get((p, e, j), 0) // found[p, e, -1] for j in range(width)] if (p, e, -1) in found else old
                            for e, old in enumerate(part)] for p, part in enumerate(books.entries)], scale)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): two hexadecimal digits of each part's nearest entry, and the squared distances' sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [book.nearest(x) for book, x in zip(books.books, books.parts_of(batch.column(2)))]
            error = [sum(map(int, d)) for d in zip(*(d for _, d in found))]
            if any(e >= LONG for e in error):
                raise ValueError("a squared distance does not fit 64 bits")
            code = ["".join(f"{i:02x}" for i in c) for c in zip(*(i.tolist() for i, _ in found))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                             ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, label_error) of every whole vector, and the codebooks that decode them.

    Vectors that are null or hold null or non-finite components are left out; shorter ones than the longest read as if
    zeros followed, the empty one included. Repeated rows are coded each for itself; null ids and labels stay, null
    labels count together; other columns are not read. No rows give no rows and no codebooks. Components may have any
    size; an error or a label's total beyond 64 bits is an error of the job, never a wrong number.
    """
    if entries > 256:
        raise ValueError("codes have two hexadecimal digits a part")
    rows = kept_vectors(vectors, id_col, vector_col, label_col)
    books = fit_codebooks(rows, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if books is None:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error")), None
    coded = materialize(encode(rows, books)).withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    totals = (coded.groupBy("label").agg(F.sum("error").alias("label_error"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
    return beside(coded, totals, ["label", "salt"]).drop("salt"), books


def _sql() -> str:
    text = """WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM kept, range(4) AS t(p)),
c0 AS MATERIALIZED (SELECT p, e, x AS y FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256) USING (vec_id)),"""
    for r in range(5):
        text += f"""
d{r} AS MATERIALIZED (SELECT vec_id, label, p, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS d FROM parts JOIN c{r} USING (p)),
a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, e, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),"""
        if r < 4:
            text += f"""
s{r} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS m FROM (
  SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{r}.y, c{r}.y) AS y FROM c{r} LEFT JOIN s{r} USING (p, e)),"""
    return text + """
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(y) AS c, generate_subscripts(y, 1) AS i FROM c4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books"""


@query("op12_slice_masks", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(books.digest() if books else "").alias("codebooks_sha256"))
