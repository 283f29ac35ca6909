"""Exact top-k inner products over a pivot-distance index.

Vectors are lifted onto a sphere by one more component, so that the largest inner product with a query is the smallest
distance to it. Each vector is keyed by its nearest pivot and its distance to it; equal steps of that distance cut
each pivot's vectors into annuli, and large annuli into blocks of bounded size. A query first visits the annuli that
can be nearest, which bounds the distance of its k-th result; then it visits just those other annuli that the triangle
inequality leaves within that bound. Queries travel in blocks, too: a visit is one row with two small matrices.

The index keeps every vector; only the pivots are a bounded sample. Pivots and annuli are at most PIVOTS * ANNULI rows
per vector length, whatever the input, and the only thing that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.plans.registry import query
from gridloom.session import materialize

K, EVERY, SCALE = 5, 50, 256.0
PIVOTS, ANNULI = 16, 8
#: Vectors in a block of the index, and queries in a block.
BLOCK, QUERIES = 4096, 512
#: Annuli that a query visits before its bound is known.
FIRST = 2
NO_ID = np.iinfo(np.int64).max
#: Stands for no score yet; every score is above it.
NO_SCORE = np.iinfo(np.int64).min


def _quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v) with v the floors of SCALE times the components as 64-bit integers; others take no part."""
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    beyond = F.raise_error(F.lit("a component is too large for 64-bit integers")).cast("long")
    floors = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) * SCALE < 2.0 ** 62, F.floor(x.cast("double") * SCALE)).otherwise(beyond))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), floors.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


class Space:
    """Pivots of one vector length, and distances on the sphere of radius ``radius``."""

    def __init__(self, radius2: float, pivots: np.ndarray):
        self.radius2, self.pivots = radius2, pivots
        self.lift = np.sqrt(np.maximum(radius2 - (pivots ** 2).sum(axis=1), 0))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.radius2 - (x ** 2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * (self.radius2 - x @ self.pivots.T - lift[:, None] * self.lift), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q ** 2).sum(axis=1)[:, None] + self.radius2 - 2 * q @ self.pivots.T, 0))

    def of_scores(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q ** 2).sum(axis=1) + self.radius2 - 2 * scores, 0))

    def slack(self, q: np.ndarray) -> np.ndarray:
        """More than rounding can add to or take from a distance: squares carry errors in proportion to the norms."""
        return 1e-6 + 4 * np.sqrt(64 * np.finfo(float).eps * ((q ** 2).sum(axis=1) + self.radius2))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact inner products of integer rows, as 64-bit integers, or as Python's where those may not hold them."""
        if self.radius2 < 2 ** 52:  # so no sum of products, complete or not, leaves what a double holds
            return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        if self.radius2 < 2 ** 62:
            return q @ x.T
        return q.astype(object) @ x.T.astype(object)


def _spaces(rows: DataFrame) -> dict[int, Space]:
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    radii = {r.dim: r.r for r in rows.groupBy("dim").agg(F.max(norm2).alias("r")).collect()}
    by_hash = Window.partitionBy("dim").orderBy("h", "id", "v")
    sample = (rows.withColumn("h", F.xxhash64("id")).withColumn("k", F.row_number().over(by_hash))
              .where(F.col("k") <= PIVOTS).select("dim", "v").collect())
    return {d: Space(r, np.array([s.v for s in sample if s.dim == d], np.float64)) for d, r in radii.items()}


def _keyed(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """rows with uid, pivot, dist (to the pivot) and the payload as packed integers of the least size that fits all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(3), dim)
                d = spaces[dim].of_vectors(x)
                nearest = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary()),
                     pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(x)), nearest], pa.float64())],
                    ["uid", "id", "dim", "v", "pivot", "dist"])

    return (rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "dim", "v")
            .mapInArrow(run, "uid long, id long, dim int, v binary, pivot int, dist double"))


def _blocks(rows: DataFrame, keys: list[str], size_of: DataFrame | None, most: int) -> DataFrame:
    """One row per block: keys, salt, and lists of uid, id and v. ``size_of``: (keys, n), how many rows share the keys."""
    rows = rows.join(size_of, keys).withColumn("salt", F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / most)))
    items = F.sort_array(F.collect_list(F.struct("uid", "id", "v")))
    return rows.groupBy(*keys, "salt").agg(items.alias("x"))


class Visits:
    """Which annuli a query has to visit. ``annuli``: {dim: [(pivot, ring, least, most, blocks), ...]}."""

    def __init__(self, spaces, annuli):
        self.spaces, self.annuli = spaces, annuli

    def bounds(self, dim: int, q: np.ndarray) -> np.ndarray:
        """Least distance of each query to any vector of each annulus."""
        d = self.spaces[dim].of_queries(q)
        a = np.array([x[:4] for x in self.annuli[dim]])
        d = d[:, a[:, 0].astype(int)]
        return np.maximum(0, np.maximum(d - a[:, 3], a[:, 2] - d))

    def wanted(self, dim: int, q: np.ndarray, need: np.ndarray | None) -> np.ndarray:
        """(queries, annuli) flags: the first ones of each query; with ``need``, the k-th scores, the rest within reach."""
        bounds = self.bounds(dim, q)
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, np.argsort(bounds, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        if need is None:
            return first
        none = need == NO_SCORE
        reach = np.where(none, np.inf, self.spaces[dim].of_scores(q, np.where(none, 0, need).astype(np.float64)))
        return ~first & (bounds <= (reach + self.spaces[dim].slack(q))[:, None])


def _unpack(items: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, id, matrix) of one block, a struct array of uid, id and v."""
    ids = items.field(1).fill_null(NO_ID)
    x = np.frombuffer(b"".join(items.field(2).to_pylist()), "<i8").reshape(len(items), dim)
    return np.asarray(items.field(0)), np.asarray(ids), x


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, ties to the smaller id; NO_SCORE never counts."""
    n = scores.shape[1]
    kth = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), NO_SCORE)
    row, col = np.nonzero((scores >= kth[:, None]) & (scores != NO_SCORE))
    values = scores[row, col]
    if values.dtype == object:  # places in order instead of values, which sorting by several keys can't take
        values = np.searchsorted(np.array(sorted(set(values.tolist())), object), values)
    order = np.lexsort((ids[col], -values, row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _visit(queries: DataFrame, blocks: DataFrame, visits: Visits, found: DataFrame | None) -> DataFrame:
    """(quid, qid, id, score): candidates for the top k from one round of visits."""
    bounded = found is not None

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for dim, pivot, salt, items, need in zip(*(c.to_pylist() if i < 3 else c for i, c in enumerate(batch.columns))):
                _, _, q = _unpack(items.values, dim)
                need = None if not bounded else np.asarray(need.values)
                wanted = visits.wanted(dim, q.astype(np.float64), need)
                for j in np.flatnonzero(wanted.any(axis=0)).tolist():
                    p, ring, _, _, n = visits.annuli[dim][j]
                    rows += [(dim, pivot, salt, p, ring, s, j) for s in range(n)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = ["dim", "qpivot", "qsalt", "pivot", "ring", "salt", "j"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(len(batch)):
                dim, j = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                quid, qid, q = _unpack(batch.column(2)[i].values, dim)
                need = None if not bounded else np.asarray(batch.column(3)[i].values)
                chosen = visits.wanted(dim, q.astype(np.float64), need)[:, j]
                uid, ids, x = _unpack(batch.column(4)[i].values, dim)
                quid, qid, q = quid[chosen], qid[chosen], q[chosen]
                scores = visits.spaces[dim].scores(q, x)
                scores[quid[:, None] == uid[None, :]] = NO_SCORE
                if need is not None:
                    scores[scores < need[chosen][:, None]] = NO_SCORE
                row, col = best(scores, ids, K)
                values = scores[row, col]
                if values.dtype == object and any(abs(v) >= 1 << 63 for v in values):
                    raise ValueError("an inner product does not fit 64 bits")
                for k, found in enumerate((quid[row], qid[row], ids[col], values.astype(np.int64))):
                    out[k].append(found)
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for o in out]
            ids = arrays[2].to_numpy()
            arrays[2] = pa.array(ids, mask=ids == NO_ID)
            yield pa.RecordBatch.from_arrays(arrays, ["quid", "qid", "id", "score"])

    if found is not None:
        kth = found.groupBy("quid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(
            "quid", F.when(F.size("s") >= K, F.element_at("s", K)).otherwise(NO_SCORE).alias("need"))
        flat = queries.select("dim", "pivot", "salt", F.explode("x").alias("y")).join(kth, F.col("y.uid") == F.col("quid"), "left")
        pair = F.sort_array(F.collect_list(F.struct(F.col("y.uid").alias("uid"), F.col("y").alias("y"),
                                                    F.coalesce("need", F.lit(NO_SCORE)).alias("need"))))
        queries = flat.groupBy("dim", "pivot", "salt").agg(pair.alias("p")).select(
            "dim", "pivot", "salt", F.col("p.y").alias("x"), F.col("p.need").alias("need"))
    else:
        queries = queries.select("dim", "pivot", "salt", "x", F.expr("CAST(array() AS array<long>)").alias("need"))
    queries = materialize(queries)
    planned = queries.mapInArrow(plan, ", ".join(f"{n} long" for n in names))
    asked = queries.select(F.col("dim").alias("dim"), F.col("pivot").alias("qpivot"), F.col("salt").alias("qsalt"), F.col("x").alias("q"), "need")
    pairs = planned.join(blocks, ["dim", "pivot", "ring", "salt"]).join(asked, ["dim", "qpivot", "qsalt"])
    return pairs.select("dim", "j", "q", "need", "x").mapInArrow(search, "quid long, qid long, id long, score long")


def _top(candidates: DataFrame) -> DataFrame:
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY) -> DataFrame:
    """(query_id, rank, id, score): the K largest integer inner products of every query with the other rows.

    Queries are the rows whose id is divisible by ``every``. A vector that is null or empty, or holds a null or
    non-finite component, takes no part; vectors are compared with those of their own length. Rows are told apart by
    position, not id: repeated ids are rows of their own, and a null id is no query and the last among ties. Fewer
    candidates than K are all returned; no rows give no rows. Other columns are not read. Scores are exact integers; a
    component beyond 2^62 / SCALE, or a candidate for the result whose score is beyond 64 bits, ends the job with an error.
    """
    spark = vectors.sparkSession
    rows = materialize(_quantised(vectors, id_col, vector_col))
    spaces = _spaces(rows)
    keyed = materialize(_keyed(rows, spaces)) if spaces else None
    if keyed is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    step = keyed.groupBy("dim").agg((F.max("dist") / ANNULI).alias("step"))
    ring = F.when(F.col("step") > 0, F.least(F.floor(F.col("dist") / F.col("step")), F.lit(ANNULI - 1))).otherwise(0).cast("int")
    ringed = materialize(keyed.join(step, "dim").withColumn("ring", ring).drop("step"))
    sizes = materialize(ringed.groupBy("dim", "pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most")))
    annuli: dict[int, list] = {}
    for r in sizes.orderBy("dim", "pivot", "ring").collect():
        annuli.setdefault(r.dim, []).append((r.pivot, r.ring, r.least, r.most, -(-r.n // BLOCK)))
    visits = Visits(spaces, annuli)
    blocks = materialize(_blocks(ringed, ["dim", "pivot", "ring"], sizes.select("dim", "pivot", "ring", "n"), BLOCK))
    asking = ringed.where(F.col("id") % every == 0)
    counted = asking.groupBy("dim", "pivot").agg(F.count("*").alias("n"))
    queries = materialize(_blocks(asking, ["dim", "pivot"], counted, QUERIES))
    first = materialize(_top(_visit(queries, blocks, visits, None)).drop("rank"))
    rest = _visit(queries, blocks, visits, first)
    return _top(first.unionByName(rest)).select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""


@query("op9_pivot_index", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
