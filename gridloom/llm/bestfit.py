"""Best-fit packing with a matching of large items: documents into as few sequences of bounded length as possible.

Only documents longer than a sequence are cut. What decides is how many pieces there are of each length, a table of at
most ``capacity`` rows at any input size: pieces above a third of the capacity are matched greedily, two to a sequence
at most, the longest with the longest that fits; shorter ones go, longest first, where they leave the least room. That
gives a plan of whole groups of equal sequences. Each piece then finds its place by its rank among the pieces of its
length, a count per task plus the counts of the tasks before; no length is ever gathered, however frequent it is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm.common import release_memory, table
from gridloom.llm.tokens import byte_file, tokenizer
from gridloom.plans.registry import query
from gridloom.session import materialize

CAPACITY, END_ID = 2048, 0
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, slice int, nth long"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Bytes of ids in an output batch.
FLUSH_BYTES = 4 << 20


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, of which only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


class Ranks:
    """Which of its length each piece of a task is, counted as they come."""

    def __init__(self, capacity: int):
        self.seen = np.zeros(capacity + 1, np.int64)

    def take(self, n: np.ndarray) -> np.ndarray:
        order = np.argsort(n, kind="stable")
        starts = np.r_[0, np.flatnonzero(np.diff(n[order])) + 1]
        nth = np.empty(len(n), np.int64)
        nth[order] = np.arange(len(n)) - np.repeat(starts, np.diff(np.r_[starts, len(n)]))
        nth += self.seen[n]
        self.seen += np.bincount(n, minlength=len(self.seen))
        return nth


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None,
                 end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (SCHEMA) of the documents' ids, each document closed by ``end_id``; ids are little-endian unsigned 32-bit.

    Null and empty texts are the end id alone. Repeated rows are cut each for itself, null ids stay null, other columns
    are not read, and no rows give no rows. ``slice`` and ``nth``, the task and the piece's rank among the task's pieces of
    its length, are for ``pack``; they hold for one evaluation.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ranks, task = tokenizer(tokenizer_path or byte_file()), Ranks(capacity), TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
            rows.clear()
            nth = ranks.take(arrays[3].to_numpy())
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(nth), task, np.int32)), pa.array(nth)], _NAMES)

        for batch in batches:
            for i in range(batch.num_rows):
                key, text = batch.column(0)[i].as_py(), batch.column(1)[i]
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids = np.append(model.encode_bytes(raw), np.uint32(end_id)).astype("<u4")
                rows += [(key, k, at, n, ids[at:at + n].tobytes()) for k, (at, n) in enumerate(cuts(len(ids), capacity))]
                held += ids.nbytes
                if held >= FLUSH_BYTES:
                    yield flush()
                    held = 0
        if rows:
            yield flush()
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


class Plan:
    """Places of all pieces, from how many there are of each length.

    ``groups`` holds [sequences, [(length, copies in each sequence), ...]] of sequences filled alike. Their number does
    not depend on the number of pieces: every step either uses up a length or moves a whole group.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c > 0}
        self.open: dict[int, list[list]] = defaultdict(list)  # by room left
        lengths = sorted(self.left, reverse=True)
        for n in (n for n in lengths if 3 * n > capacity):
            self._match(n)
        for n in (n for n in lengths if 3 * n <= capacity):
            self._fill(n)
        self.groups = [g for room in sorted(self.open) for g in self.open[room]]

    def _add(self, count: int, held: list[tuple[int, int]]) -> None:
        if count:
            self.open[self.capacity - sum(n * k for n, k in held)].append([count, held])

    def _match(self, n: int) -> None:
        """Sequences with a large piece of n, beside the longest other large one that fits."""
        while self.left[n]:
            other = next((p for p in range(min(n, self.capacity - n), self.capacity // 3, -1) if self.left.get(p)), None)
            if other == n and self.left[n] > 1:
                pairs = self.left[n] // 2
                self._add(pairs, [(n, 2)])
                self.left[n] -= 2 * pairs
            elif other is not None and other != n:
                pairs = min(self.left[n], self.left[other])
                self._add(pairs, [(n, 1), (other, 1)])
                self.left[n] -= pairs
                self.left[other] -= pairs
            else:
                below = next((p for p in range(min(n - 1, self.capacity - n), self.capacity // 3, -1) if self.left.get(p)), None)
                if below is not None:  # the last of its length has no equal left
                    self._add(1, [(n, 1), (below, 1)])
                    self.left[n] -= 1
                    self.left[below] -= 1
                else:
                    self._add(self.left[n], [(n, 1)])
                    self.left[n] = 0

    def _fill(self, n: int) -> None:
        """Each piece of n goes where it leaves the least room; as many as fit follow it there."""
        while self.left[n]:
            room = next((r for r in range(n, self.capacity) if self.open.get(r)), self.capacity)
            count, held = self.open[room].pop() if room < self.capacity else [max(1, self.left[n] // (self.capacity // n)), []]
            copies = min(room // n, self.left[n])
            full = min(count, self.left[n] // copies)
            self._add(count - full, held)
            self._add(full, [*held, (n, copies)])
            self.left[n] -= full * copies

    def places(self) -> pd.DataFrame:
        """length, first (rank), copies, sequence, offset: a piece whose rank is first + i is in sequence + i // copies."""
        rows, ranks, sequence = [], defaultdict(int), 0
        for count, held in self.groups:
            offset = 0
            for n, copies in held:
                rows.append((n, ranks[n], copies, sequence, offset))
                ranks[n] += count * copies
                offset += n * copies
            sequence += count
        return pd.DataFrame(rows, columns=["length", "first", "copies", "sequence", "offset"]).sort_values(["length", "first"])


def _numbered(pieces: DataFrame, length_col: str, capacity: int) -> DataFrame:
    """(row, length, slice, nth): the pieces, and which of its length each is among those of its task."""
    given = pieces.select(F.struct("*").alias("row"), F.col(length_col).cast("long").alias("length"),
                          F.spark_partition_id().alias("slice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(capacity)
        for batch in batches:
            if batch.num_rows:
                n = batch.column(1).to_numpy(zero_copy_only=False)
                if not ((n >= 1) & (n <= capacity)).all():
                    raise ValueError(f"lengths must be 1 to {capacity}")
                nth = ranks.take(n.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], [*batch.schema.names, "nth"])

    return given.mapInArrow(run, StructType([*given.schema.fields, StructField("nth", LongType())]))


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, ranked: bool = False) -> DataFrame:
    """The rows of ``pieces`` with sequence_id (from 0 on) and offset, gapless from 0; lengths of a sequence sum to ``capacity`` at most.

    Columns of those names are replaced, all others kept, whatever their names. Lengths must lie in 1..capacity, else
    ValueError; rows of equal length are interchangeable, so repeated rows lie each in a place of its own. No rows give
    no rows. The pieces are written once, so that ranks hold when executors are lost. ``ranked``: they come straight from
    ``token_pieces``, with its columns slice and nth, which are dropped.
    """
    dropped = ("sequence_id", "offset", *(("slice", "nth") if ranked else ()))
    kept = [c for c in pieces.columns if c not in dropped]
    if ranked:
        numbered = pieces.select(F.struct(*kept).alias("row"), F.col(length_col).alias("length"), "slice", "nth")
    else:
        numbered = _numbered(pieces, length_col, capacity)
    numbered = materialize(numbered)
    per_slice = numbered.groupBy("slice", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Plan(counts, capacity).places()
    length, first, copies, sequence, offset = (places[c].to_numpy(np.int64) for c in places.columns)
    low = np.searchsorted(length, np.arange(capacity + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(n), np.int64)
        for size in np.unique(n):
            own = n == size
            at[own] = low[size] + np.searchsorted(first[low[size]:low[size + 1]], rank[own], "right") - 1
        step = rank - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + step // copies[at], "offset": offset[at] + step % copies[at] * n})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_slice.select("slice", "length", F.coalesce(before, F.lit(0)).alias("before"))
    return (numbered.join(bases, ["slice", "length"])
            .withColumn("place", place("length", F.col("before") + F.col("nth")))
            .select(*[F.col("row")[c].alias(c) for c in kept], "place.sequence_id", "place.offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None,
                   end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Training sequences with their ids: the pieces of ``token_pieces`` and where each lies."""
    pieces = token_pieces(docs, id_col, text_col, tokenizer_path=tokenizer_path, end_id=end_id, capacity=capacity)
    return pack(pieces, "length", capacity, ranked=True)


@query("op13_best_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "slice", "nth"), ranked=True)
