"""Vector bin packing of token examples into fixed-length training sequences.

A sequence has three capacities at once: tokens, segments, and loss-bearing tokens. Each task packs its own input
partition, so nothing is shuffled and a lost task repeats exactly; it holds a bounded pool of waiting examples and
fills one sequence at a time with the example whose demand has the largest dot product with what the sequence has left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import release_memory, table
from gridloom.llm.tokens import tokenizer, word_file
from gridloom.plans.registry import query

END_ID = 2
#: Ids in an output batch.
FLUSH_IDS = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the tokens that wait in a task's pool before sequences are filled.

    Segments bind where documents are short. With the default ``loss`` of ``pack_documents`` fewer tokens than all bear a
    loss, so that limit binds only if it is set below ``tokens``, for data whose prompts bear none.
    """

    tokens: int = 4096
    segments: int = 16
    loss: int = 4096
    pool: int = 64 * 4096


@dataclass
class Piece:
    """Ids start..end of an example; ``loss`` is the running count of loss-bearing ids, one longer than ``ids``."""

    key: object
    ids: np.ndarray
    loss: np.ndarray
    start: int
    end: int

    def demand(self) -> tuple[int, int]:
        return self.end - self.start, int(self.loss[self.end] - self.loss[self.start])


class Packer:
    """Fills sequences; ``emit`` receives lists of pieces, one list per sequence."""

    def __init__(self, limits: Limits, emit: Callable[[list[Piece]], None]):
        self.limits, self.emit = limits, emit
        self.pieces: list[Piece] = []
        self.demands = np.zeros((64, 3))
        self.waiting = 0

    def add(self, piece: Piece) -> None:
        """Whole sequences are cut off a long example at once; its rest waits in the pool."""
        while piece.end - piece.start >= self.limits.tokens:
            cut = self._cut(piece, self.limits.tokens, self.limits.loss)
            self._close([Piece(piece.key, piece.ids, piece.loss, piece.start, cut)])
            piece = Piece(piece.key, piece.ids, piece.loss, cut, piece.end)
        if piece.end > piece.start:
            self._wait(piece)
        while self.waiting > self.limits.pool:
            self._fill()

    def finish(self) -> None:
        while self.pieces:
            self._fill()

    def _wait(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == len(self.demands):
            self.demands = np.concatenate([self.demands, np.zeros_like(self.demands)])
        tokens, loss = piece.demand()
        self.demands[n] = tokens, 1, loss
        self.pieces.append(piece)
        self.waiting += tokens

    def _take(self, i: int) -> Piece:
        piece, last = self.pieces[i], self.pieces.pop()
        if last is not piece:
            self.pieces[i] = last
            self.demands[i] = self.demands[len(self.pieces)]
        self.waiting -= piece.end - piece.start
        return piece

    @staticmethod
    def _cut(piece: Piece, tokens: float, loss: float) -> int:
        """Furthest end of a first part within the given room."""
        by_loss = int(np.searchsorted(piece.loss, piece.loss[piece.start] + loss, "right")) - 1
        return int(min(piece.start + tokens, by_loss, piece.end))

    def _fill(self) -> None:
        capacity = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        left, chosen = capacity.copy(), []
        while self.pieces and left[0] > 0 and left[1] > 0:
            demands = self.demands[:len(self.pieces)]
            score = demands @ (left / capacity ** 2)
            fits = (demands <= left).all(axis=1)
            if left[1] == 1 and (demands[:, 0] >= left[0]).any():
                fits &= demands[:, 0] == left[0]  # the last segment should fill the sequence, whole or cut
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, score, -1))))
            else:
                piece = self._take(int(np.argmax(score)))
                cut = self._cut(piece, left[0], left[2])
                if cut > piece.start:
                    self._wait(Piece(piece.key, piece.ids, piece.loss, cut, piece.end))
                    piece = Piece(piece.key, piece.ids, piece.loss, piece.start, cut)
                else:
                    self._wait(piece)
                    break
            tokens, loss = piece.demand()
            left -= (tokens, 1, loss)
            chosen.append(piece)
        self._close(chosen)

    def _close(self, pieces: list[Piece]) -> None:
        """A sequence that is not full is cut into sequences whose lengths are powers of two, which need no padding."""
        total = sum(p.end - p.start for p in pieces)
        while total < self.limits.tokens and total & (total - 1):
            size = 1 << (total.bit_length() - 1)
            head, rest, room = [], [], size
            for p in pieces:
                cut = min(p.end, p.start + room)
                room -= max(0, cut - p.start)
                if cut > p.start:
                    head.append(Piece(p.key, p.ids, p.loss, p.start, cut))
                if cut < p.end:
                    rest.append(Piece(p.key, p.ids, p.loss, max(cut, p.start), p.end))
            self.emit(head)
            pieces, total = rest, total - size
        if pieces:
            self.emit(pieces)


def all_but_first(ids: np.ndarray) -> np.ndarray:
    """Running count of loss-bearing ids of a document: its first id has nothing to be predicted from."""
    return np.maximum(np.arange(-1, len(ids)), 0)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None,
                   end_id: int = END_ID, limits: Limits = Limits(),
                   loss: Callable[[np.ndarray], np.ndarray] = all_but_first) -> DataFrame:
    """Pieces (SCHEMA) of the examples of ``docs``; ``ids`` are little-endian unsigned 32-bit.

    Every id, the closing ``end_id`` included, lies in exactly one piece. Null and blank texts are the end id alone.
    Repeated rows are packed each for itself; null ids stay null; other columns are not read; no rows give no rows.
    ``loss`` turns an example's ids into the running count of its loss-bearing ids (one longer, from 0).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        model = tokenizer(tokenizer_path or word_file())
        first, made = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        held = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal made, held
            offset = 0
            for p in pieces:
                n = p.end - p.start
                rows.append((p.key, p.start, n, p.ids[p.start:p.end].tobytes(), len(p.ids), first + made, offset))
                offset += n
            held += offset
            made += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)
            rows.clear()
            held = 0
            return out

        packer = Packer(limits, emit)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids = np.append(model.encode_bytes(raw), np.uint32(end_id)).astype("<u4")
                packer.add(Piece(key, ids, loss(ids), 0, len(ids)))
                if held > FLUSH_IDS:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


@query("op3_vector_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (pack_documents(table(spark, sf_dir, "documents"))
            .select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))
