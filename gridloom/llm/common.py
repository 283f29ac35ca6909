"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: space and 9 to 13. They never occur inside a longer UTF-8 sequence.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
WORD = re.compile("[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BREAK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text whose words are held as Python objects at once.
BLOCK_BYTES = 1 << 20


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, so that a very long text is never held as objects."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + BLOCK_BYTES) if at + BLOCK_BYTES < len(text) else None
        end = found.start() if found else len(text)
        yield (text[at:end] if at or found else text).split()
        at = end


def kept_by_process(name: str, make: Callable):
    """What ``make`` gives, made once per worker process: task functions travel by value and share no module globals."""
    store = vars(sys.modules.setdefault("_kept_by_process", types.ModuleType("_kept_by_process")))
    if name not in store:
        store[name] = make()
    return store[name]


def release_memory() -> None:
    """Give freed memory back to the machine, for worker processes that live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; null reads as empty."""
    col = column.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Polynomial hashes modulo 2^64 of any slice of a sequence, from one prefix sum.

    Powers and inverse powers of an odd base are kept up to the longest sequence seen.
    """

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.byte_codes = mix64(np.arange(1, 257, dtype=np.uint64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            for name, factor in (("powers", self.BASE), ("inverses", self.INVERSE)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def slices(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per slice [start, end) of ``codes`` (uint64)."""
        self._grow(len(codes) + 1)
        prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.powers[:len(codes)], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * self.inverses[starts])

    def windows(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all windows of n elements."""
        starts = np.arange(max(0, len(codes) - n + 1))
        return self.slices(codes, starts, starts + n)


_IS_SPACE = np.isin(np.arange(256), list(SPACES))


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) byte positions of the words of a text given as bytes."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[text]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
