"""What the operators of this package share: written intermediates, Arrow helpers, hashing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.store import keep  # noqa: F401 - the operators take it from here

#: Bytes of text that a Python task turns into numpy arrays at once.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_long(name: str) -> Column:
    return F.col(name).cast("long")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def payloads(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about so many text bytes; one long row stays whole.

    The runs are copies: string kernels of pyarrow read the wrong bytes of slices that start within a buffer.
    """
    sizes = pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.take(pa.array(np.arange(start, i)))
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.take(pa.array(np.arange(start, batch.num_rows))) if start else batch


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives memory that is free back to the system when it ends: a worker without a task stays for a
    minute, beside the next stages."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return whole


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A seeded bijection of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Places:
    """Places of distinct 64-bit keys in the array they came from; an open-addressing table in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys) - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.at[slot[left]] < 0]
            self.at[slot[free]] = free
            left = left[self.at[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        used = self.at >= 0
        self.keys[used] = keys[self.at[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.at[slot]
        todo = np.nonzero((out >= 0) & (self.keys[slot] != keys))[0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.at[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out
