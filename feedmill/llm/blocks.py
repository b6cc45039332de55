"""Numpy helpers for texts inside Arrow tasks: blocks of bounded size and rolling hashes of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_BYTES = 512 << 10

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> pa.Array:
    """The values of a string or binary column as valid UTF-8; null is empty, and bytes that are none are replaced."""
    raw = column.cast(pa.binary()).fill_null(b"")
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in raw.to_pylist()], pa.string())


def byte_sizes(column: pa.Array) -> list[int]:
    """Lengths of the values in bytes, without copying them; null is empty."""
    return pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_pylist()


def in_slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of one column, so that few values are copied at a time."""
    for batch in batches:
        for part in blocks(byte_sizes(batch.column(batch.schema.get_field_index(name))), limit):
            yield batch.slice(part.start, part.stop - part.start)


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Stretches of consecutive items of about ``limit`` bytes; an item is never cut."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any bits of them can serve as a bucket."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """64-bit names of byte ranges: equal ranges have equal names wherever they lie.

    A polynomial in an odd base modulo 2**64 over random byte values; prefix sums give any range in
    constant time.  The power tables grow to the longest buffer seen.
    """

    def __init__(self) -> None:
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = 1 << int(n).bit_length()
            inverse = pow(int(MULTIPLIER), -1, 1 << 64)
            for name, base in (("power", MULTIPLIER), ("inverse", np.uint64(inverse))):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table))

    def load(self, data: np.ndarray) -> None:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * self.power[: len(data)], out=sums[1:])
        self.sums = sums

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges ``flat[start:start + length]`` one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


def packed_chunks(df: DataFrame, text: str, limit: int) -> DataFrame:
    """(chunk, blob): the rows in chunks of about ``limit`` bytes of text, as compressed Arrow streams.

    Chunks are the stretches in which tasks read the rows, so making them moves nothing.  Their numbers are the
    same if a lost task reads its rows again, as it does from files.
    """

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            sizes = byte_sizes(batch.column(batch.schema.get_field_index(text)))
            for own in blocks(sizes, limit):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(batch.slice(own.start, own.stop - own.start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "blob"]
                )
                number += 1

    return df.mapInArrow(pack, "chunk long, blob binary")


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()
