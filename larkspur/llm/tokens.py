"""Hashed words of Arrow text columns, a bounded block of texts at a time.

All hashes are 64-bit and the same on every machine and run. A word's hash is a polynomial over its
bytes; a sequence's hash is a polynomial over its words' hashes, so that prefix sums give the hash of any
range of words at once.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that are hashed at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes that an Arrow batch of texts has at most, about: Spark, the worker and what is made of the batch each hold it once or more.
BATCH_BYTES = 4 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that powers have inverses modulo 2**64
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES at most, or fewer if it asks for fewer; a longer row makes a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()  # such as 64m or 4194304b
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if now > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def set_aside(docs: DataFrame, names: Collection[str]) -> tuple[DataFrame, list[Column]]:
    """docs with columns of these names (in any case) under others, and the columns that give them back."""
    kept = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(kept), [F.col(f"`{kept.get(c, c)}`").alias(c) for c in docs.columns]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if base not in known or len(known[base]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        known[base] = np.multiply.accumulate(factors)
    return known[base][:n]


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Block:
    """Texts rows[0] to rows[1] of a batch. Words of text i: bounds[i] to bounds[i + 1]; starts and sizes in bytes of data."""

    rows: tuple[int, int]
    data: np.ndarray
    offsets: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, lower: bool = True, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, hashed, about size bytes at a time; A-Z count as a-z if lower."""
    if not len(column):
        return
    data, offsets = texts(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield _block((at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def _block(rows: tuple[int, int], data: np.ndarray, offsets: np.ndarray, lower: bool) -> Block:
    inside = ~_SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    letters = data[inside]
    if lower:
        letters = _LOWER[letters]
    begins = np.flatnonzero(first[inside])
    sizes = np.diff(np.append(begins, len(letters)))
    if len(starts):
        place = np.arange(len(letters)) - np.repeat(begins, sizes)
        values = _BYTE_CODES[letters] * _powers(_BASE, int(sizes.max()))[place]
        words = mix(np.add.reduceat(values, begins) + sizes.astype(np.uint64))
    else:
        words = np.zeros(0, np.uint64)
    return Block(rows, data, offsets, words, starts, sizes, np.searchsorted(starts, offsets))


def prefix_sums(words: np.ndarray) -> np.ndarray:
    """sums such that spans() gives the hash of any range of words."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_STEP, len(words)), out=out[1:])
    return out


def spans(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of words begin to end, the same wherever they stand."""
    return (sums[end] - sums[begin]) * _powers(_STEP_INVERSE, len(sums))[begin]


def step_power(n: np.ndarray) -> np.ndarray:
    """The factor of a part that follows n words."""
    return _powers(_STEP, int(n.max(initial=0)) + 1)[n]


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow list column of the given sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
