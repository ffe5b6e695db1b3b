"""Arrow text columns as flat numpy arrays: words, lines and shingles as 64-bit hashes.

Everything works on whole texts, in chunks of whole documents, so memory follows the longest
document and not the partition. A hash is a sum of table values times powers of an odd number
modulo 2^64, taken from prefix sums, so that the hash of any byte range costs one subtraction.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lut(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


SPACE = _lut(b" \t\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
with np.errstate(over="ignore"):
    _TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = 1 << max(20, int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[str(base)] = have
    return have[:n]


class Ranges:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power(_ODD, len(data)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64))


class Chunk:
    """Some whole documents: their bytes and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row = data, offsets, first_row
        self.n = len(offsets) - 1

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end of every word, and for each document the index of its first word (n + 1)."""
        inside = ~space[self.data]
        edge = np.empty(len(inside), bool)
        if len(inside):
            edge[0] = True
            np.logical_not(inside[:-1], out=edge[1:])
            edge[self.offsets[:-1][self.offsets[:-1] < len(inside)]] = True
        starts = np.flatnonzero(edge & inside)
        last = np.zeros(len(inside), bool)
        if len(inside):
            last[-1] = True
            np.logical_not(inside[1:], out=last[:-1])
            cut = self.offsets[1:] - 1
            last[cut[cut >= 0]] = True
        ends = np.flatnonzero(last & inside) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end of every \n-separated line, and each document's first line (n + 1)."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], cuts + 1]), kind="stable")
        ends = np.sort(np.concatenate([cuts, self.offsets[1:]]), kind="stable")
        per_doc = 1 + np.diff(np.searchsorted(cuts, self.offsets))
        return starts, ends, np.concatenate([[0], np.cumsum(per_doc)])


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """Documents of a string column (null: empty) in chunks of about CHUNK_BYTES."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Chunk(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at)
        at = to


_COMBINE = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and each document's first one (n + 1).

    A document of fewer words, but not none, has one shingle: its whole sequence.
    """
    counts = np.diff(bounds)
    total = len(words)
    flat = np.zeros(total, np.uint64)
    for j in range(k):
        part = words[j:] * _COMBINE[j]
        flat[:len(part)] += part
    flat = mix(flat + np.uint64(k))
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n_out)])
    index = np.arange(first[-1]) - np.repeat(first[:-1], n_out) + np.repeat(bounds[:-1], n_out)
    out = flat[index] if len(index) else np.zeros(0, np.uint64)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[bounds[d]:bounds[d + 1]]
        out[first[d]] = mix((w * _COMBINE[:len(w)]).sum(dtype=np.uint64)[None] + np.uint64(len(w)))[0]
    return out, first


def sorted_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and each document's first one (n + 1)."""
    out = values.copy()
    for a, b in zip(first[:-1], first[1:]):
        if b - a > 1:
            out[a:b].sort()
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(first) - 1))])


def group_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups given by their first index; empty groups give 0."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until the table has no column of that name."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def collect_array(df: DataFrame, index: Column, value: Column, bits: int, dtype) -> np.ndarray:
    """An array of 2^bits numbers from rows of distinct indices; zero where there is none.

    Executors pack 4096 neighbours into one value, so the driver gets the array's own bytes and
    not as many rows.
    """
    low = min(bits, 12)
    packed = df.groupBy(F.shiftright(index, low).cast("int").alias("block")).agg(
        F.collect_list(F.struct((index.cast("bigint") % (1 << low)).cast("int").alias("at"), value.cast("bigint").alias("v"))).alias("cells"))

    def run(batch):
        out = []
        for cells in batch.column("cells"):
            own = np.zeros(1 << low, dtype)
            flat = cells.values
            own[flat.field("at").to_numpy()] = flat.field("v").to_numpy().astype(dtype)
            out.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "cells"])
    result = np.zeros((1 << (bits - low), 1 << low), dtype)
    for row in map_arrow(packed, run, "block int, cells binary").collect():
        result[row["block"]] = np.frombuffer(row["cells"], dtype)
    return result.reshape(-1)


#: Bits of the filters that tell tasks which hashes are wanted.
FILTER_BITS = 26


def bit_table(wanted: DataFrame, column: str) -> np.ndarray:
    """2^FILTER_BITS bits, of which those at the upper bits of a wanted hash (a bigint column) are set."""
    spot = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    mask = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({column}, {64 - FILTER_BITS}), 64) as int))")
    words = wanted.groupBy(F.floor(spot / 64).cast("int").alias("at")).agg(F.bit_or(mask).alias("mask"))
    return collect_array(words, F.col("at"), F.col("mask"), FILTER_BITS - 6, np.int64).view(np.uint64)


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for each hash whose bit is set."""
    spot = hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def released(run: Callable) -> Callable:
    """The same task body; when it ends, what its arrays held goes back to the machine.

    Python workers are reused: without this an idle one keeps the most that any of its tasks ever held,
    beside the executor's own memory.
    """
    def body(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)
    return body


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over single batches."""
    def run(batches):
        for batch in batches:
            yield from fn(batch)
    return df.mapInArrow(released(run), schema)
