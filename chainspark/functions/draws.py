"""Pseudo-random draws that depend only on ids: no state, no partitioning, no row order."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a draw, and its range: 60 bits reach every rank of any table and make the bias of
#: a remainder negligible.
DIGITS = 15
SPAN = 16 ** DIGITS


def draw(*parts) -> Column:
    """60-bit integer draw of the colon-joined parts (columns or literals)."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                              for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """The same draw as a double in (0, 1)."""
    return (draw(*parts) + F.lit(0.5)) / F.lit(float(SPAN))


def chunk_of(u: Column, rows: int = 100_000) -> Callable[[Column], Column]:
    """Equal ranges of a draw, as many as keep a chunk of a hot key near ``rows`` rows.

    For use as the chunk of a scan: a function of the size of the key.
    """
    return lambda size: F.floor(u.cast("double") / F.lit(float(SPAN)) * F.ceil(size / F.lit(rows)))


def poisson1_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities 0, 1, 2 ... up to the last one below 1 in doubles."""
    out, term, total, k = [], math.exp(-1), 0.0, 0
    while total + term > total and total + term < 1.0:
        total += term
        out.append(total)
        k += 1
        term /= k
    return out


def poisson1(u: Column) -> Column:
    """Poisson(1) quantile of a uniform: bootstrap weight without any exchange."""
    return sum((F.when(u > c, 1).otherwise(0) for c in poisson1_steps()), F.lit(0)).cast("bigint")


_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).astype(np.uint32)
_SINES = np.array([int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)], np.uint32)


def _md5_block(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """The digests' state after one more block each (words: 16 rows of 32 bits)."""
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, at = c ^ d, i
            f &= b
            f ^= d
        elif i < 32:
            f, at = b ^ c, (5 * i + 1) % 16
            f &= d
            f ^= c
        elif i < 48:
            f, at = b ^ c, (3 * i + 5) % 16
            f ^= d
        else:
            f, at = ~d, 7 * i % 16
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        f += words[at]
        low = f >> (np.uint32(32) - _SHIFTS[i])
        f <<= _SHIFTS[i]
        f |= low
        f += b
        a, b, c, d = d, f, b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]


class Draws:
    """draw(seed, b, id) of many ids (texts), for one b after the other: a uint64 array each.

    The messages of a block count lie side by side, and what differs from one b to the next is their first bytes.
    """

    def __init__(self, seed: int, ids: pa.Array):
        self.seed = seed
        raw = ids.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.sizes = np.diff(offsets)
        # bytes of each id, then the bit that ends a message
        self.bytes = np.zeros((len(raw), int(self.sizes.max(initial=0)) + 1), np.uint8)
        self.bytes[np.arange(self.bytes.shape[1]) < self.sizes[:, None]] = data[offsets[0]:offsets[-1]]
        self.bytes[np.arange(len(raw)), self.sizes] = 0x80
        self.head, self.laid = -1, []

    def _lay(self, head: int) -> None:
        size = self.sizes + head
        blocks = (size + 8) // 64 + 1
        self.head, self.laid = head, []
        for n in np.unique(blocks):
            own = np.flatnonzero(blocks == n)
            text = np.zeros((len(own), 64 * n), np.uint8)
            width = min(self.bytes.shape[1], 64 * n - head)
            text[:, head:head + width] = self.bytes[own, :width]
            text[:, -8:] = (8 * size[own]).astype("<u8").view(np.uint8).reshape(-1, 8)
            self.laid.append((own, np.ascontiguousarray(text.view("<u4").T)))

    def of(self, b: int) -> np.ndarray:
        head = f"{self.seed}:{b}:".encode()
        if len(head) != self.head:
            self._lay(len(head))
        full = np.frombuffer(head + bytes(-len(head) % 4), "<u4")
        keep = np.frombuffer(bytes(len(head)) + b"\xff" * (-len(head) % 4), "<u4")
        out = np.empty(len(self.sizes), np.uint64)
        for own, words in self.laid:
            words[:len(full)] = words[:len(full)] & keep[:, None] | full[:, None]
            state = [np.full(len(own), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
            for at in range(0, len(words), 16):
                state = _md5_block(state, words[at:at + 16])
            high, low = state[0].byteswap().astype(np.uint64), state[1].byteswap().astype(np.uint64)
            out[own] = (high << np.uint64(28)) | (low >> np.uint64(4))
        return out


def hypergeometric_quantiles(size: int, marked: int, drawn: int, u: np.ndarray) -> np.ndarray:
    """Marked items among ``drawn`` out of ``size`` items, ``marked`` of them marked, at probabilities u.

    Probabilities follow from their ratios, over the range that lies within forty deviations of the mean;
    beyond it no double tells the sum from zero. So the cost grows with the root of the size.
    """
    low, high = max(0, drawn + marked - size), min(drawn, marked)
    if low == high:
        return np.full(len(u), low, np.int64)
    mean = drawn * marked / size
    spread = math.sqrt(mean * (1 - marked / size) * (size - drawn) / (size - 1))
    a, b = max(low, math.floor(mean - 40 * spread - 40)), min(high, math.ceil(mean + 40 * spread + 40))
    x = np.arange(a + 1, b + 1, dtype=float)
    ratio = np.log((marked - x + 1) * (drawn - x + 1) / (x * (size - marked - drawn + x)))
    log = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(log - log.max())
    return a + np.searchsorted(np.cumsum(p) / p.sum(), u, "left").clip(0, b - a)


def hypergeometric(df: DataFrame, size: str, marked: str, drawn: str, us: str, out: str) -> DataFrame:
    """Add ``out``: for each uniform of the array ``us``, a draw without replacement from the row's counts.

    A row stands for a group of any size: replicates cost what its counts cost, no item is moved.
    """
    def run(batches):
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in (size, marked, drawn, us)))
            values = [hypergeometric_quantiles(n, k, m, np.array(u, float)).tolist() for n, k, m, u in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.int64()))], [*batch.schema.names, out])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<bigint>")
