"""Words of many texts at once: byte offsets and 64-bit hashes as numpy arrays.

Texts come from an Arrow string column. All work is on the UTF-8 bytes of a few
hundred KB of whole texts at a time; a longer text is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def byte_table(members) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    t = np.zeros(256, dtype=bool)
    t[list(members)] = True
    return t


#: Letters a-z (after folding A-Z), digits and every byte of a non-ASCII character.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Everything but the six ASCII white-space characters.
NOT_SPACE = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


@dataclass
class Texts:
    """Rows ``lo`` to ``hi`` of a column: their bytes, laid end to end, and the bounds of each row in them."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


@dataclass
class Words:
    """Words in order: byte bounds, the row (from 0) each is in, and its hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def groups(column, group_bytes: int = GROUP_BYTES) -> Iterator[Texts]:
    """Consecutive rows of an Arrow string column, as many as fit in ``group_bytes``, one at least; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, raw = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + group_bytes, side="right")) - 1)
        yield Texts(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = _powers(_BASE, size), _powers(inverse, size)
        return self.up[:n], self.down[:n]


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype=np.uint64)
    done, step = 1, base
    while done < size:
        out[done : 2 * done] = out[:done] * np.uint64(step)
        done, step = 2 * done, (step * step) & _MASK
    return out


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def find(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of member bytes; no run crosses a row's bounds."""
    inside = member[data]
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = FOLD, block: int = GROUP_BYTES) -> np.ndarray:
    """A 64-bit polynomial hash of each run of folded bytes, in blocks of whole words."""
    out = np.empty(len(start), dtype=np.uint64)
    i, values = 0, fold.astype(np.uint64) + np.uint64(1)
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
        at, to = int(start[i]), int(end[j - 1])
        up, down = _POWERS.get(to - at)
        total = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(values[data[at:to]] * up, out=total[1:])
        s = start[i:j] - at
        out[i:j] = (total[end[i:j] - at] - total[s]) * down[s]
        i = j
    return mix(out)


def words(texts: Texts, member: np.ndarray, fold: np.ndarray = FOLD) -> Words:
    """The words of a group of texts."""
    start, end, row = find(texts.data, texts.bounds, member)
    return Words(start, end, row, hashes(texts.data, start, end, fold))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive values (order matters); empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(_BASE)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)
