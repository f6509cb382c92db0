"""Words and word hashes of whole Arrow text columns, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D, so any UTF-8 text is cut exactly as by
the pattern ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit: a polynomial over random values of the bytes,
finished by a mixer. They depend on nothing but the bytes, so all workers and runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (each bit of the input changes about half of the output)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Slice:
    """Some texts side by side: first is the row of the first one, bytes their UTF-8, at the bounds of the texts."""

    first: int
    bytes: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (byte offsets) of all words, and for each text the number of the first word (with the total last)."""
        inside = ~_IS_SPACE[self.bytes]
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.at), np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.at] = True
        before = np.empty(len(inside), bool)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(inside), bool)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def sums(self) -> np.ndarray:
        """Running sums of byte values times powers; span_hash reads hashes of spans off them."""
        out = np.empty(len(self.bytes) + 1, np.uint64)
        out[0] = 0
        np.cumsum(_BYTE[self.bytes] * _power(_BASE, len(self.bytes)), out=out[1:])
        return out

    def lowered(self) -> Slice:
        return Slice(self.first, _LOWER[self.bytes], self.at)


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    back = _power(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, by the place of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = (out ^ (out >> U(29))) * U(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a string column in slices of about most bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield Slice(row, whole[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end
