"""Vectorised 64-bit hashes of words and word shingles over Arrow string buffers.

All functions are pure numpy helpers for use inside ``mapInArrow`` tasks. A word is
a run of bytes other than ASCII white space, with A-Z lower-cased; on UTF-8 that is
the same as ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
WINDOW = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[[32, 9, 10, 11, 12, 13]] = False

#: Letters and digits of ASCII, and all bytes of other characters.
_LETTERS = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n + 1:
        size = max(n + 1, WINDOW + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (rows + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    at = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _segment(data: np.ndarray, doc_starts: np.ndarray, kinds: np.ndarray):
    """Word starts, ends and hashes of one window; ``doc_starts`` always end a word."""
    low = LOWER[data]
    solid = kinds[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[doc_starts] = solid[doc_starts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = doc_starts[doc_starts > 0] - 1
    last[ends] = solid[ends]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_BYTES[low] * up[: len(data)], out=total[1:])
    return a, b, mix((total[b] - total[a]) * down[a] + (b - a).astype(U))


def words(column: pa.Array, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word offsets by row (rows + 1), byte start and end of each word).

    Byte positions count from the start of the column's own buffer slice. Windows of
    about a megabyte bound the memory; they are cut at white space or at a row's end.
    With ``letters`` a word is a run of ASCII letters and digits and other characters.
    """
    kinds = _LETTERS if letters else _SOLID
    data, at = buffers(column)
    begin, stop = int(at[0]), int(at[-1])
    data = data[begin:stop]
    at = at - begin
    hashes, starts, ends = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + WINDOW, len(data))
        if hi < len(data):
            row = int(at[np.searchsorted(at, hi, side="right") - 1])
            gap = np.flatnonzero(~kinds[data[lo:hi]])
            cut = max(row, lo + int(gap[-1]) + 1 if len(gap) else lo)
            if cut <= lo:  # one word longer than the window: go on to its end
                nxt = np.flatnonzero(~kinds[data[hi:]])
                end = hi + int(nxt[0]) if len(nxt) else len(data)
                row = at[(at > lo) & (at <= end)]
                cut = int(row[0]) if len(row) else end
            hi = cut
        inside = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
        a, b, h = _segment(data[lo:hi], inside[inside < hi - lo], kinds)
        hashes.append(h)
        starts.append(a + lo)
        ends.append(b + lo)
        lo = hi
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(len(at), np.int64), none, none
    h, a, b = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    return h, np.searchsorted(a, at, side="left").astype(np.int64), a, b


class Members:
    """Membership of 64-bit hashes in a set: a bitmap of fixed size, then the sorted hashes."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.map = np.zeros(1 << self.BITS, dtype=bool)
        self.map[(self.keys >> U(64 - self.BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of members, and their places among ``keys``."""
        at = np.flatnonzero(self.map[(h >> U(64 - self.BITS)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[place] == h[at]
        return at[good], place[good]


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash from the hashes of consecutive words."""
    x = parts[0]
    for p in parts[1:]:
        x = mix(x * U(0xD1342543DE82EF95) + p)
    return x


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    k = min(k, len(h))
    return fold([h[i : len(h) - k + 1 + i] for i in range(k)])


def chunks(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Slices of a batch whose texts have at most ``limit`` bytes, or one row.

    Behind the last one Arrow's freed memory goes back to the system: workers live on for other
    operators' tasks, and what each of them kept would add up.
    """
    _, at = buffers(batch.column(text))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(row, end - row)
        row = end
    pa.default_memory_pool().release_unused()
