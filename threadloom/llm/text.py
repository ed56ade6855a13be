"""Words of Arrow string columns as numpy arrays, without a Python object per word.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D; no byte of a multi-byte UTF-8
character is one of these, so this equals splitting the text on those characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first k bytes of a little-endian 8-byte block.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Words longer than this are hashed one by one.
LONG_WORD = 1024
#: Seeds of the two independent hashes of a word.
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Texts are taken in pieces of about so many bytes, so that the arrays over a piece stay small.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Words:
    """The words of a run of texts: 64-bit hashes, byte spans in data, and per text the first word's index.

    Beside the bytes, arrays take about 3 bytes a byte of text and 24 a word, however long a text is.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool, gaps: np.ndarray = _GAP):
        """data: the texts' bytes, one after another; bounds: n + 1 offsets into it; gaps: bytes outside of words."""
        self.data = data
        seen = _LOWER[data] if lower else data
        gap = gaps[data]
        inside = np.ones(len(data) + 1, dtype=bool)
        inside[:-1] = gap
        starts_here = ~gap
        starts_here[1:] &= gap[:-1]
        edge = bounds[:-1][bounds[:-1] < len(data)]
        starts_here[edge] = ~gap[edge]
        self.starts = np.flatnonzero(starts_here)
        ends_here = ~gap
        ends_here &= inside[1:]
        last = bounds[1:] - 1
        last = last[last >= 0]
        ends_here[last] = ~gap[last]
        self.ends = np.flatnonzero(ends_here) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.seen = np.concatenate([seen, np.zeros(8, np.uint8)])
        #: The 8 bytes from every position on, as numbers.
        self.blocks = np.ndarray(len(seen) + 1, "<u8", self.seen, strides=(1,))
        self.hashes = self.hashed(SEEDS[0])

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]

    def hashed(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word: its length, then its 8-byte blocks, each mixed into what came before.

        A step is a bijection of the block, so words of one length that differ in their last block alone never collide; no
        sum or product of bytes is involved that words could be built to cancel.
        """
        size = self.ends - self.starts
        out = mix(size.astype(_U) + _U(seed))
        rows, at, left = np.arange(len(size)), self.starts, size
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            for k in long.tolist():
                raw = self.seen[self.starts[k] : self.ends[k]]
                out[k] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
            rows = np.flatnonzero(size <= LONG_WORD)
            at, left = at[rows], left[rows]
        while len(rows):
            out[rows] = mix(out[rows] ^ (self.blocks[at] & _MASK[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        return out

    def prefixes(self, n: int) -> np.ndarray:
        """A hash of the first n bytes (8 at most) of each word, apart from whole words' hashes; 0 for words of n bytes or fewer."""
        longer = self.ends - self.starts > n
        return np.where(longer, mix((self.blocks[self.starts] & _MASK[n]) ^ mix(np.full(1, _U(SEEDS[1]) + _U(n)))), _U(0))

    def strings(self, a: int, b: int) -> list[bytes]:
        raw = self.data
        return [raw[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, lower: bool, gaps: np.ndarray = _GAP) -> Iterator[tuple[int, int, Words]]:
    """Runs [a, b) of the column's rows with their words; a run has about PIECE_BYTES bytes, or is one text."""
    data, offsets = column_bytes(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, side="right")) - 1)
        b = min(b, n)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, gaps)
        a = b


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = mix(out * _U(0xC2B2AE3D27D4EB4F) + hashes[k : k + m])
    return out
