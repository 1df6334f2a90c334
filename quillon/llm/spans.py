"""Vectorised work on the bytes of whole Arrow text columns.

A column's texts are one byte buffer with offsets; words, lines and shingles
are spans of it, hashed eight bytes at a time. No Python string is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once; the arrays made on the way are about a hundred times that.
PIECE_BYTES = 1 << 20

U64 = np.uint64
MUL_A, MUL_B, MUL_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BYTE_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

_codes = np.arange(256)
#: Bytes that part words: space and the controls from tab to carriage return.
SPACE = (_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D))
#: ASCII capitals to small letters, everything else as it is.
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: Bytes of alphanumeric words: digits, small letters, and all of a character beyond ASCII.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U64(30))
    h *= MUL_B
    h ^= h >> U64(27)
    h *= MUL_C
    h ^= h >> U64(31)
    return h


def chunks_of(texts: pa.Array, most_bytes: int = PIECE_BYTES):
    """(first row, end row) of pieces of a column of about ``most_bytes``; a longer text is a piece alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most_bytes:
            yield first, k
            first, held = k, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


class Texts:
    """The bytes of a column. ``data`` is padded by 16 zero bytes; text k is data[at[k]:at[k + 1]]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1] or b"\0" * 8, dtype=np.int64 if wide else np.int32)
        at = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(at):
            at = np.zeros(1, np.int64)
        body = texts.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.n = len(raw)
        self.count = len(texts)
        self.data = np.zeros(self.n + 16, np.uint8)
        self.data[: self.n] = LOWER[raw] if lower else raw

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes of a class, none across texts, and the runs' bounds by text."""
        inside = np.zeros(self.n + 1, bool)
        inside[: self.n] = member[self.data[: self.n]]
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[: self.n - 1] if self.n > 1 else True
        ends = inside[:-1] & ~inside[1:]
        edges = self.at[1:-1]
        edges = edges[(edges > 0) & (edges < self.n)]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.at)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of spans; equal spans have equal hashes."""
        eight = np.ndarray((self.n + 9,), "<u8", self.data.data, 0, (1,))
        left = ends - starts
        h = left.astype(np.uint64) * MUL_A + U64(seed)
        word = eight[starts] & BYTE_MASKS[np.minimum(left, 8)]
        h = mix(h ^ word)
        active = np.flatnonzero(left > 8)
        step = 8
        while len(active):
            word = eight[starts[active] + step] & BYTE_MASKS[np.minimum(left[active] - step, 8)]
            h[active] = mix((h[active] + MUL_A) ^ word)
            step += 8
            active = active[left[active] > step]
        return h


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text that each item belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive items within a text, and each one's first item."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - k + 1
    w = h[:m].copy()
    for j in range(1, k):
        w = (w * MUL_A) ^ (h[j : j + m] + (w >> U64(29)))
    own = owners(bounds)
    first = np.flatnonzero(own[:m] == own[k - 1 :])
    return mix(w[first]), first


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the items of each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class HashTable:
    """64-bit keys to positions, by open addressing in numpy: built once, probed by whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2 + 1))))
        self.shift = U64(64 - bits)
        self.cells = np.full(1 << bits, -1, np.int32)
        self.keys = np.ascontiguousarray(keys, dtype=np.uint64)
        self.last = (1 << bits) - 1
        todo = np.arange(len(keys), dtype=np.int64)
        slot = self._slot(self.keys)
        while len(todo):
            here = slot[todo]
            free = self.cells[here] < 0
            self.cells[here[free]] = todo[free]
            lost = self.cells[here] != todo
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MUL_A) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key among those it was built from, or -1."""
        slot = self._slot(keys)
        got = self.cells[slot].astype(np.int64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last
            g = self.cells[slot[todo]].astype(np.int64)
            got[todo] = g
            todo = todo[(g >= 0) & (self.keys[g] != keys[todo])]
        return got
