"""Splitting texts into pre-tokens by whole arrays, and a bounded memory of their ids.

The public pattern (contractions, letters, numbers, others, each with one
leading space, and white space) is decided from runs of character classes, so
no regular expression runs over the texts. Which characters are letters,
numbers and white space is asked of the tokenizer library itself, as libraries
differ in their Unicode version. Each new pre-token is encoded by the library
once; ids of texts are then gathered in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .spans import MUL_A, U64, Texts

OTHER, LETTER, NUMBER, SPACE_CLASS = 0, 1, 2, 3
N_CODES = 0x110000
#: Every character that a string can hold.
ALL_CHARACTERS = "".join(map(chr, [*range(0xD800), *range(0xE000, N_CODES)]))


def class_table(members: dict[int, str]) -> np.ndarray:
    """Classes by code point, from a string of the members of each class."""
    table = np.zeros(N_CODES, np.uint8)
    for kind, characters in members.items():
        table[np.frombuffer(characters.encode("utf-32-le"), "<u4")] = kind
    return table


def code_points(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters that begin at ``first``."""
    lead = data[first]
    out = lead.astype(np.int32)
    for least, most, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.flatnonzero((lead >= least) & (lead < most))
        if len(at):
            code = lead[at].astype(np.int32) & mask
            for k in range(1, more + 1):
                code = (code << 6) | (data[first[at] + k].astype(np.int32) & 0x3F)
            out[at] = code
    return out


def split(t: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens, and their bounds by text."""
    data, n = t.data, t.n
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(t.count + 1, np.int64)
    first = np.flatnonzero((data[:n] & 0xC0) != 0x80)
    code = code_points(data, first)
    kind = table[code]
    m = len(first)
    fresh = np.zeros(m + 1, bool)  # characters that open a text
    fresh[np.searchsorted(first, t.at)] = True
    run = np.empty(m, bool)
    run[0] = True
    run[1:] = kind[1:] != kind[:-1]
    run |= fresh[:m]
    start = run.copy()
    # A white-space run before another run of its text gives up its last character, a blank to the run itself.
    after = np.flatnonzero(run[1:] & ~fresh[1:m] & (kind[:-1] == SPACE_CLASS)) + 1
    start[after - 1] = True
    blank = code[after - 1] == 0x20
    start[after[blank]] = False
    # A lone quote that opens a pre-token takes the letters of a contraction.
    quote = np.flatnonzero((code == 0x27) & start)
    quote = quote[quote + 1 < m]
    quote = quote[(kind[quote + 1] == LETTER) & ~fresh[quote + 1]]
    if len(quote):
        one, two = code[quote + 1], code[np.minimum(quote + 2, m - 1)]
        second = (quote + 2 < m) & ~fresh[np.minimum(quote + 2, m)]
        pair = second & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        single = np.isin(one, (0x73, 0x74, 0x6D, 0x64))
        took = np.where(single, 1, np.where(pair, 2, 0))
        quote, took = quote[took > 0], took[took > 0]
        start[quote + 1] = False
        rest = quote + 1 + took
        inside = rest < m
        rest = rest[inside]
        start[rest[(kind[rest] == LETTER) & ~run[rest]]] = True
    begins = first[start]
    ends = np.append(begins[1:], n)
    return begins, ends, np.searchsorted(begins, t.at)


class Memory:
    """Ids of pre-tokens by 64-bit hash.

    Emptied before the next texts once it has more than ``most`` entries or
    ``most_ids`` ids, so beside that it holds one piece of texts at most, or the
    one longer text that is a piece alone, however long its pre-tokens are.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], table: np.ndarray, most: int = 1_000_000, most_ids: int = 8_000_000):
        self.encode, self.table, self.most, self.most_ids = encode, table, most, most_ids
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.cells = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << 15, np.uint64)
        self.at = np.zeros((1 << 15) + 1, np.int64)
        self.flat = np.zeros(1 << 17, np.uint32)
        self.count = 0

    def _insert(self, todo: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = ((self.keys[todo] * MUL_A) >> U64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.cells[slot] < 0
            self.cells[slot[free]] = todo[free]
            lost = self.cells[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        slot = ((keys * MUL_A) >> U64(64 - self.bits)).astype(np.int64)
        got = self.cells[slot]
        todo = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            g = self.cells[slot[todo]]
            got[todo] = g
            todo = todo[(g >= 0) & (self.keys[g] != keys[todo])]
        return got.astype(np.int64)

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        count, total = self.count + len(keys), int(self.at[self.count] + sizes.sum())
        if count > len(self.keys):
            self.keys = np.resize(self.keys, 2 * count)
            self.at = np.resize(self.at, 2 * count + 1)
        if total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * total)
        self.keys[self.count : count] = keys
        np.cumsum(sizes, out=sizes)
        base = int(self.at[self.count])
        self.at[self.count + 1 : count + 1] = base + sizes
        self.flat[base:total] = np.fromiter((i for x in ids for i in x), np.uint32, total - base)
        before, self.count = self.count, count
        if 2 * count > len(self.cells):
            self.bits = int(np.ceil(np.log2(4 * count)))
            self.cells = np.full(1 << self.bits, -1, np.int32)
            before = 0
        self._insert(np.arange(before, count))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and their bounds by text."""
        t = Texts(texts)
        begins, ends, bounds = split(t, self.table)
        keys = t.hashes(begins, ends)
        if self.count > self.most or self.at[self.count] > self.most_ids:
            self.clear()
        got = self._find(keys)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            raw, at = t.data.tobytes(), missing[where]
            for k in range(0, len(at), 8192):  # a few at a time, as a library's answers are larger than their ids
                some = at[k : k + 8192]
                self._add(new[k : k + 8192], self.encode([raw[a:b].decode() for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True)]))
            got[missing] = self._find(keys[missing])
        out, edges = gather(self.flat, self.at, got)
        return out, edges[bounds]


def gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[w]:at[w + 1]] for each w of ``which``, joined; and the joined pieces' bounds."""
    begin = at[which]
    sizes = at[which + 1] - begin
    edges = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes, out=edges[1:])
    place = np.arange(edges[-1]) + np.repeat(begin - edges[:-1], sizes)
    return flat[place], edges
