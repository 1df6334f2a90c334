"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, weighted by TF-IDF with document
frequencies of the whole corpus. They and all windows of the corpus are reduced
by a randomised SVD, so words that the corpus uses together fall together. The
windows are read once: their rows' products are added by pair of words, and the
SVD's passes run over those sums and the passages. Documents are searched in
the latent space: each window of words whose cosine with a passage's latent
image is high enough is a candidate. A candidate counts if the longest common subsequence of the
item's words and the document's words around the window covers most of the
item, or a smaller share of it with the item's closing words, its answer, among
them. So shuffled, shortened and reworded copies are found as well as exact.

A short item is outweighed by its neighbours in a window, and an item copied
into many documents lowers the weights of its own words. So a second search
takes no weights: a copy holds at least ``least_common`` of an item's n words,
hence t of any n - least_common + t of them. Wherever t of the item's rarest so
many words stand within the words around a window that the subsequence is taken
over, the window is a candidate too. No copy that the subsequence accepts
around some window is missed, whatever its cosine, which is only reported.

The benchmark is the stated query set: it is taken in blocks of items, each
with a latent space of its own of at most ``MAX_RANK`` dimensions over the
block's words, and every block meets every window of every document. Only
hashed document frequencies (a fixed number of cells) and one block's model at
a time are held by a task. A window
whose weight in the block's vocabulary can't reach the cosine is skipped, which
loses nothing.

Null and empty texts contain nothing; null and wordless items are contained in
nothing; an item without an id is found like any other. Repeated rows are judged
one by one. Ties in cosine or share don't matter. An empty benchmark contaminates
nothing. Extra columns pass ``keep_documents`` untouched.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, documents, new_folder, open_bytes, put_bytes, written
from .spans import ALNUM, MUL_A, U64, HashTable, Texts, chunks_of, owners

CELLS_BITS = 18
WINDOW, STRIDE = 32, 16
ITEMS_PER_BLOCK = 192
#: Dimensions of a block's latent space, and what all windows of the corpus weigh beside the block's own passages, one each, if they are more.
MAX_RANK, CORPUS_WEIGHT = 160, 4096
#: Sums that a task holds at once, of 8 bytes; a block with more is taken by ranges of words, in more readings.
SUMS_HELD = 1 << 24
OVERSAMPLE = 16
LEAST_COSINE = 0.35
#: Shares of an item's words that the common subsequence must hold: alone, and with the answer's words.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER_SHARE = 0.75, 0.55, 0.8
ANSWER_WORDS = 6


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = Texts(texts, lower=True)
    starts, ends, bounds = t.runs(ALNUM)
    return t.hashes(starts, ends), bounds


def cell(h: np.ndarray) -> np.ndarray:
    return ((h * MUL_A) >> U64(64 - CELLS_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by cell of a task's texts; the last rows count all documents and all windows."""
    total, count, cut = np.zeros(1 << CELLS_BITS, np.int64), 0, 0
    for batch in batches:
        for a, b in chunks_of(batch.column(0)):
            h, bounds = _words(batch.column(0).slice(a, b - a))
            seen = np.sort((owners(bounds) << CELLS_BITS) | cell(h))
            seen = seen[np.append(True, seen[1:] != seen[:-1])] if len(seen) else seen
            total += np.bincount(seen & ((1 << CELLS_BITS) - 1), minlength=1 << CELLS_BITS)
            count += b - a
            cut += len(windows(bounds)[0])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]).astype(np.int32)), pa.array(np.append(total[at], [count, cut]))], names=["cell", "df"])


def inverse_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """ln((N + 1) / (df + 1)) by cell, over all N documents, and the number of their windows; 2^18 cells however many there are."""
    parts = docs.select("text").mapInArrow(_frequencies, "cell int, df long")
    got = parts.groupBy("cell").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << CELLS_BITS)
    at = got["cell"].to_numpy()
    df[at[at >= 0]] = got["df"].to_numpy()[at >= 0]
    n, cut = (int(got["df"].to_numpy()[at == x].sum()) for x in (-1, -2))
    return np.maximum(np.log((n + 1) / (df + 1)), 0).astype(np.float32), cut


def cuts(n: int) -> list[tuple[int, int]]:
    """Windows over n words; the last ends at the last word."""
    last = max(0, n - WINDOW)
    return [(s, min(n, s + WINDOW)) for s in [*range(0, last, STRIDE), last]] if n else []


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of all ``cuts`` of texts, in order."""
    sizes = np.diff(bounds)
    count = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
    own = np.repeat(np.arange(len(sizes)), count)
    step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    begin = bounds[own] + np.minimum(step * STRIDE, np.maximum(0, sizes[own] - WINDOW))
    return own, begin, np.minimum(begin + WINDOW, bounds[own + 1])


def _matrix(rows: list, idf: np.ndarray, columns: HashTable, width: int) -> np.ndarray:
    """TF-IDF of passages, each divided by its norm over all its words, in the columns of one vocabulary."""
    out, norms = np.zeros((len(rows), width)), np.zeros(len(rows))
    for r, hashes in enumerate(rows):
        h, times = np.unique(np.asarray(hashes, np.int64).view(np.uint64), return_counts=True)
        weight = times * idf[cell(h)].astype(np.float64)
        norms[r] = np.linalg.norm(weight)
        place = columns.find(h)
        out[r, place[place >= 0]] = weight[place >= 0]
    return out / np.where(norms > 0, norms, 1)[:, None]


def _load(uri: str) -> dict[str, np.ndarray]:
    with open_bytes(uri) as source, np.load(io.BytesIO(source.read())) as held:
        return dict(held)


def _save(uri: str, **arrays: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez(out, **arrays)
    put_bytes(uri, [out.getvalue()])
    return uri


def _window_sums(h: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of 1 / norm^2 of windows: before the first window that holds a word, and up to the last one.

    The second of a word less the first of a later one is the sum over the
    windows that hold both; it is not positive if there are none.
    """
    squares = weight.astype(np.float64) ** 2
    energy = np.append(0, np.cumsum(squares))
    place = np.arange(len(h))
    low, high = np.searchsorted(end, place, side="right"), np.searchsorted(begin, place, side="right")
    pairs = np.zeros(len(begin) + 1)  # a word c times in a window weighs (c w)^2: w^2 for each occurrence and 2 w^2 for each pair of them
    for d in range(1, min(WINDOW, len(h))):
        p = np.flatnonzero(h[:-d] == h[d:])
        first, last = low[p + d], high[p]
        p, first, last = (x[first < last] for x in (p, first, last))
        pairs += np.bincount(first, 2 * squares[p], len(pairs)) - np.bincount(last, 2 * squares[p], len(pairs))
    norms = energy[end] - energy[begin] + np.cumsum(pairs)[:-1]
    total = np.append(0, np.cumsum(np.where(norms > 1e-9, 1 / np.maximum(norms, 1e-9), 0)))
    return total[low], total[high]


def _add_pairs(total: np.ndarray, place: np.ndarray, before: np.ndarray, upto: np.ndarray, width: int, first: int, end: int) -> None:
    """Add to ``total`` (words first to end x all words, flat) what pairs of words weigh in the windows that hold both, by the smaller word; ``place`` is a word's column or -1."""
    known = np.flatnonzero(place >= 0)
    word, before, upto = place[known], before[known], upto[known]
    for d in range(min(WINDOW, len(known))):
        both = upto[: len(known) - d] - before[d:]
        at = np.flatnonzero(both > 0)
        if not len(at):  # words further apart share no window either
            break
        a, b = word[at], word[at + d]
        a, b = np.minimum(a, b), np.maximum(a, b)
        value = both[at] * np.where(a == b, 2, 1) if d else both[at]  # two occurrences make two products
        if first or end < width:
            inside = (a >= first) & (a < end)
            a, b, value = a[inside], b[inside], value[inside]
        np.add.at(total, (a - first) * width + b, value)


SUMS = "block int, row int, v binary"


def corpus_sums(docs: DataFrame, blocks: dict[int, tuple[str, int]], idf: np.ndarray) -> DataFrame:
    """(block, row, v): upper triangles of the products of all windows' TF-IDF rows, by block of (file, words) and word; v begins at the diagonal.

    Every window of every row of ``docs`` counts, divided by its norm. A task
    holds ``SUMS_HELD`` sums or one word's; more are taken in more readings.
    Few tasks, by the cluster's cores, give their sums out, in single precision,
    so that what is shuffled does not grow with the corpus.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(idf)
    readings: list[list[tuple[int, str, int, int, int]]] = [[]]
    left = SUMS_HELD
    for block, (uri, width) in sorted(blocks.items()):
        first = 0
        while first < width:
            rows = min(width - first, left // width)
            if not rows and readings[-1]:
                readings.append([])
                left = SUMS_HELD
                continue
            rows = max(rows, 1)
            readings[-1].append((block, uri, width, first, first + rows))
            first, left = first + rows, left - rows * width

    def reader(ranges: list[tuple[int, str, int, int, int]]):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = [HashTable(_load(uri)["vocabulary"]) for _, uri, *_ in ranges]
            totals = [np.zeros((end - first) * width) for _, _, width, first, end in ranges]
            for batch in batches:
                for a, b in chunks_of(batch.column(0)):
                    h, bounds = _words(batch.column(0).slice(a, b - a))
                    if len(h):
                        before, upto = _window_sums(h, weights.value[cell(h)], *windows(bounds)[1:])
                        for table, total, (_, _, width, first, end) in zip(tables, totals, ranges, strict=True):
                            _add_pairs(total, table.find(h), before, upto, width, first, end)
            for total, (block, uri, width, first, end) in zip(totals, ranges, strict=True):
                weight = weights.value[cell(_load(uri)["vocabulary"])].astype(np.float64)
                total = total.reshape(-1, width)
                for a in range(first, end, 256):
                    some = [r for r in range(a, min(a + 256, end)) if total[r - first, r:].any()]
                    values = [(total[r - first, r:] * weight[r] * weight[r:]).astype(np.float32).tobytes() for r in some]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block, np.int32)), pa.array(some, pa.int32()), pa.array(values, pa.binary())], names=["block", "row", "v"])

        return read

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, row, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(v, np.float32)
                if (block, row) in held:
                    held[block, row] += part
                else:
                    held[block, row] = part.astype(np.float64)
        keys = sorted(held)
        for k in range(0, len(keys), 256):
            some = keys[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int32()), pa.array([held[x].tobytes() for x in some], pa.binary())], names=["block", "row", "v"])

    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(2 * spark.sparkContext.defaultParallelism, size >> 30 if size < 1 << 50 else 0)
    parts = None
    for ranges in readings:
        one = docs.select("text").coalesce(tasks).mapInArrow(reader(ranges), SUMS)
        parts = one if parts is None else parts.unionByName(one)
    # Few files in order of blocks: each gives out a product for each of its blocks in every pass.
    out = written(parts.repartition("block", "row").mapInArrow(add, SUMS).coalesce(4).sortWithinPartitions("block", "row"), "window-sums")
    weights.destroy()
    return out


def randomised_svd(passages: DataFrame, sums: DataFrame, share: float, blocks: dict[int, str], idf: np.ndarray, rank: int, folder: str, seed: int = 7) -> dict[int, str]:
    """Latent spaces of all blocks at once: files with the leading right singular vectors (vocabulary x rank) of ``passages(block, words)`` and the corpus.

    A block's matrix has its own passages and all windows of the corpus, of
    which it takes ``sums(block, row, v)``, times ``share``. Each pass
    multiplies a basis by the rows of a partition and back by their transpose,
    or by a partition's sums; partial products are added and made orthogonal by
    block, in tasks. The driver sees names of files alone, and no task holds
    more than a partition's passages and one block's basis.
    """
    spark = passages.sparkSession
    weights = spark.sparkContext.broadcast(idf)  # a fixed number of cells

    def opened(uri: str) -> tuple[np.ndarray, np.ndarray]:
        held = _load(uri)
        q = held.get("basis")
        if q is None:
            q = np.random.default_rng(seed).standard_normal((len(held["vocabulary"]), min(rank + OVERSAMPLE, len(held["vocabulary"]))))
        return held["vocabulary"], q

    def rows_of(block: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.union1d([0], np.flatnonzero(np.abs(total).sum(1)))  # a block without any weight has a row too
        for k in range(0, len(at), 1024):
            part = at[k : k + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array(part.astype(np.int32)), pa.array([total[x].tobytes() for x in part], pa.binary())], names=["block", "row", "v"])

    def step(names: dict[int, str], square: bool) -> dict[int, str]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, list] = {}
            for batch in batches:
                for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own.setdefault(block, []).append(words)
            for block, rows in own.items():
                vocabulary, q = opened(names[block])
                columns = HashTable(vocabulary)
                total = np.zeros((q.shape[1] if square else len(q), q.shape[1]))
                for k in range(0, len(rows), 256):
                    a = _matrix(rows[k : k + 256], weights.value, columns, len(q))
                    y = a @ q
                    total += y.T @ y if square else a.T @ y
                yield from rows_of(block, total)

        def from_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, q, total = None, None, None
            for batch in batches:
                numbers, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cut = np.union1d(np.flatnonzero(np.diff(numbers)) + 1, np.arange(0, len(rows) + 256, 256).clip(max=len(rows)))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    if numbers[a] != now:
                        if now is not None:
                            yield from rows_of(now, total)
                        now = int(numbers[a])
                        _, q = opened(names[now])
                        total = np.zeros((q.shape[1] if square else len(q), q.shape[1]))
                    some = rows[a:b]
                    upper = np.zeros((b - a, len(q)))
                    for k, (r, v) in enumerate(zip(some.tolist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True)):
                        upper[k, r:] = np.frombuffer(v)
                        upper[k, r] /= 2  # the other triangle has the other half
                    y = upper @ q * share
                    if square:
                        y = q[some].T @ y
                        total += y + y.T
                    else:
                        total[some] += y  # a word has one row in a table
                        total += upper.T @ q[some] * share
            if now is not None:
                yield from rows_of(now, total)

        def fold(group: pa.Table) -> pa.Table:
            block = group.column("block")[0].as_py()
            held = _load(names[block])
            values = np.frombuffer(b"".join(group.column("v").to_pylist())).reshape(group.num_rows, -1)
            total = np.zeros((values.shape[1] if square else len(held["vocabulary"]), values.shape[1]))
            np.add.at(total, group.column("row").to_numpy(), values)
            if square:
                strength, vectors = np.linalg.eigh(total)
                keep = np.argsort(strength)[::-1][:rank]
                keep = keep[strength[keep] > 1e-9 * max(strength.max(), 1e-30)]
                held["basis"] = held["basis"] @ vectors[:, keep]
            else:
                held["basis"] = np.linalg.qr(total)[0]
            uri = _save(f"{folder}/basis-{block}-{uuid.uuid4().hex}.npz", **held)
            return pa.table({"block": pa.array([block], pa.int32()), "uri": [uri]})

        parts = passages.mapInArrow(partial, SUMS).unionByName(sums.mapInArrow(from_sums, SUMS)).groupBy("block").applyInArrow(fold, "block int, uri string")
        return {r["block"]: r["uri"] for r in written(parts, "svd").collect()}  # a row for each block

    out = blocks
    for _ in range(2):
        out = step(out, False)
    out = step(out, True)
    weights.destroy()
    return out


def least_common(n: int) -> int:
    """The fewest words of an item of n that a copy has in common with it."""
    return next(c for c in range(1, n + 1) if c / n >= LCS_WITH_ANSWER)


class Block:
    """One block of the benchmark: vocabulary, latent space, passages and items."""

    def __init__(self, uri: str):
        held = _load(uri)
        self.vocabulary = HashTable(held["vocabulary"])
        self.space = held["space"].astype(np.float32)
        self.images = held["images"].astype(np.float32)
        self.item_of = held["item_of"]
        #: The largest part of a word in the image of any passage.
        self.most = np.concatenate([(self.space[k : k + 1024] @ self.images.T).max(1, initial=0) for k in range(0, len(self.space), 1024)])
        self.idf = held["idf"]
        words, at = held["words"], held["at"]
        self.items = [words[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        self.ids = [i if known else None for i, known in zip(held["ids"].tolist(), held["known"].tolist(), strict=True)]
        self.masks = []
        for item in self.items:
            masks: dict[int, int] = {}
            for k, w in enumerate(item):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)
        self.lengths = np.diff(at)
        self.least_hits = np.ones(len(self.items), np.int64)
        rows: list[tuple[int, int, int]] = []
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            n, need = int(b - a), least_common(int(b - a))
            self.least_hits[k] = hits = max(1, need // 2)
            rare = np.argsort(-self.idf[cell(words[a:b])], kind="stable")[: n - need + hits]
            word, times = np.unique(self.vocabulary.find(words[a:b][rare]), return_counts=True)
            rows += [(w, k, c) for w, c in zip(word.tolist(), times.tolist(), strict=True)]
        word, self.listed, self.times = np.array(sorted(rows), np.int64).reshape(-1, 3).T
        self.from_word = np.searchsorted(word, np.arange(len(held["vocabulary"]) + 1))

    def matched(self, item: int, words: list[int]) -> tuple[float, bool]:
        """Share of an item's words in the longest common subsequence with ``words``, and whether it is contained."""
        masks, n = self.masks[item], len(self.items[item])
        share = common_words(masks, n, words) / n
        if share >= LCS_ALONE:
            return share, True
        if share < LCS_WITH_ANSWER:
            return share, False
        tail = min(ANSWER_WORDS, n)
        shifted = {w: m >> (n - tail) for w, m in masks.items() if m >> (n - tail)}
        return share, common_words(shifted, tail, words) >= ANSWER_SHARE * tail

    def search(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        """(text, item, cosine, share) of the items contained in texts given by word hashes."""
        own, begin, end = windows(bounds)
        weight = self.idf[cell(h)]
        place = self.vocabulary.find(h)
        hopeful = self._hopeful(h, weight, place, begin, end)
        hopeful = hopeful[self._in_reach(weight, place, begin[hopeful], end[hopeful])]
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for some, cosines in self._cosines(h, weight, place, begin, end, hopeful, LEAST_COSINE):
            for r, c in zip(*np.nonzero(cosines >= LEAST_COSINE), strict=True):
                window = some[r]
                spot = (float(cosines[r, c]), int(begin[window]), int(end[window]))
                found.setdefault((int(own[window]), int(self.item_of[c])), []).append(spot)
        done: set[tuple[int, int]] = set()
        for (text, item), spots in found.items():
            reach = len(self.items[item])
            best, share_best, hit = max(s[0] for s in spots), 0.0, False
            region: list[int] | None = None
            for _, a, b in sorted(spots, key=lambda s: s[1]):
                a, b = max(int(bounds[text]), a - reach), min(int(bounds[text + 1]), b + reach)
                if region is not None and a <= region[1]:
                    region[1] = max(region[1], b)
                    continue
                if region is not None:
                    share, ok = self.matched(item, h[region[0] : region[1]].tolist())
                    share_best, hit = max(share_best, share), hit or ok
                region = [a, b]
            share, ok = self.matched(item, h[region[0] : region[1]].tolist())
            share_best, hit = max(share_best, share), hit or ok
            if hit:
                done.add((text, item))
                yield text, item, best, share_best
        copies: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for text, item, *region in self._copies(bounds, place, begin, end, own):
            if (text, item) not in done:
                copies.setdefault((text, item), []).append(tuple(region))
        for (text, item), regions in copies.items():
            share_best, hit = 0.0, False
            for a, b, _, _ in regions:
                share, ok = self.matched(item, h[a:b][place[a:b] >= 0].tolist())
                share_best, hit = max(share_best, share), hit or ok
            if hit:
                near = np.concatenate([np.arange(first, last + 1) for _, _, first, last in regions])
                images = self.item_of == item
                best = max((float(c[:, images].max()) for _, c in self._cosines(h, weight, place, begin, end, near)), default=0.0)
                yield text, item, max(best, 0.0), share_best

    def _hopeful(self, h: np.ndarray, weight: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The windows whose weight in the block's vocabulary may reach the least cosine; none that can is left out.

        A word c times in a window weighs (c w)^2, w^2 for each occurrence and
        2 w^2 for each pair of them. All pairs that begin in the window are
        counted, so the part inside is no less than the exact one, and the
        whole, without pairs, no more.
        """
        energy, inside = np.zeros(len(h) + 1), np.zeros(len(h) + 1)
        np.cumsum(weight * weight, out=energy[1:], dtype=np.float64)
        known = np.flatnonzero(place >= 0)
        later = np.zeros(len(known))
        for d in range(1, WINDOW):
            part = known[: np.searchsorted(known, len(h) - d)]
            later[: len(part)] += place[part] == place[part + d]
        inside[1 + known] = weight[known].astype(np.float64) ** 2 * (1 + 2 * later)
        np.cumsum(inside, out=inside)
        return np.flatnonzero(inside[end] - inside[begin] >= LEAST_COSINE**2 * np.maximum(energy[end] - energy[begin], 1e-12) * (1 - 1e-6))

    def _in_reach(self, weight: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether windows may reach the least cosine if each word fell on the passage it is nearest to; no window that can is left out.

        Repeated words add up as their occurrences do, and a norm is no less
        than that of occurrences apart.
        """
        energy, most = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
        np.cumsum(weight * weight, out=energy[1:], dtype=np.float64)
        known = np.flatnonzero(place >= 0)
        most[1 + known] = weight[known].astype(np.float64) * self.most[place[known]]
        np.cumsum(most, out=most)
        return most[end] - most[begin] >= LEAST_COSINE * np.sqrt(np.maximum(energy[end] - energy[begin], 0)) * (1 - 1e-4)

    def _cosines(self, h: np.ndarray, weight: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray, least: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some of the wanted windows and their cosines with all passages; those that can't reach the least cosine, or have no weight in the block, are left out."""
        for a in range(0, len(wanted), 1024):
            some = wanted[a : a + 1024]
            at = np.minimum(begin[some][:, None] + np.arange(WINDOW), len(h) - 1)
            real = begin[some][:, None] + np.arange(WINDOW) < end[some][:, None]
            w = np.where(real, weight[at], 0)
            order = np.argsort(h[at], axis=1)
            sorted_h, sorted_w = np.take_along_axis(h[at], order, 1), np.take_along_axis(w, order, 1).astype(np.float64)
            runs = np.ones(sorted_h.shape, bool)
            runs[:, 1:] = sorted_h[:, 1:] != sorted_h[:, :-1]
            head = np.flatnonzero(runs.ravel())
            sums = np.add.reduceat(sorted_w.ravel(), head)
            row = head // WINDOW
            norms = np.bincount(row, sums * sums, minlength=len(some))
            word = np.take_along_axis(place[at], order, 1).ravel()[head]
            known = (word >= 0) & (sums > 0)
            shares = np.bincount(row[known], sums[known] ** 2, minlength=len(some))
            known &= (shares >= least**2 * norms * (1 - 1e-9))[row]  # exact now: the others can't reach the cosine
            which, row = np.unique(row[known], return_inverse=True)
            if not len(which):
                continue
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            latent = np.add.reduceat(self.space[word[known]] * sums[known, None].astype(np.float32), first, axis=0)
            some = some[which]
            cosines = (latent @ self.images.T) / np.maximum(np.sqrt(norms[which]), 1e-12)[:, None]
            yield some, cosines

    def _copies(self, bounds: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray) -> list[tuple[int, ...]]:
        """(text, item, first word, end, first window, last window) of stretches with enough of an item's rarest words for a copy, by no weights."""
        total, text_of = int(bounds[-1]), owners(bounds)
        known = np.flatnonzero(place >= 0)
        start = self.from_word[place[known]]
        size = self.from_word[place[known] + 1] - start
        spot = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = self.listed[spot] * total + np.repeat(known, size)
        order = np.argsort(key)
        key, spot = key[order], spot[order]
        item, at = np.divmod(key, max(total, 1))
        first = np.arange(len(at))
        last = first + self.least_hits[item] - 1
        first, last = first[last < len(at)], last[last < len(at)]
        reach, text = self.lengths[item[first]], text_of[at[first]]
        good = (item[first] == item[last]) & (text == text_of[at[last]]) & (at[last] - at[first] < 2 * reach + WINDOW)
        first, last, reach, text = first[good], last[good], reach[good], text[good]
        # Windows whose surroundings hold both ends; a text's first and last windows reach to its ends.
        of_text = np.searchsorted(own, np.arange(len(bounds)))
        low = np.clip(np.searchsorted(begin, at[last] - reach - WINDOW + 1), of_text[text], of_text[text + 1] - 1)
        high = np.minimum(np.searchsorted(begin, at[first] + reach, side="right"), of_text[text + 1])
        item, low, high = item[first][high > low], low[high > low], high[high > low]
        if not len(item):
            return []
        fresh = np.append(True, (item[1:] != item[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        item, low, count = item[fresh], low[fresh], (high - low)[fresh]
        window = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, window = np.divmod(np.unique(np.repeat(item, count) * len(own) + window), len(own))
        # Neighbouring windows are taken together, over half the item's length at most.
        text, reach = own[window], self.lengths[item]
        part = (begin[window] - bounds[text]) // (reach // 2 + 1)
        heads = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (part[1:] != part[:-1])))
        tails = np.append(heads[1:], len(item)) - 1
        item, text, reach = item[heads], text[heads], reach[heads]
        a = np.maximum(bounds[text], begin[window[heads]] - reach)
        b = np.minimum(bounds[text + 1], end[window[tails]] + reach)
        # A word counts no more often than it stands among the item's rarest.
        low = np.searchsorted(key, item * total + a)
        count = np.searchsorted(key, item * total + b) - low
        held = spot[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        pair, times = np.unique(np.repeat(np.arange(len(item)), count) * len(self.times) + held, return_counts=True)
        group, held = np.divmod(pair, len(self.times))
        enough = np.bincount(group, np.minimum(times, self.times[held]), minlength=len(item)) >= self.least_hits[item]
        return list(zip(*(x[enough].tolist() for x in (text, item, a, b, window[heads], window[tails])), strict=True))


def common_words(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bits of one integer standing for the n words of an item."""
    row = full = (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


@lru_cache(maxsize=4)
def _block(uri: str) -> Block:
    return Block(uri)


def fit_blocks(docs: DataFrame, benchmark: DataFrame) -> list[str]:
    """Write a model for each block of ``benchmark(item_id, text)``; returns their places."""
    spark = docs.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "latent")
    # A block is a file of at most so many items, whatever their ids.
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    count = items.count()
    if not count:
        return []
    place, even = f"{folder}/items", -(-count // -(-count // ITEMS_PER_BLOCK))
    items.coalesce(max(1, count // (64 * ITEMS_PER_BLOCK))).write.option("maxRecordsPerFile", even).parquet(place)
    held = spark.read.schema(items.schema).parquet(place)
    number = {name.rsplit("/", 1)[-1]: k for k, name in enumerate(sorted(held.inputFiles()))}
    numbers = spark.createDataFrame([(k, n) for n, k in number.items()], "block int, file string")
    dealt = held.select("item_id", "text", F.substring_index(F.input_file_name(), "/", -1).alias("file")).join(F.broadcast(numbers), "file").select("block", "item_id", "text")  # a row for each block

    def prepare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        h, bounds = _words(group.column("text").combine_chunks())
        full = np.flatnonzero(np.diff(bounds))
        block = group.column("block")[0].as_py()
        if not len(full):
            return pa.table({"block": pa.array([], pa.int32()), "uri": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "words": pa.array([], pa.list_(pa.int64()))})
        passages = [(k, h[bounds[k] + a : bounds[k] + z]) for k in full for a, z in cuts(int(bounds[k + 1] - bounds[k]))]
        ids = group.column("item_id").take(pa.array(full))
        vocabulary = np.unique(h)
        uri = _save(
            f"{folder}/items-{block}-{uuid.uuid4().hex}.npz", vocabulary=vocabulary, words=np.concatenate([h[bounds[k] : bounds[k + 1]] for k in full]), at=np.cumsum([0, *np.diff(bounds)[full]]),
            ids=ids.fill_null(0).to_numpy().astype(np.int64), known=np.array(ids.is_valid().to_pylist(), bool), item_of=np.searchsorted(full, [k for k, _ in passages]),
            flat=np.concatenate([w for _, w in passages]), cut=np.cumsum([0, *(len(w) for _, w in passages)]))
        return pa.table({"block": pa.array([block] * len(passages), pa.int32()), "uri": [uri] * len(passages), "size": pa.array([len(vocabulary)] * len(passages), pa.int32()), "words": pa.array([w.view(np.int64) for _, w in passages], pa.list_(pa.int64()))})

    prepared = written(dealt.groupBy("block").applyInArrow(prepare, "block int, uri string, size int, words array<long>"), "passages")
    blocks = {r["block"]: (r["uri"], r["size"]) for r in prepared.select("block", "uri", "size").distinct().collect()}  # a row for each block
    if not blocks:
        return []
    idf, count = inverse_frequencies(docs)
    sums = corpus_sums(docs, blocks, idf)
    spaces = randomised_svd(prepared.select("block", "words"), sums, min(1.0, CORPUS_WEIGHT / max(count, 1)), {k: uri for k, (uri, _) in blocks.items()}, idf, MAX_RANK, folder)
    weights = spark.sparkContext.broadcast(idf)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                model = _load(uri)
                passages = [model["flat"][a:b].view(np.int64) for a, b in zip(model["cut"][:-1], model["cut"][1:], strict=True)]
                space = model.pop("basis")
                images = _matrix(passages, weights.value, HashTable(model["vocabulary"]), len(space)) @ space
                norms = np.linalg.norm(images, axis=1, keepdims=True)
                images = (images / np.where(norms > 0, norms, 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([_save(f"{folder}/block-{uuid.uuid4().hex}.npz", **model, space=space.astype(np.float32), images=images, idf=weights.value)])], names=["uri"])

    done = written(spark.createDataFrame([(u,) for u in spaces.values()], "uri string").mapInArrow(finish, "uri string"), "blocks")
    return sorted(r["uri"] for r in done.collect())


FOUND = "doc_id long, item_id long, cosine double, lcs_share double"


def contaminated(docs: DataFrame, places: list[str]) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share) for each row of ``docs`` and each item it contains."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for a, b in chunks_of(batch.column(1)):
                h, bounds = _words(batch.column(1).slice(a, b - a))
                for uri in places:
                    block = _block(uri)
                    rows += [(ids[a + t], block.ids[i], c, s) for t, i, c, s in block.search(h, bounds)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs_share"])

    return docs.select("doc_id", "text").mapInArrow(search, FOUND)


def is_contaminated(text: Column | str, places: list[str]) -> Column:
    """Whether a text contains any item."""

    @F.arrow_udf(T.BooleanType())
    def search(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for a, b in chunks_of(texts):
            h, bounds = _words(texts.slice(a, b - a))
            for uri in places:
                for t, *_ in _block(uri).search(h, bounds):
                    out[a + t] = True
        return pa.array(out)

    return search(text)


def keep_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they were."""
    places = fit_blocks(docs, benchmark)
    return docs.filter(~is_contaminated("text", places)) if places else docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return contaminated(docs, fit_blocks(docs, documents(spark, sf_dir, "benchmark")))
