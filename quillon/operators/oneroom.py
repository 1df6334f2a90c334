"""Graphs of a few edges, finished by one task: linear algorithms on arrays.

Iterative operators walk in rounds, which suits large graphs; what is left of
at most ``ONE_TASK`` edges is settled here at once, with the same result. The
edges are counted before, so no task ever holds more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ONE_TASK = 200_000


def in_one_task(edges: DataFrame, work: Callable[[np.ndarray, np.ndarray, pa.Array], list[pa.Array]], schema: str) -> DataFrame:
    """Rows of ``work(a, b, names)`` on all of ``edges(a, b)``: its ends as places in the sorted names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ends = pa.concat_arrays([c for k in (0, 1) for c in table.column(k).chunks])
        names = ends.unique()
        names = names.take(pc.sort_indices(names))
        place = pc.index_in(ends, value_set=names).to_numpy()
        rows = work(place[: table.num_rows], place[table.num_rows :], names)
        if len(rows[0]):
            yield pa.RecordBatch.from_arrays(list(rows), names=[f.strip().split(" ")[0] for f in schema.split(",")])

    return edges.coalesce(1).mapInArrow(run, schema)


def components(a: np.ndarray, b: np.ndarray, names: pa.Array) -> list[pa.Array]:
    """(node, label): each name and the smallest of its component."""
    parent = list(range(len(names)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        else:
            parent[x] = y
    for x in range(len(parent)):  # a parent is never larger, so it is settled before
        parent[x] = parent[parent[x]]
    return [names, names.take(pa.array(parent))]


def _lists(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(a, kind="stable")
    return b[order], np.searchsorted(a[order], np.arange(n + 1))


def cyclic(a: np.ndarray, b: np.ndarray, names: pa.Array) -> list[pa.Array]:
    """(symbol): names that reach themselves, by strongly connected parts (Tarjan's, without recursion)."""
    n = len(names)
    to, at = _lists(a, b, n)
    to, at = to.tolist(), at.tolist()
    index, low, on, out = [-1] * n, [0] * n, [False] * n, [False] * n
    for x in a[a == b].tolist():
        out[x] = True
    stack: list[int] = []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, at[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            x, k = work.pop()
            if k < at[x + 1]:
                work.append((x, k + 1))
                y = to[k]
                if index[y] < 0:
                    index[y] = low[y] = count
                    count += 1
                    stack.append(y)
                    on[y] = True
                    work.append((y, at[y]))
                elif on[y]:
                    low[x] = min(low[x], index[y])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[x])
            if low[x] == index[x]:
                part = []
                while True:
                    y = stack.pop()
                    on[y] = False
                    part.append(y)
                    if y == x:
                        break
                if len(part) > 1:
                    for y in part:
                        out[y] = True
    return [names.filter(pa.array(out, pa.bool_()))]


def levels(a: np.ndarray, b: np.ndarray, names: pa.Array) -> list[pa.Array]:
    """(name, wave): 1 where nothing is needed, else one more than the last of what is needed; -1 on or behind cycles. ``a`` needs ``b``."""
    n = len(names)
    users, at = _lists(b, a, n)
    left = np.bincount(a, minlength=n)
    wave = np.full(n, -1, np.int64)
    ready, k = np.flatnonzero(left == 0), 0
    while len(ready):
        k += 1
        wave[ready] = k
        freed = np.concatenate([users[at[x] : at[x + 1]] for x in ready.tolist()])
        if not len(freed):
            break
        np.subtract.at(left, freed, 1)
        freed = np.unique(freed)
        ready = freed[left[freed] == 0]
    return [names, pa.array(wave.astype(np.int32))]
