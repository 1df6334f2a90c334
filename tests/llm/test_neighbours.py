"""Nearest neighbours against a full search."""

import numpy as np
import pytest
from pyspark.sql import types as T

from quillon.llm import neighbours

FIELDS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("q", T.StringType()), T.StructField("uid", T.StringType()), T.StructField("score", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", None, "y") for i, v in rows], FIELDS)


def full(rows, k=20, every=20):
    """Every query against all others, with plain sums."""
    held = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        held[i] = min(held.get(i, v), v)
    out = {}
    for i, q in held.items():
        if i % every == 0:
            scored = []
            for j, v in held.items():
                if j != i:
                    s = 0.0
                    for a, b in zip(q, v):
                        s += a * b
                    scored.append((-s, j))
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, truth):
    hits = sum(len({j for j, _ in found.get(i, [])} & {j for j, _ in t}) for i, t in truth.items())
    return hits / max(1, sum(map(len, truth.values())))


def test_edges(spark):
    rows = [(0, [1.0, 2.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [-1.0, 0.5]), (-20, [3.0, 1.0, 9.0]), (7, [1.0]), (40, [5.0, 5.0])]
    assert got(neighbours.nearest(table(spark, rows))) == full([(i, v and v + [0.0] * (3 - len(v))) for i, v in rows])


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(20, [0.0])], [(20, [2.0])]])
def test_few(spark, rows):
    out = neighbours.nearest(table(spark, rows))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and not out.collect()


def test_equal_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [0.6, 0.8] if i % 3 else rng.standard_normal(2).tolist()) for i in range(400)]
    found, truth = got(neighbours.nearest(table(spark, rows))), full(rows)
    assert found.keys() == truth.keys()
    for i in truth:
        if i % 3:
            assert found[i] == truth[i]
    assert recall(found, truth) >= 0.95


@pytest.mark.parametrize("kind", ["sphere", "norms", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 24))
    if kind == "clusters":
        x = rng.standard_normal((60, 24))[rng.integers(60, size=4000)] + 0.25 * x
    if kind != "norms":
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        x *= rng.lognormal(0, 0.5, 4000)[:, None]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found, truth = got(neighbours.nearest(table(spark, rows))), full(rows)
    assert recall(found, truth) >= 0.9
    scores = {(i, j): s for i, t in truth.items() for j, s in t}
    assert all(s == scores.get((i, j), s) for i, t in found.items() for j, s in t)


def test_split_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_UNITS", 16)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((600, 4)) * 0.05 + 1).tolist())]
    assert recall(got(neighbours.nearest(table(spark, rows))), full(rows)) >= 0.9


def test_buckets_come_in_order_of_chance():
    hashes = neighbours.Hashes(8, 1000, 1.0)
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((3, 8))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    owner, floors = hashes.visits(rows, np.full(3, 0.5), 0)
    assert set(owner) == {0, 1, 2} and floors.shape[1] == hashes.floors
    more, _ = hashes.visits(rows, np.full(3, 0.95), 0)
    assert len(more) < len(owner)
