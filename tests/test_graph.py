"""Graph operators against plain Python on random graphs, and the cases that trip them."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.operators import graph as G
from quillon.operators import components
from quillon.operators.components import connected_components

E = "caller string, callee string"


def frame(spark, edges):
    return spark.createDataFrame(list(edges), E)


def reach_of(edges, start):
    seen, todo = {}, [(start, 0)]
    while todo:
        x, d = todo.pop(0)
        for a, b in edges:
            if a == x and b not in seen:
                seen[b] = d + 1
                todo.append((b, d + 1))
    return seen


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(2)
    return sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)})


def test_reach_and_closure(spark, graph):
    df = frame(spark, [*graph, *graph, (None, "n1"), ("n1", None)])
    start = spark.createDataFrame([("n1",), ("n2",)], "root string")
    for depth in (2, 7, None):
        got = {(r["root"], r["node"]): r["depth"] for r in G.reach(df, start, depth).collect()}
        want = {(s, n): d for s in ("n1", "n2") for n, d in reach_of(graph, s).items() if (depth is None or d <= depth) and n != s}
        assert {k: v for k, v in got.items() if k[0] != k[1]} == want
    closed = {(r["caller"], r["callee"]) for r in G.closure(df).collect()}
    assert closed == {(a, b) for a in {x for e in graph for x in e} for b in reach_of(graph, a)}
    assert {r["symbol"] for r in G.on_cycles(df).collect()} == {a for a, b in closed if a == b}


def test_self_edge_and_root(spark):
    df = frame(spark, [("a", "a"), ("a", "b")])
    start = spark.createDataFrame([("a",)], "root string")
    assert {r["node"] for r in G.reach(df, start, 2).collect()} == {"b"}
    assert {r["node"] for r in G.reach(df, start, 2, include_root=True).collect()} == {"a", "b"}


def test_paths(spark):
    df = frame(spark, [("A", "B"), ("B", "C"), ("A", "X"), ("X", "C"), ("C", "D")])
    assert G.shortest_paths(df, "A", "C").collect()[0]["path"] == ["A", "B", "C"]
    assert G.shortest_paths(df, "D", "A").count() == 0
    assert G.shortest_paths(df, "A", "A").collect()[0]["path"] == ["A"]
    only_x = spark.createDataFrame([("X",)], "name string")
    assert G.shortest_paths(df, "A", "C", only_x).collect()[0]["path"] == ["A", "X", "C"]


@pytest.mark.parametrize("few", [0, 200_000])
def test_waves(spark, monkeypatch, few):
    monkeypatch.setattr(G, "ONE_TASK", few)
    nodes = spark.createDataFrame([(x,) for x in "abcdxyz"], "name string")
    df = frame(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("d", "elsewhere"), ("c", "c")])
    got = {r["name"]: r["wave"] for r in G.waves(nodes, df).collect()}
    assert got == {"c": 1, "d": 1, "b": 2, "a": 3, "x": -1, "y": -1, "z": -1}


@pytest.mark.parametrize("few", [0, 200_000])
def test_cycles_by_brute_force(spark, monkeypatch, few):
    """Strongly connected parts in rounds and in one task."""
    monkeypatch.setattr(G, "ONE_TASK", few)
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(48)] + [("s", "s"), ("t", "n01")]
    reach = {a: {b for x, b in edges if x == a} for e in edges for a in e}
    for _ in reach:
        for a in reach:
            reach[a] |= {c for b in reach[a] for c in reach.get(b, ())}
    got = {r["symbol"] for r in G.on_cycles(frame(spark, edges)).collect()}
    assert got == {a for a in reach if a in reach[a]} and 2 < len(got) < 40
    assert G.on_cycles(frame(spark, edges[:0] or [("a", "b")])).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_waves_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(G, "ONE_TASK", few)
    rng = random.Random(9)
    edges = [(f"n{a}", f"n{rng.randrange(a)}") for a in range(1, 14) for _ in range(2)] + [("n5", "c1"), ("c1", "c2"), ("c2", "c1")]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    want = {}
    while True:
        ready = [x for x in nodes if x not in want and all(b in want for a, b in edges if a == x)]
        if not ready:
            break
        want |= {x: 1 + max([want[b] for a, b in edges if a == x], default=0) for x in ready}
    got = {r["name"]: r["wave"] for r in G.waves(spark.createDataFrame([(x,) for x in nodes], "name string"), frame(spark, edges)).collect()}
    assert got == {x: want.get(x, -1) for x in nodes}


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "ONE_TASK", few)
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    real = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in real}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hub_is_the_highest_degree(spark):
    got = {r["symbol"]: (r["hub"], r["size"]) for r in G.labelled_components(frame(spark, [("a", "m"), ("b", "m"), ("x", "y")])).collect()}
    assert got == {"a": ("m", 3), "b": ("m", 3), "m": ("m", 3), "x": ("x", 2), "y": ("x", 2)}


def test_entry_points(spark):
    f = spark.createDataFrame([("main", "app.py"), ("used", "app.py"), ("__init__", "app.py"), ("test_x", "tests/test_a.py"), ("main", "a.py")], "name string, file_path string")
    c = spark.createDataFrame([("Thing", "t.py")], "name string, file_path string")
    rows = {r["name"]: (r["file_path"], r["out_degree"]) for r in G.entry_points(f, c, frame(spark, [("main", "pkg.mod.used"), ("main", "usedX")])).collect()}
    assert rows == {"main": ("a.py", 2), "Thing": ("t.py", 0)}


@pytest.mark.parametrize("name, keys", [("a.b.c", ["a.b.c", "b.c", "c"]), ("f_x", ["f_x"]), ("M.F", ["M.F", "F"])])
def test_suffix_keys(spark, name, keys):
    row = spark.createDataFrame([(name,)], "n string").select(N.suffix_keys("n").alias("k"), N.after_first_dot("n").alias("f"), N.after_last_dot("n").alias("l")).first()
    assert row["k"] == keys and row["f"] == (name.split(".", 1)[-1]) and row["l"] == name.rsplit(".", 1)[-1]


def test_names(spark):
    one = spark.createDataFrame([("self.x.y", "a::b.c", "https://h/api/<id>/?q=1", "OrderLineStore")], "a string, b string, u string, c string").select(
        N.is_noise("a").alias("noise"), N.normalize_symbol("b").alias("bare"), N.normalize_url("u").alias("url"), N.snake_case("c").alias("snake"), N.concept_base("c").alias("base"),
        N.url_matches(F.lit("/api/7"), F.lit("/api/*")).alias("m"), N.url_matches(F.lit("/api/7/x"), F.lit("/api/*")).alias("n")).first()
    assert tuple(one) == (True, "c", "/api/*", "order_line_store", "OrderLine", True, False)


def test_co_occurring_pairs_are_counted_in_tasks(spark, monkeypatch):
    """Counts equal all pairs by brute force, in several blocks, and no join pairs a caller's callees."""
    rng = random.Random(5)
    calls = [(f"c{rng.randrange(40)}", f"s{min(rng.randrange(60), rng.randrange(60))}") for _ in range(900)] + [("c1", None), (None, "s1"), ("c90", "s1"), ("c91", "s2")]
    edges = spark.createDataFrame(calls, "caller string, callee string")
    of = {}
    for a, b in calls:
        if a and b:
            of.setdefault(a, set()).add(b)
    monkeypatch.setattr(G, "PAIRS_AT_ONCE", 500)
    for least in (1, 3):
        count = {}
        for used in of.values():
            for a in used:
                for b in used:
                    if a < b:
                        count[a, b] = count.get((a, b), 0) + 1
        got = G.co_occurring_callees(edges, least)
        rows = [(r["callee_a"], r["callee_b"], r["callers"]) for r in got.collect()]
        assert sorted(rows) == sorted((a, b, n) for (a, b), n in count.items() if n >= least) and rows
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not any("Join" in line and "caller" in line for line in plan.splitlines())
    assert G.co_occurring_callees(edges.limit(0)).count() == 0
