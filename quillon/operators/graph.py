"""Graph operators on edges(caller, callee, ...).

Edges are a multigraph: rows repeat unless an operator says distinct, and rows
with a null end are kept by the table and dropped here. Traversals advance one
distinct frontier at a time, so cycles cost nothing and work is bounded by the
edges touched; each hop ends in a written table, and only emptiness is asked by
the driver. Walks of up to three hops are one plan without any action.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.shared import dealt, written
from .oneroom import ONE_TASK, cyclic, in_one_task, levels

UNROLLED = 3


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct (caller, callee) without null ends."""
    return edges.filter("caller IS NOT NULL AND callee IS NOT NULL").select("caller", "callee").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))


def undirected(edges: DataFrame) -> DataFrame:
    p = edges.select("caller", "callee")
    return pairs(p.unionByName(reversed_edges(p)))


# Degrees and neighbours


def endpoints(edges: DataFrame) -> DataFrame:
    """(symbol) once for each edge end."""
    return edges.select(F.explode(F.array("caller", "callee")).alias("symbol")).filter("symbol IS NOT NULL")


def degree(edges: DataFrame) -> DataFrame:
    """In- and out-edges of each symbol, repeated edges counted, a self-edge twice."""
    return endpoints(edges).groupBy("symbol").agg(F.count(F.lit(1)).alias("degree"))


def hotspots(edges: DataFrame, n: int = 10) -> DataFrame:
    return degree(edges).orderBy(F.desc("degree"), "symbol").limit(n)


def neighbours(edges: DataFrame) -> DataFrame:
    """Sorted distinct callees and callers of every symbol."""
    p = pairs(edges)
    out = p.groupBy(F.col("caller").alias("symbol")).agg(F.sort_array(F.collect_set("callee")).alias("callees"))
    into = p.groupBy(F.col("callee").alias("symbol")).agg(F.sort_array(F.collect_set("caller")).alias("callers"))
    return out.join(into, "symbol", "full_outer")


def adjacency(edges: DataFrame) -> DataFrame:
    return pairs(edges).groupBy("caller").agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def unique_counts(edges: DataFrame, of: str, n: int | None = None) -> DataFrame:
    """Distinct partners of each ``of`` ('callee' or 'caller'), the most first."""
    other = "caller" if of == "callee" else "callee"
    counted = pairs(edges).groupBy(F.col(of).alias("symbol")).agg(F.count(other).alias("partners"))
    return counted.orderBy(F.desc("partners"), "symbol").limit(n) if n else counted


def hot_callers(edges: DataFrame, functions: DataFrame, n: int = 20) -> DataFrame:
    """Functions by distinct callers of their resolved in-edges."""
    calls = edges.filter("resolved").groupBy(F.col("target_id").alias("name")).agg(F.countDistinct("caller").alias("callers"), F.count(F.lit(1)).alias("calls"))
    return calls.join(functions.select("name").distinct(), "name").orderBy(F.desc("callers"), F.desc("calls"), "name").limit(n)


# Traversals


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, include_root: bool = False) -> DataFrame:
    """(root, node, depth): what each root reaches and in how few hops.

    ``seeds(root)`` may be any number of roots, walked together. A root is in
    its own result only with ``include_root``. Without ``depth``, to the end.
    """
    step = pairs(edges)
    start = seeds.select("root", F.col("root").alias("node")).distinct()
    if depth is not None and depth <= UNROLLED:
        found = start.withColumn("depth", F.lit(0))
        front = found
        for k in range(1, depth + 1):
            front = front.join(step, front["node"] == step["caller"]).select("root", F.col("callee").alias("node"), F.lit(k).alias("depth")).distinct()
            found = found.unionByName(front)
        least = found.groupBy("root", "node").agg(F.min("depth").alias("depth"))
        return least if include_root else least.filter("depth > 0")
    step = written(step, "reach-edges")
    seen = front = written(start.withColumn("depth", F.lit(0)), "reach")
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        ahead = front.join(step, front["node"] == step["caller"]).select("root", F.col("callee").alias("node")).distinct()
        front = written(ahead.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(hop)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if include_root else seen.filter("depth > 0")


def closure(edges: DataFrame) -> DataFrame:
    """(caller, callee) of every pair joined by a path of one edge or more; a node pairs with itself on a cycle.

    Paths double each round. Of two halves one at least is new since the round
    before, so pairs that are long known aren't joined with each other again.
    """
    old, new = None, written(pairs(edges), "closure")
    while True:
        seen = new if old is None else old.unionByName(new)
        joined = lambda a, b: a.select("caller", F.col("callee").alias("mid")).join(b.select(F.col("caller").alias("mid"), "callee"), "mid").select("caller", "callee")
        ahead = joined(new, seen) if old is None else joined(new, seen).unionByName(joined(old, new))
        fresh = written(ahead.distinct().join(seen, ["caller", "callee"], "left_anti"), "closure")
        if fresh.isEmpty():
            return seen
        old, new = seen, fresh


def _trimmed(core: DataFrame, ends: str) -> tuple[DataFrame, int]:
    """The edges whose both ends have in- and out-edges, again and again until none goes; and their number."""
    count = core.count()
    while count > ONE_TASK:
        kept = core.join(core.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi").join(core.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi")
        core = written(kept.select("caller", "callee"), ends)
        before, count = count, core.count()
        if count == before:
            break
    return core, count


def _changed(rows: DataFrame) -> tuple:
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    return got["n"], got["h"]


def on_cycles(edges: DataFrame) -> DataFrame:
    """(symbol) of the nodes that reach themselves, by strongly connected parts.

    A large graph is trimmed of nodes that can't be on a cycle and coloured:
    each node takes the largest name that reaches it, and what leads back to a
    colour's own node within the colour is one part, which goes. What is left
    of a few edges is one task's. No pairs of nodes are held.
    """
    core, count = _trimmed(written(pairs(edges), "cycle-edges"), "cycle-edges")
    found = core.filter("caller = callee").select(F.col("caller").alias("symbol"))
    while count > ONE_TASK:
        colours = written(endpoints(core).distinct().withColumn("colour", F.col("symbol")), "colours")
        seen = _changed(colours)
        while True:
            given = core.join(colours.withColumnRenamed("symbol", "caller"), "caller").select(F.col("callee").alias("symbol"), "colour")
            colours = written(colours.unionByName(given).groupBy("symbol").agg(F.max("colour").alias("colour")), "colours")
            was, seen = seen, _changed(colours)
            if was == seen:
                break
        own = core.join(colours.select(F.col("symbol").alias("caller"), F.col("colour").alias("one")), "caller").join(colours.select(F.col("symbol").alias("callee"), F.col("colour").alias("two")), "callee")
        own = written(own.filter("one = two").select(F.col("callee").alias("symbol"), F.col("caller").alias("before"), F.col("one").alias("colour")), "colour-edges")
        parts = front = written(colours.filter("symbol = colour"), "parts")
        while not front.isEmpty():
            back = own.join(front, ["symbol", "colour"]).select(F.col("before").alias("symbol"), "colour").distinct()
            front = written(back.join(parts, ["symbol", "colour"], "left_anti"), "parts")
            parts = parts.unionByName(front)
        parts = written(parts, "parts")
        many = parts.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.unionByName(parts.join(many, "colour", "left_semi").select("symbol"))
        rest = core.join(parts.select(F.col("symbol").alias("caller")), "caller", "left_anti").join(parts.select(F.col("symbol").alias("callee")), "callee", "left_anti")
        core, count = _trimmed(written(rest.select("caller", "callee"), "cycle-edges"), "cycle-edges")
    return found.unionByName(in_one_task(core, cyclic, "symbol string")).distinct()


def shortest_paths(edges: DataFrame, source: str, target: str | None = None, through: DataFrame | None = None, depth: int = 30) -> DataFrame:
    """(node, path) of the shortest path from ``source``; of equals the smallest by names.

    ``through(name)`` restricts the nodes passed on the way; ``target`` alone is
    always allowed. The source's own path is itself.
    """
    step = pairs(edges)
    if through is not None:
        allowed = through.select(F.col("name").alias("callee")).distinct()
        if target is not None:
            allowed = allowed.unionByName(allowed.sparkSession.createDataFrame([(target,)], "callee string")).distinct()
        step = step.join(allowed, "callee", "left_semi").select("caller", "callee")
    step = written(step, "path-edges")
    spark = edges.sparkSession
    seen = front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    for _ in range(depth):
        ahead = front.join(step, front["node"] == step["caller"]).select(F.col("callee").alias("node"), F.concat("path", F.array("callee")).alias("path"))
        front = written(ahead.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"), "paths")
        seen = seen.unionByName(front)
        if front.isEmpty() or target is not None and not front.filter(F.col("node") == target).isEmpty():
            break
    return seen.filter(F.col("node") == target) if target is not None else seen


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, wave): a node's wave is after all it depends on; nodes on or behind cycles share the last, -1.

    ``edges(caller, callee)`` say that a caller depends on its callee; only
    edges between two different ``nodes(name)`` count.
    """
    left = written(nodes.select("name").distinct(), "waves")
    known = left.select(F.col("name").alias("callee"))
    needs = pairs(edges).filter("caller <> callee").join(known, "callee", "left_semi").join(left.select(F.col("name").alias("caller")), "caller", "left_semi")
    needs = written(needs.select("caller", "callee"), "waves-needs")
    done, wave = None, 0
    while (count := needs.count()) > ONE_TASK:
        wave += 1
        ready = written(left.join(needs.select(F.col("caller").alias("name")).distinct(), "name", "left_anti"), "waves-ready")
        if ready.isEmpty():
            break
        here = ready.withColumn("wave", F.lit(wave))
        done = here if done is None else done.unionByName(here)
        left = written(left.join(ready, "name", "left_anti"), "waves")
        needs = written(needs.join(ready.select(F.col("name").alias("callee")), "callee", "left_anti").select("caller", "callee"), "waves-needs")
    if count > ONE_TASK:  # all that is left is on or behind cycles
        rest = left.withColumn("wave", F.lit(-1))
    else:
        last = in_one_task(needs.select("caller", "callee"), levels, "name string, wave int")
        rest = left.join(last, "name", "left").select("name", F.when(F.col("wave") < 0, -1).otherwise(F.coalesce("wave", F.lit(1)) + wave).cast("int").alias("wave"))
    return rest if done is None else done.unionByName(rest)


def ball(edges: DataFrame, symbol: str, radius: int) -> DataFrame:
    """(node, depth) within ``radius`` undirected hops."""
    spark = edges.sparkSession
    return reach(undirected(edges), spark.createDataFrame([(symbol,)], "root string"), radius, include_root=True).select("node", "depth")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with both ends among ``nodes(node)``."""
    a, b = nodes.select(F.col("node").alias("caller")), nodes.select(F.col("node").alias("callee"))
    return pairs(edges).join(a, "caller", "left_semi").join(b, "callee", "left_semi").select("caller", "callee")


def bfs_callees(edges: DataFrame, root: str, max_depth: int = 3, max_nodes: int = 50, resolved_only: bool = False) -> DataFrame:
    """(node, depth) nearest first, at most ``max_nodes``: the cap is the operator's own report limit."""
    used = edges.filter("resolved") if resolved_only else edges
    found = reach(used, edges.sparkSession.createDataFrame([(root,)], "root string"), max_depth, include_root=True)
    return found.select("node", "depth").orderBy("depth", "node").limit(max_nodes)


def labelled_components(edges: DataFrame) -> DataFrame:
    """(symbol, hub, size): each node's component, named by its node of highest degree (of equals the smallest name)."""
    from .components import connected_components

    ids = written(endpoints(edges).distinct().withColumn("id", F.monotonically_increasing_id()), "component-ids")
    p = pairs(edges)
    numbered = p.join(ids.select(F.col("symbol").alias("caller"), F.col("id").alias("a")), "caller").join(ids.select(F.col("symbol").alias("callee"), F.col("id").alias("b")), "callee")
    labels = connected_components(numbered.select("a", "b"))
    placed = ids.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")).join(degree(edges), "symbol")
    placed = written(placed.select("symbol", "label", "degree"), "component-nodes")
    hubs = placed.groupBy("label").agg(F.max_by("symbol", F.struct("degree", F.lit(0))).alias("any"), F.max("degree").alias("top"), F.count(F.lit(1)).alias("size"))
    named = placed.join(hubs, "label").filter("degree = top").groupBy("label", "size").agg(F.min("symbol").alias("hub"))
    return placed.join(named, "label").select("symbol", "hub", "size")


# Names and modules


def known_callees(edges: DataFrame) -> DataFrame:
    """Distinct keys by which callees can be named: every dotted suffix."""
    return edges.filter("callee IS NOT NULL").select(F.explode(N.suffix_keys("callee")).alias("name")).distinct()


def calls_by_name(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(name, caller, ...edge) of edges whose callee is a function's name or ends in it behind a dot."""
    keyed = edges.filter("callee IS NOT NULL").select("*", F.explode(N.suffix_keys("callee")).alias("name"))
    return keyed.join(functions.select("name").distinct(), "name", "left_semi")


def entry_points(functions: DataFrame, classes: DataFrame, edges: DataFrame, exclude_tests: bool = True) -> DataFrame:
    """(name, file_path, out_degree) of what is never called: no dunders, one row per name, most outgoing calls first."""
    all_names = functions.select("name", "file_path").unionByName(classes.select("name", "file_path")).filter(~N.is_dunder("name"))
    if exclude_tests:
        all_names = all_names.filter(~N.is_test_path("file_path") & ~F.col("name").startswith("test_"))
    free = all_names.groupBy("name").agg(F.min("file_path").alias("file_path")).join(known_callees(edges), "name", "left_anti")
    out = pairs(edges).groupBy(F.col("caller").alias("name")).agg(F.count("callee").alias("n"))
    return free.join(out, "name", "left").select("name", "file_path", F.coalesce("n", F.lit(0)).alias("out_degree"))


def file_of_symbol(functions: DataFrame) -> DataFrame:
    """(name, file_path): the alphabetically first file of each name."""
    return functions.groupBy("name").agg(F.min("file_path").alias("file_path"))


def most_connected(edges: DataFrame, functions: DataFrame, n: int = 15) -> DataFrame:
    """Project functions by total degree, aliases with a dotted prefix merged, dunders left out."""
    bare = edges.select(N.after_last_dot("caller").alias("caller"), N.after_last_dot("callee").alias("callee"))
    return degree(bare).withColumnRenamed("symbol", "name").filter(~N.is_dunder("name")).join(file_of_symbol(functions), "name").orderBy(F.desc("degree"), "name").limit(n)


def file_clusters(edges: DataFrame, functions: DataFrame, min_edges: int = 3) -> DataFrame:
    """(file_a, file_b, calls) of unordered pairs of files with at least so many calls between them."""
    at = file_of_symbol(functions)
    named = edges.select(N.after_last_dot("caller").alias("caller"), N.after_last_dot("callee").alias("callee"))
    both = named.join(at.select(F.col("name").alias("caller"), F.col("file_path").alias("fa")), "caller").join(at.select(F.col("name").alias("callee"), F.col("file_path").alias("fb")), "callee")
    pairs_ = both.filter("fa <> fb").groupBy(F.least("fa", "fb").alias("file_a"), F.greatest("fa", "fb").alias("file_b")).agg(F.count(F.lit(1)).alias("calls"))
    return pairs_.filter(F.col("calls") >= min_edges)


def module_projection(edges: DataFrame) -> DataFrame:
    """Distinct pairs of different modules of two segments."""
    m = edges.select(N.module_of("caller").alias("caller"), N.module_of("callee").alias("callee"))
    return pairs(m).filter("caller <> callee")


def first_segment_projection(edges: DataFrame) -> DataFrame:
    """Pairs of different first segments, one row per edge."""
    return edges.select(N.first_segment("caller").alias("caller"), N.first_segment("callee").alias("callee")).filter("caller <> callee")


def module_stats(edges: DataFrame) -> DataFrame:
    """(module, fan_in, fan_out, total) over the module projection."""
    p = module_projection(edges)
    out = p.groupBy(F.col("caller").alias("module")).agg(F.count("callee").alias("fan_out"))
    into = p.groupBy(F.col("callee").alias("module")).agg(F.count("caller").alias("fan_in"))
    both = out.join(into, "module", "full_outer").select("module", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return both.withColumn("total", F.col("fan_in") + F.col("fan_out"))


def module_cycles(edges: DataFrame) -> DataFrame:
    return on_cycles(module_projection(edges)).withColumnRenamed("symbol", "module")


def rank_modules(edges: DataFrame) -> DataFrame:
    """2 x fan-in + fan-out + 5 if on a cycle."""
    marked = module_stats(edges).join(module_cycles(edges).withColumn("in_cycle", F.lit(True)), "module", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    return marked.select("module", "fan_in", "fan_out", "in_cycle", (2 * F.col("fan_in") + F.col("fan_out") + 5 * F.col("in_cycle").cast("int")).alias("score"))


def impacted_modules(edges: DataFrame) -> DataFrame:
    """(module, impacted): how many modules reach each module, itself only on a cycle."""
    return closure(module_projection(edges)).groupBy(F.col("callee").alias("module")).agg(F.count("caller").alias("impacted"))


def risk_scores(edges: DataFrame) -> DataFrame:
    """3 x fan-in + 2 x fan-out + 2 x impacted modules + 10 if on a cycle; both of the last from one closure."""
    reached = written(closure(module_projection(edges)).groupBy(F.col("callee").alias("module")).agg(F.count("caller").alias("impacted"), F.max(F.col("caller") == F.col("callee")).alias("in_cycle")), "impacted")
    r = module_stats(edges).join(reached, "module", "left").na.fill(0, ["impacted"]).na.fill(False, ["in_cycle"])
    return r.select("module", "impacted", (3 * F.col("fan_in") + 2 * F.col("fan_out") + 2 * F.col("impacted") + 10 * F.col("in_cycle").cast("int")).alias("risk"))


def subsystems(edges: DataFrame, modules: DataFrame, builtins: DataFrame | None = None) -> DataFrame:
    """(module, targets, cross_edges): modules by map, else by the map of the last segment, else two segments."""
    skip = edges if builtins is None else edges.join(builtins.select(F.col("symbol").alias("callee")), "callee", "left_anti")

    def placed(df: DataFrame, end: str) -> DataFrame:
        full = modules.select(F.col("name").alias(end), F.col("module").alias(f"{end}_full"))
        last = modules.select(F.col("name").alias(f"{end}_key"), F.col("module").alias(f"{end}_last"))
        df = df.withColumn(f"{end}_key", N.after_last_dot(end)).join(full, end, "left").join(last, f"{end}_key", "left")
        return df.withColumn(f"{end}_module", F.coalesce(f"{end}_full", f"{end}_last", N.module_of(end)))

    both = placed(placed(skip.filter("caller IS NOT NULL AND callee IS NOT NULL").select("caller", "callee"), "caller"), "callee").filter("caller_module <> callee_module")
    return both.groupBy(F.col("caller_module").alias("module")).agg(F.sort_array(F.collect_set("callee_module")).alias("targets"), F.count(F.lit(1)).alias("cross_edges"))


def score_risk(edges: DataFrame, mutations: DataFrame) -> DataFrame:
    """(symbol, callers, callees, mutations, risk): HOT from 5 callers, or from 3 with mutations; WARM from 2, or with mutations; else SAFE."""
    p = pairs(edges.select(N.after_last_dot("caller").alias("caller"), N.after_last_dot("callee").alias("callee")))
    out = p.groupBy(F.col("caller").alias("symbol")).agg(F.count("callee").alias("callees"))
    into = p.groupBy(F.col("callee").alias("symbol")).agg(F.count("caller").alias("callers"))
    changed = mutations.groupBy(F.col("function_name").alias("symbol")).agg(F.count(F.lit(1)).alias("mutations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = out.join(into, "symbol", "full_outer").join(changed, "symbol", "left").select("symbol", zero("callers"), zero("callees"), zero("mutations"))
    n, m = F.col("callers"), F.col("mutations")
    return rows.withColumn("risk", F.when((n >= 5) | ((n >= 3) & (m > 0)), "HOT").when((n >= 2) | (m > 0), "WARM").otherwise("SAFE"))


def blast_radius(edges: DataFrame, functions: DataFrame, file_path: str) -> DataFrame:
    """(name, callers) of a file's functions, by distinct callers outside of the file."""
    own = functions.filter(F.col("file_path") == file_path).select("name").distinct()
    calls = calls_by_name(edges.filter(F.col("caller_file") != file_path), own)
    counted = calls.groupBy("name").agg(F.countDistinct("caller").alias("callers"))
    return own.join(counted, "name", "left").select("name", F.coalesce("callers", F.lit(0)).alias("callers"))


def find_symbols(functions: DataFrame, edges: DataFrame, pattern: str, n: int = 20) -> DataFrame:
    """Functions whose name contains a pattern, by how many edges name them with any prefix or any suffix."""
    wanted = functions.filter(F.lower("name").contains(pattern.lower())).groupBy("name").agg(F.min("file_path").alias("file_path"))
    keys = F.array_distinct(F.concat(N.suffix_keys("callee"), N.prefix_keys("callee")))
    uses = edges.filter("callee IS NOT NULL").select(F.explode(keys).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    return wanted.join(uses, "name", "left").select("name", "file_path", F.coalesce("uses", F.lit(0)).alias("uses")).orderBy(F.desc("uses"), "name").limit(n)


#: Pairs of callees that a task counts at a time.
PAIRS_AT_ONCE = 4_000_000


def co_occurring_callees(edges: DataFrame, min_callers: int = 3) -> DataFrame:
    """(callee_a, callee_b, callers): pairs that at least so many distinct callers use both; a callee of fewer callers is in none and goes first.

    Pairs are never rows. Each caller's callees are a list from rare to common,
    and each of them but the last is posted with those after it; a task counts
    the pairs of the callees dealt to it. A common callee is posted with more
    common ones alone, so its postings stay short.
    """
    p = written(pairs(edges), "callee-pairs")
    common = p.groupBy("callee").agg(F.count("caller").alias("n")).filter(F.col("n") >= min_callers)
    common = written(common.withColumn("id", F.monotonically_increasing_id()), "common-callees")
    lists = p.join(dealt(common), "callee").groupBy("caller").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda s: s["id"]).alias("ids")).filter(F.size("ids") > 1)
    lists = written(lists.select("ids"), "callee-lists")
    size = F.size("ids").cast("long")
    total = lists.agg(F.sum(size * (size - 1) / 2).alias("n")).first()["n"] or 0
    posted = lists.select("ids", F.posexplode("ids").alias("at", "a")).filter(F.col("at") < F.size("ids") - 1).select("a", F.slice("ids", F.col("at") + 2, F.size("ids")).alias("more"))

    def counted(group: pa.Table) -> pa.Table:
        more = group.column("more").combine_chunks()
        kinds, a = np.unique(np.repeat(group.column("a").to_numpy(), more.value_lengths().to_numpy()), return_inverse=True)
        others, b = np.unique(more.flatten().to_numpy(), return_inverse=True)
        pair, n = np.unique(a * len(others) + b, return_counts=True)
        pair, n = pair[n >= min_callers], n[n >= min_callers]
        return pa.table({"a": kinds[pair // len(others)], "b": others[pair % len(others)], "callers": n.astype(np.int64)})

    blocks = max(1, int(-(-total // PAIRS_AT_ONCE)))
    found = posted.groupBy(F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("block")).applyInArrow(counted, "a long, b long, callers long")
    name = lambda c: common.select(F.col("id").alias(c), F.col("callee").alias(f"{c}_name"))
    named = found.join(dealt(name("a")), "a").join(dealt(name("b")), "b")
    return named.select(F.least("a_name", "b_name").alias("callee_a"), F.greatest("a_name", "b_name").alias("callee_b"), "callers")


def symbol_rank(symbols: DataFrame, seeds: Column, edges: DataFrame, n: int = 40) -> DataFrame:
    """Symbols by 5 for a seed, 2 for each seed's tail contained, and a tenth of the degree up to 3; the first n. Degrees count distinct callees and callers."""
    placed = symbols.join(degree(pairs(edges)), "symbol", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    tails = F.size(F.filter(F.transform(seeds, lambda s: F.element_at(F.split(s, r"\."), -1)), lambda t: F.col("symbol").contains(t)))
    score = 5 * F.array_contains(seeds, F.col("symbol")).cast("int") + 2 * tails + F.least(F.lit(0.1) * F.col("degree"), F.lit(3.0))
    return placed.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "symbol").limit(n)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__place = 1").drop("__place")
