"""Operators on unfinished code: stubs, their callers, chains, interfaces, features and conventions.

Functions are matched to calls by every dotted suffix of the callee, as an
equi-join; a function that several rows name counts as a stub if any row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.shared import dealt, written
from . import graph as G

#: Pairs that a task of ``siblings`` gives out, about, and stubs that are given out in turn for one function.
PAIRS_A_TASK, STUBS_A_BLOCK = 1 << 25, 64


def by_name(functions: DataFrame) -> DataFrame:
    """(name, is_stub, file_path), one row per name."""
    return functions.groupBy("name").agg(F.bool_or("is_stub").alias("is_stub"), F.min("file_path").alias("file_path"))


def siblings(functions: DataFrame) -> DataFrame:
    """(name, sibling): each stub with each implemented function of its file.

    The pairs grow with the square of a file's functions, so tasks are dealt by
    the pairs that they give out, not by the names that they read, and a large
    file is cut into slices of its functions. Stubs come in blocks, and a task
    gives a block out for one function after the other: in columns, a sibling
    is a run and the names repeat at a short distance, so a file of pairs takes
    a small part of their bytes.
    """
    spark = functions.sparkSession
    known = written(by_name(functions).filter("name IS NOT NULL AND file_path IS NOT NULL"), "known-functions")
    files = known.groupBy("file_path").agg(F.count_if("is_stub").alias("stubs"), F.count_if(~F.col("is_stub")).alias("live")).filter("stubs > 0 AND live > 0")
    files = files.withColumn("pairs", F.col("stubs") * F.col("live"))
    sized = files.select("file_path", F.ceil(F.col("stubs") / STUBS_A_BLOCK).alias("blocks"), F.ceil(F.col("pairs") / PAIRS_A_TASK).alias("slices"))
    pairs = files.agg(F.sum("pairs")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
    of = lambda n: F.pmod(F.xxhash64("name"), F.col(n))
    stubs = known.filter("is_stub").join(sized, "file_path").groupBy("file_path", "slices", of("blocks").alias("block")).agg(F.collect_list("name").alias("names"))
    stubs = stubs.select("file_path", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "names")
    live = known.filter("NOT is_stub").join(sized, "file_path").select("file_path", of("slices").alias("slice"), F.col("name").alias("sibling"))
    even = lambda df: dealt(df.repartition(tasks, "file_path", "slice"))
    return even(stubs).join(even(live), ["file_path", "slice"]).select(F.explode("names").alias("name"), "sibling")


def calls(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, name, caller_stub, callee_stub): distinct calls between known functions; an unknown caller's flag is null."""
    known = by_name(functions)
    keyed = edges.filter("callee IS NOT NULL").select("caller", F.explode(N.suffix_keys("callee")).alias("name")).distinct()
    named = keyed.join(known.select("name", F.col("is_stub").alias("callee_stub")), "name")
    return named.join(known.select(F.col("name").alias("caller"), F.col("is_stub").alias("caller_stub")), "caller", "left").select("caller", "name", "caller_stub", "callee_stub")


def known_calls(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``calls`` as a table, for operators that use them more than once."""
    return written(calls(functions, edges), "calls")


def frontier(functions: DataFrame, edges: DataFrame, mode: str = "all", known: DataFrame | None = None) -> DataFrame:
    """(caller, name, mode): calls of stubs by implemented functions ('direct'), by stubs ('chain'), or both."""
    rows = (calls(functions, edges) if known is None else known).filter("callee_stub AND caller_stub IS NOT NULL")
    rows = rows.select("caller", "name", F.when(F.col("caller_stub"), "chain").otherwise("direct").alias("mode"))
    return rows if mode == "all" else rows.filter(F.col("mode") == mode)


def chain_positions(functions: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, position) of stubs in chains: head (implemented caller, calls a stub), middle (stub caller, calls a stub), tail (stub caller, calls none)."""
    f = frontier(functions, edges, "all", known)
    flags = f.groupBy("name").agg(F.bool_or(F.col("mode") == "direct").alias("live"), F.bool_or(F.col("mode") == "chain").alias("held"))
    callers = f.filter("mode = 'chain'").select(F.col("caller").alias("name")).distinct().withColumn("calls_stub", F.lit(True))
    stubs = by_name(functions).filter("is_stub").select("name").join(flags, "name", "left").join(callers, "name", "left").na.fill(False)
    position = F.when(F.col("live") & F.col("calls_stub"), "head").when(F.col("held") & F.col("calls_stub"), "middle").when(F.col("held"), "tail")
    return stubs.select("name", position.alias("position")).filter("position IS NOT NULL")


def caller_counts(functions: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    return (calls(functions, edges) if known is None else known).groupBy("name").agg(F.count("caller").alias("callers"), F.count_if(F.col("caller_stub")).alias("stub_callers"), F.count_if(~F.col("caller_stub")).alias("live_callers"))


def interface_methods(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_name, method): abstract methods of classes whose base is named as abstract."""
    bases = classes.filter(F.col("base_class").contains("ABC") | F.col("base_class").contains("Abstract")).select(F.col("name").alias("class_name")).distinct()
    return methods.filter("is_abstract").join(bases, "class_name", "left_semi").select("class_name", "method").distinct()


def abstract_gaps(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_name, base_class, method): abstract methods that a declared subclass doesn't define."""
    wanted = interface_methods(classes, methods).withColumnRenamed("class_name", "base_class")
    subs = classes.select(F.col("name").alias("class_name"), "base_class")
    return subs.join(wanted, "base_class").join(methods.select("class_name", "method").distinct(), ["class_name", "method"], "left_anti").select("class_name", "base_class", "method")


def abstract_voids(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Classes with abstract methods and no declared subclass."""
    bases = interface_methods(classes, methods).select(F.col("class_name").alias("name")).distinct()
    return bases.join(classes.select(F.col("base_class").alias("name")).distinct(), "name", "left_anti").select(F.col("name").alias("class_name"))


def polymorphic_edges(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee): base.method to sub.method for abstract methods that a subclass overrides."""
    wanted = methods.filter("is_abstract").select(F.col("class_name").alias("base_class"), "method").distinct()
    have = methods.select("class_name", "method").distinct()
    pairs = classes.select(F.col("name").alias("class_name"), "base_class").join(wanted, "base_class").join(have, ["class_name", "method"])
    return pairs.select(F.concat_ws(".", "base_class", "method").alias("caller"), F.concat_ws(".", "class_name", "method").alias("callee"))


def interface_dispatch(interfaces: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee): interface.method to type.method for types that have all of an interface's methods.

    Joined on single methods and counted, so no pair without a common method
    is made; a type isn't its own implementation.
    """
    wanted = interfaces.select("interface", "method").distinct()
    sizes = wanted.groupBy("interface").agg(F.count(F.lit(1)).alias("size"))
    have = methods.select("class_name", "method").distinct()
    met = have.join(wanted, "method").filter("class_name <> interface").groupBy("interface", "class_name").agg(F.count(F.lit(1)).alias("n"))
    full = met.join(sizes, "interface").filter("n = size").select("interface", "class_name")
    return full.join(wanted, "interface").select(F.concat_ws(".", "interface", "method").alias("caller"), F.concat_ws(".", "class_name", "method").alias("callee"))


def orphaned_interfaces(classes: DataFrame, methods: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(interface, class_name, matched, size, strength): classes that aren't abstract themselves and, undeclared, share at least a threshold of an interface's abstract methods."""
    wanted = interface_methods(classes, methods).withColumnRenamed("class_name", "interface")
    sizes = wanted.groupBy("interface").agg(F.count(F.lit(1)).alias("size"))
    abstract = classes.filter(F.col("base_class").contains("ABC") | F.col("base_class").contains("Abstract")).select(F.col("name").alias("class_name"))
    have = methods.select("class_name", "method").distinct().join(abstract, "class_name", "left_anti")
    met = have.join(wanted, "method").groupBy("interface", "class_name").agg(F.count(F.lit(1)).alias("matched")).join(sizes, "interface")
    declared = classes.select(F.col("name").alias("class_name"), F.col("base_class").alias("interface"))
    free = met.join(declared, ["class_name", "interface"], "left_anti").filter(F.col("matched") >= threshold * F.col("size"))
    return free.select("interface", "class_name", "matched", "size", F.when(F.col("matched") >= 0.6 * F.col("size"), "strong").otherwise("possible").alias("strength"))


#: How factory methods begin.
FACTORY = ("create_", "build_", "make_", "get_", "new_", "produce_")


def phantom_factories(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Classes without subclass whose abstract methods are all named like factories."""
    made = F.lit(False)
    for p in FACTORY:
        made = made | F.col("method").startswith(p)
    names = interface_methods(classes, methods).groupBy("class_name").agg(F.bool_and(made).alias("all_made"), F.countDistinct("method").alias("methods")).filter("all_made")
    return names.join(abstract_voids(classes, methods), "class_name", "left_semi").select("class_name", "methods")


def gap_methods(classes: DataFrame, methods: DataFrame) -> DataFrame:
    return abstract_gaps(classes, methods).select(F.col("method").alias("name")).distinct()


def frontier_priority(functions: DataFrame, edges: DataFrame, gaps: DataFrame, n: int | None = 20) -> DataFrame:
    """(name, callers, position, score) of stubs that implemented functions call and of tails and middles of chains.

    Score: implemented callers + 5 for a tail, 2 middle, 1 head + 3 for an interface gap.
    """
    stubs, known = by_name(functions).filter("is_stub").select("name"), known_calls(functions, edges)
    live = caller_counts(functions, edges, known).select("name", F.col("live_callers").alias("callers"))
    rows = stubs.join(live, "name", "left").join(chain_positions(functions, edges, known), "name", "left").join(gaps.withColumn("gap", F.lit(3)), "name", "left").na.fill(0, ["callers", "gap"])
    rows = rows.filter((F.col("callers") > 0) | F.coalesce(F.col("position").isin("tail", "middle"), F.lit(False)))
    bonus = F.when(F.col("position") == "tail", 5).when(F.col("position") == "middle", 2).when(F.col("position") == "head", 1).otherwise(0)
    rows = rows.select("name", "callers", "position", (F.col("callers") + bonus + F.col("gap")).alias("score"))
    return rows.orderBy(F.desc("score"), F.desc("callers"), "name").limit(n) if n else rows


def frontier_coverage(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(functions, gated, pct, band): implemented functions that only stubs call."""
    live = by_name(functions).filter("NOT is_stub")
    counts = caller_counts(functions, edges)
    gated = live.join(counts.filter("stub_callers > 0 AND live_callers = 0").select("name"), "name", "left_semi")
    got = gated.select(F.lit(1).alias("g")).unionByName(live.select(F.lit(0).alias("g"))).agg(F.count_if(F.col("g") == 0).alias("functions"), F.count_if(F.col("g") == 1).alias("gated"))
    pct = F.round(100.0 * F.col("gated") / F.greatest(F.col("functions"), F.lit(1)), 1)
    return got.select("functions", "gated", pct.alias("pct")).withColumn("band", F.when(F.col("pct") >= 40, "high").when(F.col("pct") >= 20, "medium").otherwise("low"))


#: Parts of paths and beginnings of names that outside events call, and decorators of structure alone.
ENTRY_PARTS = (
    "route", "routes", "view", "views", "handler", "handlers", "endpoint", "endpoints", "cli", "commands", "command", "webhook", "webhooks", "task", "tasks", "signal", "signals", "middleware", "main")
ENTRY_PREFIXES = ("handle_", "on_", "route_", "cmd_", "do_")
STRUCTURAL = ("property", "staticmethod", "classmethod")


def is_entry_hint(name: Column, path: Column) -> Column:
    parts = F.split(F.translate(F.lower(F.coalesce(path, F.lit(""))), "\\.", "//"), "/")
    hint = F.arrays_overlap(parts, F.array(*(F.lit(p) for p in ENTRY_PARTS)))
    for p in ENTRY_PREFIXES:
        hint = hint | F.lower(name).startswith(p)
    return hint


def is_framework(decorators: Column) -> Column:
    """Whether a comma-separated list holds a decorator that isn't of structure alone."""
    last = lambda d: F.substring_index(F.substring_index(F.trim(d), "(", 1), ".", -1)
    return F.exists(F.split(F.coalesce(decorators, F.lit("")), ","), lambda d: (F.trim(d) != "") & ~last(d).isin(*STRUCTURAL))


def topology(functions: DataFrame, edges: DataFrame, gaps: DataFrame) -> DataFrame:
    """(shape, n): the nine shapes of unfinished code by name, the totals, and which gap dominates (1 where it does).

    connectivity: stubs there are, and implementations without live callers
    are three times as many, fifty and half of all at least; wiring: no stubs,
    and such implementations are fifty and half of all at least.
    """
    known = known_calls(functions, edges)
    counts, chains = caller_counts(functions, edges, known), chain_positions(functions, edges, known)
    own = functions.groupBy("name").agg(
        F.bool_or("is_stub").alias("is_stub"), F.bool_or(is_framework(F.col("decorators"))).alias("framework"), F.bool_or(is_entry_hint(F.col("name"), F.col("file_path"))).alias("hint"),
        F.bool_or(F.coalesce(F.col("file_path").endswith(".json"), F.lit(False))).alias("in_json"))
    calling = edges.select(F.col("caller").alias("name")).distinct().withColumn("calls", F.lit(True))
    rows = own.join(counts, "name", "left").join(chains, "name", "left").join(calling, "name", "left").na.fill(0, ["callers", "live_callers"]).na.fill(False, ["calls"])
    s = F.col("is_stub")
    cut_off = s & (F.col("callers") == 0) & ~F.col("calls")
    machine = F.col("name").contains("::action::") | F.col("name").contains("::guard::") | F.col("in_json")
    sums = rows.agg(
        F.count_if(s).alias("total_stubs"), F.count_if(~s).alias("total_implemented"), F.count_if(s & (F.col("live_callers") > 0)).alias("direct_call"),
        *(F.count_if(s & (F.col("position") == p)).alias(f"chain_{p}") for p in ("head", "middle", "tail")), F.count_if(~s & (F.col("live_callers") == 0) & ~F.col("framework")).alias("orphaned_impl"),
        F.count_if(cut_off & F.col("hint")).alias("entry_point"), F.count_if(cut_off & ~F.col("hint") & machine).alias("fsm_dispatch"), F.count_if(cut_off & ~F.col("hint") & ~machine).alias("disconnected"))
    wide = (F.col("orphaned_impl") >= 50) & (F.col("orphaned_impl") >= 0.5 * F.col("total_implemented"))
    sums = sums.withColumn("connectivity", (wide & (F.col("total_stubs") > 0) & (F.col("orphaned_impl") >= 3 * F.col("total_stubs"))).cast("long")).withColumn("wiring", (wide & (F.col("total_stubs") == 0)).cast("long"))
    gap = gaps.distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("abc_interface").alias("shape"), "n")
    return sums.unpivot([], sums.columns, "shape", "n").unionByName(gap)


def orphaned_implementations(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, file_path, callers, label): implemented functions without framework decorators that nobody, or only stubs and unknowns, call.

    Uncalled ones are ready-but-blocked in a file with stubs, else
    anticipatory; the others are possibly-stranded.
    """
    live = functions.filter("NOT is_stub").groupBy("name", "file_path").agg(F.bool_or(is_framework(F.col("decorators"))).alias("framework")).filter("NOT framework")
    rows = live.join(caller_counts(functions, edges), "name", "left").na.fill(0, ["callers", "live_callers"]).filter("live_callers = 0")
    unfinished = functions.filter("is_stub").select("file_path").distinct().withColumn("has_stubs", F.lit(True))
    label = F.when(F.col("callers") > 0, "possibly-stranded").when(F.col("has_stubs"), "ready-but-blocked").otherwise("anticipatory")
    return rows.join(unfinished, "file_path", "left").select("name", "file_path", "callers", label.alias("label"))


def pure_functions(functions: DataFrame, mutations: DataFrame, edges: DataFrame, min_callers: int = 0) -> DataFrame:
    """(name, file_path, callers, memo) of implemented functions in code files without mutations; callers are those of resolved calls by that very name."""
    code = functions.filter(F.col("file_path").isNull() | ~F.lower("file_path").endswith(".json"))
    clean = code.filter("NOT is_stub").join(mutations.select("file_path").distinct(), "file_path", "left_anti").select("name", "file_path").distinct()
    called = edges.filter("resolved").groupBy(F.col("callee").alias("name")).agg(F.countDistinct("caller").alias("callers"))
    rows = clean.join(called, "name", "left").na.fill(0, ["callers"]).filter(F.col("callers") >= min_callers)
    return rows.select("name", "file_path", "callers", (F.col("callers") >= 2).alias("memo"))


def dead_event_handlers(edges: DataFrame) -> DataFrame:
    """Undotted targets of function references that nothing else calls."""
    handlers = edges.filter("edge_type IN ('function_reference', 'decorator')").filter(~F.col("callee").contains(".")).select(F.col("callee").alias("name")).distinct()
    other = edges.filter("edge_type NOT IN ('function_reference', 'decorator')").select(F.col("target_id").alias("name")).distinct()
    return handlers.join(other, "name", "left_anti")


def large_files(functions: DataFrame, mutations: DataFrame, n: int = 20, at_least: int = 5) -> DataFrame:
    own = functions.groupBy("file_path").agg(F.count(F.lit(1)).alias("functions"), F.count_if("is_stub").alias("stubs"))
    changed = mutations.groupBy("file_path").agg(F.count(F.lit(1)).alias("mutations"))
    return own.filter(F.col("functions") >= at_least).join(changed, "file_path", "left").na.fill(0, ["mutations"]).orderBy(F.desc("functions"), F.desc("mutations"), "file_path").limit(n)


def stub_islands(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Stubs that no implemented function reaches through stubs."""
    c = calls(functions, edges).filter("caller_stub IS NOT NULL AND callee_stub")
    live = c.filter("NOT caller_stub").select(F.col("name").alias("root")).distinct()
    through = c.filter("caller_stub").select("caller", F.col("name").alias("callee"))
    return by_name(functions).filter("is_stub").select("name").join(multi_reach(through, live), "name", "left_anti")


def multi_reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name) of all that any of ``roots(root)`` reaches, the roots with them; one walk for all roots together."""
    step = written(G.pairs(edges), "walk-edges")
    seen = front = written(roots.select(F.col("root").alias("name")).distinct(), "walk")
    while True:
        ahead = front.join(step, front["name"] == step["caller"], "inner").select(F.col("callee").alias("name")).distinct()
        front = written(ahead.join(seen, "name", "left_anti"), "walk")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def implementation_order(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, wave): stubs after the stubs they call; what cycles hold back is wave -1."""
    c = calls(functions, edges).filter("caller_stub AND callee_stub")
    return G.waves(by_name(functions).filter("is_stub").select("name"), c.select("caller", F.col("name").alias("callee")))


# Features


#: Directories of tests and of assets.
TEST_DIRECTORIES = ("test", "tests", "spec", "specs", "__tests__", "__test__", "testing", "testcases", "test_cases")
ASSET_DIRECTORIES = ("static", "assets", "public", "dist", "build", "vendor", "node_modules", "www", "media")


def feature_key(path: Column | str, depth: int = 1) -> Column:
    """The first ``depth`` segments of a path; a file at the root is a feature of its own."""
    return F.substring_index(F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/"), "/", depth)


def _first_directory(feature: Column) -> Column:
    return F.substring_index(F.substring_index(F.lower(feature), "/", 1), ".", 1)


def is_test_feature(feature: Column) -> Column:
    base = _first_directory(feature)
    return base.isin(*TEST_DIRECTORIES) | base.startswith("test_") | base.startswith("spec_")


def _members(functions: DataFrame, depth: int, tests: bool) -> DataFrame:
    at = functions.withColumn("feature", feature_key("file_path", depth))
    return at if tests else at.filter(~is_test_feature(F.col("feature")))


def features(functions: DataFrame, edges: DataFrame, depth: int = 1, tests: bool = False) -> DataFrame:
    """(feature, symbols, stubs, entry_points, crossings, standing) by the first ``depth`` directories.

    Entry points are the distinct symbols, by their name or what follows its
    last dot, that are called from outside, unknown callers among them;
    crossings are those calls. A complete feature that is hardly called is
    isolated, one with many entry points and stubs is incomplete.
    """
    at = _members(functions, depth, tests)
    rows = at.groupBy("feature").agg(F.countDistinct("name").alias("symbols"), F.count_if("is_stub").alias("stubs"))
    bare = at.filter("name LIKE '%.%' AND name NOT LIKE '%::%'").select("feature", N.after_last_dot("name").alias("callee"))
    known = at.select("feature", F.col("name").alias("callee")).unionByName(bare).distinct()
    place = functions.groupBy("name").agg(F.min(feature_key("file_path", depth)).alias("from_feature")).select(F.col("name").alias("caller"), "from_feature")
    calls_in = edges.select("caller", "callee").join(known, "callee").join(place, "caller", "left").filter(F.coalesce("from_feature", F.lit("")) != F.col("feature"))
    crossing = calls_in.groupBy("feature").agg(F.countDistinct("callee").alias("entry_points"), F.count(F.lit(1)).alias("crossings"))
    rows = rows.join(crossing, "feature", "left").na.fill(0, ["entry_points", "crossings"])
    asset = _first_directory(F.col("feature")).isin(*ASSET_DIRECTORIES)
    isolated = ~asset & (F.col("symbols") >= 30) & (F.col("entry_points") >= 2) & (1 - F.col("stubs") / F.col("symbols") >= 0.85) & (F.col("entry_points") / F.col("symbols") <= 0.08)
    incomplete = ~asset & (F.col("entry_points") >= 20) & (F.col("stubs") >= 5)
    return rows.withColumn("standing", F.when(isolated, "isolated").when(incomplete, "incomplete").otherwise("none"))


def development_priorities(functions: DataFrame, edges: DataFrame, classes: DataFrame, methods: DataFrame, n: int | None = 10, depth: int = 1, tests: bool = False) -> DataFrame:
    """(feature, implemented, stubs, missing, calls_in, blocked, void, priority) of unfinished features, the most pressing first.

    Missing are distinct undotted callees, not built in, that no function
    bears. Priority: the share that isn't implemented, times the calls from
    other features; at least five times that share where an interface has no
    subclass. blocked: other features call one of its stubs.
    """
    at = _members(functions, depth, tests)
    sums = at.groupBy("feature").agg(F.count_if(~F.col("is_stub")).alias("implemented"), F.count_if("is_stub").alias("stubs"))
    own = at.groupBy("name").agg(F.max(F.struct("id", "feature", "is_stub")).alias("o")).select("name", "o.feature", "o.is_stub")
    bare = own.filter("name LIKE '%.%' OR name LIKE '%::%'").groupBy(N.normalize_symbol("name").alias("bare")).agg(F.min(F.struct("name", "feature", "is_stub")).alias("o")).select(F.col("bare").alias("name"), "o.feature", "o.is_stub")
    known = own.unionByName(bare.join(own.select("name"), "name", "left_anti"))
    one = edges.select("caller", "callee").join(known.select(F.col("name").alias("caller"), F.col("feature").alias("from_feature")), "caller")
    met = one.join(known.select(F.col("name").alias("callee"), "feature", "is_stub"), "callee", "left")
    into = met.filter("feature <> from_feature").groupBy("feature").agg(F.count(F.lit(1)).alias("calls_in"), F.bool_or("is_stub").alias("blocked"))
    lost = met.filter(F.col("feature").isNull() & ~F.col("callee").contains(".") & ~F.col("callee").isin(*N.PYTHON_BUILTINS)).groupBy(F.col("from_feature").alias("feature")).agg(F.countDistinct("callee").alias("missing"))
    abstract = classes.filter(F.col("base_class").contains("ABC") | F.col("base_class").contains("Abstract"))
    void = abstract.join(classes.select(F.col("base_class").alias("name")).distinct(), "name", "left_anti").select(feature_key("file_path", depth).alias("feature")).distinct().withColumn("void", F.lit(True))
    rows = sums.join(into, "feature", "left").join(lost, "feature", "left").join(void, "feature", "left").na.fill(0, ["calls_in", "missing"]).na.fill(False, ["blocked", "void"])
    undone = 1 - F.col("implemented") / (F.col("implemented") + F.col("stubs") + F.col("missing"))
    rows = rows.withColumn("priority", F.round(F.greatest(undone * F.col("calls_in"), F.when(F.col("void"), undone * 5).otherwise(0.0)), 4)).filter("stubs > 0 OR missing > 0")
    rows = rows.select("feature", "implemented", "stubs", "missing", "calls_in", "blocked", "void", "priority").orderBy(F.desc("priority"), F.desc("blocked"), F.desc("void"), "feature")
    return rows.limit(n) if n else rows


def feature_shape(functions: DataFrame, edges: DataFrame, feature: str) -> DataFrame:
    """(node, status) of what a feature calls: implemented, stub, missing (an undotted unknown) or external."""
    inside = by_name(functions).filter(N.directory_key("file_path") == feature).select("name")
    keyed = edges.join(inside.select(F.col("name").alias("caller")), "caller", "left_semi").filter("callee IS NOT NULL").select("callee").distinct()
    known = by_name(functions).select("name", "is_stub")
    rows = keyed.withColumn("name", N.after_last_dot("callee")).join(known, "name", "left")
    status = F.when(F.col("is_stub"), "stub").when(~F.col("is_stub"), "implemented").when(F.col("callee").contains("."), "external").otherwise("missing")
    return rows.select(F.col("callee").alias("node"), status.alias("status"))


def stub_shapes(functions: DataFrame, key: Column) -> DataFrame:
    """(place, functions, stubs, density, dominant, verdict); dominant is the most frequent return type of stubs, 'mixed' on ties."""
    at = functions.withColumn("place", key)
    base = at.groupBy("place").agg(F.count(F.lit(1)).alias("functions"), F.count_if("is_stub").alias("stubs"))
    kinds = at.filter("is_stub").groupBy("place", F.coalesce("return_type", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    top = kinds.withColumn("place_rank", F.rank().over(Window.partitionBy("place").orderBy(F.desc("n")))).filter("place_rank = 1").groupBy("place").agg(F.when(F.count(F.lit(1)) > 1, "mixed").otherwise(F.min("kind")).alias("dominant"))
    density = F.round(F.col("stubs") / F.col("functions"), 4)
    rows = base.join(top, "place", "left").withColumn("density", density)
    return rows.select("place", "functions", "stubs", "density", "dominant", F.when(F.col("density") >= 0.6, "blocked").when(F.col("density") >= 0.3, "partial").otherwise("sound").alias("verdict"))


def prerequisite_map(functions: DataFrame) -> DataFrame:
    """(prerequisite, stubs, level): what stubs' docstrings wait for; HIGH from 3 stubs, MED from 2."""
    rows = functions.filter("is_stub").select("name", F.explode(N.prerequisites("docstring")).alias("prerequisite"))
    counted = rows.groupBy("prerequisite").agg(F.countDistinct("name").alias("stubs"))
    return counted.withColumn("level", F.when(F.col("stubs") >= 3, "HIGH").when(F.col("stubs") == 2, "MED").otherwise("LOW"))


def concept_ghosts(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(concept, uses, state): CamelCase words of docstrings that no class or function name bears.

    live: equal to a class name up to its architectural ending; partial: its
    snake-case form is part of a function's name; ghost: neither.
    """
    words = functions.select("name", F.explode(N.concepts("docstring")).alias("concept")).groupBy("concept").agg(F.countDistinct("name").alias("uses"))
    names = classes.select(N.concept_base("name").alias("base")).distinct().withColumn("is_class", F.lit(True))
    tokens = functions.select(F.explode(N.name_tokens("name")).alias("token")).distinct()
    rows = words.withColumn("base", N.concept_base("concept")).join(names, "base", "left")
    parts = rows.select("concept", F.explode(N.name_tokens(N.snake_case("base"))).alias("token")).join(tokens, "token", "left_semi").select("concept").distinct().withColumn("is_part", F.lit(True))
    return rows.join(parts, "concept", "left").select("concept", "uses", F.when(F.col("is_class"), "live").when(F.col("is_part"), "partial").otherwise("ghost").alias("state"))


def missing_bridges(functions: DataFrame) -> DataFrame:
    """(name, param, wanted): a stub's typed parameters that no implemented function returns."""
    typed = functions.filter("is_stub AND param_types <> ''").select("name", F.explode(F.split("param_types", ",")).alias("p"))
    typed = typed.select("name", F.substring_index("p", ":", 1).alias("param"), F.substring_index("p", ":", -1).alias("wanted"))
    given = functions.filter("NOT is_stub").select(N.named_type("return_type").alias("wanted")).filter("wanted IS NOT NULL").distinct()
    return typed.join(given, "wanted", "left_anti").select("name", "param", "wanted").distinct()


#: Dimensions by which a name family may agree, and what kind of fact each is.
DIMENSIONS = {"callers": "structural", "callees": "structural", "return_type": "type", "param_count": "type", "body_weight": "role"}


def _step(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n <= 1, "1").when(n <= 3, "2").when(n <= 8, "3").otherwise("4")


def return_category(declared: Column) -> Column:
    c = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    has = lambda *words: c.rlike("|".join(words))
    return (F.when(c.isin("", "none", "nonetype"), "none").when(c == "bool", "bool").when(c.isin("int", "float"), "numeric").when(c.isin("str", "string"), "str")
            .when(has("dict", "mapping"), "dict").when(has("list", "sequence", "iterable"), "list").otherwise("object"))


def _families(functions: DataFrame, edges: DataFrame, leave_tests: bool) -> DataFrame:
    """A row for each family of a function: names with a common first, or another last, token."""
    rows = functions.filter(~N.is_dunder("name"))
    if leave_tests:
        rows = rows.filter(F.col("file_path").isNull() | ~F.lower(F.translate("file_path", "\\", "/")).rlike("/test."))
    one = G.first_per_key(rows, ["name"], [F.desc("id")])
    out = edges.groupBy(F.col("caller").alias("name")).agg(F.countDistinct("callee").alias("out"))
    into = edges.filter("callee IS NOT NULL").select("caller", F.explode(N.suffix_keys("callee")).alias("name")).groupBy("name").agg(F.countDistinct("caller").alias("into"))
    params = F.size(F.filter(F.split(F.coalesce("param_types", F.lit("")), ","), lambda p: p != ""))
    one = one.join(out, "name", "left").join(into, "name", "left").na.fill(0, ["out", "into"])
    tokens = N.name_tokens(F.regexp_replace("name", "^_+", ""))
    first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)
    both = F.array(F.concat(F.lit("prefix:"), first), F.when(first != last, F.concat(F.lit("suffix:"), last)))
    return one.select("name", "file_path", "is_stub", F.explode(F.filter(both, lambda f: f.isNotNull())).alias("family"), _step(F.col("into")).alias("callers"), _step(F.col("out")).alias("callees"),
                      return_category(F.col("return_type")).alias("return_type"), _step(params).alias("param_count"), F.when(F.col("is_stub"), "stub").otherwise("impl").alias("body_weight"))


def convention_members(functions: DataFrame, edges: DataFrame, checked: bool = True, min_family: int = 3) -> DataFrame:
    """(family, size, canon, name, file_path, is_stub, diverges) of families with a convention.

    A dimension agrees if at least 70% of a family share a value. Two must,
    of two kinds of fact. ``checked`` leaves out test files, and families of
    which over 40% diverge in an agreeing dimension. canon and diverges list
    dimensions by name.
    """
    rows = _families(functions, edges, checked)
    sizes = rows.groupBy("family").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_family)
    values = rows.join(sizes, "family").unpivot(["family", "size"], list(DIMENSIONS), "dimension", "value").groupBy("family", "size", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    kind = F.create_map(*(F.lit(x) for item in DIMENSIONS.items() for x in item))
    agreed = values.filter(10 * F.col("n") >= 7 * F.col("size")).withColumn("kind", F.element_at(kind, F.col("dimension")))
    pair = F.sort_array(F.collect_list(F.struct("dimension", "value")))
    canon = agreed.groupBy("family", "size").agg(pair.alias("held"), F.count(F.lit(1)).alias("dims"), F.countDistinct("kind").alias("kinds")).filter("dims >= 2 AND kinds >= 2")
    own = F.create_map(*(x for d in DIMENSIONS for x in (F.lit(d), F.col(d))))
    odd = F.filter("held", lambda h: F.element_at(own, h["dimension"]) != h["value"])
    members = rows.join(canon, "family").withColumn("odd", odd)
    if checked:
        bad = members.groupBy("family").agg(F.count_if(F.size("odd") > 0).alias("bad"))
        members = members.join(bad, "family").filter(10 * F.col("bad") <= 4 * F.col("size"))
    text = F.array_join(F.transform("held", lambda h: F.concat_ws("=", h["dimension"], h["value"])), ",")
    return members.select("family", "size", text.alias("canon"), "name", "file_path", "is_stub", F.array_join(F.transform("odd", lambda h: h["dimension"]), ",").alias("diverges"))


def conventions(functions: DataFrame, edges: DataFrame, min_family: int = 3) -> DataFrame:
    """(family, size, canon, outliers)."""
    rows = convention_members(functions, edges, True, min_family)
    return rows.groupBy("family", "size", "canon").agg(F.count_if(F.col("diverges") != "").alias("outliers"))


def convention_outliers(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, family, diverges, is_stub) of members that leave their family's convention."""
    return convention_members(functions, edges).filter("diverges <> ''").select("name", "family", "diverges", "is_stub")


def verify_implementations(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, verdict): FAIL for stubs, WARN for the uncalled and for callers of stubs, else PASS."""
    known = known_calls(functions, edges)
    counts = caller_counts(functions, edges, known).select("name", "callers")
    stuck = known.filter("callee_stub").select(F.col("caller").alias("name")).distinct().withColumn("stuck", F.lit(True))
    rows = by_name(functions).join(counts, "name", "left").join(stuck, "name", "left")
    return rows.select("name", F.when(F.col("is_stub"), "FAIL").when(F.col("callers").isNull() | F.col("stuck"), "WARN").otherwise("PASS").alias("verdict"))


def readiness(functions: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, stub_callees, unknown_types, ready) of stubs."""
    c = calls(functions, edges).filter("callee_stub AND caller_stub").groupBy(F.col("caller").alias("name")).agg(F.count(F.lit(1)).alias("stub_callees"))
    typed = functions.filter("is_stub AND param_types <> ''").select("name", F.explode(F.split("param_types", ",")).alias("p")).select("name", F.substring_index("p", ":", -1).alias("wanted")).distinct()
    unknown = typed.join(classes.select(F.col("name").alias("wanted")).distinct(), "wanted", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("unknown_types"))
    rows = by_name(functions).filter("is_stub").select("name").join(c, "name", "left").join(unknown, "name", "left").na.fill(0)
    return rows.withColumn("ready", (F.col("stub_callees") == 0) & (F.col("unknown_types") == 0))


def entry_tiers(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, file_path, tier): explicit entry points, and inferred ones that nothing calls."""
    tier = N.entry_tier(F.col("name"), F.col("file_path"), F.col("is_tool"), F.col("http_route"))
    rows = functions.select("name", "file_path", tier.alias("tier")).distinct()
    free = rows.filter("tier = 'inferred'").join(G.known_callees(edges), "name", "left_anti")
    return rows.filter("tier <> 'inferred'").unionByName(free.select(rows.columns))


def annotation_queue(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, callers) of implemented functions without parameter types, the most called first."""
    rows = functions.filter("NOT is_stub AND param_types = ''").select("name").distinct()
    return rows.join(caller_counts(functions, edges).select("name", "callers"), "name", "left").na.fill(0, ["callers"])
