"""Work plans of all features at once: stubs in the order in which they can be written, grouped by where their missing calls lead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.shared import written
from . import graph as G
from .judgment import contained
from .stubs import feature_key, readiness

#: Axis of stubs with a call that leads to no place of the corpus.
EXTERNAL = "[external]"
_GLUE = "\x01"


def known_names(functions: DataFrame) -> DataFrame:
    """(name): functions' names, and what follows the last dot of dotted ones or else the last ``::``."""
    bare = F.when(F.col("name").contains("."), F.substring_index("name", ".", -1)).when(F.col("name").contains("::"), F.substring_index("name", "::", -1))
    return functions.select(F.explode(F.array("name", bare)).alias("name")).filter("name IS NOT NULL").distinct()


def grouped_waves(members: DataFrame, needs: DataFrame) -> DataFrame:
    """(feature, name, wave) of ``members(feature, name)`` in layers: each after the members of its own group that it needs.

    ``needs(caller, callee)`` between members of different groups are cut. All
    groups are layered in one run, as one graph whose nodes carry their group.
    What needs itself, is on a cycle, or is behind either, has wave -1.
    """
    inside = members.select("feature", F.col("name").alias("caller")).join(needs, "caller").join(members.select("feature", F.col("name").alias("callee")), ["feature", "callee"])
    inside = written(inside.select(*(F.concat_ws(_GLUE, "feature", end).alias(end) for end in ("caller", "callee"))).distinct(), "plan-needs")
    # A node of its own on the other end holds back what needs itself, as a cycle of two would.
    again = inside.filter("caller = callee").select("caller", F.concat_ws(_GLUE, "callee", F.lit("again")).alias("callee"))
    drawn = inside.unionByName(again).unionByName(G.reversed_edges(again))
    nodes = members.select(F.concat_ws(_GLUE, "feature", "name").alias("name")).unionByName(again.select(F.col("callee").alias("name")))
    rows = G.waves(nodes, drawn).withColumn("parts", F.split("name", _GLUE)).filter("size(parts) = 2")
    return rows.select(F.col("parts")[0].alias("feature"), F.col("parts")[1].alias("name"), "wave")


def unmet_needs(functions: DataFrame, edges: DataFrame, stubs: DataFrame, depth: int = 1, builtins: Sequence[str] = N.PYTHON_BUILTINS) -> DataFrame:
    """(feature, name, callee): distinct undotted callees of unresolved calls that a stub makes in its own feature's files, borne by no function and not built in."""
    calls = edges.filter("NOT resolved AND callee <> ''").filter(~F.col("callee").contains(".") & ~F.col("callee").isin(*builtins))
    calls = calls.select(feature_key("caller_file", depth).alias("feature"), F.col("caller").alias("name"), "callee").distinct()
    return calls.join(known_names(functions).withColumnRenamed("name", "callee"), "callee", "left_anti").join(stubs.select("feature", "name"), ["feature", "name"], "left_semi").select("feature", "name", "callee")


def groundings(functions: DataFrame, classes: DataFrame, stubs: DataFrame) -> DataFrame:
    """(feature, name, ghosts, bridges) of ``stubs(feature, name, doc, params)`` that speak of concepts without a hold in the corpus.

    A concept is a ghost if neither its base holds a class's name nor a class's
    name the base, letter case aside. Of the others, a bridge is missing from
    each parameter of the stub that no implemented function of that parameter
    turns into a type that holds the base. Both are sorted lists.
    """
    told = written(stubs.select("feature", "name", "params", F.explode(N.concepts("doc")).alias("concept")).withColumn("base", F.lower(N.concept_base("concept"))), "plan-concepts")
    bases, kinds = told.select("base").distinct(), classes.select(F.lower("name").alias("kind")).distinct()
    held = contained(bases.select(F.col("base").alias("part")), kinds.select(F.col("kind").alias("text"))).select(F.col("part").alias("base"))
    holding = contained(kinds.select(F.col("kind").alias("part")), bases.select(F.col("base").alias("text"))).select(F.col("text").alias("base"))
    real = written(held.unionByName(holding).distinct(), "plan-classes")
    ghosts = told.join(real, "base", "left_anti").groupBy("feature", "name").agg(F.sort_array(F.collect_set("concept")).alias("ghosts"))
    asked = told.join(real, "base", "left_semi").filter("params <> ''").select("feature", "name", "base", N.concept_base("concept").alias("label"), F.explode(F.split("params", ",")).alias("param")).withColumn("param", F.substring_index("param", ":", 1))
    turns = functions.filter("NOT is_stub AND param_types <> '' AND return_type <> ''").select(F.lower("return_type").alias("returned"), F.explode(F.split("param_types", ",")).alias("param")).select("returned", F.substring_index("param", ":", 1).alias("param")).distinct()
    fit = contained(asked.select(F.col("base").alias("part")).distinct(), turns.select(F.col("returned").alias("text"))).select(F.col("part").alias("base"), F.col("text").alias("returned"))
    crossed = fit.join(turns, "returned").select("base", "param").distinct()
    bridges = asked.join(crossed, ["base", "param"], "left_anti").groupBy("feature", "name").agg(F.sort_array(F.collect_set(F.concat("param", F.lit(" -> "), "label"))).alias("bridges"))
    return ghosts.join(bridges, ["feature", "name"], "full_outer")


def feature_work_plan(functions: DataFrame, edges: DataFrame, classes: DataFrame, depth: int = 1, top_axes: int | None = None, builtins: Sequence[str] = N.PYTHON_BUILTINS) -> DataFrame:
    """One row for each stub of each feature, the first ``depth`` segments of paths.

    (feature, axis, axis_rank, axis_score, place, wave, name, file_path, line_number,
    calls_in, called_by, needs, readiness, missing, signature, contract).

    ``axis`` is '[external]' for stubs with unmet needs, as a call that has a
    place in the corpus is met, else the feature itself. An axis scores one
    for each of its stubs and one for each resolved call of it; ``axis_rank``
    orders a feature's axes by score, then label, and ``top_axes`` keeps the
    first. ``place`` orders an axis by wave and name; wave -1, what cycles
    hold back, comes last. ``called_by`` lists the first four of a stub's
    distinct resolved callers, ``needs`` the first five unmet needs, as a
    report's limits. ``readiness`` is READY, else UNGROUNDABLE with the ghosts
    in ``missing``, else MISSING_BRIDGE with the bridges, else BLOCKED. A
    stub's text is that of its first row in the feature, by path, line, types,
    return type and docstring; null parameters read '?'. Rows without a name or
    a path are left out; without stubs there are no rows.
    """
    placed = functions.filter("is_stub AND name <> '' AND file_path IS NOT NULL").withColumn("feature", feature_key("file_path", depth))
    stubs = placed.groupBy("feature", "name").agg(F.min(F.struct("file_path", "line_number", F.col("param_types").alias("params"), "return_type", F.col("docstring").alias("doc"))).alias("f")).select("feature", "name", "f.*")
    stubs = written(stubs, "plan-stubs")
    met = edges.filter("resolved AND callee IS NOT NULL").select("caller", "callee")
    into = met.groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("calls_in"), F.array_sort(F.collect_set("caller")).alias("callers"))
    layers = grouped_waves(stubs.select("feature", "name"), met.distinct())
    needs = unmet_needs(functions, edges, stubs, depth, builtins).groupBy("feature", "name").agg(F.array_sort(F.collect_set("callee")).alias("lacks"))
    ready = readiness(functions, edges, classes).select("name", "ready")
    rows = stubs.join(layers, ["feature", "name"]).join(into, "name", "left").join(needs, ["feature", "name"], "left").join(ready, "name", "left").join(groundings(functions, classes, stubs), ["feature", "name"], "left")
    rows = rows.na.fill(0, ["calls_in"]).withColumn("axis", F.when(F.col("lacks").isNotNull(), EXTERNAL).otherwise(F.col("feature")))
    axes = rows.groupBy("feature", "axis").agg(F.sum(F.col("calls_in") + 1).alias("axis_score"))
    axes = axes.withColumn("axis_rank", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("axis_score"), "axis")))
    axes = axes.filter(F.col("axis_rank") <= top_axes) if top_axes else axes
    rows = rows.join(axes, ["feature", "axis"])
    # Places by count: sizes of the waves before, then the names within a wave, so that no axis is ordered as one group.
    late = F.when(F.col("wave") < 0, F.lit(1 << 30)).otherwise(F.col("wave"))
    rows = rows.withColumn("late", late)
    sizes = rows.groupBy("feature", "axis", "late").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("feature", "axis").orderBy("late").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("feature", "axis", "late", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("feature", "axis", "late").orderBy("name"))
    rows = rows.join(sizes, ["feature", "axis", "late"]).withColumn("place", F.col("earlier") + within)
    state = F.when(F.col("ready"), "READY").when(F.col("ghosts").isNotNull(), "UNGROUNDABLE").when(F.col("bridges").isNotNull(), "MISSING_BRIDGE").otherwise("BLOCKED")
    listed = lambda c, n: F.coalesce(F.array_join(F.slice(c, 1, n), ","), F.lit(""))
    takes = F.coalesce(F.replace(F.replace("params", F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": ")), F.lit("?"))
    signature = F.concat(F.lit("("), takes, F.lit(") -> "), F.coalesce(F.nullif("return_type", F.lit("")), F.lit("[infer: return type unknown]")))
    contract = F.coalesce(F.when(F.col("doc") != "", F.trim("doc")), F.concat(F.lit("[infer: intent from name '"), "name", F.lit("']")))
    lost = F.when(F.col("readiness") == "UNGROUNDABLE", F.array_join("ghosts", ", ")).when(F.col("readiness") == "MISSING_BRIDGE", F.array_join("bridges", "; ")).otherwise("")
    rows = rows.withColumn("readiness", state)
    return rows.select("feature", "axis", "axis_rank", "axis_score", F.col("place").cast("long").alias("place"), "wave", "name", "file_path", "line_number", "calls_in", listed("callers", 4).alias("called_by"),
                       listed("lacks", 5).alias("needs"), "readiness", lost.alias("missing"), signature.alias("signature"), contract.alias("contract"))
