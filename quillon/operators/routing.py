"""Questions to intents, seeds and budgeted expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .graph import reach, reversed_edges, symbol_rank

GENERAL = "general_query"
#: The primitives of each intent, and its forward and reverse hops.
PRIMITIVES = {
    "impact_query": ("impact", "context"), "reverse_query": ("impact",), "surface_query": ("surface", "context"), "role_query": ("role",), "debug_query": ("findings", "impact", "context"),
    "mutation_query": ("mutations", "impact", "context"), GENERAL: ("context", "surface", "impact")}
BUDGETS = {
    "surface_query": (2, 0), "impact_query": (0, 2), "reverse_query": (0, 1), GENERAL: (1, 1), "role_query": (0, 0), "debug_query": (0, 2), "mutation_query": (1, 1)}
#: Phrases of the intents; the two-part ones need a word of either list.
IMPACT, REVERSE, SURFACE = ("what depends", "impact"), ("what uses", "used by"), ("what does", "surface")
BROKEN, WHY, FAULTS = ("broken", "failing", "crashed", "erroring", "not working"), ("why",), ("fail", "wrong", "error", "bug", "crash", "exception")
MUTATES, CHANGED, ASKED = ("mutates", "who mutates"), ("modif", "changes"), ("where", "what", "who")
ROLE = ("purpose", "why does", "why is", "role of", "what role", "what kind of")


def intent_of(text: Column | str) -> Column:
    """The intent of a question: the first of impact, reverse, surface, debug, mutation and role whose phrases it holds, else general."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))

    def any_of(phrases: tuple) -> Column:
        found = F.lit(False)
        for p in phrases:
            found = found | low.contains(p)
        return found

    return (F.when(any_of(IMPACT), "impact_query").when(any_of(REVERSE), "reverse_query").when(any_of(SURFACE), "surface_query")
            .when(any_of(BROKEN) | (any_of(WHY) & any_of(FAULTS)), "debug_query").when(any_of(MUTATES) | (any_of(CHANGED) & any_of(ASKED)), "mutation_query")
            .when(any_of(ROLE), "role_query").otherwise(GENERAL))


def primitives_of(intent: Column | str) -> Column:
    c = F.col(intent) if isinstance(intent, str) else intent
    out = F.lit(",".join(PRIMITIVES[GENERAL]))
    for name, items in PRIMITIVES.items():
        out = F.when(c == name, ",".join(items)).otherwise(out)
    return out


def keywords(text: Column | str) -> Column:
    """Words longer than five characters, lower-cased and distinct."""
    return F.array_distinct(F.filter(F.split(F.lower(text if isinstance(text, Column) else F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 5))


def token_seeds(questions: DataFrame, symbols: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, symbol, score): symbols whose name tokens a question's words share, a point each, two for four characters in common and more.

    Both sides are exploded to tokens and joined on them, so only pairs that
    share a token are made.
    """
    words = questions.select("query_id", F.explode(F.array_distinct(F.split(F.lower("raw_query"), r"[^\p{L}\p{N}]+"))).alias("token")).filter("token <> ''")
    names = symbols.filter(~N.is_noise("symbol")).select("symbol", F.explode(F.array_distinct(F.transform(N.name_tokens("symbol"), F.lower))).alias("token"))
    hits = words.join(names, "token").groupBy("query_id", "symbol").agg(F.sum(F.when(F.length("token") >= 4, 2).otherwise(1)).alias("score"))
    return hits.filter(F.col("score") >= least)


def route_expand(edges: DataFrame, seeds: DataFrame, intent: str, builtins: DataFrame | None = None) -> DataFrame:
    """(symbol, reason): seeds and what the intent's hop budgets reach, forward and back; 'seed' before 'forward' before 'reverse'.

    A walk never enters a noise symbol or one of ``builtins(symbol)``; seeds are taken as they are.
    """
    forward, back = BUDGETS.get(intent, BUDGETS[GENERAL])

    def clean(steps: DataFrame) -> DataFrame:
        steps = steps.select("caller", "callee").filter(~N.is_noise("callee"))
        return steps.join(builtins.select(F.col("symbol").alias("callee")), "callee", "left_anti") if builtins is not None else steps

    rows = seeds.select(F.col("root").alias("symbol"), F.lit(0).alias("o"))
    if forward:
        rows = rows.unionByName(reach(clean(edges), seeds, forward).select(F.col("node").alias("symbol"), F.lit(1).alias("o")))
    if back:
        rows = rows.unionByName(reach(clean(reversed_edges(edges)), seeds, back).select(F.col("node").alias("symbol"), F.lit(2).alias("o")))
    best = rows.groupBy("symbol").agg(F.min("o").alias("o"))
    return best.select("symbol", F.when(F.col("o") == 0, "seed").when(F.col("o") == 1, "forward").otherwise("reverse").alias("reason"))


def route(edges: DataFrame, seeds: list[str], intent: str, limit: int = 40, builtins: DataFrame | None = None) -> DataFrame:
    """(symbol, reason, degree, score) of the best symbols of a question's neighbourhood. The seeds are a question's few names."""
    spark = edges.sparkSession
    found = route_expand(edges, spark.createDataFrame([(s,) for s in seeds], "root string"), intent, builtins)
    return symbol_rank(found, F.array(*(F.lit(s) for s in seeds)), edges, limit)
