"""Why a stub exists: signals of its text, callers and surroundings, scored for four readings, and a ranking built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.shared import written
from . import graph as G
from .stubs import caller_counts, chain_positions, convention_members, known_calls

#: Phrases of intent, of work that waits, and of what isn't there.
MODAL = r"(?i)\b(would|should|could|meant to|intended to|is supposed to|is meant to)\b"
WAITS = (
    r"(?i)\b(?:will|to)\s+be\s+implemented\s+when\b|\bimplemented\s+when\s+\w[\w\s]*\s+is\s+(?:built|ready|done|added|available)\b"
    r"|\bwhen\s+\w[\w\s]*\s+(?:is|are)\s+(?:built|ready|done|added|available|wired)\b|\bonce\s+\w[\w\s]*\s+(?:is|are)\s+(?:built|ready|done|added|implemented)\b")
ABSENT = (
    r"(?i)(?:doesn['’]t\s+(?:have|support|exist|include|implement)|don['’]t\s+(?:have|support|use|exist|apply)|does\s+not\s+(?:have|support|exist|apply|belong)|do\s+not\s+(?:have|support|exist|apply)"
    r"|not\s+(?:supported|applicable|part\s+of|used|present|implemented)\s+in|not\s+in\s+(?:this|the|our|og)\b|(?:no|zero)\s+\w+\s+in\s+(?:this|the|our|og)\b"
    r"|(?:was|were|has\s+been|have\s+been)\s+(?:removed|deleted|dropped|eliminated)|concept\s+(?:removed|dropped|eliminated|deprecated)|for\s+(?:backward|back)(?:s?ward)?\s*compatibility\s+only"
    r"|always\s+returns?\s+(?:empty|none|null|false|zero|0|an?\s+empty))")
#: Methods that every Python class may have, and bases of contracts.
MAGIC = (
    "__init__", "__new__", "__del__", "__str__", "__repr__", "__bytes__", "__format__", "__len__", "__length_hint__", "__bool__", "__call__", "__hash__", "__eq__", "__ne__", "__lt__", "__le__",
    "__gt__", "__ge__", "__getitem__", "__setitem__", "__delitem__", "__contains__", "__iter__", "__next__", "__reversed__", "__enter__", "__exit__", "__get__", "__set__", "__delete__",
    "__getattr__", "__setattr__", "__delattr__", "__add__", "__sub__", "__mul__", "__truediv__", "__radd__", "__rsub__", "__rmul__", "__iadd__", "__isub__", "__imul__", "__neg__", "__pos__",
    "__abs__", "__int__", "__float__", "__index__", "__await__", "__aiter__", "__anext__", "__aenter__", "__aexit__")
CONTRACT_BASES = r"Protocol|ABC"
FSM_KINDS = ("fsm_state", "fsm_action", "fsm_guard")
#: The readings, in the order that settles ties.
READINGS = ("concept-not-applicable", "blocked-on-prerequisite", "design-intent-stated", "genuinely-unknown")
FULL_SCORE, LEAST_SCORE = 3.0, 0.2


def has_intent(text: Column) -> Column:
    c = F.coalesce(text, F.lit(""))
    return c.rlike(WAITS) | c.rlike(MODAL)


def has_removal(text: Column) -> Column:
    c = F.coalesce(text, F.lit(""))
    return ~c.rlike(WAITS) & c.rlike(ABSENT)


def is_test_file(path: Column) -> Column:
    low = F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))
    return low.contains("/test") | F.substring_index(low, "/", -1).startswith("test_")


def is_lifecycle(name: Column, path: Column) -> Column:
    ending = F.lower(F.substring_index(F.coalesce(path, F.lit("")), ".", -1))
    return F.when(ending == "py", name.isin(*MAGIC)).when(ending.isin("js", "ts", "jsx", "tsx"), name == "constructor").otherwise(N.is_dunder(name) & (F.length(name) > 4))


#: Lengths of the pieces that a substring join indexes; a part is found by its rarest piece of the largest length that fits in it.
PIECES = (1, 2, 3, 6, 12)
#: Characters of a stretch of text whose pieces are cut together, so that cutting takes time linear in a text.
STRETCH = 256


def _cut(low: Column, width: Column) -> Column:
    """All pieces of ``width`` characters, as hashes; the whole where it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - width + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(low, i, width)))


def part_pieces(parts: DataFrame) -> DataFrame:
    """(part, piece) of distinct lower-case parts: every piece of the one length that a part is found by."""
    low = parts.filter("part <> ''").select(F.lower("part").alias("part")).distinct()
    width = F.lit(PIECES[0])
    for k in PIECES[1:]:
        width = F.when(F.length("part") >= k, k).otherwise(width)
    return low.withColumn("width", width).select("part", F.explode(F.array_distinct(_cut(F.col("part"), F.col("width")))).alias("piece"))


def text_pieces(texts: DataFrame) -> DataFrame:
    """(text_hash, piece) of texts, of all lengths in ``PIECES``; stretches overlap by the longest piece."""
    low = texts.filter("text <> ''").select(F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low"))
    starts = F.sequence(F.lit(0), F.floor((F.length("low") - 1) / STRETCH).cast("int"))
    low = low.select("text_hash", F.explode(F.transform(starts, lambda k: F.substring(F.col("low"), k * STRETCH + 1, F.lit(STRETCH + PIECES[-1] - 1)))).alias("low"))
    return low.select("text_hash", F.explode(F.array_distinct(F.concat(*(_cut(F.col("low"), F.lit(k)) for k in PIECES)))).alias("piece"))


def containment_candidates(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, text_hash) of lower-case parts and the texts that hold a part's rarest piece.

    A piece's rarity is counted over all texts; a part with a piece that no
    text holds is in none. Whatever beginnings parts share, each meets only
    the texts that share the least common stretch of it.
    """
    cut = part_pieces(parts)
    held = text_pieces(texts)
    common = held.join(cut.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = cut.join(common, "piece", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
    rarest = rarest.filter("least.n > 0").select("part", F.col("least.piece").alias("piece"))
    return held.join(rarest, "piece").select("part", "text_hash").distinct()


def contained(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, text) where a text holds a part, letter case aside; null and empty ones are in none, and equal rows count once."""
    spelt = parts.filter("part <> ''").select("part").distinct()
    written_out = texts.filter("text <> ''").select("text").distinct()
    near = containment_candidates(spelt, written_out).withColumnRenamed("part", "low")
    near = near.join(written_out.withColumn("text_hash", F.xxhash64("text")), "text_hash").filter(F.lower("text").contains(F.col("low")))
    return near.join(spelt.withColumn("low", F.lower("part")), "low").select("part", "text")


def signals(functions: DataFrame, edges: DataFrame, classes: DataFrame, artifacts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row of signals for each stub (name, file_path) of ``functions(name, file_path, is_stub, docstring, body_shape)``.

    A name's callers are the distinct callers of it or of any qualified form.
    ``artifacts(subject, kind)`` tells which concepts state machines define or name.
    """
    stubs = functions.filter("is_stub").groupBy("name", "file_path").agg(F.max(F.trim(F.coalesce("docstring", F.lit("")))).alias("doc"), F.min("body_shape").alias("body"))
    first = G.first_per_key(classes, ["file_path"], [F.col("id")]).select(
        "file_path", F.col("name").alias("class_name"), F.coalesce(F.col("base_class").rlike(CONTRACT_BASES), F.lit(False)).alias("contract"), F.trim(F.coalesce("docstring", F.lit(""))).alias("class_doc"))
    rows = stubs.join(first, "file_path", "left").withColumn("lifecycle", is_lifecycle(F.col("name"), F.col("file_path")))
    rows = rows.withColumn("text", F.when((F.col("doc") == "") & F.col("lifecycle"), F.coalesce("class_doc", F.lit(""))).otherwise(F.col("doc")))
    rows = rows.withColumn("intent", has_intent(F.col("text"))).withColumn("removal", has_removal(F.col("text"))).withColumn("contract", F.coalesce(F.col("lifecycle") & F.col("contract"), F.lit(False)))
    rows = rows.withColumn("quality", F.when(F.col("doc") == "", "none").when(has_intent(F.col("doc")), "behavioral").otherwise("placeholder"))
    rows = rows.join(caller_counts(functions, edges, known).select("name", "callers"), "name", "left").na.fill(0, ["callers"])

    told = rows.select("name", "file_path", F.explode(N.concepts("doc")).alias("concept")).withColumn("part", N.concept_base("concept"))
    texts = functions.select(F.col("name").alias("text")).unionByName(functions.select(F.col("file_path").alias("text"))).unionByName(classes.select(F.col("name").alias("text"))).unionByName(classes.select(F.col("file_path").alias("text")))
    parts = told.select("part").distinct()
    present = contained(parts, texts.distinct()).select("part").distinct().withColumn("present", F.lit(True))
    named = contained(parts, artifacts.filter(F.col("kind").isin(*FSM_KINDS)).select(F.col("subject").alias("text")).distinct())
    own = F.lower("text").startswith(F.concat(F.lower("part"), F.lit(".")))
    machines = named.groupBy("part").agg(F.max(own).alias("defined"))
    by = told.join(present, "part", "left").join(machines, "part", "left").groupBy("name", "file_path").agg(
        F.count_if(F.col("present").isNull()).alias("absent"), F.count_if("present").alias("there"), F.max(F.coalesce("defined", F.lit(False))).alias("fsm_defined"), F.max(F.coalesce(~F.col("defined"), F.lit(False))).alias("fsm_named"))
    rows = rows.join(by, ["name", "file_path"], "left").na.fill(0, ["absent", "there"]).na.fill(False, ["fsm_defined", "fsm_named"])

    shape = functions.groupBy("file_path").agg(F.count(F.lit(1)).alias("in_file"), F.count_if("is_stub").alias("stubs_in_file"), F.count_if(F.col("is_stub") & has_removal(F.col("docstring"))).alias("removed_in_file"))
    mine = functions.groupBy("file_path", "name").agg(F.count_if("is_stub").alias("own_stubs"), F.count_if(~F.col("is_stub")).alias("own_live"), F.count_if(F.col("is_stub") & has_removal(F.col("docstring"))).alias("own_removed"))
    rows = rows.join(shape, "file_path").join(mine, ["file_path", "name"])
    siblings = F.col("stubs_in_file") - F.col("own_stubs")
    rows = rows.withColumn("siblings", siblings).withColumn("live_siblings", F.col("in_file") - F.col("stubs_in_file") - F.col("own_live"))
    rows = rows.withColumn("trend", F.when(F.col("siblings") > 0, (F.col("removed_in_file") - F.col("own_removed")) / F.col("siblings")).otherwise(0.0))
    held = classes.groupBy("file_path").agg(F.count(F.lit(1)).alias("classes"), F.min(F.lower(F.substring_index("name", ".", -1))).alias("only"))
    like = functions.join(held.filter("classes = 1"), "file_path").filter(F.expr("lower(name) RLIKE concat('^', only, '[.]|[.]', only, '[.]|^..', only)")).groupBy("file_path").agg(F.count(F.lit(1)).alias("method_like"))
    rows = rows.join(held.select("file_path", "classes"), "file_path", "left").join(like, "file_path", "left").na.fill(0, ["classes", "method_like"])
    character = F.when(F.col("classes") == 0, "utility_bag").when(F.col("classes") >= 2, "multi_concept").when(F.col("method_like") >= 0.5 * F.col("in_file"), "single_class").otherwise("mixed")
    body = F.when(F.lower(F.substring_index("file_path", ".", -1)).isin("json", "yaml", "yml", "toml"), "config_declared").otherwise(F.coalesce("body", F.lit("unknown")))
    return rows.withColumn("character", character).withColumn("body", body).withColumn("in_tests", is_test_file(F.col("file_path"))).withColumn("assigns", F.lit(True))


def scored(s: DataFrame) -> DataFrame:
    """``signals`` with a raw score for each reading, in columns of the readings' names."""
    c = F.col
    add = lambda *terms: sum((F.when(when, value).otherwise(0.0) for when, value in terms[1:]), F.when(terms[0][0], terms[0][1]).otherwise(0.0))
    called, none, some, absent = c("callers") > 0, c("callers") == 0, c("there") > 0, c("absent") > 0
    live, declared = called & ~c("in_tests"), c("body") == "config_declared"
    late = ~declared  # a stub that a configuration declares is judged by what comes before its body
    unfilled = live & c("quality").isin("none", "placeholder") & (c("body") == "empty_pass") & ~c("intent")
    many, dying = c("siblings") >= 3, c("trend") >= 0.5
    gone = add((c("removal"), 1.5), (absent & ~some & none, 1.2), (absent & ~some & called, 0.5), (none, 0.2), (late & many & dying, 0.5 + c("trend") * 0.8), (late & (c("character") == "multi_concept"), 0.1), (late & (c("quality") == "placeholder"), 0.2))
    blocked = add((absent & ~some & called, 0.8), (absent & some, 1.0), (live, 0.2), (unfilled, 1.0), (declared, 0.6), (late & (c("body") == "trivial_return"), 0.3), (late & many & ~dying, 0.4), (late & (c("character") == "single_class"), 0.1))
    design = add((c("intent") & ~c("removal"), 1.2), (some & ~absent, 0.3), (live, 0.3 * F.least(c("callers"), F.lit(3))), (declared, 1.8), (late & (c("body") == "trivial_return"), 0.2), (late & (c("body") == "raise_not_impl"), 0.5),
                 (late & many & ~dying, 0.2), (late & c("siblings").between(1, 2), 0.1), (late & (c("character") == "single_class"), 0.15))
    unknown = add((none, 0.4), (called & c("in_tests"), 0.5), (late & (c("body") == "empty_pass"), 0.2), (late & (c("character") == "utility_bag"), 0.15), (late & (c("quality") == "none"), 0.3))
    # Methods of a class's life: contracts are design; a constructor that sets nothing is unfinished, or right where the class works.
    life = late & c("lifecycle")
    contract, idle = life & c("contract"), life & ~c("contract") & ~c("assigns")
    stateless, unbuilt = idle & (c("live_siblings") >= 1), idle & (c("live_siblings") < 1)
    design = design + add((contract, 1.5))
    unknown = F.when(contract, F.greatest(unknown - 0.5, F.lit(0.0))).when(stateless, F.least(unknown, F.lit(0.1))).when(unbuilt, unknown + 0.2).otherwise(unknown)
    blocked = F.when(stateless, 0.0).otherwise(blocked + add((unbuilt, 0.6))) + add((life & many & ~c("contract"), 0.4))
    blocked = blocked + add((late & c("fsm_named") & ~c("fsm_defined"), 0.8))
    design = design + add((late & c("fsm_defined"), 0.3))
    return s.withColumns(dict(zip(READINGS, (gone, blocked, design, unknown), strict=True)))


def classify_stubs(functions: DataFrame, edges: DataFrame, classes: DataFrame, artifacts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, file_path, callers, reading, score): each stub's best reading; genuinely-unknown with 0 where none reaches 0.2."""
    rows = scored(signals(functions, edges, classes, artifacts, known))
    entry = lambda k, name: F.struct(F.bround(F.least(F.col(f"`{name}`") / FULL_SCORE, F.lit(1.0)), 2).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("reading"), (F.col(f"`{name}`") / FULL_SCORE >= LEAST_SCORE).alias("counts"))
    best = F.array_max(F.filter(F.array(*(entry(k, n) for k, n in enumerate(READINGS))), lambda e: e["counts"]))
    rows = rows.withColumn("best", best)
    return rows.select("name", "file_path", "callers", F.coalesce(F.col("best.reading"), F.lit(READINGS[3])).alias("reading"), F.coalesce(F.col("best.score"), F.lit(0.0)).alias("score"))


def rank_stubs(functions: DataFrame, edges: DataFrame, classes: DataFrame, artifacts: DataFrame, mode: str = "priority", n: int | None = 20) -> DataFrame:
    """(name, file_path, reading, score, composite): callers x score + 5 for a tail, 2 for a middle + 3 for a convention's outlier, test files aside.

    'priority' keeps stubs that wait or whose design is stated, 'gap' keeps
    all by reading and score, 'perusal' the three highest of all.
    """
    if mode not in ("priority", "gap", "perusal"):
        raise ValueError(f"no mode {mode}")
    edges = written(edges.select("caller", "callee").distinct(), "judged-edges")  # read by both of the next, which count distinct ends
    known = known_calls(functions, edges)
    rows = classify_stubs(functions, edges, classes, artifacts, known).filter(~F.lower("file_path").rlike("test.|.test"))
    odd = convention_members(functions, edges, False).filter("is_stub AND diverges <> ''").select("name").distinct().withColumn("odd", F.lit(3))
    rows = rows.join(chain_positions(functions, edges, known), "name", "left").join(odd, "name", "left").na.fill(0, ["odd"])
    bonus = F.when(F.col("position") == "tail", 5).when(F.col("position") == "middle", 2).otherwise(0)
    rows = rows.select("name", "file_path", "reading", "score", F.round(F.col("callers") * F.col("score") + bonus + F.col("odd"), 4).alias("composite"))
    if mode == "gap":
        return rows.orderBy("reading", F.desc("score"), "name", "file_path")
    if mode == "priority":
        rows = rows.filter(F.col("reading").isin(*READINGS[1:3]))
    rows = rows.orderBy(F.desc("composite"), "name", "file_path")
    return rows.limit(3 if mode == "perusal" else n) if n or mode == "perusal" else rows
