"""What is known of symbols, files and features, and what is missing: signals, drift of documents, contracts for completing stubs, coverage, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.shared import written
from . import graph as G
from .judgment import READINGS, classify_stubs, contained
from .stubs import by_name, chain_positions, concept_ghosts, convention_members, known_calls

#: Words that name no import, language of unfinished work, and kinds of artifacts that tell of symbols.
IMPORT_NOISE = (
    "get", "set", "add", "run", "load", "save", "init", "main", "make", "build", "find", "show", "list", "move", "type", "from", "with", "self", "data", "info", "none")
STALE_WORDS = ("todo", "stub", "placeholder", "not implemented")
SYMBOL_KINDS = ("design_note", "strategy_decision", "query_finding", "known_issue")
BADGES = {"design-intent-stated": "DESIGN-INTENT", "blocked-on-prerequisite": "BLOCKED", "genuinely-unknown": "UNCERTAIN"}


def data_flow(edges: DataFrame) -> DataFrame:
    """(symbol, direction, other): whose values a symbol takes ('in') and who takes its own ('out')."""
    flow = edges.filter("edge_type = 'data_flow'")
    taken = flow.select(F.col("source_id").alias("symbol"), F.lit("in").alias("direction"), F.col("target_id").alias("other"))
    return taken.unionByName(flow.select(F.col("target_id").alias("symbol"), F.lit("out").alias("direction"), F.col("source_id").alias("other")))


def call_routes(edges: DataFrame, start: str, depth: int = 10) -> DataFrame:
    """(node, depth, fanout) of what a symbol reaches, itself with depth 0."""
    spark = edges.sparkSession
    found = G.reach(edges, spark.createDataFrame([(start,)], "root string"), depth, include_root=True)
    fan = G.pairs(edges).groupBy(F.col("caller").alias("node")).agg(F.count("callee").alias("fanout"))
    return found.join(fan, "node", "left").select("node", "depth", F.coalesce("fanout", F.lit(0)).alias("fanout"))


def artifact_signals(names: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(name, dead, inline_notes, design_note): artifacts(subject, kind, content) that speak of ``names(name)``.

    A dead mark's subject ends with the name, a note's is the name, a design
    note's content holds it, letter case aside.
    """
    own = names.select("name").distinct()
    marks = artifacts.filter("kind = 'dead'").select(F.lower("subject").alias("text")).distinct()
    ends = contained(own.select(F.col("name").alias("part")), marks).filter(F.col("text").endswith(F.lower("part"))).select(F.col("part").alias("name")).distinct().withColumn("dead", F.lit(True))
    notes = artifacts.filter("kind = 'inline_note'").groupBy(F.col("subject").alias("name")).agg(F.count(F.lit(1)).alias("inline_notes"))
    told = contained(own.select(F.col("name").alias("part")), artifacts.filter("kind = 'design_note'").select(F.col("content").alias("text")).distinct()).select(F.col("part").alias("name")).distinct().withColumn("design_note", F.lit(True))
    return own.join(ends, "name", "left").join(notes, "name", "left").join(told, "name", "left").na.fill(False, ["dead", "design_note"]).na.fill(0, ["inline_notes"])


def return_type_signals(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, file_path, type, known) of stubs that return a named type, and whether a class bears that name."""
    typed = functions.filter("is_stub").select("name", "file_path", N.named_type("return_type").alias("type")).filter("type IS NOT NULL").distinct()
    return typed.join(classes.select(F.col("name").alias("type")).distinct().withColumn("known", F.lit(True)), "type", "left").select("name", "file_path", "type", F.coalesce("known", F.lit(False)).alias("known"))


def import_signals(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(name, file_path, tokens, unmatched): a stub's first eight telling words, of its docstring and then its name, and those that no imported module holds."""
    real = lambda words: F.filter(words, lambda t: (F.length(t) >= 5) & ~t.isin(*IMPORT_NOISE))
    doc = F.transform(F.regexp_extract_all(F.coalesce("docstring", F.lit("")), F.lit(r"\b[A-Za-z]\w{4,}\b"), F.lit(0)), lambda t: F.lower(t))
    words = F.slice(F.array_distinct(F.concat(real(doc), real(F.split(F.lower("name"), r"[_\s]+")))), 1, 8)
    rows = functions.filter("is_stub").groupBy("name", "file_path").agg(F.max(F.coalesce("docstring", F.lit(""))).alias("docstring")).select("name", "file_path", words.alias("words"))
    listed = rows.select("name", "file_path", F.explode("words").alias("part"))
    found = contained(listed.select("part"), imports.select(F.col("module").alias("text")).distinct()).select("part").distinct().withColumn("found", F.lit(True))
    return listed.join(found, "part", "left").groupBy("name", "file_path").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("found").isNull()).alias("unmatched"))


def doc_drift(functions: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(file_path, name, gap): uncalled entry points and stubs without a design note, and implemented functions whose docstring still speaks of unfinished work."""
    tier = N.entry_tier(F.col("name"), F.col("file_path"), F.col("is_tool"), F.col("http_route"))
    noted = contained(functions.select(F.col("name").alias("part")).distinct(), artifacts.filter("kind = 'design_note'").select(F.col("subject").alias("text")).distinct()).select(F.col("part").alias("name")).distinct()
    live = functions.filter("NOT is_stub").select("file_path", "name", "docstring", tier.alias("tier"))
    free = live.filter("tier NOT IN ('protocol', 'test')").join(G.known_callees(edges), "name", "left_anti").join(noted, "name", "left_anti")
    entry = free.select("file_path", "name", F.when(F.col("tier") == "inferred", "inferred_entry_point").otherwise("explicit_entry_point").alias("gap"))
    low, stale = F.lower(F.coalesce("docstring", F.lit(""))), F.lit(False)
    for w in STALE_WORDS:
        stale = stale | low.contains(w)
    old = live.filter(stale).select("file_path", "name", F.lit("stale_docstring").alias("gap"))
    stubs = functions.filter("is_stub").join(noted, "name", "left_anti").select("file_path", "name", F.lit("stub_without_note").alias("gap"))
    return entry.unionByName(old).unionByName(stubs).distinct()


def completion_contracts(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, callers, live_callees, stub_callees, missing_callees) of every stub: whom it must satisfy, what it can use, what it waits for.

    Callees are matched by their last segment; undotted callees that no
    function bears and that aren't built in are missing.
    """
    known = known_calls(functions, edges)
    stubs = by_name(functions).filter("is_stub").select("name")
    callers = known.groupBy("name").agg(F.count("caller").alias("callers"))
    uses = known.groupBy(F.col("caller").alias("name")).agg(F.count_if(~F.col("callee_stub")).alias("live_callees"), F.count_if("callee_stub").alias("stub_callees"))
    named = by_name(functions).select("name")
    lost = edges.select(F.col("caller").alias("of"), "callee").distinct().filter(~F.col("callee").contains(".") & ~F.col("callee").isin(*N.PYTHON_BUILTINS)).join(named.select(F.col("name").alias("callee")), "callee", "left_anti")
    missing = lost.groupBy(F.col("of").alias("name")).agg(F.count(F.lit(1)).alias("missing_callees"))
    return stubs.join(callers, "name", "left").join(uses, "name", "left").join(missing, "name", "left").na.fill(0)


def symbol_findings(functions: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """(name, is_stub, callees, importing_files): what the tables say of each function by name; files that import a module named like its file, by the first file."""
    out = edges.groupBy(F.col("caller").alias("name")).agg(F.countDistinct("callee").alias("callees"))
    rows = by_name(functions).withColumn("part", F.regexp_replace(F.substring_index(F.translate("file_path", "\\", "/"), "/", -1), r"\.py", ""))
    modules = contained(rows.select("part").distinct(), imports.select(F.col("module").alias("text")).distinct()).withColumnRenamed("text", "module")
    files = imports.select("file_path", "module").distinct().join(modules, "module").groupBy("part").agg(F.countDistinct("file_path").alias("importing_files"))
    return rows.join(out, "name", "left").join(files, "part", "left").na.fill(0, ["callees", "importing_files"]).select("name", "is_stub", "callees", "importing_files")


def coverage(files: DataFrame, functions: DataFrame, classes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(what, total, known): files, by name, with a stated purpose; symbols with a note or finding; decisions on chains."""
    names = files.select(F.substring_index(F.translate("file_path", "\\", "/"), "/", -1).alias("s")).distinct()
    symbols = functions.select(F.col("name").alias("s")).unionByName(classes.select(F.col("name").alias("s"))).distinct()

    def share(what: str, own: DataFrame, told: DataFrame) -> DataFrame:
        marked = own.join(told.select(F.col("subject").alias("s")).distinct().withColumn("k", F.lit(1)), "s", "left")
        return marked.agg(F.count(F.lit(1)).alias("total"), F.count("k").alias("known")).select(F.lit(what).alias("what"), "total", "known")

    chains = artifacts.filter("kind = 'strategy_decision' AND subject LIKE 'chain::%'").select("subject").distinct().agg(F.count(F.lit(1)).alias("total"))
    return share("files", names, artifacts.filter("kind = 'file_purpose'")).unionByName(share("symbols", symbols, artifacts.filter(F.col("kind").isin(*SYMBOL_KINDS)))).unionByName(
        chains.select(F.lit("chains").alias("what"), "total", F.col("total").alias("known")))


def knowledge_status(artifacts: DataFrame) -> DataFrame:
    """(what, n): artifacts in all, by kind, by the prefix of their subject, and those that need review."""
    kinds = artifacts.groupBy(F.concat(F.lit("kind:"), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    prefix = F.substring_index("subject", "::", 1)
    marks = artifacts.filter(F.col("subject").contains("::")).groupBy(F.concat(prefix, F.lit("::")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    sums = artifacts.agg(F.count(F.lit(1)).alias("artifacts"), F.count_if("needs_review").alias("needs_review")).unpivot([], ["artifacts", "needs_review"], "what", "n")
    return kinds.unionByName(marks).unionByName(sums)


def corpus_verdict(functions: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(fact, n): stubs, directories that hold them, stubs that live code calls, and concepts of their docstrings that nothing bears."""
    stubs = functions.filter("is_stub")
    sums = stubs.agg(F.count(F.lit(1)).alias("stubs"), F.countDistinct(N.parent_directory("file_path")).alias("subsystems")).unpivot([], ["stubs", "subsystems"], "fact", "n")
    live = known_calls(functions, edges).filter("callee_stub AND NOT caller_stub").select("name").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("actionable").alias("fact"), "n")
    told = stubs.select("name", "docstring").unionByName(functions.select("name", F.lit(None).cast("string").alias("docstring")))
    ghosts = concept_ghosts(told, classes).filter("state = 'ghost'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("ghosts").alias("fact"), "n")
    return sums.unionByName(live).unionByName(ghosts)


def work_primer(functions: DataFrame, edges: DataFrame, classes: DataFrame, artifacts: DataFrame, n: int | None = 5) -> DataFrame:
    """(place, badge, name, callers, composite, handlers): what to begin with.

    State machines with unwritten actions and guards first, by how many; then
    stubs by callers x score + 5 for a tail, 2 for a middle + 3 for an outlier,
    without concepts that don't apply and scaffolds that at most one calls.
    """
    code = functions.filter(~F.lower("file_path").rlike("test.|.test"))
    handler = F.col("name").contains("::action::") | F.col("name").contains("::guard::")
    machines = code.filter(F.col("is_stub") & handler).groupBy(F.substring_index("name", "::", 1).alias("name")).agg(F.count(F.lit(1)).alias("handlers"))
    machines = machines.select(F.lit("FSM-SPEC").alias("badge"), "name", F.lit(0).cast("long").alias("callers"), F.lit(0.0).alias("composite"), "handlers", F.lit(0).alias("rank"))
    edges = written(edges.select("caller", "callee").distinct(), "judged-edges")  # read by both of the next, which count distinct ends
    known = known_calls(functions, edges)
    judged = classify_stubs(functions, edges, classes, artifacts, known).filter(~F.lower("file_path").rlike("test.|.test") & ~handler).filter(F.col("reading") != READINGS[0])
    bodies = functions.filter("is_stub").groupBy("name", "file_path").agg(F.min("body_shape").alias("body"), F.size(N.concepts(F.max(F.trim(F.coalesce("docstring", F.lit("")))))).alias("concepts"))
    judged = judged.join(bodies, ["name", "file_path"]).filter(~((F.coalesce("body", F.lit("")) == "empty_pass") & (F.col("concepts") == 0) & (F.col("callers") <= 1)))
    odd = convention_members(functions, edges, False).filter("is_stub AND diverges <> ''").select("name").distinct().withColumn("odd", F.lit(3))
    judged = judged.join(chain_positions(functions, edges, known), "name", "left").join(odd, "name", "left").na.fill(0, ["odd"])
    bonus = F.when(F.col("position") == "tail", 5).when(F.col("position") == "middle", 2).otherwise(0)
    badge = F.create_map(*(F.lit(x) for item in BADGES.items() for x in item))
    stubs = judged.select(F.element_at(badge, F.col("reading")).alias("badge"), "name", "callers", F.bround(F.col("callers") * F.col("score") + bonus + F.col("odd"), 1).alias("composite"), F.lit(0).cast("long").alias("handlers"), F.lit(1).alias("rank"))
    rows = machines.unionByName(stubs).orderBy("rank", F.desc("handlers"), F.desc("composite"), "name", "badge")
    return (rows.limit(n) if n else rows).drop("rank")


def context_bundle(file_path: str, functions: DataFrame, classes: DataFrame, imports: DataFrame, refs: DataFrame, mutations: DataFrame) -> DataFrame:
    """(kind, name, line_number) of everything recorded for a file."""
    own = lambda df, kind, name: df.filter(F.col("file_path") == file_path).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("line_number").cast("int").alias("line_number"))
    return (own(functions, "function", "name").unionByName(own(classes, "class", "name")).unionByName(own(imports, "import", "module")).unionByName(own(refs, "reference", "callee")).unionByName(own(mutations, "mutation", "operation")))
