"""Design documents: their catalogue, the rules in them, conflicts and repetitions, layer rules and the imports that break them, and claims held against a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt, spread, written
from .text import CONSTRAINT

#: Signals of document types in the order that settles ties, and what isn't a document.
TYPE_SIGNALS = {
    "changelog": ("changelog", "change log", "release notes", "history", "## [", "### ["), "readme": ("readme", "# getting started", "## installation", "## usage", "## quickstart"),
    "design": ("design", "architect", "constitution", "constraint", "invariant", "authority", "must not", "shall not", "intent", "principles"), "notes": ("notes", "scratchpad", "todo", "brainstorm", "ideas")}
SKIP_DIRECTORIES = (
    ".git", ".venv", "venv", "env", "node_modules", "__pycache__", ".tox", "dist", "build", ".mypy_cache", ".pytest_cache", "migrations", "site-packages", "Lib", "Scripts", "Include", "lib", "bin",
    "include", "ai_context", "archive", "archives", "prompts", "external_corpora", "external", "vendor", "third_party")
SKIP_FILES = ("license", "licence", "contributing", "code_of_conduct", "security", "authors", "credits")
ENDINGS = ("md", "rst", "txt", "adoc")
MAX_BYTES = 512 * 1024
#: Ranks of confidence, and names that lend it.
RANKS = {"inferred": 0, "low": 1, "medium": 2, "high": 3, "authoritative": 4, "conflicted": -1}
HIGHEST_NAMES, HIGH_NAMES = ("CONSTITUTION", "CONSTRAINTS", "INVARIANT"), ("DESIGN", "ARCHITECTURE", "SPEC", "ASPIRATIONAL", "SYSTEM")
MUST_NOT = r"(?i)\b(must\s+not|must\s+never|shall\s+not|never|forbidden|prohibited|may\s+not)\b"
MUST = r"(?i)\b(must(?!\s+not)|shall(?!\s+not)|required\s+to|is\s+required)\b"
LAYER_RULE = r"(?i)`?([A-Za-z0-9_./]+)`?\s+(?:must not|cannot|should not|is forbidden (?:from|to))\s+(?:import from|depend on|import|use)\s+`?([A-Za-z0-9_./]+)`?"
STOP_WORDS = ("must", "should", "never", "only", "shall", "that", "this", "with", "from", "into", "when", "not", "may", "will", "are", "the", "and", "for", "its", "any", "all")
SUBJECT_SKIP = ("the", "a", "an", "of", "for", "in", "on", "at", "to", "and")


def _lines(text: Column) -> Column:
    """Lines of a text; a line end at its end opens no further one."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n"))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _any(text: Column, words: tuple) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def doc_type(name: Column, text: Column) -> Column:
    """The type with the highest count of signals, three for one in the name and one for one in the first 3000 characters; 'unknown' without any."""
    low, head = F.lower(name), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 3000))
    score = {t: sum((low.contains(s).cast("int") * 3 + head.contains(s).cast("int") for s in signals), F.lit(0)) for t, signals in TYPE_SIGNALS.items()}
    best = F.greatest(*score.values())
    out = F.lit("unknown")
    for t in reversed(TYPE_SIGNALS):
        out = F.when(score[t] == best, t).otherwise(out)
    return F.when(best > 0, out).otherwise("unknown")


def catalogue(files: DataFrame) -> DataFrame:
    """(file_path, doc_type, heading_count, constraint_score, confidence, text) of the documents among ``files(file_path, text)``.

    Hidden and foreign directories, other endings, files over 512 KB and
    licences and the like are left out.
    """
    parts = F.split("file_path", "/")
    stem = F.lower(F.regexp_replace(_name(F.col("file_path")), r"\.[^.]*$", ""))
    ending = F.lower(F.regexp_extract(_name(F.col("file_path")), r"\.([^.]*)$", 1))
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIP_DIRECTORIES))
    docs = spread(files.filter(~hidden & ending.isin(*ENDINGS) & ~stem.isin(*SKIP_FILES) & (F.octet_length(F.coalesce("text", F.lit(""))) <= MAX_BYTES)))
    lines = _lines(F.col("text"))
    share = F.size(F.filter(lines, lambda x: x.rlike(CONSTRAINT))) / F.greatest(F.size(lines), F.lit(1))
    docs = docs.select("file_path", doc_type(_name(F.col("file_path")), F.col("text")).alias("doc_type"), F.size(F.filter(lines, lambda x: x.rlike(r"^#{1,4}\s+."))).alias("heading_count"), F.bround(share, 3).alias("constraint_score"), "text")
    upper, score = F.upper(_name(F.col("file_path"))), F.col("constraint_score")
    grade = (F.when((score >= 0.12) | _any(upper, HIGHEST_NAMES), "authoritative").when((score >= 0.05) | ((F.col("doc_type") == "design") & _any(upper, HIGH_NAMES)), "high")
             .when((F.col("doc_type") == "readme") | (score >= 0.01), "medium").otherwise("low"))
    return docs.withColumn("confidence", grade).select("file_path", "doc_type", "heading_count", "constraint_score", "confidence", "text")


def subject_of(heading: Column) -> Column:
    """A key for a heading: its first word if that is a CamelCase name, else its first three words that mean something, in snake case."""
    h = F.trim(F.regexp_replace(heading, r"^[A-Za-z]{0,2}\d*\.\s*", ""))
    h = F.trim(F.get(F.split(h, "[:(]"), F.lit(0)))
    words = F.filter(F.split(h, r"\s+"), lambda w: w != "")
    real = F.filter(words, lambda w: ~F.lower(w).isin(*SUBJECT_SKIP))
    base = F.array_join(F.slice(F.when(F.size(real) > 0, real).otherwise(words), 1, 3), "_")
    snake = F.lower(F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    head = F.substring(heading, 1, 40)
    return F.when(F.size(words) == 0, head).when(F.get(words, F.lit(0)).rlike("^[A-Z][a-z]+[A-Z]"), F.get(words, F.lit(0))).otherwise(F.when(snake == "", head).otherwise(snake))


def lowered(confidence: Column) -> Column:
    return F.when(confidence == "authoritative", "high").when(confidence == "high", "medium").when(confidence == "medium", "low").otherwise("inferred")


def extract_rules(docs: DataFrame) -> DataFrame:
    """(file_path, section, heading, subject, rule, kind, confidence) of every headed section of ``docs(file_path, text, confidence)``.

    A section's sentences of constraint, each once and eight at most, are the
    rule: constraint, requirement or permission. A section without is intent,
    its first 600 characters, of the next lower confidence. Lines before the
    first heading have the file's name as subject.
    """
    rows = docs.select("file_path", "confidence", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("is_heading", F.col("line").rlike(r"^#{1,4}\s+."))
    rows = rows.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(Window.partitionBy("file_path").orderBy("at")))
    kept = F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("at", "line"))))
    parts = rows.groupBy("file_path", "confidence", "section").agg(F.max(F.when(F.col("is_heading"), F.trim(F.regexp_extract("line", r"^#{1,4}\s+(.+)", 1)))).alias("heading"), kept.alias("kept"))
    parts = parts.withColumn("heading", F.coalesce("heading", F.lit(""))).withColumn("lines", F.transform("kept", lambda k: k["line"]))
    parts = parts.withColumn("body", F.regexp_replace(F.array_join("lines", "\n"), r"\A\s+|\s+\z", "")).filter("body <> ''")
    told = F.transform(F.split("body", "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-•*]+", "")))
    told = F.filter(told, lambda x: (F.length(x) >= 10) & x.rlike(CONSTRAINT))
    # Columns of their own: inside the functions of the next filter they would be computed for every sentence anew.
    parts = parts.withColumn("told", told).withColumn("low", F.transform("told", lambda x: F.lower(x)))
    first = F.filter("told", lambda x, k: F.array_position("low", F.lower(x)) == k + 1)
    parts = parts.withColumn("told", F.slice(first, 1, 8)).drop("low")
    text = F.when(F.size("told") > 0, F.array_join("told", " | ")).otherwise(F.substring("body", 1, 600))
    rule = F.when(F.col("heading") != "", F.concat(F.lit("["), "heading", F.lit("] "), text)).otherwise(text)
    parts = parts.withColumn("rule", rule)
    kind = F.when(F.size("told") == 0, "intent").when(F.col("rule").rlike(MUST_NOT), "constraint").when(F.col("rule").rlike(MUST), "requirement").otherwise("permission")
    stem = F.regexp_replace(_name(F.col("file_path")), r"\.[^.]*$", "")
    return parts.select(
        "file_path", "section", "heading", F.when(F.col("heading") != "", subject_of(F.col("heading"))).otherwise(stem).alias("subject"), "rule", kind.alias("kind"),
        F.when(F.size("told") > 0, F.col("confidence")).otherwise(lowered(F.col("confidence"))).alias("confidence"))


def conflicts(rules: DataFrame) -> DataFrame:
    """``rules`` with confidence 'conflicted' where a constraint and a requirement of one subject, of two files, share two terms of four letters and more.

    Each pair of terms tells whether the other kind has a file beside one's
    own, by its least and largest, so no pair of rules is made. Terms are
    paired for subjects alone of which two files state both kinds.
    """
    rules = written(rules, "rules")
    found = F.regexp_extract_all(F.lower("rule"), F.lit(r"\b\w{4,}\b"), F.lit(0))
    terms = F.sort_array(F.array_except(F.array_distinct(found), F.array(*(F.lit(w) for w in STOP_WORDS))))
    after = lambda t, k: F.transform(F.slice(F.col("terms"), k + 2, F.size("terms")), lambda u: F.concat_ws(" ", t, u))
    stated = rules.filter("kind IN ('constraint', 'requirement')")
    split = stated.groupBy("subject").agg(F.min("kind").alias("k"), F.max("kind").alias("l"), F.min("file_path").alias("f"), F.max("file_path").alias("g")).filter("k <> l AND f <> g").select("subject")
    listed = stated.join(dealt(split), "subject", "left_semi").select("file_path", "section", "subject", "kind", terms.alias("terms"))
    listed = listed.select("file_path", "section", "subject", "kind", F.explode(F.flatten(F.transform("terms", after))).alias("pair"))
    other = F.when(F.col("kind") == "constraint", "requirement").otherwise("constraint")
    files = listed.groupBy("subject", other.alias("kind"), "pair").agg(F.min("file_path").alias("low"), F.max("file_path").alias("high"))
    bad = listed.join(dealt(files), ["subject", "kind", "pair"]).filter("low <> file_path OR high <> file_path").select("file_path", "section").distinct().withColumn("bad", F.lit(True))
    return rules.join(dealt(bad), ["file_path", "section"], "left").withColumn("confidence", F.when(F.col("bad"), "conflicted").otherwise(F.col("confidence"))).drop("bad")


def deduplicated(rules: DataFrame) -> DataFrame:
    """Of rules whose subject and first 60 characters, signs and case aside, are equal the one of highest confidence, then the first by file and section."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(F.trim("rule")), r"\s+", " "), r"[^\w\s]", "")
    rank = F.create_map(*(F.lit(x) for item in RANKS.items() for x in item))
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("__rank"), "file_path", "section"))
    rows = rules.withColumn("__key", F.concat(F.lower("subject"), F.lit("::"), F.substring(norm, 1, 60))).withColumn("__rank", F.coalesce(F.try_element_at(rank, F.col("confidence")), F.lit(0)))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__key", "__rank", "__place")


def layer_rules(docs: DataFrame) -> DataFrame:
    """(from_layer, to_layer, source) of every forbidden import that ``docs(file_path, text)`` state, once a document."""
    rows = docs.select(F.col("file_path").alias("source"), F.explode(_lines(F.col("text"))).alias("line")).filter(F.col("line").rlike(LAYER_RULE))
    layer = lambda k: F.lower(F.translate(F.regexp_replace(F.regexp_extract("line", LAYER_RULE, k), "^/+|/+$", ""), "/", "."))
    return rows.select(layer(1).alias("from_layer"), layer(2).alias("to_layer"), "source").distinct()


def layer_violations(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_path, from_layer, forbidden_import, line_number, to_layer, source): imports that leave a layer for one forbidden to it.

    A file is of every layer that some stretch of its directories, as a dotted
    name, begins or ends with; an import is of every layer that its module
    begins with. Both are equi-joins.
    """
    from ..functions import names as N

    layers = rules.filter("from_layer <> '' AND to_layer <> ''")
    files = imports.select("file_path").distinct()
    folders = F.filter(F.split(F.translate("file_path", "\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    folders = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))), lambda k: F.array_join(F.slice(folders, k, F.size(folders)), "."))
    names = files.select("file_path", F.explode(F.array_distinct(F.concat(folders, tails))).alias("name")).filter("name <> ''")
    of = names.select("file_path", F.explode(F.array_distinct(F.concat(N.prefix_keys("name"), N.suffix_keys("name")))).alias("from_layer")).distinct()
    known = imports.select("file_path", "module", "line_number", F.explode(N.prefix_keys("module")).alias("to_layer"))
    return layers.join(of, "from_layer").join(known, ["file_path", "to_layer"]).select("file_path", "from_layer", F.col("module").alias("forbidden_import"), "line_number", "to_layer", "source")


#: How answers state calls, missing callers and methods, and words that are no names.
CALLS = (r"(?i)\b(\w+)\s+calls?\s+into\s+(\w+)", r"(?i)\b(\w+)\s+calls?\s+(\w+)", r"(?i)\b(\w+)\s+invokes?\s+(\w+)")
NO_CALLERS = (
    r"(?i)\b(\w+)\s+has\s+no\s+(?:direct\s+)?callers?", r"(?i)\b(\w+)\s+is\s+not\s+called\b", r"(?i)no\s+(?:direct\s+)?callers?\s+(?:of|for)\s+(\w+)", r"(?i)nothing\s+calls?\s+(\w+)",
    r"(?i)\b(\w+)\s+(?:has\s+)?no\s+callers?\b")
HAS_METHOD = (
    r"""(?i)\b(\w+)\s+has\s+(?:a\s+)?[`'"]?(\w+)[`'"]?\s+method\b""", r"""(?i)\b(\w+)'s\s+[`'"]?(\w+)[`'"]?\s+method\b""",
    r"""(?i)\bclass\s+(\w+)\s+(?:implements|defines|provides)\s+(?:a\s+)?[`'"]?(\w+)[`'"]?\b""", r"(?i)\b(\w+)\.(\w+)\s*\(\)")
NOISE_WORDS = (
    "it", "this", "that", "the", "and", "or", "not", "also", "which", "then", "when", "if", "is", "are", "was", "were", "be", "a", "an", "what", "who", "where", "how", "why", "via", "its", "any", "all")


def extract_claims(answers: DataFrame) -> DataFrame:
    """(answer_id, kind, subject, object) of the structural claims of ``answers(answer_id, text)``, each once, letter case aside; the first spelling by name."""
    text = F.coalesce("text", F.lit(""))
    found = []
    for kind, patterns, two in (("CALLS", CALLS, True), ("NO_CALLERS", NO_CALLERS, False), ("HAS_METHOD", HAS_METHOD, True)):
        for p in patterns:
            subjects = F.regexp_extract_all(text, F.lit(p), F.lit(1))
            objects = F.regexp_extract_all(text, F.lit(p), F.lit(2)) if two else F.transform(subjects, lambda s: F.lit(""))
            found.append(F.transform(F.arrays_zip(subjects.alias("subject"), objects.alias("object")), lambda c: F.struct(F.lit(kind).alias("kind"), c["subject"].alias("subject"), c["object"].alias("object"))))  # noqa: B023
    rows = answers.select("answer_id", F.explode(F.concat(*found)).alias("c")).select("answer_id", "c.*")
    real = lambda c: (F.length(c) >= 3) & ~F.lower(c).isin(*NOISE_WORDS)
    rows = rows.filter(real("subject") & (real("object") | (F.col("kind") == "NO_CALLERS")))
    return rows.groupBy("answer_id", "kind", F.lower("subject").alias("s"), F.lower("object").alias("o")).agg(F.min(F.struct("subject", "object")).alias("c")).select("answer_id", "kind", "c.subject", "c.object")


def verify_claims(claims: DataFrame, edges: DataFrame, functions: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """``claims(kind, subject, object)`` with verdict and fact: refuted, with what is so instead, or unrefuted.

    A call is refuted by other calls of its subject, a method by the class's
    other methods, letter case aside, missing callers by any caller; subjects
    that the corpus doesn't know are refuted as such. Facts name four callees
    or callers and six methods at most, by name.
    """
    few = lambda c, n: F.array_join(F.slice(F.sort_array(F.collect_set(c)), 1, n), ", ")
    out = edges.groupBy(F.col("caller").alias("subject")).agg(few("callee", 4).alias("callees"))
    into = edges.groupBy(F.col("callee").alias("subject")).agg(few("caller", 4).alias("callers"))
    pairs = edges.select(F.col("caller").alias("subject"), F.col("callee").alias("object")).distinct().withColumn("is_edge", F.lit(True))
    named = functions.select(F.col("name").alias("subject")).distinct().withColumn("is_function", F.lit(True))
    typed = classes.select(F.col("name").alias("subject")).distinct().withColumn("is_class", F.lit(True))
    own = methods.groupBy(F.col("class_name").alias("subject")).agg(few("method", 6).alias("methods"))
    have = methods.select(F.col("class_name").alias("subject"), F.lower("method").alias("low")).distinct().withColumn("has", F.lit(True))
    rows = claims.withColumn("low", F.lower("object"))
    for other, key in ((out, "subject"), (into, "subject"), (named, "subject"), (typed, "subject"), (own, "subject")):
        rows = rows.join(other, key, "left")
    rows = rows.join(pairs, ["subject", "object"], "left").join(have, ["subject", "low"], "left")
    unknown = F.concat("subject", F.lit(" does not exist in this codebase"))
    fact = (F.when((F.col("kind") == "CALLS") & F.col("is_edge").isNull(), F.when(F.col("callees").isNotNull(), F.concat("subject", F.lit(" calls: "), "callees")).when(F.col("is_function").isNull(), unknown))
            .when((F.col("kind") == "NO_CALLERS") & F.col("callers").isNotNull(), F.concat("subject", F.lit(" callers: "), "callers"))
            .when((F.col("kind") == "HAS_METHOD") & F.col("is_class").isNull(), F.when(F.col("is_function").isNull(), unknown))
            .when((F.col("kind") == "HAS_METHOD") & F.col("has").isNull(), F.concat("subject", F.lit(" methods: "), F.coalesce(F.when(F.col("methods") != "", F.col("methods")), F.lit("(none recorded)")))))
    return rows.withColumn("fact", fact).select(*claims.columns, F.when(F.col("fact").isNotNull(), "refuted").otherwise("unrefuted").alias("verdict"), "fact")
