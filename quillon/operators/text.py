"""Scans of texts line by line: markers, sentences of constraint, and four passes that find more sentences like them. Links and calls of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt, spread, written


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_number, line), lines counted from 1."""
    return docs.select(key, F.posexplode(F.split("text", "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_number"), "line")


def find_markers(docs: DataFrame, pattern: str = r"\b(TODO|FIXME|HACK|XXX)\b", key: str = "doc_id") -> DataFrame:
    """(key, line_number, marker, line) of lines with a marker."""
    return lines(docs, key).withColumn("marker", F.regexp_extract("line", pattern, 1)).filter("marker <> ''")


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, sentence): lines without list marks, numbered from 0; headings and what has under ten characters left out."""
    rows = docs.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    clean = F.col("line")
    for mark in (r"^[-*•]\s+", r"^\d+[.)]\s+", r"^[a-zA-Z][.)]\s+"):
        clean = F.regexp_replace(clean, mark, "")
    rows = rows.withColumn("sentence", F.trim(clean))
    return rows.filter((F.length("sentence") >= 10) & ~F.col("line").rlike(r"^#+\s")).select(key, "n", "sentence")


#: Patterns of obligation, action, definition and authority.
MODAL = r"(?i)\b(must not|must|shall not|shall|may not|never|required to|forbidden|prohibited|always|cannot|will not|is required)\b"
ACTION = r"(?i)\b(ensure|enforce|require|restrict|allow|prevent|provide|handle|validate|check|guarantee|return|accept|reject|maintain|store|expose|protect|support|initialize|manage)\b"
AUTHORITY = r"(?i)\b(layer|boundary|authority|system|component|module|interface|contract|engine|controller|manager)\b"
DEFINITION = r":\s+[A-Z]"
CONSTRAINT = r"(?i)\b(must not|must|may not|shall not|shall|never|forbidden|only|required|invariant|non-negotiable|always|prohibited|cannot|will not)\b"
#: Words of the sentence grammar.
MODAL_WORDS = ("must", "shall", "never", "required", "forbidden", "prohibited", "cannot", "always")
AUTHORITY_WORDS = ("layer", "boundary", "authority", "system", "component", "module", "interface", "contract", "engine", "controller", "manager", "service", "handler")
ACTION_WORDS = (
    "ensure", "enforce", "require", "restrict", "allow", "prevent", "provide", "handle", "validate", "check", "guarantee", "return", "accept", "reject", "maintain", "store", "expose", "protect",
    "support", "initialize", "manage")
METHODS = ("fca", "mdl", "wrapper", "grammar")


def words_of(sentence: Column) -> Column:
    return F.filter(F.split(sentence, r"\s+"), lambda w: w != "")


def features(sentence: Column | str) -> dict[str, Column]:
    """The binary features of a sentence."""
    c = F.col(sentence) if isinstance(sentence, str) else sentence
    size = F.size(words_of(c))
    return {
        "has_modal": c.rlike(MODAL), "has_verb": c.rlike(ACTION), "has_colon_def": c.rlike(DEFINITION), "has_authority": c.rlike(AUTHORITY), "is_short": size <= 20, "is_long": size > 40, "starts_upper": c.rlike(r"^\p{Lu}"),
    }


def structure_class(sentence: Column | str) -> Column:
    """modal, numbered, bullet, authoritative_prose or prose: the first that holds."""
    c = F.col(sentence) if isinstance(sentence, str) else sentence
    return (F.when(c.rlike(MODAL), "modal").when(c.rlike(r"^(\d+|[a-zA-Z])[.)]\s+"), "numbered").when(c.rlike(r"^[-*•]\s+"), "bullet")
            .when(c.rlike(DEFINITION) | c.rlike(AUTHORITY), "authoritative_prose").otherwise("prose"))


def constraint_sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence) of lines of at least ten characters, without list marks, with words of constraint."""
    rows = docs.select(key, F.explode(F.split(F.coalesce("text", F.lit("")), r"\r\n?|\n")).alias("line"))
    rows = rows.withColumn("sentence", F.trim(F.regexp_replace(F.trim("line"), r"^[-•*]+", "")))
    return rows.filter((F.length("sentence") >= 10) & F.col("sentence").rlike(CONSTRAINT)).select(key, "sentence")


def normalized(sentence: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(sentence)), r"\s+", " ")


def _plain(sentence: Column | str) -> Column:
    """Lower-cased words without signs."""
    return words_of(F.lower(F.regexp_replace(sentence, r"[^\w\s]", "")))


def fca_hits(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n) of sentences that share enough features with all of their text's seeds: all but two, two at least; where seeds share none, with any of them."""
    f = features("sentence")
    marked = rows.select(key, "n", "seed", *(c.alias(name) for name, c in f.items()))
    common = marked.filter("seed").groupBy(key).agg(*(F.bool_and(name).alias(f"all_{name}") for name in f), *(F.bool_or(name).alias(f"any_{name}") for name in f))
    count = lambda cols: sum((c.cast("int") for c in cols[1:]), cols[0].cast("int"))
    shared = count([F.col(f"all_{n}") for n in f])
    joined = marked.filter("NOT seed").join(dealt(common), key).withColumn("shared", shared)
    intent = [F.when(F.col("shared") > 0, F.col(f"all_{n}")).otherwise(F.col(f"any_{n}")) for n in f]
    met = count([c & F.col(n) for n, c in zip(f, intent, strict=True)])
    return joined.filter(met >= F.greatest(F.lit(2), count(intent) - 2)).select(key, "n")


def mdl_hits(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n) of sentences in the class, of those of their text's seeds, that most of the text is in; of equals the first by name."""
    classed = rows.withColumn("class", structure_class("sentence"))
    sizes = classed.groupBy(key, "class").agg(F.count(F.lit(1)).alias("size"), F.bool_or("seed").alias("seeded")).filter("seeded")
    best = sizes.groupBy(key).agg(F.min(F.struct((-F.col("size")).alias("k"), "class"))["class"].alias("class"))
    return classed.filter("NOT seed").join(dealt(best), [key, "class"]).select(key, "n")


def wrapper_hits(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n) of sentences that agree with a seed of their text in three of five: first three words, last three, length in fives, obligation, first word.

    Joined on every three of the five, so only sentences that agree meet.
    """
    w = F.col("w")
    last = F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3))
    props = [F.array_join(F.slice(w, 1, 3), " "), F.array_join(last, " "), F.floor(F.size(w) / 5).cast("string"), F.col("sentence").rlike(MODAL).cast("string"), F.coalesce(F.get(w, F.lit(0)), F.lit(""))]
    threes = [(a, b, c) for a in range(5) for b in range(a + 1, 5) for c in range(b + 1, 5)]
    keys = F.explode(F.array(*(F.concat_ws("\x1f", F.lit(str(t)), *(props[k] for k in t)) for t in threes)))
    keyed = rows.withColumn("w", _plain("sentence")).select(key, "n", "seed", keys.alias("k"))
    return keyed.filter("NOT seed").join(dealt(keyed.filter("seed").select(key, "k").distinct()), [key, "k"], "left_semi").select(key, "n").distinct()


def shape(sentence: Column | str) -> Column:
    """Words as MOD, AUT, VRB or NUM, other words of four letters and more as WRD."""
    kind = lambda w: F.when(w.isin(*MODAL_WORDS), "MOD").when(w.isin(*AUTHORITY_WORDS), "AUT").when(w.isin(*ACTION_WORDS), "VRB").when(w.rlike("^[0-9]+$"), "NUM").when(F.length(w) >= 4, "WRD")
    return F.filter(F.transform(_plain(sentence), kind), lambda k: k.isNotNull())


def shape_grams(s: Column) -> Column:
    """Distinct runs of one to three of a sentence's word shapes, which are best a column of their own: here they are read for every run."""

    def runs(s: Column, n: int) -> Column:
        return F.when(F.size(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - n + 1, F.lit(1))), lambda k: F.array_join(F.slice(s, k, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(runs(s, n) for n in (1, 2, 3))))


def grammar_hits(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n) of sentences with two or more of the shape runs of their text's seeds, one of two words at least; seeds that have one run in all accept nothing."""
    grams = rows.select(key, "n", "seed", shape("sentence").alias("s")).select(key, "n", "seed", F.explode(shape_grams(F.col("s"))).alias("gram"))
    accepted = grams.filter("seed").select(key, "gram").distinct()
    enough = accepted.groupBy(key).agg(F.count(F.lit(1)).alias("accepted")).filter("accepted >= 2").select(key)
    met = grams.filter("NOT seed").join(dealt(accepted), [key, "gram"]).join(dealt(enough), key, "left_semi")
    return met.groupBy(key, "n").agg(F.count(F.lit(1)).alias("hits"), F.max(F.col("gram").contains(" ")).alias("long")).filter("hits >= 2 AND long").select(key, "n")


def induced(docs: DataFrame, seeds: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, n, sentence, methods, tier) of sentences that structure alone shows to be like a text's rules.

    ``seeds(key, sentence)`` are the rules known, by default the sentences of
    constraint. discriminant: found by two methods and more though no seed;
    review: by one.
    """
    docs = spread(docs.select(key, "text"), key)
    rows = sentences(docs, key).withColumn("norm", normalized("sentence"))
    known = (constraint_sentences(docs, key) if seeds is None else seeds).select(key, normalized("sentence").alias("norm")).distinct().withColumn("seed", F.lit(True))
    rows = written(rows.join(dealt(known), [key, "norm"], "left").select(key, "n", "sentence", F.coalesce("seed", F.lit(False)).alias("seed")), "sentences")  # all passes read them
    hits = None
    for name, found in zip(METHODS, (fca_hits, mdl_hits, wrapper_hits, grammar_hits), strict=True):
        one = found(rows, key).select(key, "n", F.lit(name).alias("method"))
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy(key, "n").agg(F.collect_set("method").alias("m"))
    methods = F.array_join(F.filter(F.array(*(F.lit(m) for m in METHODS)), lambda m: F.array_contains(F.col("m"), m)), ",")
    return rows.join(dealt(merged), [key, "n"]).select(key, "n", "sentence", methods.alias("methods"), F.when(F.size("m") >= 2, "discriminant").otherwise("review").alias("tier"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, host, href) of every link of a page."""
    href = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""href=["']([^"']*)["']"""), F.lit(1))
    return pages.select("page_id", F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.explode(href).alias("href"))


def script_calls(pages: DataFrame) -> DataFrame:
    """(page_id, call) of functions called in scripts and inline handlers of a page."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?:[;>]|on\w+=[\"'])\s*([A-Za-z_]\w*)\("), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("call"))
