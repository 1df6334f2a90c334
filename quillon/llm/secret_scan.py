"""Secret scans with DataFrame functions alone.

Base kinds are patterns (assignments, access keys, hex strings). The method
adds candidate strings: runs of the characters of keys, classed as hex,
letters-and-digits or base64, whose Shannon entropy in some sliding window is
over the class's threshold; strings of letters or of digits alone are held to
the threshold of the class they fall in, as any other. The window's counts move by one character in and
one out, so a string of n characters takes n steps however wide the window.
Candidates that match the allow-list are suppressed; base matches never are.

Positions are code points. A null text is empty and has no secrets. Repeated
rows are scanned one by one, extra columns pass ``redact_documents`` untouched.
An empty table gives no rows. Spans of several kinds that start together are
listed in the order of the kinds; where spans overlap, one mark stands for all.
Texts are scanned whole, in time that grows with their length and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character that some window must exceed, by class; none is an entropy that a window of 20 can have.
HEX_BITS, ALNUM_BITS, BASE64_BITS = 2.951, 3.653, 3.753
#: Candidates that are no secrets: identifiers of the UUID form, and placeholders.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|sample|dummy|placeholder|changeme|xxxx|your[_-]"

#: Running values are taken in two levels, chunks and items of a chunk, as each array appended to is copied.
CHUNK = 512

_SPAN = "array<struct<start:int,kind:int,stop:int,first:int,after:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(items: Column, start: Column, add) -> Column:
    """For each item what ``add`` makes of those before it; associative, and ``start`` changes nothing."""

    def scan(some: Column, first: Column) -> Column:
        empty = F.filter(F.array(start), lambda x: F.lit(False))
        step = lambda held, x: F.struct(add(held["at"], x).alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out"))
        return F.aggregate(some, F.struct(first.alias("at"), empty.alias("out")), step, lambda held: held["out"])

    count = F.floor((F.size(items) + CHUNK - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))
    split = lambda parts: F.flatten(F.zip_with(parts, scan(F.transform(parts, lambda some: F.aggregate(some, start, add)), start), scan))
    return F.when(F.size(items) > 0, _let(chunks, split)).otherwise(F.filter(F.array(start), lambda x: F.lit(False)))


def _pair(chars: Column, octets: Column) -> Column:
    return F.struct(chars.cast("int").alias("chars"), octets.cast("int").alias("octets"))


def _places(text: Column, pattern: str) -> Column:
    """(s, e, first, after, found) of the leftmost matches that don't overlap, in code points and bytes; the text is split only if there are any."""
    none = F.array().cast("array<struct<s:int,e:int,first:int,after:int,found:string>>")

    def place(before: Column, pair: Column) -> Column:
        s, first = before["chars"] + F.length(pair["piece"]), before["octets"] + F.octet_length(pair["piece"])
        return F.struct(s.alias("s"), (s + F.length(pair["match"])).alias("e"), first.alias("first"), (first + F.octet_length(pair["match"])).alias("after"), pair["match"].alias("found"))

    def sized(pair: Column) -> Column:
        return _pair(F.length(pair["piece"]) + F.length(pair["match"]), F.octet_length(pair["piece"]) + F.octet_length(pair["match"]))

    def located(pairs: Column) -> Column:
        ahead = _running(F.transform(pairs, sized), _pair(F.lit(0), F.lit(0)), lambda a, b: _pair(a["chars"] + b["chars"], a["octets"] + b["octets"]))
        return F.zip_with(ahead, pairs, place)

    def matched(found: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")))
        return F.when(F.size(found) > 0, _let(pairs, located)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), matched)


def _spans(places: Column, kind: int, wanted=None) -> Column:
    kept = F.filter(places, wanted) if wanted else places
    return F.transform(kept, lambda p: F.struct(p["s"].alias("start"), F.lit(kind).alias("kind"), p["e"].alias("stop"), p["first"].alias("first"), p["after"].alias("after"))).cast(_SPAN)


def window_bits(string: Column) -> Column:
    """The largest entropy of any window of a string of the alphabet's characters, in bits a character."""
    symbols = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    weigh = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("seen"))
    pairs = F.arrays_zip(symbols.alias("new"), F.concat(F.array_repeat(F.lit(-1), WINDOW), symbols).alias("old"))

    def step(held: Column, pair: Column) -> Column:
        new, old = pair["new"], pair["old"]
        counts, total, best, seen = held["counts"], held["sum"], held["best"], held["seen"] + 1
        came, went = F.get(counts, new), F.when(old >= 0, F.get(counts, F.greatest(old, F.lit(0)))).otherwise(0)
        moved = F.transform(counts, lambda n, k: n + (k == new).cast("int") - (k == old).cast("int"))
        change = F.when(new == old, 0.0).otherwise(weigh(came + 1) - weigh(came) + F.when(old >= 0, weigh(went - 1) - weigh(went)).otherwise(0.0))
        after = total + change
        bits = F.log2(F.lit(float(WINDOW))) - after / WINDOW
        return F.struct(moved.alias("counts"), after.alias("sum"), F.when((seen >= WINDOW) & (bits > best), bits).otherwise(best).alias("best"), seen.alias("seen"))

    return F.aggregate(F.filter(pairs, lambda p: p["new"].isNotNull()), start, step, lambda held: held["best"])


def _suspect(place: Column) -> Column:
    string = place["found"]
    most = F.when(string.rlike("^[0-9A-Fa-f]+$"), HEX_BITS).when(string.rlike("^[A-Za-z0-9]+$"), ALNUM_BITS).otherwise(BASE64_BITS)
    return F.when(~string.rlike(ALLOWED), window_bits(string) > most).otherwise(False)


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, first: str = "__base", every: str = "__all") -> DataFrame:
    """``docs`` with columns ``first`` (base spans) and ``every`` (all), arrays of (start, kind, stop, and both in bytes) in order of start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = _spans(_places(text, ASSIGN), 0, lambda p: F.length(F.regexp_extract(p["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.concat(assign, _spans(_places(text, ACCESS), 1), _spans(_places(text, HEX), 2))
    (more,) = unused(docs, "__more")
    found = docs.withColumn(first, F.sort_array(base)).withColumn(more, _spans(_places(text, CANDIDATE), 3, _suspect))
    return found.withColumn(every, F.sort_array(F.concat(first, more))).drop(more)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans for each row of ``docs(doc_id, text)``."""
    rows = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return rows.select("doc_id", count(0), count(1), count(2), F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__all")).alias("spans"))


def redact_documents(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark and n_chars (if there is one) as the text then has."""
    names = docs.columns

    def redacted(body: Column, spans: Column) -> Column:
        ends = F.transform(spans, lambda x: x["after"])
        covered = _running(ends, F.lit(0), lambda a, b: F.greatest(a, b))

        def piece(span: Column, at: Column) -> Column:
            gap = F.substring(body, at + 1, span["first"] - at).cast("string")
            return F.when(span["first"] >= at, F.concat(gap, F.lit(mark))).otherwise("")

        last = F.array_max(ends)
        tail = F.substring(body, last + 1, F.octet_length(body) - last).cast("string")
        return F.array_join(F.concat(F.zip_with(spans, covered, piece), F.array(tail)), "")

    first, every = unused(docs, "__base", "__all")
    rows = scan(docs, first, every)
    # Bytes are cut at an offset; characters would be counted from the text's beginning for every span.
    cut = _let(F.col("text").cast("binary"), lambda body: _let(F.col(every), lambda spans: redacted(body, spans)))
    rows = rows.withColumn("text", F.when(F.size(every) > 0, cut).otherwise(F.col("text")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.size(every) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(f"`{c}`") for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def _sql_places(kind: int, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, m[i] AS found,
       CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(text, '{p}', 0) AS m, regexp_split_to_array(text, '{p}') AS p FROM d) WHERE len(m) > 0)"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({_sql_places(0, ASSIGN)}), k AS ({_sql_places(1, ACCESS)}), h AS ({_sql_places(2, HEX)}), c AS ({_sql_places(3, CANDIDATE)}),
w AS (SELECT rid, kind, found, s,
        list_max(list_transform(range(1, length(found) - {WINDOW} + 2), lambda i:
            log2({WINDOW}.0) - list_sum(list_transform(list_distinct(string_split(substr(found, i, {WINDOW}), '')), lambda q:
                ({WINDOW} - length(replace(substr(found, i, {WINDOW}), q, ''))) * log2({WINDOW} - length(replace(substr(found, i, {WINDOW}), q, ''))))) / {WINDOW}.0)) AS bits
      FROM c WHERE len(regexp_extract_all(found, '[A-Za-z]')) >= 2 AND len(regexp_extract_all(found, '[0-9]')) >= 2 AND NOT regexp_matches(found, '{ALLOWED}')),
s AS (SELECT rid, kind, s, s + length(found) AS e FROM a WHERE length(regexp_extract(found, '{_ASSIGN_SQL}', 2)) >= {ASSIGN_LEAST}
      UNION ALL SELECT rid, kind, s, s + length(found) FROM k UNION ALL SELECT rid, kind, s, s + length(found) FROM h
      UNION ALL SELECT rid, kind, s, s + length(found) FROM w WHERE bits > CASE WHEN regexp_full_match(found, '[0-9A-Fa-f]+') THEN {HEX_BITS} WHEN regexp_full_match(found, '[A-Za-z0-9]+') THEN {ALNUM_BITS} ELSE {BASE64_BITS} END),
n AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS t FROM s),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind) AS spans FROM n GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""
