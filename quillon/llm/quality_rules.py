"""Quality rules with host verdicts.

Each text is measured once in numpy (words, symbols, repeated lines, repeated
8-word windows). Rules mark failures; failures are summed by host, the hosts'
rates are shrunk by beta priors fitted to all hosts by moments, and the
verdicts are joined back. A host is strict if its shrunk rate of base failures
is over a half, or if its rate of failures of any rule, base or stricter, is
surely (by two deviations of its posterior) over twice the prior's mean, or
over a half where that is less. On a strict host a document must also pass the
stricter rules; elsewhere the base rules alone decide. So a clean document is
kept wherever it comes from.

Null or empty texts have no words and fail the base. A null host is a host of
its own. Repeated rows count and are judged one by one. Extra columns pass
through ``keep_documents`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, documents, unused, written
from .spans import MUL_A, SPACE, U64, Texts, chunks_of, mix, owners, per_text, windows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
#: A host is strict where its shrunk rate of base failures is over this.
STRICT_HOST_RATE = 0.5
#: Or where its rate of any failures, less so many deviations, is over so many times the prior's mean (or the rate above).
STRICT_DEVIATIONS, STRICT_TIMES_MEAN = 2.0, 2.0
#: The stricter rules: symbols a hundred words, repeated lines a hundred words, code points a word.
STRICT_SYMBOL_PERCENT = 10
STRICT_LINE_PERCENT = 10
STRICT_WORD_CHARS = (2, 20)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_WORD = ~SPACE
_LINE = np.arange(256) != 0x0A
_TAIL = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items occur twice or more, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def measure_texts(texts: pa.Array) -> list[np.ndarray]:
    """The five measures of each text."""
    t = Texts(texts)
    starts, ends, bounds = t.runs(_WORD)
    n_words = np.diff(bounds)
    body = t.data[: t.n]
    counted = np.zeros(t.n + 1, np.int64)
    np.cumsum(_WORD[body] & ~_TAIL[body], out=counted[1:])
    word_chars = counted[t.at[1:]] - counted[t.at[:-1]]
    np.cumsum(_SYMBOLS[body], out=counted[1:])
    n_symbols = counted[t.at[1:]] - counted[t.at[:-1]]

    line_starts, line_ends, line_bounds = t.runs(_LINE)
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    own = owners(line_bounds)[full]
    keys = mix(t.hashes(line_starts[full], line_ends[full]) + own.astype(np.uint64) * MUL_A)
    n_dup = np.bincount(own[_repeats(keys)[1]], minlength=t.count)

    h = t.hashes(starts, ends)
    w, first = windows(h, bounds, WINDOW_WORDS)
    word_own = owners(bounds)
    twice, _ = _repeats(mix(w + word_own[first].astype(np.uint64) * U64(0xD6E8FEB86659FD93)))
    covered = np.zeros(len(h) + 1, np.int64)
    np.add.at(covered, first[twice], 1)
    np.add.at(covered, first[twice] + WINDOW_WORDS, -1)
    return [n_words, word_chars, n_symbols, n_dup, per_text(np.cumsum(covered[:-1]) > 0, bounds)]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURES]))
def measures(texts: pa.Array) -> pa.Array:
    parts = [measure_texts(texts.slice(a, b - a)) for a, b in chunks_of(texts)]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5)]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=MEASURES)


def _ruled(m) -> dict:
    n = m("n_words")
    base = (n < MIN_WORDS) | (100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    low, high = STRICT_WORD_CHARS
    strict = (
        (100 * m("n_symbols") > STRICT_SYMBOL_PERCENT * n)
        | (100 * m("n_dup_lines") > STRICT_LINE_PERCENT * n)
        | (m("word_chars") < low * n)
        | (m("word_chars") > high * n)
    )
    return {"base_failed": base, "strict_failed": strict}


def _shrunk(failed: Column, n: Column, mean: float, spread: float) -> tuple[Column, Column]:
    """Means and deviations of the hosts' posterior rates under the beta prior of a mean and variance."""
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else float("inf")
    if strength == float("inf"):
        return F.lit(float(mean)), F.lit(0.0)
    held = max(strength, 0.0)
    rate = (failed + F.lit(held * mean)) / (n + F.lit(held)) if strength >= 0 else (failed / n).cast("double")
    return rate, F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (n + F.lit(held + 1)))


def host_verdicts(failures: DataFrame) -> DataFrame:
    """One row per host of ``failures(host, base_failed, strict_failed)``: documents, failures, shrunk rate of base failures, strict.

    A prior is the beta distribution whose mean and variance are those of
    the hosts' raw rates (each host one vote); without spread among hosts all
    shrink fully to the mean. Hosts are counted with partial sums, so a host
    with a third of all rows costs no single task.
    """
    number = lambda failed: F.sum(failed.cast("long"))
    hosts = written(
        failures.groupBy("host").agg(
            F.count(F.lit(1)).alias("host_docs"), number(F.col("base_failed")).alias("host_failed"),
            number(F.col("base_failed") | F.col("strict_failed")).alias("host_any_failed")),
        "hosts",
    )
    n = F.col("host_docs")
    rates = {c: F.col(c) / n for c in ("host_failed", "host_any_failed")}
    got = hosts.agg(*(f(r).alias(f"{k}_{c}") for c, r in rates.items() for k, f in (("m", F.avg), ("v", F.var_pop)))).first()  # one row
    prior = {c: (got[f"m_{c}"] or 0.0, got[f"v_{c}"] or 0.0) for c in rates}
    base, _ = _shrunk(F.col("host_failed"), n, *prior["host_failed"])
    every, deviation = _shrunk(F.col("host_any_failed"), n, *prior["host_any_failed"])
    most = min(STRICT_HOST_RATE, STRICT_TIMES_MEAN * prior["host_any_failed"][0])
    return hosts.withColumn("host_rate", base).withColumn("host_strict", (F.col("host_rate") > STRICT_HOST_RATE) | (every - STRICT_DEVIATIONS * deviation > most))


def judge_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, kept, host, host_rate for each row of ``docs(doc_id, text, host)``."""
    bound_batches(docs.sparkSession)
    measured = docs.select("doc_id", F.col(host).alias("host"), measures("text").alias("m"))
    rows = written(measured.select("doc_id", "host", "m.*"), "measures")
    rows = rows.withColumns(_ruled(F.col))
    verdicts = host_verdicts(rows).select(F.col("host").alias("of_host"), "host_rate", "host_strict")
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select(
        "doc_id", *MEASURES, "base_failed",
        (~F.col("base_failed") & ~(F.col("host_strict") & F.col("strict_failed"))).alias("kept"),
        "host", F.round("host_rate", 9).alias("host_rate"),
    )


def keep_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were.

    The first pass gathers failures by host; the second measures again rather
    than holding texts and measures together in a shuffle.
    """
    bound_batches(docs.sparkSession)
    names = [F.col(f"`{c}`") for c in docs.columns]
    held, strict_host = unused(docs, "__measures", "__strict_host")
    seen = docs.select(F.col(f"`{host}`").alias("host"), measures.asNondeterministic()("text").alias("m"))
    # Measured once: each rule alone would evaluate the measures anew.
    seen = seen.select("host", *(v.alias(k) for k, v in _ruled(lambda c: F.col(f"m.{c}")).items()))
    verdicts = host_verdicts(seen)
    strict = verdicts.filter("host_strict").select(F.col("host").alias(strict_host))
    # Not deterministic for the planner: else filters would be pushed down with a second evaluation each.
    rows = docs.withColumn(held, measures.asNondeterministic()("text"))
    rules = _ruled(lambda c: F.col(f"{held}.{c}"))
    passed = rows.filter(~rules["base_failed"])
    joined = passed.join(strict, F.col(f"`{host}`").eqNullSafe(F.col(strict_host)), "left")
    known = F.coalesce(F.col(strict_host).isNotNull(), F.lit(False))
    if verdicts.filter("host_strict AND host IS NULL").limit(1).count():
        known = known | F.col(f"`{host}`").isNull()
    return joined.filter(~(known & rules["strict_failed"])).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
b AS (SELECT *, len(ws) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
p AS (SELECT rid, unnest(range(1, n_words - 6)) AS i, ws FROM b WHERE n_words >= 8),
g AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS gram FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM r) GROUP BY rid),
m AS (SELECT b.rid, doc_id, source, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM b LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS strict_failed FROM m),
h AS (SELECT source AS host, count(*) AS host_docs, sum(base_failed::INT) AS host_failed FROM f GROUP BY source),
q AS (SELECT avg(host_failed / host_docs) AS mu, var_pop(host_failed / host_docs) AS v FROM h),
s AS (SELECT host, CASE WHEN v <= 0 THEN mu WHEN mu * (1 - mu) / v - 1 < 0 THEN host_failed / host_docs
        ELSE (host_failed + (mu * (1 - mu) / v - 1) * mu) / (host_docs + (mu * (1 - mu) / v - 1)) END AS host_rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_rate > 0.5 AND strict_failed) AS kept, f.source AS host, round(host_rate, 9) AS host_rate
FROM f JOIN s ON s.host IS NOT DISTINCT FROM f.source
"""
