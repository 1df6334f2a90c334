"""What each of five filters removes, alone and after others, in all 120 orders.

A document's failures are five bits. Under a given order its first failing
filter removes it, so a table of 32 failure patterns by 120 orders holds every
step at which anything goes; documents are counted by part, pattern and label
first, and ``np.bincount`` adds those counts up by part, order and step. Tasks
give partial sums, which Spark adds.

Filters: A fewer than 50 words; B distinct words under 65% of words; C capitals
over 5% of code points; D any of ``#$%&*|``; E a text that a smaller doc_id has.
Texts are compared whole through SHA-256: a group of copies costs one row with
its smallest doc_id, and rows meet it in a join that AQE can split.

A null text is empty, and so a copy of other empty ones; an empty text fails A
alone, and E if repeated. A null source is the part ''. A null doc_id is never
smaller or larger than another: it neither fails E nor makes another fail. Rows
that repeat a doc_id are documents of their own; none of them makes another
fail E. A document counts as good or toxic if any of its labels' rows says so;
labels of other documents don't count. Texts of any length are taken whole. An
empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, documents, scratch, written
from .spans import SPACE, Texts, chunks_of, owners, per_text

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
MARKS = "#$%&*|"

_WORD = ~SPACE
_CODES = np.arange(256)
_CAPITAL = (_CODES >= 65) & (_CODES <= 90)
_MARK = np.isin(_CODES, list(MARKS.encode()))

#: All orders of the filters, as letters and as indices by step.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
FILTER_AT = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])


def first_failures() -> np.ndarray:
    """The step (0 to 4) at which each order removes each pattern of failures; 5 where nothing does."""
    fails = (np.arange(32)[:, None, None] >> FILTER_AT) & 1  # pattern, order, step
    return np.where(fails.any(2), fails.argmax(2), 5)


FIRST_FAILURE = first_failures()


def failures(texts: pa.Array) -> np.ndarray:
    """Bits of A to D for each text; E needs the other documents."""
    t = Texts(texts)
    starts, ends, bounds = t.runs(_WORD)
    n, own, h = np.diff(bounds), owners(bounds), t.hashes(starts, ends)
    order = np.lexsort((h, own))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(own[order]) != 0) | (h[order][1:] != h[order][:-1])
    distinct = np.bincount(own[order][new], minlength=t.count)
    data = t.data[: t.n]
    points = per_text((data & 0xC0) != 0x80, t.at)
    bits = (
        n < MIN_WORDS,
        100 * distinct < MIN_DISTINCT_PERCENT * n,
        100 * per_text(_CAPITAL[data], t.at) > MAX_CAPITAL_PERCENT * points,
        per_text(_MARK[data], t.at) > 0,
    )
    return sum(b.astype(np.int64) << k for k, b in enumerate(bits))


@F.arrow_udf(T.LongType())
def own_failures(texts: pa.Array) -> pa.Array:
    parts = [failures(texts.slice(a, b - a)) for a, b in chunks_of(texts)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))


def patterns(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """part, pattern, good, toxic and n: documents counted by failures and labels. Few rows for each part."""
    bound_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own_failures(text).alias("own")), "failures")
    copied = F.count("doc_id")
    firsts = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), copied.alias("n")).filter("n > 1").select("digest", "first"), "first-copies")
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = written(labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(says("quality"), says("toxic")), "marks")
    judged = rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("own") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("pattern"))
    joined = judged.join(marks, "doc_id", "left")
    return joined.groupBy("part", "pattern", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def removals(counted: DataFrame) -> DataFrame:
    """The counts of each part, order and step, from ``patterns``."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.column("part").dictionary_encode()
            code, parts = named.indices.to_numpy(), len(named.dictionary)
            pattern, n = batch.column("pattern").to_numpy(), batch.column("n").to_numpy().astype(float)
            good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("good", "toxic"))
            cell = ((code[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * 6 + FIRST_FAILURE[pattern]).ravel()

            def gone(weights: np.ndarray) -> np.ndarray:
                """By part, order and step."""
                return np.bincount(cell, np.repeat(weights, len(ORDERS)), parts * len(ORDERS) * 6).reshape(parts, len(ORDERS), 6)[:, :, :5]

            def of_filter(bits: np.ndarray) -> np.ndarray:
                """Sums of a column for each filter, by part, order and step."""
                each = np.stack([np.bincount(code, n * bits[:, f], parts) for f in range(5)], 1)
                return each[:, FILTER_AT]

            removed = gone(n)
            total = np.bincount(code, n, parts)[:, None, None]
            over_orders = np.stack([(removed * (FILTER_AT == f)).sum((1, 2)) for f in range(5)], 1)
            counts = (
                total - removed.cumsum(2),
                removed,
                of_filter((pattern[:, None] >> np.arange(5)) & 1) - removed,
                of_filter(pattern[:, None] == 1 << np.arange(5)),
                gone(n * good),
                gone(n * toxic),
                over_orders[:, FILTER_AT],
            )
            each = len(ORDERS) * 5
            columns = [named.dictionary.take(pa.array(np.repeat(np.arange(parts), each))), pa.array(np.tile(np.repeat(ORDERS, 5), parts)), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), parts * len(ORDERS)))]
            columns += [pa.array(c.astype(np.int64).ravel()) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])

    # A part has 128 rows at most; in one task they give one set of arrays.
    partial = counted.repartition("part").mapInArrow(look_up, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return partial.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts, for ``docs(doc_id, text, part)`` and ``labels(doc_id, quality, toxic)``."""
    with scratch(docs.sparkSession) as keep:
        return keep(written(removals(patterns(docs, labels, F.col(f"`{part}`"))), "audit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
s AS (SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM f),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT p.c || q.c || r.c || t.c || u.c AS filter_order FROM x p, x q, x r, x t, x u
      WHERE len(list_distinct([p.c, q.c, r.c, t.c, u.c])) = 5),
k AS (SELECT filter_order, step, substr(filter_order, step, 1) AS c, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT part, filter_order, step, c, good, toxic, fails, contains(fails, c) AS failing,
        length(regexp_replace(before, '[' || fails || 'x]', '', 'g')) < step - 1 AS gone FROM s, k),
g AS (SELECT part, filter_order, step, c, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (failing AND NOT gone) AS removed,
        count(*) FILTER (failing AND gone) AS redundant, count(*) FILTER (fails = c) AS unique_fails,
        count(*) FILTER (failing AND NOT gone AND good) AS good_lost, count(*) FILTER (failing AND NOT gone AND toxic) AS toxic_lost
      FROM j GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM g
"""
