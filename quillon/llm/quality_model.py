"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every word has a sparse signed index vector, fixed by its hash. A word's own
vector is the sum of the index vectors of the words up to two places away, over
all documents; words share a fixed number of rows by hash, so what is gathered
and sent is bounded however large the corpus. A document is the mean and the
spread of its words' vectors, the mean's length, and the logarithm of its own.

The network learns from labelled rows outside the held-out fold alone, at most
``MAX_TRAIN`` of them chosen by hash; a part of these sets the
temperature that calibrates its probabilities. It sees texts only.

Null and empty texts are pooled as no words and scored like any other. Labels
that are null, or whose document isn't there, teach nothing; repeated labels
teach once, repeated documents repeatedly, within the bound. With fewer than ten labelled
rows, or with labels of one kind, every score is the smoothed share of ones. An
empty table of documents gives no rows. Texts that tie score the same. Extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, documents, written
from .spans import ALNUM, MUL_A, MUL_C, SPACE, U64, Texts, chunks_of, mix, owners

ROW_BITS = 14
DIMENSIONS = 64
NONZERO = 2
REACH = 2
HIDDEN = 32
#: Bound of the labelled sample.
MAX_TRAIN = 20_000
HELD_OUT = (5, 0)
THRESHOLD = 0.3
FEATURES = 2 * DIMENSIONS + 2

#: Words are runs of alphanumerics and runs of other visible characters.
_SIGNS = ~SPACE & ~ALNUM


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = Texts(texts, lower=True)
    a0, a1, _ = t.runs(ALNUM)
    s0, s1, _ = t.runs(_SIGNS)
    starts, ends = np.concatenate([a0, s0]), np.concatenate([a1, s1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return t.hashes(starts, ends), np.searchsorted(starts, t.at)


def row_of(h: np.ndarray) -> np.ndarray:
    return ((h * MUL_A) >> U64(64 - ROW_BITS)).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by row over a task's texts."""
    size = DIMENSIONS << ROW_BITS
    total = np.zeros(size)
    for batch in batches:
        for a, b in chunks_of(batch.column(0)):
            h, bounds = _words(batch.column(0).slice(a, b - a))
            own, row = owners(bounds), row_of(h) * DIMENSIONS
            index = mix(h ^ MUL_C)
            for z in range(NONZERO):
                part = (index >> U64(16 * z)).astype(np.int64)
                place, sign = part & (DIMENSIONS - 1), np.where(part & 0x8000, -1.0, 1.0)
                for step in range(1, REACH + 1):
                    if len(h) > step:
                        near = own[step:] == own[:-step]
                        total += np.bincount((row[:-step] + place[step:])[near], sign[step:][near], size)
                        total += np.bincount((row[step:] + place[:-step])[near], sign[:-step][near], size)
    yield from _rows(total.reshape(-1, DIMENSIONS))


def _rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(np.abs(table).sum(1))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in table[at].astype(np.float32)], pa.binary())], names=["row", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((1 << ROW_BITS, DIMENSIONS))
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, DIMENSIONS)
        np.add.at(table, batch.column(0).to_numpy(), values)
    yield from _rows(table)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors by row, from all of ``docs(text)``; 2^14 rows of 64 however many words there are."""
    bound_batches(docs.sparkSession)
    kind = "row int, v binary"
    parts = docs.select("text").mapInArrow(_contexts, kind).repartition(8, "row").mapInArrow(_added, kind)
    table = np.zeros((1 << ROW_BITS, DIMENSIONS), np.float32)
    for r in parts.collect():
        table[r["row"]] = np.frombuffer(r["v"], np.float32)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.where(norm > 0, norm, 1)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its words' vectors, the mean's length, and log words."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    both = np.concatenate([vectors, vectors * vectors], 1)
    done = 0
    for a, b in chunks_of(texts):
        h, bounds = _words(texts.slice(a, b - a))
        row, n = row_of(h), np.diff(bounds)
        sums = np.zeros((b - a, 2 * DIMENSIONS), np.float64)
        own = owners(bounds)
        for x in range(0, len(row), 16384):
            part, who = both[row[x : x + 16384]], own[x : x + 16384]
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            sums[who[first]] += np.add.reduceat(part, first, axis=0)
        mean = sums / np.maximum(n, 1)[:, None]
        low, high = mean[:, :DIMENSIONS], mean[:, DIMENSIONS:]
        out[a:b, :DIMENSIONS] = low
        out[a:b, DIMENSIONS:-2] = np.sqrt(np.maximum(high - low * low, 0))
        out[a:b, -2] = np.linalg.norm(low, axis=1)
        out[a:b, -1] = np.log1p(n)
        done = b
    assert done == len(texts)
    return out


class Network:
    """Two layers in numpy with a temperature; trained by Adam on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 60, batch: int = 256):
        self.share = (y.sum() + 1) / (len(y) + 2)
        self.flat = len(y) < 10 or y.min() == y.max()
        if self.flat:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        hold, learn = order[: max(1, len(x) // 5)], order[max(1, len(x) // 5) :]
        p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v, best, best_loss, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], None, np.inf, 0
        for _ in range(epochs):
            rng.shuffle(learn)
            for k in range(0, len(learn), batch):
                at = learn[k : k + batch]
                hidden = np.tanh(x[at] @ p[0] + p[1])
                error = (_sigmoid(hidden @ p[2] + p[3]) - y[at]) / len(at)
                back = np.outer(error, p[2]) * (1 - hidden * hidden)
                grads = [x[at].T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
                t += 1
                for q, g, mm, vv in zip(p, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= 0.003 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
            loss = _loss(np.tanh(x[hold] @ p[0] + p[1]) @ p[2] + p[3], y[hold])
            if loss < best_loss:
                best, best_loss = [q.copy() for q in p], loss
        self.p = best
        logits = np.tanh(x[hold] @ best[0] + best[1]) @ best[2] + best[3]
        choices = np.geomspace(0.25, 8, 81)
        self.temperature = float(choices[np.argmin([_loss(logits / c, y[hold]) for c in choices])])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        if self.flat:
            return np.full(len(x), self.share)
        hidden = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return _sigmoid((hidden @ self.p[2] + self.p[3]) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def held_out(doc_id: Column | str) -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors of all ``docs(doc_id, text)`` and the network learnt from ``labels(doc_id, target)`` outside the fold."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labels.select(F.col("doc_id").alias("of"), F.col(target).cast("int").alias("label")).filter(~held_out("of") & F.col("of").isNotNull() & F.col("label").isNotNull())
    known = written(known.distinct().orderBy(F.xxhash64("of", "label"), "of", "label").limit(MAX_TRAIN), "labels")  # by hash, so the same labels at each run
    sent = spark.sparkContext.broadcast(vectors)

    @F.arrow_udf(T.BinaryType())
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for r in pool(texts, sent.value)], pa.binary())

    # The labels are within the bound, so this side is sent whole.
    pairs = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("of")).select("doc_id", F.xxhash64("text").alias("th"), features("text").alias("x"), "label")
    # Documents that repeat an id multiply in the join, so the bound holds for its rows too: those of least hash.
    first = F.xxhash64("doc_id", "label", "th")
    rows = pairs.orderBy(first, "doc_id", "label", "th").limit(MAX_TRAIN).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["th"]))
    sent.destroy()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return vectors, Network(x, np.array([r["label"] for r in rows], float))


def quality_scores(text: Column | str, vectors: np.ndarray, network: Network, spark: SparkSession) -> Column:
    """Calibrated probability that a text's label is 1."""
    sent = spark.sparkContext.broadcast((vectors, network))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        vectors, network = sent.value
        return pa.array(network.score(pool(texts, vectors).astype(np.float64)))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs(doc_id, text)``."""
    vectors, network = train(docs, labels)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality_scores("text", vectors, network, docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
