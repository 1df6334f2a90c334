"""Language-model scores by context-tree weighting of bytes.

Each byte is eight binary decisions; each decision has a tree over the bytes
before it, depth 0 to ``DEPTH``. A node estimates its bit by Krichevsky and
Trofimov; its weighted probability is half its own estimate of all its training
bits and half its children's product. A text is scored with the counts fixed:
along the contexts seen in training the nodes' estimates are mixed by their
posterior weights, from the root to the deepest node seen. Code length is the
negative logarithm of that, per byte.

Training is counting: grams of context and byte, added up by partial sums over
all training texts; the tree's levels are aggregations upward and joins
downward. The counts of words for the base score are gathered in the same pass.
Both models are written as shards of bounded size; scoring tasks probe them one
shard at a time, so no model need fit in memory whole.

Byte 0xFF, which no text holds, stands before a text's beginning and closes it.
A null text is empty. A null doc_id counts as the empty text for the held-out
rule. Repeated rows count as often as they occur. With nothing to learn from,
every bit is even and the base score is 0 per token. Extra columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, documents, local_path, new_folder, open_bytes, put_bytes, scratch, written
from .spans import MUL_A, SPACE, U64, Texts, chunks_of, per_text

DEPTH = 4
#: Rows of a model shard; a task holds one shard at a time.
SHARD_ROWS = 500_000
HELD_OUT = (7, 2)
PRIME = 1_000_003
MARK = 0xFF
END_KEY = 0x5DEECE66D

_WORD = ~SPACE
GRAM, WORD = 0, 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after a shift by eight."""
    z = x + 8
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    r = 1 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


@F.arrow_udf(T.DoubleType())
def kt_logs(n0: pa.Array, n1: pa.Array) -> pa.Array:
    return pa.array(kt_log(n0.to_numpy(zero_copy_only=False).astype(float), n1.to_numpy(zero_copy_only=False).astype(float)))


def grams_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and end of all texts (context bytes, then the byte, lowest), and bounds by text."""
    sizes = np.diff(t.at)
    own = np.repeat(np.arange(t.count), sizes)
    out = np.full(t.n + (DEPTH + 1) * t.count + 8, MARK, np.uint8)
    place = np.arange(t.n) + own * (DEPTH + 1) + DEPTH
    out[place] = t.data[: t.n]
    stops = t.at[1:] + np.arange(t.count) * (DEPTH + 1) + DEPTH
    where = np.empty(t.n + t.count, np.int64)
    where[np.arange(t.n) + own] = place
    bounds = t.at + np.arange(t.count + 1)
    where[bounds[1:] - 1] = stops
    eight = np.ndarray((len(out) - 7,), ">u8", out.data, 0, (1,))
    return eight[where - DEPTH].astype(np.uint64) >> U64(64 - 8 * (DEPTH + 1)), bounds


def word_keys(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts and their bounds by text."""
    starts, ends, bounds = t.runs(_WORD)
    return t.hashes(starts, ends), bounds


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams and words of a task's texts, given out whenever many are held."""
    held: dict[int, list] = {GRAM: [], WORD: []}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            if parts:
                keys, counts = _added(parts)
                for a in range(0, len(keys), 100_000):
                    k, c = keys[a : a + 100_000].view(np.int64), counts[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c)], names=["kind", "key", "n"])
                held[kind] = []

    for batch in batches:
        for a, b in chunks_of(batch.column(0)):
            texts = batch.column(0).slice(a, b - a)
            grams, _ = grams_of(Texts(texts))
            words, _ = word_keys(Texts(texts, lower=True))
            for kind, keys in ((GRAM, grams), (WORD, np.append(words, np.full(b - a, END_KEY, np.uint64)))):
                keys, counts = np.unique(keys, return_counts=True)
                held[kind].append((keys, counts))
                size += len(keys)
            if size > 3_000_000:
                held = {k: [_added(p)] for k, p in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 1_500_000:
                    yield from out()
                    size = 0
    yield from out()


def held_out(doc_id: Column | str) -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def tree_nodes(grams: DataFrame) -> DataFrame:
    """(depth, node, n0, n1, one) of every node seen: ``one`` is the mixed probability of a 1 where the node is the deepest seen.

    A node is its context, newest byte lowest, shifted by 8, and the bits of
    the byte so far behind a leading 1.
    """
    bit = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")

    rows = grams.select("key", "n", bit).select(
        F.shiftleft(F.shiftright("key", 8), 8).bitwiseOR(F.expr("shiftleft(1L, i) | shiftright(key & 255L, 8 - i)")).alias("node"),
        F.expr("shiftright(key & 255L, 7 - i) & 1").alias("bit"), "n")
    level = rows.groupBy("node").agg(F.sum(F.expr("CASE WHEN bit = 0 THEN n ELSE 0L END")).alias("n0"), F.sum(F.expr("CASE WHEN bit = 1 THEN n ELSE 0L END")).alias("n1"))
    level = written(level.withColumn("own", kt_logs("n0", "n1")).withColumn("lw", F.col("own")), "ctw-up")
    levels = {DEPTH: level}
    for d in range(DEPTH - 1, -1, -1):
        up = F.col("node").bitwiseAND((1 << 8 * (d + 1)) - 1)
        level = level.groupBy(up.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        level = level.withColumn("own", kt_logs("n0", "n1"))
        more = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - float(np.log(2))
        level = written(level.select("node", "n0", "n1", "own", more.alias("lw")), "ctw-up")
        levels[d] = level
    kt_one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    out, above = [], None
    for d in range(DEPTH + 1):
        here = levels[d]
        if above is None:
            here = here.withColumn("mass", F.lit(1.0)).withColumn("sofar", F.lit(0.0))
        else:
            up = F.col("node").bitwiseAND((1 << 8 * d) - 1)
            here = here.withColumn("up", up).join(above, "up")
        stays = F.exp(F.col("own") - float(np.log(2)) - F.col("lw")) if d < DEPTH else F.lit(1.0)
        here = here.withColumn("kt", kt_one).withColumn("stays", F.least(stays, F.lit(1.0)))
        here = written(here.select("node", "n0", "n1", (F.col("sofar") + F.col("mass") * F.col("kt")).alias("one"),
            (F.col("mass") * (1 - F.col("stays"))).alias("mass"), (F.col("sofar") + F.col("mass") * F.col("stays") * F.col("kt")).alias("sofar")), "ctw-down")
        out.append(here.select(F.lit(d).alias("depth"), "node", "n0", "n1", "one"))
        above = here.select(F.col("node").alias("up"), "mass", "sofar")
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _keyed(depth: int, node: np.ndarray) -> np.ndarray:
    """One key space for the nodes of all depths."""
    return node.astype(np.uint64) | U64((depth + 1) << 8 * (DEPTH + 1))


def _shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    return (context % PRIME) % shards


def _table_bytes(keys: np.ndarray, values: np.ndarray) -> bytes:
    """An open-addressing table as bytes: slot bits, then keys with 0 for empty, then values."""
    bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
    cells, held = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float64)
    mask = (1 << bits) - 1
    slot = ((keys * MUL_A) >> U64(64 - bits)).astype(np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        free = cells[slot] == 0
        cells[slot[free]] = keys[todo[free]]
        won = cells[slot] == keys[todo]
        held[slot[won]] = values[todo[won]]
        todo, slot = todo[~won], (slot[~won] + 1) & mask
    return np.uint64(bits).tobytes() + cells.tobytes() + held.tobytes()


class Shard:
    """A table of ``_table_bytes``, mapped where the folder is mounted."""

    def __init__(self, uri: str):
        path = local_path(uri)
        if path is not None:
            raw = np.memmap(path, np.uint8, "r")
        else:
            with open_bytes(uri) as source:
                raw = np.frombuffer(source.read(), np.uint8)
        self.bits = int(raw[:8].view(np.uint64)[0])
        size = 8 << self.bits
        self.cells, self.values = raw[8 : 8 + size].view(np.uint64), raw[8 + size :].view(np.float64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values by key; not a number where there is none."""
        mask = (1 << self.bits) - 1
        slot = ((keys * MUL_A) >> U64(64 - self.bits)).astype(np.int64)
        got = self.cells[slot]
        todo = np.flatnonzero((got != keys) & (got != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            g = self.cells[slot[todo]]
            got[todo] = g
            todo = todo[(g != keys[todo]) & (g != 0)]
        return np.where(got == keys, self.values[slot], np.nan)


@lru_cache(maxsize=4)
def _shard(uri: str) -> Shard:
    return Shard(uri)


class Sharded:
    """A model dealt over shards; keys are looked up a shard at a time."""

    def __init__(self, files: list[str]):
        self.files = files

    def find(self, keys: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        if len(self.files) == 1:
            return _shard(self.files[0]).find(keys)
        out = np.full(len(keys), np.nan)
        which = _shard_of(contexts, len(self.files))
        for s, uri in enumerate(self.files):
            at = np.flatnonzero(which == s)
            if len(at):
                out[at] = _shard(uri).find(keys[at])
        return out


def _tree_tables(depth_node_one: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a shard of the tree: nodes of all depths, and each gram of full depth with its log10 probability."""
    depth, node, n0, n1, one = (depth_node_one.column(c).to_numpy() for c in ("depth", "node", "n0", "n1", "one"))
    keys = node.astype(np.uint64) | ((depth + 1).astype(np.uint64) << U64(8 * (DEPTH + 1)))
    full = depth == DEPTH
    from .spans import HashTable

    place = HashTable(node[full].astype(np.uint64))
    leaf_one = one[full]
    last = full & ((node & 0x80) != 0)  # nodes of the eighth bit
    grams, logs = [], []
    for bit, seen in ((0, n0), (1, n1)):
        at = last & (seen > 0)
        context = (node[at] >> 8) << 8
        byte = ((node[at] & 0x7F) << 1) | bit
        total = np.zeros(at.sum())
        for i in range(8):
            p = leaf_one[place.find((context | (1 << i) | (byte >> (8 - i))).astype(np.uint64))]
            total += np.log10(np.where((byte >> (7 - i)) & 1, p, 1 - p))
        grams.append((context | byte).astype(np.uint64) | U64((DEPTH + 2) << 8 * (DEPTH + 1)))
        logs.append(total)
    return np.concatenate([keys, *grams]), np.concatenate([one, *logs])


def _write_shards(rows: DataFrame, context: Column, tables, name: str) -> list[str]:
    """Write rows as shards by context; returns the files in order of shard. Their number follows the row count."""
    spark = rows.sparkSession
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    folder = new_folder(spark, name)

    def write(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        uri = f"{folder}/{uuid.uuid4().hex}.table"
        put_bytes(uri, [_table_bytes(*tables(pa.Table.from_batches(parts)))])
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri])], names=["shard", "uri"])

    def write_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            of = batch.column("shard").to_numpy()
            heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for a, b in zip(heads, [*heads[1:], len(of)], strict=True):
                if of[a] != now and held:
                    yield write(now, held)
                    held = []
                now = int(of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield write(now, held)

    dealt = rows.withColumn("shard", F.pmod(F.pmod(context, F.lit(PRIME)), F.lit(shards)).cast("int"))
    # By range, as many parts as shards: by hash, shards would meet in a task.
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard")
    done = written(dealt.mapInArrow(write_all, "shard int, uri string"), f"{name}-files")
    files = {r["shard"]: r["uri"] for r in done.collect()}  # a row for each shard
    if len(files) < shards:
        empty = f"{folder}/empty.table"
        spark.range(1).coalesce(1).mapInArrow(lambda it: (put_bytes(empty, [_table_bytes(np.zeros(0, np.uint64), np.zeros(0))]) and b for b in it), "id long").count()
        files |= {s: empty for s in range(shards) if s not in files}
    return [files[s] for s in range(shards)]


class Model:
    """Where the shards of a trained model are, and the totals of the base score."""

    def __init__(self, tree: list[str], words: list[str], n_tokens: int, n_distinct: int):
        self.tree, self.words, self.n_tokens, self.n_distinct = tree, words, n_tokens, n_distinct


def _word_context(key: Column) -> Column:
    return F.shiftrightunsigned(key, 8)


def train(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs(text)``; the tables on the way are removed, the shards stay."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _train(docs)


def _train(docs: DataFrame) -> Model:
    parts = docs.select("text").mapInArrow(_count, "kind int, key long, n long")
    counts = written(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.filter(F.col("kind") == WORD)
    got = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()

    def word_table(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return group.column("key").to_numpy().view(np.uint64), group.column("n").to_numpy().astype(float)

    word_files = _write_shards(words, _word_context(F.col("key")), word_table, "lm-words")
    nodes = tree_nodes(counts.filter(F.col("kind") == GRAM).select("key", "n"))
    tree_files = _write_shards(nodes, F.shiftright("node", 8), _tree_tables, "lm-tree")
    return Model(tree_files, word_files, got["n"] or 0, got["v"])


def gram_scores(tree: Sharded, grams: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after its context."""
    context = (grams >> U64(8)).astype(np.int64)
    out = tree.find(grams | U64((DEPTH + 2) << 8 * (DEPTH + 1)), context)
    rare = np.flatnonzero(np.isnan(out))
    if not len(rare):
        return out
    some, back = np.unique(grams[rare], return_inverse=True)
    context, byte = (some >> U64(8)).astype(np.int64), (some & U64(0xFF)).astype(np.int64)
    total = np.zeros(len(some))
    for i in range(8):
        prefix = (1 << i) | (byte >> (8 - i))
        p = np.full(len(some), np.nan)
        for d in range(DEPTH, -1, -1):  # the deepest node seen
            left = np.flatnonzero(np.isnan(p))
            if not len(left):
                break
            c = context[left] & ((1 << 8 * d) - 1)
            p[left] = tree.find(_keyed(d, (c << 8) | prefix[left]), c)
        p = np.where(np.isnan(p), 0.5, p)
        total += np.log10(np.where((byte >> (7 - i)) & 1, p, 1 - p))
    out[rare] = total[back]
    return out


_SCORES = T.StructType([T.StructField(n, k) for n, k in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("n_bytes", T.LongType()))])


def scores(text: Column | str, model: Model) -> Column:
    """n_tokens, n_known, base_score, score and n_bytes of a text."""
    tree_files, word_files, n, v = model.tree, model.words, model.n_tokens, model.n_distinct

    @F.arrow_udf(_SCORES)
    def score(texts: pa.Array) -> pa.Array:
        tree, words = Sharded(tree_files), Sharded(word_files)
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for a, b in chunks_of(texts):
            piece = texts.slice(a, b - a)
            t = Texts(piece)
            grams, bounds = grams_of(t)
            logs = gram_scores(tree, grams)
            keys, at = word_keys(Texts(piece, lower=True))
            end = np.array([END_KEY], np.uint64)
            c = np.nan_to_num(words.find(keys, (keys >> U64(8)).astype(np.int64)))
            c_end = float(np.nan_to_num(words.find(end, (end >> U64(8)).astype(np.int64)))[0])
            base = float(np.log10(n + (v + 1)))
            own = np.repeat(np.arange(b - a), np.diff(at))
            cols[0].append(np.diff(at) + 1)
            cols[1].append(per_text(c > 0, at) + (c_end > 0))
            cols[2].append(np.bincount(own, np.log10(c + 1) - base, minlength=b - a) + np.log10(c_end + 1) - base)
            cols[3].append(np.add.reduceat(logs, bounds[:-1]))
            cols[4].append(np.diff(t.at))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], k) for x, k in zip(cols, kinds, strict=True)], names=_SCORES.names)

    return score(text)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, the scores, and bits_per_byte (code length; over the end mark alone for empty texts)."""
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), scores("text", model).alias("s"))
    bits = -F.col("score") / float(np.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return rows.select("doc_id", "held_out", "s.*").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs.filter(~held_out("doc_id"))))
