"""Which tokens of two tokenizers cover the same bytes, through a dictionary of groups.

Both tokenizers encode a text with one space before it. Offsets where a token
of each ends cut the tokens into groups; within a group, tokens whose bytes
overlap are linked. What a group links depends on its ids alone, so:

1. tasks intern groups and count them; Spark adds the counts up by group;
2. each distinct group's links are expanded once and carry its frequency,
   which gives the count of every id pair and the highest count of every B id;
3. these give each group's sums, once a group;
4. texts are encoded again and take the sums of their groups: those of the most
   frequent groups, of which there can be at most ``MOST_SENT``, are sent to the
   tasks; all others are joined by the group's key.

Groups are told apart in a task's memory by 64-bit hashes and in Spark by all
their ids. The piece tokenizer never merges over the start of a blank run, as
no piece has a blank after another character (checked on opening), so its
blank-led chunks are encoded once each and remembered.

Texts that are null or empty, or that a tokenizer doesn't give back byte for
byte, have no tokens: zeros and an empty digest. Strings of special tokens are
ordinary text. Texts of any length are taken whole; a text without common ends
is one group. B ids whose highest count is shared by several pairs have several
best ones. Repeated rows give repeated results and count each. A null doc_id
stays null. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_files
from .bpe import TO_BYTE
from .common import bound_batches, documents, scratch, written
from .pretokens import Memory, gather
from .spans import MUL_A, MUL_B, MUL_C, U64, Texts, chunks_of, mix

#: Most groups whose sums are sent to every task; a group is among them if it makes up more than this share of all.
MOST_SENT = 1 << 16
#: Groups and ids that a task remembers before it starts anew.
MOST_GROUPS, MOST_GROUP_IDS = 400_000, 4_000_000
#: The character that stands for a blank in pieces; a fixed value of the format.
BLANK_MARK = "▁"


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(bodies) + 1, np.int64)
    np.cumsum([len(b) for b in bodies], out=at[1:])
    return np.frombuffer(b"".join(bodies), np.uint8), at


class Chunks(Memory):
    """Piece ids of texts that begin with a blank, by chunks: a run of blanks and what follows to the next."""

    def ids(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        blank = t.data[: t.n] == 0x20
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[t.at[:-1]] = True
        begins = np.flatnonzero(opens)
        ends = np.append(begins[1:], t.n)
        if self.count > self.most or self.at[self.count] > self.most_ids:
            self.clear()
        keys = t.hashes(begins, ends)
        got = self._find(keys)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            raw, at = t.data.tobytes(), missing[where]
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                self._add(new[k : k + 8192], self.encode([raw[a + 1 : b].decode() for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True)]))
            got[missing] = self._find(keys[missing])
        out, edges = gather(self.flat, self.at, got)
        return out, edges[np.searchsorted(begins, t.at)]


class PieceCodec:
    """A sentencepiece model that puts a blank before a text and has a piece for every byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.engine = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.engine.id_to_piece(k) for k in range(self.engine.get_piece_size())]
        if any(BLANK_MARK in p.lstrip(BLANK_MARK) for p in pieces):
            raise ValueError(f"{path}: pieces with a blank after another character")
        self.lone = [self.engine.piece_to_id(BLANK_MARK)]
        self.memory = Chunks(self._encode, np.zeros(0, np.uint8))
        self.body, self.body_at = _joined([bytes([int(p[3:5], 16)]) if self.engine.is_byte(k) else p.replace(BLANK_MARK, " ").encode() for k, p in enumerate(pieces)])

    def _encode(self, rest: list[str]) -> list[list[int]]:
        """Ids of chunks given without their first blank, which the library adds to all but empty ones."""
        return [ids or self.lone for ids in self.engine.encode(rest, num_threads=1)]


@lru_cache(maxsize=1)
def codecs(byte_path: str, piece_path: str):
    """Both tokenizers with the bytes of their ids; one for each worker process."""
    first = token_files.codec(byte_path)
    tokens = [first.engine.id_to_token(k) or "" for k in range(first.n_ids)]
    return first, _joined([bytes(TO_BYTE[c] for c in t) for t in tokens]), PieceCodec(piece_path)


class Cut:
    """The groups of a column's texts: ``group_at`` bounds them by text, a_at and b_at bound each one's ids."""

    def __init__(self, texts: pa.Array, byte_path: str, piece_path: str):
        first, (body, body_at), second = codecs(byte_path, piece_path)
        texts = pc.fill_null(texts, "")
        spaced = pc.binary_join_element_wise(pa.nulls(len(texts), texts.type).fill_null(""), texts, " ")
        t = Texts(spaced)
        a, a_bounds = first.memory.ids(spaced)
        b, b_bounds = second.memory.ids(t)
        whole = (np.diff(t.at) > 1) & _same(t, a, a_bounds, body, body_at) & _same(t, b, b_bounds, second.body, second.body_at)
        a_own, b_own = np.diff(a_bounds), np.diff(b_bounds)
        if not whole.all():
            a, b = a[np.repeat(whole, a_own)], b[np.repeat(whole, b_own)]
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.n_a, self.n_b = a_own * whole, b_own * whole
        a_ends, b_ends = np.cumsum(np.diff(body_at)[self.a]), np.cumsum(np.diff(second.body_at)[self.b])
        place = np.searchsorted(b_ends, a_ends)
        both = np.flatnonzero(b_ends[place] == a_ends) if len(a_ends) else np.zeros(0, np.int64)
        self.a_at, self.b_at = np.append(0, both + 1), np.append(0, place[both] + 1)
        self.group_at = np.searchsorted(both + 1, np.append(0, np.cumsum(self.n_a)), "right")

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each group's ids."""
        return mix(_sums(self.a, self.a_at, MUL_B) * MUL_C + _sums(self.b, self.b_at, MUL_A))


def _sums(ids: np.ndarray, at: np.ndarray, seed: U64) -> np.ndarray:
    """Sums over each group of hashes of ids and their places in it."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    place = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
    return np.add.reduceat(mix(ids.astype(np.uint64) * seed + (place + 1).astype(np.uint64) * MUL_A), at[:-1])


def _same(t: Texts, ids: np.ndarray, bounds: np.ndarray, body: np.ndarray, body_at: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's ids are the text's."""
    got, edges = gather(body, body_at, ids.astype(np.int64))
    at = edges[bounds]
    if np.array_equal(at, t.at) and np.array_equal(got, t.data[: t.n]):
        return np.ones(t.count, bool)
    return np.array([np.array_equal(got[at[k] : at[k + 1]], t.data[t.at[k] : t.at[k + 1]]) for k in range(t.count)], bool)


class Groups(Memory):
    """Distinct groups in a task: the number of A ids, the A ids and the B ids of each."""

    def __init__(self):
        super().__init__(None, None, MOST_GROUPS, MOST_GROUP_IDS)

    def full(self) -> bool:
        return self.count > self.most or self.at[self.count] > self.most_ids

    def intern(self, cut: Cut) -> np.ndarray:
        """The number of each group here."""
        keys = cut.keys()
        got = self._find(keys)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            some = missing[where]
            spans = zip(cut.a_at[some].tolist(), cut.a_at[some + 1].tolist(), cut.b_at[some].tolist(), cut.b_at[some + 1].tolist(), strict=True)
            self._add(new, [[y - x, *cut.a[x:y].tolist(), *cut.b[v:w].tolist()] for x, y, v, w in spans])
            got[missing] = self._find(keys[missing])
        return got

    def key(self, k: int) -> bytes:
        return self.flat[self.at[k] : self.at[k + 1]].astype("<u4").tobytes()

    def text(self, k: int) -> bytes:
        n, *ids = self.flat[self.at[k] : self.at[k + 1]].tolist()
        return b"%s|%s" % (",".join(map(str, ids[:n])).encode(), ",".join(map(str, ids[n:])).encode())


def group_counts(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """key, hash, n: how often each group stands in ``texts(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        seen = np.zeros(0, np.int64)

        def rows():
            for k in range(0, groups.count, 16384):
                stop = min(groups.count, k + 16384)
                yield pa.RecordBatch.from_arrays([pa.array([groups.key(i) for i in range(k, stop)], pa.binary()), pa.array(groups.keys[k:stop].view(np.int64)), pa.array(seen[k:stop])], names=["key", "hash", "n"])

        for batch in batches:
            texts = batch.column(0)
            for x, y in chunks_of(texts):
                if groups.full():
                    yield from rows()
                    groups.clear()
                    seen = np.zeros(0, np.int64)
                found = np.bincount(groups.intern(Cut(texts.slice(x, y - x), byte_path, piece_path)), minlength=groups.count)
                found[: len(seen)] += seen
                seen = found
        yield from rows()

    return texts.mapInArrow(count, "key binary, hash long, n long").groupBy("key", "hash").agg(F.sum("n").alias("n"))


def expanded(groups: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """gid, a, b, n: the links of each of ``groups(gid, key, n)``, a row each.

    Tokens of both sides tile a group's bytes, so its links are the stretches
    between neighbouring ends of either side.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, (_, a_at), second = codecs(byte_path, piece_path)
        a_size, b_size = np.diff(a_at), np.diff(second.body_at)
        for batch in batches:
            keys = batch.column(1)
            if not len(keys):
                continue
            raw = Texts(keys)
            at = raw.at // 4
            flat = raw.data[: raw.n].view("<u4").astype(np.int64)
            own = np.repeat(np.arange(len(keys)), np.diff(at))
            place = np.arange(len(flat)) - at[own]
            is_a, is_b = (place > 0) & (place <= flat[at[own]]), place > flat[at[own]]
            a, b = flat[is_a], flat[is_b]
            a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
            ends = np.union1d(a_ends, b_ends)
            of_a = np.searchsorted(a_ends, ends)
            rows = [batch.column(0).take(owner := pa.array(own[is_a][of_a])), pa.array(a[of_a].astype(np.int32)), pa.array(b[np.searchsorted(b_ends, ends)].astype(np.int32)), batch.column(2).take(owner)]
            yield pa.RecordBatch.from_arrays(rows, names=["gid", "a", "b", "n"])

    return groups.select("gid", "key", "n").mapInArrow(expand, "gid long, a int, b int, n long")


def rated_groups(groups: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``groups(gid, key, hash, n)`` with n_best and count_sum of one occurrence each."""
    links = written(expanded(groups, byte_path, piece_path), "links")
    pairs = written(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    tops = pairs.groupBy("b").agg(F.max("count").alias("top"))  # at most a row for each id of the piece vocabulary
    rated = written(pairs.join(F.broadcast(tops), "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best")), "rated-pairs")
    sums = written(links.join(rated, ["a", "b"]).groupBy("gid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum")), "group-sums")
    return written(groups.join(sums, "gid").select("key", "hash", "n", "n_best", "count_sum"), "rated-groups")


def align(docs: DataFrame, byte_path: str, piece_path: str, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    bound_batches(spark)
    with scratch(spark) as keep:
        groups = written(group_counts(docs.select("text"), byte_path, piece_path).withColumn("gid", F.monotonically_increasing_id()), "groups")
        rated = rated_groups(groups, byte_path, piece_path)
        total = groups.agg(F.sum("n")).first()[0] or 0
        often = F.col("n") > total // most_sent  # so there are fewer than most_sent
        sent = rated.filter(often).select("hash", "n_best", "count_sum").toArrow()
        known = spark.sparkContext.broadcast([sent.column(c).to_numpy() for c in ("hash", "n_best", "count_sum")])

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, best, count_sum = known.value
            order = np.argsort(held.view(np.uint64))
            held, best, count_sum = held.view(np.uint64)[order], best[order], count_sum[order]
            groups, texts_of, sums = Groups(), [], np.zeros((0, 3), np.int64)
            for batch in batches:
                texts = batch.column(1)
                for x, y in chunks_of(texts):
                    if groups.full():
                        groups.clear()
                        texts_of, sums = [], np.zeros((0, 3), np.int64)
                    cut = Cut(texts.slice(x, y - x), byte_path, piece_path)
                    which = groups.intern(cut)
                    if groups.count > len(texts_of):
                        first = len(texts_of)
                        texts_of += map(groups.text, range(first, groups.count))
                        keys = groups.keys[first : groups.count]
                        place = np.minimum(np.searchsorted(held, keys), max(len(held) - 1, 0))
                        is_held = held[place] == keys if len(held) else np.zeros(len(keys), bool)
                        new = np.zeros((len(keys), 3), np.int64)
                        new[:, 0] = ~is_held
                        new[is_held, 1], new[is_held, 2] = best[place[is_held]], count_sum[place[is_held]]
                        sums = np.concatenate([sums, new])
                    totals = np.concatenate([np.zeros((1, 3), np.int64), sums[which].cumsum(0)])[cut.group_at]
                    named = which.tolist()
                    digests, rest_keys, rest_n, rest_at = [], [], [], [0]
                    for k, (i, j) in enumerate(zip(cut.group_at[:-1].tolist(), cut.group_at[1:].tolist(), strict=True)):
                        digests.append(hashlib.sha256(b";".join([texts_of[g] for g in named[i:j]])).hexdigest() if i < j else "")
                        if totals[k + 1, 0] > totals[k, 0]:
                            own = which[i:j]
                            rest, n = np.unique(own[sums[own, 0] > 0], return_counts=True)
                            rest_keys += map(groups.key, rest.tolist())
                            rest_n.append(n)
                        rest_at.append(len(rest_keys))
                    n_groups = np.diff(cut.group_at)
                    rest = pa.StructArray.from_arrays([pa.array(rest_keys, pa.binary()), pa.array(np.concatenate(rest_n) if rest_n else np.zeros(0, np.int64))], names=["key", "n"])
                    per_text = [cut.n_a, cut.n_b, n_groups, cut.n_a + cut.n_b - n_groups, *np.diff(totals[:, 1:], axis=0).T]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(x, y - x), *(pa.array(c.astype(np.int64)) for c in per_text), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), rest)],
                        names=["doc_id", *COUNTS, "groups_sha256", "rest"])

        coded = docs.select("doc_id", "text").mapInArrow(code, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, rest array<struct<key: binary, n: long>>")
        rows = written(coded.withColumn("row", F.monotonically_increasing_id()), "aligned")
        rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.key", F.col("r.n").alias("times"))
        others = rated.filter(~often).select("key", F.col("n_best").alias("x"), F.col("count_sum").alias("y"))
        joined = rest.join(others, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("x")).alias("x"), F.sum(F.col("times") * F.col("y")).alias("y"))
        zero = F.lit(0).cast("long")
        out = rows.join(joined, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("x", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("y", zero)).alias("count_sum"), "groups_sha256")
        return keep(written(out, "alignment"))


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), *vocabularies())
