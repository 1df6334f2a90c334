"""Byte-level BPE through a sentencepiece model made straight from a rank file.

Every byte is written as one printable character, so each vocabulary entry is
a piece; a piece's score is its negative rank, the normaliser is the identity,
and the model is serialised here field by field. Sentencepiece's merging by
highest score then is merging by lowest rank. Pre-tokens are encoded one by
one; decoding maps pieces back to bytes.

A null text is empty and has no ids; an empty table gives no rows. Texts are
never cut. Of merges of one rank the leftmost goes first. Repeated rows give
repeated results. Results carry only the named columns, whatever others the
input has.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, documents
from .pretokens import ALL_CHARACTERS, LETTER, NUMBER, SPACE_CLASS, Memory, class_table, gather
from .spans import Texts, chunks_of


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


TO_CHARACTER = dict(enumerate(byte_characters()))
TO_BYTE = {c: b for b, c in TO_CHARACTER.items()}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank."""
    with open(path, "rb") as source:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, source))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks aren't 0 to {len(pairs) - 1}")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    body = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece k is token k; the required unknown piece comes last."""
    pieces = [_field(1, "".join(TO_CHARACTER[b] for b in token)) + _field(2, float(-rank)) + _field(3, 1) for rank, token in enumerate(tokens)]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, piece) for piece in pieces) + _field(2, trainer) + _field(3, normaliser)


def tiktoken_classes() -> np.ndarray:
    """Character classes as tiktoken's own engine has them."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def members(pattern: str) -> str:
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(ALL_CHARACTERS)
        return bytes(found).decode()

    return class_table({LETTER: members(r"\p{L}"), NUMBER: members(r"\p{N}"), SPACE_CLASS: members(r"\s")})


class PieceCodec:
    """Encoding and decoding with one serialised model; one for each worker process."""

    def __init__(self, path: str):
        import sentencepiece

        tokens = read_ranks(path)
        self.model = serialised_model(tokens)
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.memory = Memory(self._pieces, tiktoken_classes())
        bodies = [bytes(TO_BYTE[c] for c in self.engine.id_to_piece(k)) for k in range(len(tokens))]
        self.body = np.frombuffer(b"".join(bodies), np.uint8)
        self.body_at = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(b) for b in bodies], out=self.body_at[1:])

    def _pieces(self, pretokens: list[str]) -> list[list[int]]:
        return self.engine.encode([p.encode().decode("latin-1").translate(TO_CHARACTER) for p in pretokens], num_threads=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and their bounds by text."""
        return self.memory.ids(texts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, joined, and their bounds by text."""
        body, edges = gather(self.body, self.body_at, ids.astype(np.int64))
        return body, edges[bounds]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def token_ids(text: Column | str, path: str) -> Column:
    """The ids of a text, an array of ints."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        parts = []
        for a, b in chunks_of(texts):
            ids, bounds = codec(path).encode(texts.slice(a, b - a))
            parts.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def token_bytes(ids: Column | str, path: str) -> Column:
    """The bytes that an array of ids stands for; a null array stands for none."""

    @F.arrow_udf(T.BinaryType())
    def decode(lists: pa.Array) -> pa.Array:
        bounds = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=bounds[1:])
        body, edges = codec(path).decode(lists.flatten().to_numpy(zero_copy_only=False), bounds)
        raw = body.tobytes()
        return pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())

    return decode(ids)


def coded(text: Column | str, path: str) -> Column:
    """Number of ids of a text, digest of the ids as little-endian 32-bit integers, and digest of the decoded bytes."""

    @F.arrow_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
    def digest(texts: pa.Array) -> pa.Array:
        sizes, of_ids, of_bytes = [], [], []
        for a, b in chunks_of(texts):
            ids, bounds = codec(path).encode(texts.slice(a, b - a))
            body, edges = codec(path).decode(ids, bounds)
            raw, text_raw = memoryview(ids.astype("<u4")).cast("B"), memoryview(np.ascontiguousarray(body))
            for k in range(b - a):
                sizes.append(int(bounds[k + 1] - bounds[k]))
                of_ids.append(hashlib.sha256(raw[4 * bounds[k] : 4 * bounds[k + 1]]).hexdigest())
                of_bytes.append(hashlib.sha256(text_raw[edges[k] : edges[k + 1]]).hexdigest())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def code_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs(doc_id, text)``."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", coded("text", path).alias("c")).select("doc_id", "c.*")


def checked_ids(text: Column | str, path: str) -> Column:
    """token_ids of a text, and round_trip: whether they decode to it. One pass, one worker."""

    @F.arrow_udf(T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]))
    def encode(texts: pa.Array) -> pa.Array:
        lists, same = [], []
        for a, b in chunks_of(texts):
            piece = texts.slice(a, b - a)
            ids, bounds = codec(path).encode(piece)
            body, edges = codec(path).decode(ids, bounds)
            t = Texts(piece)
            equal = np.array_equal(t.at, edges) and np.array_equal(t.data[: t.n], body)
            same += [True] * (b - a) if equal else [np.array_equal(t.data[t.at[k] : t.at[k + 1]], body[edges[k] : edges[k + 1]]) for k in range(b - a)]
            lists.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
        ids_ = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([ids_, pa.array(same, pa.bool_())], names=["token_ids", "round_trip"])

    return encode(text)


def encode_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip (whether the ids decode to the text) for each row of ``docs``."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", checked_ids("text", path).alias("c"))
    return rows.select("doc_id", F.size("c.token_ids").cast("long").alias("n_tokens"), "c.token_ids", "c.round_trip")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_documents(documents(spark, sf_dir), vocabulary())
