"""Token ids and decoding against the libraries, and files against random access."""

import glob
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, token_files, warc
from quillon.llm.pretokens import ALL_CHARACTERS
from quillon.llm.seekable import SeekableReader, write_items

WEIRD = ["", None, " ", "  ", "\n", " \n x", "it's 'twas we'll I've I'm d'd 're", "''s", " 's", "a" * 3000, "é" * 500 + "  \t end ", "１２ ٣ x", "\x00\x01", "中文字符", "\U0001f600 ok", "<|endoftext|> a", "  lead", "trail  "]


def texts(n=4000):
    random.seed(5)
    letters = "abst'' '  \n\t é1２-_!?中\U0001f600\x00 relvmdRE'"
    return WEIRD + ["".join(random.choice(letters) for _ in range(random.randrange(14))) for _ in range(n)]


def test_bpe_equals_tiktoken_and_round_trips():
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(bpe.vocabulary())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    own = bpe.codec(bpe.vocabulary())
    rows = texts() + ["a" + c for c in ALL_CHARACTERS[::37]]
    ids, at = own.encode(pa.array(rows))
    body, ends = own.decode(ids, at)
    for k, text in enumerate(rows):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(text or ""), repr(text)
        assert body[ends[k] : ends[k + 1]].tobytes() == (text or "").encode()


def test_every_token_is_its_own_piece():
    own = bpe.codec(bpe.vocabulary())
    tokens = bpe.read_ranks(bpe.vocabulary())
    got = own.engine.encode(["".join(bpe.TO_CHARACTER[b] for b in t) for t in tokens], num_threads=1)
    assert got == [[k] for k in range(len(tokens))]


def test_memory_forgets_and_stays_right():
    own = bpe.PieceCodec(bpe.vocabulary())
    own.memory.most = 50
    rows = [f"word{k} and {k}" for k in range(400)]
    first = [own.encode(pa.array([r]))[0].tolist() for r in rows]
    assert first == [own.encode(pa.array([r]))[0].tolist() for r in rows]
    assert own.memory.count < 200


def test_memory_is_bounded_in_ids():
    """Pre-tokens as long as their texts are coded right and don't stay."""
    own = bpe.PieceCodec(bpe.vocabulary())
    own.memory.most_ids = 1000
    plain = bpe.PieceCodec(bpe.vocabulary())
    rows = [chr(97 + k) * 20000 + "qx" * 9000 for k in range(12)] + ["w" * 1_500_000, "short"]
    for r in rows:
        assert own.encode(pa.array([r]))[0].tolist() == plain.encode(pa.array([r]))[0].tolist()
        assert own.memory.at[own.memory.count] <= 1000 + len(r)
    assert own.memory.count == 1


def test_bpe_documents(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(WEIRD)] + [(None, "x"), (1, "twice"), (1, "twice")], "doc_id long, text string")
    rows = bpe.code_documents(docs, bpe.vocabulary()).collect()
    assert len(rows) == len(WEIRD) + 3
    empty = hashlib.sha256(b"").hexdigest()
    assert next(r for r in rows if r["doc_id"] == 0) == (0, 0, empty, empty)
    again = bpe.encode_rows(docs, bpe.vocabulary()).collect()
    assert all(r["round_trip"] for r in again) and len(again) == len(rows)
    assert bpe.code_documents(docs.limit(0), bpe.vocabulary()).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.vocabulary())
    library.encode_special_tokens = True
    rows = [(k, t) for k, t in enumerate(texts(800))]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash")).repartition(5)
    manifest = token_files.write_files(docs, str(tmp_path), token_files.vocabulary())
    got = sorted(token_files.read_files(manifest).collect())
    start = 0
    for r, (doc_id, text) in zip(got, sorted(rows), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert r == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    file = next(r["file"] for r in manifest.collect())
    with SeekableReader(file) as source:
        key = int(source.index["key"][0])
        source.get(key)
        assert source.frames_read == 1
    assert token_files.read_document(file, key)[0][-1] == 0
    assert token_files.write_files(docs.limit(0), str(tmp_path / "none"), token_files.vocabulary()).count() == 0


def test_seekable_file(tmp_path):
    import zstandard

    uri = str(tmp_path / "x.zst")
    items = [(k if k % 5 else None, bytes([k % 256]) * (k * 37)) for k in range(200)]
    write_items(uri, items, frame_bytes=5000)
    with SeekableReader(uri) as source:
        assert list(source.items()) == items
        assert source.n_frames > 10
    plain = zstandard.ZstdDecompressor().stream_reader(open(uri, "rb"), read_across_frames=True).read()
    assert plain == b"".join(b for _, b in items)
    raw = bytearray(open(uri, "rb").read())
    raw[int(SeekableReader(uri).starts[3]) + 20] ^= 0xFF
    open(uri, "wb").write(raw)
    with SeekableReader(uri) as source, pytest.raises(Exception):
        list(source.items())


def test_warc_archives(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "http://c", "same"), (4, "u", None), (5, "u", ""), (6, "http://d", "é" * 50000), (None, "n", "same"), (7, "u", "own")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_bundles(df, str(tmp_path))
    got = {r["page_id"]: r for r in warc.read_bundles(manifest).collect()}
    assert len(got) == len(pages)
    assert [got[k]["record_type"] for k in (1, 2, 3, 4, 5, 6, 7, None)] == ["revisit", "revisit", "response", "revisit", "response", "response", "response", "revisit"]
    assert (got[1]["refers_to"], got[None]["refers_to"], got[4]["refers_to"], got[7]["refers_to"]) == (3, 3, 5, None)
    assert got[6]["payload_bytes"] == 100000 and got[1]["payload_bytes"] == 4
    record = warc.read_record(got[6]["bundle"], 6)[0]
    assert record["payload"].decode() == "é" * 50000
    assert "\r" not in warc.read_record(got[1]["bundle"], 1)[0]["url"]
    everything = warc.read_bundles(warc.write_bundles(df, str(tmp_path / "b"), min_revisit_bytes=5)).collect()
    assert {r["record_type"] for r in everything} == {"response"}
    assert warc.read_bundles(warc.write_bundles(df.limit(0), str(tmp_path / "c"))).count() == 0
    assert not glob.glob(str(tmp_path / "*.part"))


def test_warc_of_repeated_rows_and_other_columns(spark, tmp_path):
    """Identical rows are all archived: those that hold the largest id are responses; columns with the names of the index don't matter."""
    rows = [(1, "u", "same", "b", 7), (2, "u", "same", "b", 7), (2, "u", "same", "b", 7), (3, "u", "alone", "b", 7), (3, "u", "alone", "b", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, bundle string, leader int")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.write_bundles(df, str(tmp_path))).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (3, "response", None)]


def test_token_files_of_null_and_repeated_ids_and_wide_ones(spark, tmp_path):
    """Rows without an id come first, rows that repeat one follow each other, and an end id over 16 bits is kept whole."""
    rows = [(5, "five five"), (None, "nobody"), (5, "five again"), (1, None), (None, ""), (2, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("start", F.lit(1)).withColumn("part", F.lit("x"))
    manifest = token_files.write_files(docs, str(tmp_path), token_files.vocabulary(), end_id=70_000)
    got = sorted(token_files.read_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 2, 5, 5]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    held = [x for r in sorted(manifest.collect(), key=lambda r: r["part"]) for k in (1, 5) for x in token_files.read_document(r["file"], k)]
    assert len(held) == 3 and all(x[-1] == 70_000 for x in held) and held[0].tolist() == [70_000]


def test_bpe_of_other_columns_and_long_words(spark):
    docs = spark.createDataFrame([(1, "ab" * 600_000, 3, "x"), (2, "short", 3, "x"), (2, "short", 3, "x")], "doc_id long, text string, n_tokens int, ids_sha256 string")
    rows = sorted(bpe.code_documents(docs, bpe.vocabulary()).collect())
    assert [r["doc_id"] for r in rows] == [1, 2, 2] and rows[0]["decoded_sha256"] == hashlib.sha256(b"ab" * 600_000).hexdigest() and rows[1] == rows[2]
