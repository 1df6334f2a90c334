"""Token ids as files of independent zstandard frames.

Documents are dealt by ranges of doc_id and sorted; each task encodes its range
with the tokenizers library and writes one file of little-endian ids, a
document after another, each closed by the end id. Frames are independent and
checksummed, an index gives each document's frame, offset and length, and the
seek table ends the file, so a reader decompresses only the frames it needs.
The written manifest has one row for each file; where a file's ids begin in the
whole is the running total over that manifest. The number of files follows the
table's size, so a file and its index stay of one size however large the table.

A null text has the end id alone. A null doc_id comes first and is written
without a key. Rows that tie on doc_id keep their input order. An empty table
gives no file. Extra columns aren't written. Special tokens' strings in a text
are ordinary text.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, documents, new_folder, parts_for, written
from .pretokens import ALL_CHARACTERS, LETTER, NUMBER, SPACE_CLASS, Memory, class_table
from .seekable import SeekableReader, write_items
from .spans import chunks_of

END_ID = 0
FRAME_BYTES = 128 << 10
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class LibraryCodec:
    """The tokenizers library behind a memory of pre-tokens; one for each worker process."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.engine = Tokenizer.from_file(path)
        self.engine.encode_special_tokens = True
        self.n_ids = self.engine.get_vocab_size(with_added_tokens=True)

        def members(pattern: str) -> str:
            asked, out = pre_tokenizers.Split(Regex(pattern), "removed"), []
            for k in range(0, len(ALL_CHARACTERS), 1 << 14):  # a few at a time, as each answer is an object
                some, at = ALL_CHARACTERS[k : k + (1 << 14)], 0
                for _, (a, b) in asked.pre_tokenize_str(some):
                    out.append(some[at:a])
                    at = b
                out.append(some[at:])
            return "".join(out)

        self.memory = Memory(self._encode, class_table({LETTER: members(r"\p{L}"), NUMBER: members(r"\p{N}"), SPACE_CLASS: members(r"\s")}))

    def _encode(self, pretokens: list[str]) -> list[list[int]]:
        return [x.ids for x in self.engine.encode_batch_fast(pretokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs(doc_id, text)`` in order of doc_id; returns the manifest (part, file, n_docs, n_ids)."""
    bound_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.ids.zst"
        total = 0

        def items():
            nonlocal total
            engine = codec(path)
            kind = "<u2" if max(engine.n_ids, end_id + 1) <= 1 << 16 else "<u4"
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1)
                for a, b in chunks_of(texts):
                    ids, bounds = engine.memory.ids(texts.slice(a, b - a))
                    for k in range(a, b):
                        own = np.append(ids[bounds[k - a] : bounds[k - a + 1]], end_id).astype(kind)
                        total += len(own)
                        yield keys[k], bytes([own.itemsize]) + own.tobytes()

        first = next(source := items(), None)
        if first is None:
            return

        def again():
            yield first
            yield from source

        count, _ = write_items(name, again(), FRAME_BYTES)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [name], "n_docs": [count], "n_ids": [total]})

    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(parts_for(docs.select("doc_id", "text")), "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return written(ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "ids-manifest")


def ids_of(item: bytes) -> np.ndarray:
    """The ids of one stored document."""
    return np.frombuffer(item, f"<u{item[0]}", offset=1).astype("<u4")


def read_files(manifest: DataFrame) -> DataFrame:
    """A row for each document of the manifest's files, from the files alone.

    The running total is over one row per file, not per document.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("begin"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = READ.replace(" long", "").split(", ")
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with SeekableReader(name) as source:
                    for key, item in source.items():
                        ids = ids_of(item)
                        rows.append((key, begin, len(ids), zlib.crc32(ids.tobytes())))
                        begin += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return files.repartition(max(parts_for(manifest), manifest.count()), "file").mapInArrow(read, READ)


def read_document(file: str, doc_id: int) -> list[np.ndarray]:
    """Ids of one document, from its own frames only."""
    with SeekableReader(file) as source:
        return [ids_of(x) for x in source.get(doc_id)]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "ids")
    return read_files(write_files(documents(spark, sf_dir), folder, vocabulary()))
