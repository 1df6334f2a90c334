"""Groups, links and counts of two tokenizers against a plain walk over whole texts."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from quillon.llm import alignment
from quillon.llm.bpe import TO_BYTE

FIELDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rest", T.StringType()), T.StructField("n_a", T.StringType())])


def plain(rows):
    """Result rows of (doc_id, text) by whole-text encoding and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.vocabularies()
    first, second = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    first.encode_special_tokens = True
    docs, counts = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        a_bytes = [bytes(TO_BYTE[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in (a_bytes, b_bytes)):
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, bodies in ((a, a_bytes), (b, b_bytes)):
            end, out = 0, []
            for i, body in zip(ids, bodies):
                out.append((end, end + len(body), i))
                end += len(body)
            spans.append(out)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        begin = 0
        for end in common:
            own = [[i for s, e, i in side if begin <= s and e <= end] for side in spans]
            groups.append("|".join(",".join(map(str, ids)) for ids in own))
            begin = end
        for s, e, i in spans[0]:
            links += [(i, j) for x, y, j in spans[1] if x < e and s < y]
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return sorted(
        ((d, len(a), len(b), len(g), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, links in docs),
        key=str)


TEXTS = ["The quick brown fox.", None, "", " ", "  two  blanks ", "tail   ", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve façade 東京都 \U0001f600 ok", "\x00\x01\n\n\ttabs\r\n", "東" * 90, "x" * 400, "it's we'll 12345 3.14",
         "Überraschung für größere Straßen", "the the the the", "The quick brown fox.", "word " * 3000 + "end", "　wide space", "é́ combining"]


@pytest.mark.parametrize("most_sent", [1, 4, 1 << 16])
def test_alignment_equals_whole_texts(spark, most_sent):
    """However many groups' sums are sent to the tasks and however many are joined."""
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id here"), (3, "a repeated id"), (3, "a repeated id")]
    frame = spark.createDataFrame([(d, t, "rest", "n_a") for d, t in rows], FIELDS).repartition(3)
    got = alignment.align(frame, *alignment.vocabularies(), most_sent=most_sent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_alignment_of_driver_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, alignment.align(docs, *alignment.vocabularies(), most_sent=512).collect()), key=str) == plain(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], FIELDS), *alignment.vocabularies()).count() == 0
    nothing = spark.createDataFrame([(1, None, "", "")], FIELDS)
    assert [tuple(r) for r in alignment.align(nothing, *alignment.vocabularies()).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_memory_of_groups_starts_anew(spark, monkeypatch):
    """A task that remembers few groups gives the same rows."""
    from quillon.llm.pretokens import Memory

    monkeypatch.setattr(alignment.Groups, "__init__", lambda self: Memory.__init__(self, None, None, 5, 50))
    monkeypatch.setattr(alignment, "chunks_of", lambda texts: ((k, k + 1) for k in range(len(texts))))
    batch = alignment.pa.array(TEXTS)
    groups, found = alignment.Groups(), Counter()
    for x, y in alignment.chunks_of(batch):
        if groups.full():
            groups.clear()
        cut = alignment.Cut(batch.slice(x, y - x), *alignment.vocabularies())
        found.update(groups.text(int(k)) for k in groups.intern(cut))
    want = Counter()
    once = alignment.Cut(batch, *alignment.vocabularies())
    all_groups = Memory.__new__(alignment.Groups)
    Memory.__init__(all_groups, None, None)
    want.update(all_groups.text(int(k)) for k in all_groups.intern(once))
    assert found == want
