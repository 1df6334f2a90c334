"""The pipeline's stages on a small corpus: what goes, what stays, and columns."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import bpe, decontaminate


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = make(40)
    base = [make(60) for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(base)] + [(20, base[0]), (21, base[0] + " tail"), (22, "too short"), (23, make(50) + " " + item + " " + make(30)), (24, make(40) + " token = 0123456789abcdef0123456789"), (25, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [*range(8), 24]
    assert all(r["round_trip"] for r in out.values())
    text = bytes(bpe.codec(bpe.vocabulary()).decode(__import__("numpy").array(out[24]["token_ids"]), __import__("numpy").array([0, len(out[24]["token_ids"])]))[0]).decode()
    assert text.endswith("[secret]")
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, now.limit(0), str(tmp_path)).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "byte_bpe"]
    assert now.filter(F.col("doc_id") < 0).count() == 0


def test_stages_of_nulls_repeats_and_nothing(spark, tmp_path):
    """Null fields, repeated rows and clashing columns pass; an empty table passes every stage."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text + " and more of it", "en", "s", 3), (3, None, "en", "s", None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, cid int, spans string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == 1 and out[0]["round_trip"] and len(out[0]["token_ids"]) > 40
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_decontamination_is_fitted_to_every_window_of_the_stage(spark, tmp_path, monkeypatch):
    """An item holds all words of the corpus, so a window's row has norm 1 and the sums' diagonal adds up to the number of all windows, over 4,096 of them."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(100)) for _ in range(900)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(400)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sums, seen = decontaminate.corpus_sums, []
    monkeypatch.setattr(decontaminate, "corpus_sums", lambda *given: seen.append(sums(*given)) or seen[-1])
    dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    count = len(decontaminate.windows(decontaminate._words(pa.array(texts))[1])[0])
    assert count > 4096 and abs(sum(np.frombuffer(r["v"])[0] for r in seen[0].collect()) - count) < 0.01


def test_run_equals_brute_force(spark, tmp_path):
    """Every stage in plain Python on a few hundred documents: rules, links of five-word shingles, items held, spans redacted, ids of the public library."""
    rng = random.Random(30)
    word = lambda: f"w{rng.randrange(10**6)}"
    make = lambda n: " ".join(word() for _ in range(n))
    items = [make(rng.randrange(15, 60)) for _ in range(12)]
    texts = []
    for k in range(240):
        t = make(rng.randrange(5, 90)).split()
        if k % 6 == 1:  # near and far copies of an earlier one
            t = list(texts[rng.randrange(len(texts))].split())
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(len(t))] = word()
        if k % 10 == 3:
            t += rng.choice(items).split() + make(20).split()
        if k % 8 == 5:
            t += ["token", "=", "".join(rng.choice("0123456789abcdef") for _ in range(30))]
        if k % 12 == 7:
            t = t[:10] * 12
        texts.append(" ".join(t))
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def passes(t):
        w = t.split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        return len(w) >= 20 and 100 * len(inside) <= 30 * len(w)

    left = [k for k, t in enumerate(texts) if passes(t)]
    shingles = {k: {tuple(texts[k].split()[i : i + 5]) for i in range(len(texts[k].split()) - 4)} for k in left}
    label = {k: k for k in left}
    for a in left:
        for b in left:
            both = len(shingles[a] & shingles[b])
            if a < b and label[a] != label[b] and 100 * both >= 80 * (len(shingles[a]) + len(shingles[b]) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    left = [k for k in left if label[k] == k]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b):
                row[j + 1] = above[j] + 1 if x == y else max(row[j], above[j + 1])
        return row[-1]

    def holds(t, i):
        i, t = i.split(), t.split()
        share = common(i, t) / len(i)
        return share >= 0.75 or share >= 0.55 and common(i[-6:], t) >= 0.8 * 6

    left = [k for k in left if not any(holds(texts[k], i) for i in items)]
    redacted = {k: re.sub(r"token = [0-9a-f]{30}", "[secret]", texts[k]) for k in left}
    library = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_ranks(), special_tokens={})
    want = {k: library.encode_ordinary(t) for k, t in redacted.items()}
    got = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 60 < len(want) < 200 and any(redacted[k] != texts[k] for k in left)


def bpe_ranks():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    return {base64.b64decode(t): int(n) for t, n in (x.split() for x in lines if x)}
