"""Stages keep every column as it was, whatever its name."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import near_dedup, quality_rules, secret_scan

CLASHES = ["__measures", "__strict_host", "__id", "__th", "__component", "__size", "__hash", "__alone", "__base", "__all", "__more", "___ID", "host", "label", "th", "m", "first", "n"]


@pytest.mark.parametrize("stage", [quality_rules.keep_documents, near_dedup.keep_documents, secret_scan.redact_documents])
def test_clashing_columns(spark, stage):
    prose = lambda k: " ".join(f"word{k}x{j}" for j in range(40))
    rows = [(k, prose(k // 2 if k < 4 else k), "en", "s" if k % 2 else None, 40) for k in range(12)] + [(3, prose(1), "en", "s", 40), (50, None, None, None, None), (51, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.select("*", *(F.lit(f"value of {c}").alias(c) for c in CLASHES))
    plain, out = stage(docs), stage(clashing)
    assert out.columns == clashing.columns
    assert sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert all(r[c] == f"value of {c}" for r in out.collect() for c in CLASHES)
