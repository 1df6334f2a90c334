"""Shapes of structured and prose files: graphs, hierarchies and state machines in JSON, arrows and lists in prose."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING = "file_path string, shape string, nodes int, references int, links int, depth int, confidence double"
PARTS = "file_path string, kind string, name string, target string"
ID_KEYS, SOURCE_KEYS, TARGET_KEYS = ("id", "name", "key"), ("source", "from", "src"), ("target", "to", "dst")


def _each(x, depth: int = 0) -> Iterator[tuple[object, int]]:
    todo = [(x, depth)]
    while todo:
        v, d = todo.pop()
        yield v, d
        todo += [(y, d + 1) for y in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]


def _first(x: dict, keys: tuple) -> str | None:
    return next((x[k] for k in keys if isinstance(x.get(k), str)), None)


def scan_value(value) -> tuple:
    """(shape, nodes, references, links, depth, confidence) by four passes: named objects, strings that name them, source-target objects, nesting."""
    everything = list(_each(value))
    names = {n for x, _ in everything if isinstance(x, dict) and (n := _first(x, ID_KEYS))}
    uses = sum(isinstance(x, str) and x in names for x, _ in everything) - len(names)
    links = sum(isinstance(x, dict) and bool(_first(x, SOURCE_KEYS)) and bool(_first(x, TARGET_KEYS)) for x, _ in everything)
    depth = max(d for _, d in everything)
    signs = (len(names) >= 2, uses >= 2, links >= 1, depth >= 4)
    shape = "graph" if signs[2] else "registry" if signs[0] and signs[1] else "hierarchy" if signs[3] else "list" if signs[0] else "none"
    return shape, len(names), max(uses, 0), links, depth, sum(signs) / 4


def scan_json(files: DataFrame) -> DataFrame:
    """A finding for each of ``files(file_path, text)`` that is JSON; others are of shape 'invalid'."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in FINDING.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((path, *scan_value(json.loads(text or ""))))
                except (ValueError, RecursionError):
                    rows.append((path, "invalid", 0, 0, 0, 0, 0.0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("file_path", "text").mapInArrow(scan, FINDING)


def machine_parts(files: DataFrame) -> DataFrame:
    """(file_path, kind, name, target): nodes, links, actions and guards of JSON state machines."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in PARTS.split(", ")]
        for batch in batches:
            rows = set()
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text or "")
                except (ValueError, RecursionError):
                    continue
                for x, _ in _each(value):
                    if not isinstance(x, dict):
                        continue
                    a, b = _first(x, SOURCE_KEYS), _first(x, TARGET_KEYS)
                    if a and b:
                        rows.add((path, "link", a, b))
                    elif n := _first(x, ID_KEYS):
                        rows.add((path, "node", n, None))
                    for k in ("action", "guard"):
                        if isinstance(x.get(k), str):
                            rows.add((path, k, x[k], None))
            if rows:
                ordered = sorted(rows, key=lambda r: tuple(v or "" for v in r))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*ordered, strict=True)], names=names)

    return files.select("file_path", "text").mapInArrow(parts, PARTS)


def scan_prose(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, arrows, rows, bullets, lines, shape) of prose by the density of arrows, table rows and bullets."""
    text = F.coalesce("text", F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    rows = docs.select(key, count(r"->|=>").alias("arrows"), count(r"\|[^\n|]*\|").alias("rows"), count(r"(?m)^\s*[-*]\s").alias("bullets"), F.size(F.split(text, "\n")).cast("long").alias("lines"))
    n = F.col("lines")
    return rows.withColumn("shape", F.when(F.col("arrows") * 5 >= n, "flow").when(F.col("rows") * 3 >= n, "table").when(F.col("bullets") * 3 >= n, "outline").otherwise("prose"))
