"""State machines in JSON files under a folder ``fsms``: their states, events, actions and guards as functions, their transitions as edges.

A file replaces its own earlier rows (``store.apply_delta``); one that isn't a
machine gives an error row and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .shared import spread

ROWS = "kind string, file_path string, name string, target string, docstring string"
_FIELDS = [x.split(" ")[0] for x in ROWS.split(", ")]
TRANSITION = "fsm_transition"


def machine_files(files: DataFrame) -> DataFrame:
    """The JSON files with a path component ``fsms``."""
    return files.filter(F.col("file_path").endswith(".json") & F.array_contains(F.split(F.translate("file_path", "\\", "/"), "/"), "fsms"))


def parse_machine(path: str, text: str | None) -> list[tuple]:
    """(kind, file_path, name, target, docstring) of a machine: states, events, actions, guards and transitions; one error row for what isn't one."""
    try:
        held = json.loads(text or "")
        if not isinstance(held, dict) or not isinstance(held.get("name"), str):
            raise ValueError("missing or non-string 'name'")
        if not isinstance(held.get("states"), list):
            raise ValueError("missing or non-list 'states'")
    except (ValueError, RecursionError) as e:
        return [("error", path, None, None, "JSON parse error" if isinstance(e, json.JSONDecodeError) else str(e))]
    own = held["name"]
    said = lambda x, key: (x.get(key) or None) if isinstance(x, dict) else None
    rows = [("state", path, f"{own}::state::{s['name']}", None, said(s, "prompt")) for s in held["states"] if isinstance(s, dict) and isinstance(s.get("name"), str)]
    for event, x in (held.get("events") or {}).items():
        rows.append(("event", path, f"{own}::event::{event}", None, None))
        for t in (x or {}).get("transitions") or []:
            if isinstance(t.get("to"), str):
                rows.append(("transition", path, f"{own}::event::{event}", f"{own}::state::{t['to']}", None))
    for kind in ("action", "guard"):
        rows += [(kind, path, f"{own}::{kind}::{name}", None, said(x, "description")) for name, x in (held.get(f"{kind}s") or {}).items()]
    return rows


def parse_machines(files: DataFrame) -> DataFrame:
    """All rows of the machines among ``files(file_path, text)``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := parse_machine(path, text):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=_FIELDS)

    return spread(machine_files(files).select("file_path", "text")).mapInArrow(parse, ROWS)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """functions (actions and guards are stubs), edges and errors of parsed rows."""
    parts = rows.filter("kind IN ('state', 'event', 'action', 'guard')")
    return {
        "functions": parts.select("file_path", "name", F.lit(0).alias("line_number"), F.col("kind").isin("action", "guard").alias("is_stub"), "docstring"),
        "edges": rows.filter("kind = 'transition'").select(
            F.col("name").alias("caller"), F.col("target").alias("callee"), F.col("file_path").alias("caller_file"), F.lit(True).alias("resolved"), F.lit(TRANSITION).alias("edge_type"),
            N.normalize_symbol("name").alias("source_id"), N.normalize_symbol("target").alias("target_id")),
        "errors": rows.filter("kind = 'error'").select("file_path", F.col("docstring").alias("error")),
    }


def diagram(rows: DataFrame) -> DataFrame:
    """(machine, line) of state diagrams: a line for each transition."""
    part = lambda c, k: F.get(F.split(c, "::"), F.lit(k))
    return rows.filter("kind = 'transition'").select(part("name", 0).alias("machine"), F.concat(F.lit("[*] --> "), part("target", 2), F.lit(": "), part("name", 2)).alias("line")).distinct()
