"""Scripts and compiled languages by blocks: ranges of functions, interfaces, traits, class hierarchies, flow of values and keys of responses.

Strings and comments are blanked, braces are matched; there is no syntax tree,
so macros and unusual layouts may be missed. One pass over a file gives all
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .shared import spread
from .web_code import DECLARATIONS, KEYWORDS

ROWS = "kind string, file_path string, name string, target string, detail string, line_number int, end_line int"
SCRIPTS = ("javascript", "typescript")
_FIELDS = [x.split(" ")[0] for x in ROWS.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32()}
_QUOTED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_NAME = r"[A-Za-z_$][\w.$:]*"
_BOUND = re.compile(rf"(?:(?:const|let|var)\s+(?:mut\s+)?)?\b([A-Za-z_$]\w*)\s*(?::=|=(?!=))\s*(?:await\s+)?({_NAME})\(")
_NESTED = re.compile(rf"({_NAME})\(\s*(?:await\s+)?(?=({_NAME})\()")
_EACH = re.compile(rf"for\s*\(\s*(?:const|let|var)\s+\w+\s+of\s+(?:await\s+)?({_NAME})\(")
_CALLED = re.compile(rf"({_NAME})\(([^()]*)\)")
_OPENED = re.compile(r"(?:const|let|var)\s+\{([^}]*)\}\s*=\s*[^;\n]*\.json\(\)")
_ANSWER = re.compile(r"(?:const|let|var)\s+([A-Za-z_$]\w*)\s*=\s*[^;\n]*\.json\(\)")
_CLASS = re.compile(r"\b(?:class|struct)\s+(\w+)(?:\s+final)?\s*:\s*([^{;]+)\{")
_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+([\w:]+)", re.M)


def blanked(text: str) -> str:
    """The text with strings and comments as blanks, line ends kept."""
    return _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closed(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``; the end where none does."""
    depth = 0
    for k in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if not depth:
            return k + 1
    return len(text)


def _ranges(text: str, language: str) -> list[tuple[str, int, int]]:
    """(name, place, end) of declared functions: to the brace that closes the first one opened before a line without any ends."""
    out = []
    at = 0
    for line in text.split("\n"):
        m = re.search(DECLARATIONS[language], line)
        name = next((g for g in m.groups() if g), None) if m else None
        if name and name not in KEYWORDS:
            brace = text.find("{", at + m.end() - (1 if m[0].endswith("{") else 0))
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            out.append((name, at, _closed(text, brace) if 0 <= brace < stop else stop))
        at += len(line) + 1
    return out


def _scan(path: str, language: str | None, raw: str) -> Iterator[tuple]:
    if language not in DECLARATIONS:
        return
    text = blanked(raw)
    line = lambda at: text.count("\n", 0, at) + 1
    for name, at, end in _ranges(text, language):
        yield "range", path, name, None, None, line(at), line(max(at, end - 1))
        body = text[at:end]
        if language in (*SCRIPTS, "go", "rust"):
            real = lambda f: f.split(".")[0] not in KEYWORDS
            for m in _NESTED.finditer(body):
                if real(m[1]) and real(m[2]) and not body[: m.start()].rstrip().endswith(("function", "func", "fn")):
                    yield "flow", path, m[1], m[2], "data_flow_arg", line(at + m.start()), None
            bound = {m[1]: m[2] for m in _BOUND.finditer(body) if real(m[2])}
            for m in _CALLED.finditer(body):
                if not real(m[1]) or m[1] == name:
                    continue
                for a in m[2].split(","):
                    a = a.strip()
                    pair = re.fullmatch(r"\{?\s*\w+\s*:\s*(\w+)\s*\}?", a)
                    if a in bound:
                        yield "flow", path, m[1], bound[a], "data_flow_var", line(at + m.start()), None
                    elif pair and pair[1] in bound:
                        yield "flow", path, m[1], bound[pair[1]], "data_flow_var_kwarg", line(at + m.start()), None
            for m in _EACH.finditer(body):
                yield "flow", path, name, m[1], "data_flow_for_iter", line(at + m.start()), None
        if language in SCRIPTS:
            keys = {k.split(":")[0].strip() for m in _OPENED.finditer(body) for k in m[1].split(",")}
            for m in _ANSWER.finditer(body):
                keys |= set(re.findall(rf"\b{re.escape(m[1])}\.([A-Za-z_$]\w*)", body)) - {"json", "then", "catch", "finally"}
            if keys - {""}:
                yield "consumer", path, name, ",".join(sorted(keys - {""})), None, line(at), None
    if language == "go":
        for m in re.finditer(r"\btype\s+(\w+)\s+interface\s*\{", text):
            body = text[m.end() : _closed(text, m.end() - 1)]
            if methods := re.findall(r"^\s*(\w+)\s*\(", body, re.M):
                yield "interface", path, m[1], ",".join(dict.fromkeys(methods)), None, line(m.start()), None
    if language == "rust":
        for m in re.finditer(r"\btrait\s+(\w+)[^{;]*\{", text):
            body = text[m.end() : _closed(text, m.end() - 1)]
            if methods := re.findall(r"\bfn\s+(\w+)", body):
                yield "trait", path, m[1], ",".join(dict.fromkeys(methods)), None, line(m.start()), None
        for m in _IMPL.finditer(text):
            yield "impl", path, m[2].split("::")[-1], m[1].split("::")[-1], None, line(m.start(1)), None
    if language == "cpp":
        for m in _CLASS.finditer(text):
            plain = re.sub(r"<[^<>]*>", "", m[2])
            bases = [re.sub(r"\b(?:public|private|protected|virtual)\b", "", b).strip().split("::")[-1] for b in plain.split(",")]
            yield "class", path, m[1], ",".join(b for b in bases if b), None, line(m.start()), None


def scan_blocks(files: DataFrame) -> DataFrame:
    """All rows of ``files(file_path, text)``, languages by file ending."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_KINDS[x.split(" ")[1]] for x in ROWS.split(", ")]
        for batch in batches:
            for path, language, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = list(_scan(path, language, text or ""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_FIELDS)

    return spread(files.select("file_path", N.language("file_path").alias("language"), "text")).mapInArrow(scan, ROWS)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """ranges, flows, consumers, interfaces, traits, implementations and hierarchies of scanned rows."""
    of = lambda kind: rows.filter(F.col("kind") == kind)
    listed = lambda kind, name, other: of(kind).select("file_path", F.col("name").alias(name), F.explode(F.split("target", ",")).alias(other))
    return {
        "ranges": of("range").select("file_path", "name", "line_number", "end_line"),
        "flows": of("flow").select("file_path", F.col("name").alias("consumer"), F.col("target").alias("producer"), F.col("detail").alias("provenance")).distinct(),
        "consumers": of("consumer").select("file_path", "name", F.col("target").alias("keys")),
        "interfaces": listed("interface", "interface", "method"), "traits": listed("trait", "trait", "method"),
        "implementations": of("impl").select("file_path", F.col("name").alias("type"), F.col("target").alias("trait")).distinct(), "hierarchies": listed("class", "class_name", "base"),
    }


def enclosing(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """``lines(file_path, line_number)`` with the innermost function around each, null where there is none."""
    inner = F.max_by("name", F.struct("start", (-F.col("end")).alias("e")))
    spans = ranges.select("file_path", "name", F.col("line_number").alias("start"), F.col("end_line").alias("end"))
    met = lines.join(spans, "file_path").filter("line_number BETWEEN start AND end").groupBy("file_path", "line_number").agg(inner.alias("function"))
    return lines.join(met, ["file_path", "line_number"], "left")


def linked_responses(consumers: DataFrame, responses: DataFrame) -> DataFrame:
    """(file_path, name, handler, shared) of functions that read keys and handlers that answer with them; joined on single keys."""
    a = consumers.select("file_path", "name", F.explode(F.split("keys", ",")).alias("key"))
    b = responses.select("handler", F.explode(F.split("keys", ",")).alias("key")).distinct()
    return a.join(b, "key").groupBy("file_path", "name", "handler").agg(F.count(F.lit(1)).alias("shared"))
