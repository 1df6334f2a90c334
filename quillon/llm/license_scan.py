"""License scans by template markup.

Templates are texts with optional regions ``[[ ... ]]`` and replaceable regions
``{n}`` (any words, at most n). Each compiles to an automaton over words: a
mandatory word must match exactly, an optional region may be skipped whole, a
replaceable region takes up to n words. A text gets a template's label where
its automaton accepts a run of the text's words.

Words are runs of letters, digits and characters beyond ASCII, lower-cased, so
layout and punctuation don't matter. Base phrases are counted apart from the
templates. Automata start only where a template's first mandatory words stand,
which is found by word hashes over whole columns, and the words at such places
are then compared themselves.

Null and empty texts have no words and no labels; an empty table gives no rows.
Texts are scanned whole, however long, and repeated rows each; of runs that
begin at one place the longest counts. Extra columns don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, documents
from .spans import ALNUM, Texts, chunks_of, owners, windows

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Public license wordings as templates. None begins with a region.
TEMPLATES = (
    ("apache-2.0", "licensed under the[[ terms of the]] apache license[[ version]] 2.0"),
    ("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at[[ {8}]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("cc-by-notice", "licensed under[[ a]][[ the]] cc by[[ nc]][[ nd]][[ sa]][[ {2}]] 4.0[[ international]]"),
    ("gpl-notice", "this {3} is licensed under the gnu[[ lesser]][[ affero]] general public license version {1}"),
    ("gpl-notice", "is free software you can redistribute it and or modify it under the terms of the gnu[[ lesser]][[ affero]] general public license as published by the free software foundation"),
    ("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu[[ lesser]][[ affero]] general public license for more details"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-notice", "licensed under the[[ terms of the]] mozilla public license[[[[ version]] 2.0]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-notice", "to the extent possible under law {12} waived all copyright and related or neighboring rights to {20}"),
    ("cc0-notice", "dedicated to the public domain under[[ the]][[ creative commons]] cc0[[ 1.0[[ universal]]]]"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("mit-notice", "released under the[[ terms of the]] mit license"),
    ("mit-notice", "licensed under the[[ terms of the]] mit license"),
    ("mit-notice", "distributed under the[[ terms of the]] mit license"),
    ("mit-warranty", "in no event shall the[[ authors or]] copyright holders[[ {3}]] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice[[ including the next paragraph]] shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and[[ or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met[[ 1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer[[ 2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("copyright-notice", "copyright[[ c]] {12} all rights reserved"),
    ("warranty", "the software is provided as is[[ and {6} disclaims all warranties]][[ without warranty of any kind]]"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MOST_ANCHOR_WORDS = 3
_MARK = re.compile(r"\[\[|\]\]|\{(\d+)\}|[^\[\]{}]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


@dataclass(frozen=True)
class Automaton:
    """States 0 to ``accept``. ``steps[s]`` is the word that leads from s to s + 1, None for any word; ``skips[s]`` are states reached from s for nothing."""

    label: str
    steps: tuple
    skips: tuple
    accept: int

    def _open(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def longest(self, words: list[str], at: int) -> int:
        """Words in the longest run accepted that begins at ``at``; -1 if none is."""
        now, best = self._open({0}), -1
        if self.accept in now:
            best = 0
        for k in range(at, len(words)):
            now = self._open({s + 1 for s in now if s < self.accept and self.steps[s] in (None, words[k])})
            if not now:
                break
            if self.accept in now:
                best = k + 1 - at
        return best


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template; optional regions may hold replaceable ones and each other."""
    steps: list[str | None] = []
    skips: list[set[int]] = [set()]
    opened: list[int] = []
    for mark in _MARK.finditer(template):
        if mark[0] == "[[":
            opened.append(len(steps))
        elif mark[0] == "]]":
            if not opened:
                raise ValueError(f"{label}: a region is closed that isn't open")
            skips[opened.pop()].add(len(steps))
        elif mark[1]:
            begin = len(steps)
            for _ in range(int(mark[1])):
                steps.append(None)
                skips.append(set())
            for s in range(begin, len(steps)):
                skips[s].add(len(steps))
        else:
            for word in words_of(mark[0]):
                steps.append(word)
                skips.append(set())
    if opened or not steps or steps[0] is None or skips[0]:
        raise ValueError(f"{label}: a template must begin with a mandatory word and close its regions")
    return Automaton(label, tuple(steps), tuple(map(tuple, skips)), len(steps))


def _run_hash(words: list[str]) -> np.uint64:
    """The hash that ``windows`` has for these words in a row."""
    t = Texts(pa.array([" ".join(words)]), lower=True)
    starts, ends, bounds = t.runs(ALNUM)
    return windows(t.hashes(starts, ends), bounds, len(words))[0][0]


@lru_cache(maxsize=1)
def _prepared():
    base = [(len(p.split()), _run_hash(p.split()), label) for p, label in BASE]
    automata = [compiled(*t) for t in TEMPLATES]
    anchors = []
    for a in automata:
        stop = 1
        while stop < min(MOST_ANCHOR_WORDS, len(a.steps)) and a.steps[stop] is not None and not a.skips[stop]:
            stop += 1
        anchors.append((stop, _run_hash(list(a.steps[:stop]))))
    return base, automata, anchors


def scan_texts(texts: pa.Array) -> list[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each text.

    The score is the share of a text's words inside accepted runs and base
    phrases, so a text that is a license whole has 1.
    """
    base, automata, anchors = _prepared()
    t = Texts(texts, lower=True)
    starts, ends, bounds = t.runs(ALNUM)
    h = t.hashes(starts, ends)
    own = owners(bounds)
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(length: int, key: np.uint64) -> np.ndarray:
        if length not in by_length:
            by_length[length] = windows(h, bounds, length)
        keys, first = by_length[length]
        return first[keys == key]

    n = np.diff(bounds)
    n_base = np.zeros(t.count, np.int64)
    low, high = np.full(t.count, -1, np.int64), np.full(t.count, -1, np.int64)
    labels: list[set[str]] = [set() for _ in range(t.count)]
    base_labels: list[set[str]] = [set() for _ in range(t.count)]
    covered: dict[int, list[tuple[int, int]]] = {}
    for length, key, label in base:
        for at in places(length, key).tolist():
            text = int(own[at])
            place = at - int(bounds[text])
            n_base[text] += 1
            low[text] = place if low[text] < 0 else min(low[text], place)
            high[text] = max(high[text], place)
            base_labels[text].add(label)
            covered.setdefault(text, []).append((place, place + length))
    known: dict[int, list[str]] = {}
    for a, (length, key) in zip(automata, anchors, strict=True):
        for at in places(length, key).tolist():
            text = int(own[at])
            if text not in known:
                known[text] = words_of(t.data[t.at[text] : t.at[text + 1]].tobytes().decode())
            place = at - int(bounds[text])
            run = a.longest(known[text], place)
            if run > 0:
                labels[text].add(a.label)
                covered.setdefault(text, []).append((place, place + run))
    out = []
    for k in range(t.count):
        inside, reach = 0, 0
        for a, b in sorted(covered.get(k, ())):
            inside += max(0, b - max(a, reach))
            reach = max(reach, b)
        some = n_base[k] > 0
        out.append((int(n[k]), int(n_base[k]), int(low[k]) if some else None, int(high[k]) if some else None,
                    ",".join(sorted(base_labels[k])), ",".join(sorted(base_labels[k] | labels[k])), inside / int(n[k]) if n[k] else 0.0))
    return out


_FIELDS = (("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()),
           ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()))


@F.arrow_udf(T.StructType([T.StructField(n, k) for n, k, _ in _FIELDS]))
def _licenses(texts: pa.Array) -> pa.Array:
    rows = [row for a, b in chunks_of(texts) for row in scan_texts(texts.slice(a, b - a))]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, (_, _, k) in zip(columns, _FIELDS, strict=True)], names=[n for n, _, _ in _FIELDS])


def licenses(text: Column | str) -> Column:
    """The struct of ``scan_texts`` for a text column."""
    return _licenses(text)


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and the scan for each row of ``docs(doc_id, text)``."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", licenses("text").alias("s")).select("doc_id", "s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir))


def _regex(template: str) -> str:
    """A template as a regular expression over words that each have one blank behind them."""
    out = ""
    for mark in _MARK.finditer(template):
        if mark[0] == "[[":
            out += "(?:"
        elif mark[0] == "]]":
            out += ")?"
        elif mark[1]:
            out += f"(?:[^ ]+ ){{0,{mark[1]}}}"
        else:
            out += "".join(w + " " for w in words_of(mark[0]))
    return out


def _sql() -> str:
    base = [(p, label, len(p.split())) for p, label in BASE]
    spots = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, i - 1 AS pos, i - 1 + {n} AS stop FROM (SELECT rid, ws, unnest(range(1, n_words - {n} + 2)) AS i FROM w WHERE n_words >= {n}) WHERE array_to_string(ws[i:i+{n - 1}], ' ') = '{p}'"
        for p, label, n in base)
    # All places where a template's first word stands, each with its longest run.
    runs = " UNION ALL ".join(
        f"""SELECT rid, '{label}' AS label, i - 1 AS pos, i - 1 + length(m) - length(replace(m, ' ', '')) AS stop
            FROM (SELECT rid, i, regexp_extract(array_to_string(ws[i:i+{len(words_of(_plain(t))) + 40}], ' ') || ' ', '^{_regex(t)}', 0) AS m
                  FROM (SELECT rid, ws, unnest(range(1, n_words + 1)) AS i FROM w WHERE contains(' ' || array_to_string(ws, ' ') || ' ', '{_lead(t)}')) WHERE ws[i] = '{words_of(t)[0]}') WHERE m <> ''"""
        for label, t in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT *, len(ws) AS n_words FROM d),
b AS ({spots}),
r AS ({runs}),
c AS (SELECT rid, count(DISTINCT k) AS inside FROM (SELECT rid, unnest(range(pos, stop)) AS k FROM (SELECT * FROM b UNION ALL SELECT * FROM r)) GROUP BY rid),
gb AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid),
ga AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM r) GROUP BY rid)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_words > 0 THEN coalesce(inside, 0) / n_words ELSE 0.0 END AS score
FROM w LEFT JOIN gb USING (rid) LEFT JOIN ga USING (rid) LEFT JOIN c USING (rid)
"""


def _plain(template: str) -> str:
    return re.sub(r"\[\[|\]\]|\{\d+\}", " ", template)


def _lead(template: str) -> str:
    """Words that every run of a template begins with."""
    return " " + " ".join(words_of(re.split(r"\[\[|\{", template)[0])) + " "


SQL = _sql()
