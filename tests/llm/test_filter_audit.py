"""Removals by order, step and part against a walk over each document in each order."""

from itertools import permutations

import pytest

from quillon.llm import filter_audit

WORDS = " ".join(f"w{k}" for k in range(60))
ROWS = [(1, WORDS, "a"), (2, WORDS, "a"), (3, WORDS + " #", "b"), (4, "", None), (5, None, "a"), (6, "A " * 60, "b"), (7, "A " * 60, ""), (7, "A " * 60, "b"), (None, WORDS, "a"), (8, WORDS.upper() + "\x0b\x0c", "a"),
        (9, "é " * 49 + "|", "b"), (10, "word " * 40000, "b"), (11, " \t\n", "a"), (12, WORDS + " B" * 8, "c")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, None, 1), (7, 1, None), (10, 0, 1), (None, 1, 1), (99, 1, 1)]


def fails(rows, k):
    doc_id, text, _ = rows[k]
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
        out.add("E")
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = [fails(rows, k) for k in range(len(rows))]
    out, shapley = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {s or "" for _, _, s in rows}:
            own = [(i, f) for (i, _, s), f in zip(rows, found) if (s or "") == part]
            left = own
            for step, c in enumerate(order, 1):
                gone = [i for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                failing = sum(c in f for _, f in own)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(f == {c} for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone))
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items())


@pytest.mark.parametrize("rows, labels", [(ROWS, LABELS), (ROWS[:1], []), ([], LABELS)])
def test_against_a_walk(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, n long").repartition(3)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, source string")
    out = filter_audit.audit(docs, marks)
    assert out.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert sorted(tuple(r) for r in out.collect()) == plain(rows, labels)


def test_table():
    assert filter_audit.FIRST_FAILURE.shape == (32, 120)
    assert (filter_audit.FIRST_FAILURE[0] == 5).all() and (filter_audit.FIRST_FAILURE[31] == 0).all()
