"""The substring join against a comparison of all pairs, and how many candidates it makes of skewed names."""

import random

from quillon.operators.judgment import PIECES, STRETCH, contained, containment_candidates


def frame(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def plain(parts, texts):
    return sorted({(p, t) for p in parts if p for t in texts if t and p.lower() in t.lower()})


def joined(spark, parts, texts):
    return sorted(map(tuple, contained(frame(spark, "part", parts), frame(spark, "text", texts)).collect()))


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["get", "set", "order", "Order", "row", "_", "é", "İx", "𝒜b", "a", "ab", "item"]
    parts = ["".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(120)]
    texts = ["".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(150)]
    assert joined(spark, parts, texts) == plain(parts, texts)


def test_empty_null_repeated_and_case(spark):
    parts, texts = ["Get", "get", None, "", "get"], ["target", "TARGET", None, "", "target", "ge"]
    assert joined(spark, parts, texts) == [("Get", "TARGET"), ("Get", "target"), ("get", "TARGET"), ("get", "target")]
    assert joined(spark, [], texts) == [] and joined(spark, parts, []) == []


def test_long_texts_across_stretches(spark):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghij", k=5 * STRETCH))
    at = [STRETCH - 1, STRETCH, STRETCH + 1, 2 * STRETCH - 5, 5 * STRETCH - 40]
    parts = [text[i - w // 2: i - w // 2 + w] for i in at for w in (*PIECES, 4, 11, 13, 30)]
    assert joined(spark, parts + ["zz", "abcabcabcabc"], [text]) == plain(parts + ["zz", "abcabcabcabc"], [text])


def test_candidates_follow_hits(spark):
    """A fifth of the names begin alike, as do as many texts: candidates stay within twice the true hits, the pairs of equal beginnings do not."""
    names = [(f"get_item_{k}" if k % 5 == 0 else f"load_order{k}_row") for k in range(4000)]
    texts = [(f"see get_item_{k * 7 % 5000} there" if k % 5 == 0 else f"mod{k % 17}.load_order{k * 3 % 9000}_row") for k in range(4000)]
    parts, rows = frame(spark, "part", names), frame(spark, "text", texts)
    hits = contained(parts, rows).count()
    found = containment_candidates(parts, rows).count()
    alike = sum(n[:3] == "get" for n in names) * sum("get" in t for t in texts)
    assert hits > 1000 and found <= 2 * hits and found * 20 < alike
