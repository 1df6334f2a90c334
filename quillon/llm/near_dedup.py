"""Near-duplicate documents by circulant MinHash and exact Jaccard.

A document's set is its distinct shingles of a few words. Two permutations of 32-bit
words give all coordinates: the first scatters the shingles, the second, shifted
circularly by k, ranks them for coordinate k. Bands of coordinates propose
candidates; links are confirmed on full shingle sets.

How groups of any size stay cheap and whole:

* documents with equal sets are one class from the start, by partial aggregation;
* in each band bucket every class is compared with the bucket's first class
  alone, a star that joins most near copies in linear work;
* of what such stars leave apart, groups of a few are compared pair by pair; a
  larger group gets a second star around the member that shares most with
  others, and what that leaves apart can only link if it shares some of its
  rarest differences from that member, by an exact bound (see ``_candidates``);
* components are found by star contraction in the cluster.

The chance that no band proposes a pair at exactly the threshold is
(1 - 0.8^5)^40 = 1.3e-7, and less above it.

Texts that are null, empty or without words have empty sets and link with
nothing. Rows that repeat a doc_id are separate documents here; a null doc_id
has no say in component ids. Of rows that tie for the smallest doc_id all are
kept, and ``keep_documents`` keeps one. Texts of any length are taken whole. An
empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import bound_batches, documents, scratch, unused, written
from .spans import MUL_A, MUL_C, SPACE, U64, Texts, chunks_of, mix, owners, windows

SHINGLE_WORDS = 4
#: Words of a shingle where no contract says otherwise.
STAGE_WORDS = 5
LINK_PERCENT = 80
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
#: Signature agreement under which a pair isn't confirmed: over five standard deviations below the threshold.
LEAST_AGREEMENT = 0.65
#: Groups up to this are compared pair by pair; larger ones by their differences from one member.
BLOCK = 16

_WORD = ~SPACE
U32 = np.uint32


def _first_permutation(x: np.ndarray) -> np.ndarray:
    x = x * U32(0x9E3779B1)
    x ^= x >> U32(15)
    x *= U32(0x85EBCA77)
    x ^= x >> U32(13)
    return x


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Coordinates of each set, a row each; sets without shingles have the largest value throughout."""
    count = len(bounds) - 1
    out = np.full((count, COORDINATES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    scattered = _first_permutation((shingles >> U64(32)).astype(np.uint32))
    begin = bounds[full]
    cut = 0
    while cut < len(full):
        stop = max(cut + 1, int(np.searchsorted(begin, begin[cut] + 32768)))
        a, b = int(begin[cut]), int(bounds[full[stop - 1] + 1])
        block, at = scattered[a:b], begin[cut:stop] - a
        x, y = np.empty_like(block), np.empty_like(block)
        for k in range(COORDINATES):
            np.add(block, U32(k), out=x)  # the circular shift
            np.right_shift(x, U32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, U32(0x7FEB352D), out=x)
            np.right_shift(x, U32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, U32(0x846CA68B), out=x)
            out[full[cut:stop], k] = np.minimum.reduceat(x, at)
        cut = stop
    return out


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their bounds by text."""
    t = Texts(texts, lower=True)
    starts, ends, bounds = t.runs(_WORD)
    h = t.hashes(starts, ends)
    w, first = windows(h, bounds, size)
    own = owners(bounds)[first]
    sizes = np.diff(bounds)
    for k in range(1, size):  # shorter texts are one shingle
        few = np.flatnonzero(sizes == k)
        if len(few):
            whole = np.full(len(few), k, np.uint64)
            for j in range(k):
                whole = mix(whole * MUL_A + h[bounds[few] + j])
            w, own = np.concatenate([w, whole]), np.concatenate([own, few])
    order = np.argsort(w)
    order = order[np.argsort(own[order].astype(np.uint16 if t.count < 65536 else np.int64), kind="stable")]
    w, own = w[order], own[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (own[1:] != own[:-1])
    w, own = w[new], own[new]
    return w, np.searchsorted(own, np.arange(t.count + 1))


def _sums(w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


_SKETCH = T.StructType([T.StructField(n, k) for n, k in (
    ("n_shingles", T.LongType()), ("s1", T.LongType()), ("s2", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("sketch", T.BinaryType()))])


def sketch_texts(texts: pa.Array, size: int = SHINGLE_WORDS) -> pa.Array:
    """Set size, a 128-bit print of the set, a key for each band, and the low bytes of all coordinates."""
    sizes, one, two, keys, low = [], [], [], [], []
    for a, b in chunks_of(texts):
        w, bounds = shingle_sets(texts.slice(a, b - a), size)
        sizes.append(np.diff(bounds))
        one.append(_sums(mix(w), bounds))
        two.append(_sums(mix(w ^ MUL_C), bounds))
        sig = signatures(w, bounds)
        key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], b - a, 0) * MUL_A
        for r in range(ROWS):
            key = mix(key + sig[:, r::ROWS].astype(np.uint64) * MUL_C + U64(r))
        keys.append(key.view(np.int64).ravel())
        low.append((sig & U32(0xFF)).astype(np.uint8))
    if not sizes:
        return pa.array([], pa.struct([("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]))
    n = sum(map(len, sizes))
    bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys)))
    raw = np.concatenate(low).tobytes()
    sketch = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * COORDINATES).tobytes()), pa.py_buffer(raw)])
    return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes)), pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), bands, sketch], names=_SKETCH.names)


def sketches(text: Column | str, size: int = SHINGLE_WORDS) -> Column:
    """The struct of ``sketch_texts`` for a text column."""

    @F.arrow_udf(_SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        return sketch_texts(texts, size)

    return sketch(text)


def set_bytes(text: Column | str, size: int = SHINGLE_WORDS) -> Column:
    """The sorted shingle hashes of a text, eight bytes each."""

    @F.arrow_udf(T.BinaryType())
    def shingles(texts: pa.Array) -> pa.Array:
        return _set_bytes(texts, size)

    return shingles(text)


def _set_bytes(texts: pa.Array, size: int) -> pa.Array:
    out = []
    for a, b in chunks_of(texts):
        w, bounds = shingle_sets(texts.slice(a, b - a), size)
        raw = w.tobytes()
        out += [raw[8 * x : 8 * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BooleanType())
def agree(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two sketches agree often enough for their sets to be worth comparing."""
    x = np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(-1, COORDINATES)
    y = np.frombuffer(b"".join(b.to_pylist()), np.uint8).reshape(-1, COORDINATES)
    return pa.array(agreement((x == y).sum(1)) >= LEAST_AGREEMENT)


def agreement(equal: np.ndarray) -> np.ndarray:
    """Estimated Jaccard from equal low bytes; one in 256 unequal coordinates agrees by chance."""
    return (equal / COORDINATES - 1 / 256) / (1 - 1 / 256)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact rule on two sorted sets."""
    if 100 * min(len(a), len(b)) < LINK_PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LINK_PERCENT * (len(a) + len(b) - both)


@F.arrow_udf(T.BooleanType())
def confirmed(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs], pa.bool_())


_DIFFERENCE = T.StructType([
    T.StructField("size", T.LongType()), T.StructField("of_pivot", T.LongType()), T.StructField("linked", T.BooleanType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
#: Told apart from the shingle itself: that a set lacks it.
_LACKS = U64(0x5851F42D4C957F2D)


@F.arrow_udf(_DIFFERENCE)
def differences(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sizes of two sets, whether they link, and one token for each shingle that the first has and the second lacks, or the other way."""
    sizes, others, links, tokens = [], [], [], []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        more, less = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
        sizes.append(len(x))
        others.append(len(y))
        links.append(linked(x, y))
        tokens.append(np.concatenate([more, mix(less ^ _LACKS)]).view(np.int64))
    at = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
    flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(others, pa.int64()), pa.array(links, pa.bool_()), pa.ListArray.from_arrays(pa.array(at), flat)], names=_DIFFERENCE.names)


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Sketched rows, and one row for each distinct set that isn't empty."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), sketches("text", size).alias("s")).select("doc_id", "th", "s.*")
    rows = written(rows, "dedup-rows")
    full = rows.filter("n_shingles > 0")
    grouped = full.groupBy("n_shingles", "s1", "s2").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "dedup-classes")
    return rows, classes


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, shingles) of the wanted classes, from one row of each; read again rather than kept for all."""
    reps = classes.join(wanted, "cid", "left_semi").select("cid", "rep.doc_id", "rep.th")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    same = texts.join(reps, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
    return written(same.select("cid", set_bytes("text", size).alias("shingles")).groupBy("cid").agg(F.first("shingles").alias("shingles")), "dedup-sets")


def class_links(docs: DataFrame, classes: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(node, label) of the classes that link with others; the tables on the way are removed."""
    with scratch(docs.sparkSession) as keep:
        return keep(_class_links(docs, classes, size))


def _class_links(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    keyed = classes.select("cid", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("cid").alias("leader"), F.max("cid").alias("last"), F.count(F.lit(1)).alias("size"))
    buckets = written(buckets.filter("leader <> last"), "dedup-buckets")
    members = written(keyed.join(buckets.select("key", "leader", "size"), "key"), "dedup-members")

    low = classes.select("cid", "sketch")
    pairs = members.filter("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b")).distinct()
    close = _close(pairs, low)
    sets = _sets(docs, classes, close.select(F.col("a").alias("cid")).union(close.select("b")).distinct(), size)
    labels = written(connected_components(_confirmed(close, sets)), "dedup-components")

    # Buckets whose members, the first aside, are still apart: their other pairs haven't been compared.
    rest = _apart(members.filter("size > 2 AND cid <> leader").select("key", "cid"), labels)
    if not rest.limit(1).count():
        return labels
    sets = _sets(docs, classes, rest.select("cid").distinct(), size)
    few = rest.filter(F.col("n") <= BLOCK)
    one, two = few.select("key", F.col("cid").alias("a"), F.col("label").alias("la")), few.select("key", F.col("cid").alias("b"), F.col("label").alias("lb"))
    pairs = one.join(two, "key").filter("a < b AND la <> lb").select("a", "b")
    many = rest.filter(F.col("n") > BLOCK)
    weight = many.groupBy("cid", "label").agg(F.sum("n").alias("weight"))  # who shares most with others is the likeliest to link with them
    best = weight.groupBy("label").agg(F.max(F.struct("weight", "cid")).alias("best"))
    pivots = many.groupBy("key", "label").agg(F.count(F.lit(1)).alias("votes")).join(best, "label").groupBy("key").agg(F.max(F.struct("votes", "best", "label")).alias("p"))
    around = many.join(pivots.select("key", F.col("p.best.cid").alias("pivot"), F.col("p.label").alias("of_pivot")), "key").filter("cid <> pivot")
    around = written(around.select("pivot", "cid", "label", "of_pivot").distinct(), "dedup-pivots")
    pairs = pairs.union(around.filter("label <> of_pivot").select("cid", "pivot")).distinct()
    labels = _merged(labels, _confirmed(_close(pairs, low), sets))
    found = _confirmed(_close(_candidates(around.select("pivot", "cid"), labels, sets), low), sets)
    return _merged(labels, found)


def _close(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree often enough."""
    both = pairs.join(low.select(F.col("cid").alias("a"), F.col("sketch").alias("one")), "a").join(low.select(F.col("cid").alias("b"), F.col("sketch").alias("two")), "b")
    return written(both.filter(agree("one", "two")).select("a", "b"), "dedup-close")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("two")), "b")
    return written(both.filter(confirmed("one", "two")).select("a", "b"), "dedup-links")


def _labelled(rows: DataFrame, labels: DataFrame, cid: str = "cid") -> DataFrame:
    """Rows with the label of their class; a class without links is its own."""
    return rows.join(labels.withColumnRenamed("node", cid), cid, "left").withColumn("label", F.coalesce("label", cid))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links, which are few: components of labels, not of classes."""
    edges = _labelled(_labelled(links, labels, "a").withColumnRenamed("label", "la"), labels, "b")
    edges = written(edges.select("a", "b", "la", F.col("label").alias("lb")).filter("la <> lb"), "dedup-merges")
    if not edges.limit(1).count():
        return labels
    parts = written(connected_components(edges.select(F.col("la").alias("a"), F.col("lb").alias("b"))), "dedup-components")
    new = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")), F.struct(F.col("b").alias("node"), F.col("lb").alias("label")))).alias("e")).select("e.*")
    all_ = labels.unionByName(new).distinct().join(parts.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return written(all_.select("node", F.coalesce("to", "label").alias("label")), "dedup-labels")


def _apart(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cid, label, n) of the groups (key, cid) with several labels; of equal groups, one."""
    named = written(_labelled(groups, labels), "dedup-named")
    apart = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("print"))
    apart = apart.filter("low <> high").groupBy("n", "print").agg(F.min("key").alias("key"))  # bands often repeat a bucket
    return written(named.join(apart.select("key", "n"), "key").select("key", "cid", "label", "n"), "dedup-apart")


def _candidates(around: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels, of all members (pivot, cid) of a group, that an exact bound doesn't rule out.

    Let X and Y be the differences of the sets x and y from the pivot's set p.
    If x and y link, they differ in at most (|x| + |y|) / 9 shingles, so X and Y
    have at least c = (|X| + |Y| - (|x| + |y|) / 9) / 2 in common, which is over
    0 unless both link with the pivot and so have one label. Then in an order
    that all members share, rare differences first, the first |X| - c + 1 of X
    and |Y| - c + 1 of Y meet. A member that links with the pivot can only meet
    one that doesn't, so its c is at least (|X| + (|p| - |x|) / 9) / 2; for the
    others c is at least |X| - (|x| + |y|) / 9. Differences that only one member
    has meet nothing: they come first and aren't listed. Where a listed
    difference is met, what follows it in both orders must hold c. Members of
    one label whose common differences and sizes are equal have equal overlap
    with all others, so one stands for them.
    """
    named = _labelled(around, labels)
    apart = named.groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("pivot")
    both = named.join(apart, "pivot").join(sets, "cid").join(sets.select(F.col("cid").alias("pivot"), F.col("shingles").alias("of")), "pivot")
    rows = both.select("pivot", "cid", "label", differences.asNondeterministic()("shingles", "of").alias("d")).select("pivot", "cid", "label", "d.*")
    rows = written(rows.withColumn("d", F.size("tokens")), "dedup-differences")
    most = rows.groupBy("pivot").agg(F.max("size").alias("most"))
    tokens = rows.select("pivot", "cid", F.explode("tokens").alias("token"))
    common = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = tokens.join(common, ["pivot", "token"]).groupBy("pivot", "cid").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    full = rows.drop("tokens").join(held, ["pivot", "cid"]).join(most, "pivot")
    one = full.groupBy("pivot", "label", "linked", "size", "of_pivot", "most", "d", "held").agg(F.min("cid").alias("cid")).withColumn("s", F.size("held"))
    reach = F.floor((F.col("size") + F.least(F.floor(F.col("size") * 5 / 4), F.col("most"))) / 9)
    least = 9 * F.col("d") + F.col("of_pivot") - F.col("size")  # 18 times the least c with a member that doesn't link with the pivot
    some = one.filter((18 * F.col("s") >= least) | (~F.col("linked") & (F.col("s") >= F.col("d") - reach)))
    length = F.when(F.col("linked"), F.floor((18 * F.col("d") - least) / 18)).otherwise(reach) + 1 - (F.col("d") - F.col("s"))
    some = some.withColumn("length", F.greatest(length, F.lit(0)).cast("int")).filter("length > 0")
    spots = some.select("pivot", "cid", "label", "linked", "size", "d", "s", F.posexplode(F.slice("held", 1, F.col("length"))).alias("at", "t"))
    spots = written(spots.withColumn("token", F.col("t.token")).drop("t"), "dedup-spots")
    x, y = spots.filter("NOT linked").alias("x"), spots.alias("y")
    col = F.col
    meets = (
        (col("x.pivot") == col("y.pivot")) & (col("x.token") == col("y.token")) & (col("x.label") != col("y.label")) & (col("y.linked") | (col("y.cid") < col("x.cid")))
        & (5 * F.least("x.size", "y.size") >= 4 * F.greatest("x.size", "y.size"))
        & (18 * F.least(col("x.s") - col("x.at"), col("y.s") - col("y.at")) >= 9 * (col("x.d") + col("y.d")) - col("x.size") - col("y.size")))
    return x.join(y, meets).select(col("x.cid").alias("a"), col("y.cid").alias("b")).distinct()


def link_documents(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, label (of the component), component_id, kept for each row of ``docs(doc_id, text)``."""
    bound_batches(docs.sparkSession)
    rows, classes = _classes(docs.select("doc_id", "text"), size)
    labels = class_links(docs.select("doc_id", "text"), classes, size)
    known = classes.select("cid", F.col("n_shingles").alias("n"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), "first_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.withColumn("label", F.coalesce("label", "cid"))
    least = written(known.groupBy("label").agg(F.min("first_id").alias("least_id")), "dedup-least")  # a plain exchange in the join below, which can be split
    known = written(known.join(least, "label").select("n", "p1", "p2", "label", "least_id"), "dedup-known")
    joined = rows.select("doc_id", "th", "n_shingles", "s1", "s2").join(known, (F.col("n_shingles") == F.col("n")) & (F.col("s1") == F.col("p1")) & (F.col("s2") == F.col("p2")), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "th", "n_shingles", "label", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_documents(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component of ``docs``, all columns as they were; of rows that tie, one."""
    found = written(link_documents(docs, size), "dedup-found")
    key, th, component, held, own, alone = unused(docs, "__id", "__th", "__component", "__size", "__hash", "__alone")
    stay = found.filter("kept").select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("label").alias(component), F.col("n_shingles").alias(held))
    ties = stay.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(own, F.xxhash64("text"))
    joined = marked.join(stay.distinct(), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(th)))
    if ties:
        empty = F.when(F.col(held) == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))  # empty sets link with nothing
        joined = joined.withColumn(alone, empty).dropDuplicates([component, alone])
    return joined.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
