"""Nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

1. Equal vectors are one unit, which keeps its ``k + 1`` smallest ids: no query
   can need more of them. Queries with equal vectors are searched once.
2. Units are scaled by the largest norm and filled up to length 1 by one more
   coordinate, so the largest inner product is the nearest direction. Each of
   ``TABLES`` tables takes floors of Gaussian projections; their number grows
   with the logarithm of the units.
3. A query's neighbours of nearness c have projections around c times its own.
   Buckets are visited in the order of the chance, under this, to hold such a
   neighbour, until ``SUCCESS`` is reached in the table; more are made where
   it isn't. Three c are tried: that of the last neighbour, as a bounded sample
   (``SAMPLE_ROWS``, ``SAMPLE_BYTES``) tells it, that of a near copy, and halfway.
4. Buckets that share their first floors are a cell, where queries meet the
   units of the buckets that they visit. Cells over ``CELL_UNITS`` units or
   ``CELL_QUERIES`` queries are split into a grid.
5. The best of each cell, unless under what the sample (later, the first table
   too) already gives a query, are scored in double precision, component after
   component, and merged. Queries that found fewer than asked for (buckets held
   too few) meet all units, split in the same way.

Vectors that are null or zero or hold a null or non-finite component take no
part, nor do rows without an id. Shorter vectors count as filled up with zeros.
Of rows that repeat an id, that with the smallest vector counts. Ties go to the
smaller id. With fewer candidates than asked for, all come.
An empty table, or one without queries, gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, documents, scratch, written

NEIGHBOURS = 20
EVERY = 20
TABLES = 8
#: Tables visited first; the last of a query's neighbours there bounds what the others give out.
FIRST_TABLES = 1
#: Chance to meet a neighbour that a table's visited buckets must reach: 0.968 over all tables.
SUCCESS = 0.35
#: Width of a floor, where projections have deviation 1.
WIDTH = 2.0
#: Floors of a table for each doubling of the units, and the last ones, which tell buckets of a cell apart.
FLOORS_PER_DOUBLING = 0.64
INNER = 5
NEAR_COPY = 0.95
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 16 << 20
CELL_UNITS, CELL_QUERIES = 8192, 2048
SEED = 12

_SLACK = 1e-9


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` doubles."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(vectors), dim))
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _normal_below(z: np.ndarray) -> np.ndarray:
    """The normal distribution's lower tail, to four digits: it only orders buckets."""
    return 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (z + 0.044715 * z**3)))


class Hashes:
    """The floors of all tables; alike in every task."""

    def __init__(self, dim: int, units: int, largest: float):
        self.dim, self.largest = dim, largest
        self.floors = max(INNER + 1, round(FLOORS_PER_DOUBLING * log2(max(units, 2))))
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((TABLES, dim + 1, self.floors))
        self.shift = rng.random((TABLES, self.floors)) * WIDTH
        self.odd = rng.integers(1 << 62, size=self.floors) | 1

    def projected(self, rows: np.ndarray, last: np.ndarray, table: int) -> np.ndarray:
        return rows @ self.lines[table, :-1] + last[:, None] * self.lines[table, -1]

    def of_units(self, rows: np.ndarray, table: int) -> np.ndarray:
        scaled = rows / self.largest
        last = np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))
        return np.floor((self.projected(scaled, last, table) + self.shift[table]) / WIDTH).astype(np.int64)

    def names(self, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and bucket in the cell; two that share a name are visited together."""
        outer = floors[..., :-INNER]
        cell = (outer * self.odd[: outer.shape[-1]]).sum(-1)
        bucket = ((floors[..., -INNER:] & 15) << (4 * np.arange(INNER))).sum(-1)
        return cell ^ (cell >> 29), bucket

    def visits(self, rows: np.ndarray, nearness: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, floors) of the buckets that unit ``rows`` visit for neighbours of ``nearness``."""
        own = self.projected(rows, np.zeros(len(rows)), table) * nearness[:, None] + self.shift[table]
        spread = np.maximum(np.sqrt(1 - nearness**2), 0.05)[:, None]
        first = np.floor((own - 3.2 * spread) / WIDTH).astype(np.int64)
        slots = ceil(6.4 / WIDTH) + 1
        edges = (first[:, :, None] + np.arange(slots + 1)) * WIDTH
        chance = np.diff(_normal_below((edges - own[:, :, None]) / spread[:, :, None]), axis=2)
        left, width, found = np.arange(len(rows)), 128, []
        while len(left):
            best, picked = np.ones((len(left), 1)), np.zeros((len(left), 1, 0), np.int64)
            for j in range(self.floors):  # prefixes that aren't among the best can't lead to the best
                wider = (best[:, :, None] * chance[left, j, None, :]).reshape(len(left), -1)
                top = np.argpartition(-wider, width - 1, 1)[:, :width] if wider.shape[1] > width else np.broadcast_to(np.arange(wider.shape[1]), wider.shape)
                best = np.take_along_axis(wider, top, 1)
                picked = np.concatenate([np.take_along_axis(picked, (top // slots)[:, :, None], 1), (top % slots + first[left, j, None])[:, :, None]], 2)
            order = np.argsort(-best, 1, kind="stable")
            reached = np.take_along_axis(best, order, 1).cumsum(1)
            enough = (reached[:, -1] >= SUCCESS) | (width >= slots**self.floors)
            visit = (reached - np.take_along_axis(best, order, 1) < SUCCESS) & enough[:, None]
            at, place = np.nonzero(visit)
            found.append((left[at], picked[at, order[at, place]]))
            left, width = left[~enough], width * 4
        return np.concatenate([r for r, _ in found]), np.concatenate([b for _, b in found])


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), h1 and h2: the rows that take part, one for each id."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter("vec_id IS NOT NULL")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(finite & F.exists("embedding", lambda v: v != 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})


def distinct(rows: DataFrame, asked: Column, k: int) -> DataFrame:
    """uid, embedding, ids (the k + 1 smallest) and asked (whether a query has it) of each distinct vector."""
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    held = few.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    queried = rows.filter(asked).select("h1", "h2", F.lit(True).alias("asked")).distinct()
    return held.join(queried, ["h1", "h2"], "left").withColumn("uid", F.monotonically_increasing_id())


def indexed(units: DataFrame, hashes: Hashes, tables: range) -> DataFrame:
    """t, cell, bucket, uid, embedding and ids of each unit in each of ``tables``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(1), hashes.dim)
            for table in tables:
                cell, bucket = hashes.names(hashes.of_units(rows, table))
                columns = [pa.array(np.full(len(rows), table, np.int32)), pa.array(cell), pa.array(bucket.astype(np.int32)), *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "cell", "bucket", "uid", "embedding", "ids"])

    return units.select("uid", "embedding", "ids").mapInArrow(index, "t int, cell long, bucket int, uid long, embedding array<double>, ids array<long>")


def probes(units: DataFrame, hashes: Hashes, sample: tuple[np.ndarray, np.ndarray], n_units: int, k: int) -> DataFrame:
    """q, t, cell, the buckets to visit there, the query's vector and the least score that can matter."""
    sent = units.sparkSession.sparkContext.broadcast(sample)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = sent.value
        last = min(len(held), ceil((k + 1) * len(held) / n_units))
        for batch in batches:
            for x in range(0, batch.num_rows, 64):
                some = batch.slice(x, 64)
                uid, rows = some.column(0).to_numpy(), matrix(some.column(1), hashes.dim)
                scores = rows @ held.T
                floor = np.full(len(rows), -np.inf)
                if len(held) > k:
                    floor = np.partition(scores, -(k + 1), 1)[:, -(k + 1)]
                    floor -= _SLACK * np.maximum(np.abs(floor), 1)
                norm = np.linalg.norm(rows, axis=1)
                near = np.where(uid[:, None] == held_ids, -np.inf, scores / (norm[:, None] * hashes.largest))
                least = np.clip(np.partition(near, -last, 1)[:, -last], -NEAR_COPY, NEAR_COPY)
                for table in range(TABLES):
                    found = [hashes.visits(rows / norm[:, None], c, table) for c in (least, (least + NEAR_COPY) / 2, np.full(len(rows), NEAR_COPY))]
                    owner = np.concatenate([r for r, _ in found])
                    cell, bucket = hashes.names(np.concatenate([b for _, b in found]))
                    order = np.lexsort((bucket, cell, owner))
                    owner, cell, bucket = owner[order], cell[order], bucket[order]
                    new = np.append(True, (np.diff(owner) != 0) | (np.diff(cell) != 0) | (np.diff(bucket) != 0))
                    owner, cell, bucket = owner[new], cell[new], bucket[new]
                    starts = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(cell) != 0)))
                    own = owner[starts]
                    buckets = pa.ListArray.from_arrays(pa.array(np.append(starts, len(owner)).astype(np.int32)), pa.array(bucket.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(uid[own]), pa.array(np.full(len(own), table, np.int32)), pa.array(cell[starts]), buckets, _lists(rows[own]), pa.array(floor[own])], names=["q", "t", "cell", "buckets", "vector", "floor"])

    return units.filter("asked").select("uid", "embedding").mapInArrow(probe, "q long, t int, cell long, buckets array<int>, vector array<double>, floor double")


def met(asked: DataFrame, units: DataFrame, dim: int, k: int) -> DataFrame:
    """q, uid, score and ids: the best of each cell for each query that visits it."""
    cell = ["t", "cell"]
    grid = asked.groupBy(cell).agg(F.count(F.lit(1)).alias("queries")).join(units.groupBy(cell).agg(F.count(F.lit(1)).alias("units")), cell)
    grid = written(grid.select(*cell, F.ceil(F.col("queries") / CELL_QUERIES).cast("int").alias("across"), F.ceil(F.col("units") / CELL_UNITS).cast("int").alias("down")), "grid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    key = [*cell, "i", "j"]
    left = asked.join(grid, cell).withColumn("i", piece("q", "across")).withColumn("j", every("down")).drop("across", "down")
    right = units.join(grid, cell).withColumn("j", piece("uid", "down")).withColumn("i", every("across")).drop("across", "down")

    def rank(queries: pa.Table, held: pa.Table) -> pa.Table:
        nothing = pa.table({"q": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        if not queries.num_rows or not held.num_rows:
            return nothing
        queries, held = queries.combine_chunks(), held.combine_chunks()
        one = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        rows, sought = matrix(one(held, "embedding"), dim), matrix(one(queries, "vector"), dim)
        names, which = np.unique(one(held, "bucket").to_numpy(), return_inverse=True)
        lists, floor = one(queries, "buckets"), one(queries, "floor").to_numpy()
        wanted, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        hit = names[place] == wanted
        at, to, score = [], [], []
        for x in range(0, len(sought), 256):
            block = sought[x : x + 256]
            mine = hit & (of >= x) & (of < x + len(block))
            visited = np.zeros((len(block), len(names)), bool)
            visited[of[mine] - x, place[mine]] = True
            rough = np.where(visited[:, which], block @ rows.T, -np.inf)
            least = floor[x : x + 256]
            if len(rows) > k + 1:
                top = np.partition(rough, -(k + 1), 1)[:, -(k + 1)]
                least = np.maximum(least, top - _SLACK * np.maximum(np.abs(top), 1))
            i, j = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
            exact = np.zeros(len(i))
            for d in range(dim):
                exact += block[i, d] * rows[j, d]
            at.append(i + x)
            to.append(j)
            score.append(exact)
        at, to, score = np.concatenate(at), np.concatenate(to), np.concatenate(score)
        return pa.table({"q": one(queries, "q").take(pa.array(at)), "uid": one(held, "uid").take(pa.array(to)), "score": pa.array(score), "ids": one(held, "ids").take(pa.array(to))})

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(rank, "q long, uid long, score double, ids array<long>")


def merged(found: DataFrame, k: int) -> DataFrame:
    """q and top: the k + 1 best (far, id) among what cells gave, the query's own row included."""
    pairs = found.groupBy("q", "uid").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    top = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    listed = top.select("q", F.explode("ids").alias("id"), (-F.col("score")).alias("far"))
    first = listed.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))).filter(F.col("place") <= k + 1)
    return first.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("far", "id"))).alias("top"))


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: of ``vectors(vec_id, embedding)``, the nearest found of each id divisible by ``every``."""
    spark = vectors.sparkSession
    bound_batches(spark)
    asked = F.col("vec_id") % every == 0
    with scratch(spark) as keep:
        rows = written(clean(vectors), "vectors")
        units = written(distinct(rows, asked, k), "units")
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
        n_units, dim, largest = units.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(norm)).first()
        if not n_units:
            none = "query_id long, rank int, vec_id long, score double"
            return spark.createDataFrame([], none)
        size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        drawn = units.orderBy(F.xxhash64("embedding", F.lit(SEED)), "uid").limit(size).select("uid", "embedding").toArrow()
        sample = (drawn.column(0).to_numpy(), matrix(drawn.column(1).combine_chunks(), dim))
        hashes = Hashes(dim, n_units, largest)
        visits = written(probes(units, hashes, sample, n_units, k), "probes")
        found = written(met(visits.filter(F.col("t") < FIRST_TABLES), indexed(units, hashes, range(FIRST_TABLES)), dim, k), "first-found")
        last = merged(found, k).filter(F.size("top") == k + 1).select("q", (-F.col("top")[k]["far"]).alias("last"))
        known = F.col("last") - _SLACK * F.greatest(F.abs("last"), F.lit(1.0))
        raised = visits.filter(F.col("t") >= FIRST_TABLES).join(written(last, "last"), "q", "left").withColumn("floor", F.greatest("floor", known)).drop("last")
        further = written(met(raised, indexed(units, hashes, range(FIRST_TABLES, TABLES)), dim, k), "found")
        lists = written(merged(found.unionByName(further), k), "lists")
        whole = min(k + 1, rows.count())
        short = written(units.filter("asked").join(lists.filter(F.size("top") >= whole), F.col("uid") == F.col("q"), "left_anti"), "short")
        if not short.isEmpty():
            one_cell = [F.lit(0).alias("t"), F.lit(0).cast("long").alias("cell")]
            asking = short.select(F.col("uid").alias("q"), *one_cell, F.array(F.lit(0)).alias("buckets"), F.col("embedding").alias("vector"), F.lit(float("-inf")).alias("floor"))
            rest = merged(met(asking, units.select(*one_cell, F.lit(0).alias("bucket"), "uid", "embedding", "ids"), dim, k), k)
            lists = written(lists.filter(F.size("top") >= whole).unionByName(rest), "whole-lists")
        named = units.join(lists, F.col("uid") == F.col("q")).select("h1", "h2", "top")
        own = rows.filter(asked).select("vec_id", "h1", "h2").join(named, ["h1", "h2"])
        others = F.slice(F.filter("top", lambda x: x["id"] != F.col("vec_id")), 1, k)
        out = own.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "one"))
        out = out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.id").alias("vec_id"), (-F.col("one.far")).alias("score"))
        return keep(written(out, "neighbours"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"))
