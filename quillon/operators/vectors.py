"""Cosine search and near-duplicates on array columns, with built-in functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(df: DataFrame, column: str = "embedding", name: str = "unit") -> DataFrame:
    """Vectors of length 1; null, empty and zero vectors are left out."""
    n = norm(F.col(column))
    return df.filter(n > 0).withColumn(name, F.transform(column, lambda x: x.cast("double") / n))


#: Rows of one side of a product, and how far a product may be from a cosine rounded to six places: half of the last place, twice for two of them, and as much for rounding errors.
QUERY_BLOCK, VECTOR_BLOCK, SLACK = 2048, 16384, 2e-6


def _rows(table: pa.Table, column: str, size: int) -> np.ndarray:
    out = np.zeros((table.num_rows, size))
    for k, r in enumerate(table.column(column).to_pylist()):
        out[k, : len(r)] = [0.0 if x is None else x for x in r]
    return out


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = -1.0, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, cosine): the k nearest of ``vectors(vec_id, embedding)`` for each of ``queries(query_id, embedding)``.

    The queries are a stated set and all of them meet all vectors: blocks of
    both are dealt by pair and a task multiplies two of them at a time. A pair
    of blocks gives out, for a query, what may be among its best k, which is
    a little more than k rows; the cosines of the best of all are then taken
    from the vectors themselves.
    """
    from pyspark.sql import Window

    q = written(unit(queries.select("query_id", "embedding").filter("query_id IS NOT NULL"), name="q").select("query_id", "q"), "query-units")
    v = written(unit(vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL")).select("vec_id", "unit"), "vector-units")
    nq, nv = (max(1, -(-df.count() // n)) for df, n in ((q, block), (v, VECTOR_BLOCK)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.select("query_id", "q", part("query_id", nq).alias("i"), each(nv).alias("j"))
    held = v.select("vec_id", "unit", each(nq).alias("i"), part("vec_id", nv).alias("j"))
    kinds = ((q, "query_id"), (v, "vec_id"))
    schema = T.StructType([df.schema[c] for df, c in kinds] + [T.StructField("near", T.DoubleType())])

    def best_of(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = left.column("query_id"), right.column("vec_id")
        rows, columns, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            size = max(len(r) for t, c in ((left, "q"), (right, "unit")) for r in t.column(c).to_pylist())
            a, b = _rows(left, "q", size), _rows(right, "unit", size).T
            places: dict = {}
            for c, name in enumerate(names.to_pylist()):
                places.setdefault(name, []).append(c)
            asked_ids = ids.to_pylist()
            for x in range(0, len(a), 128):
                products = a[x : x + 128] @ b
                products[np.isnan(products)] = np.inf  # not a number is more than any number, as in the order of rows
                for r, name in enumerate(asked_ids[x : x + 128]):
                    products[r, places.get(name, [])] = -np.inf
                bar = np.partition(products, -k, axis=1)[:, -k] if products.shape[1] > k else np.full(len(products), -np.inf)
                r, c = np.nonzero(products >= np.maximum(bar, least)[:, None] - SLACK)
                real = products[r, c] > -np.inf
                rows.append(r[real] + x)
                columns.append(c[real])
                near.append(products[r, c][real])
        taken = ids.take(pa.array(np.concatenate(rows))), names.take(pa.array(np.concatenate(columns)))
        return pa.table({"query_id": taken[0], "vec_id": taken[1], "near": np.concatenate(near)})

    near = asked.groupBy("i", "j").cogroup(held.groupBy("i", "j")).applyInArrow(best_of, schema)
    of_query = Window.partitionBy("query_id")
    near = near.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("near"))))
    near = near.withColumn("bar", F.min(F.when(F.col("place") <= k, F.col("near"))).over(of_query)).filter(F.col("near") >= F.col("bar") - SLACK).select("query_id", "vec_id")
    found = near.distinct().join(q, "query_id").join(v, "vec_id").select("query_id", "vec_id", F.round(dot(F.col("unit"), F.col("q")), 6).alias("cosine")).filter((F.col("cosine") >= least) & (F.col("query_id") != F.col("vec_id")))
    return found.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("cosine"), "vec_id"))).filter(F.col("place") <= k).select("query_id", "vec_id", "cosine")


def _floats(column: pa.ChunkedArray, size: int) -> np.ndarray:
    lists = column.combine_chunks()
    lengths, values = lists.value_lengths().to_numpy(), lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size), np.float32)
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def near_pairs(units: DataFrame, threshold: float, block: int = VECTOR_BLOCK) -> DataFrame:
    """(a, b), a < b, of ``units(rep, unit)`` whose product may reach ``threshold``: none that does is missing, and those that fall short do so by a rounding error.

    All vectors meet: blocks are dealt by pair and a task multiplies two of
    them in single precision, a strip at a time. A vector is copied once for
    each block.
    """
    k = max(1, -(-units.count() // block))
    small = units.filter("rep IS NOT NULL").select("rep", F.col("unit").cast("array<float>").alias("v"), F.pmod(F.xxhash64("rep"), F.lit(k)).cast("int").alias("part"))
    left = small.select(F.col("rep").alias("a"), "v", F.col("part").alias("i"), F.explode(F.sequence("part", F.lit(k - 1))).alias("j"))
    right = small.select(F.col("rep").alias("b"), "v", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    kind = units.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("own", T.BooleanType())])

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own = False
        if one.num_rows and two.num_rows:
            own = one.column("i")[0].as_py() == one.column("j")[0].as_py()
            size = max(int(t.column("v").combine_chunks().value_lengths().to_numpy().max()) for t in (one, two))
            x, y = _floats(one.column("v"), size), _floats(two.column("v"), size).T
            bar = np.float32(threshold - (size + 4) * 1.2e-7 - SLACK)
            for at in range(0, len(x), 256):
                r, c = np.nonzero(~(x[at : at + 256] @ y < bar))  # not a number is more than any number, as in the order of rows
                rows.append(r + at)
                columns.append(c)
        r, c = np.concatenate(rows), np.concatenate(columns)
        return pa.table({"a": one.column("a").take(pa.array(r)), "b": two.column("b").take(pa.array(c)), "own": np.full(len(r), own)})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, schema)
    return found.filter("NOT own OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def cosine_pairs(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, cosine) of all pairs of ``vectors(vec_id, embedding)`` with cosine at least ``threshold``.

    Equal vectors are one until the end, when their pairs are put in.
    """
    v = written(unit(vectors.select("vec_id", "embedding")).select("vec_id", "unit", F.xxhash64("unit").alias("h")), "unit-vectors")
    groups = written(v.groupBy("h", "unit").agg(F.min("vec_id").alias("rep")), "vector-groups")
    near = written(near_pairs(groups.select("rep", "unit"), threshold), "near-pairs")
    both = near.join(groups.select(F.col("rep").alias("a"), F.col("unit").alias("ua")), "a").join(groups.select(F.col("rep").alias("b"), F.col("unit").alias("ub")), "b")
    found = both.select("a", "b", F.round(dot(F.col("ua"), F.col("ub")), 6).alias("cosine")).filter(F.col("cosine") >= threshold)
    own = groups.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.round(dot(F.col("unit"), F.col("unit")), 6).alias("cosine")).filter(F.col("cosine") >= threshold)
    members = v.join(groups, ["h", "unit"]).select("rep", "vec_id")
    all_ = found.unionByName(own).join(members.select(F.col("rep").alias("a"), F.col("vec_id").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("vec_id").alias("y")), "b")
    return all_.filter("a <> b OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def best_cached(prompts: DataFrame, cache: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(query_id, vec_id, cosine): the best cached answer of each prompt, where it is near enough."""
    return cosine_top_k(cache, prompts, 1, threshold)
