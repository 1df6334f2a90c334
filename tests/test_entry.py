"""The driver's contract: names, schemas and SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__
from quillon.operators import stubs

SF = "/root/testdata/sf0.001"
SHOWN = ("structure_hotspots", "module_stats", "frontier_rows", "contract_health", "algebra_combined", "semantic_search")

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_every_sql_has_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 140


def test_views_are_named_in_sql():
    assert all(re.search(r"\bselect\b", s, re.I) for s in __spark_entry__.oracle_sql().values())


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", SHOWN)
def test_rows_equal_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())


@needs_tables
@pytest.mark.parametrize("name", ("stub_gap_survey", "work_session_primer"))
def test_surveys_of_stubs_read_calls_once(spark, name):
    """Calls are a table that was written, not joined from lines again, and the rows equal the SQL."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
    test_rows_equal_sql(spark, name)


@pytest.mark.parametrize("at_once", (stubs.PAIRS_A_TASK, 50_000))
def test_pairs_of_siblings_are_dealt_and_take_few_bytes(spark, tmp_path, monkeypatch, at_once):
    """Two files of hundreds of functions, whole or in slices: the rows equal the SQL, tasks follow the pairs, and a pair takes under a quarter of a byte."""
    monkeypatch.setattr(stubs, "PAIRS_A_TASK", at_once)
    keys = [*range(0, 255 * 1500, 255), *range(1, 255 * 40, 255)]
    parts = spark.createDataFrame([(k, f"n{k}", "b", "t", k % 47 + 1) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(re.sub(r"edges AS \(.*?\) e\),", "edges AS (SELECT NULL::VARCHAR AS caller, NULL::VARCHAR AS callee WHERE false),", __spark_entry__.oracle_sql()["stub_siblings"], flags=re.S)).fetchall()
    __spark_entry__.queries()["stub_siblings"](spark, str(tmp_path)).write.parquet(out := str(tmp_path / "out"))
    got = [tuple(r) for r in spark.read.parquet(out).select("name", "sibling").collect()]
    assert sorted(got) == sorted(want) and len(got) > 250_000
    files = [f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")]
    assert sum(files) < len(got) / 4 and (at_once > len(got) or sum(x > 5_000 for x in files) >= 4)
