"""Queries of the stores, of vectors, of routing and of text scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph as G
from ..operators import routing as R
from ..operators import store as K
from ..operators import text as X
from ..operators import vectors as V
from .registry import query

_TRUST = "CASE provenance WHEN 'human-confirmed' THEN 3 WHEN 'ai-confirmed-by-human' THEN 2 WHEN 'ai-generated' THEN 1 ELSE 0 END"


@query(f"SELECT subject, id, kind, provenance FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {_TRUST} DESC, created_at DESC, id) AS r FROM {{artifacts}}) WHERE r = 1")
def highest_provenance(c):
    return K.highest_provenance(c.artifacts).select("subject", "id", "kind", "provenance")


@query(f"SELECT subject, id, {_TRUST} AS trust, row_number() OVER (PARTITION BY subject ORDER BY {_TRUST} DESC, created_at DESC, id) AS place FROM {{artifacts}}")
def artifacts_by_trust(c):
    return K.artifacts_by_trust(c.artifacts).select("subject", "id", "trust", "place")


@query("SELECT kind, provenance, count(*) AS n, max(CAST(json_extract(content, '$.k') AS INT)) AS most FROM {artifacts} GROUP BY kind, provenance")
def list_artifacts(c):
    return c.artifacts.groupBy("kind", "provenance").agg(F.count(F.lit(1)).alias("n"), F.max(F.get_json_object("content", "$.k").cast("int")).alias("most"))


@query("SELECT subject, id, (value < 20 OR subject = 'fn1') AS needs_review FROM (SELECT a.*, CASE WHEN subject = 'fn1' THEN 1 ELSE 0 END AS x FROM {artifacts} a)")
def flag_stale(c):
    """Review where the current hash isn't the artifact's."""
    table = c.artifacts.withColumn("file_hash", F.when(F.col("value") < 20, "old").otherwise("new"))
    hashes = c.artifacts.select(F.col("subject").alias("file_path")).distinct().filter("file_path <> 'fn1'").withColumn("file_hash", F.lit("new"))
    return K.flag_stale(table, hashes).select("subject", "id", F.coalesce("needs_review", F.lit(True)).alias("needs_review"))


@query("""WITH RECURSIVE f AS (SELECT DISTINCT caller AS name, callee AS into_ FROM {module_edges}), s AS (SELECT DISTINCT caller AS name FROM {module_edges} WHERE caller LIKE 'cust%' UNION SELECT f.into_ FROM s JOIN f USING (name)) SELECT name FROM s""")
def cascade_stale(c):
    """Staleness runs along what feeds what, to the fixpoint."""
    artifacts = G.endpoints(c.module_edges).distinct().select(F.col("symbol").alias("name"), F.col("symbol").startswith("cust").alias("stale"))
    return K.cascade_stale(artifacts, c.module_edges.select(F.col("caller").alias("name"), F.col("callee").alias("into")))


@query("SELECT c_custkey AS id, CASE c_custkey WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE c_nationkey END AS rank FROM {customer}")
def rerank_items(c):
    return K.rerank(c.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("rank")), [3, 1, 2]).select("id", "rank")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'in_progress' WHEN o_orderpriority < '3' THEN 'next_up' ELSE 'backlog' END AS queue FROM {orders}")
def prioritize_work(c):
    items = c.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "in_progress").otherwise("open").alias("status"), F.when(F.col("o_orderpriority") < "3", F.substring("o_orderpriority", 1, 1).cast("int")).alias("rank"))
    return K.work_list(items).select("id", "queue")


@query("SELECT event_type AS bag_id, CASE WHEN user_id % 2 = 0 THEN 'file' ELSE 'symbol' END AS item_type, count(DISTINCT user_id) AS items FROM {events} GROUP BY 1, 2")
def bag_status(c):
    """Keyed inserts, then counts by bag and type."""
    rows = c.events.select(F.col("event_type").alias("bag_id"), F.col("user_id").cast("string").alias("key"), F.when(F.col("user_id") % 2 == 0, "file").otherwise("symbol").alias("item_type"), F.col("props").alias("content"))
    return K.bag_status(K.bag_add(rows.limit(0), rows))


@query("SELECT p_partkey AS subject, p_size <= 25 AS fresh, CASE WHEN p_size <= 25 THEN p_type END AS summary FROM {part}")
def summary_cache(c):
    sources = c.part.select(F.col("p_partkey").alias("subject"), F.lit("part").alias("kind"), F.col("p_name").alias("source_text"))
    cache = c.part.select(F.col("p_partkey").alias("subject"), F.lit("part").alias("kind"), F.sha2(F.when(F.col("p_size") <= 25, F.col("p_name")).otherwise("x"), 256).alias("hash"), F.col("p_type").alias("summary"))
    return K.fresh_summaries(sources, cache).select("subject", "fresh", "summary")


@query("SELECT file_path, name, CASE WHEN id % 7 = 0 THEN 'added' WHEN id % 7 = 1 THEN 'removed' WHEN id % 7 = 2 THEN 'updated' ELSE 'unchanged' END AS change FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY id) AS r FROM {functions}) WHERE r = 1")
def file_delta(c):
    """Old against new: full outer on file and name."""
    f = G.first_per_key(c.functions, ["file_path", "name"], [F.col("id")])
    old = f.filter("id % 7 <> 0").select("file_path", "name", F.col("return_type").alias("signature"))
    new = f.filter("id % 7 <> 1").select("file_path", "name", F.when(F.col("id") % 7 == 2, "changed").otherwise(F.col("return_type")).alias("signature"))
    return K.file_delta(old, new)


@query("SELECT o_orderkey AS file_path FROM {orders} WHERE o_totalprice > 100000 OR o_orderstatus = 'P'")
def changed_files(c):
    disk = c.orders.select(F.col("o_orderkey").alias("file_path"), F.when(F.col("o_totalprice") > 100000, F.expr("o_orderdate + interval 1 day")).otherwise(F.col("o_orderdate")).alias("mtime"))
    files = c.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file_path"), F.col("o_orderdate").alias("ingested_at"))
    return K.changed_files(disk, files)


# Vectors

_U = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM {embeddings}"


@query(f"WITH v AS ({_U}), p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.u, v.u), 6) AS cosine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS r FROM p WHERE cosine >= 0.1) WHERE r <= 5")
def semantic_search(c):
    """Every row whose id is divisible by 100 against all rows."""
    return V.cosine_top_k(c.embeddings, c.embeddings.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 5, 0.1)


@query(f"WITH v AS ({_U.replace('{embeddings}', '{vectors}')}) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 6) AS cosine FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.u, b.u), 6) >= 0.85")
def find_duplicates(c):
    return V.cosine_pairs(c.vectors)


@query(f"WITH v AS ({_U}), m AS (SELECT label, list_transform(range(1, len(any_value(u)) + 1), lambda i: 0) AS z, count(*) AS n FROM v GROUP BY label) SELECT label, n FROM m")
def embedding_index(c):
    """Vectors that can be searched, by label."""
    return V.unit(c.embeddings).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# Routing


_INTENT = """CASE WHEN contains(q, 'what depends') OR contains(q, 'impact') THEN 'impact_query' WHEN contains(q, 'what uses') OR contains(q, 'used by') THEN 'reverse_query' WHEN contains(q, 'what does') OR contains(q, 'surface') THEN 'surface_query'
WHEN regexp_matches(q, 'broken|failing|crashed|erroring|not working') OR (contains(q, 'why') AND regexp_matches(q, 'fail|wrong|error|bug|crash|exception')) THEN 'debug_query' WHEN contains(q, 'mutates') OR (regexp_matches(q, 'modif|changes') AND regexp_matches(q, 'where|what|who')) THEN 'mutation_query'
WHEN regexp_matches(q, 'purpose|why does|why is|role of|what role|what kind of') THEN 'role_query' ELSE 'general_query' END"""


@query(f"SELECT intent, count(*) AS n FROM (SELECT {_INTENT} AS intent FROM (SELECT lower(raw_query) AS q FROM {{questions}} UNION ALL SELECT lower(coalesce(raw_query, '')) FROM {{sessions}})) GROUP BY intent")
def detect_intents(c):
    asked = c.questions.select("raw_query").unionByName(c.sessions.select("raw_query"))
    return asked.select(R.intent_of("raw_query").alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT query_id, intent, CASE intent WHEN 'impact_query' THEN 'impact,context' WHEN 'reverse_query' THEN 'impact' WHEN 'surface_query' THEN 'surface,context' WHEN 'role_query' THEN 'role' WHEN 'debug_query' THEN 'findings,impact,context' WHEN 'mutation_query' THEN 'mutations,impact,context'
ELSE 'context,surface,impact' END AS primitives FROM (SELECT query_id, {_INTENT} AS intent FROM (SELECT query_id, lower(raw_query) AS q FROM {{questions}}))""")
def query_sessions(c):
    """Every question's intent and primitives."""
    return c.questions.withColumn("intent", R.intent_of("raw_query")).select("query_id", "intent", R.primitives_of("intent").alias("primitives"))


QUESTIONS = ((1, "Which function can load an order row?"), (2, "Where do we parse a row"), (3, "who calls get item"), (4, "helper"), (5, "set the item"))
_ASKED = ", ".join(f"({k}, '{q}')" for k, q in QUESTIONS)


@query(f"""WITH q AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(regexp_split_to_array(lower(raw_query), '[^\\p{{L}}\\p{{N}}]+')) AS token FROM (VALUES {_ASKED}) v(query_id, raw_query)) WHERE token <> ''),
n AS (SELECT DISTINCT name AS symbol, lower(t) AS token FROM (SELECT name, unnest(string_split(name, '_')) AS t FROM (SELECT DISTINCT name FROM {{functions}})) WHERE t <> '')
SELECT query_id, symbol, sum(CASE WHEN length(token) >= 4 THEN 2 ELSE 1 END)::BIGINT AS score FROM q JOIN n USING (token) GROUP BY ALL HAVING sum(CASE WHEN length(token) >= 4 THEN 2 ELSE 1 END) >= 2""")
def discover_seeds(c):
    """A few questions against all names."""
    questions = c.spark.createDataFrame(list(QUESTIONS), "query_id int, raw_query string")
    return R.token_seeds(questions, c.functions.select(F.col("name").alias("symbol")).distinct())


@query("""WITH e AS (SELECT DISTINCT caller, callee FROM {fk_edges}), x AS (SELECT 'n3' AS symbol, 0 AS o UNION ALL SELECT callee, 1 FROM e WHERE caller = 'n3' UNION ALL SELECT caller, 2 FROM e WHERE callee = 'n3'), b AS (SELECT symbol, min(o) AS o FROM x GROUP BY symbol),
d AS (SELECT s AS symbol, count(*) AS degree FROM (SELECT caller AS s FROM e UNION ALL SELECT callee FROM e) GROUP BY s)
SELECT symbol, CASE o WHEN 0 THEN 'seed' WHEN 1 THEN 'forward' ELSE 'reverse' END AS reason, degree, round(CASE WHEN symbol = 'n3' THEN 5 ELSE 0 END + CASE WHEN contains(symbol, 'n3') THEN 2 ELSE 0 END + least(0.1::DOUBLE * degree, 3.0), 6)::DOUBLE AS score FROM b JOIN d USING (symbol) ORDER BY score DESC, symbol LIMIT 40""")
def route_query(c):
    return R.route(c.fk_edges, ["n3"], "general_query")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT caller, callee FROM {edges} WHERE caller IS NOT NULL AND callee IS NOT NULL), v AS (SELECT * FROM e WHERE NOT starts_with(caller, '<') AND caller <> '' AND NOT regexp_matches(lower(caller), '(^|[.])(self|cursor|cls|ctx)([.]|$)')),
w AS (SELECT 'helper' AS symbol, 0 AS d UNION SELECT v.caller, d + 1 FROM w JOIN v ON v.callee = w.symbol WHERE d < 2), b AS (SELECT symbol, min(d) AS d FROM w GROUP BY symbol), g AS (SELECT s AS symbol, count(*) AS degree FROM (SELECT caller AS s FROM e UNION ALL SELECT callee FROM e) GROUP BY s)
SELECT symbol, CASE WHEN d = 0 THEN 'seed' ELSE 'reverse' END AS reason, degree, round(CASE WHEN symbol = 'helper' THEN 5 ELSE 0 END + CASE WHEN contains(symbol, 'helper') THEN 2 ELSE 0 END + least(0.1::DOUBLE * degree, 3.0), 6)::DOUBLE AS score FROM b JOIN g USING (symbol) ORDER BY score DESC, symbol LIMIT 40""")
def route_debug_query(c):
    """Two hops back from a name, around noise."""
    return R.route(c.edges, ["helper"], "debug_query")


# Texts


@query("SELECT doc_id, line_number, regexp_extract(line, '(?:^| )(the|und|les|que)(?: |$)', 1) AS marker FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents})) WHERE regexp_extract(line, '(?:^| )(the|und|les|que)(?: |$)', 1) <> ''")
def find_markers(c):
    """Lines with a marker; the words stand for TODO and its like."""
    return X.find_markers(c.documents, r"(?:^| )(the|und|les|que)(?: |$)").select("doc_id", F.col("line_number").cast("long").alias("line_number"), "marker")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href=[\"'']([^\"'']*)[\"'']', 1)) AS href FROM {pages}")
def page_links(c):
    return X.page_links(c.pages)


@query("""WITH l AS (SELECT unnest(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1)) AS href FROM {pages}), u AS (SELECT href, regexp_replace(regexp_replace(regexp_replace(href, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', '') AS p FROM l)
SELECT url, count(*) AS n FROM (SELECT CASE WHEN regexp_replace(p, '<[^>]*>|\\$\\{[^}]*\\}|\\{[^}]*\\}|:[A-Za-z_]\\w*', '*', 'g') = '' THEN '/' ELSE regexp_replace(p, '<[^>]*>|\\$\\{[^}]*\\}|\\{[^}]*\\}|:[A-Za-z_]\\w*', '*', 'g') END AS url FROM u) GROUP BY url""")
def normalized_urls(c):
    return X.page_links(c.pages).select(N.normalize_url("href").alias("url")).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?:[;>]|on\\w+=[\"''])\\s*([A-Za-z_]\\w*)\\(', 1)) AS call FROM {pages}")
def script_calls(c):
    return X.script_calls(c.pages)
