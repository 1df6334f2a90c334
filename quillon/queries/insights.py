"""Queries of signals, drift, contracts, coverage and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insight as I
from ..operators import store as K
from .graphs import BUILTIN_LIST
from .registry import query
from .unfinished import _JUDGED, _NAMED, _WORDS, _conventions, with_, with_all


@query("SELECT source_id AS symbol, 'in' AS direction, target_id AS other FROM {edges} WHERE edge_type = 'data_flow' UNION ALL SELECT target_id, 'out', source_id FROM {edges} WHERE edge_type = 'data_flow'")
def data_flow_edges(c):
    return I.data_flow(c.edges)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT caller, callee FROM {fk_edges}), w AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT e.callee, depth + 1 FROM w JOIN e ON e.caller = w.node WHERE depth < 10)
SELECT node, min(depth) AS depth, (SELECT count(*) FROM e WHERE e.caller = w.node) AS fanout FROM w GROUP BY node""")
def explore_call_routes(c):
    return I.call_routes(c.fk_edges, "n3")


@query("""WITH n AS (SELECT DISTINCT name FROM {functions} WHERE is_stub) SELECT name, EXISTS (SELECT 1 FROM {notes} WHERE kind = 'dead' AND ends_with(lower(subject), lower(name))) AS dead, (SELECT count(*) FROM {notes} WHERE kind = 'inline_note' AND subject = name) AS inline_notes,
EXISTS (SELECT 1 FROM {notes} WHERE kind = 'design_note' AND contains(lower(content), lower(name))) AS design_note FROM n""")
def artifact_signals(c):
    return I.artifact_signals(c.functions.filter("is_stub"), c.notes)


@query(f"SELECT DISTINCT name, file_path, type, type IN (SELECT name FROM {{classes}}) AS known FROM (SELECT name, file_path, {_NAMED} AS type FROM {{functions}} WHERE is_stub) WHERE type IS NOT NULL")
def return_type_signals(c):
    return I.return_type_signals(c.functions, c.classes)


_NOISE = "('get', 'set', 'add', 'run', 'load', 'save', 'init', 'main', 'make', 'build', 'find', 'show', 'list', 'move', 'type', 'from', 'with', 'self', 'data', 'info', 'none')"


@query(f"""WITH s AS (SELECT name, file_path, max(coalesce(docstring, '')) AS doc FROM {{functions}} WHERE is_stub GROUP BY 1, 2),
w AS (SELECT name, file_path, list_concat(list_transform(regexp_extract_all(doc, '\\b[A-Za-z]\\w\\w\\w\\w+\\b'), lambda t: lower(t)), list_filter(regexp_split_to_array(lower(name), '[_\\s]+'), lambda t: length(t) >= 5)) AS a FROM s),
f AS (SELECT name, file_path, list_filter(a, lambda t: t NOT IN {_NOISE}) AS a FROM w), d AS (SELECT name, file_path, list_filter(a, lambda t, i: list_position(a, t) = i)[1:8] AS a FROM f), u AS (SELECT name, file_path, unnest(a) AS t FROM d), m AS (SELECT DISTINCT lower(module) AS m FROM {{imports}})
SELECT name, file_path, count(*) AS tokens, count(*) FILTER (NOT EXISTS (SELECT 1 FROM m WHERE contains(m.m, u.t))) AS unmatched FROM u GROUP BY 1, 2""")
def import_signals(c):
    return I.import_signals(c.functions, c.imports)


@query(with_all(""", nt AS (SELECT DISTINCT lower(subject) AS s FROM {notes} WHERE kind = 'design_note'), nd AS (SELECT DISTINCT name FROM {functions} f WHERE EXISTS (SELECT 1 FROM nt WHERE contains(s, lower(f.name)))),
t AS (SELECT DISTINCT name, file_path, docstring, CASE WHEN http_route <> '' OR is_tool THEN 'explicit' WHEN (starts_with(name, '__') AND ends_with(name, '__')) OR starts_with(name, 'from_') OR starts_with(name, 'to_') OR name IN ('serialize', 'deserialize', 'encode', 'decode') OR regexp_matches(file_path, '[.](json|yaml|toml)$') THEN 'protocol' WHEN starts_with(name, 'test_') OR contains(file_path, '/test') THEN 'test' ELSE 'inferred' END AS tier FROM {functions} WHERE NOT is_stub)
SELECT file_path, name, tier || '_entry_point' AS gap FROM t WHERE tier IN ('explicit', 'inferred') AND name NOT IN (SELECT name FROM k) AND name NOT IN (SELECT name FROM nd) UNION SELECT file_path, name, 'stale_docstring' FROM t WHERE regexp_matches(lower(coalesce(docstring, '')), 'todo|stub|placeholder|not implemented')
UNION SELECT file_path, name, 'stub_without_note' FROM {functions} WHERE is_stub AND name NOT IN (SELECT name FROM nd)""").replace(") ,", "),"))
def detect_doc_drift(c):
    return I.doc_drift(c.all_functions, c.edges, c.notes)


@query(with_(f""", uc AS (SELECT caller AS name, count(*) FILTER (NOT callee_stub) AS l, count(*) FILTER (callee_stub) AS s FROM c GROUP BY 1), ms AS (SELECT caller AS name, count(DISTINCT callee) AS n FROM {{edges}} WHERE NOT contains(callee, '.') AND callee NOT IN ({BUILTIN_LIST}) AND callee NOT IN (SELECT name FROM fn) GROUP BY 1)
SELECT fn.name, coalesce(callers, 0) AS callers, coalesce(l, 0) AS live_callees, coalesce(s, 0) AS stub_callees, coalesce(ms.n, 0) AS missing_callees FROM fn LEFT JOIN cnt USING (name) LEFT JOIN uc USING (name) LEFT JOIN ms USING (name) WHERE is_stub""").replace(") ,", "),"))
def completion_contracts(c):
    return I.completion_contracts(c.functions, c.edges)


@query(with_(""", im AS (SELECT DISTINCT file_path, lower(module) AS m FROM {imports}), st AS (SELECT DISTINCT lower(regexp_replace(string_split(file_path, '/')[-1], '[.]py', '')) AS p FROM fn), ic AS (SELECT p, count(DISTINCT file_path) AS n FROM st JOIN im ON contains(m, p) GROUP BY 1)
SELECT fn.name, is_stub, (SELECT count(DISTINCT callee) FROM {edges} WHERE caller = fn.name) AS callees, coalesce(n, 0) AS importing_files FROM fn LEFT JOIN ic ON p = lower(regexp_replace(string_split(file_path, '/')[-1], '[.]py', ''))""").replace(") ,", "),"))
def symbol_findings(c):
    return I.symbol_findings(c.functions, c.edges, c.imports)


@query("""WITH f AS (SELECT DISTINCT string_split(file_path, '/')[-1] AS s FROM {functions}), y AS (SELECT name AS s FROM {functions} UNION SELECT name FROM {classes}) SELECT 'files' AS what, count(*) AS total, count(*) FILTER (s IN (SELECT subject FROM {notes} WHERE kind = 'file_purpose')) AS known FROM f
UNION ALL SELECT 'symbols', count(*), count(*) FILTER (s IN (SELECT subject FROM {notes} WHERE kind IN ('design_note', 'strategy_decision', 'query_finding', 'known_issue'))) FROM y UNION ALL SELECT 'chains', count(DISTINCT subject), count(DISTINCT subject) FROM {notes} WHERE kind = 'strategy_decision' AND starts_with(subject, 'chain::')""")
def coverage_report(c):
    return I.coverage(c.functions.select("file_path"), c.functions, c.classes, c.notes)


@query("SELECT 'kind:' || kind AS what, count(*) AS n FROM {notes} GROUP BY kind UNION ALL SELECT string_split(subject, '::')[1] || '::', count(*) FROM {notes} WHERE contains(subject, '::') GROUP BY 1 UNION ALL SELECT 'artifacts', count(*) FROM {notes} UNION ALL SELECT 'needs_review', count(*) FILTER (needs_review) FROM {notes}")
def knowledge_status(c):
    return I.knowledge_status(c.notes)


_END = "'^(.+)(FSM|Manager|Engine|System|Controller|Service|Handler|Registry|Store|State|Model)$', '\\1'"


@query(with_(f""", gw AS (SELECT DISTINCT unnest({_WORDS}) AS concept FROM {{functions}} WHERE is_stub AND docstring IS NOT NULL), gt AS (SELECT DISTINCT unnest(string_split(name, '_')) AS t FROM {{functions}}),
gp2 AS (SELECT DISTINCT concept FROM (SELECT concept, unnest(string_split(lower(regexp_replace(regexp_replace(concept, {_END}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_')) AS t FROM gw) WHERE t <> '' AND t IN (SELECT t FROM gt))
SELECT 'stubs' AS fact, count(*) AS n FROM {{functions}} WHERE is_stub UNION ALL SELECT 'subsystems', count(DISTINCT array_to_string(string_split(file_path, '/')[1:len(string_split(file_path, '/')) - 1], '/')) FROM {{functions}} WHERE is_stub UNION ALL SELECT 'actionable', count(DISTINCT name) FROM c WHERE callee_stub AND NOT caller_stub
UNION ALL SELECT 'ghosts', count(*) FROM gw WHERE regexp_replace(concept, {_END}) NOT IN (SELECT regexp_replace(name, {_END}) FROM {{classes}}) AND concept NOT IN (SELECT concept FROM gp2)""").replace(") ,", "),"))
def stub_corpus_verdict(c):
    return I.corpus_verdict(c.functions, c.edges, c.classes)


@query(with_all(f""", {_JUDGED}, {_conventions('', '1.00')}, od AS (SELECT DISTINCT name FROM cm WHERE is_stub AND diverges <> ''), bd2 AS (SELECT name, file_path, min(body_shape) AS body, len({_WORDS.replace('docstring', "max(trim(coalesce(docstring, '')))")}) AS nc FROM {{functions}} WHERE is_stub GROUP BY 1, 2),
py AS (SELECT CASE reading WHEN 'design-intent-stated' THEN 'DESIGN-INTENT' WHEN 'blocked-on-prerequisite' THEN 'BLOCKED' ELSE 'UNCERTAIN' END AS badge, jd.name, callers, round_even((callers * score + CASE position WHEN 'tail' THEN 5 WHEN 'middle' THEN 2 ELSE 0 END + CASE WHEN jd.name IN (SELECT name FROM od) THEN 3 ELSE 0 END)::DOUBLE, 1) AS composite, 0 AS handlers, 1 AS rank
 FROM jd JOIN bd2 USING (name, file_path) LEFT JOIN pos ON pos.name = jd.name WHERE NOT regexp_matches(lower(jd.file_path), 'test.|.test') AND NOT contains(jd.name, '::action::') AND NOT contains(jd.name, '::guard::') AND reading <> 'concept-not-applicable' AND NOT (coalesce(body, '') = 'empty_pass' AND nc = 0 AND callers <= 1)),
ms AS (SELECT 'FSM-SPEC' AS badge, string_split(name, '::')[1] AS name, 0 AS callers, 0.0::DOUBLE AS composite, count(*) AS handlers, 0 AS rank FROM {{functions}} WHERE is_stub AND NOT regexp_matches(lower(file_path), 'test.|.test') AND (contains(name, '::action::') OR contains(name, '::guard::')) GROUP BY 2)
SELECT badge, name, callers, composite, handlers FROM (SELECT * FROM ms UNION ALL SELECT * FROM py) ORDER BY rank, handlers DESC, composite DESC, name, badge LIMIT 5""").replace(") ,", "),"))
def work_session_primer(c):
    return I.work_primer(c.all_functions, c.edges, c.classes, c.fsm_artifacts)


_FILE = "pkg1/sub1/mod4.py"


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, {name} AS name, line_number FROM {{{view}}} WHERE file_path = '{_FILE}'" for kind, name, view in (("function", "name", "functions"), ("class", "name", "classes"), ("import", "module", "imports"), ("reference", "callee", "refs"), ("mutation", "operation", "mutations"))))
def context_bundle(c):
    """Everything recorded for one file."""
    return I.context_bundle(_FILE, c.functions, c.classes, c.imports, c.refs, c.mutations)


@query("SELECT file_path, count(*) AS functions FROM {functions} WHERE starts_with(file_path, 'pkg1/') GROUP BY 1")
def files_in_directory(c):
    return c.functions.filter(F.col("file_path").startswith("pkg1/")).groupBy("file_path").agg(F.count(F.lit(1)).alias("functions"))


@query("""WITH i AS (SELECT p_partkey AS id, p_name AS title, 'open' AS status, p_size AS rank FROM {part}), a AS (SELECT * FROM i UNION ALL SELECT (SELECT max(id) FROM i) + row_number() OVER (ORDER BY title), title, 'open', 99 FROM (VALUES ('b new'), ('a new')) v(title))
SELECT id, title, CASE WHEN id % 3 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 1 ELSE rank END AS rank FROM a WHERE id % 7 <> 0 OR rank = 99""")
def work_items(c):
    """Items added, changed and removed."""
    items = c.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("open").alias("status"), F.col("p_size").alias("rank"))
    more = K.add_items(items, c.spark.createDataFrame([("b new", "open", 99), ("a new", "open", 99)], "title string, status string, rank int"))
    changes = more.filter("id % 3 = 0").select("id", F.lit("done").alias("status"), F.when(F.col("id") % 2 == 0, 1).alias("rank"))
    return K.delete_rows(K.update_items(more, changes), items.filter("id % 7 = 0").select("id"))


@query("""WITH n AS (SELECT id, subject, kind, content FROM {notes}) SELECT id, subject, kind, content FROM n WHERE (subject, kind) NOT IN (SELECT (subject, kind) FROM n WHERE id % 4 = 0) UNION ALL SELECT id, subject, kind, upper(content) FROM n WHERE id % 4 = 0""")
def store_artifacts(c):
    """New artifacts in place of those of their subject and kind."""
    table = c.notes.select("id", "subject", "kind", "content")
    return K.store_artifact(table, table.filter("id % 4 = 0").withColumn("content", F.upper("content")))


@query("""SELECT bag_id, CASE bag_id WHEN 'view' THEN 'seen' WHEN 'click' THEN 'pressed' END AS label, item_type, count(*) AS items, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT DISTINCT event_type AS bag_id, CAST(user_id AS VARCHAR) AS key, CASE WHEN user_id % 2 = 0 THEN 'file' ELSE 'symbol' END AS item_type FROM {events} WHERE event_type <> 'error') GROUP BY 1, 2, 3""")
def bag_report(c):
    """Labelled bags and their keys, one bag cleared."""
    rows = c.events.select(F.col("event_type").alias("bag_id"), F.col("user_id").cast("string").alias("key"), F.when(F.col("user_id") % 2 == 0, "file").otherwise("symbol").alias("item_type"), F.col("props").alias("content"))
    bag = K.bag_clear(K.bag_add(rows.limit(0), rows), "error")
    labels = K.bag_labels(c.spark.createDataFrame([("view", "old")], "bag_id string, label string"), c.spark.createDataFrame([("view", "seen"), ("click", "pressed")], "bag_id string, label string"))
    return K.bag_report(bag, labels)
