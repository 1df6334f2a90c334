"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph as G
from .registry import query

BUILTIN_LIST = ", ".join(f"'{b}'" for b in N.PYTHON_BUILTINS)
#: Noise in SQL, over a column.
NOISE = """({c} = '' OR {c} LIKE '<%' OR {c} IN (BUILTINS) OR regexp_matches(lower({c}), '(^|[.])(self|cursor|cls|ctx)([.]|$)') OR
 (len(string_split({c}, '.')) >= 3 AND len(list_filter(string_split({c}, '.')[2:len(string_split({c}, '.')) - 1], lambda p: length(p) <= 2)) > 0))""".replace("BUILTINS", BUILTIN_LIST)
PAIRS = "SELECT DISTINCT caller, callee FROM {v} WHERE caller IS NOT NULL AND callee IS NOT NULL"


def pairs(view: str) -> str:
    return "SELECT DISTINCT caller, callee FROM {" + view + "} WHERE caller IS NOT NULL AND callee IS NOT NULL"


def listed(df, *columns):
    return df.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in columns})


def root(c, name):
    return c.spark.createDataFrame([(name,)], "root string")


LAST = "regexp_replace({0}, '^.*[.]', '')"
SUFFIXES = "list_transform(range(1, len(string_split({c}, '.')) + 1), lambda k: array_to_string(string_split({c}, '.')[k:], '.'))"
PREFIXES = "list_transform(range(1, len(string_split({c}, '.')) + 1), lambda k: array_to_string(string_split({c}, '.')[1:k], '.'))"
TWO = "array_to_string(string_split({0}, '.')[1:2], '.')"


HOTSPOTS = f"""SELECT symbol, count(*) AS degree FROM (SELECT caller AS symbol FROM {{edges}} UNION ALL SELECT callee FROM {{edges}}) e
WHERE NOT {NOISE.replace('{c}', 'symbol')} AND symbol NOT IN (SELECT s FROM (SELECT caller AS s, bucket FROM {{refs}} UNION ALL SELECT callee, bucket FROM {{refs}}) WHERE s IS NOT NULL GROUP BY s HAVING min(bucket) = 'builtin' AND max(bucket) = 'builtin')
GROUP BY symbol ORDER BY degree DESC, symbol LIMIT 10"""


@query(HOTSPOTS)
def structure_hotspots(c):
    """The flagship: Select STRUCTURE.hotspots through the planner and executor of the query algebra."""
    from ..plans.algebra import Executor, Select
    from ..plans.views import views_of

    return Executor(views_of(c)).execute(Select("STRUCTURE", "hotspots"))


@query("SELECT symbol, count(*) AS degree FROM (SELECT caller AS symbol FROM {trade_edges} UNION ALL SELECT callee FROM {trade_edges}) e GROUP BY symbol")
def degree(c):
    return G.degree(c.trade_edges)


@query("SELECT symbol, count(*) AS degree FROM (SELECT caller AS symbol FROM {trade_edges} UNION ALL SELECT callee FROM {trade_edges}) e GROUP BY symbol ORDER BY degree DESC, symbol LIMIT 10")
def assessor_hotspots(c):
    return G.hotspots(c.trade_edges, 10)


@query(f"""WITH p AS ({pairs('edges')}), o AS (SELECT caller AS symbol, string_agg(callee, ',' ORDER BY callee) AS callees FROM p GROUP BY caller), i AS (SELECT callee AS symbol, string_agg(caller, ',' ORDER BY caller) AS callers FROM p GROUP BY callee)
SELECT symbol, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers FROM o FULL JOIN i USING (symbol)""")
def neighbours(c):
    return listed(G.neighbours(c.edges), "callees", "callers")


@query(f"WITH p AS ({pairs('event_edges')}) SELECT caller, string_agg(callee, ',' ORDER BY callee) AS callees FROM p GROUP BY caller")
def adjacency(c):
    return listed(G.adjacency(c.event_edges), "callees")


@query("SELECT callee, caller, line_number, caller_file, resolved, edge_type FROM {edges} WHERE callee = 'helper'")
def edges_for_callee(c):
    return c.edges.filter("callee = 'helper'").select("callee", "caller", "line_number", "caller_file", "resolved", "edge_type")


@query(f"WITH p AS ({pairs('trade_edges')}) SELECT callee AS symbol, count(caller) AS partners FROM p GROUP BY callee ORDER BY partners DESC, symbol LIMIT 25")
def top_callees(c):
    return G.unique_counts(c.trade_edges, "callee", 25)


@query(f"WITH p AS ({pairs('trade_edges')}) SELECT caller AS symbol, count(callee) AS partners FROM p GROUP BY caller ORDER BY partners DESC, symbol LIMIT 25")
def top_callers(c):
    return G.unique_counts(c.trade_edges, "caller", 25)


@query("SELECT s AS symbol FROM (SELECT caller AS s, bucket FROM {refs} UNION ALL SELECT callee, bucket FROM {refs}) WHERE s IS NOT NULL GROUP BY s HAVING min(bucket) = 'builtin' AND max(bucket) = 'builtin'")
def builtin_symbols(c):
    from ..operators.assess import builtin_symbols as found

    return found(c.refs)


def _walk(view: str, start: str, depth: int, back: bool = False) -> str:
    a, b = ("callee", "caller") if back else ("caller", "callee")
    return f"""WITH RECURSIVE w AS (SELECT '{start}' AS node, 0 AS depth UNION SELECT e.{b}, w.depth + 1 FROM w JOIN (SELECT DISTINCT caller, callee FROM {{{view}}}) e ON e.{a} = w.node WHERE w.depth < {depth})
SELECT '{start}' AS root, node, min(depth) AS depth FROM w WHERE node <> '{start}' GROUP BY node"""


@query(_walk("fk_edges", "r0", 3))
def surface(c):
    """Forward to depth 3 from one root, one plan."""
    return G.reach(c.fk_edges, root(c, "r0"), 3).filter("node <> root")


@query(_walk("edges", "helper", 2, True))
def influence(c):
    return G.reach(G.reversed_edges(c.edges), root(c, "helper"), 2).filter("node <> root")


@query("""WITH RECURSIVE w AS (SELECT DISTINCT n_regionkey AS k, 'r' || CAST(n_regionkey AS STRING) AS root, 'r' || CAST(n_regionkey AS STRING) AS node, 0 AS depth FROM {nation} UNION SELECT k, root, e.callee, depth + 1 FROM w JOIN (SELECT DISTINCT caller, callee FROM {fk_edges}) e ON e.caller = node WHERE depth < 2)
SELECT root, node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY root, node""")
def call_chain_survey(c):
    """Chains of all roots at once, the root carried along."""
    return G.reach(c.fk_edges, c.nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("root")), 2)


@query("""WITH RECURSIVE w AS (SELECT 'event' AS s, 'view' AS node, 0 AS depth UNION SELECT s, e.callee, depth + 1 FROM w JOIN (SELECT DISTINCT caller, callee FROM {event_edges}) e ON e.caller = node WHERE depth < 2),
u AS (SELECT 'event' AS s, 'view' AS node, 0 AS depth UNION SELECT s, e.caller, depth + 1 FROM u JOIN (SELECT DISTINCT caller, callee FROM {event_edges}) e ON e.callee = node WHERE depth < 2)
SELECT 'callee' AS part, callee AS node FROM {event_edges} WHERE caller = 'view' GROUP BY callee UNION ALL SELECT 'caller', caller FROM {event_edges} WHERE callee = 'view' GROUP BY caller
UNION ALL SELECT 'surface', node FROM w WHERE node <> 'view' GROUP BY node UNION ALL SELECT 'influence', node FROM u WHERE node <> 'view' GROUP BY node""")
def engine_query(c):
    """Context, surface and influence of one symbol."""
    e = c.event_edges
    around = G.pairs(e)
    parts = [around.filter("caller = 'view'").select(F.lit("callee").alias("part"), F.col("callee").alias("node")), around.filter("callee = 'view'").select(F.lit("caller").alias("part"), F.col("caller").alias("node"))]
    for part, edges in (("surface", e), ("influence", G.reversed_edges(e))):
        parts.append(G.reach(edges, root(c, "view"), 2).filter("node <> root").select(F.lit(part).alias("part"), "node"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_MP = f"SELECT DISTINCT a AS caller, b AS callee FROM (SELECT {TWO.format('caller')} AS a, {TWO.format('callee')} AS b FROM {{module_edges}}) WHERE a <> b"
_CLOSURE = f"WITH RECURSIVE m AS ({_MP}), t AS (SELECT caller, callee FROM m UNION SELECT t.caller, m.callee FROM t JOIN m ON t.callee = m.caller)"
_STATS = """st AS (SELECT coalesce(o.module, i.module) AS module, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT caller AS module, count(*) AS fan_out FROM m GROUP BY caller) o FULL JOIN (SELECT callee AS module, count(*) AS fan_in FROM m GROUP BY callee) i ON o.module = i.module)"""


@query(f"""WITH RECURSIVE m AS ({_MP}), w AS (SELECT 'cust.n3' AS node, 0 AS depth UNION SELECT m.callee, w.depth + 1 FROM w JOIN m ON m.caller = w.node WHERE w.depth < 6)
SELECT 'cust.n3' AS root, node, min(depth) AS depth FROM w WHERE node <> 'cust.n3' GROUP BY node""")
def deep_surface(c):
    """Beyond three hops: the frontier loop."""
    return G.reach(G.module_projection(c.module_edges), root(c, "cust.n3"), 6).filter("node <> root")


@query(_MP)
def module_projection(c):
    return G.module_projection(c.module_edges)


@query("SELECT caller, callee, count(*) AS n FROM (SELECT string_split(caller, '.')[1] AS caller, string_split(callee, '.')[1] AS callee FROM {module_edges}) WHERE caller <> callee GROUP BY caller, callee")
def assessor_module_projection(c):
    """First segments, repeats counted."""
    return G.first_segment_projection(c.module_edges).groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT caller AS module, string_agg(DISTINCT callee, ',' ORDER BY callee) AS deps, count(*) AS cross_edges FROM (SELECT string_split(caller, '.')[1] AS caller, string_split(callee, '.')[1] AS callee FROM {module_edges}) WHERE caller <> callee GROUP BY caller")
def assessor_subsystems(c):
    """Dependencies and degree of first segments."""
    p = G.first_segment_projection(c.module_edges)
    return p.groupBy(F.col("caller").alias("module")).agg(F.array_join(F.sort_array(F.collect_set("callee")), ",").alias("deps"), F.count(F.lit(1)).alias("cross_edges"))


@query(f"WITH m AS ({_MP}), {_STATS} SELECT module, fan_in, fan_out, fan_in + fan_out AS total FROM st")
def module_stats(c):
    return G.module_stats(c.module_edges)


@query(f"{_CLOSURE} SELECT caller AS module FROM t WHERE caller = callee")
def module_cycles(c):
    return G.module_cycles(c.module_edges)


@query(f"{_CLOSURE} SELECT count(*) > 0 AS has_cycles FROM t WHERE caller = callee")
def has_cycles(c):
    return G.module_cycles(c.module_edges).agg((F.count(F.lit(1)) > 0).alias("has_cycles"))


@query(f"{_CLOSURE}, {_STATS}, cy AS (SELECT caller AS module FROM t WHERE caller = callee) SELECT module, fan_in, fan_out, module IN (SELECT module FROM cy) AS in_cycle, 2 * fan_in + fan_out + CASE WHEN module IN (SELECT module FROM cy) THEN 5 ELSE 0 END AS score FROM st")
def rank_modules(c):
    return G.rank_modules(c.module_edges)


@query(f"{_CLOSURE}, {_STATS}, cy AS (SELECT caller AS module FROM t WHERE caller = callee) SELECT module, 2 * fan_in + fan_out + CASE WHEN module IN (SELECT module FROM cy) THEN 5 ELSE 0 END AS score FROM st ORDER BY score DESC, module LIMIT 5")
def critical_modules(c):
    return G.rank_modules(c.module_edges).select("module", "score").orderBy(F.desc("score"), "module").limit(5)


@query(f"{_CLOSURE} SELECT callee AS module, count(*) AS impacted FROM t GROUP BY callee")
def impacted_modules(c):
    return G.impacted_modules(c.module_edges)


@query(f"{_CLOSURE}, {_STATS}, cy AS (SELECT caller AS module FROM t WHERE caller = callee), im AS (SELECT callee AS module, count(*) AS impacted FROM t GROUP BY callee) SELECT module, coalesce(impacted, 0) AS impacted, 3 * fan_in + 2 * fan_out + 2 * coalesce(impacted, 0) + CASE WHEN module IN (SELECT module FROM cy) THEN 10 ELSE 0 END AS risk FROM st LEFT JOIN im USING (module)")
def risk_scores(c):
    return G.risk_scores(c.module_edges)


@query(f"{_CLOSURE} SELECT caller, callee FROM t WHERE caller <> callee")
def reachability(c):
    """All pairs, self removed."""
    return G.closure(G.module_projection(c.module_edges)).filter("caller <> callee")


@query("""WITH mm AS (SELECT name, array_to_string(string_split(min(file_path), '/')[1:len(string_split(min(file_path), '/')) - 1], '/') AS module FROM {functions} GROUP BY name),
e AS (SELECT caller, callee FROM {edges} WHERE callee NOT IN (SELECT s FROM (SELECT caller AS s, bucket FROM {refs} UNION ALL SELECT callee, bucket FROM {refs}) WHERE s IS NOT NULL GROUP BY s HAVING min(bucket) = 'builtin' AND max(bucket) = 'builtin')),
p AS (SELECT coalesce(a1.module, a2.module, array_to_string(string_split(caller, '.')[1:2], '.')) AS a, coalesce(b1.module, b2.module, array_to_string(string_split(callee, '.')[1:2], '.')) AS b FROM e
LEFT JOIN mm a1 ON a1.name = caller LEFT JOIN mm a2 ON a2.name = regexp_replace(caller, '^.*[.]', '') LEFT JOIN mm b1 ON b1.name = callee LEFT JOIN mm b2 ON b2.name = regexp_replace(callee, '^.*[.]', ''))
SELECT a AS module, string_agg(DISTINCT b, ',' ORDER BY b) AS targets, count(*) AS cross_edges FROM p WHERE a <> b GROUP BY a""")
def subsystem_view(c):
    from ..operators.assess import builtin_symbols as found

    modules = G.file_of_symbol(c.functions).select("name", N.parent_directory("file_path").alias("module"))
    return listed(G.subsystems(c.edges, modules, found(c.refs)), "targets")


@query("""WITH RECURSIVE p AS (SELECT 'r1' AS node, ['r1'] AS path, 0 AS d UNION ALL SELECT e.callee, list_append(p.path, e.callee), d + 1 FROM p JOIN (SELECT DISTINCT caller, callee FROM {fk_edges}) e ON e.caller = p.node WHERE d < 6)
SELECT node, array_to_string(min(path), '>') AS path FROM p WHERE node LIKE 's%' GROUP BY node""")
def shortest_paths(c):
    """From one root to every supplier."""
    return listed_path(G.shortest_paths(c.fk_edges, "r1", depth=6).filter("node LIKE 's%'"))


def listed_path(df):
    return df.select("node", F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT a, b FROM (SELECT caller AS a, callee AS b FROM {fk_edges} UNION ALL SELECT callee, caller FROM {fk_edges})),
w AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT u.b, depth + 1 FROM w JOIN u ON u.a = w.node WHERE depth < 2)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def subgraph_around(c):
    return G.ball(c.fk_edges, "n3", 2)


@query("""WITH RECURSIVE u AS (SELECT DISTINCT a, b FROM (SELECT caller AS a, callee AS b FROM {module_edges} UNION ALL SELECT callee, caller FROM {module_edges})),
w AS (SELECT 'supp.k1.h' AS node, 0 AS depth UNION SELECT u.b, depth + 1 FROM w JOIN u ON u.a = w.node WHERE depth < 2), n AS (SELECT DISTINCT node FROM w)
SELECT DISTINCT caller, callee FROM {module_edges} WHERE caller IN (SELECT node FROM n) AND callee IN (SELECT node FROM n)""")
def induced_subgraph(c):
    return G.induced(c.module_edges, G.ball(c.module_edges, "supp.k1.h", 2))


_ENTRY = f"""keys AS (SELECT DISTINCT unnest({SUFFIXES.replace('{c}', 'callee')}) AS name FROM {{edges}}),
al AS (SELECT name, file_path FROM {{functions}} UNION ALL SELECT name, file_path FROM {{classes}}),
ep AS (SELECT name, min(file_path) AS file_path FROM al WHERE NOT (name LIKE '\\_\\_%' ESCAPE '\\' AND name LIKE '%\\_\\_' ESCAPE '\\') AND NOT regexp_matches(file_path, '(^|/)tests?/|(^|/)test_[^/]*$|_test\\.[^./]*$') AND name NOT LIKE 'test\\_%' ESCAPE '\\' AND name NOT IN (SELECT name FROM keys) GROUP BY name)"""


@query(f"WITH {_ENTRY} SELECT ep.name, ep.file_path, coalesce(n, 0) AS out_degree FROM ep LEFT JOIN (SELECT caller, count(DISTINCT callee) AS n FROM {{edges}} GROUP BY caller) o ON o.caller = ep.name")
def entry_points(c):
    return G.entry_points(c.functions, c.classes, c.edges)


@query(f"""WITH fa AS (SELECT name, min(file_path) AS file_path FROM {{functions}} GROUP BY name), d AS (SELECT s AS name, count(*) AS degree FROM (SELECT {LAST.format('caller')} AS s FROM {{edges}} UNION ALL SELECT {LAST.format('callee')} FROM {{edges}}) GROUP BY s)
SELECT name, degree, file_path FROM d JOIN fa USING (name) WHERE NOT (name LIKE '\\_\\_%' ESCAPE '\\' AND name LIKE '%\\_\\_' ESCAPE '\\') ORDER BY degree DESC, name LIMIT 15""")
def most_connected(c):
    return G.most_connected(c.edges, c.functions)


@query(f"""WITH fa AS (SELECT name, min(file_path) AS file_path FROM {{functions}} GROUP BY name)
SELECT least(a.file_path, b.file_path) AS file_a, greatest(a.file_path, b.file_path) AS file_b, count(*) AS calls FROM {{edges}} e JOIN fa a ON a.name = {LAST.format('e.caller')} JOIN fa b ON b.name = {LAST.format('e.callee')} WHERE a.file_path <> b.file_path GROUP BY 1, 2 HAVING count(*) >= 3""")
def file_clusters(c):
    return G.file_clusters(c.edges, c.functions)


@query("SELECT target_id AS name, count(DISTINCT caller) AS callers, count(*) AS calls FROM {edges} WHERE resolved AND target_id IN (SELECT name FROM {functions}) GROUP BY target_id ORDER BY callers DESC, calls DESC, name LIMIT 20")
def hot_callers(c):
    return G.hot_callers(c.edges, c.functions)


@query(f"""WITH p AS (SELECT DISTINCT {LAST.format('caller')} AS caller, {LAST.format('callee')} AS callee FROM {{edges}}), o AS (SELECT caller AS symbol, count(*) AS callees FROM p GROUP BY caller), i AS (SELECT callee AS symbol, count(*) AS callers FROM p GROUP BY callee),
m AS (SELECT function_name AS symbol, count(*) AS mutations FROM {{mutations}} GROUP BY 1), r AS (SELECT symbol, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(mutations, 0) AS mutations FROM o FULL JOIN i USING (symbol) LEFT JOIN m USING (symbol))
SELECT *, CASE WHEN callers >= 5 OR (callers >= 3 AND mutations > 0) THEN 'HOT' WHEN callers >= 2 OR mutations > 0 THEN 'WARM' ELSE 'SAFE' END AS risk FROM r""")
def score_risk(c):
    return G.score_risk(c.edges, c.mutations)


@query(f"""WITH own AS (SELECT DISTINCT name FROM {{functions}} WHERE file_path = 'pkg1/sub0/mod6.py'), k AS (SELECT caller, unnest({SUFFIXES.replace('{c}', 'callee')}) AS name FROM {{edges}} WHERE caller_file <> 'pkg1/sub0/mod6.py')
SELECT own.name, count(DISTINCT caller) AS callers FROM own LEFT JOIN k USING (name) GROUP BY own.name""")
def blast_radius(c):
    return G.blast_radius(c.edges, c.functions, "pkg1/sub0/mod6.py")


@query("""WITH RECURSIVE w AS (SELECT 'helper' AS node, 0 AS depth UNION SELECT e.callee, depth + 1 FROM w JOIN (SELECT DISTINCT caller, callee FROM {edges} WHERE resolved) e ON e.caller = node WHERE depth < 2)
SELECT node, min(depth) AS depth FROM w GROUP BY node ORDER BY depth, node LIMIT 50""")
def bfs_callees(c):
    return G.bfs_callees(c.edges, "helper", 2, 50, True)


@query(f"""WITH keys AS (SELECT unnest(list_distinct(list_concat({SUFFIXES.replace('{c}', 'callee')}, {PREFIXES.replace('{c}', 'callee')}))) AS name FROM {{edges}}), u AS (SELECT name, count(*) AS uses FROM keys GROUP BY name)
SELECT f.name, f.file_path, coalesce(uses, 0) AS uses FROM (SELECT name, min(file_path) AS file_path FROM {{functions}} WHERE contains(lower(name), 'row') GROUP BY name) f LEFT JOIN u USING (name) ORDER BY uses DESC, name LIMIT 20""")
def find_symbols(c):
    return G.find_symbols(c.functions, c.edges, "row")


@query(f"WITH p AS ({pairs('trade_edges')}) SELECT a.callee AS callee_a, b.callee AS callee_b, count(*) AS callers FROM p a JOIN p b ON a.caller = b.caller AND a.callee < b.callee GROUP BY 1, 2 HAVING count(*) >= 3")
def primitive_gaps(c):
    return G.co_occurring_callees(c.trade_edges, 3)


@query("""WITH RECURSIVE u AS (SELECT DISTINCT a, b FROM (SELECT caller AS a, callee AS b FROM {module_edges} UNION ALL SELECT callee, caller FROM {module_edges})),
t AS (SELECT a AS node, a AS seen FROM u UNION SELECT t.node, u.b FROM t JOIN u ON u.a = t.seen), lab AS (SELECT node, min(seen) AS label, count(*) AS size FROM t GROUP BY node),
d AS (SELECT s AS node, count(*) AS degree FROM (SELECT caller AS s FROM {module_edges} UNION ALL SELECT callee FROM {module_edges}) GROUP BY s),
h AS (SELECT label, node AS hub FROM (SELECT label, node, row_number() OVER (PARTITION BY label ORDER BY degree DESC, node) AS r FROM lab JOIN d USING (node)) WHERE r = 1)
SELECT node AS symbol, hub, size FROM lab JOIN h USING (label)""")
def cluster_hubs(c):
    return G.labelled_components(c.module_edges)


@query("""WITH RECURSIVE n AS (SELECT DISTINCT 'n' || CAST(n_nationkey AS STRING) AS name FROM {nation} UNION SELECT DISTINCT 'r' || CAST(n_regionkey AS STRING) FROM {nation} UNION SELECT 'c' || CAST(c_custkey AS STRING) FROM {customer} UNION SELECT 's' || CAST(s_suppkey AS STRING) FROM {supplier}),
e AS (SELECT DISTINCT caller, callee FROM {fk_edges} WHERE caller IN (SELECT name FROM n) AND callee IN (SELECT name FROM n)),
w AS (SELECT name, 1 AS wave FROM n UNION SELECT e.caller, w.wave + 1 FROM w JOIN e ON e.callee = w.name WHERE w.wave < 20)
SELECT name, max(wave) AS wave FROM w GROUP BY name""")
def dependency_waves(c):
    """Waves of a graph without cycles: one more than the longest way down."""
    text = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string")).alias("name")
    nodes = c.nation.select(text("n", "n_nationkey")).union(c.nation.select(text("r", "n_regionkey"))).union(c.customer.select(text("c", "c_custkey"))).union(c.supplier.select(text("s", "s_suppkey")))
    return G.waves(nodes, c.fk_edges)


@query("SELECT count(*) AS rows_all, count(DISTINCT caller || '>' || callee) AS pairs_distinct FROM {edges}")
def edge_counts(c):
    """Rows of the snapshot, and distinct pairs as routing counts them."""
    return c.edges.agg(F.count(F.lit(1)).alias("rows_all"), F.countDistinct(F.concat_ws(">", "caller", "callee")).alias("pairs_distinct"))


@query("SELECT direction, other, count(*) AS n, min(line_number) AS first_line FROM (SELECT 'in' AS direction, caller AS other, line_number FROM {edges} WHERE callee = 'helper' UNION ALL SELECT 'out', callee, line_number FROM {edges} WHERE caller = 'helper') GROUP BY ALL")
def edges_of(c):
    e = c.edges
    both = e.filter("callee = 'helper'").select(F.lit("in").alias("direction"), F.col("caller").alias("other"), "line_number").unionByName(e.filter("caller = 'helper'").select(F.lit("out").alias("direction"), F.col("callee").alias("other"), "line_number"))
    return both.groupBy("direction", "other").agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first_line"))


@query("SELECT caller AS source, callee AS target, 'caller' AS source_role, 'callee' AS target_role FROM {event_edges} WHERE caller IS NOT NULL AND callee IS NOT NULL")
def semantic_edges(c):
    return c.event_edges.filter("caller IS NOT NULL AND callee IS NOT NULL").select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("caller").alias("source_role"), F.lit("callee").alias("target_role"))


@query("SELECT edge_type, count(*) AS n, count(*) FILTER (resolved) AS resolved_n, round(100.0 * count(*) FILTER (NOT resolved) / count(*), 1) AS unresolved_pct FROM {edges} GROUP BY edge_type")
def corpus_edge_stats(c):
    return c.edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("resolved_n"), F.round(100.0 * F.count_if(~F.col("resolved")) / F.count(F.lit(1)), 1).alias("unresolved_pct"))
