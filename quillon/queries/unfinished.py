"""Queries of stubs, chains, interfaces, features and conventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import judgment as J
from ..operators import stubs as S
from .graphs import BUILTIN_LIST, LAST, SUFFIXES
from .registry import query

_C = f"""fn AS (SELECT name, bool_or(is_stub) AS is_stub, min(file_path) AS file_path FROM {{functions}} GROUP BY name),
k AS (SELECT DISTINCT caller, unnest({SUFFIXES.replace('{c}', 'callee')}) AS name FROM {{edges}} WHERE callee IS NOT NULL),
c AS (SELECT k.caller, k.name, a.is_stub AS caller_stub, b.is_stub AS callee_stub FROM k JOIN fn b ON b.name = k.name LEFT JOIN fn a ON a.name = k.caller),
fr AS (SELECT caller, name, CASE WHEN caller_stub THEN 'chain' ELSE 'direct' END AS mode FROM c WHERE callee_stub AND caller_stub IS NOT NULL),
cnt AS (SELECT name, count(caller) AS callers, count(*) FILTER (caller_stub) AS stub_callers, count(*) FILTER (NOT caller_stub) AS live_callers FROM c GROUP BY name),
pos AS (SELECT * FROM (SELECT fn.name, CASE WHEN name IN (SELECT name FROM fr WHERE mode = 'direct') AND name IN (SELECT caller FROM fr WHERE mode = 'chain') THEN 'head'
  WHEN name IN (SELECT name FROM fr WHERE mode = 'chain') AND name IN (SELECT caller FROM fr WHERE mode = 'chain') THEN 'middle' WHEN name IN (SELECT name FROM fr WHERE mode = 'chain') THEN 'tail' END AS position FROM fn WHERE is_stub) WHERE position IS NOT NULL),
aa AS (SELECT DISTINCT class_name AS base_class, method FROM {{methods}} WHERE is_abstract), ab AS (SELECT * FROM aa WHERE base_class IN (SELECT name FROM {{classes}} WHERE base_class LIKE '%ABC%' OR base_class LIKE '%Abstract%')), hv AS (SELECT DISTINCT class_name, method FROM {{methods}}),
gp AS (SELECT s.name AS class_name, s.base_class, ab.method FROM {{classes}} s JOIN ab USING (base_class) WHERE NOT EXISTS (SELECT 1 FROM hv WHERE hv.class_name = s.name AND hv.method = ab.method)),
vd AS (SELECT DISTINCT base_class AS class_name FROM ab WHERE base_class NOT IN (SELECT base_class FROM {{classes}}))"""


def with_(rest: str) -> str:
    return f"WITH {_C} {rest}"


def with_all(rest: str) -> str:
    """The same over all_functions."""
    return with_(rest).replace("{functions}", "{all_functions}")


@query(with_("SELECT caller, name, mode FROM fr"))
def frontier_rows(c):
    return S.frontier(c.functions, c.edges)


@query(with_("SELECT * FROM pos"))
def chain_positions(c):
    return S.chain_positions(c.functions, c.edges)


@query(with_("SELECT * FROM cnt"))
def caller_counts(c):
    return S.caller_counts(c.functions, c.edges)


@query(with_("SELECT DISTINCT * FROM gp"))
def find_abc_gaps(c):
    return S.abstract_gaps(c.classes, c.methods)


@query(with_("SELECT * FROM vd"))
def abc_voids(c):
    return S.abstract_voids(c.classes, c.methods)


@query(with_("SELECT s.base_class || '.' || ab.method AS caller, s.name || '.' || ab.method AS callee FROM {classes} s JOIN aa AS ab USING (base_class) JOIN hv ON hv.class_name = s.name AND hv.method = ab.method"))
def polymorphic_edges(c):
    return S.polymorphic_edges(c.classes, c.methods)


_IFACE = "SELECT DISTINCT 'I' || substr(class_name, 6) AS interface, method FROM {methods} WHERE is_abstract AND method LIKE 'on%'"


@query(f"WITH i AS ({_IFACE}), hv AS (SELECT DISTINCT class_name, method FROM {{methods}}) SELECT i.interface || '.' || i.method AS caller, t.class_name || '.' || i.method AS callee FROM i CROSS JOIN (SELECT DISTINCT class_name FROM hv) t WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.interface = i.interface AND NOT EXISTS (SELECT 1 FROM hv WHERE hv.class_name = t.class_name AND hv.method = j.method))")
def interface_dispatch(c):
    """Interfaces satisfied by their method sets."""
    wanted = c.methods.filter("is_abstract AND method LIKE 'on%'").select(F.concat(F.lit("I"), F.expr("substr(class_name, 6)")).alias("interface"), "method")
    return S.interface_dispatch(wanted, c.methods)


@query(with_(""", sz AS (SELECT base_class AS interface, count(*) AS size FROM ab GROUP BY 1), mt AS (SELECT ab.base_class AS interface, hv.class_name, count(*) AS matched FROM ab JOIN hv USING (method) WHERE hv.class_name NOT IN (SELECT name FROM {classes} WHERE base_class LIKE '%ABC%' OR base_class LIKE '%Abstract%') GROUP BY 1, 2)
SELECT interface, class_name, matched, size, CASE WHEN matched >= 0.6 * size THEN 'strong' ELSE 'possible' END AS strength FROM mt JOIN sz USING (interface) WHERE matched >= 0.4 * size AND NOT EXISTS (SELECT 1 FROM {classes} k WHERE k.name = class_name AND k.base_class = interface)""").replace(") ,", "),"))
def orphaned_interfaces(c):
    return S.orphaned_interfaces(c.classes, c.methods)


@query(with_("SELECT base_class AS class_name, count(DISTINCT method) AS methods FROM ab WHERE base_class IN (SELECT class_name FROM vd) GROUP BY 1 HAVING bool_and(regexp_matches(method, '^(create_|build_|make_|get_|new_|produce_)'))"))
def phantom_factories(c):
    return S.phantom_factories(c.classes, c.methods)


_PRIORITY = "SELECT fn.name, coalesce(live_callers, 0) AS callers, position, coalesce(live_callers, 0) + CASE position WHEN 'tail' THEN 5 WHEN 'middle' THEN 2 WHEN 'head' THEN 1 ELSE 0 END + CASE WHEN fn.name IN (SELECT method FROM gp) THEN 3 ELSE 0 END AS score FROM fn LEFT JOIN cnt USING (name) LEFT JOIN pos USING (name) WHERE fn.is_stub AND (coalesce(live_callers, 0) > 0 OR position IN ('tail', 'middle'))"


@query(with_(_PRIORITY + " ORDER BY score DESC, callers DESC, name LIMIT 20"))
def frontier_priority(c):
    return S.frontier_priority(c.functions, c.edges, S.gap_methods(c.classes, c.methods))


@query(with_(_PRIORITY))
def score_stubs(c):
    """The same scores for all such stubs."""
    return S.frontier_priority(c.functions, c.edges, S.gap_methods(c.classes, c.methods), None)


@query(with_("SELECT *, CASE WHEN pct >= 40 THEN 'high' WHEN pct >= 20 THEN 'medium' ELSE 'low' END AS band FROM (SELECT count(*) AS functions, count(*) FILTER (stub_callers > 0 AND live_callers = 0) AS gated, round(100.0 * count(*) FILTER (stub_callers > 0 AND live_callers = 0) / greatest(count(*), 1), 1) AS pct FROM fn LEFT JOIN cnt USING (name) WHERE NOT is_stub)"))
def frontier_coverage(c):
    return S.frontier_coverage(c.functions, c.edges)


_FRAMEWORK = "len(list_filter(string_split(coalesce(decorators, ''), ','), lambda d: trim(d) <> '' AND regexp_replace(string_split(trim(d), '(')[1], '^.*[.]', '') NOT IN ('property', 'staticmethod', 'classmethod'))) > 0"
_HINT = """(regexp_matches(lower(coalesce(file_path, '')), '(^|[/.\\\\])(route|routes|view|views|handler|handlers|endpoint|endpoints|cli|commands|command|webhook|webhooks|task|tasks|signal|signals|middleware|main)($|[/.\\\\])') OR regexp_matches(lower(name), '^(handle_|on_|route_|cmd_|do_)'))"""


@query(with_all(f""", o AS (SELECT name, bool_or({_FRAMEWORK}) AS fw, bool_or({_HINT}) AS hint, bool_or(coalesce(file_path LIKE '%.json', false)) AS js FROM {{functions}} GROUP BY name),
t AS (SELECT fn.name, is_stub AS s, coalesce(callers, 0) AS callers, coalesce(live_callers, 0) AS live, position, fw, hint, js OR contains(fn.name, '::action::') OR contains(fn.name, '::guard::') AS mach, is_stub AND coalesce(callers, 0) = 0 AND fn.name NOT IN (SELECT caller FROM {{edges}} WHERE caller IS NOT NULL) AS cut FROM fn JOIN o USING (name) LEFT JOIN cnt USING (name) LEFT JOIN pos USING (name)),
u AS (SELECT count(*) FILTER (s) AS st, count(*) FILTER (NOT s) AS im, count(*) FILTER (NOT s AND live = 0 AND NOT fw) AS orp FROM t)
SELECT 'total_stubs' AS shape, st AS n FROM u UNION ALL SELECT 'total_implemented', im FROM u UNION ALL SELECT 'direct_call', count(*) FILTER (s AND live > 0) FROM t UNION ALL SELECT 'chain_' || p, (SELECT count(*) FROM t WHERE position = p) FROM (VALUES ('head'), ('middle'), ('tail')) v(p)
UNION ALL SELECT 'orphaned_impl', orp FROM u UNION ALL SELECT 'entry_point', count(*) FILTER (cut AND hint) FROM t UNION ALL SELECT 'fsm_dispatch', count(*) FILTER (cut AND NOT hint AND mach) FROM t UNION ALL SELECT 'disconnected', count(*) FILTER (cut AND NOT hint AND NOT mach) FROM t
UNION ALL SELECT 'abc_interface', (SELECT count(DISTINCT method) FROM gp) UNION ALL SELECT 'connectivity', CASE WHEN st > 0 AND orp >= 3 * st AND orp >= 50 AND orp >= 0.5 * im THEN 1 ELSE 0 END FROM u UNION ALL SELECT 'wiring', CASE WHEN st = 0 AND orp >= 50 AND orp >= 0.5 * im THEN 1 ELSE 0 END FROM u""").replace(") ,", "),"))
def detect_topology(c):
    return S.topology(c.all_functions, c.edges, S.gap_methods(c.classes, c.methods))


@query(with_all(f"SELECT l.name, l.file_path, coalesce(callers, 0) AS callers, CASE WHEN coalesce(callers, 0) > 0 THEN 'possibly-stranded' WHEN l.file_path IN (SELECT file_path FROM {{functions}} WHERE is_stub) THEN 'ready-but-blocked' ELSE 'anticipatory' END AS label FROM (SELECT name, file_path FROM {{functions}} WHERE NOT is_stub GROUP BY name, file_path HAVING NOT bool_or({_FRAMEWORK})) l LEFT JOIN cnt USING (name) WHERE coalesce(live_callers, 0) = 0"))
def orphaned_implementations(c):
    return S.orphaned_implementations(c.all_functions, c.edges)


@query("SELECT p.name, p.file_path, coalesce(n, 0) AS callers, coalesce(n, 0) >= 2 AS memo FROM (SELECT DISTINCT name, file_path FROM {all_functions} WHERE NOT is_stub AND lower(file_path) NOT LIKE '%.json' AND file_path NOT IN (SELECT file_path FROM {mutations})) p LEFT JOIN (SELECT callee AS name, count(DISTINCT caller) AS n FROM {edges} WHERE resolved GROUP BY 1) c USING (name)")
def pure_functions(c):
    return S.pure_functions(c.all_functions, c.mutations, c.edges)


@query("SELECT DISTINCT callee AS name FROM {edges} WHERE edge_type IN ('function_reference', 'decorator') AND NOT contains(callee, '.') AND callee NOT IN (SELECT target_id FROM {edges} WHERE edge_type NOT IN ('function_reference', 'decorator'))")
def dead_event_handlers(c):
    return S.dead_event_handlers(c.edges)


@query("SELECT o.file_path, functions, stubs, coalesce(m.n, 0) AS mutations FROM (SELECT file_path, count(*) AS functions, count(*) FILTER (is_stub) AS stubs FROM {functions} GROUP BY 1 HAVING count(*) >= 5) o LEFT JOIN (SELECT file_path, count(*) AS n FROM {mutations} GROUP BY 1) m USING (file_path) ORDER BY functions DESC, mutations DESC, file_path LIMIT 20")
def large_files(c):
    return S.large_files(c.functions, c.mutations)


@query(with_(", w AS (SELECT DISTINCT name FROM c WHERE callee_stub AND caller_stub = false UNION SELECT c.name FROM w JOIN c ON c.caller = w.name WHERE c.caller_stub AND c.callee_stub) SELECT name FROM fn WHERE is_stub AND name NOT IN (SELECT name FROM w)").replace("WITH fn", "WITH RECURSIVE fn").replace(") ,", "),"))
def stub_islands(c):
    return S.stub_islands(c.functions, c.edges)


@query(with_(""", sn AS (SELECT name FROM fn WHERE is_stub), se AS (SELECT DISTINCT caller, name FROM c WHERE caller_stub AND callee_stub AND caller <> name), w AS (SELECT name, 1 AS d FROM sn UNION SELECT se.caller, d + 1 FROM w JOIN se ON se.name = w.name WHERE d <= (SELECT count(*) FROM sn))
SELECT name, CASE WHEN max(d) > (SELECT count(*) FROM sn) THEN -1 ELSE max(d) END AS wave FROM w GROUP BY name""").replace("WITH fn", "WITH RECURSIVE fn").replace(") ,", "),"))
def implementation_order(c):
    """Waves on a graph with cycles; by SQL a stub is behind a cycle if some path from it is longer than there are stubs."""
    return S.implementation_order(c.functions, c.edges)


_FEATURE = "string_split(file_path, '/')[1]"
_TESTS = "regexp_matches(string_split(lower({0}), '.')[1], '^(tests?|specs?|__tests?__|testing|testcases|test_cases|test_.*|spec_.*)$')"
_AT = f"at_ AS (SELECT *, {_FEATURE} AS feature FROM {{all_functions}} WHERE NOT {_TESTS.format(_FEATURE)})"


@query(f"""WITH {_AT}, kn AS (SELECT DISTINCT feature, name AS callee FROM at_ UNION SELECT feature, {LAST.format('name')} FROM at_ WHERE contains(name, '.') AND NOT contains(name, '::')), pl AS (SELECT name, min({_FEATURE}) AS f FROM {{all_functions}} GROUP BY name),
x AS (SELECT kn.feature, count(DISTINCT e.callee) AS entry_points, count(*) AS crossings FROM {{edges}} e JOIN kn USING (callee) LEFT JOIN pl ON pl.name = e.caller WHERE coalesce(pl.f, '') <> kn.feature GROUP BY 1),
r AS (SELECT feature, symbols, stubs, coalesce(entry_points, 0) AS entry_points, coalesce(crossings, 0) AS crossings FROM (SELECT feature, count(DISTINCT name) AS symbols, count(*) FILTER (is_stub) AS stubs FROM at_ GROUP BY 1) LEFT JOIN x USING (feature))
SELECT *, CASE WHEN string_split(lower(feature), '.')[1] IN ('static', 'assets', 'public', 'dist', 'build', 'vendor', 'node_modules', 'www', 'media') THEN 'none' WHEN symbols >= 30 AND entry_points >= 2 AND 1 - stubs / symbols >= 0.85 AND entry_points / symbols <= 0.08 THEN 'isolated' WHEN entry_points >= 20 AND stubs >= 5 THEN 'incomplete' ELSE 'none' END AS standing FROM r""")
def list_features(c):
    return S.features(c.all_functions, c.edges)


@query(f"""WITH {_AT}, ow AS (SELECT name, arg_max(feature, id) AS feature, arg_max(is_stub, id) AS is_stub FROM at_ GROUP BY name),
br AS (SELECT regexp_replace(name, '^.*(::|[.])', '') AS name, arg_min(feature, name) AS feature, arg_min(is_stub, name) AS is_stub FROM ow WHERE contains(name, '.') OR contains(name, '::') GROUP BY 1), kn AS (SELECT * FROM ow UNION ALL SELECT * FROM br WHERE name NOT IN (SELECT name FROM ow)),
m AS (SELECT e.callee, a.feature AS ff, b.feature, b.is_stub FROM {{edges}} e JOIN kn a ON a.name = e.caller LEFT JOIN kn b ON b.name = e.callee),
i AS (SELECT feature, count(*) AS calls_in, bool_or(is_stub) AS blocked FROM m WHERE feature <> ff GROUP BY 1), l AS (SELECT ff AS feature, count(DISTINCT callee) AS missing FROM m WHERE feature IS NULL AND NOT contains(callee, '.') AND callee NOT IN ({BUILTIN_LIST}) GROUP BY 1),
v AS (SELECT DISTINCT {_FEATURE} AS feature FROM {{classes}} WHERE (base_class LIKE '%ABC%' OR base_class LIKE '%Abstract%') AND name NOT IN (SELECT base_class FROM {{classes}} WHERE base_class IS NOT NULL)),
s AS (SELECT feature, count(*) FILTER (NOT is_stub) AS implemented, count(*) FILTER (is_stub) AS stubs FROM at_ GROUP BY 1),
r AS (SELECT feature, implemented, stubs, coalesce(missing, 0) AS missing, coalesce(calls_in, 0) AS calls_in, coalesce(blocked, false) AS blocked, feature IN (SELECT feature FROM v) AS void FROM s LEFT JOIN i USING (feature) LEFT JOIN l USING (feature))
SELECT *, round(greatest((1 - implemented / (implemented + stubs + missing)) * calls_in, CASE WHEN void THEN (1 - implemented / (implemented + stubs + missing)) * 5 ELSE 0 END), 4) AS priority FROM r WHERE stubs > 0 OR missing > 0 ORDER BY priority DESC, blocked DESC, void DESC, feature LIMIT 10""")
def development_priorities(c):
    return S.development_priorities(c.all_functions, c.edges, c.classes, c.methods)


@query(with_("SELECT e.callee AS node, CASE WHEN b.is_stub THEN 'stub' WHEN NOT b.is_stub THEN 'implemented' WHEN contains(e.callee, '.') THEN 'external' ELSE 'missing' END AS status FROM (SELECT DISTINCT callee FROM {edges} WHERE caller IN (SELECT name FROM fn WHERE string_split(file_path, '/')[1] = 'pkg2')) e LEFT JOIN fn b ON b.name = regexp_replace(e.callee, '^.*[.]', '')"))
def feature_shape(c):
    return S.feature_shape(c.functions, c.edges, "pkg2")


def _shapes(key: str) -> str:
    return f"""WITH b AS (SELECT {key} AS place, count(*) AS functions, count(*) FILTER (is_stub) AS stubs FROM {{functions}} GROUP BY 1), kd AS (SELECT {key} AS place, coalesce(return_type, 'none') AS kind, count(*) AS n FROM {{functions}} WHERE is_stub GROUP BY 1, 2),
tp AS (SELECT place, CASE WHEN count(*) > 1 THEN 'mixed' ELSE min(kind) END AS dominant FROM (SELECT *, rank() OVER (PARTITION BY place ORDER BY n DESC) AS r FROM kd) WHERE r = 1 GROUP BY place)
SELECT place, functions, stubs, round(stubs / functions, 4) AS density, dominant, CASE WHEN round(stubs / functions, 4) >= 0.6 THEN 'blocked' WHEN round(stubs / functions, 4) >= 0.3 THEN 'partial' ELSE 'sound' END AS verdict FROM b LEFT JOIN tp USING (place)"""


@query(_shapes("file_path"))
def stub_file_shape(c):
    return S.stub_shapes(c.functions, F.col("file_path"))


@query(_shapes("array_to_string(string_split(file_path, '/')[1:len(string_split(file_path, '/')) - 1], '/')"))
def stub_subsystem_shape(c):
    return S.stub_shapes(c.functions, N.parent_directory("file_path"))


@query("SELECT prerequisite, count(DISTINCT name) AS stubs, CASE WHEN count(DISTINCT name) >= 3 THEN 'HIGH' WHEN count(DISTINCT name) = 2 THEN 'MED' ELSE 'LOW' END AS level FROM (SELECT name, unnest(regexp_extract_all(docstring, '(?:blocked on|requires|needs|depends on)\\s+(\\w[\\w#.]*)', 1)) AS prerequisite FROM {functions} WHERE is_stub) WHERE lower(prerequisite) NOT IN ('a', 'an', 'the', 'this', 'that', 'to') GROUP BY prerequisite")
def prerequisite_map(c):
    return S.prerequisite_map(c.functions)


_END = "'^(.+)(FSM|Manager|Engine|System|Controller|Service|Handler|Registry|Store|State|Model)$', '\\1'"
_WORDS = "list_filter(list_distinct(list_concat(regexp_extract_all(docstring, '\\b([A-Z][a-z]+(?:[A-Z][a-zA-Z0-9]+)+)\\b', 1), regexp_extract_all(docstring, '\\b([A-Za-z][a-zA-Z0-9]*(?:FSM|Manager|Engine|Controller|Service|Handler|Registry|Store))\\b', 1))), lambda w: w NOT IN ('None', 'True', 'False', 'Optional', 'List', 'Dict', 'Any', 'Union', 'Query', 'Get', 'Set', 'Use', 'The', 'This', 'For', 'Return', 'Note', 'Args', 'Returns', 'Raises', 'Example', 'Check', 'Call', 'Handle', 'Active', 'Current', 'New', 'Old', 'Data', 'Info', 'Type'))"


@query(f"""WITH w AS (SELECT concept, count(DISTINCT name) AS uses FROM (SELECT name, unnest({_WORDS}) AS concept FROM {{functions}} WHERE docstring IS NOT NULL) GROUP BY concept), tk AS (SELECT DISTINCT unnest(string_split(name, '_')) AS token FROM {{functions}}),
pt AS (SELECT DISTINCT concept FROM (SELECT concept, unnest(string_split(lower(regexp_replace(regexp_replace(concept, {_END}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_')) AS token FROM w) WHERE token <> '' AND token IN (SELECT token FROM tk))
SELECT concept, uses, CASE WHEN regexp_replace(concept, {_END}) IN (SELECT regexp_replace(name, {_END}) FROM {{classes}}) THEN 'live' WHEN concept IN (SELECT concept FROM pt) THEN 'partial' ELSE 'ghost' END AS state FROM w""")
def concept_ghosts(c):
    return S.concept_ghosts(c.functions, c.classes)


_BARE = "regexp_replace(CASE WHEN regexp_matches(trim(return_type), '^\\w+\\[.+\\]$') THEN regexp_extract(trim(return_type), '^\\w+\\[(.+)\\]$', 1) ELSE trim(return_type) END, '^[''\"]+|[''\"]+$', '', 'g')"
_NAMED = f"CASE WHEN {_BARE} <> '' AND NOT contains({_BARE}, ',') AND NOT regexp_matches({_BARE}, '^[a-z]') AND lower({_BARE}) NOT IN ('none', 'nonetype', 'any', 'object', 'str', 'string', 'int', 'float', 'bool', 'bytes', 'dict', 'list', 'tuple', 'set', 'frozenset', 'optional', 'union', 'type') THEN {_BARE} END"


@query(f"SELECT DISTINCT name, string_split(p, ':')[1] AS param, string_split(p, ':')[-1] AS wanted FROM (SELECT name, unnest(string_split(param_types, ',')) AS p FROM {{functions}} WHERE is_stub AND param_types <> '') WHERE string_split(p, ':')[-1] NOT IN (SELECT {_NAMED} FROM {{functions}} WHERE NOT is_stub AND {_NAMED} IS NOT NULL)")
def missing_bridges(c):
    return S.missing_bridges(c.functions)


_TOKENS = "list_filter(string_split(name, '_'), lambda t: t <> '')"
_STEP = "CASE WHEN {0} <= 0 THEN '0' WHEN {0} <= 1 THEN '1' WHEN {0} <= 3 THEN '2' WHEN {0} <= 8 THEN '3' ELSE '4' END"
_RETURNS = """CASE WHEN lower(trim(coalesce(return_type, ''))) IN ('', 'none', 'nonetype') THEN 'none' WHEN lower(trim(return_type)) = 'bool' THEN 'bool' WHEN lower(trim(return_type)) IN ('int', 'float') THEN 'numeric' WHEN lower(trim(return_type)) IN ('str', 'string') THEN 'str'
WHEN regexp_matches(lower(return_type), 'dict|mapping') THEN 'dict' WHEN regexp_matches(lower(return_type), 'list|sequence|iterable') THEN 'list' ELSE 'object' END"""


def _conventions(tests: str, most: str) -> str:
    return f"""ci AS (SELECT name, count(DISTINCT caller) AS n FROM (SELECT caller, unnest({SUFFIXES.replace('{c}', 'callee')}) AS name FROM {{edges}} WHERE callee IS NOT NULL) GROUP BY 1), co AS (SELECT caller AS name, count(DISTINCT callee) AS n FROM {{edges}} GROUP BY 1),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id DESC) AS r FROM {{all_functions}} WHERE NOT (starts_with(name, '__') AND ends_with(name, '__')) {tests}) WHERE r = 1),
f2 AS (SELECT f1.name, file_path, is_stub, {_TOKENS.replace('name', 'f1.name')} AS tk, {_STEP.format('coalesce(ci.n, 0)')} AS callers, {_STEP.format('coalesce(co.n, 0)')} AS callees, {_RETURNS} AS return_type, {_STEP.format("len(list_filter(string_split(coalesce(param_types, ''), ','), lambda p: p <> ''))")} AS param_count, CASE WHEN is_stub THEN 'stub' ELSE 'impl' END AS body_weight FROM f1 LEFT JOIN ci ON ci.name = f1.name LEFT JOIN co ON co.name = f1.name),
fm AS (SELECT *, 'prefix:' || tk[1] AS family FROM f2 WHERE len(tk) > 0 UNION ALL SELECT *, 'suffix:' || tk[-1] FROM f2 WHERE len(tk) > 0 AND tk[1] <> tk[-1]), sz AS (SELECT family, count(*) AS size FROM fm GROUP BY 1 HAVING count(*) >= 3),
vl AS (SELECT family, dimension, value, count(*) AS n FROM (SELECT family, unnest(['callers', 'callees', 'return_type', 'param_count', 'body_weight']) AS dimension, unnest([callers, callees, return_type, param_count, body_weight]) AS value FROM fm) GROUP BY ALL),
ag AS (SELECT vl.*, size, CASE dimension WHEN 'callers' THEN 's' WHEN 'callees' THEN 's' WHEN 'body_weight' THEN 'r' ELSE 't' END AS kind FROM vl JOIN sz USING (family) WHERE n >= 0.70 * size),
cn AS (SELECT family, size, string_agg(dimension || '=' || value, ',' ORDER BY dimension) AS canon FROM ag GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT kind) >= 2),
dv AS (SELECT fm.family, fm.name, string_agg(ag.dimension, ',' ORDER BY ag.dimension) FILTER (ag.value <> CASE ag.dimension WHEN 'callers' THEN callers WHEN 'callees' THEN callees WHEN 'return_type' THEN fm.return_type WHEN 'param_count' THEN param_count ELSE body_weight END) AS diverges, any_value(is_stub) AS is_stub FROM fm JOIN ag USING (family) WHERE family IN (SELECT family FROM cn) GROUP BY 1, 2),
cm AS (SELECT cn.family, size, canon, name, is_stub, coalesce(diverges, '') AS diverges FROM cn JOIN dv USING (family)), ok AS (SELECT family FROM cm GROUP BY family, size HAVING count(*) FILTER (diverges <> '') <= {most} * size)"""


_CONV = _conventions("AND NOT regexp_matches(lower(file_path), '/test.')", "0.40")


@query(f"WITH {_CONV} SELECT family, size, canon, count(*) FILTER (diverges <> '') AS outliers FROM cm WHERE family IN (SELECT family FROM ok) GROUP BY ALL")
def detect_conventions(c):
    return S.conventions(c.all_functions, c.edges)


@query(f"WITH {_CONV} SELECT name, family, diverges, is_stub FROM cm WHERE family IN (SELECT family FROM ok) AND diverges <> ''")
def convention_outliers(c):
    return S.convention_outliers(c.all_functions, c.edges)


_TEXTS = "(SELECT name AS t FROM {all_functions} UNION SELECT file_path FROM {all_functions} UNION SELECT name FROM {classes} UNION SELECT file_path FROM {classes})"
_MODAL_SQL = r"regexp_matches({0}, '(?i)\b(would|should|could|meant to|intended to|is supposed to|is meant to)\b')"
_WAITS_SQL = r"(regexp_matches({0}, '(?i)\b(will|to)\s+be\s+implemented\s+when\b') OR regexp_matches({0}, '(?i)\bimplemented\s+when\s+\w[\w\s]*\s+is\s+(built|ready|done|added|available)\b') OR regexp_matches({0}, '(?i)\bwhen\s+\w[\w\s]*\s+(is|are)\s+(built|ready|done|added|available|wired)\b') OR regexp_matches({0}, '(?i)\bonce\s+\w[\w\s]*\s+(is|are)\s+(built|ready|done|added|implemented)\b'))"
_ABSENT_SQL = r"(regexp_matches({0}, '(?i)(doesn[''’]t\s+(have|support|exist|include|implement)|don[''’]t\s+(have|support|use|exist|apply)|does\s+not\s+(have|support|exist|apply|belong)|do\s+not\s+(have|support|exist|apply)|not\s+(supported|applicable|part\s+of|used|present|implemented)\s+in|not\s+in\s+(this|the|our|og)\b)') OR regexp_matches({0}, '(?i)((no|zero)\s+\w+\s+in\s+(this|the|our|og)\b|(was|were|has\s+been|have\s+been)\s+(removed|deleted|dropped|eliminated)|concept\s+(removed|dropped|eliminated|deprecated)|always\s+returns?\s+(empty|none|null|false|zero|0|an?\s+empty))'))"
_REMOVED = f"(NOT {_WAITS_SQL.format('doc')} AND {_ABSENT_SQL.format('doc')})"
# The methods of a class's life are in the views' classes without a contract base, and set their state.
_JUDGED = f"""st AS (SELECT name, file_path, max(trim(coalesce(docstring, ''))) AS doc, min(body_shape) AS body FROM {{functions}} WHERE is_stub GROUP BY 1, 2), fc AS (SELECT file_path, arg_min(base_class, id) AS bc, arg_min(trim(coalesce(docstring, '')), id) AS cdoc, count(*) AS nc FROM {{classes}} GROUP BY 1),
s0 AS (SELECT st.*, coalesce(nc, 0) AS nc, name IN ('__init__') AND file_path LIKE '%.py' AS life, regexp_matches(coalesce(bc, ''), 'Protocol|ABC') AS cb, CASE WHEN doc = '' AND name IN ('__init__') AND file_path LIKE '%.py' THEN coalesce(cdoc, '') ELSE doc END AS tx FROM st LEFT JOIN fc USING (file_path)),
cp AS (SELECT name, file_path, unnest({_WORDS.replace('docstring', 'doc')}) AS concept FROM s0), cq AS (SELECT *, regexp_replace(concept, {_END}) AS b FROM cp), bs AS (SELECT DISTINCT b FROM cq),
bp AS (SELECT b, EXISTS (SELECT 1 FROM {_TEXTS} x WHERE contains(lower(t), lower(b))) AS there, EXISTS (SELECT 1 FROM {{fsm_artifacts}} WHERE kind IN ('fsm_state', 'fsm_action', 'fsm_guard') AND starts_with(lower(subject), lower(b) || '.')) AS fd, EXISTS (SELECT 1 FROM {{fsm_artifacts}} WHERE kind IN ('fsm_state', 'fsm_action', 'fsm_guard') AND contains(lower(subject), lower(b))) AS fn_ FROM bs),
cc AS (SELECT name, file_path, count(*) FILTER (NOT there) AS ab_, count(*) FILTER (there) AS th, bool_or(fd) AS fd, bool_or(fn_ AND NOT fd) AS fr_ FROM cq JOIN bp USING (b) GROUP BY 1, 2),
fi AS (SELECT file_path, name, is_stub, {_REMOVED} AS rm FROM (SELECT *, coalesce(docstring, '') AS doc FROM {{functions}})),
s1 AS (SELECT s0.*, coalesce(ab_, 0) > 0 AS absent, coalesce(th, 0) > 0 AS there, coalesce(fd, false) AS fd, coalesce(fr_, false) AS fr_, coalesce(callers, 0) AS callers, (SELECT count(*) FROM fi WHERE fi.file_path = s0.file_path AND is_stub AND fi.name <> s0.name) AS sib, (SELECT count(*) FROM fi WHERE fi.file_path = s0.file_path AND is_stub AND fi.name <> s0.name AND rm) AS sibr,
  {_WAITS_SQL.format('tx')} OR {_MODAL_SQL.format('tx')} AS intent, NOT {_WAITS_SQL.format('tx')} AND {_ABSENT_SQL.format('tx')} AS removal, CASE WHEN doc = '' THEN 'none' WHEN {_WAITS_SQL.format('doc')} OR {_MODAL_SQL.format('doc')} THEN 'behavioral' ELSE 'placeholder' END AS q,
  CASE WHEN nc = 0 THEN 'bag' WHEN nc >= 2 THEN 'multi' ELSE 'mixed' END AS ch, CASE WHEN regexp_matches(lower(file_path), '[.](json|yaml|yml|toml)$') THEN 'config' ELSE coalesce(body, 'unknown') END AS bo, contains(lower(file_path), '/test') OR regexp_matches(lower(file_path), '(^|/)test_[^/]*$') AS tf FROM s0 LEFT JOIN cc USING (name, file_path) LEFT JOIN cnt USING (name)),
s2 AS (SELECT *, bo <> 'config' AS late, callers > 0 AND NOT tf AS live, CASE WHEN sib > 0 THEN sibr / sib ELSE 0 END AS tr FROM s1),
s3 AS (SELECT name, file_path, callers,
  1.5::DOUBLE * removal::INT + 1.2::DOUBLE * (absent AND NOT there AND callers = 0)::INT + 0.5::DOUBLE * (absent AND NOT there AND callers > 0)::INT + 0.2::DOUBLE * (callers = 0)::INT + CASE WHEN late AND sib >= 3 AND tr >= 0.5 THEN 0.5::DOUBLE + tr::DOUBLE * 0.8::DOUBLE ELSE 0 END + 0.1::DOUBLE * (late AND ch = 'multi')::INT + 0.2::DOUBLE * (late AND q = 'placeholder')::INT AS r0,
  0.8::DOUBLE * (absent AND NOT there AND callers > 0)::INT + 1.0::DOUBLE * (absent AND there)::INT + 0.2::DOUBLE * live::INT + 1.0::DOUBLE * (live AND q IN ('none', 'placeholder') AND bo = 'empty_pass' AND NOT intent)::INT + 0.6::DOUBLE * (NOT late)::INT + 0.3::DOUBLE * (bo = 'trivial_return')::INT + 0.4::DOUBLE * (late AND sib >= 3 AND tr < 0.5)::INT + 0.4::DOUBLE * (late AND life AND NOT cb AND sib >= 3)::INT + 0.8::DOUBLE * (late AND fr_ AND NOT fd)::INT AS r1,
  1.2::DOUBLE * (intent AND NOT removal)::INT + 0.3::DOUBLE * (there AND NOT absent)::INT + CASE WHEN live THEN 0.3::DOUBLE * least(callers, 3) ELSE 0 END + 1.8::DOUBLE * (NOT late)::INT + 0.2::DOUBLE * (bo = 'trivial_return')::INT + 0.5::DOUBLE * (bo = 'raise_not_impl')::INT + 0.2::DOUBLE * (late AND sib >= 3 AND tr < 0.5)::INT + 0.1::DOUBLE * (late AND sib BETWEEN 1 AND 2)::INT + 1.5::DOUBLE * (late AND life AND cb)::INT + 0.3::DOUBLE * (late AND fd)::INT AS r2,
  greatest(0, 0.4::DOUBLE * (callers = 0)::INT + 0.5::DOUBLE * (callers > 0 AND tf)::INT + 0.2::DOUBLE * (bo = 'empty_pass')::INT + 0.15::DOUBLE * (late AND ch = 'bag')::INT + 0.3::DOUBLE * (late AND q = 'none')::INT - 0.5::DOUBLE * (late AND life AND cb)::INT) AS r3 FROM s2),
s4 AS (SELECT name, file_path, callers, round_even(least(r0 / 3.0::DOUBLE, 1.0::DOUBLE), 2) AS a, round_even(least(r1 / 3.0::DOUBLE, 1.0::DOUBLE), 2) AS b, round_even(least(r2 / 3.0::DOUBLE, 1.0::DOUBLE), 2) AS c, round_even(least(r3 / 3.0::DOUBLE, 1.0::DOUBLE), 2) AS d, greatest(r0, r1, r2, r3) / 3.0::DOUBLE >= 0.2::DOUBLE AS any_ FROM s3),
jd AS (SELECT name, file_path, callers, CASE WHEN NOT any_ THEN 'genuinely-unknown' WHEN a >= b AND a >= c AND a >= d THEN 'concept-not-applicable' WHEN b >= c AND b >= d THEN 'blocked-on-prerequisite' WHEN c >= d THEN 'design-intent-stated' ELSE 'genuinely-unknown' END AS reading, CASE WHEN any_ THEN greatest(a, b, c, d) ELSE 0.0 END AS score FROM s4)"""


@query(with_all(f", {_JUDGED} SELECT * FROM jd").replace(") ,", "),"))
def classify_stubs(c):
    return J.classify_stubs(c.all_functions, c.edges, c.classes, c.fsm_artifacts)


_RANKED = f""", {_JUDGED}, {_conventions('', '1.00')}, od AS (SELECT DISTINCT name FROM cm WHERE is_stub AND diverges <> ''),
rk AS (SELECT jd.name, jd.file_path, reading, score, round(callers * score + CASE position WHEN 'tail' THEN 5 WHEN 'middle' THEN 2 ELSE 0 END + CASE WHEN jd.name IN (SELECT name FROM od) THEN 3 ELSE 0 END, 4)::DOUBLE AS composite FROM jd LEFT JOIN pos ON pos.name = jd.name WHERE NOT regexp_matches(lower(jd.file_path), 'test.|.test'))"""


@query(with_all(_RANKED + " SELECT * FROM rk WHERE reading IN ('blocked-on-prerequisite', 'design-intent-stated') ORDER BY composite DESC, name, file_path LIMIT 20").replace(") ,", "),"))
def rank_stubs(c):
    """What to work on next."""
    return J.rank_stubs(c.all_functions, c.edges, c.classes, c.fsm_artifacts)


@query(with_all(_RANKED + " SELECT * FROM rk").replace(") ,", "),"))
def stub_gap_survey(c):
    """All stubs by reading."""
    return J.rank_stubs(c.all_functions, c.edges, c.classes, c.fsm_artifacts, "gap")


@query(with_all(_RANKED + " SELECT * FROM rk ORDER BY composite DESC, name, file_path LIMIT 3").replace(") ,", "),"))
def stub_perusal(c):
    return J.rank_stubs(c.all_functions, c.edges, c.classes, c.fsm_artifacts, "perusal")


@query(with_("SELECT fn.name, CASE WHEN is_stub THEN 'FAIL' WHEN callers IS NULL OR fn.name IN (SELECT caller FROM c WHERE callee_stub) THEN 'WARN' ELSE 'PASS' END AS verdict FROM fn LEFT JOIN cnt USING (name)"))
def verify_implementations(c):
    return S.verify_implementations(c.functions, c.edges)


@query(with_(", sc AS (SELECT caller AS name, count(*) AS n FROM c WHERE caller_stub AND callee_stub GROUP BY 1), ut AS (SELECT name, count(*) AS n FROM (SELECT DISTINCT name, string_split(p, ':')[-1] AS w FROM (SELECT name, unnest(string_split(param_types, ',')) AS p FROM {functions} WHERE is_stub AND param_types <> '')) WHERE w NOT IN (SELECT name FROM {classes}) GROUP BY name) SELECT fn.name, coalesce(sc.n, 0) AS stub_callees, coalesce(ut.n, 0) AS unknown_types, coalesce(sc.n, 0) = 0 AND coalesce(ut.n, 0) = 0 AS ready FROM fn LEFT JOIN sc USING (name) LEFT JOIN ut USING (name) WHERE is_stub").replace(") ,", "),"))
def readiness_check(c):
    return S.readiness(c.functions, c.edges, c.classes)


@query(with_all(", t AS (SELECT DISTINCT name, file_path, CASE WHEN http_route <> '' THEN 'explicit_http' WHEN is_tool THEN 'explicit_tool' WHEN (starts_with(name, '__') AND ends_with(name, '__')) OR starts_with(name, 'from_') OR starts_with(name, 'to_') OR name IN ('serialize', 'deserialize', 'encode', 'decode') OR regexp_matches(file_path, '[.](json|yaml|toml)$') THEN 'protocol' WHEN starts_with(name, 'test_') OR contains(file_path, '/test') THEN 'test' ELSE 'inferred' END AS tier FROM {functions}) SELECT * FROM t WHERE tier <> 'inferred' OR name NOT IN (SELECT name FROM k)").replace(") ,", "),"))
def entry_tiers(c):
    return S.entry_tiers(c.all_functions, c.edges)


@query(with_("SELECT q.name, coalesce(callers, 0) AS callers FROM (SELECT DISTINCT name FROM {functions} WHERE NOT is_stub AND param_types = '') q LEFT JOIN cnt USING (name)"))
def annotation_queue(c):
    return S.annotation_queue(c.functions, c.edges)


@query(with_("SELECT a.name, b.name AS sibling FROM fn a JOIN fn b ON b.file_path = a.file_path AND b.name <> a.name WHERE a.is_stub AND NOT b.is_stub"))
def stub_siblings(c):
    """Implemented functions in a stub's file."""
    return S.siblings(c.functions)


@query("SELECT file_path, name FROM {functions} WHERE docstring IS NULL OR docstring = '' UNION ALL SELECT file_path, name FROM {classes} WHERE docstring IS NULL OR docstring = ''")
def missing_docstrings(c):
    both = c.functions.select("file_path", "name", "docstring").unionByName(c.classes.select("file_path", "name", "docstring"))
    return both.filter("docstring IS NULL OR docstring = ''").select("file_path", "name")


@query(with_("SELECT fn.file_path, avg(n) AS mean_callees, count(*) AS functions FROM fn JOIN (SELECT caller AS name, count(*) AS n FROM c GROUP BY 1) x USING (name) GROUP BY fn.file_path"))
def neighbour_complexity(c):
    n = S.calls(c.functions, c.edges).groupBy(F.col("caller").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return S.by_name(c.functions).join(n, "name").groupBy("file_path").agg(F.avg("n").alias("mean_callees"), F.count(F.lit(1)).alias("functions"))


@query("SELECT name, count(*) AS definitions FROM {all_functions} GROUP BY name HAVING count(DISTINCT file_path) > 1")
def names_in_several_files(c):
    return c.all_functions.groupBy("name").agg(F.count(F.lit(1)).alias("definitions"), F.countDistinct("file_path").alias("f")).filter("f > 1").select("name", "definitions")
