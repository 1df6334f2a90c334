"""Queries of checks, contracts, summaries and the query algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import assess as A
from ..plans.algebra import Combine, Executor, Filter, Select
from ..plans.views import views_of
from .graphs import BUILTIN_LIST, HOTSPOTS, LAST
from .registry import query

_BUCKETS = "SELECT k.bucket, count(r.b) AS n FROM (VALUES ('project'), ('builtin'), ('classification_gap')) k(bucket) LEFT JOIN (SELECT CASE WHEN bucket IN ('project', 'builtin') THEN bucket ELSE 'classification_gap' END AS b FROM {refs}) r ON r.b = k.bucket GROUP BY k.bucket"


@query(_BUCKETS)
def bucket_summary(c):
    return A.bucket_summary(c.refs)


@query("SELECT count(*) AS reference_count, count(DISTINCT file_path) AS file_count FROM {refs}")
def reference_counts(c):
    return c.refs.agg(F.count(F.lit(1)).alias("reference_count"), F.countDistinct("file_path").alias("file_count"))


@query("SELECT file_path, count(*) AS refs, count(DISTINCT callee) AS callees, count(*) FILTER (callee IS NULL OR callee = '') AS missing FROM {refs} GROUP BY file_path")
def file_reference_map(c):
    return A.file_reference_map(c.refs)


@query(f"SELECT 'edge_count' AS metric, count(*) AS value FROM {{edges}} UNION ALL SELECT 'file_count', count(DISTINCT file_path) FROM {{refs}} UNION ALL SELECT 'reference_count', count(*) FROM {{refs}} UNION ALL SELECT 'bucket_' || bucket, n FROM ({_BUCKETS})")
def system_summary(c):
    return A.system_summary(c.refs, c.edges)


@query("""WITH e AS (SELECT caller, callee FROM {event_edges}) SELECT * FROM (SELECT 'error' AS severity, 'missing_caller' AS kind, count(*) FILTER (caller IS NULL OR caller = '') AS n FROM e UNION ALL SELECT 'error', 'missing_callee', count(*) FILTER (callee IS NULL OR callee = '') FROM e
UNION ALL SELECT 'warning', 'self_edge', count(*) FILTER (caller = callee) FROM e UNION ALL SELECT 'error', 'empty_graph', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM e UNION ALL SELECT 'warning', 'small_graph', CASE WHEN count(*) < 10 THEN 1 ELSE 0 END FROM e) WHERE n > 0""")
def validate_graph(c):
    return A.validate_graph(c.event_edges)


@query("SELECT 'null_caller' AS kind, count(*) FILTER (caller IS NULL) AS n FROM {refs} UNION ALL SELECT 'null_callee', count(*) FILTER (callee IS NULL) FROM {refs} UNION ALL SELECT 'edges_minus_refs', (SELECT count(*) FROM {edges}) - (SELECT count(*) FROM {refs})")
def integrity_check(c):
    return A.integrity(c.refs, c.edges)


@query("WITH a AS (SELECT DISTINCT caller, callee FROM {edges}), b AS (SELECT DISTINCT caller, callee FROM {refs}) SELECT 'only_first' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_second', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def structural_diff(c):
    return A.structural_diff(c.edges, c.refs)


@query("SELECT file_path, coalesce(a.n, 0) AS first, coalesce(b.n, 0) AS second FROM (SELECT file_path, count(*) AS n FROM {refs} GROUP BY 1) a FULL JOIN (SELECT caller_file AS file_path, count(*) AS n FROM {edges} GROUP BY 1) b USING (file_path) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def file_count_diff(c):
    return A.count_diff(c.refs, c.edges.withColumnRenamed("caller_file", "file_path"))


_DRIFT = "SELECT contract_name, count(*) AS n, CASE WHEN count(*) = 1 THEN 'transient' WHEN count(*) <= 3 THEN 'recurring' ELSE 'structural' END AS classification, arg_max(severity, seq) AS severity, arg_max(layer, seq) AS layer FROM {contract_reports} WHERE violation > 0 GROUP BY contract_name"


@query(_DRIFT)
def contract_drift(c):
    return A.drift(c.contract_reports)


_HISTORY = "SELECT file_path AS contract_name, CASE WHEN severity = 'error' THEN 'structural' WHEN violation > 0 THEN 'recurring' ELSE 'transient' END AS classification FROM {contract_reports}"
_HEALTH = f"""SELECT contract_name, n, round_even(greatest(0.0, 1 - (3 * s + 2 * r + t) / n / 5), 3) AS stability, CASE WHEN s > r THEN 'degrading' WHEN t > s AND r = 0 THEN 'improving' ELSE 'stable' END AS trend
FROM (SELECT contract_name, count(*) AS n, count(*) FILTER (classification = 'structural') AS s, count(*) FILTER (classification = 'recurring') AS r, count(*) FILTER (classification = 'transient') AS t FROM ({_HISTORY}) GROUP BY contract_name)"""


def _history(c):
    kind = F.when(F.col("severity") == "error", "structural").when(F.col("violation") > 0, "recurring").otherwise("transient")
    return c.contract_reports.select(F.col("file_path").alias("contract_name"), kind.alias("classification"))


@query(_HEALTH)
def contract_health(c):
    return A.health(_history(c))


@query(f"""SELECT contract_name, state, CASE state WHEN 'ACTIVE' THEN 'no action' WHEN 'STABLE' THEN 'monitor' WHEN 'DEGRADING' THEN 'investigate usage shift' WHEN 'UNSTABLE' THEN 'review contract definition' WHEN 'STALE' THEN 'insufficient signal' ELSE 'candidate for removal' END AS recommendation
FROM (SELECT contract_name, CASE WHEN stability > 0.85 AND trend = 'stable' THEN 'ACTIVE' WHEN stability >= 0.7 AND stability <= 0.85 THEN 'STABLE' WHEN trend = 'degrading' THEN 'DEGRADING' WHEN stability < 0.5 AND n > 5 THEN 'UNSTABLE' WHEN n <= 2 THEN 'STALE' ELSE 'OBSOLETE' END AS state FROM ({_HEALTH}))""")
def contract_lifecycle(c):
    return A.lifecycle(A.health(_history(c)))


@query("SELECT DISTINCT file_path, 'missing_reference' AS rule FROM {refs} WHERE caller IS NULL OR caller = '' OR callee IS NULL OR callee = '' UNION SELECT DISTINCT file_path, 'references_without_edges' FROM {refs} WHERE file_path NOT IN (SELECT caller_file FROM {edges} WHERE caller_file IS NOT NULL)")
def file_contracts(c):
    return A.file_contracts(c.refs, c.edges)


@query("SELECT file_path, sum(violation)::BIGINT AS violations, sum(violation) = 0 AS stable FROM {contract_reports} GROUP BY file_path")
def stability_view(c):
    return A.stability(c.contract_reports)


_ROLES = """SELECT file_path, bool_or(regexp_matches(t, 'scan|parse|ast|ingestion|scanner')) AS ingestion, bool_or(regexp_matches(t, 'classify|semantic|symbol|reference')) AS classification, bool_or(regexp_matches(t, 'graph|edge|node|builder')) AS graph,
bool_or(regexp_matches(t, 'sqlite|database|persist|insert|update')) AS persistence, bool_or(regexp_matches(t, 'report|summary|snapshot|json|print')) AS reporting FROM (SELECT file_path, lower(file_path || coalesce(' ' || callee, '')) AS t FROM {refs}) GROUP BY file_path"""


@query(_ROLES)
def responsibility_map(c):
    return A.responsibilities(c.refs)


@query(" UNION ALL ".join(f"SELECT '{r}' AS role, count(*) FILTER ({r}) AS files FROM ({_ROLES})" for r in ("ingestion", "classification", "graph", "persistence", "reporting")))
def responsibility_totals(c):
    return A.responsibility_totals(c.refs)


@query(f"""WITH p AS (SELECT DISTINCT {LAST.format('caller')} AS a, {LAST.format('callee')} AS b FROM {{edges}}), r AS (SELECT name, (SELECT count(*) FROM p WHERE b = f.name) AS i, (SELECT count(*) FROM p WHERE a = f.name) AS o FROM (SELECT DISTINCT name FROM {{functions}}) f)
SELECT name, CASE WHEN i >= 5 THEN 'hot' WHEN i = 0 AND o > 0 THEN 'entry' ELSE 'dead' END AS fact FROM r WHERE i >= 5 OR i = 0""")
def design_facts(c):
    return A.design_facts(c.functions, c.edges)


@query("SELECT 'functions' AS kind, count(*) FILTER (docstring <> '') AS documented, count(*) AS total FROM {functions} UNION ALL SELECT 'classes', count(*) FILTER (docstring <> ''), count(*) FROM {classes} UNION ALL SELECT 'mutations', count(*) FILTER (operation <> ''), count(*) FROM {mutations}")
def intent_coverage(c):
    return A.intent_coverage(c.functions, c.classes, c.mutations)


@query("SELECT file_path, name, docstring FROM {functions} WHERE docstring <> '' AND file_path LIKE '%mod3.py'")
def algebra_intent_filtered(c):
    """A Select with a filter through planner and executor."""
    return Executor(views_of(c)).execute(Select("INTENT", "functions", Filter("file_path", "endswith", "mod3.py")))


@query(f"SELECT 'hotspot' AS side, symbol AS item, degree AS n FROM ({HOTSPOTS}) WHERE degree > 3 UNION ALL SELECT 'unstable', file_path, v FROM (SELECT file_path, sum(violation)::BIGINT AS v FROM {{contract_reports}} GROUP BY file_path) WHERE v > 0")
def algebra_combined(c):
    """A Combine pairs two results; here they are put one under the other."""
    left, right = Executor(views_of(c)).execute(Combine(Select("STRUCTURE", "hotspots", Filter("hotspots", ">", 3)), Select("STABILITY", "unstable_contracts")))
    return left.select(F.lit("hotspot").alias("side"), F.col("symbol").alias("item"), F.col("degree").alias("n")).unionByName(right.select(F.lit("unstable").alias("side"), F.col("file_path").alias("item"), F.col("violations").alias("n")))


_ENVIRONMENT = "(SELECT DISTINCT regexp_replace(name, '^.*[.]', '') FROM {functions} WHERE is_tool OR id % 3 = 0)"


@query(f"""SELECT name, bucket, count(*) AS n FROM (SELECT callee AS name, CASE WHEN regexp_replace(callee, '^.*[.]', '') IN {_ENVIRONMENT} THEN 'project' WHEN regexp_replace(callee, '^.*[.]', '') IN ({BUILTIN_LIST}) THEN 'builtin'
WHEN string_split(callee, '.')[1] IN ('os', 'sys', 're', 'json') THEN 'stdlib' WHEN line_number % 5 = 0 THEN 'runtime' ELSE 'unknown' END AS bucket FROM (SELECT callee, line_number FROM {{refs}} WHERE callee IS NOT NULL UNION ALL SELECT module, line_number FROM {{imports}})) GROUP BY 1, 2""")
def classify_references(c):
    """References and imports by class; a name is the project's if it ends in one of its symbols."""
    own = c.functions.filter("is_tool OR id % 3 = 0").select(N.after_last_dot("name").alias("leaf")).distinct().withColumn("own", F.lit(True))
    rows = c.refs.filter("callee IS NOT NULL").select(F.col("callee").alias("name"), "line_number").unionByName(c.imports.select(F.col("module").alias("name"), "line_number"))
    rows = rows.withColumn("leaf", N.after_last_dot("name")).join(own, "leaf", "left")
    kind = N.symbol_class("name", F.col("own"), F.when(F.col("line_number") % 5 == 0, "alias"))
    return rows.select("name", kind.alias("bucket")).groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT role, count(*) AS n FROM (SELECT CASE WHEN s IS NULL OR s = '' THEN 'unknown' WHEN lower(s) = 'print' THEN 'runtime_noise' WHEN lower(s) IN ('str', 'sum', 'len') THEN 'builtin_primitive' WHEN lower(s) = 'exec' THEN 'runtime_execution' WHEN starts_with(lower(s), 'test_') THEN 'test_code'
WHEN starts_with(s, '<') THEN 'runtime_artifact' WHEN contains(s, '.') THEN 'qualified_reference' WHEN regexp_matches(s, '^[A-Z]') THEN 'type_or_class' ELSE 'general_symbol' END AS role FROM (SELECT callee AS s FROM {refs} UNION ALL SELECT name FROM {classes})) GROUP BY role""")
def semantic_roles(c):
    names = c.refs.select(F.col("callee").alias("s")).unionByName(c.classes.select(F.col("name").alias("s")))
    return names.groupBy(N.semantic_role("s").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT *, CASE WHEN contracts > 0 THEN unstable / contracts ELSE 0.0 END AS ratio FROM {policy_states}),
r AS (SELECT id, CASE WHEN has_cycles THEN 0.35 ELSE 0 END AS a, least(errors * 0.08, 0.40) AS b, ratio * 0.40 AS c, CASE WHEN edges / greatest(files, 1) > 20 THEN 0.10 ELSE 0 END AS d, CASE WHEN top_degree > 50 THEN 0.10 ELSE 0 END AS e, CASE WHEN role_files = 0 THEN 0.05 ELSE 0 END AS f,
CASE WHEN intent IS NULL THEN 0 WHEN seed_count = 0 THEN 0.25 WHEN seed_count <= 3 THEN 0.10 ELSE 0 END AS g, CASE WHEN intent IS NOT NULL AND expanded_count / greatest(seed_count, 1) < 2.0 THEN 0.10 ELSE 0 END AS h, CASE WHEN intent IN ('debug_query', 'general_query') THEN 0.10 ELSE 0 END AS i,
'INTEGRITY' || CASE WHEN has_cycles THEN ',STRUCTURE' ELSE '' END || CASE WHEN ratio > 0.30 THEN ',STABILITY' ELSE '' END || CASE WHEN top_degree > 50 THEN ',SUMMARY' ELSE '' END AS surfaces FROM t)
SELECT id, round(a::DOUBLE + b::DOUBLE + c::DOUBLE + d::DOUBLE + e::DOUBLE + f::DOUBLE, 6) AS corpus_risk, round(g::DOUBLE + h::DOUBLE + i::DOUBLE, 6) AS query_risk, round(greatest(0.0, least(1.0, a::DOUBLE + b::DOUBLE + c::DOUBLE + d::DOUBLE + e::DOUBLE + f::DOUBLE + g::DOUBLE + h::DOUBLE + i::DOUBLE)), 6) AS severity, surfaces FROM r""")
def epistemic_policy(c):
    """Risk of many states of a corpus and a question."""
    rows = A.epistemic_risk(c.policy_states)
    add = lambda names: F.round(sum((F.col(f"risk_{k}") for k in names[1:]), F.col(f"risk_{names[0]}")), 6)
    return rows.select("id", add(A.RISK_TERMS[:6]).alias("corpus_risk"), add(A.RISK_TERMS[6:]).alias("query_risk"), F.round("severity", 6).alias("severity"), "surfaces")


@query("""SELECT CASE WHEN caller IS NULL OR callee IS NULL OR caller = '' OR callee = '' THEN 'unknown' WHEN caller LIKE 'test\\_%' ESCAPE '\\' THEN 'test_execution' WHEN caller LIKE '<%' THEN 'runtime_execution' WHEN contains(callee, '.') THEN 'module_dependency' WHEN regexp_matches(callee, '^[A-Z]') THEN 'type_usage' ELSE 'function_call' END AS role, count(*) AS n FROM {refs} GROUP BY 1""")
def edge_roles(c):
    return c.refs.groupBy(N.edge_role("caller", "callee").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_path, name, line_number FROM {functions} WHERE is_stub ORDER BY file_path, line_number, name")
def find_stubs(c):
    return c.functions.filter("is_stub").select("file_path", "name", "line_number")


@query("SELECT array_to_string(string_split(file_path, '/')[1:2], '/') AS module, count(*) AS files, min(file_path) AS first_file, sum(line_count)::BIGINT AS lines FROM {files} GROUP BY 1")
def find_modules(c):
    return c.files.groupBy(N.parent_directory("file_path").alias("module")).agg(F.count(F.lit(1)).alias("files"), F.min("file_path").alias("first_file"), F.sum("line_count").alias("lines"))


@query("SELECT file_path, role, line_count FROM {files} WHERE contains(lower(file_path), 'src1/') AND role = 'en' ORDER BY file_path LIMIT 50")
def find_files(c):
    return c.files.filter(F.lower("file_path").contains("src1/") & (F.col("role") == "en")).select("file_path", "role", "line_count").orderBy("file_path").limit(50)


@query("SELECT name, min(file_path) AS file_path, count(*) AS definitions, count(DISTINCT file_path) AS files FROM {functions} GROUP BY name")
def symbol_index(c):
    return c.functions.groupBy("name").agg(F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("definitions"), F.countDistinct("file_path").alias("files"))


@query(f"""WITH forms AS (SELECT DISTINCT name, 'surface' AS name_type FROM (SELECT callee AS name FROM {{edges}}) UNION SELECT DISTINCT {LAST.format('callee')}, 'bare' FROM {{edges}} WHERE {LAST.format('callee')} <> callee) SELECT name_type, count(*) AS n FROM forms GROUP BY name_type""")
def symbol_name_forms(c):
    forms = c.edges.select(F.explode(N.name_forms("callee")).alias("f")).select("f.*").distinct()
    return forms.groupBy("name_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_path, count(*) AS n_functions, count(*) FILTER (is_stub) AS stubs, min(line_number) AS first_line, string_agg(name, ',' ORDER BY line_number, name) AS names FROM {functions} GROUP BY file_path")
def file_analysis(c):
    """Everything of a file put together, for all files."""
    rows = F.sort_array(F.collect_list(F.struct("line_number", "name")))
    return c.functions.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_functions"), F.count_if("is_stub").alias("stubs"), F.min("line_number").alias("first_line"), F.array_join(F.transform(rows, lambda r: r["name"]), ",").alias("names"))


@query("""SELECT DISTINCT i.file_path AS from_file, f.file_path AS to_file FROM {imports} i JOIN (SELECT DISTINCT file_path, replace(regexp_replace(file_path, '[.][^./]*$', ''), '/', '.') AS module FROM {functions}) f USING (module)""")
def import_graph(c):
    modules = c.functions.select("file_path").distinct().select(F.col("file_path").alias("to_file"), N.module_name("file_path").alias("module"))
    return c.imports.join(modules, "module").select(F.col("file_path").alias("from_file"), "to_file").distinct()


@query("""SELECT file_path, 'critical' AS level FROM (SELECT DISTINCT file_path, replace(regexp_replace(file_path, '[.][^./]*$', ''), '/', '.') AS module FROM {functions}) WHERE module NOT IN (SELECT module FROM {imports}) AND file_path IN (SELECT file_path FROM {classes} WHERE base_class IN ('ABC', 'Protocol'))
UNION ALL SELECT file_path, 'isolated' FROM (SELECT DISTINCT file_path, replace(regexp_replace(file_path, '[.][^./]*$', ''), '/', '.') AS module FROM {functions}) WHERE module NOT IN (SELECT module FROM {imports}) AND file_path NOT IN (SELECT file_path FROM {classes} WHERE base_class IN ('ABC', 'Protocol'))""")
def isolated_modules(c):
    own = c.functions.select("file_path").distinct().withColumn("module", N.module_name("file_path"))
    free = own.join(c.imports.select("module").distinct(), "module", "left_anti")
    abstract = c.classes.filter("base_class IN ('ABC', 'Protocol')").select("file_path").distinct().withColumn("level", F.lit("critical"))
    return free.join(abstract, "file_path", "left").select("file_path", F.coalesce("level", F.lit("isolated")).alias("level"))


@query("SELECT file_path, bool_or(n >= 3) AS is_hot FROM (SELECT f.file_path, f.name, count(DISTINCT caller) AS n FROM {functions} f LEFT JOIN (SELECT caller, callee AS name FROM {edges} UNION SELECT caller, regexp_replace(callee, '^[^.]*[.]', '') FROM {edges}) e USING (name) GROUP BY 1, 2) GROUP BY file_path")
def hot_files(c):
    """A file is hot if it defines a symbol with three distinct callers, by its name or what follows its first dot."""
    keys = c.edges.select("caller", F.explode(F.array("callee", N.after_first_dot("callee"))).alias("name")).distinct()
    counts = keys.groupBy("name").agg(F.countDistinct("caller").alias("n"))
    return c.functions.join(counts, "name", "left").groupBy("file_path").agg(F.bool_or(F.coalesce(F.col("n") >= 3, F.lit(False))).alias("is_hot"))


@query("SELECT 'total_files' AS what, count(DISTINCT file_path) AS n FROM {contract_reports} UNION ALL SELECT 'total_violations', sum(violation)::BIGINT FROM {contract_reports} UNION ALL SELECT 'contract:' || contract_name, sum(violation)::BIGINT FROM {contract_reports} WHERE violation > 0 GROUP BY contract_name")
def summarize_reports(c):
    return A.summarize_reports(c.contract_reports)


@query("""SELECT 'error' AS severity, 'Invalid symbol reference at line ' || CAST(line_number AS VARCHAR) AS message, count(*) AS n FROM {refs} WHERE coalesce(caller, '') = '' OR coalesce(callee, '') = '' GROUP BY 2 UNION ALL SELECT 'error', 'Contract violated: ' || contract_name, count(*) FROM {contract_reports} WHERE violation > 0 AND severity = 'error' GROUP BY 2
UNION ALL SELECT 'error', 'Graph has zero edges', 1 FROM (SELECT count(*) AS k FROM {edges} WHERE line_number = 99) WHERE k = 0 UNION ALL SELECT 'warning', 'Low edge count detected', 1 FROM (SELECT count(*) AS k FROM {edges} WHERE line_number = 99) WHERE k < 10""")
def validate_system(c):
    """References and contracts, and a graph that lost its edges."""
    return A.validate_system(c.refs, c.edges.filter("line_number = 99"), c.contract_reports)


_PLACE = "CASE {0} WHEN 'project' THEN 1 WHEN 'builtin' THEN 2 WHEN 'stdlib' THEN 3 WHEN 'runtime' THEN 4 WHEN 'unknown' THEN 5 ELSE 6 END"


@query(f"""SELECT a, b, CASE WHEN {_PLACE.format('b')} < {_PLACE.format('a')} THEN b ELSE a END AS winner, count(*) AS n FROM (SELECT coalesce(bucket, 'classification_gap') AS a, CASE line_number WHEN 1 THEN 'project' WHEN 2 THEN 'stdlib' WHEN 3 THEN 'runtime' WHEN 4 THEN 'external_lib' ELSE 'unknown' END AS b FROM {{refs}}) GROUP BY ALL""")
def bucket_priority(c):
    n = F.col("line_number")
    other = F.when(n == 1, "project").when(n == 2, "stdlib").when(n == 3, "runtime").when(n == 4, "external_lib").otherwise("unknown")
    rows = c.refs.select(A.checked_bucket(F.coalesce("bucket", F.lit("classification_gap"))).alias("a"), A.checked_bucket(other).alias("b"))
    return rows.select("a", "b", A.stronger_bucket("a", "b").alias("winner")).groupBy("a", "b", "winner").agg(F.count(F.lit(1)).alias("n"))


_SNAPSHOT = f"""SELECT 'edge_count' AS metric, count(*) AS value FROM {{edges}} UNION ALL SELECT 'file_count', count(DISTINCT file_path) FROM {{refs}} UNION ALL SELECT 'reference_count', count(*) FROM {{refs}} UNION ALL SELECT 'bucket_' || bucket, n FROM ({_BUCKETS}) UNION ALL SELECT 'functions', count(*) FROM {{functions}}
UNION ALL SELECT 'stubs', count(*) FROM {{functions}} WHERE is_stub UNION ALL SELECT 'classes', count(*) FROM {{classes}} UNION ALL SELECT 'violations', sum(violation)::BIGINT FROM {{contract_reports}}"""


@query(_SNAPSHOT)
def evaluation_snapshot(c):
    return A.snapshot(c.refs, c.edges, c.functions, c.classes, c.contract_reports)


@query(f"WITH a AS ({_SNAPSHOT}), b AS ({_SNAPSHOT.replace('{functions}', '{all_functions}')}) SELECT metric, a.value AS first, b.value AS second, b.value - a.value AS change FROM a JOIN b USING (metric) WHERE a.value <> b.value")
def snapshot_changes(c):
    """What more functions change."""
    make = lambda functions: A.snapshot(c.refs, c.edges, functions, c.classes, c.contract_reports)
    return A.snapshot_diff(make(c.functions), make(c.all_functions))


@query("""SELECT query_id, intent, CASE intent WHEN 'impact_query' THEN 'STRUCTURE beside INTEGRITY' WHEN 'reverse_query' THEN 'STRUCTURE beside INTEGRITY' WHEN 'surface_query' THEN 'STRUCTURE beside STABILITY' WHEN 'general_query' THEN 'STABILITY beside INTEGRITY'
WHEN 'role_query' THEN CASE WHEN regexp_matches(raw_query, '[.]py$') THEN 'ROLE.files where file_path endswith ' || chr(39) || regexp_extract(raw_query, '[^ ]+[.]py$') || chr(39) ELSE 'ROLE' END ELSE 'STRUCTURE' END AS plan
FROM (SELECT query_id, raw_query, CASE query_id % 13 WHEN 0 THEN 'impact_query' WHEN 1 THEN 'impact_query' WHEN 2 THEN 'reverse_query' WHEN 3 THEN 'reverse_query' WHEN 4 THEN 'surface_query' WHEN 5 THEN 'debug_query' WHEN 6 THEN 'debug_query' WHEN 7 THEN 'mutation_query' WHEN 8 THEN 'mutation_query'
WHEN 9 THEN 'role_query' WHEN 10 THEN 'role_query' WHEN 11 THEN 'mutation_query' ELSE 'general_query' END AS intent FROM (SELECT query_id, raw_query || CASE WHEN query_id % 2 = 0 THEN ' in pkg/m.py' ELSE '' END AS raw_query FROM {questions}))""")
def compiled_queries(c):
    """Questions compiled to queries of the algebra."""
    from ..plans.algebra import compiled_plans

    return compiled_plans(c.questions.withColumn("raw_query", F.concat("raw_query", F.when(F.col("query_id") % 2 == 0, " in pkg/m.py").otherwise(""))))


_NAMES = "SELECT DISTINCT callee AS name FROM {refs} UNION SELECT DISTINCT module FROM {imports} UNION SELECT DISTINCT callee FROM {edges}"


@query(f"""WITH b AS (SELECT 'mod' || CAST(n_nationkey AS VARCHAR) AS variable, min('svc' || CAST(n_regionkey AS VARCHAR) || '.run') AS bound_to FROM {{nation}} WHERE n_nationkey < 4 GROUP BY 1 UNION ALL SELECT 'self.mod5', 'vendor.call_7'), pl AS (SELECT DISTINCT regexp_replace(name, '^.*(::|[.])', '') AS leaf FROM {{functions}} WHERE id % 3 = 0),
n AS ({_NAMES}), k AS (SELECT name, max(len(string_split(variable, '.'))) AS l FROM n JOIN b ON name = variable OR starts_with(name, variable || '.') GROUP BY 1), r AS (SELECT n.name, CASE WHEN n.name IN (SELECT variable FROM b) THEN (SELECT bound_to FROM b WHERE variable = n.name) WHEN n.name IN (SELECT bound_to FROM b) THEN n.name
 WHEN l IS NOT NULL THEN (SELECT bound_to FROM b WHERE (variable = n.name OR starts_with(n.name, variable || '.')) AND len(string_split(variable, '.')) = l) END AS bound_to FROM n LEFT JOIN k ON k.name = n.name)
SELECT name, type, CASE WHEN type = 'runtime' THEN bound_to END AS bound_to FROM (SELECT *, CASE WHEN name IS NULL OR name = '' THEN 'unknown' WHEN string_split(name, '.')[1] IN ({BUILTIN_LIST}) THEN 'builtin' WHEN bound_to IS NOT NULL THEN 'runtime' WHEN string_split(name, '.')[1] IN ('os', 'sys', 're', 'json') THEN 'stdlib'
WHEN regexp_replace(name, '^.*(::|[.])', '') IN (SELECT leaf FROM pl) THEN 'project' WHEN contains(name, '.') THEN 'external' ELSE 'unknown' END AS type FROM r)""")
def resolve_symbol_types(c):
    """Names by what they resolve to, with bindings of variables."""
    from ..operators.resolve import resolve_types

    names = c.refs.select(F.col("callee").alias("name")).unionByName(c.imports.select(F.col("module").alias("name"))).unionByName(c.edges.select(F.col("callee").alias("name")))
    bindings = c.nation.filter("n_nationkey < 4").select(F.concat(F.lit("mod"), F.col("n_nationkey").cast("string")).alias("variable"), F.concat(F.lit("svc"), F.col("n_regionkey").cast("string"), F.lit(".run")).alias("bound_to"))
    bindings = bindings.unionByName(c.spark.createDataFrame([("self.mod5", "vendor.call_7")], "variable string, bound_to string"))
    return resolve_types(names, bindings, c.functions.filter("id % 3 = 0").select(F.col("name").alias("symbol")))
