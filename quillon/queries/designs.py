"""Queries of design documents, sentences and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as D
from ..operators import text as X
from .registry import query

_MODAL = r"'(?i)\b(must not|must|shall not|shall|may not|never|required to|forbidden|prohibited|always|cannot|will not|is required)\b'"
_ACTION = r"'(?i)\b(ensure|enforce|require|restrict|allow|prevent|provide|handle|validate|check|guarantee|return|accept|reject|maintain|store|expose|protect|support|initialize|manage)\b'"
_AUTHORITY = r"'(?i)\b(layer|boundary|authority|system|component|module|interface|contract|engine|controller|manager)\b'"
_CONSTRAINT = r"'(?i)\b(must not|must|may not|shall not|shall|never|forbidden|only|required|invariant|non-negotiable|always|prohibited|cannot|will not)\b'"
_SENT = r"""ls AS (SELECT doc_id, unnest(range(0, len(l))) AS n, trim(unnest(l)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {design_docs})),
st AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace(regexp_replace(line, '^[-*•]\s+', ''), '^\d+[.)]\s+', ''), '^[a-zA-Z][.)]\s+', '')) AS sentence FROM ls WHERE NOT regexp_matches(line, '^#+\s')),
se AS (SELECT * FROM st WHERE length(sentence) >= 10)"""
_CLASS = f"CASE WHEN regexp_matches(sentence, {_MODAL}) THEN 'modal' WHEN regexp_matches(sentence, '^(\\d+|[a-zA-Z])[.)]\\s+') THEN 'numbered' WHEN regexp_matches(sentence, '^[-*•]\\s+') THEN 'bullet' WHEN regexp_matches(sentence, ':\\s+[A-Z]') OR regexp_matches(sentence, {_AUTHORITY}) THEN 'authoritative_prose' ELSE 'prose' END"


@query(f"WITH {_SENT} SELECT class, count(*) AS n FROM (SELECT {_CLASS} AS class FROM se) GROUP BY class")
def sentence_classes(c):
    return X.sentences(c.design_docs).select(X.structure_class("sentence").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_TOLD = f"SELECT doc_id, s AS sentence FROM (SELECT doc_id, trim(regexp_replace(line, '^[-•*]+', '')) AS s FROM ls) WHERE length(s) >= 10 AND regexp_matches(s, {_CONSTRAINT})"


@query(f"WITH {_SENT} {_TOLD}")
def constraint_sentences(c):
    return X.constraint_sentences(c.design_docs)


_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_PLAIN = _WORDS.format("lower(regexp_replace(sentence, '[^\\w\\s]', '', 'g'))")
_KIND = """CASE WHEN w IN ('must', 'shall', 'never', 'required', 'forbidden', 'prohibited', 'cannot', 'always') THEN 'MOD' WHEN w IN ('layer', 'boundary', 'authority', 'system', 'component', 'module', 'interface', 'contract', 'engine', 'controller', 'manager', 'service', 'handler') THEN 'AUT'
WHEN w IN ('ensure', 'enforce', 'require', 'restrict', 'allow', 'prevent', 'provide', 'handle', 'validate', 'check', 'guarantee', 'return', 'accept', 'reject', 'maintain', 'store', 'expose', 'protect', 'support', 'initialize', 'manage') THEN 'VRB' WHEN regexp_full_match(w, '[0-9]+') THEN 'NUM' WHEN length(w) >= 4 THEN 'WRD' END"""
_FEATURES = ("m", "v", "c", "a", "sh", "lo", "u")
_SUM = " + ".join


@query(f"""WITH {_SENT}, td AS (SELECT DISTINCT doc_id, regexp_replace(lower(trim(sentence)), '\\s+', ' ', 'g') AS norm FROM ({_TOLD})), sd AS (SELECT se.*, (doc_id, regexp_replace(lower(trim(sentence)), '\\s+', ' ', 'g')) IN (SELECT (doc_id, norm) FROM td) AS seed FROM se),
ft AS (SELECT *, regexp_matches(sentence, {_MODAL}) AS m, regexp_matches(sentence, {_ACTION}) AS v, regexp_matches(sentence, ':\\s+[A-Z]') AS c, regexp_matches(sentence, {_AUTHORITY}) AS a, len({_WORDS.format('sentence')}) <= 20 AS sh, len({_WORDS.format('sentence')}) > 40 AS lo, regexp_matches(sentence, '^[A-Z]') AS u, {_CLASS} AS class, {_PLAIN} AS w FROM sd),
al AS (SELECT doc_id, {', '.join(f'bool_and({x}) AS e{x}, bool_or({x}) AS o{x}' for x in _FEATURES)} FROM ft WHERE seed GROUP BY 1), it AS (SELECT doc_id, {', '.join(f'CASE WHEN {" OR ".join("e" + y for y in _FEATURES)} THEN e{x} ELSE o{x} END AS i{x}' for x in _FEATURES)} FROM al),
fca AS (SELECT doc_id, n FROM ft JOIN it USING (doc_id) WHERE NOT seed AND {_SUM(f'(i{x} AND {x})::INT' for x in _FEATURES)} >= greatest(2, {_SUM(f'i{x}::INT' for x in _FEATURES)} - 2)),
cl AS (SELECT doc_id, class, count(*) AS k FROM ft GROUP BY 1, 2 HAVING bool_or(seed)), bc AS (SELECT doc_id, class FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, class) AS r FROM cl) WHERE r = 1), mdl AS (SELECT doc_id, n FROM ft JOIN bc USING (doc_id, class) WHERE NOT seed),
pr AS (SELECT doc_id, n, seed, w[1:3] AS p1, w[greatest(len(w) - 2, 1):] AS p2, len(w) // 5 AS p3, m AS p4, coalesce(w[1], '') AS p5 FROM ft),
wrapper AS (SELECT DISTINCT x.doc_id, x.n FROM pr x JOIN pr y ON x.doc_id = y.doc_id AND NOT x.seed AND y.seed WHERE (x.p1 = y.p1)::INT + (x.p2 = y.p2)::INT + (x.p3 = y.p3)::INT + (x.p4 = y.p4)::INT + (x.p5 = y.p5)::INT >= 3),
ks AS (SELECT doc_id, n, seed, list_filter(list_transform(w, lambda w: {_KIND}), lambda k: k IS NOT NULL) AS s FROM ft), gr AS (SELECT DISTINCT doc_id, n, seed, array_to_string(s[i:i + d - 1], ' ') AS g FROM (SELECT ks.*, d, unnest(range(1, len(s) - d + 2)) AS i FROM ks, (VALUES (1), (2), (3)) v(d))),
ac AS (SELECT DISTINCT doc_id, g FROM gr WHERE seed), en AS (SELECT doc_id FROM ac GROUP BY 1 HAVING count(*) >= 2), grammar AS (SELECT gr.doc_id, n FROM gr JOIN ac USING (doc_id, g) WHERE NOT seed AND gr.doc_id IN (SELECT doc_id FROM en) GROUP BY 1, 2 HAVING count(*) >= 2 AND bool_or(contains(g, ' '))),
hh AS (SELECT doc_id, n, 1 AS o, 'fca' AS me FROM fca UNION ALL SELECT doc_id, n, 2, 'mdl' FROM mdl UNION ALL SELECT doc_id, n, 3, 'wrapper' FROM wrapper UNION ALL SELECT doc_id, n, 4, 'grammar' FROM grammar)
SELECT doc_id, n, any_value(sentence) AS sentence, string_agg(me, ',' ORDER BY o) AS methods, CASE WHEN count(*) >= 2 THEN 'discriminant' ELSE 'review' END AS tier FROM hh JOIN se USING (doc_id, n) GROUP BY doc_id, n""")
def induced_sentences(c):
    """Sentences that four passes find to be like a document's rules."""
    return X.induced(c.design_docs).withColumn("n", F.col("n").cast("long"))


_SIGNALS = {
    "changelog": ("changelog", "change log", "release notes", "history", "## [", "### ["), "readme": ("readme", "# getting started", "## installation", "## usage", "## quickstart"),
    "design": ("design", "architect", "constitution", "constraint", "invariant", "authority", "must not", "shall not", "intent", "principles"), "notes": ("notes", "scratchpad", "todo", "brainstorm", "ideas")}
_SCORES = ", ".join(_SUM(f"3 * contains(nl, '{s}')::INT + contains(tl, '{s}')::INT" for s in signals) + f" AS k{k}" for k, signals in enumerate(_SIGNALS.values()))
_CATALOGUE = f"""fs AS (SELECT file_path, text, string_split(text, chr(10)) AS l, string_split(file_path, '/') AS ps, string_split(file_path, '/')[-1] AS nm FROM {{design_docs}}),
fd AS (SELECT *, lower(nm) AS nl, lower(substr(text, 1, 3000)) AS tl FROM fs WHERE len(list_filter(ps, lambda p: starts_with(p, '.') OR p IN ('node_modules', 'dist', 'build', 'vendor', 'lib', 'bin', 'archive', 'external'))) = 0 AND regexp_matches(lower(nm), '[.](md|rst|txt|adoc)$')),
fk AS (SELECT *, {_SCORES} FROM fd), fc AS (SELECT file_path, text, upper(nm) AS up, CASE WHEN greatest(k0, k1, k2, k3) = 0 THEN 'unknown' WHEN k0 >= greatest(k1, k2, k3) THEN 'changelog' WHEN k1 >= greatest(k2, k3) THEN 'readme' WHEN k2 >= k3 THEN 'design' ELSE 'notes' END AS doc_type,
 len(list_filter(l, lambda x: regexp_matches(x, '^#{{1,4}}\\s+.'))) AS heading_count, round_even(len(list_filter(l, lambda x: regexp_matches(x, {_CONSTRAINT}))) / len(l), 3) AS constraint_score FROM fk),
ca AS (SELECT file_path, doc_type, heading_count, constraint_score, CASE WHEN constraint_score >= 0.12 OR regexp_matches(up, 'CONSTITUTION|CONSTRAINTS|INVARIANT') THEN 'authoritative' WHEN constraint_score >= 0.05 OR (doc_type = 'design' AND regexp_matches(up, 'DESIGN|ARCHITECTURE|SPEC|ASPIRATIONAL|SYSTEM')) THEN 'high' WHEN doc_type = 'readme' OR constraint_score >= 0.01 THEN 'medium' ELSE 'low' END AS confidence, text FROM fc)"""


@query(f"WITH {_CATALOGUE} SELECT file_path, doc_type, heading_count, constraint_score, confidence FROM ca")
def discover_docs(c):
    return D.catalogue(c.design_docs).drop("text")


_SUBJECT = """CASE WHEN heading = '' THEN regexp_replace(string_split(file_path, '/')[-1], '[.][^.]*$', '') WHEN len(ws) = 0 THEN substr(heading, 1, 40) WHEN regexp_matches(ws[1], '^[A-Z][a-z]+[A-Z]') THEN ws[1] ELSE lower(trim(regexp_replace(array_to_string(CASE WHEN len(mw) > 0 THEN mw[1:3] ELSE ws[1:3] END, '_'), '[^a-zA-Z0-9]+', '_', 'g'), '_')) END"""
_RULES = f"""ln AS (SELECT file_path, confidence, unnest(range(0, len(l))) AS n, unnest(l) AS line FROM (SELECT file_path, confidence, string_split(text, chr(10)) AS l FROM ca)), lh AS (SELECT *, regexp_matches(line, '^#{{1,4}}\\s+.') AS h FROM ln), sx AS (SELECT *, sum(h::INT) OVER (PARTITION BY file_path ORDER BY n)::BIGINT AS section FROM lh),
sb AS (SELECT file_path, confidence, section, coalesce(max(CASE WHEN h THEN trim(regexp_extract(line, '^#{{1,4}}\\s+(.+)', 1)) END), '') AS heading, list(line ORDER BY n) FILTER (NOT h) AS l FROM sx GROUP BY 1, 2, 3),
sy AS (SELECT *, trim(array_to_string(l, chr(10)), chr(10) || ' ') AS body FROM sb WHERE l IS NOT NULL), sz AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[-•*]+', ''))), lambda x: length(x) >= 10 AND regexp_matches(x, {_CONSTRAINT})) AS t0 FROM sy WHERE body <> ''),
su AS (SELECT *, list_filter(t0, lambda x, i: list_position(list_transform(t0, lambda y: lower(y)), lower(x)) = i)[1:8] AS t, trim(string_split(replace(trim(regexp_replace(heading, '^[A-Za-z]{{0,2}}\\d*\\.\\s*', '')), '(', ':'), ':')[1]) AS hh FROM sz),
sv AS (SELECT *, {_WORDS.format('hh')} AS ws, list_filter({_WORDS.format('hh')}, lambda w: lower(w) NOT IN ('the', 'a', 'an', 'of', 'for', 'in', 'on', 'at', 'to', 'and')) AS mw, CASE WHEN heading <> '' THEN '[' || heading || '] ' ELSE '' END || CASE WHEN len(t) > 0 THEN array_to_string(t, ' | ') ELSE substr(body, 1, 600) END AS rule FROM su),
ru AS (SELECT file_path, section, heading, {_SUBJECT} AS subject, rule, CASE WHEN len(t) = 0 THEN 'intent' WHEN regexp_matches(rule, '(?i)\\b(must\\s+not|must\\s+never|shall\\s+not|never|forbidden|prohibited|may\\s+not)\\b') THEN 'constraint' WHEN regexp_matches(rule, '(?i)\\b(must|shall|required\\s+to|is\\s+required)\\b') THEN 'requirement' ELSE 'permission' END AS kind,
 CASE WHEN len(t) > 0 THEN confidence WHEN confidence = 'authoritative' THEN 'high' WHEN confidence = 'high' THEN 'medium' WHEN confidence = 'medium' THEN 'low' ELSE 'inferred' END AS confidence FROM sv)"""


@query(f"WITH {_CATALOGUE}, {_RULES} SELECT * FROM ru")
def design_rules(c):
    return D.extract_rules(D.catalogue(c.design_docs))


_TERMS = "list_filter(list_distinct(regexp_extract_all(lower(rule), '\\b\\w\\w\\w\\w+\\b')), lambda w: w NOT IN ('must', 'should', 'never', 'only', 'shall', 'that', 'this', 'with', 'from', 'into', 'when', 'will'))"
_CONFLICTS = f"""tm AS (SELECT file_path, section, subject, kind, {_TERMS} AS tw FROM ru WHERE kind IN ('constraint', 'requirement')), mt AS (SELECT a.file_path AS af, a.section AS asec, b.file_path AS bf, b.section AS bsec FROM tm a JOIN tm b ON a.subject = b.subject AND a.kind = 'constraint' AND b.kind = 'requirement' AND a.file_path <> b.file_path WHERE len(list_intersect(a.tw, b.tw)) >= 2),
bd AS (SELECT af AS file_path, asec AS section FROM mt UNION SELECT bf, bsec FROM mt), rc AS (SELECT ru.* REPLACE (CASE WHEN bd.file_path IS NOT NULL THEN 'conflicted' ELSE ru.confidence END AS confidence) FROM ru LEFT JOIN bd ON bd.file_path = ru.file_path AND bd.section = ru.section)"""


@query(f"WITH {_CATALOGUE}, {_RULES}, {_CONFLICTS} SELECT file_path, section, subject, kind, confidence FROM rc")
def rule_conflicts(c):
    """Constraints and requirements of one subject that two files state on the same terms."""
    return D.conflicts(D.extract_rules(D.catalogue(c.design_docs))).select("file_path", "section", "subject", "kind", "confidence")


@query(f"""WITH {_CATALOGUE}, {_RULES} SELECT subject, rule, file_path, section, confidence FROM (SELECT *, row_number() OVER (PARTITION BY lower(subject) || '::' || substr(regexp_replace(regexp_replace(lower(trim(rule)), '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g'), 1, 60)
ORDER BY CASE confidence WHEN 'authoritative' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'inferred' THEN 0 ELSE -1 END DESC, file_path, section) AS r FROM ru) WHERE r = 1""")
def deduplicated_rules(c):
    return D.deduplicated(D.extract_rules(D.catalogue(c.design_docs))).select("subject", "rule", "file_path", "section", "confidence")


_LAYERS = r"""lr AS (SELECT DISTINCT source, replace(lower(trim(regexp_extract(line, p, 1), '/')), '/', '.') AS from_layer, replace(lower(trim(regexp_extract(line, p, 2), '/')), '/', '.') AS to_layer FROM (SELECT file_path AS source, unnest(string_split(text, chr(10))) AS line, '(?i)`?([A-Za-z0-9_./]+)`?\s+(?:must not|cannot|should not|is forbidden (?:from|to))\s+(?:import from|depend on|import|use)\s+`?([A-Za-z0-9_./]+)`?' AS p FROM {design_docs}) WHERE regexp_matches(line, p))"""


@query(f"WITH {_LAYERS} SELECT * FROM lr")
def layer_rules(c):
    return D.layer_rules(c.design_docs)


@query(f"""WITH {_LAYERS}, rl AS (SELECT DISTINCT from_layer, to_layer FROM lr UNION SELECT 'pkg2.sub1', 'pkg1'), fo AS (SELECT DISTINCT file_path, string_split(file_path, '/')[1:len(string_split(file_path, '/')) - 1] AS d FROM {{imports}}),
fl AS (SELECT DISTINCT file_path, unnest(list_concat(d, list_transform(range(1, len(d) + 1), lambda k: array_to_string(d[k:], '.')))) AS p FROM fo)
SELECT DISTINCT i.file_path, from_layer, module AS forbidden_import, line_number, to_layer FROM {{imports}} i JOIN fl USING (file_path) JOIN rl ON (p = from_layer OR starts_with(p, from_layer || '.') OR ends_with(p, '.' || from_layer)) AND (module = to_layer OR starts_with(module, to_layer || '.'))""")
def layer_violations(c):
    """Imports across boundaries that documents forbid."""
    rules = D.layer_rules(c.design_docs).select("from_layer", "to_layer").distinct().unionByName(c.spark.createDataFrame([("pkg2.sub1", "pkg1")], "from_layer string, to_layer string")).withColumn("source", F.lit(""))
    return D.layer_violations(c.imports, rules).drop("source").distinct()


_CLAIM = r"""cl0 AS (SELECT answer_id, kind, unnest(regexp_extract_all(text, p, 1)) AS subject, CASE WHEN kind = 'NO_CALLERS' THEN '' ELSE unnest(regexp_extract_all(text, p, CASE WHEN kind = 'NO_CALLERS' THEN 1 ELSE 2 END)) END AS object FROM {answers}, (VALUES ('CALLS', '(?i)\b(\w+)\s+calls?\s+into\s+(\w+)'), ('CALLS', '(?i)\b(\w+)\s+calls?\s+(\w+)'), ('CALLS', '(?i)\b(\w+)\s+invokes?\s+(\w+)'),
('NO_CALLERS', '(?i)\b(\w+)\s+has\s+no\s+(?:direct\s+)?callers?'), ('NO_CALLERS', '(?i)\b(\w+)\s+is\s+not\s+called\b'), ('NO_CALLERS', '(?i)no\s+(?:direct\s+)?callers?\s+(?:of|for)\s+(\w+)'), ('NO_CALLERS', '(?i)nothing\s+calls?\s+(\w+)'), ('NO_CALLERS', '(?i)\b(\w+)\s+(?:has\s+)?no\s+callers?\b'),
('HAS_METHOD', '(?i)\b(\w+)\s+has\s+(?:a\s+)?[`''"]?(\w+)[`''"]?\s+method\b'), ('HAS_METHOD', '(?i)\bclass\s+(\w+)\s+(?:implements|defines|provides)\s+(?:a\s+)?[`''"]?(\w+)[`''"]?\b'), ('HAS_METHOD', '(?i)\b(\w+)\.(\w+)\s*\(\)')) v(kind, p)),
cl1 AS (SELECT * FROM cl0 WHERE length(subject) >= 3 AND lower(subject) NOT IN ('the', 'and', 'not', 'this', 'that', 'also', 'which', 'then', 'when', 'are', 'was', 'were', 'what', 'who', 'where', 'how', 'why', 'via', 'its', 'any', 'all') AND (kind = 'NO_CALLERS' OR (length(object) >= 3 AND lower(object) NOT IN ('the', 'and', 'not', 'this', 'that', 'also', 'which', 'then', 'when', 'are', 'was', 'were', 'what', 'who', 'where', 'how', 'why', 'via', 'its', 'any', 'all')))),
cl AS (SELECT answer_id, kind, min(subject) AS subject, min(object) AS object FROM cl1 GROUP BY answer_id, kind, lower(subject), lower(object))"""


@query(f"WITH {_CLAIM} SELECT * FROM cl")
def extract_claims(c):
    return D.extract_claims(c.answers)


@query(f"""WITH {_CLAIM}, ot AS (SELECT caller AS s, array_to_string(list_sort(list(DISTINCT callee))[1:4], ', ') AS x FROM {{edges}} GROUP BY 1), io AS (SELECT callee AS s, array_to_string(list_sort(list(DISTINCT caller))[1:4], ', ') AS x FROM {{edges}} GROUP BY 1), mo AS (SELECT class_name AS s, array_to_string(list_sort(list(DISTINCT method))[1:6], ', ') AS x FROM {{methods}} GROUP BY 1)
SELECT *, CASE WHEN fact IS NULL THEN 'unrefuted' ELSE 'refuted' END AS verdict FROM (SELECT cl.*, CASE WHEN kind = 'CALLS' AND (subject, object) NOT IN (SELECT (caller, callee) FROM {{edges}}) THEN CASE WHEN ot.x IS NOT NULL THEN subject || ' calls: ' || ot.x WHEN subject NOT IN (SELECT name FROM {{functions}}) THEN subject || ' does not exist in this codebase' END
WHEN kind = 'NO_CALLERS' AND io.x IS NOT NULL THEN subject || ' callers: ' || io.x WHEN kind = 'HAS_METHOD' AND subject NOT IN (SELECT name FROM {{classes}}) THEN CASE WHEN subject NOT IN (SELECT name FROM {{functions}}) THEN subject || ' does not exist in this codebase' END
WHEN kind = 'HAS_METHOD' AND (subject, lower(object)) NOT IN (SELECT (class_name, lower(method)) FROM {{methods}}) THEN subject || ' methods: ' || coalesce(mo.x, '(none recorded)') END AS fact FROM cl LEFT JOIN ot ON ot.s = subject LEFT JOIN io ON io.s = subject LEFT JOIN mo ON mo.s = subject)""")
def verify_claims(c):
    """What answers claim, held against the corpus."""
    return D.verify_claims(D.extract_claims(c.answers), c.edges, c.functions, c.classes, c.methods)
