"""A structural corpus as views over the driver's tables.

Each view is plain SQL that Spark and DuckDB both run, so the same definition
feeds the DataFrame operators and the SQL they are held against. Base tables
and earlier views are written in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _name(key: str) -> str:
    """Name of the function that a part stands for; every 50th shares the name ``helper``."""
    return (f"CASE WHEN {key} % 50 = 0 THEN 'helper' WHEN {key} % 5 = 0 THEN 'get_item_' || CAST({key} AS STRING) WHEN {key} % 5 = 1 THEN 'set_item_' || CAST({key} AS STRING) "
            f"WHEN {key} % 5 = 2 THEN 'load_order' || CAST({key} AS STRING) || '_row' WHEN {key} % 5 = 3 THEN 'parse_' || CAST({key} AS STRING) || '_row' ELSE '__run' || CAST({key} AS STRING) || '__' END")


def _module(key: str) -> str:
    return f"'mod' || CAST({key} % 17 AS STRING)"


def _path(key: str) -> str:
    return f"CASE WHEN {key} % 41 = 0 THEN 'tests/test_' || {_module(key)} || '.py' ELSE 'pkg' || CAST({key} % 5 AS STRING) || '/sub' || CAST({key} % 3 AS STRING) || '/' || {_module(key)} || '.py' END"


def _line(k: str) -> str:
    """A line of a design document."""
    return ("CASE ({k}) % 12 WHEN 0 THEN '- The storage layer must not import the web module' WHEN 1 THEN '2. `ui/views` cannot depend on `core.store`' WHEN 2 THEN 'Every controller must validate its input and return a result' WHEN 3 THEN 'Orders are kept in tables for later use' "
            "WHEN 4 THEN 'a) The engine shall never expose internal state of ' || p_brand WHEN 5 THEN 'Note: Managers handle requests of ' || p_name WHEN 6 THEN 'short' WHEN 7 THEN '* Callers `pkg1` should not use `os`' WHEN 8 THEN 'The system is required to protect all records of ' || p_name "
            "WHEN 9 THEN '## ' || CASE WHEN p_partkey % 3 = 0 THEN 'OrderEngine' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) || ': rules of writes' WHEN p_partkey % 3 = 1 THEN 'B2. The mutation of ' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) ELSE 'Visibility ' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) || ' (all of it)' END WHEN 10 THEN 'Plain prose about ' || p_name || ' in general terms, nothing more' ELSE 'Data must be stored by the store layer and the cache may not keep it' END").replace("{k}", k)


_LINES = " || chr(10) || ".join(_line(k) for k in ("p_partkey", "p_partkey * 5 + 1", "p_partkey * 7 + 2", "p_size", "p_size * 5 + p_partkey", "p_partkey * 11 + 4", "p_size + 9", "p_partkey + p_size * 7"))


def _text(*lines: str) -> str:
    """Lines of SQL strings as one text."""
    return " || chr(10) || ".join(lines)


def _sql(line: str) -> str:
    """A line as SQL: ``~expression~`` is put in as text; braces are written as characters, as they name views elsewhere."""
    parts = line.split("~")
    out = [f"CAST({x} AS STRING)" if k % 2 else "'" + x.replace("'", "''").replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '") + "'" for k, x in enumerate(parts)]
    return " || ".join(out)


K = "p_partkey"
_PYTHON = _text(*map(_sql, (
    "import os.path as op", f"from app.store import Store~{K} % 7~", "", f"class C~{K}~(~CASE {K} % 5 WHEN 0 THEN 'Protocol' WHEN 1 THEN 'ABC' ELSE 'Base' END~):", "    def __init__(self, n: int):", "        self.n = n",
    f"        self.store = Store~{K} % 7~()", "    def run(self, x):", '        """' + f"~CASE WHEN {K} % 3 = 0 THEN 'Updates the cart. Returns it.' ELSE 'Plain words.' END~" + '"""', "        if x and self.n:", f"            self.~CASE WHEN {K} % 4 = 0 THEN 'n' ELSE 'm' END~ = op.join(x)",
    "        return x", "    def todo(self):", f"        ~CASE {K} % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'raise NotImplementedError' ELSE 'return op.sep' END~", f'@app.route("/api/~{K}~/<id>")', f"def get_~{K}~(item, n=0):",
    f"    # ~CASE WHEN {K} % 2 = 0 THEN 'TODO: check it' ELSE 'a plain remark' END~", f"    data = load_~{K} % 11~(item)", f"    ~CASE WHEN {K} % 6 = 0 THEN 'if n: raise NotImplementedError' ELSE 'item.save(data)' END~", f"    return jsonify(id=n, k~{K} % 3~=1)")))
_SCRIPT = _text(*map(_sql, (
    f"function go~{K}~() {{", f"  fetch('/api/~{K}~/7?x=1'~CASE WHEN {K} % 2 = 0 THEN ', ' || chr(123) || 'method: ' || chr(39) || 'post' || chr(39) || chr(125) ELSE '' END~);", f"  sock.emit('ping~{K} % 5~', 1);", f"  helper~{K} % 3~();", "}", f"const two~{K}~ = () => axios.get('/none/~{K}~');", f"el.addEventListener('click', go~{K}~);")))
_PAGE = _text(*map(_sql, (f'<button onclick="go~{K}~(1)" hx-post="/api/~{K}~/x/">', f"<a onkeyup='two~{K} % 9~ ( )'>no</a>", "<script>fetch(`/api/${id}/z`)</script>")))
_JSON = ("CASE p_partkey % 5 WHEN 0 THEN " + _sql('[{"source": "a~p_partkey~", "to": "b", "action": "go~p_partkey % 3~"}, {"id": "b"}]') + " WHEN 1 THEN " + _sql('[{"id": "x"}, {"name": "y", "use": "x"}, {"key": "z", "uses": ["y", "x", "~p_name~"]}]')
         + " WHEN 2 THEN " + _sql('{"a": {"b": {"c": {"d": ~p_size~}}}}') + " WHEN 3 THEN " + _sql('[{"id": "p"}, {"id": "q~p_partkey~", "guard": "ok"}]') + " ELSE " + _sql("{not json") + " END")

_GO = _text(*map(_sql, ("package main", "", f"type Store~{K}~ interface {{", "    Get(id int) string", "    Put(id int) // no Drop(x)", "}", "", f"func Run~{K}~(s Store) {{", f"    x := load~{K} % 5~(s)", "    save(x)", "    show(parse(x))", "}")))
_RUST = _text(*map(_sql, (f"pub trait Draw~{K}~ {{", "    fn draw(&self);", "    fn size(&self) -> i32 { 1 }", "}", f"impl<T> Draw~{K}~<T> for app::Shape~{K} % 7~ {{", "    fn draw(&self) { render(self) }", "}")))
_CPP = _text(*map(_sql, (f"class Base~{K} % 5~ {{ }};", f"class Item~{K}~ final : public Base~{K} % 5~, private virtual ns::Mix<int, long> {{", "    void go();", "};")))
_ASYNC = _text(*map(_sql, (f"async function load~{K}~(u) {{", "  const { a, b: c } = await (await fetch(u)).json();", "  const d = await resp.json();", f"  show(d.total, d.k~{K} % 3~);", "  const x = make(u);", "  send(x); // put(no(u))", "  put(pick(u));", "  for (const y of list(u)) { use({ it: x }); }", "}", f"const two~{K}~ = () => go('f(g())');")))

_MACHINE = ("CASE WHEN p_partkey % 11 = 0 THEN 'not json' WHEN p_partkey % 13 = 0 THEN " + _sql('{"states": []}') + " ELSE " + _sql('{"name": "Combat~p_partkey~FSM", "states": [{"name": "idle", "prompt": "wait"}, {"name": "run~p_partkey % 3~"}, {"x": 1}], "events": {"go": {"transitions": [{"to": "run~p_partkey % 3~", "guard": "ok"}, {"to": 3}]}, "stop": null}, "actions": {"hit~p_partkey % 4~": {"description": "strikes"}, "miss": {}}, "guards": {"ok": {"description": ""}}}') + " END")


VIEWS: dict[str, str] = {
    # A function per part.
    "functions": f"""SELECT p_partkey AS id, {_path('p_partkey')} AS file_path, {_name('p_partkey')} AS name, CAST(p_size AS INT) AS line_number,
        CASE WHEN p_size % 10 < 2 THEN 'Missing' WHEN p_partkey % 5 = 0 THEN 'Optional[Class' || CAST(p_partkey % 25 AS STRING) || ']' WHEN p_partkey % 5 = 1 THEN 'int' WHEN p_partkey % 5 = 2 THEN 'OrderRow' END AS return_type,
        CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN '' WHEN p_partkey % 6 = 2 THEN p_name || ' blocked on ' || p_brand || ' then requires OrderEngine' WHEN p_partkey % 6 = 3 THEN p_name || ' should drive the WorldController and CombatFSM' WHEN p_partkey % 18 = 4 THEN 'The store does not support ' || p_name || ' of PlayerState'
            WHEN p_partkey % 18 = 10 THEN 'will be implemented when ' || p_name || ' exists, see Mod3Registry' ELSE p_name || ' for Class' || CAST(p_partkey % 31 AS STRING) || 'Handler and PartStore' END AS docstring,
        p_size <= 15 AS is_stub, CASE p_size % 5 WHEN 0 THEN 'empty_pass' WHEN 1 THEN 'trivial_return' WHEN 2 THEN 'raise_not_impl' WHEN 3 THEN 'has_content' END AS body_shape,
        CASE WHEN p_partkey % 29 = 0 THEN 'property' WHEN p_partkey % 31 = 0 THEN 'app.route' WHEN p_partkey % 23 = 0 THEN 'abstractmethod' ELSE '' END AS decorators,
        CASE WHEN p_partkey % 31 = 0 THEN '/api/' || lower(p_type) || '/<id>/' END AS http_route, p_partkey % 43 = 0 AS is_tool,
        CASE WHEN p_partkey % 3 = 0 THEN 'Class' || CAST(p_partkey % 25 AS STRING) END AS class_name,
        CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'order:Order' ELSE 'order:Order,row:Class' || CAST(p_partkey % 33 AS STRING) END AS param_types
        FROM {{part}}""",
    # The same, and stubs that outside events or machines call, converters, methods of a class's life and files of data.
    "all_functions": """SELECT * FROM {functions} UNION ALL SELECT id + 10000000, CASE WHEN id % 7 = 0 THEN 'fsm/combat' || CAST(id % 3 AS STRING) || '.json' WHEN id % 7 = 1 THEN 'app/handlers/m' || CAST(id % 5 AS STRING) || '.py' WHEN id % 7 = 2 THEN 'conf/m.yaml' ELSE file_path END,
        CASE WHEN id % 7 = 0 THEN 'Combat::action::a' || CAST(id AS STRING) WHEN id % 7 = 1 THEN 'work' || CAST(id AS STRING) WHEN id % 7 = 3 THEN 'on_event' || CAST(id AS STRING) WHEN id % 7 = 4 THEN '__init__' WHEN id % 7 = 5 THEN 'to_json' ELSE 'alone' || CAST(id AS STRING) END,
        line_number, return_type, docstring, id % 7 <> 6, body_shape, decorators, NULL, false, class_name, param_types FROM {functions} WHERE id % 11 < 2""",
    # Notes, marks and findings on symbols and files.
    "notes": f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'x::' || {_name('p_partkey')} WHEN 1 THEN {_name('p_partkey')} WHEN 2 THEN 'note on ' || {_name('p_partkey')} WHEN 3 THEN 'mod' || CAST(p_partkey % 17 AS STRING) || '.py' WHEN 4 THEN 'chain::' || CAST(p_partkey % 9 AS STRING) ELSE {_name('p_partkey')} END AS subject,
        CASE p_partkey % 6 WHEN 0 THEN 'dead' WHEN 1 THEN 'inline_note' WHEN 2 THEN 'design_note' WHEN 3 THEN 'file_purpose' WHEN 4 THEN 'strategy_decision' ELSE 'known_issue' END AS kind, 'see ' || {_name('(p_partkey * 2 + 1)')} || ' first' AS content, p_partkey % 5 = 0 AS needs_review FROM {{part}} WHERE p_size < 20""",
    "fsm_artifacts": """SELECT 'Combat.' || n_name AS subject, 'fsm_state' AS kind FROM {nation} WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'Encounter.start_world' || CAST(n_nationkey AS STRING), 'fsm_action' FROM {nation} WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'Player', 'note' FROM {region}""",
    # A call per pair of neighbouring lines of an order, most of them to vendor code; duplicates and several spellings of a callee occur.
    "edges": f"""SELECT caller, callee, line_number, caller_file, resolved, edge_type, caller AS source_id, regexp_replace(callee, '^.*[.]', '') AS target_id FROM (
        SELECT {_name('a.l_partkey')} AS caller,
        CASE WHEN b.l_quantity > 5 THEN 'vendor.call_' || CAST(b.l_suppkey AS STRING) WHEN a.l_linenumber % 3 = 0 THEN {_module('b.l_partkey')} || '.' || {_name('b.l_partkey')} WHEN a.l_linenumber % 7 = 1 THEN 'self.' || {_module('b.l_partkey')} || '.' || {_name('b.l_partkey')} ELSE {_name('b.l_partkey')} END AS callee,
        CAST(a.l_linenumber AS INT) AS line_number, {_path('a.l_partkey')} AS caller_file, a.l_linestatus = 'F' AS resolved,
        CASE WHEN a.l_returnflag = 'R' THEN 'dynamic' WHEN a.l_returnflag = 'A' THEN 'static' WHEN a.l_shipdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'function_reference' ELSE 'data_flow' END AS edge_type
        FROM {{lineitem}} a JOIN {{lineitem}} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) e""",
    # The same, and calls of functions that nobody wrote, of built-in ones and of the caller itself.
    "plan_edges": f"""SELECT * FROM {{edges}} UNION ALL SELECT caller, callee, line_number, caller_file, resolved, edge_type, caller, callee FROM (
        SELECT {_name('l_partkey')} AS caller, CASE WHEN l_suppkey % 4 = 0 THEN 'print' WHEN l_suppkey % 4 = 1 THEN {_name('l_partkey')} ELSE 'missing_helper' || CAST(l_suppkey % 40 AS STRING) END AS callee,
        CAST(l_linenumber AS INT) AS line_number, {_path('l_partkey')} AS caller_file, l_suppkey % 4 = 1 AS resolved, 'static' AS edge_type FROM {{lineitem}} WHERE l_quantity = 7) e""",
    "trade_edges": """SELECT 'c' || CAST(o_custkey AS STRING) AS caller, 's' || CAST(l_suppkey AS STRING) AS callee, CAST(l_linenumber AS INT) AS line_number, o_orderpriority AS caller_file,
        l_linestatus = 'F' AS resolved, l_returnflag AS edge_type FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "fk_edges": """SELECT 'r' || CAST(n_regionkey AS STRING) AS caller, 'n' || CAST(n_nationkey AS STRING) AS callee FROM {nation}
        UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING) FROM {customer}
        UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING) FROM {orders}
        UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), 's' || CAST(s_suppkey AS STRING) FROM {supplier}""",
    "event_edges": """SELECT event_type AS caller, nxt AS callee, CAST(user_id AS INT) AS line_number FROM (
        SELECT event_type, user_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) e WHERE nxt IS NOT NULL""",
    # Modules of two dotted segments; a sparse graph with and without cycles.
    "module_edges": """SELECT 'app' || CAST(n_regionkey AS STRING) || '.n' || CAST(n_nationkey AS STRING) || '.f' AS caller, 'app' || CAST(k % 5 AS STRING) || '.n' || CAST(k AS STRING) || '.g' AS callee FROM (
        SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey < 13 THEN (n_nationkey * 4) % 13 ELSE n_nationkey % 13 END AS k FROM {nation}) n
        UNION ALL SELECT 'cust.n' || CAST(c_nationkey AS STRING) || '.m', 'app' || CAST(c_nationkey % 5 AS STRING) || '.n' || CAST(c_nationkey AS STRING) || '.f' FROM {customer}
        UNION ALL SELECT 'app' || CAST(s_nationkey % 5 AS STRING) || '.n' || CAST(s_nationkey AS STRING) || '.g', 'supp.k' || CAST(s_suppkey % 11 AS STRING) || '.h' FROM {supplier}""",
    "files": """SELECT source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS file_path, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS line_count, lang AS role, doc_id FROM {documents}""",
    "classes": """SELECT k AS id, 'pkg' || CAST(k % 5 AS STRING) || '/sub' || CAST(k % 3 AS STRING) || '/mod' || CAST(k % 17 AS STRING) || '.py' AS file_path, 'Class' || CAST(k AS STRING) AS name, CAST(k AS INT) AS line_number,
        CASE WHEN k % 4 = 0 THEN 'ABC' WHEN k % 4 = 3 THEN 'Protocol' ELSE 'Class' || CAST(k - k % 4 AS STRING) END AS base_class, methods,
        CASE WHEN k % 2 = 0 THEN 'holds ' || methods END AS docstring FROM (
        SELECT p_partkey % 25 AS k, CAST(count(*) AS STRING) AS methods FROM {part} GROUP BY p_partkey % 25) c""",
    # Four methods a class; some of base classes and protocols are abstract.
    "methods": """SELECT class_name, CASE WHEN k = 24 THEN 'build_' WHEN m % 2 = 0 THEN 'make_' ELSE 'on_' END || CAST(m AS STRING) AS method, (k % 4 = 0 AND j < 3) OR (k % 4 = 3 AND j = 0) AS is_abstract FROM (
        SELECT 'Class' || CAST(p_partkey % 25 AS STRING) AS class_name, p_partkey % 25 AS k, p_partkey % 4 AS j, (p_partkey % 25 * 7 + p_partkey % 4) % 13 AS m FROM {part}) p""",
    "refs": f"""SELECT {_path('l_partkey')} AS file_path, {_name('l_partkey')} AS caller,
        CASE WHEN l_quantity > 49 THEN NULL WHEN l_returnflag = 'A' THEN 'print' WHEN l_linenumber = 6 THEN 'self.' || {_name('l_suppkey')} || '.x' ELSE {_module('l_suppkey')} || '.' || {_name('l_suppkey')} END AS callee,
        CAST(l_linenumber AS INT) AS line_number, CASE WHEN l_returnflag = 'A' THEN 'builtin' WHEN l_returnflag = 'R' THEN 'project' WHEN l_linestatus = 'F' THEN NULL ELSE 'unknown' END AS bucket FROM {{lineitem}}""",
    "imports": f"""SELECT {_path('l_partkey')} AS file_path, CASE WHEN l_linenumber % 4 = 0 THEN 'os.path' ELSE 'pkg' || CAST(l_suppkey % 5 AS STRING) || '.sub' || CAST(l_suppkey % 3 AS STRING) || '.' || {_module('l_suppkey')} END AS module, CAST(l_linenumber AS INT) AS line_number FROM {{lineitem}} WHERE l_discount > 0.08""",
    "contract_reports": """SELECT d.source AS file_path, 'c_' || lang AS contract_name, CASE WHEN toxic = 1 THEN 'error' ELSE 'warning' END AS severity, lang AS layer, l.doc_id AS seq,
        CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS violation FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "mutations": f"""SELECT {_path('user_id')} AS file_path, {_name('user_id')} AS function_name, event_type AS operation, CAST(event_id AS INT) AS line_number FROM {{events}} WHERE event_type IN ('purchase', 'error')""",
    "artifacts": """SELECT event_id AS id, 'fn' || CAST(user_id AS STRING) AS subject, event_type AS kind, props AS content,
        CASE WHEN event_id % 3 = 0 THEN 'human-confirmed' WHEN event_id % 3 = 1 THEN 'ai-confirmed-by-human' ELSE 'ai-generated' END AS provenance, ts AS created_at, value FROM {events}""",
    "sessions": """SELECT conv_id, turn, text AS raw_query FROM {conversations} WHERE role = 'user'""",
    # A design document per part, some of them no document or of no account.
    "design_docs": f"""SELECT CASE p_partkey % 8 WHEN 0 THEN 'docs/CONSTITUTION_' || CAST(p_partkey AS STRING) || '.md' WHEN 1 THEN 'docs/DESIGN_' || CAST(p_partkey AS STRING) || '.rst' WHEN 2 THEN 'pkg' || CAST(p_partkey % 5 AS STRING) || '/README_' || CAST(p_partkey AS STRING) || '.md' WHEN 3 THEN 'notes/todo_' || CAST(p_partkey AS STRING) || '.txt'
        WHEN 4 THEN 'node_modules/a/m' || CAST(p_partkey AS STRING) || '.md' WHEN 5 THEN 'src/m' || CAST(p_partkey AS STRING) || '.py' WHEN 6 THEN 'docs/.cache/x' || CAST(p_partkey AS STRING) || '.md' ELSE 'docs/m' || CAST(p_partkey AS STRING) || '.md' END AS file_path, p_partkey AS doc_id,
        CASE WHEN p_partkey % 16 = 7 THEN 'Nothing of weight is said here' || chr(10) || 'nor here, of ' || p_name ELSE {_LINES} END AS text FROM {{part}}""",
    # An answer per part that claims calls, missing callers and methods.
    "answers": f"""SELECT p_partkey AS answer_id, CASE p_partkey % 7 WHEN 0 THEN {_name('p_partkey')} || ' calls helper. It calls this.' WHEN 1 THEN 'I think ' || {_name('p_partkey')} || ' invokes ' || {_name('(p_partkey * 3)')} || ' twice' WHEN 2 THEN {_name('p_partkey')} || ' has no direct callers'
        WHEN 3 THEN 'Nothing calls ' || {_name('p_partkey')} WHEN 4 THEN 'Class' || CAST(p_partkey % 30 AS STRING) || ' has a `make_' || CAST(p_partkey % 13 AS STRING) || '` method' WHEN 5 THEN 'class Class' || CAST(p_partkey % 25 AS STRING) || ' defines on_' || CAST(p_partkey % 13 AS STRING) ELSE 'nobody calls Nowhere' || CAST(p_partkey AS STRING) || ' and it calls the rest' END AS text FROM {{part}}""",
    # A Python file per part, every 17th broken; a script or a page per part; a JSON file per part.
    "py_files": f"""SELECT p_partkey AS k, CASE WHEN p_partkey % 19 = 0 THEN 'pkg' || CAST(p_partkey AS STRING) || '/__init__.py' WHEN p_partkey % 13 = 0 THEN 'tests/m' || CAST(p_partkey AS STRING) || '.py' ELSE 'pkg' || CAST(p_partkey % 5 AS STRING) || '/m' || CAST(p_partkey AS STRING) || '.py' END AS file_path,
        CASE WHEN p_partkey % 17 = 0 THEN 'def x(:' ELSE {_PYTHON} END AS text FROM {{part}}""",
    "web_files": f"""SELECT p_partkey AS k, 'web/f' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.html' ELSE '.js' END AS file_path, CASE WHEN p_partkey % 3 = 0 THEN {_PAGE} ELSE {_SCRIPT} END AS text FROM {{part}}""",
    "machine_sources": f"""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'data/' WHEN p_partkey % 5 = 1 THEN 'app/fsms/deep/' ELSE 'fsms/' END || 'm' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 7 = 0 THEN '.txt' ELSE '.json' END AS file_path, {_MACHINE} AS text FROM {{part}}""",
    "native_files": f"""SELECT p_partkey AS k, 'src/f' || CAST(p_partkey AS STRING) || CASE p_partkey % 4 WHEN 0 THEN '.go' WHEN 1 THEN '.rs' WHEN 2 THEN '.cpp' ELSE '.ts' END AS file_path, CASE p_partkey % 4 WHEN 0 THEN {_GO} WHEN 1 THEN {_RUST} WHEN 2 THEN {_CPP} ELSE {_ASYNC} END AS text FROM {{part}}""",
    "json_files": f"""SELECT p_partkey AS k, 'data/f' || CAST(p_partkey AS STRING) || '.json' AS file_path, {_JSON} AS text FROM {{part}}""",
    # A question per part, each intent's phrases among them.
    "questions": f"""SELECT p_partkey AS query_id, CASE p_partkey % 13 WHEN 0 THEN 'What depends on ' WHEN 1 THEN 'show the IMPACT of ' WHEN 2 THEN 'what uses ' WHEN 3 THEN 'where is it used by ' WHEN 4 THEN 'What does it do: ' WHEN 5 THEN 'the build is broken in ' WHEN 6 THEN 'why is there an error in '
        WHEN 7 THEN 'what changes ' WHEN 8 THEN 'who mutates ' WHEN 9 THEN 'what is the purpose of ' WHEN 10 THEN 'why does it call ' WHEN 11 THEN 'who modified ' ELSE 'tell me about ' END || {_name('p_partkey')} AS raw_query FROM {{part}}""",
    # States of a corpus and, for most, of a question.
    "policy_states": """SELECT c_custkey AS id, c_custkey % 3 = 0 AS has_cycles, CAST(c_custkey % 7 AS INT) AS errors, CAST(c_custkey % 5 AS INT) AS unstable, CAST(c_custkey % 4 + c_custkey % 5 AS INT) AS contracts, CAST(c_nationkey * 40 AS INT) AS edges, CAST(c_custkey % 11 AS INT) AS files,
        CAST(c_nationkey * 5 AS INT) AS top_degree, CAST(c_custkey % 6 AS INT) AS role_files, CAST(c_custkey % 8 AS INT) AS seed_count, CAST(c_custkey % 17 AS INT) AS expanded_count,
        CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'debug_query' WHEN 2 THEN 'general_query' ELSE 'impact_query' END AS intent FROM {customer}""",
    # The vectors, and a part of them again under other ids.
    "vectors": """SELECT vec_id, embedding, label FROM {embeddings} UNION ALL SELECT vec_id + 1000000, embedding, label FROM {embeddings} WHERE vec_id % 9 = 0 UNION ALL SELECT vec_id + 2000000, embedding, label FROM {embeddings} WHERE vec_id % 27 = 0""",
}

_BRACES = re.compile(r"\{(\w+)\}")


class Corpus:
    """Views of one folder of tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._held:
            if name in VIEWS:
                sql = VIEWS[name]
                self._held[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in set(_BRACES.findall(sql))})
            elif name in BASE_TABLES:
                self._held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._held[name]


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that ``sql`` names in braces as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _BRACES.findall(text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    plain = lambda text: _BRACES.sub(lambda m: m[1], text)
    views = ",\n".join(f"{name} AS ({plain(VIEWS[name])})" for name in order)
    body = plain(sql).strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[4:]}"
    return f"WITH {views}\n{body}"
