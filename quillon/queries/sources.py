"""Queries of parsers and scanners over files, scripts, pages and documents.

The files are made from rows by templates; the SQL states what stands in them
from the same rows, without reading the texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import blocks, machines, python_code, structured, web_code
from ..sources.shared import written
from .registry import query


def parsed(c, name: str):
    return python_code.tables(python_code.parse_files(c.py_files, python_code.KINDS[name]))[name]


_OK = "{py_files} WHERE k % 17 <> 0"
_STR = "CAST(k AS VARCHAR)"


@query(f"""SELECT file_path, '__init__' AS name, 5 AS line_number, false AS is_stub, 1 AS complexity, 'C' || {_STR} AS class_name, NULL AS docstring FROM {_OK} UNION ALL SELECT file_path, 'run', 8, false, 3, 'C' || {_STR}, CASE WHEN k % 3 = 0 THEN 'Updates the cart. Returns it.' ELSE 'Plain words.' END FROM {_OK}
UNION ALL SELECT file_path, 'todo', 13, k % 3 < 2 AND k % 5 <> 0, 1, 'C' || {_STR}, NULL FROM {_OK} UNION ALL SELECT file_path, 'get_' || {_STR}, 16, false, CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END, NULL, NULL FROM {_OK}""")
def parsed_functions(c):
    return parsed(c, "functions").select("file_path", "name", "line_number", "is_stub", "complexity", "class_name", "docstring")


@query(f"SELECT file_path, 'C' || {_STR} AS name, 4 AS line_number, CASE k % 5 WHEN 0 THEN 'Protocol' WHEN 1 THEN 'ABC' ELSE 'Base' END AS bases, '__init__,run,todo' AS methods FROM {_OK}")
def parsed_classes(c):
    return parsed(c, "classes").select("file_path", "name", "line_number", F.array_join("base_classes", ",").alias("bases"), F.array_join("methods", ",").alias("methods"))


@query(f"SELECT file_path, 'os.path' AS module, 'op' AS alias, 'import' AS import_type, 1 AS line_number FROM {_OK} UNION ALL SELECT file_path, 'app.store.Store' || CAST(k % 7 AS VARCHAR), 'Store' || CAST(k % 7 AS VARCHAR), 'from', 2 FROM {_OK}")
def parsed_imports(c):
    return parsed(c, "imports").select("file_path", "module", "alias", "import_type", "line_number")


@query(f"""SELECT edge_type, callee, count(*) AS n FROM (SELECT 'static' AS edge_type, unnest(['Store' || CAST(k % 7 AS VARCHAR), 'op.join', 'load_' || CAST(k % 11 AS VARCHAR), 'jsonify', 'app.route']) AS callee FROM {_OK} UNION ALL SELECT 'static', 'item.save' FROM {_OK} AND k % 6 <> 0
UNION ALL SELECT 'function_reference', unnest(['x', 'item', 'n']) FROM {_OK} UNION ALL SELECT 'function_reference', 'data' FROM {_OK} AND k % 6 <> 0) GROUP BY 1, 2""")
def parsed_edges(c):
    return parsed(c, "edges").groupBy("edge_type", "callee").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file_path, 'C' || {_STR} AS class_name, 'store' AS attribute, 'Store' || CAST(k % 7 AS VARCHAR) AS inferred_type FROM {_OK}")
def class_attributes(c):
    return parsed(c, "attributes")


@query(f"SELECT file_path, 11 AS line_number, 'op' AS target, 'join' AS operation FROM {_OK} UNION ALL SELECT file_path, 15, 'app', 'route' FROM {_OK} UNION ALL SELECT file_path, 19, 'item', 'save' FROM {_OK} AND k % 6 <> 0")
def parsed_mutations(c):
    return parsed(c, "mutations").select("file_path", "line_number", "target", "operation")


@query(f"""SELECT file_path, '__init__' AS function_name, '' AS description, '' AS side_effects, 'internal_state_change' AS testable_behaviors, 1 AS complexity FROM {_OK}
UNION ALL SELECT file_path, 'run', CASE WHEN k % 3 = 0 THEN 'Updates the cart. Returns it.' ELSE 'Plain words.' END, CASE WHEN k % 3 = 0 THEN 'mutates cart' ELSE '' END, CASE WHEN k % 3 = 0 THEN 'verifiable_return_value,state_change_verification,' ELSE '' END || 'internal_state_change', 3 FROM {_OK}""")
def behavioral_contracts(c):
    return parsed(c, "contracts").drop("line_number")


@query(f"SELECT file_path, 'get_' || {_STR} AS handler, 'id,k' || CAST(k % 3 AS VARCHAR) AS keys FROM {_OK}")
def response_shapes(c):
    return parsed(c, "responses")


@query(f"SELECT file_path, 'C' || {_STR} AS class_name, 'n,store' AS attributes, CASE WHEN k % 4 = 0 THEN 'n' ELSE '' END AS mutated, k % 4 <> 0 AS stable FROM {_OK}")
def find_stable_layouts(c):
    return parsed(c, "layouts").drop("line_number")


@query(f"SELECT file_path, 'data' AS variable, 18 AS line_number, 'load_' || CAST(k % 11 AS VARCHAR) AS bound_to FROM {_OK}")
def runtime_bindings(c):
    return parsed(c, "bindings")


@query(f"SELECT file_path, unnest(['self.n', 'self.store', 'op.join', 'app.route']) AS chain FROM {_OK} UNION SELECT file_path, 'self.m' FROM {_OK} AND k % 4 <> 0 UNION SELECT file_path, 'op.sep' FROM {_OK} AND k % 3 = 2 UNION SELECT file_path, 'item.save' FROM {_OK} AND k % 6 <> 0")
def attribute_chains(c):
    return parsed(c, "chains")


@query(f"SELECT file_path, 'get_' || {_STR} AS name, 16 AS line_number, 19 AS raise_line FROM {_OK} AND k % 6 = 0 UNION ALL SELECT file_path, 'run', 8, 14 FROM {_OK} AND false")
def find_conditional_stubs(c):
    return parsed(c, "conditional_stubs")


@query(f"SELECT file_path, 17 AS line_number, CASE WHEN k % 2 = 0 THEN 'TODO: check it' ELSE 'a plain remark' END AS text, 'block' AS position, CASE WHEN k % 2 = 0 THEN 'TODO' END AS marker FROM {_OK}")
def collected_comments(c):
    return parsed(c, "comments")


@query(f"SELECT file_path, CASE WHEN k % 19 = 0 THEN 'init' WHEN k % 13 = 0 THEN 'test' ELSE 'entry_point' END AS role, 20 AS line_count FROM {_OK}")
def file_roles(c):
    return parsed(c, "files")


@query(f"SELECT file_path, 'get_' || {_STR} AS handler, '/api/' || {_STR} || '/<id>' AS url FROM {_OK}")
def parsed_routes(c):
    return parsed(c, "routes")


@query("SELECT file_path, 1 AS line_number, 'SyntaxError' AS detail FROM {py_files} WHERE k % 17 = 0")
def parse_errors(c):
    return parsed(c, "errors")


_JS, _HTML = "{web_files} WHERE k % 3 <> 0", "{web_files} WHERE k % 3 = 0"
_ASKED = f"SELECT k, file_path, CASE WHEN k % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, '/api/' || {_STR} || '/7?x=1' AS url FROM {_JS} UNION ALL SELECT k, file_path, 'GET', '/none/' || {_STR} FROM {_JS} UNION ALL SELECT k, file_path, 'GET', '/api/$' || chr(123) || 'id' || chr(125) || '/z' FROM {_HTML}"


@query(f"SELECT file_path, method, url FROM ({_ASKED})")
def fetch_calls(c):
    return web_code.fetch_calls(c.web_files)


@query(f"SELECT file_path, 'POST' AS method, '/api/' || {_STR} || '/x/' AS url FROM {_HTML}")
def element_requests(c):
    return web_code.element_requests(c.web_files).select("file_path", "method", "url")


@query(f"SELECT file_path, 'click' AS event, 'go' || {_STR} AS handler FROM {_HTML} UNION ALL SELECT file_path, 'keyup', 'two' || CAST(k % 9 AS VARCHAR) FROM {_HTML}")
def inline_handlers(c):
    return web_code.inline_handlers(c.web_files)


@query(f"SELECT file_path, 'click' AS event, 'go' || {_STR} AS handler FROM {_JS}")
def event_listeners(c):
    return web_code.listeners(c.web_files)


@query(f"SELECT event, count(*) AS n FROM (SELECT 'ping' || CAST(k % 5 AS VARCHAR) AS event FROM {_JS}) GROUP BY event")
def emitted_events(c):
    return web_code.emitted_events(c.web_files).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file_path, 'go' || {_STR} AS name, 1 AS line_number FROM {_JS} UNION ALL SELECT file_path, 'two' || {_STR}, 6 FROM {_JS}")
def script_functions(c):
    return web_code.declarations(c.web_files).select("file_path", "name", "line_number")


@query(f"""SELECT caller_file, caller, callee, line_number FROM (SELECT file_path AS caller_file, 'go' || {_STR} AS caller, 'fetch' AS callee, 2 AS line_number FROM {_JS} UNION ALL SELECT file_path, 'go' || {_STR}, 'sock.emit', 3 FROM {_JS} UNION ALL SELECT file_path, 'go' || {_STR}, 'helper' || CAST(k % 3 AS VARCHAR), 4 FROM {_JS}
UNION ALL SELECT file_path, 'two' || {_STR}, 'axios.get', 6 FROM {_JS} UNION ALL SELECT file_path, 'two' || {_STR}, 'el.addEventListener', 7 FROM {_JS})""")
def script_call_edges(c):
    return web_code.enclosing_calls(c.web_files.filter("file_path LIKE '%.js'")).select("caller_file", "caller", "callee", "line_number")


_ROUTED = f"SELECT {_STR} AS id, 'get_' || {_STR} AS handler FROM {_OK}"


@query(f"""WITH r AS ({_ROUTED}), least AS (SELECT min(handler) AS handler FROM r) SELECT DISTINCT caller_file, callee, 'http_fetch' AS edge_type FROM (SELECT file_path AS caller_file, handler AS callee FROM {{web_files}} w JOIN r ON r.id = CAST(w.k AS VARCHAR) UNION ALL SELECT file_path, handler FROM {_HTML.replace('WHERE', ', least WHERE')})""")
def cross_language_edges(c):
    """Requests of scripts and pages to the handlers of their urls."""
    found = python_code.tables(written(python_code.parse_files(c.py_files, ("decorator",)), "decorators"))  # one parse for both tables
    return web_code.cross_language_edges(c.web_files, found["routes"], found["events"])


@query("""SELECT doc_id, arrows, rows, bullets, lines, CASE WHEN arrows * 5 >= lines THEN 'flow' WHEN rows * 3 >= lines THEN 'table' WHEN bullets * 3 >= lines THEN 'outline' ELSE 'prose' END AS shape FROM (
SELECT doc_id, len(regexp_extract_all(text, '->|=>')) AS arrows, len(regexp_extract_all(text, '\\|[^\\n|]*\\|')) AS rows, len(regexp_extract_all(text, '(?m)^\\s*[-*]\\s')) AS bullets, len(string_split(text, chr(10))) AS lines FROM {documents})""")
def scan_prose(c):
    return structured.scan_prose(c.documents)


@query("""SELECT file_path, CASE k % 5 WHEN 0 THEN 'graph' WHEN 1 THEN 'registry' WHEN 2 THEN 'hierarchy' WHEN 3 THEN 'list' ELSE 'invalid' END AS shape, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS nodes, CASE k % 5 WHEN 0 THEN 1 ELSE 0 END AS links FROM {json_files}""")
def scan_json(c):
    """A finding for each JSON file."""
    return structured.scan_json(c.json_files).select("file_path", "shape", "nodes", "links")


@query(f"""SELECT file_path, 'link' AS kind, 'a' || {_STR} AS name, 'b' AS target FROM {{json_files}} WHERE k % 5 = 0 UNION ALL SELECT file_path, 'action', 'go' || CAST(k % 3 AS VARCHAR), NULL FROM {{json_files}} WHERE k % 5 = 0 UNION ALL SELECT file_path, 'node', 'b', NULL FROM {{json_files}} WHERE k % 5 = 0
UNION ALL SELECT file_path, 'node', unnest(['x', 'y', 'z']), NULL FROM {{json_files}} WHERE k % 5 = 1 UNION ALL SELECT file_path, 'node', unnest(['p', 'q' || {_STR}]), NULL FROM {{json_files}} WHERE k % 5 = 3 UNION ALL SELECT file_path, 'guard', 'ok', NULL FROM {{json_files}} WHERE k % 5 = 3""")
def machine_parts(c):
    """Nodes, links, actions and guards of state machines."""
    return structured.machine_parts(c.json_files)


# Scripts and compiled languages


def scanned(c, name: str):
    return blocks.tables(blocks.scan_blocks(c.native_files))[name]


_GO, _RS, _CPP, _TS = (f"{{native_files}} WHERE k % 4 = {n}" for n in range(4))


@query(f"""SELECT file_path, 'Run' || {_STR} AS name, 8 AS line_number, 12 AS end_line FROM {_GO} UNION ALL SELECT file_path, unnest(['draw', 'size', 'draw']), unnest([2, 3, 6]), unnest([2, 3, 6]) FROM {_RS}
UNION ALL SELECT file_path, 'load' || {_STR}, 1, 9 FROM {_TS} UNION ALL SELECT file_path, 'two' || {_STR}, 10, 10 FROM {_TS}""")
def function_ranges(c):
    return scanned(c, "ranges")


@query(f"""SELECT file_path, 'save' AS consumer, 'load' || CAST(k % 5 AS VARCHAR) AS producer, 'data_flow_var' AS provenance FROM {_GO} UNION ALL SELECT file_path, 'show', 'parse', 'data_flow_arg' FROM {_GO} UNION ALL SELECT file_path, 'parse', 'load' || CAST(k % 5 AS VARCHAR), 'data_flow_var' FROM {_GO}
UNION ALL SELECT file_path, 'send', 'make', 'data_flow_var' FROM {_TS} UNION ALL SELECT file_path, 'put', 'pick', 'data_flow_arg' FROM {_TS} UNION ALL SELECT file_path, 'load' || {_STR}, 'list', 'data_flow_for_iter' FROM {_TS} UNION ALL SELECT file_path, 'use', 'make', 'data_flow_var_kwarg' FROM {_TS}""")
def script_data_flow(c):
    return scanned(c, "flows")


@query(f"SELECT file_path, 'load' || {_STR} AS name, 'a,b,k' || CAST(k % 3 AS VARCHAR) || ',total' AS keys FROM {_TS}")
def response_consumers(c):
    return scanned(c, "consumers")


@query(f"SELECT file_path, 'Store' || {_STR} AS interface, unnest(['Get', 'Put']) AS method FROM {_GO}")
def interface_types(c):
    return scanned(c, "interfaces")


@query(f"SELECT file_path, 'Draw' || {_STR} AS trait, unnest(['draw', 'size']) AS method FROM {_RS}")
def trait_types(c):
    return scanned(c, "traits")


@query(f"SELECT file_path, 'Shape' || CAST(k % 7 AS VARCHAR) AS type, 'Draw' || {_STR} AS trait FROM {_RS}")
def trait_implementations(c):
    return scanned(c, "implementations")


@query(f"SELECT file_path, 'Item' || {_STR} AS class_name, unnest(['Base' || CAST(k % 5 AS VARCHAR), 'Mix']) AS base FROM {_CPP}")
def class_hierarchy(c):
    return scanned(c, "hierarchies")


@query(f"SELECT file_path, line_number, CASE WHEN line_number BETWEEN 1 AND 9 THEN 'load' || {_STR} WHEN line_number = 10 THEN 'two' || {_STR} END AS function FROM {_TS.replace('WHERE', ', (VALUES (1), (5), (9), (10), (11)) v(line_number) WHERE')}")
def enclosing_functions(c):
    lines = c.native_files.filter("k % 4 = 3").select("file_path", F.explode(F.array(*(F.lit(n) for n in (1, 5, 9, 10, 11)))).alias("line_number"))
    return blocks.enclosing(lines, scanned(c, "ranges"))


# State machines

_FOUND = "{machine_sources} WHERE k % 5 <> 0 AND k % 7 <> 0"
_MACHINES = f"{_FOUND} AND k % 11 <> 0 AND k % 13 <> 0"
_FSM = "'Combat' || CAST(k AS VARCHAR) || 'FSM::'"


def machine_tables(c):
    return machines.tables(machines.parse_machines(c.machine_sources))


@query(f"""SELECT file_path, {_FSM} || part AS name, is_stub, docstring FROM (SELECT file_path, k, unnest(['state::idle', 'state::run' || CAST(k % 3 AS VARCHAR), 'event::go', 'event::stop', 'action::hit' || CAST(k % 4 AS VARCHAR), 'action::miss', 'guard::ok']) AS part,
unnest([false, false, false, false, true, true, true]) AS is_stub, unnest(['wait', NULL, NULL, NULL, 'strikes', NULL, NULL]) AS docstring FROM {_MACHINES})""")
def machine_functions(c):
    return machine_tables(c)["functions"].select("file_path", "name", "is_stub", "docstring")


@query(f"SELECT {_FSM} || 'event::go' AS caller, {_FSM} || 'state::run' || CAST(k % 3 AS VARCHAR) AS callee, file_path AS caller_file, 'go' AS source_id, 'run' || CAST(k % 3 AS VARCHAR) AS target_id FROM {_MACHINES}")
def machine_transitions(c):
    return machine_tables(c)["edges"].select("caller", "callee", "caller_file", "source_id", "target_id")


@query(f"SELECT file_path, CASE WHEN k % 11 = 0 THEN 'JSON parse error' ELSE 'missing or non-string ' || chr(39) || 'name' || chr(39) END AS error FROM {_FOUND} AND (k % 11 = 0 OR k % 13 = 0)")
def machine_errors(c):
    return machine_tables(c)["errors"]


@query(f"SELECT 'Combat' || CAST(k AS VARCHAR) || 'FSM' AS machine, '[*] --> run' || CAST(k % 3 AS VARCHAR) || ': go' AS line FROM {_MACHINES}")
def machine_diagrams(c):
    return machines.diagram(machines.parse_machines(c.machine_sources))
