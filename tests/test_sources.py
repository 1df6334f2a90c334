"""Parsers and scanners on small sources; refresh by streaming."""

import json

from pyspark.sql import functions as F

from quillon.sources import python_code, shared, structured, web_code
from quillon.streaming import refresh

CODE = '''
import os.path
from app.store import Store

HANDLERS = {"a": first, "b": mod.second}

class Base(ABC):
    size: int = 0
    def __init__(self):
        self.store = Store()
    @abstractmethod
    def todo(self) -> Optional[Store]:
        """Blocked on Engine."""
        raise NotImplementedError

@app.route("/api/<id>")
def fetch(item: Store, n=0):
    """Doc."""
    if n:
        item.load(parse(n))
    self_made = Store()
    self_made.save()
    Thread(target=worker)
    state.count += 1
    return item
'''


def test_python_tables(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "main.py").write_text(CODE)
    (tmp_path / "pkg" / "broken.py").write_text("def x(:\n")
    (tmp_path / "__pycache__").mkdir()
    (tmp_path / "__pycache__" / "c.py").write_text("x = 1")
    files = python_code.source_files(spark, str(tmp_path))
    assert {r["file_path"] for r in files.collect()} == {"pkg/main.py", "pkg/broken.py"}
    t = python_code.tables(python_code.parse_files(files))
    f = {r["name"]: r for r in t["functions"].collect()}
    assert not f["todo"]["is_stub"] and not f["fetch"]["is_stub"] and f["fetch"]["complexity"] == 2 and f["todo"]["decorators"] == ["abstractmethod"]
    edges = {(r["caller"], r["callee"], r["edge_type"], r["resolved"]) for r in t["edges"].collect()}
    assert ("fetch", "Store.load", "static", True) in edges and ("fetch", "Store.save", "static", True) in edges and ("fetch", "worker", "thread", False) in edges
    assert ("<module>", "mod.second", "dynamic", False) in edges and ("fetch", "parse", "data_flow", False) in edges
    assert {r["target"] for r in t["assignments"].collect()} == {"self.store", "state.count"}
    assert {(r["target"], r["operation"]) for r in t["mutations"].collect()} == {("item", "load"), ("self_made", "save"), ("app", "route")}
    assert t["classes"].first()["methods"] == ["__init__", "todo"] and [(r["attribute"], r["inferred_type"]) for r in t["attributes"].collect()] == [("store", "Store")]
    assert [tuple(r) for r in t["routes"].select("handler", "url").collect()] == [("fetch", "/api/<id>")]
    assert [r["file_path"] for r in t["errors"].collect()] == ["pkg/broken.py"]


def test_stubs_by_body():
    """Bodies that are stubs and that aren't; abstract and protocol methods never are."""
    empty = ["pass", "...", "raise", "raise NotImplementedError", "raise NotImplementedError('x')", "return", "return None", "return 0", "return False", "return ''", "return []", "return {}", "'doc'", "'doc'\n    pass"]
    real = ["return ()", "return 1", "raise ValueError", "x = 1", "'doc'\n    1", "return [1]", "for x in y: pass"]
    stub = lambda body: next(r[8] for r in python_code.rows_of("a.py", f"def f(y):\n    {body}\n") if r[0] == "function")
    assert [b for b in empty if not stub(b)] == [] and [b for b in real if stub(b)] == []
    code = "class P(Protocol):\n    def a(self): ...\nclass Q:\n    @abc.abstractmethod\n    def b(self): pass\n    def c(self): pass\n"
    assert {r[2]: r[8] for r in python_code.rows_of("a.py", code) if r[0] == "function"} == {"a": False, "b": False, "c": True}


def test_roles_and_comments():
    roles = {"pkg/__init__.py": "init", "Tests/x.py": "test", "a/test_x.py": "test", "a/x_test.py": "test", "a/config.py": "config", "a/my_config.py": "config", "a/x.py": "module"}
    assert {p: python_code.role_of(p, "x = 1") for p in roles} == roles
    assert python_code.role_of("a.py", "@api.v1.route('/x')") == python_code.role_of("config.py", "if __name__ == '__main__': go()") == "entry_point"
    rows = [(r[3], r[6], r[7], r[2]) for r in python_code.rows_of("a.py", "# TODO: one\nx = 1  # FIXME -- two\n#\ny = '# no'  # plain\n") if r[0] == "comment"]
    assert rows == [(1, "TODO: one", "block", "TODO"), (2, "FIXME -- two", "inline", "FIXME"), (4, "plain", "inline", None)]
    assert python_code.rows_of("a.py", "")[-1][0] == "file" and [r[0] for r in python_code.rows_of("a.py", "def x(:")] == ["error"]


def test_routes_match_by_segment(spark):
    routes = spark.createDataFrame([("by_id", "/a/<id>"), ("fixed", "/a/b"), ("deep", "/a/<x>/c"), ("any", "/<x>/<y>/<z>"), ("slash", "/a/b/")], "handler string, url string")
    calls = spark.createDataFrame([("f", "/a/7"), ("f", "/a/b?q=1"), ("f", "/a/${k}"), ("f", "http://h/a/1/c"), ("f", "/q/w/e"), ("f", "/none"), ("f", "/a/7")], "file_path string, url string")
    assert {(r["url"], r["handler"]) for r in web_code.matched_routes(calls, routes).collect()} == {("/a/7", "by_id"), ("/a/b?q=1", "by_id"), ("/a/${k}", "by_id"), ("http://h/a/1/c", "any"), ("/q/w/e", "any")}


def test_web_links(spark):
    files = spark.createDataFrame([
        ("a.js", "function go() {\n  fetch('/api/7?x=1', {method: 'post'});\n  sock.emit('ping', 1);\n  helper();\n}\nconst two = () => axios.get('/none');"),
        ("b.html", "<a onclick=\"go(1)\"></a><div hx-get=\"/api/9/\"></div>"), ("c.go", "func Run(x int) {\n  work(x)\n}"), ("d.rs", "pub async fn spin() {\n  turn();\n}"), ("e.cu", "__global__ void kern(int x) {\n}\nvoid f() {\n kern<<<1,2>>>(3);\n}"), ("f.js", None)], "file_path string, text string")
    routes = spark.createDataFrame([("fetch", "/api/<id>")], "handler string, url string")
    events = spark.createDataFrame([("on_ping", "ping")], "handler string, event string")
    got = {tuple(r) for r in web_code.cross_language_edges(files, routes, events).collect()}
    assert got == {("a.js", "fetch", "http_fetch"), ("b.html", "fetch", "http_fetch"), ("a.js", "on_ping", "cross_language")}
    assert {(r["file_path"], r["method"], r["url"]) for r in web_code.fetch_calls(files).collect()} == {("a.js", "POST", "/api/7?x=1"), ("a.js", "GET", "/none")}
    assert {(r["file_path"], r["name"]) for r in web_code.declarations(files).collect()} >= {("a.js", "go"), ("a.js", "two"), ("c.go", "Run"), ("d.rs", "spin"), ("e.cu", "kern")}
    calls = {(r["caller"], r["callee"]) for r in web_code.enclosing_calls(files).collect()}
    assert {("go", "helper"), ("Run", "work"), ("spin", "turn")} <= calls
    assert [r["callee"] for r in web_code.cuda_launches(files).collect()] == ["kern"]
    assert [tuple(r) for r in web_code.inline_handlers(files).collect()] == [("b.html", "click", "go")]
    native = spark.createDataFrame([("n.py", "lib = ctypes.CDLL('x')\nlib.run(1)\nlib._hid(2)\nother.run()")], "file_path string, text string")
    assert [tuple(r) for r in web_code.native_calls(native).collect()] == [("n.py", "run")]
    edges = spark.createDataFrame([("fetch", "load")], "caller string, callee string")
    assert {tuple(r) for r in web_code.trace_route("/api/3", files, routes, edges).collect()} == {("handler", "fetch"), ("client", "a.js"), ("callee", "load")}


def test_web_texts_are_read_once_over_all_cores(spark, tmp_path):
    """Links take all that they need from one reading of the texts, and scanners deal texts of one partition by path; repeated urls and null texts change nothing."""
    texts = [(f"{k}.js", f"fetch('/api/{k}'); fetch('/api/{k}', {{method: 'put'}}); axios.get(\"/api/x/y\"); s.emit('ping{k % 3}'); s.emit('ping{k % 3}');" if k % 7 else None) for k in range(40)] + [("p.html", '<a hx-delete="/api/2/">')]
    spark.createDataFrame(texts, "file_path string, text string").coalesce(1).write.parquet(place := str(tmp_path / "texts"))
    files = spark.read.parquet(place)
    routes = spark.createDataFrame([("one", "/api/<id>"), ("two", "/api/<id>")], "handler string, url string")
    events = spark.createDataFrame([("on", "ping1"), ("on", "ping1"), ("off", "ping9")], "handler string, event string")
    links = web_code.cross_language_edges(files, routes, events)
    assert not any("/texts/" in f for f in links.inputFiles())
    asked = {f"{k}.js" for k in range(40) if k % 7} | {"p.html"}
    assert sorted(map(tuple, links.collect())) == sorted([(f, "one", "http_fetch") for f in asked] + [(f"{k}.js", "on", "cross_language") for k in range(40) if k % 7 and k % 3 == 1])
    for rows in (web_code.element_requests(files), web_code.inline_handlers(files), web_code.declarations(files)):
        assert rows.rdd.getNumPartitions() >= 4


def test_structured_files(spark):
    machine = {"states": [{"id": "s1"}, {"id": "s2"}], "transitions": [{"from": "s1", "to": "s2", "action": "go", "guard": "ok"}]}
    files = spark.createDataFrame([("m.json", json.dumps(machine)), ("x.json", "{bad"), ("n.json", None), ("l.json", "[1, 2]")], "file_path string, text string")
    assert {r["file_path"]: r["shape"] for r in structured.scan_json(files).collect()} == {"m.json": "graph", "x.json": "invalid", "n.json": "invalid", "l.json": "none"}
    assert {(r["kind"], r["name"], r["target"]) for r in structured.machine_parts(files).collect()} == {("node", "s1", None), ("node", "s2", None), ("link", "s1", "s2"), ("action", "go", None), ("guard", "ok", None)}


def test_refresh_keeps_the_newest(spark, tmp_path):
    schema = "file_path string, version long, name string"
    inbox, target = str(tmp_path / "in"), str(tmp_path / "table")
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
    run = lambda: refresh.refresh_table(refresh.arriving(spark, inbox, schema), target, str(tmp_path / "cp")).awaitTermination()
    put([("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z")])
    run()
    put([("a", 2, "x2"), ("b", 0, "old")])
    run()
    assert sorted((r["file_path"], r["version"], r["name"]) for r in spark.read.parquet(target).collect()) == [("a", 2, "x2"), ("b", 1, "z")]


def test_running_drift(spark, tmp_path):
    spark.createDataFrame([("c", 1), ("c", 1), ("d", 0)], "contract_name string, violation int").write.parquet(str(tmp_path / "in"))
    rows = refresh.drift_counts(refresh.arriving(spark, str(tmp_path / "in"), "contract_name string, violation int"))
    q = rows.writeStream.format("memory").queryName("drift_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("drift_now").collect()] == [("c", 2, "recurring")]
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_scratch_tables_are_removed(spark):
    """What a scratch keeps can be read after it; the rest is gone, inner scratches' too."""
    import os

    table = lambda k: shared.written(spark.range(k), "t")
    place = lambda df: shared.local_path(df.written_to)
    with shared.scratch(spark) as keep:
        one, two = table(1), keep(table(2))
        with shared.scratch(spark) as inner:
            three, four = table(3), inner(table(4))
        assert not os.path.exists(place(three)) and four.count() == 4
    assert two.count() == 2 and not os.path.exists(place(one)) and not os.path.exists(place(four))
    assert os.path.exists(place(table(5)))


def test_rows_of_some_kinds_are_those_of_all(spark):
    """Kinds asked for alone are the rows that a whole parse has of them, and no others; files share batches."""
    texts = {"a.py": CODE, "b.py": "def x(:\n", "c.py": "class A:\n    def __init__(self):\n        self.n, self.m = Store(), 0\n    def go(self):\n        global k\n        if self.n and k:\n            raise NotImplementedError\n        self.n = op.join(f(k))\n        return {'k': 1}\n"}
    every = [r for p, t in texts.items() for r in python_code.rows_of(p, t)]
    assert {r[0] for r in every} >= {"layout", "conditional", "response", "attribute", "chain", "mutation", "flow", "error"}
    for kinds in python_code.KINDS.values():
        some = [r for p, t in texts.items() for r in python_code.rows_of(p, t, frozenset(kinds))]
        assert sorted(map(repr, some)) == sorted(repr(r) for r in every if r[0] in kinds)
    files = spark.createDataFrame([(f"f{k}.py", "import os\nos.path.join(a)\n") for k in range(300)], "file_path string, text string")
    batches = python_code.parse_files(files, ("import",)).mapInArrow(lambda rows: (b.select(["number"]).slice(0, 1) for b in rows), "number int")
    assert python_code.parse_files(files, ("import",)).count() == 300 and batches.count() <= 16
