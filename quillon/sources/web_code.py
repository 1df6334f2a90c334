"""Links between web pages, scripts and their handlers, and functions of other languages, by regular expressions.

Patterns are stated plainly per language; they find declarations and calls line
by line and don't build a syntax tree, so nested or macro-made code may be
missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .shared import spread, written

#: Declarations of functions: the first group is the name.
DECLARATIONS = {
    "javascript": r"(?:^|\s)(?:async\s+)?function\s+(\w+)\s*\(|(?:^|\s)(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    "typescript": r"(?:^|\s)(?:async\s+)?function\s+(\w+)\s*[(<]|(?:^|\s)(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "zig": r"^\s*(?:pub\s+)?fn\s+(\w+)\s*\(", "lua": r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*\(",
    "c": r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{", "cpp": r"^[A-Za-z_][\w\s*&:<>,]*?\b([\w:~]+)\s*\([^;]*\)[^;]*\{", "cuda": r"^(?:__global__|__device__|__host__)[\w\s*]*?\b(\w+)\s*\(",
}
CALL = r"\b([A-Za-z_][\w.]*)\s*\("
#: Requests for urls, by the caller: scripts and elements of pages; and events sent to a server.
FETCH = r"fetch\(\s*['\"`]([^'\"`]+)['\"`](?:\s*,\s*\{[^}]*method\s*:\s*['\"](\w+)['\"])?"
AXIOS = r"axios\.(get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)['\"`]"
ELEMENT = r"hx-(get|post|put|delete|patch)=[\"']([^\"']+)[\"']"
EMIT = r"\.emit\(\s*['\"]([\w:.-]+)['\"]"
KEYWORDS = ("if", "for", "while", "switch", "return", "function", "func", "fn", "catch", "sizeof", "match", "and", "or", "not")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(file_path, language, line_number, line)."""
    rows = spread(files.select("file_path", "text")).select("file_path", N.language("file_path").alias("language"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "line"))
    return rows.select("file_path", "language", (F.col("p") + 1).alias("line_number"), "line")


def declarations(files: DataFrame) -> DataFrame:
    """(file_path, language, name, line_number) of functions in nine languages."""
    name = F.lit(None).cast("string")
    for lang, pattern in DECLARATIONS.items():
        groups = 2 if lang in ("javascript", "typescript") else 1
        found = F.concat(*(F.regexp_extract("line", pattern, g + 1) for g in range(groups)))
        name = F.when(F.col("language") == lang, found).otherwise(name)
    return numbered_lines(files).withColumn("name", name).filter("name <> ''").filter(~F.col("name").isin(*KEYWORDS)).select("file_path", "language", "name", "line_number")


def enclosing_calls(files: DataFrame) -> DataFrame:
    """(caller, callee, line_number, caller_file): calls placed in the last function declared before them.

    The place is a running maximum over a file's lines, so a range join isn't
    needed; a file's lines are one window group.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file_path").orderBy("line_number")
    declared = declarations(files).select("file_path", "line_number", "name")
    rows = numbered_lines(files).filter("language <> 'python'").join(declared, ["file_path", "line_number"], "left")
    placed = rows.withColumn("caller", F.last("name", ignorenulls=True).over(w))
    calls = placed.select("caller", F.explode(F.regexp_extract_all("line", F.lit(CALL), F.lit(1))).alias("callee"), "line_number", F.col("file_path").alias("caller_file"), "name")
    return calls.filter(~F.col("callee").isin(*KEYWORDS) & ~F.col("callee").eqNullSafe(F.col("name"))).select(F.coalesce("caller", F.lit("<module>")).alias("caller"), "callee", "line_number", "caller_file")


def cuda_launches(files: DataFrame) -> DataFrame:
    """(caller_file, callee, line_number) of ``name<<<...>>>`` launches."""
    found = F.regexp_extract_all("line", F.lit(r"(\w+)\s*<<<"), F.lit(1))
    return numbered_lines(files).filter("language = 'cuda'").select(F.col("file_path").alias("caller_file"), F.explode(found).alias("callee"), "line_number")


def _found(files: DataFrame, pattern: str, groups: list[str]) -> DataFrame:
    """(file_path, groups...) of every match of a pattern in whole texts, which are dealt over all cores."""
    hits = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))
    rows = spread(files.select("file_path", "text")).select("file_path", F.explode(hits).alias("hit"))
    return rows.select("file_path", *(F.regexp_extract("hit", pattern, k + 1).alias(g) for k, g in enumerate(groups)))


def fetch_calls(files: DataFrame) -> DataFrame:
    """(file_path, method, url) of fetch and axios calls; fetch without an options method is GET."""
    fetch, axios = _found(files, FETCH, ["url", "method"]), _found(files, AXIOS, ["method", "url"])
    both = fetch.select("file_path", F.when(F.col("method") == "", "GET").otherwise(F.upper("method")).alias("method"), "url").unionByName(axios.select("file_path", F.upper("method").alias("method"), "url"))
    return both.distinct()


def element_requests(files: DataFrame) -> DataFrame:
    """(file_path, method, url) of hx-get and its like."""
    return _found(files, ELEMENT, ["method", "url"]).withColumn("method", F.upper("method"))


def inline_handlers(files: DataFrame) -> DataFrame:
    """(file_path, event, handler) of inline attributes."""
    return _found(files, r"\bon(\w+)=[\"']\s*(\w+)\s*\(", ["event", "handler"])


def listeners(files: DataFrame) -> DataFrame:
    """(file_path, event, handler) of addEventListener with a named function."""
    return _found(files, r"addEventListener\(\s*['\"](\w+)['\"]\s*,\s*(\w+)\s*[,)]", ["event", "handler"])


def emitted_events(files: DataFrame) -> DataFrame:
    return _found(files, EMIT, ["event"])


def native_calls(files: DataFrame) -> DataFrame:
    """(file_path, callee) of calls on variables bound to a loaded native library; underscore names are skipped."""
    loaded = _found(files, r"(\w+)\s*=\s*(?:ctypes\.)?(?:CDLL|cdll\.LoadLibrary|WinDLL|PyDLL)\(", ["variable"]).distinct()
    called = _found(files, r"\b(\w+)\.([A-Za-z]\w*)\s*\(", ["variable", "callee"])
    return called.join(loaded, ["file_path", "variable"]).select("file_path", "callee").distinct()


def matched_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls(file_path, url) with the handler of routes(handler, url) that matches segment by segment, the first by name."""
    return _routed(calls, routes).distinct()


def _routed(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``matched_routes`` with a row for each call.

    Each distinct url is matched once. One without parameters joins on its text
    with the wildcards of a pattern put in, for the few placements of wildcards
    that patterns of its length have; only urls with parameters of their own
    meet all patterns of their length.
    """
    a = written(calls.withColumn("client", N.normalize_url("url")), "asked-urls")  # both sides are parsed from texts and used twice
    urls = a.select("client").distinct().withColumn("segments", F.size(F.split("client", "/")))
    b = routes.select("handler", N.normalize_url("url").alias("pattern")).groupBy("pattern").agg(F.min("handler").alias("handler"))
    b = written(b, "routes").withColumn("segments", F.size(F.split("pattern", "/")))
    mask = F.array_join(F.transform(F.split("pattern", "/"), lambda x: F.when(x == "*", "*").otherwise("")), "/")
    masks = b.select("segments", mask.alias("mask")).distinct()
    put = F.array_join(F.zip_with(F.split("client", "/"), F.split("mask", "/"), lambda x, m: F.when(m == "*", m).otherwise(x)), "/")
    plain = urls.filter(~F.col("client").contains("*")).join(masks, "segments").select("client", put.alias("pattern")).join(b, "pattern").select("client", "handler")
    open_ = urls.filter(F.col("client").contains("*")).join(b, "segments").filter(N.url_matches(F.col("client"), F.col("pattern"))).select("client", "handler")
    hits = plain.unionByName(open_).groupBy("client").agg(F.min("handler").alias("handler"))
    return a.join(hits, "client").select(*calls.columns, "handler")


def cross_language_edges(files: DataFrame, routes: DataFrame, events: DataFrame) -> DataFrame:
    """(caller_file, callee, edge_type): requests to handlers by url, and emitted events to handlers by name. Texts are read once, for both."""
    every = lambda pattern, group: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(group))
    urls = F.array_distinct(F.concat(every(FETCH, 1), every(AXIOS, 2), every(ELEMENT, 2)))
    found = written(spread(files.select("file_path", "text")).select(F.col("file_path").alias("caller_file"), urls.alias("urls"), F.array_distinct(every(EMIT, 1)).alias("events")), "requests")
    asked = _routed(found.select("caller_file", F.explode("urls").alias("url")), routes)
    http = asked.select("caller_file", F.col("handler").alias("callee"), F.lit("http_fetch").alias("edge_type"))
    sent = found.select("caller_file", F.explode("events").alias("event")).join(events.select("event", "handler").distinct(), "event")
    return http.unionByName(sent.select("caller_file", F.col("handler").alias("callee"), F.lit("cross_language").alias("edge_type"))).distinct()


def trace_route(url: Column | str, files: DataFrame, routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, item) of a url: its handlers, the files that ask for it, and what the handlers call."""
    want = N.normalize_url(F.lit(url)) if isinstance(url, str) else N.normalize_url(url)
    handlers = routes.filter(N.url_matches(want, N.normalize_url("url"))).select("handler").distinct()
    clients = matched_routes(fetch_calls(files), routes).join(handlers, "handler", "left_semi").select("file_path").distinct()
    called = edges.join(handlers.select(F.col("handler").alias("caller")), "caller", "left_semi").select("callee").distinct()
    rows = [("handler", handlers, "handler"), ("client", clients, "file_path"), ("callee", called, "callee")]
    out = None
    for step, df, c in rows:
        one = df.select(F.lit(step).alias("step"), F.col(c).alias("item"))
        out = one if out is None else out.unionByName(one)
    return out
