"""A closed query algebra over seven views.

A query is a Select (a view, optionally one of its metrics, optionally a filter
on it) or a Combine of two Selects, which pairs their results and joins nothing.
Plans are checked before any DataFrame is asked for: unknown views, metrics,
filter keys and operators, a bare Filter, nested Combines and pairs that aren't
allowed are errors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    key: str
    op: str
    value: object


@dataclass(frozen=True)
class Select:
    view: str
    metric: str | None = None
    filter: Filter | None = None


@dataclass(frozen=True)
class Combine:
    left: Select
    right: Select


class PlanError(ValueError):
    """A query that the algebra doesn't allow."""


#: The views with their metrics, the keys that filters may name, and the pairs that may be combined.
METRICS = {
    "STRUCTURE": ("edges", "adjacency", "hotspots"), "STABILITY": ("stable_contracts", "unstable_contracts", "drift_signals"), "INTEGRITY": ("errors", "warnings", "db_mismatches"),
    "SUMMARY": ("edge_count", "file_count", "metrics"), "SUBSYSTEM": ("subsystems",), "ROLE": ("files", "totals"), "INTENT": ("functions", "classes", "mutations", "coverage"),
}
FILTER_KEYS = {
    "STRUCTURE": ("edges", "callee", "caller", "hotspots"), "STABILITY": ("stable_contracts", "unstable_contracts"), "SUBSYSTEM": ("modules", "edge_count"), "ROLE": ("file_path",),
    "INTENT": ("file_path", "name"), "INTEGRITY": (), "SUMMARY": (),
}
OPERATORS = ("==", ">", "<", "endswith")
PAIRS = frozenset(frozenset(p) for p in (("STRUCTURE", "STABILITY"), ("STRUCTURE", "INTEGRITY"), ("SUMMARY", "STABILITY"), ("SUBSYSTEM", "STRUCTURE"), ("STABILITY", "INTEGRITY")))
#: Columns of the results that keys stand for, where they differ.
COLUMNS = {"edges": "callee", "hotspots": "degree", "stable_contracts": "file_path", "unstable_contracts": "file_path", "modules": "module", "edge_count": "cross_edges"}


def check_select(q: Select) -> None:
    if q.view not in METRICS:
        raise PlanError(f"unknown view {q.view}")
    if q.metric is not None and q.metric not in METRICS[q.view]:
        raise PlanError(f"{q.view} has no metric {q.metric}")
    if q.filter is not None:
        if q.filter.key not in FILTER_KEYS[q.view]:
            raise PlanError(f"{q.view} can't be filtered by {q.filter.key}")
        if q.filter.op not in OPERATORS:
            raise PlanError(f"unknown operator {q.filter.op}")


def plan(q: object) -> Select | Combine:
    """The query, once it is known to be allowed."""
    if isinstance(q, Select):
        check_select(q)
        return q
    if isinstance(q, Combine):
        for side in (q.left, q.right):
            if not isinstance(side, Select):
                raise PlanError("a Combine takes two Selects")
            check_select(side)
        if frozenset((q.left.view, q.right.view)) not in PAIRS:
            raise PlanError(f"{q.left.view} and {q.right.view} can't be combined")
        return q
    raise PlanError(f"{type(q).__name__} can't be a query")


def apply_filter(data: DataFrame, f: Filter) -> DataFrame:
    """Comparisons take a missing number as 0; a column that a metric lacks is an error."""
    name = COLUMNS.get(f.key, f.key)
    if name not in data.columns:
        raise PlanError(f"this result has no {f.key}")
    c = F.col(name)
    if f.op == "==":
        return data.filter(c == F.lit(f.value))
    if f.op == "endswith":
        return data.filter(c.endswith(str(f.value)))
    c = F.coalesce(c, F.lit(0))
    return data.filter(c > F.lit(f.value) if f.op == ">" else c < F.lit(f.value))


class Executor:
    """Runs plans on views: ``views[view][metric]`` makes a DataFrame when it is needed."""

    def __init__(self, views: dict[str, dict[str, Callable[[], DataFrame]]]):
        self.views = views

    def execute(self, q: object):
        """A DataFrame for a metric, a dict of them for a whole view, a pair of results for a Combine."""
        q = plan(q)
        if isinstance(q, Combine):
            return self.execute(q.left), self.execute(q.right)
        made = self.views[q.view]
        names = (q.metric,) if q.metric else METRICS[q.view]
        out = {}
        for name in names:
            data = made[name]()
            if q.filter and (q.metric or COLUMNS.get(q.filter.key, q.filter.key) in data.columns):
                data = apply_filter(data, q.filter)
            out[name] = data
        return out[q.metric] if q.metric else out


#: The rule table from intents to queries; all others ask for STRUCTURE.
RULES = {
    "impact_query": Combine(Select("STRUCTURE"), Select("INTEGRITY")), "surface_query": Combine(Select("STRUCTURE"), Select("STABILITY")),
    "reverse_query": Combine(Select("STRUCTURE"), Select("INTEGRITY")), "general_query": Combine(Select("STABILITY"), Select("INTEGRITY")), "role_query": Select("ROLE"),
}


def named_file(text: str) -> str | None:
    """The ``*.py`` file that a text names, once; none where it names files more often."""
    found = re.findall(r"\b[\w./\\-]+\.py\b", text or "")
    return found[0] if len(found) == 1 else None


def compile_query(intent: str, text: str = "") -> Select | Combine:
    """Intent and text to an allowed query; a ROLE query for all or for its files that names one file is narrowed to it."""
    q = RULES.get(intent, Select("STRUCTURE"))
    path = named_file(text)
    if isinstance(q, Select) and q.view == "ROLE" and q.metric in (None, "files") and q.filter is None and path:
        q = replace(q, metric="files", filter=Filter("file_path", "endswith", path))
    return plan(q)


def explain(q: Select | Combine) -> str:
    if isinstance(q, Combine):
        return f"{explain(q.left)} beside {explain(q.right)}"
    where = f" where {q.filter.key} {q.filter.op} {q.filter.value!r}" if q.filter else ""
    return f"{q.view}{'.' + q.metric if q.metric else ''}{where}"


def parse(text: str) -> Select | Combine:
    """A query from its JSON form."""

    def node(x: dict) -> Select | Combine:
        if x.get("type") == "combine":
            return Combine(node(x["left"]), node(x["right"]))
        if x.get("type") != "select":
            raise PlanError(f"unknown node {x.get('type')}")
        f = x.get("filter")
        return Select(x["view"], x.get("metric"), Filter(f["key"], f["op"], f["value"]) if f else None)

    return plan(node(json.loads(text)))


def field(q: Select, result, name: str, default=None):
    """A metric out of a result, whether the query asked for the whole view or for that metric; ``default`` where it asked for another."""
    if q.metric == name:
        return result
    return default if q.metric is not None else result.get(name, default)


def compiled_plans(questions: DataFrame) -> DataFrame:
    """(query_id, intent, plan) of ``questions(query_id, raw_query)``: each question's intent, and its query in words."""
    from ..operators.routing import intent_of

    out = F.lit(explain(Select("STRUCTURE")))
    for intent, q in RULES.items():
        out = F.when(F.col("intent") == intent, explain(q)).otherwise(out)
    files = F.regexp_extract_all(F.coalesce("raw_query", F.lit("")), F.lit(r"\b[\w./\\-]+\.py\b"), F.lit(0))
    one = F.concat(F.lit("ROLE.files where file_path endswith '"), F.get(files, F.lit(0)), F.lit("'"))
    rows = questions.withColumn("intent", intent_of("raw_query"))
    return rows.select("query_id", "intent", F.when((F.col("intent") == "role_query") & (F.size(files) == 1), one).otherwise(out).alias("plan"))
