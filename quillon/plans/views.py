"""The seven views of the algebra over a corpus, each metric a plan that is built when asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import assess as A
from ..operators import graph as G


def structure_hotspots(edges, builtins, n: int = 10):
    """Symbols by degree; built-in and noise names left out before the top n is taken."""
    counted = G.degree(edges).filter(~N.is_noise("symbol")).join(builtins, "symbol", "left_anti")
    return counted.orderBy(F.desc("degree"), "symbol").limit(n)


def views_of(corpus) -> dict:
    """View to metric to a function without arguments that gives a DataFrame."""
    c = corpus
    clean = lambda: G.pairs(c.edges).filter(~N.is_noise("caller") & ~N.is_noise("callee"))
    modules = lambda: G.file_of_symbol(c.functions).select("name", N.parent_directory("file_path").alias("module"))
    checks = lambda severity: A.validate_graph(c.edges).filter(F.col("severity") == severity).select("kind", F.col("n").cast("string").alias("subject"))
    summary = lambda: A.system_summary(c.refs, c.edges)
    coverage = lambda kind: A.intent_coverage(c.functions, c.classes, c.mutations).filter(F.col("kind") == kind)
    return {
        "STRUCTURE": {"edges": lambda: c.edges.select("caller", "callee"), "adjacency": lambda: G.adjacency(clean()), "hotspots": lambda: structure_hotspots(c.edges, A.builtin_symbols(c.refs))},
        "STABILITY": {"stable_contracts": lambda: A.stability(c.contract_reports).filter("stable"), "unstable_contracts": lambda: A.stability(c.contract_reports).filter("NOT stable"), "drift_signals": lambda: A.drift(c.contract_reports)},
        "INTEGRITY": {"errors": lambda: checks("error"), "warnings": lambda: checks("warning"), "db_mismatches": lambda: A.integrity(c.refs, c.edges).filter("kind = 'edges_minus_refs' AND n <> 0").select("kind", F.col("n").cast("string").alias("subject"))},
        "SUMMARY": {"edge_count": lambda: summary().filter("metric = 'edge_count'"), "file_count": lambda: summary().filter("metric = 'file_count'"), "metrics": summary},
        "SUBSYSTEM": {"subsystems": lambda: G.subsystems(c.edges, modules(), A.builtin_symbols(c.refs))},
        "ROLE": {"files": lambda: A.responsibilities(c.refs), "totals": lambda: A.responsibility_totals(c.refs)},
        "INTENT": {"functions": lambda: c.functions.filter("docstring <> ''").select("file_path", "name", "docstring"), "classes": lambda: c.classes.filter("docstring <> ''").select("file_path", "name", "docstring"),
                   "mutations": lambda: c.mutations.select("file_path", F.col("function_name").alias("name"), "operation"), "coverage": lambda: coverage("functions").unionByName(coverage("classes")).unionByName(coverage("mutations"))},
    }
