"""Checks, contracts and summaries over references, edges and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def builtin_symbols(refs: DataFrame) -> DataFrame:
    """Symbols whose buckets, as caller or callee, are all builtin; null buckets have no say."""
    ends = refs.select(F.explode(F.array("caller", "callee")).alias("symbol"), "bucket").filter("symbol IS NOT NULL")
    return ends.groupBy("symbol").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).filter("low = 'builtin' AND high = 'builtin'").select("symbol")


def bucket_summary(refs: DataFrame) -> DataFrame:
    """References by project, builtin and classification_gap; missing ones are 0."""
    folded = refs.groupBy(F.when(F.col("bucket").isin("project", "builtin"), F.col("bucket")).otherwise("classification_gap").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = refs.sparkSession.createDataFrame([("project",), ("builtin",), ("classification_gap",)], "bucket string")
    return names.join(folded, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def file_reference_map(refs: DataFrame) -> DataFrame:
    return refs.groupBy("file_path").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("callee").alias("callees"), F.count_if(F.col("callee").isNull() | (F.col("callee") == "")).alias("missing"))


def system_summary(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value) rows: edges, files, references and references by bucket."""
    one = edges.agg(F.count(F.lit(1)).alias("value")).select(F.lit("edge_count").alias("metric"), "value")
    two = refs.agg(F.countDistinct("file_path").alias("file_count"), F.count(F.lit(1)).alias("reference_count")).unpivot([], ["file_count", "reference_count"], "metric", "value")
    return one.unionByName(two).unionByName(bucket_summary(refs).select(F.concat(F.lit("bucket_"), "bucket").alias("metric"), F.col("n").alias("value")))


def validate_graph(edges: DataFrame) -> DataFrame:
    """(severity, kind, n): missing ends are errors, self-edges warnings, an empty graph an error, under 10 edges a warning."""
    got = edges.agg(
        F.count_if(F.col("caller").isNull() | (F.col("caller") == "")).alias("missing_caller"), F.count_if(F.col("callee").isNull() | (F.col("callee") == "")).alias("missing_callee"),
        F.count_if(F.col("caller") == F.col("callee")).alias("self_edge"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("empty_graph"),
        F.when(F.count(F.lit(1)) < 10, 1).otherwise(0).cast("long").alias("small_graph"))
    rows = got.unpivot([], ["missing_caller", "missing_callee", "self_edge", "empty_graph", "small_graph"], "kind", "n")
    return rows.filter("n > 0").select(F.when(F.col("kind").isin("self_edge", "small_graph"), "warning").otherwise("error").alias("severity"), "kind", "n")


def integrity(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): null ends, and by how much edges and references differ in number."""
    ends = refs.agg(F.count_if(F.col("caller").isNull()).alias("null_caller"), F.count_if(F.col("callee").isNull()).alias("null_callee"), F.count(F.lit(1)).alias("n_refs"))
    total = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    both = ends.unpivot([], ["null_caller", "null_callee", "n_refs"], "kind", "n").unionByName(total.select(F.lit("n_edges").alias("kind"), F.col("n_edges").alias("n")))
    return both.agg(F.sum(F.when(F.col("kind") == "null_caller", F.col("n"))).alias("null_caller"), F.sum(F.when(F.col("kind") == "null_callee", F.col("n"))).alias("null_callee"),
                    F.sum(F.when(F.col("kind") == "n_edges", F.col("n")).when(F.col("kind") == "n_refs", -F.col("n"))).alias("edges_minus_refs")).unpivot([], ["null_caller", "null_callee", "edges_minus_refs"], "kind", "n")


def structural_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """(side, caller, callee): distinct pairs that only one of two edge sets has."""
    a, b = one.select("caller", "callee"), two.select("caller", "callee")
    return a.subtract(b).select(F.lit("only_first").alias("side"), "*").unionByName(b.subtract(a).select(F.lit("only_second").alias("side"), "*"))


def count_diff(one: DataFrame, two: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, first, second) where the numbers of rows of two tables differ."""
    a, b = one.groupBy(key).agg(F.count(F.lit(1)).alias("first")), two.groupBy(key).agg(F.count(F.lit(1)).alias("second"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("second", F.lit(0)).alias("second"))
    return both.filter("first <> second")


# Contracts


def drift(reports: DataFrame) -> DataFrame:
    """(contract_name, n, classification, severity, layer): transient 1, recurring 2 to 3, structural beyond; the last report's severity and layer."""
    bad = reports.filter("violation > 0")
    got = bad.groupBy("contract_name").agg(F.count(F.lit(1)).alias("n"), F.max_by("severity", "seq").alias("severity"), F.max_by("layer", "seq").alias("layer"))
    return got.select("contract_name", "n", F.when(F.col("n") == 1, "transient").when(F.col("n") <= 3, "recurring").otherwise("structural").alias("classification"), "severity", "layer")


def health(history: DataFrame) -> DataFrame:
    """(contract_name, n, stability, trend) of rows (contract_name, classification): 1 - (3 structural + 2 recurring + transient) / n / 5, at least 0."""
    is_ = lambda k: F.count_if(F.col("classification") == k)
    got = history.groupBy("contract_name").agg(F.count(F.lit(1)).alias("n"), is_("structural").alias("s"), is_("recurring").alias("r"), is_("transient").alias("t"))
    stability = F.greatest(F.lit(0.0), 1 - (3 * F.col("s") + 2 * F.col("r") + F.col("t")) / F.col("n") / 5)
    got = got.withColumn("stability", F.bround(stability, 3))
    trend = F.when(F.col("s") > F.col("r"), "degrading").when((F.col("t") > F.col("s")) & (F.col("r") == 0), "improving").otherwise("stable")
    return got.select("contract_name", "n", "stability", trend.alias("trend"))


#: What is advised in each state.
ADVICE = {
    "ACTIVE": "no action", "STABLE": "monitor", "DEGRADING": "investigate usage shift", "UNSTABLE": "review contract definition", "STALE": "insufficient signal", "OBSOLETE": "candidate for removal"}


def lifecycle(healths: DataFrame) -> DataFrame:
    """(contract_name, state, recommendation): the first state whose condition holds."""
    s, n, trend = F.col("stability"), F.col("n"), F.col("trend")
    state = (F.when((s > 0.85) & (trend == "stable"), "ACTIVE").when(s.between(0.7, 0.85), "STABLE").when(trend == "degrading", "DEGRADING")
             .when((s < 0.5) & (n > 5), "UNSTABLE").when(n <= 2, "STALE").otherwise("OBSOLETE"))
    advice = F.create_map(*(F.lit(x) for item in ADVICE.items() for x in item))
    return healths.select("contract_name", state.alias("state")).withColumn("recommendation", F.element_at(advice, F.col("state")))


def file_contracts(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, rule): files with missing callees, and files with references but no edges."""
    missing = refs.filter(F.col("caller").isNull() | (F.col("caller") == "") | F.col("callee").isNull() | (F.col("callee") == "")).select("file_path", F.lit("missing_reference").alias("rule"))
    bare = refs.select("file_path").join(edges.select(F.col("caller_file").alias("file_path")), "file_path", "left_anti").select("file_path", F.lit("references_without_edges").alias("rule"))
    return missing.unionByName(bare).distinct()


def stability(reports: DataFrame) -> DataFrame:
    """(file_path, violations, stable)."""
    got = reports.groupBy("file_path").agg(F.sum("violation").cast("long").alias("violations"))
    return got.withColumn("stable", F.col("violations") == 0)


#: Weights and thresholds of the risk terms.
CYCLE_RISK, HOTSPOT_THRESHOLD, HOTSPOT_RISK = 0.35, 50, 0.10
ERROR_RISK, ERROR_CAP = 0.08, 0.40
DRIFT_SCALE, DRIFT_THRESHOLD = 0.40, 0.30
DENSITY_THRESHOLD, SCALE_RISK = 20, 0.10
COMPLETENESS_RISK = 0.05
SEED_ZERO_RISK, SEED_SPARSE_RISK, SEED_SPARSE_MAX = 0.25, 0.10, 3
EXPANSION_SPARSE_RISK, EXPANSION_LEAST = 0.10, 2.0
INTERPRETIVE_RISK, INTERPRETIVE = 0.10, ("debug_query", "general_query")
RISK_TERMS = ("structure", "integrity", "stability", "scale", "complexity", "completeness", "query_grounding", "query_coverage", "query_intent")


def epistemic_risk(states: DataFrame) -> DataFrame:
    """``states`` with its risk terms, their sum within [0, 1] as severity, and the surfaces to be shown.

    Columns taken: has_cycles, errors, unstable, contracts, edges, files,
    top_degree, role_files; and of a question seed_count, expanded_count and
    intent, which are null where there is none and then add nothing.
    """
    c, zero = F.col, F.lit(0.0)
    ratio = F.when(c("contracts") > 0, c("unstable") / c("contracts")).otherwise(0.0)
    asked = c("intent").isNotNull()
    widened = c("expanded_count") / F.greatest(c("seed_count"), F.lit(1))
    terms = {
        "structure": F.when(c("has_cycles"), CYCLE_RISK), "integrity": F.least(c("errors") * ERROR_RISK, F.lit(ERROR_CAP)), "stability": ratio * DRIFT_SCALE,
        "scale": F.when(c("edges") / F.greatest(c("files"), F.lit(1)) > DENSITY_THRESHOLD, SCALE_RISK), "complexity": F.when(c("top_degree") > HOTSPOT_THRESHOLD, HOTSPOT_RISK),
        "completeness": F.when(c("role_files") == 0, COMPLETENESS_RISK),
        "query_grounding": F.when(asked & (c("seed_count") == 0), SEED_ZERO_RISK).when(asked & (c("seed_count") <= SEED_SPARSE_MAX), SEED_SPARSE_RISK),
        "query_coverage": F.when(asked & (widened < EXPANSION_LEAST), EXPANSION_SPARSE_RISK), "query_intent": F.when(c("intent").isin(*INTERPRETIVE), INTERPRETIVE_RISK),
    }
    rows = states.withColumns({f"risk_{k}": F.coalesce(v.cast("double"), zero) for k, v in terms.items()})
    total = zero
    for k in RISK_TERMS:
        total = total + c(f"risk_{k}")
    surfaces = F.array(F.lit("INTEGRITY"), F.when(c("has_cycles"), "STRUCTURE"), F.when(ratio > DRIFT_THRESHOLD, "STABILITY"), F.when(c("top_degree") > HOTSPOT_THRESHOLD, "SUMMARY"))
    return rows.withColumn("severity", F.greatest(zero, F.least(F.lit(1.0), F.round(total, 9)))).withColumn("surfaces", F.array_join(surfaces, ","))


#: Words by which paths and callees show a file's role.
ROLE_WORDS = {
    "ingestion": ("scan", "parse", "ast", "ingestion", "scanner"), "classification": ("classify", "semantic", "symbol", "reference"), "graph": ("graph", "edge", "node", "builder"),
    "persistence": ("sqlite", "database", "persist", "insert", "update"), "reporting": ("report", "summary", "snapshot", "json", "print")}


def responsibilities(refs: DataFrame) -> DataFrame:
    """(file_path, a flag per role) by words in the path and the callees."""
    flags = [F.bool_or(F.coalesce(F.lit(False) | F.lower(F.concat_ws(" ", "file_path", "callee")).rlike("|".join(words)), F.lit(False))).alias(role) for role, words in ROLE_WORDS.items()]
    return refs.groupBy("file_path").agg(*flags)


def responsibility_totals(refs: DataFrame) -> DataFrame:
    return responsibilities(refs).agg(*(F.count_if(F.col(r)).alias(r) for r in ROLE_WORDS)).unpivot([], list(ROLE_WORDS), "role", "files")


def design_facts(functions: DataFrame, edges: DataFrame, min_in: int = 5) -> DataFrame:
    """(name, fact): entry (calls, never called), dead (neither), hot (called by at least ``min_in``)."""
    p = edges.select(N.after_last_dot("caller").alias("caller"), N.after_last_dot("callee").alias("callee")).distinct()
    into = p.groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("i"))
    out = p.groupBy(F.col("caller").alias("name")).agg(F.count(F.lit(1)).alias("o"))
    rows = functions.select("name").distinct().join(into, "name", "left").join(out, "name", "left").na.fill(0, ["i", "o"])
    fact = F.when(F.col("i") >= min_in, "hot").when((F.col("i") == 0) & (F.col("o") > 0), "entry").when((F.col("i") == 0) & (F.col("o") == 0), "dead")
    return rows.select("name", fact.alias("fact")).filter("fact IS NOT NULL")


def intent_coverage(functions: DataFrame, classes: DataFrame, mutations: DataFrame) -> DataFrame:
    """(kind, documented, total); mutations are documented by an operation."""
    def of(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.agg(F.count_if(F.coalesce(F.col(column) != "", F.lit(False))).alias("documented"), F.count(F.lit(1)).alias("total")).select(F.lit(kind).alias("kind"), "documented", "total")
    return of(functions, "functions", "docstring").unionByName(of(classes, "classes", "docstring")).unionByName(of(mutations, "mutations", "operation"))


# Validation of a whole system

#: The buckets that symbols may have, and which of two wins.
BUCKETS = ("project", "builtin", "stdlib", "runtime", "external_lib", "external_unknown", "classification_gap", "unresolved_qualified_reference", "unknown")
PRIORITY = ("project", "builtin", "stdlib", "runtime", "unknown")


def checked_bucket(bucket: Column | str) -> Column:
    """The bucket; one that isn't allowed is an error when the row is read."""
    c = F.col(bucket) if isinstance(bucket, str) else bucket
    return F.when(c.isin(*BUCKETS), c).otherwise(F.raise_error(F.concat(F.lit("invalid bucket "), F.coalesce(c, F.lit("null")))))


def stronger_bucket(current: Column | str, candidate: Column | str) -> Column:
    """The bucket of two that comes first in the order of priority; what isn't in the order comes last, and ties keep the current one."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (current, candidate))
    order = F.array(*(F.lit(p) for p in PRIORITY))
    place = lambda c: F.when(F.array_position(order, c) > 0, F.array_position(order, c)).otherwise(len(PRIORITY) + 1)
    return F.when(place(b) < place(a), b).otherwise(a)


def summarize_reports(reports: DataFrame) -> DataFrame:
    """(what, n): files reported on, violations in all, and by contract."""
    sums = reports.agg(F.countDistinct("file_path").alias("total_files"), F.coalesce(F.sum("violation"), F.lit(0)).cast("long").alias("total_violations")).unpivot([], ["total_files", "total_violations"], "what", "n")
    by = reports.filter("violation > 0").groupBy(F.concat(F.lit("contract:"), "contract_name").alias("what")).agg(F.sum("violation").cast("long").alias("n"))
    return sums.unionByName(by)


def validate_system(refs: DataFrame, edges: DataFrame, reports: DataFrame) -> DataFrame:
    """(severity, message, n): references without an end by line, a graph without edges or with few, and contracts violated as errors."""
    bad = refs.filter(F.coalesce(F.col("caller"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("callee"), F.lit("")).eqNullSafe(""))
    lines = bad.groupBy(F.concat(F.lit("Invalid symbol reference at line "), F.col("line_number").cast("string")).alias("message")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("error").alias("severity"), "message", "n")
    size = edges.agg(F.count(F.lit(1)).alias("n"))
    none = size.filter("n = 0").select(F.lit("error").alias("severity"), F.lit("Graph has zero edges").alias("message"), F.lit(1).cast("long").alias("n"))
    few = size.filter("n < 10").select(F.lit("warning").alias("severity"), F.lit("Low edge count detected").alias("message"), F.lit(1).cast("long").alias("n"))
    broken = reports.filter("violation > 0 AND severity = 'error'").groupBy(F.concat(F.lit("Contract violated: "), "contract_name").alias("message")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("error").alias("severity"), "message", "n")
    return lines.unionByName(none).unionByName(few).unionByName(broken)


def snapshot(refs: DataFrame, edges: DataFrame, functions: DataFrame, classes: DataFrame, reports: DataFrame) -> DataFrame:
    """(metric, value): the reduced state of a corpus: its size, its references by bucket, its stubs and its violations."""
    sums = functions.agg(F.count(F.lit(1)).alias("functions"), F.count_if("is_stub").alias("stubs")).unpivot([], ["functions", "stubs"], "metric", "value")
    kinds = classes.agg(F.count(F.lit(1)).alias("value")).select(F.lit("classes").alias("metric"), "value")
    bad = reports.agg(F.coalesce(F.sum("violation"), F.lit(0)).cast("long").alias("value")).select(F.lit("violations").alias("metric"), "value")
    return system_summary(refs, edges).unionByName(sums).unionByName(kinds).unionByName(bad)


def snapshot_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """(metric, first, second, change) of the metrics that differ between two snapshots; a missing one is 0."""
    both = one.select("metric", F.col("value").alias("first")).join(two.select("metric", F.col("value").alias("second")), "metric", "full_outer").na.fill(0, ["first", "second"])
    return both.withColumn("change", F.col("second") - F.col("first")).filter("change <> 0")
