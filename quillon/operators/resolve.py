"""What a referenced name is: built in, bound at run time, of the standard library, of the project, external or unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def runtime_bindings(names: DataFrame, bindings: DataFrame) -> DataFrame:
    """(name, bound_to) of the names that ``bindings(variable, bound_to)`` explain: by the variable itself, as what a variable is bound to, or by the longest prefix that is a variable.

    Prefixes are joined by equality; of several bindings of a variable the
    smallest counts.
    """
    own = names.select("name").filter("name <> ''").distinct()
    held = bindings.groupBy("variable").agg(F.min("bound_to").alias("bound_to"))
    keys = F.posexplode(F.reverse(N.prefix_keys("name"))).alias("cut", "variable")
    by_prefix = own.select("name", keys).join(held, "variable").groupBy("name").agg(F.min(F.struct("cut", "bound_to")).alias("b")).select("name", (F.col("b.cut") == 0).alias("exact"), F.col("b.bound_to").alias("by_prefix"))
    values = held.select(F.col("bound_to").alias("name")).distinct().withColumn("is_value", F.lit(True))
    rows = own.join(by_prefix, "name", "left").join(values, "name", "left")
    bound = F.when(F.col("exact"), F.col("by_prefix")).when(F.col("is_value"), F.col("name")).otherwise(F.col("by_prefix"))
    return rows.select("name", bound.alias("bound_to")).filter("bound_to IS NOT NULL")


def resolve_types(names: DataFrame, bindings: DataFrame, project: DataFrame) -> DataFrame:
    """(name, type, bound_to) of each distinct name: builtin by its first segment, runtime, stdlib by its first segment, project by its last, external where it is dotted, else unknown."""
    own = names.select("name").distinct()
    leaves = project.select(N.normalize_symbol("symbol").alias("leaf")).distinct().withColumn("is_project", F.lit(True))
    rows = own.join(runtime_bindings(own, bindings), "name", "left").withColumn("leaf", N.normalize_symbol("name")).join(leaves, "leaf", "left")
    root, c = N.first_segment("name"), F.col("name")
    kind = (F.when(c.isNull() | (c == ""), "unknown").when(root.isin(*N.PYTHON_BUILTINS), "builtin").when(F.col("bound_to").isNotNull(), "runtime").when(root.isin(*N.STDLIB_MODULES), "stdlib")
            .when(F.col("is_project"), "project").when(c.contains("."), "external").otherwise("unknown"))
    return rows.select("name", kind.alias("type"), F.when(kind == "runtime", F.col("bound_to")).alias("bound_to"))
