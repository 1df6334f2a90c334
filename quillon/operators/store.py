"""Artifacts, work items, bags, summaries and their freshness, as tables that operators read and rewrite.

A rewrite gives the new table; what a caller writes back is whole, so no row
is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import first_per_key

#: How far a provenance is trusted.
PROVENANCE = {"human-confirmed": 3, "ai-confirmed-by-human": 2, "ai-generated": 1}


def provenance_rank(column: str = "provenance"):
    out = F.lit(0)
    for name, rank in PROVENANCE.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def add_artifacts(table: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows of a known provenance; others are an error when the rows are read."""
    checked = new.withColumn("provenance", F.when(provenance_rank() > 0, F.col("provenance")).otherwise(F.raise_error(F.concat(F.lit("unknown provenance "), F.coalesce("provenance", F.lit("null"))))))
    return table.unionByName(checked.select(table.columns))


def artifacts_by_trust(table: DataFrame) -> DataFrame:
    """Rows with their place within a subject: most trusted first, then newest, then by id."""
    return table.withColumn("trust", provenance_rank()).withColumn("place", F.row_number().over(_by_subject()))


def _by_subject():
    from pyspark.sql import Window

    return Window.partitionBy("subject").orderBy(F.desc(provenance_rank()), F.desc("created_at"), "id")


def highest_provenance(table: DataFrame) -> DataFrame:
    """The most trusted row of each subject."""
    return first_per_key(table, ["subject"], [F.desc(provenance_rank()), F.desc("created_at"), F.col("id")])


def flag_stale(table: DataFrame, hashes: DataFrame) -> DataFrame:
    """``needs_review`` where the file's current hash isn't the artifact's; files that are gone need review too."""
    now = hashes.select(F.col("file_path").alias("subject"), F.col("file_hash").alias("now"))
    return table.join(now, "subject", "left").withColumn("needs_review", ~F.col("file_hash").eqNullSafe(F.col("now"))).drop("now")


def stale_since(table: DataFrame, files: DataFrame) -> DataFrame:
    """``stale`` where an artifact is older than the last ingest."""
    last = files.agg(F.max("ingested_at").alias("last")).first()["last"]  # one row
    return table.withColumn("stale", F.lit(False) if last is None else F.coalesce(F.col("created_at") < F.lit(last), F.lit(True)))


def cascade_stale(artifacts: DataFrame, feeds: DataFrame) -> DataFrame:
    """(name) of what is stale after all: ``artifacts(name, stale)`` and whatever they feed, ``feeds(name, into)``, to the fixpoint."""
    step = written(feeds.select("name", F.col("into").alias("to")).distinct(), "feeds")
    seen = front = written(artifacts.filter("stale").select("name").distinct(), "stale")
    while True:
        front = written(front.join(step, "name").select(F.col("to").alias("name")).distinct().join(seen, "name", "left_anti"), "stale")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def rerank(items: DataFrame, order: list[int]) -> DataFrame:
    """Ranks 1 to n in the order given; other items keep theirs. The order is a caller's list of ids."""
    spark = items.sparkSession
    given = spark.createDataFrame(list(zip(order, range(1, len(order) + 1), strict=True)), "id long, new_rank int")
    return items.join(given, "id", "left").withColumn("rank", F.coalesce("new_rank", "rank")).drop("new_rank")


def work_list(items: DataFrame) -> DataFrame:
    """Items with their queue: in progress first, then the ranked, then the backlog."""
    return items.withColumn("queue", F.when(F.col("status") == "in_progress", "in_progress").when(F.col("rank").isNotNull(), "next_up").otherwise("backlog"))


def bag_add(bag: DataFrame, new: DataFrame) -> DataFrame:
    """Add items whose (bag_id, key) isn't there yet; of equal new keys the smallest content stays."""
    fresh = first_per_key(new, ["bag_id", "key"], [F.col("content"), F.col("item_type")]).join(bag.select("bag_id", "key"), ["bag_id", "key"], "left_anti")
    return bag.unionByName(fresh.select(bag.columns))


def bag_status(bag: DataFrame) -> DataFrame:
    return bag.groupBy("bag_id", "item_type").agg(F.count(F.lit(1)).alias("items"))


def fresh_summaries(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """(subject, kind, summary, fresh): a cached summary counts while its source's hash is the same."""
    key = sources.withColumn("hash", F.sha2(F.coalesce("source_text", F.lit("")), 256))
    held = cache.select("subject", "kind", F.col("hash").alias("held_hash"), "summary")
    return key.join(held, ["subject", "kind"], "left").select("subject", "kind", F.when(F.col("hash") == F.col("held_hash"), F.col("summary")).alias("summary"), F.coalesce(F.col("hash") == F.col("held_hash"), F.lit(False)).alias("fresh"))


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, name, change): added, removed, updated or unchanged by signature."""
    a = old.select("file_path", "name", F.struct("signature").alias("was"))
    b = new.select("file_path", "name", F.struct("signature").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("updated")
    return a.join(b, ["file_path", "name"], "full_outer").select("file_path", "name", change.alias("change"))


def apply_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table with every file of ``new`` replaced by its rows."""
    return old.join(new.select("file_path").distinct(), "file_path", "left_anti").unionByName(new.select(old.columns))


def changed_files(disk: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path) of files newer than their ingest, or never ingested."""
    held = files.select("file_path", "ingested_at")
    return disk.join(held, "file_path", "left").filter("ingested_at IS NULL OR mtime > ingested_at").select("file_path")


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Append items without ids; they take the numbers after the largest, in order of title."""
    last = items.agg(F.max("id").alias("m")).first()["m"] or 0  # one row
    from pyspark.sql import Window

    numbered = new.withColumn("id", (F.row_number().over(Window.orderBy("title")) + last).cast("long"))  # a caller's few items
    return items.unionByName(numbered.select(items.columns))


def update_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with the fields of ``changes(id, ...)`` put in where they aren't null; unknown ids change nothing."""
    fields = [c for c in changes.columns if c != "id"]
    given = changes.select("id", *(F.col(c).alias(f"new_{c}") for c in fields))
    joined = items.join(given, "id", "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in items.columns))


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table without the rows whose key is among ``ids``; rows without a key stay."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def store_artifact(table: DataFrame, new: DataFrame) -> DataFrame:
    """Put rows in place of those of the same subject and kind, or beside the others."""
    return table.join(new.select("subject", "kind").distinct(), ["subject", "kind"], "left_anti").unionByName(new.select(table.columns))


def bag_labels(bags: DataFrame, labels: DataFrame) -> DataFrame:
    """``bags(bag_id, label)`` with the labels given put in or changed."""
    return bags.join(labels.select("bag_id").distinct(), "bag_id", "left_anti").unionByName(labels.select(bags.columns))


def bag_clear(bag: DataFrame, bag_id: str) -> DataFrame:
    return bag.filter(F.col("bag_id") != bag_id)


def bag_report(bag: DataFrame, bags: DataFrame) -> DataFrame:
    """(bag_id, label, item_type, items, keys): what each bag holds, keys in order."""
    rows = bag.groupBy("bag_id", "item_type").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))
    return rows.join(bags, "bag_id", "left").select("bag_id", "label", "item_type", "items", "keys")
