"""Incremental refresh: file facts and contract reports that arrive as files, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def newest(batch: DataFrame) -> DataFrame:
    """Of a batch's rows of a file, those of its newest version."""
    last = batch.groupBy("file_path").agg(F.max("version").alias("version"))
    return batch.join(last, ["file_path", "version"], "left_semi")


def refresh_table(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep ``target`` at the newest version of every file of ``rows(file_path, version, ...)``.

    Each batch replaces the partitions of its files' buckets: rows of files that
    the batch doesn't bring, or brings in an older version, are carried over.
    Replaying a batch gives the same table, so a lost driver does no harm.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = newest(batch).withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(64)).cast("int"))
        if new.isEmpty():
            return
        try:
            old = spark.read.parquet(target)
        except Exception as e:  # the first batch has no table to read
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        merged = new
        if old is not None:
            buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # 64 at most; other partitions aren't read
            touched = old.filter(F.col("bucket").isin(buckets))
            merged = newest(touched.unionByName(new)).dropDuplicates()
        staged = f"{target}-staged"  # read whole before the partitions that it comes from are replaced
        merged.write.mode("overwrite").parquet(staged)
        now = spark.read.parquet(staged)
        now.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift_counts(reports: DataFrame) -> DataFrame:
    """Running (contract_name, n, classification) of violations."""
    got = reports.filter("violation > 0").groupBy("contract_name").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("classification", F.when(F.col("n") == 1, "transient").when(F.col("n") <= 3, "recurring").otherwise("structural"))


def windowed_drift(reports: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(contract_name, start, n) by event time; reports later than ``late`` are left out once a window closes."""
    w = F.window("timestamp", width)
    rows = reports.withWatermark("timestamp", late).filter("violation > 0").groupBy("contract_name", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("contract_name", F.col("w.start").alias("start"), "n")
