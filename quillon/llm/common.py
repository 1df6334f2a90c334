"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import bound_batches, local_path, new_folder, open_bytes, parts_for, put_bytes, scratch, shared_dir, written

__all__ = ["bound_batches", "documents", "local_path", "new_folder", "open_bytes", "parts_for", "put_bytes", "scratch", "shared_dir", "unused", "written"]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with as many underscores before them as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
