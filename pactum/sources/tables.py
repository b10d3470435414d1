"""Parquet table loading.

Tables are read lazily; Catalyst prunes columns and pushes filters into the
scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    """Where a table is: one file, or a folder of files."""
    return os.path.join(sf_dir, f"{name}.parquet")


def stream_path(sf_dir: str, name: str) -> str:
    """A table's path for a file stream: as a pattern, so that one file is taken as well as a folder."""
    return os.path.join(sf_dir, f"{name}.parque[t]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over several tasks for each core, dealt by ``keys``.  For narrow rows that get a long
    text next: their bytes tell neither the scan nor the adaptive planner how much work follows."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def register_all(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(name)
