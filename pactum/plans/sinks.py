"""Sinks and schema checks.

Writers go through the DataFrame writer (distributed; nothing is collected).
"Latest" outputs are written to a fresh folder and a small pointer file is
switched afterwards, so readers never see a half-written snapshot and a job
never overwrites the path it is reading.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, out_dir: str, stamp: _dt.datetime | None = None,
                  refresh: bool = False) -> str:
    """A10: snappy parquet; a timestamped folder, or ``latest`` semantics via
    a new folder + pointer when ``refresh``."""
    stamp = stamp or _dt.datetime.now(_dt.timezone.utc)
    path = os.path.join(out_dir, f"contracts_{stamp:%Y%m%d_%H%M%S}")
    df.write.option("compression", "snappy").mode("errorifexists").parquet(path)
    if refresh:
        _point_latest(df.sparkSession, out_dir, path)
    return path


def write_csv(df: DataFrame, out_dir: str, stamp: _dt.datetime | None = None) -> str:
    """CSV with header (UTF-8; the byte-order mark of the original is out
    of scope)."""
    stamp = stamp or _dt.datetime.now(_dt.timezone.utc)
    path = os.path.join(out_dir, f"contracts_{stamp:%Y%m%d_%H%M%S}_csv")
    df.write.option("header", True).mode("errorifexists").csv(path)
    return path


def write_kpis_json(kpis: DataFrame, path: str) -> str:
    """The one-row KPI frame as JSON."""
    kpis.coalesce(1).write.mode("overwrite").json(path)
    return path


def append_run_log(log: DataFrame, root: str, run_id: str) -> str:
    """Append the repair run log as JSON lines partitioned by run id."""
    log.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(root)
    return root


def _point_latest(spark: SparkSession, out_dir: str, target: str) -> None:
    spark.createDataFrame([(target,)], "target STRING").coalesce(1).write.mode("overwrite") \
        .text(os.path.join(out_dir, "_latest"))


def read_latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """BI consumer re-read of the latest snapshot."""
    target = spark.read.text(os.path.join(out_dir, "_latest")).first()[0]
    return spark.read.parquet(target)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First n rows (lazy limit, pushed into the plan)."""
    return df.limit(n)


def schema_validation(df: DataFrame, expected: list[str]) -> DataFrame:
    """Matching / missing / extra column counts and the match percentage
    (|matching| / |expected| * 100) as a one-row frame; column lists joined."""
    spark = df.sparkSession
    actual = set(df.columns)
    exp = list(dict.fromkeys(expected))
    rows = ([(c, "matching") for c in exp if c in actual] + [(c, "missing") for c in exp if c not in actual]
            + [(c, "extra") for c in df.columns if c not in set(exp)])
    names = spark.createDataFrame(rows, "column STRING, kind STRING")
    pct = F.round(F.count_if(F.col("kind") == "matching") / F.lit(max(len(exp), 1)) * 100, 2)
    return names.agg(
        F.count_if(F.col("kind") == "matching").alias("n_matching"),
        F.count_if(F.col("kind") == "missing").alias("n_missing"),
        F.count_if(F.col("kind") == "extra").alias("n_extra"),
        pct.alias("match_pct"))
