"""Dense global numbering without a single-partition window (W3, §7.4).

``dense_index(df, order_cols)`` adds ``seq`` = 1..N in the total order given by
``order_cols`` (which must be unique per row).  Plan:

1. ``repartitionByRange`` on the order columns: Spark samples the keys and
   splits them into balanced ranges, so a hot value cannot pile into one task;
2. the range-partitioned frame (only the key columns) is checkpointed into the
   shared checkpoint folder, which freezes partition ids and survives executor
   loss;
3. per-partition row counts (one row per partition) give offsets by a prefix
   sum over that tiny table, joined back broadcast;
4. ``row_number`` within each partition (a window partitioned by the partition
   id: one balanced range per task) plus the offset is the dense index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize


def dense_index(df: DataFrame, order_cols: list[str], n_parts: int | None = None,
                seq_col: str = "seq") -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if n_parts is None:
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = [F.col(c).asc_nulls_first() for c in order_cols]
    ranged = materialize(df.repartitionByRange(n_parts, *ordered)
                         .withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # prefix sum over (at most n_parts) rows
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = offsets.select("_part", F.coalesce("_off", F.lit(0)).alias("_off"))
    w = Window.partitionBy("_part").orderBy(*ordered)
    return (ranged.join(F.broadcast(offsets), "_part")
            .withColumn(seq_col, (F.row_number().over(w) + F.col("_off")).cast("bigint"))
            .drop("_part", "_off"))


def rank_within_groups(df: DataFrame, group_cols: list[str], order_cols: list[str],
                       seq_col: str = "rank_in_group") -> DataFrame:
    """1-based position of each row inside its group, in ``order_cols`` order.

    Uses one global dense index over (group, order) and subtracts the group's
    first index (a partial aggregation), so a group holding a third of all rows
    is still spread over many tasks."""
    idx = dense_index(df, group_cols + order_cols, seq_col="_gseq")
    starts = idx.groupBy(*group_cols).agg(F.min("_gseq").alias("_gstart"))
    out = idx.join(starts, group_cols, "inner")  # group keys are non-NULL
    return out.withColumn(seq_col, (F.col("_gseq") - F.col("_gstart") + 1).cast("bigint")) \
        .drop("_gseq", "_gstart")
