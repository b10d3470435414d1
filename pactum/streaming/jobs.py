"""Structured Streaming jobs.

* T1 ``auto_ingest``: file source -> the ingest projections -> ``foreachBatch``
  append guarded by a ``left_anti`` on contract_id, so a replayed micro-batch
  (after executor or driver loss) writes nothing twice.
* T2 ``high_risk_alerts``: row versions with risk >= 70, one alert per
  (contract, version) via ``dropDuplicatesWithinWatermark``; watermark ours.
* T3/T4: the daily expiration digest (K14) and weekly summary (K13) bodies run
  with ``trigger(availableNow=True)`` over the current fact snapshot.
* T5 ``intake_queue``: submissions -> Processed with a contract id.
* T6 ``session_history``: per-user last-10 history kept as bounded keyed state
  with ``applyInPandasWithState`` (batch twin: W1).
T2, T5 and T6 write each epoch to ``run=<run id>/epoch=<n>``.  The run id is kept in the
checkpoint, so a repeated epoch replaces itself and another checkpoint or source on the
same output never touches it; rows carry the time of their batch, which a repeat keeps.
Paths for collections, checkpoints and snapshots live under the shared folder
named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import ingest as IN
from ..session import scratch_path


def new_run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its Hadoop file system; other failures surface."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the run that ``checkpoint`` belongs to; made with the checkpoint, kept in it."""
    path = os.path.join(checkpoint, "run")
    if not path_exists(spark, os.path.join(path, "_SUCCESS")):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


def run_epochs(spark: SparkSession, rows: DataFrame, root: str, checkpoint: str, output_mode: str = "append") -> None:
    """Drive ``rows`` to its end: epoch N of a run goes to its own folder, with ``batch_time``."""
    run = run_id(spark, checkpoint)

    def write(df: DataFrame, epoch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(root, f"run={run}", f"epoch={epoch_id}"))

    # within a stream this is the time in the batch's offset log: the same when the batch is repeated
    q = (rows.withColumn("batch_time", F.current_timestamp()).writeStream.outputMode(output_mode).foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_epochs(spark: SparkSession, root: str, columns: str) -> DataFrame:
    """All epochs of all runs below ``root``; none yet, or none with rows, is an empty table."""
    schema = f"{columns}, batch_time timestamp, run string, epoch long"
    if not path_exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


# ------------------------------------------------------------------- T1
ID_PART_DIGITS = 2              # 256 folders of the collection
COLLECTION_COLUMNS = ("contract_id", "_pos", "file_name", "source_hash", "size", "text")


def auto_ingest(spark: SparkSession, source_dir: str, schema: str, collection_path: str,
                checkpoint: str, glob: str = "*.parquet", extensions=IN.SUPPORTED_EXTENSIONS) -> None:
    """Ingest every newly arrived document file once (availableNow run)."""
    stream = (spark.readStream.format("parquet").schema(schema)
              .option("pathGlobFilter", glob).load(source_dir))
    batch = IN.document_batch(stream)

    def upsert(df: DataFrame, epoch_id: int) -> None:
        ok = IN.dedupe(df.where(F.col("junk_reason").isNull()).select(*COLLECTION_COLUMNS))
        s = df.sparkSession
        ok = ok.withColumn("id_part", F.concat(F.lit("p"), F.substring(F.sha1("contract_id"), 1, ID_PART_DIGITS)))
        if path_exists(s, collection_path):
            # stored ids are laid out by id part, so a batch reads only the parts it has ids in
            # (the schema is given: after batches without a good row the folder holds no file)
            stored = s.read.schema("contract_id string, id_part string").parquet(collection_path)
            ok = ok.join(stored, ["contract_id", "id_part"], "left_anti")
        ok.write.mode("append").partitionBy("id_part").parquet(collection_path)

    q = (batch.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------- T2
def high_risk_alerts(versions: DataFrame, threshold: int = 70, watermark: str = "1 day",
                     ts_col: str = "updated_at") -> DataFrame:
    """Alerts for created/modified rows at or above the threshold; a
    version re-delivered within the watermark alerts once."""
    return (versions.where(F.col("risk_score") >= threshold)
            .withWatermark(ts_col, watermark)
            .dropDuplicatesWithinWatermark(["contract_id", "version"]))


def run_alerts(spark: SparkSession, versions: DataFrame, out_path: str, checkpoint: str, threshold: int = 70) -> DataFrame:
    """Drive T2 over a stream of row versions; all alerts so far.  A version that another
    run has seen too alerts once, at its first batch."""
    alerts = high_risk_alerts(versions, threshold)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alerts.schema)
    run_epochs(spark, alerts, out_path, checkpoint)
    rows = read_epochs(spark, out_path, columns)
    first = rows.groupBy("contract_id", "version").agg(
        F.min_by(F.struct(*alerts.columns), F.struct("batch_time", "run", "epoch")).alias("r"))
    return first.select("r.*")


# ------------------------------------------------------------------- T5
QUEUE_COLUMNS = "submission_id long, file_name string, status string, contract_id string"


def intake_queue(spark: SparkSession, submissions: DataFrame, queue_root: str, checkpoint: str) -> None:
    """T5: mark submissions Processed with their contract id; any number of checkpoints and
    sources may feed one queue."""
    name = F.col("file_name")
    done = submissions.select(F.col("submission_id").cast("long").alias("submission_id"), "file_name", F.lit("Processed").alias("status"),
                              IN.contract_id(name, IN.source_hash(name, F.col("text"))).alias("contract_id"))
    run_epochs(spark, done, queue_root, checkpoint)


def latest_queue(spark: SparkSession, queue_root: str) -> DataFrame | None:
    """The queue as it stands: of each submission the row of its newest batch."""
    if not path_exists(spark, queue_root):
        return None
    rows = read_epochs(spark, queue_root, QUEUE_COLUMNS)
    cols = [c for c in rows.columns if c not in ("batch_time", "run", "epoch")]
    newest = rows.groupBy("submission_id").agg(F.max_by(F.struct(*cols), F.struct("batch_time", "epoch", "run")).alias("r"))
    return newest.select("r.*")


# ------------------------------------------------------------------- T6
HISTORY = 10
HISTORY_SCHEMA = "user_id LONG, event_id LONG, ts TIMESTAMP, event_type STRING, rank INT"
STATE_SCHEMA = "history STRING"


def _history(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    items = json.loads(state.get[0]) if state.exists else []
    for pdf in pdfs:
        for r in pdf.itertuples(index=False):
            items.append([int(r.event_id), pd.Timestamp(r.ts).value, r.event_type])
        # keep only the newest HISTORY entries: the state never grows past it
        items.sort(key=lambda x: (x[1], x[0]), reverse=True)
        items = items[:HISTORY]
    state.update((json.dumps(items),))
    yield pd.DataFrame({
        "user_id": [key[0]] * len(items),
        "event_id": [i[0] for i in items],
        "ts": [pd.Timestamp(i[1]) for i in items],
        "event_type": [i[2] for i in items],
        "rank": list(range(1, len(items) + 1)),
    })


def _partial_last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: per Arrow batch keep only each user's newest
    HISTORY events, so a hot user sends at most HISTORY rows per batch to the
    stateful task."""
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf.sort_values(["user_id", "ts", "event_id"], ascending=[True, False, False])
        yield pdf.groupby("user_id", sort=False).head(HISTORY)


def session_history(events: DataFrame) -> DataFrame:
    """Per-user last-10 history as keyed state (update mode)."""
    ev = events.select("user_id", "event_id", "ts", "event_type")
    ev = ev.mapInPandas(_partial_last, ev.schema)
    return (ev.groupBy("user_id")
            .applyInPandasWithState(_history, HISTORY_SCHEMA, STATE_SCHEMA, "update",
                                    GroupStateTimeout.NoTimeout))


def run_session_history(spark: SparkSession, source_dir: str, schema: str, out_path: str, checkpoint: str,
                        glob: str = "*.parquet") -> DataFrame:
    """Drive T6 over a file source.  A run's latest emission for a user is its history there;
    the newest entries of all runs that feed ``out_path`` are the user's history."""
    stream = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", glob).load(source_dir)
    run_epochs(spark, session_history(stream), out_path, checkpoint, "update")
    out = read_epochs(spark, out_path, HISTORY_SCHEMA)
    last = out.groupBy("run", "user_id").agg(F.max("epoch").alias("epoch"))
    entries = out.join(last, ["run", "user_id", "epoch"]).dropDuplicates(["user_id", "event_id"])
    # at most HISTORY rows for each user and run
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return (entries.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= HISTORY)
            .select("user_id", "event_id", "ts", "event_type", "rank"))
