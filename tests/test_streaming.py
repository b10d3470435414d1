"""Streaming jobs on small inputs written to a scratch folder."""
import datetime as dt
import os

from pyspark.sql import functions as F

from pactum.streaming import jobs as T


def test_intake_queue_marks_processed(spark):
    run = T.new_run_dir(spark, "t5-test")
    src = os.path.join(run, "in")
    rows = [(1, "Acme NDA.pdf", "x" * 100), (2, "Beta SOW 3.pdf", "y" * 100)]
    spark.createDataFrame(rows, "submission_id INT, file_name STRING, text STRING").write.parquet(src)
    sub = spark.readStream.schema("submission_id INT, file_name STRING, text STRING").parquet(src)
    T.intake_queue(spark, sub, os.path.join(run, "queue"), os.path.join(run, "ckpt"))
    q = T.latest_queue(spark, os.path.join(run, "queue"))
    got = {r.submission_id: (r.status, r.contract_id.split("-")[0]) for r in q.collect()}
    assert got == {1: ("Processed", "acme"), 2: ("Processed", "beta")}


def _submissions(spark, run, rows):
    src = os.path.join(run, "in")
    schema = "submission_id INT, file_name STRING, text STRING"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).parquet(src)


def test_intake_queue_replays_an_epoch(spark):
    """A lost checkpoint delivers epoch 0 again: the queue stays as it was."""
    run = T.new_run_dir(spark, "t5-replay")
    queue = os.path.join(run, "queue")
    sub = _submissions(spark, run, [(1, "Acme NDA.pdf", "x" * 100), (2, "Beta SOW 3.pdf", "y" * 100)])
    T.intake_queue(spark, sub, queue, os.path.join(run, "c1"))
    first = sorted(map(tuple, T.latest_queue(spark, queue).collect()))
    T.intake_queue(spark, sub, queue, os.path.join(run, "c2"))
    assert sorted(map(tuple, T.latest_queue(spark, queue).collect())) == first and len(first) == 2


def test_alerts_replay_an_epoch(spark):
    run = T.new_run_dir(spark, "t2-replay")
    src = os.path.join(run, "in")
    schema = "contract_id STRING, risk_score INT, version INT, updated_at TIMESTAMP"
    spark.createDataFrame([("c1", 80, 1, dt.datetime(2000, 1, 1)), ("c2", 10, 1, dt.datetime(2000, 1, 1))],
                          schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    for k in (1, 2):
        got = T.run_alerts(spark, stream, os.path.join(run, "out"), os.path.join(run, f"c{k}"))
        assert [r.contract_id for r in got.collect()] == ["c1"]


def test_session_history_replays_an_epoch(spark):
    run = T.new_run_dir(spark, "t6-replay")
    src = os.path.join(run, "in")
    schema = "user_id LONG, event_id LONG, ts TIMESTAMP, event_type STRING"
    rows = [(u, 100 * u + i, dt.datetime(2000, 1, 1, 0, i), "view") for u in (1, 2) for i in range(12)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    n = [T.run_session_history(spark, src, schema, os.path.join(run, "out"), os.path.join(run, f"c{k}")).count()
         for k in (1, 2)]
    assert n == [20, 20]


def test_high_risk_alerts_dedupe_versions(spark):
    run = T.new_run_dir(spark, "t2-test")
    src = os.path.join(run, "in")
    t0 = dt.datetime(2000, 1, 1)
    rows = [("c1", 80, 1, t0), ("c1", 80, 1, t0), ("c1", 90, 2, t0), ("c2", 10, 1, t0)]
    schema = "contract_id STRING, risk_score INT, version INT, updated_at TIMESTAMP"
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = (T.high_risk_alerts(stream).writeStream.format("memory").queryName("alerts_t")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.contract_id, r.version) for r in spark.table("alerts_t").collect())
    assert got == [("c1", 1), ("c1", 2)]


def test_auto_ingest_twice_is_once(spark):
    run = T.new_run_dir(spark, "t1-test")
    src = os.path.join(run, "in")
    docs = [(i, "word " * 120 + str(i), "en", "src1", 0) for i in range(5)]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    spark.createDataFrame(docs, schema).write.parquet(src)
    coll = os.path.join(run, "coll")
    T.auto_ingest(spark, src, schema, coll, os.path.join(run, "ck1"))
    n1 = spark.read.parquet(coll).count()
    T.auto_ingest(spark, src, schema, coll, os.path.join(run, "ck2"))  # replay from scratch
    assert spark.read.parquet(coll).count() == n1 == 5


def test_auto_ingest_after_a_batch_without_good_rows(spark):
    run = T.new_run_dir(spark, "t1-junk")
    src, coll = os.path.join(run, "in"), os.path.join(run, "coll")
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    spark.createDataFrame([(1, "x", "en", "src1", 1), (2, None, "en", "src1", 0)], schema).write.parquet(src)
    T.auto_ingest(spark, src, schema, coll, os.path.join(run, "ck"))
    for k in range(2):                                   # the next run reads a folder without files
        good = [(10 + k, "word " * 120 + str(k), "en", "src1", 0)]
        spark.createDataFrame(good, schema).write.mode("append").parquet(src)
        T.auto_ingest(spark, src, schema, coll, os.path.join(run, "ck"))
        assert spark.read.parquet(coll).count() == k + 1


def test_queue_fed_by_two_sources(spark):
    """Epoch 0 of a second checkpoint replaces nothing of the first; the newest batch wins."""
    run = T.new_run_dir(spark, "t5-two")
    queue = os.path.join(run, "queue")
    for k, rows in enumerate([[(1, "Acme NDA.pdf", "x" * 100)], [(2, "Beta SOW 3.pdf", "y" * 100), (1, "Acme NDA 2.pdf", "z" * 100)]]):
        sub = _submissions(spark, os.path.join(run, str(k)), rows)
        T.intake_queue(spark, sub, queue, os.path.join(run, f"c{k}"))
    got = {r.submission_id: r.file_name for r in T.latest_queue(spark, queue).collect()}
    assert got == {1: "Acme NDA 2.pdf", 2: "Beta SOW 3.pdf"}


def test_alerts_and_history_of_two_sources(spark):
    run = T.new_run_dir(spark, "t26-two")
    a, b = "contract_id STRING, risk_score INT, version INT, updated_at TIMESTAMP", \
        "user_id LONG, event_id LONG, ts TIMESTAMP, event_type STRING"
    for k in (0, 1):
        src = os.path.join(run, f"a{k}")
        spark.createDataFrame([(f"c{k}", 80, 1, dt.datetime(2000, 1, 1)), ("both", 90, 1, dt.datetime(2000, 1, 1))], a).write.parquet(src)
        alerts = T.run_alerts(spark, spark.readStream.schema(a).parquet(src), os.path.join(run, "out"), os.path.join(run, f"ca{k}"))
        src = os.path.join(run, f"b{k}")
        spark.createDataFrame([(1, 100 * k + i, dt.datetime(2000, 1, 1 + k, 0, i), "view") for i in range(6)], b).write.parquet(src)
        history = T.run_session_history(spark, src, b, os.path.join(run, "hist"), os.path.join(run, f"cb{k}"))
    assert sorted(r.contract_id for r in alerts.collect()) == ["both", "c0", "c1"]
    assert [r.event_id for r in history.orderBy("rank").collect()] == [105, 104, 103, 102, 101, 100, 5, 4, 3, 2]


def test_streams_read_tables_of_one_file_and_of_many(spark):
    """A table may be one file or a folder of files; the streams see the same rows."""
    from pactum.plans.catalog import QUERIES
    run = T.new_run_dir(spark, "tables-test")
    docs = spark.createDataFrame([(i, f"Text number {i} of the table, long enough to be kept. " * 60, "en", "web", 200) for i in range(12)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    events = spark.createDataFrame([(i, i % 3, dt.datetime(2000, 1, 1, 0, i), "view") for i in range(12)],
                                   "event_id long, user_id long, ts timestamp, event_type string")
    found = []
    for kind in ("folder", "file"):
        sf = os.path.join(run, kind)
        os.makedirs(sf)
        for name, rows in (("documents", docs), ("events", events)):
            if kind == "folder":
                rows.repartition(3).write.parquet(os.path.join(sf, f"{name}.parquet"))
            else:
                rows.toPandas().to_parquet(os.path.join(sf, f"{name}.parquet"), coerce_timestamps="us")
        found.append([sorted(map(tuple, QUERIES[q](spark, sf).collect()))
                      for q in ("t1_auto_ingest_stream", "t5_intake_queue", "t6_session_history_stream")])
    assert found[0] == found[1] and [len(rows) for rows in found[0]] == [12, 12, 12]
