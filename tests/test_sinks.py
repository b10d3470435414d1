"""Sinks, preview and schema validation."""
import datetime as dt
import os

from pactum.plans import sinks as SK
from pactum.plans.catalog import COLLECTION_SCHEMA, QUERIES
from pactum.streaming.jobs import new_run_dir

from conftest import SMALL


def test_schema_validation_against_documented_collection(spark):
    r = QUERIES["a13_schema_validation"](spark, SMALL).first()
    assert (r.n_matching, r.n_missing, r.n_extra) == (18, len(COLLECTION_SCHEMA) - 18, 0)
    assert r.match_pct == round(18 / len(COLLECTION_SCHEMA) * 100, 2)


def test_parquet_csv_json_and_latest_pointer(spark):
    out = new_run_dir(spark, "sinks")
    fact = QUERIES["b10_fact_table"](spark, SMALL)
    p1 = SK.write_parquet(fact, out, dt.datetime(2000, 1, 1), refresh=True)
    assert SK.read_latest(spark, out).count() == fact.count()
    p2 = SK.write_csv(SK.preview(fact, 7), out, dt.datetime(2000, 1, 1))
    assert spark.read.option("header", True).csv(p2).count() == 7
    k = QUERIES["k1_portfolio_kpis"](spark, SMALL)
    SK.write_kpis_json(k, os.path.join(out, "kpis"))
    assert spark.read.json(os.path.join(out, "kpis")).count() == 1
    log = QUERIES["g12_repair_log"](spark, SMALL)
    SK.append_run_log(log, os.path.join(out, "runs"), "r1")
    SK.append_run_log(log, os.path.join(out, "runs"), "r2")
    runs = spark.read.json(os.path.join(out, "runs"))
    assert runs.select("run_id").distinct().count() == 2
    assert p1 != p2
