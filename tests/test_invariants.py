"""Invariants of FIXTURES.md §4 on the small scale."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from pactum.config import FIXTURE_AS_OF, FIXTURE_CONFIG
from pactum.functions.sequence import dense_index, rank_within_groups
from pactum.operators import registry as R
from pactum.plans.catalog import QUERIES
from pactum.sources.contracts import contracts

from conftest import SMALL


def test_dense_index_matches_single_partition_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("pos"))
    ref = df.withColumn("seq", F.row_number().over(Window.orderBy("k", "pos")).cast("bigint"))
    for parts in (1, 16):
        got = dense_index(df, ["k", "pos"], n_parts=parts)
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_rank_within_groups_matches_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 7).alias("g"), (F.col("id") * 31 % 997).alias("k"),
                                     F.col("id").alias("pos"))
    ref = df.withColumn("rank_in_group", F.row_number().over(
        Window.partitionBy("g").orderBy("k", "pos")).cast("bigint"))
    got = rank_within_groups(df, ["g"], ["k", "pos"])
    assert got.select(*ref.columns).exceptAll(ref).count() == 0


def test_parent_ids_unique_and_dense(spark):
    reg = R.registry(contracts(spark, SMALL), FIXTURE_AS_OF, FIXTURE_CONFIG)
    seqs = reg.where(F.col("seq").isNotNull())
    n = seqs.count()
    agg = seqs.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first()
    assert (agg[0], agg[1], agg[2]) == (1, n, n)
    parents = reg.where(F.col("hierarchy").isin(*R.PARENT_CLASSES))
    assert parents.select("norm_id").distinct().count() == parents.count()


def test_totals_agree_across_breakdowns(spark):
    total = QUERIES["k1_portfolio_kpis"](spark, SMALL).first()["total_contracts"]
    by_type = QUERIES["k2_counts_by_type"](spark, SMALL).agg(F.sum("n_contracts")).first()[0]
    by_region = QUERIES["k2_counts_by_region"](spark, SMALL).agg(F.sum("n_contracts")).first()[0]
    assert total == by_type == by_region


def test_gap_sets_are_disjoint(spark):
    from pactum.operators import gaps as G
    e = G.gap_entries(contracts(spark, SMALL))
    bad = e.where((F.size(F.array_intersect("missing_fields", F.map_keys("inherited"))) > 0)
                  | (F.size(F.array_intersect("missing_fields", "suppressed_fields")) > 0))
    assert bad.count() == 0


def test_patch_apply_is_idempotent(spark):
    from pactum.operators import gaps as G
    from pactum.plans.catalog import responses_from_text
    ct = contracts(spark, SMALL)
    e = G.gap_entries(ct)
    log = G.run_repair(e, responses_from_text(e))
    once = G.apply_patches(ct, log)
    twice = G.apply_patches(once, log)
    assert once.exceptAll(twice).count() == 0
