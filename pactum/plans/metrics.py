"""Portfolio measures and chart datasets over the BI fact table.

All measures are single aggregations (partial aggregate per task, one small
final merge); none collects rows.  Rankings use ``orderBy().limit()``, which
Spark plans as a per-partition top-k plus a bounded merge
(TakeOrderedAndProject), never a one-partition window.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig


def portfolio_kpis(fact: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """K1: one row of portfolio KPIs."""
    return fact.agg(
        F.count(F.lit(1)).alias("total_contracts"),
        F.count_if(F.col("status") == "Active").alias("active_contracts"),
        F.count_if(F.col("terminated")).alias("terminated_contracts"),
        F.count_if(F.col("is_expiring_soon")).alias("expiring_soon"),
        F.count_if(F.col("is_expired")).alias("expired_contracts"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.count_if(F.col("risk_score") >= cfg.high_risk).alias("high_risk_contracts"),
        F.count_if(F.col("gdpr_applicable")).alias("gdpr_contracts"),
        F.count_distinct("company_folder").alias("unique_companies"),
    )


def counts_by(fact: DataFrame, column: str) -> DataFrame:
    """K2: contracts per value of ``column`` (type, region, ...)."""
    return fact.groupBy(column).agg(F.count(F.lit(1)).alias("n_contracts"))


def dax_measures(fact: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """K3: the five dashboard measures.  Critical alerts = expired + (days <= 30
    and not expired); NULL expiry was filled with 0 days upstream, so such rows
    count as critical (Q30).  ``critical_alerts_strict`` is the corrected form
    (expiry known)."""
    not_expired = ~F.col("is_expired")
    crit = (F.col("days_until_expiration") <= cfg.critical_days) & not_expired
    known = F.col("expiration_date").isNotNull()
    return fact.agg(
        F.count(F.lit(1)).alias("total_contracts"),
        F.count_if((F.col("status") == "Active") & not_expired).alias("active_contracts"),
        F.count_if(F.col("is_expiring_soon")).alias("expiring_soon"),
        F.avg("risk_score").alias("avg_risk_score"),
        (F.count_if(F.col("is_expired")) + F.count_if(crit)).alias("critical_alerts"),
        (F.count_if(F.col("is_expired")) + F.count_if(crit & known)).alias("critical_alerts_strict"),
    )


def top_companies(fact: DataFrame, n: int = 10) -> DataFrame:
    """K4: top-n companies by contract count (ties by name)."""
    return (fact.groupBy("company_folder").agg(F.count(F.lit(1)).alias("n_contracts"))
            .orderBy(F.desc("n_contracts"), F.asc("company_folder")).limit(n))


def expirations_by_month(fact: DataFrame) -> DataFrame:
    """K5: expirations per month x status (rows without an expiry dropped)."""
    month = F.date_format(F.col("expiration_date"), "yyyy-MM")
    return (fact.where(F.col("expiration_date").isNotNull())
            .groupBy(month.alias("expiration_month"), "status")
            .agg(F.count(F.lit(1)).alias("n_contracts")))


def status_distribution(fact: DataFrame) -> DataFrame:
    """K6: count per status and share of the total.

    The total is a scalar subquery over the same scan, not a window over all
    rows."""
    total = fact.select(F.count(F.lit(1))).scalar()
    return (fact.groupBy("status").agg(F.count(F.lit(1)).alias("n_contracts"))
            .select("status", "n_contracts",
                    (F.col("n_contracts") / total).alias("share")))


def first_companies(fact: DataFrame, n: int = 20) -> DataFrame:
    """The first n distinct companies alphabetically (bounded, broadcast-safe)."""
    return (fact.select("company_folder").distinct()
            .orderBy("company_folder").limit(n))


def risk_matrix(fact: DataFrame, n_companies: int = 20) -> DataFrame:
    """K7 as the chart wants it: mean risk per company (rows, the first 20
    alphabetically) x contract type (columns), 0 where a pair has no contract.

    The company list is bounded by ``n_companies`` and broadcast; the pivot
    values are the distinct types among those companies' rows.
    """
    firsts = first_companies(fact, n_companies)
    rows = fact.join(F.broadcast(firsts), "company_folder", "left_semi")
    rows = rows.withColumn("contract_type", F.coalesce("contract_type", F.lit("Unknown")))
    return (rows.groupBy("company_folder").pivot("contract_type").agg(F.avg("risk_score"))
            .na.fill(0.0).orderBy("company_folder"))


def risk_matrix_long(fact: DataFrame, n_companies: int = 20) -> DataFrame:
    """K7 in long form (company, type, avg_risk): the unpivoted matrix."""
    wide = risk_matrix(fact, n_companies)
    types = [c for c in wide.columns if c != "company_folder"]
    return wide.unpivot(["company_folder"], types, "contract_type", "avg_risk")


def gdpr_distribution(fact: DataFrame) -> DataFrame:
    """K8: count by region x GDPR flag, with the chart label."""
    return (fact.groupBy("region", "gdpr_applicable").agg(F.count(F.lit(1)).alias("n_contracts"))
            .withColumn("label", F.concat_ws("\n", F.col("region"),
                                             F.when(F.col("gdpr_applicable"), F.lit("GDPR"))
                                             .otherwise(F.lit("Non-GDPR")),
                                             F.concat(F.col("n_contracts").cast("string"),
                                                      F.lit(" contracts")))))


# Funnel stage order.
FUNNEL_STAGES = ("Draft", "Active", "Expiring Soon", "Expired", "Terminated")


def lifecycle_funnel(fact: DataFrame) -> DataFrame:
    """K9: ordered funnel stages.  A stage present as a status takes its count;
    'Expiring Soon' (never a status) takes the flag sum when > 0; when no stage
    is present at all, the raw status counts are returned.
    ``width`` = count / max(count) over the stage rows.

    The fact table is aggregated once by status; everything else works on the one row
    that holds the counts (as many as there are statuses)."""
    per = fact.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_expiring_soon").alias("soon"))
    one = per.agg(F.collect_list(F.struct("status", "n")).alias("all"), F.sum("soon").alias("soon"))
    row = "array<struct<stage_order:int,stage:string,n_contracts:bigint>>"

    def count_of(name: str) -> Column:
        n = F.element_at(F.transform(F.filter("all", lambda x: x["status"] == name), lambda x: x["n"]), 1)
        n = F.when(F.exists("all", lambda x: x["status"] == name), n)
        return F.coalesce(n, F.when(F.col("soon") > 0, F.col("soon"))) if name == "Expiring Soon" else n

    staged = F.array_compact(F.array(*(
        F.when(count_of(s).isNotNull(), F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage"),
                                                 count_of(s).alias("n_contracts")))
        for i, s in enumerate(FUNNEL_STAGES)))).cast(row)
    raw = F.transform("all", lambda x: F.struct(F.lit(None).cast("int").alias("stage_order"), x["status"].alias("stage"),
                                                x["n"].alias("n_contracts"))).cast(row)
    rows = one.select(F.when(F.size(staged) > 0, staged).otherwise(raw).alias("rows"))
    return rows.select(F.explode("rows").alias("r"), F.array_max(F.transform("rows", lambda x: x["n_contracts"])).alias("mx")) \
        .select("r.*", (F.col("r.n_contracts") / F.col("mx")).alias("width"))


def expiration_calendar(fact: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """2 x 12 grid of expiration counts for the 24 months starting at the
    as-of month, keeping only year offsets 0 and 1 (Q31), 0-filled."""
    spark = fact.sparkSession
    start = _dt.date(as_of.year, as_of.month, 1)
    month = F.trunc(F.col("expiration_date"), "month")
    monthly = (fact.where(F.col("expiration_date").isNotNull())
               .where((month >= F.lit(start)) & (month < F.add_months(F.lit(start), 24)))
               .groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n_contracts"))
               .where(F.year("m") - as_of.year < 2))
    cells = spark.range(0, 24).select(
        (F.col("id") / 12).cast("int").alias("year_offset"),
        (F.col("id") % 12 + 1).cast("int").alias("month"))
    keyed = monthly.select((F.year("m") - as_of.year).alias("year_offset"),
                           F.month("m").alias("month"), "n_contracts")
    return (cells.join(keyed, ["year_offset", "month"], "left")
            .select("year_offset", "month",
                    F.coalesce("n_contracts", F.lit(0)).alias("n_contracts")))


def expiration_timeline(fact: DataFrame, n: int = 30, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Contracts with both dates, duration in days, the n soonest
    expirations (ties by contract_id), emphasis when risk > 70."""
    return (fact.where(F.col("effective_date").isNotNull() & F.col("expiration_date").isNotNull())
            .select("contract_id", "document_name", "status", "effective_date", "expiration_date",
                    F.datediff("expiration_date", "effective_date").alias("duration_days"),
                    (F.col("risk_score") > cfg.high_risk).alias("emphasis"))
            .orderBy("expiration_date", "contract_id").limit(n))


def party_network(fact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes).  Edges are distinct unordered pairs (primary,
    counterparty) without Unknown/empty counterparties; node degree is the
    number of distinct neighbours (Q32), ``n_contracts`` the contract count."""
    ok = fact.where(~F.col("party_counterparty").isin("Unknown", "") &
                    F.col("party_counterparty").isNotNull())
    a, b = F.col("party_primary"), F.col("party_counterparty")
    pairs = ok.select(F.least(a, b).alias("node_a"), F.greatest(a, b).alias("node_b"))
    edges = pairs.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("n_contracts"))
    ends = edges.select(F.col("node_a").alias("node"), F.col("node_b").alias("other"), "n_contracts") \
        .unionByName(edges.select(F.col("node_b").alias("node"), F.col("node_a").alias("other"),
                                  "n_contracts"))
    nodes = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"),
                                     F.sum("n_contracts").alias("n_contracts"))
    return edges, nodes


def weekly_summary(fact: DataFrame, n_top: int = 5, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The weekly payload as (section, key, value) rows: KPIs, counts by
    type and the n soonest expiring contracts (company, days)."""
    k = portfolio_kpis(fact, cfg)
    kpis = k.select(F.explode(F.create_map(
        F.lit("total_contracts"), F.col("total_contracts"),
        F.lit("active_contracts"), F.col("active_contracts"),
        F.lit("expiring_soon"), F.col("expiring_soon"),
        F.lit("high_risk_contracts"), F.col("high_risk_contracts"),
        F.lit("unique_companies"), F.col("unique_companies"))).alias("key", "value")) \
        .select(F.lit("kpi").alias("section"), F.lit(0).alias("rank"), "key", "value")
    by_type = counts_by(fact, "contract_type").select(
        F.lit("by_type").alias("section"), F.lit(0).alias("rank"),
        F.coalesce("contract_type", F.lit("Unknown")).alias("key"),
        F.col("n_contracts").alias("value"))
    top = (fact.where(F.col("is_expiring_soon"))
           .select("company_folder", "days_until_expiration", "contract_id")
           .orderBy("days_until_expiration", "contract_id").limit(n_top))
    top = top.select(F.lit("top_expiring").alias("section"), F.lit(0).alias("rank"),
                     F.col("company_folder").alias("key"),
                     F.col("days_until_expiration").cast("bigint").alias("value"),
                     "contract_id")
    return kpis.unionByName(by_type).unionByName(top.drop("contract_id"))


def owner_digest(fact: DataFrame, threshold: int = 90) -> DataFrame:
    """Contracts expiring within ``threshold`` days, one row per contract,
    ordered by (owner, days).  The per-owner e-mail is a group of these rows;
    we keep them flat (a global range sort), so a hot owner never lands in one
    task."""
    owner = F.when(F.col("sharepoint_owner") == "", F.lit("Unassigned")).otherwise(
        F.col("sharepoint_owner"))
    return (fact.where(F.col("is_expiring_soon") & (F.col("days_until_expiration") <= threshold))
            .select(owner.alias("owner"), "contract_id", "document_name",
                    F.col("company_folder").alias("company"), "expiration_date",
                    F.col("days_until_expiration").alias("days_until_expiration"),
                    "risk_score")
            .orderBy("owner", "days_until_expiration", "contract_id"))


def slice_fact(fact: DataFrame, regions=None, types=None, statuses=None, companies=None,
               expires_from=None, expires_to=None) -> DataFrame:
    """Report slicers as a filter in front of any measure (pushed to the
    scan where the columns come straight from storage)."""
    cond = F.lit(True)
    if regions:
        cond &= F.col("region").isin(*regions)
    if types:
        cond &= F.col("contract_type").isin(*types)
    if statuses:
        cond &= F.col("status").isin(*statuses)
    if companies:
        cond &= F.col("company_folder").isin(*companies)
    if expires_from is not None:
        cond &= F.col("expiration_date") >= F.lit(expires_from)
    if expires_to is not None:
        cond &= F.col("expiration_date") <= F.lit(expires_to)
    return fact.where(cond)


def high_risk_list(fact: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Risk >= 70, sorted by risk desc (ties by id)."""
    return (fact.where(F.col("risk_score") >= cfg.high_risk)
            .orderBy(F.desc("risk_score"), "contract_id"))


def display_bands(fact: DataFrame) -> DataFrame:
    """Colour bands of the dashboard: days < 30 red / 30-60 yellow / > 60
    green; row risk > 70 flagged."""
    d = F.col("days_until_expiration")
    return fact.select(
        "contract_id", d.alias("days_until_expiration"), "risk_score",
        F.when(d < 30, "red").when(d <= 60, "yellow").otherwise("green").alias("days_band"),
        (F.col("risk_score") > 70).alias("risk_flag"))


def avg_risk_band(avg_risk) -> str:
    """E42 for the KPI card (a scalar over one aggregated row)."""
    if avg_risk is None:
        return "neutral"
    return "red" if avg_risk > 70 else ("green" if avg_risk < 40 else "neutral")
