"""BI fact table (B8, B10, E20, E22) — 35 typed columns, one narrow stage.

Input: a contracts frame (any subset of the collection columns; absent columns
are absent metadata keys).  Output columns and types follow the BI schema:
STRING / BOOLEAN / TIMESTAMP / INT / DOUBLE.  No shuffle: the whole table is a
single projection over the scan, so it scales with the number of input files.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.dates import as_of_lit, floor_days, parse_date_bi
from ..functions.missing import MISSING_BI, col_or_null, gdpr_flag, pick

FACT_COLUMNS = (
    "contract_id", "document_name", "file_path", "company_folder", "party_primary",
    "party_counterparty", "all_parties", "contract_type", "document_role", "status",
    "terminated", "effective_date", "expiration_date", "termination_date",
    "ingestion_date", "days_until_expiration", "is_expired", "is_expiring_soon",
    "termination_for_convenience", "auto_renewal", "governing_law", "payment_terms",
    "region", "gdpr_applicable", "gdpr_reason", "parent_folder", "grandparent_folder",
    "sequence_label", "relationship_hints", "sharepoint_owner", "sharepoint_department",
    "contract_value_usd", "risk_score", "text_length", "page_count",
)


def expiry_metrics(expiration: Column, as_of) -> tuple[Column, Column, Column]:
    """(days_until, is_expired, is_expiring_soon) from a parsed TIMESTAMP.

    days floor like a timedelta (Q21); NULL expiry is neither expired nor soon;
    day 90 counts as soon (Q33).
    """
    days = floor_days(expiration, as_of_lit(as_of))
    expired = F.coalesce(days < 0, F.lit(False))
    soon = F.coalesce((days >= 0) & (days <= 90), F.lit(False))
    return days, expired, soon


def risk_score_bi(days: Column, effective: Column, counterparty: Column,
                  law: Column, gdpr: Column, tfc: Column) -> Column:
    """0-100 risk score of the BI export.

    expiry band 40 (<0) / 30 (<30) / 20 (<90) / 10 (<180); +10 per missing
    effective date, counterparty, governing law; +15 GDPR; +15 when
    termination for convenience is 'No'.  Capped at 100.
    """
    unknown = ("", "Unknown")
    expiry = (F.when(days.isNull(), 0).when(days < 0, 40).when(days < 30, 30)
              .when(days < 90, 20).when(days < 180, 10).otherwise(0))
    score = (expiry
             + F.when(effective.isNull(), 10).otherwise(0)
             + F.when(counterparty.isNull() | counterparty.isin(*unknown), 10).otherwise(0)
             + F.when(law.isNull() | law.isin(*unknown), 10).otherwise(0)
             + F.when(gdpr, 15).otherwise(0)
             + F.when(tfc == "No", 15).otherwise(0))
    return F.least(score, F.lit(100)).cast("int")


def fact_table(contracts: DataFrame, as_of: _dt.datetime,
               cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The BI fact table with the B8 type enforcement applied."""
    g = lambda name, dtype="string": col_or_null(contracts, name, dtype)
    eff = parse_date_bi(g("effective_date"))
    exp = parse_date_bi(g("expiration_date"))
    term = parse_date_bi(g("termination_date"))
    # Q1 fixed: the ingest writes upload_date, the export looked for another key
    ingestion = F.coalesce(parse_date_bi(g("ingestion_timestamp")), parse_date_bi(g("upload_date")))
    days, expired, soon = expiry_metrics(exp, as_of)
    counterparty = pick(g("party_counterparty"), g("parent_folder_name"), default="Unknown")
    law = pick(g("governing_law"), default="Unknown")
    tfc = pick(g("termination_for_convenience"), default="Unknown")
    gdpr = gdpr_flag(g("gdpr_applicable"))
    text = g("text")
    char_count = g("char_count", "int")
    text_length = F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(
        F.coalesce(char_count, F.length(text))).cast("int")
    terminated = (F.coalesce(g("is_terminated", "boolean"), F.lit(False))
                  | F.coalesce(g("terminated") == "Yes", F.lit(False)))
    return contracts.select(
        F.col("contract_id"),
        pick(g("filename"), g("document_name"), default="Unknown").alias("document_name"),
        pick(g("file_path"), default="").alias("file_path"),
        pick(g("parent_folder_name"), g("company_folder"), default="Unknown").alias("company_folder"),
        pick(g("party_primary"), default=cfg.primary_company_display).alias("party_primary"),
        counterparty.alias("party_counterparty"),
        pick(g("parties"), g("all_parties"), default="").alias("all_parties"),
        pick(g("contract_type"), default="Unknown").alias("contract_type"),
        pick(g("document_role"), default="Unknown").alias("document_role"),
        pick(g("contract_status"), g("status"), default="Active").alias("status"),
        terminated.alias("terminated"),
        eff.alias("effective_date"),
        exp.alias("expiration_date"),
        term.alias("termination_date"),
        ingestion.alias("ingestion_date"),
        F.coalesce(days, F.lit(0)).cast("int").alias("days_until_expiration"),
        expired.alias("is_expired"),
        soon.alias("is_expiring_soon"),
        tfc.alias("termination_for_convenience"),
        pick(g("auto_renewal"), default="Unknown").alias("auto_renewal"),
        law.alias("governing_law"),
        pick(g("payment_terms"), default="").alias("payment_terms"),
        pick(g("region"), default="Unknown").alias("region"),
        gdpr.alias("gdpr_applicable"),
        pick(g("gdpr_reason"), default="").alias("gdpr_reason"),
        pick(g("parent_folder_name"), g("parent_folder"), default="").alias("parent_folder"),
        pick(g("grandparent_folder_name"), g("grandparent_folder"), default="").alias("grandparent_folder"),
        pick(g("sequence_label"), default="").alias("sequence_label"),
        pick(g("related_contract_hint"), g("relationship_hints"), default="").alias("relationship_hints"),
        pick(g("sharepoint_owner_primary"), g("sharepoint_owner"), default="").alias("sharepoint_owner"),
        pick(g("sharepoint_department"), default="Legal").alias("sharepoint_department"),
        F.lit(0.0).alias("contract_value_usd"),
        risk_score_bi(days, eff, counterparty, law, gdpr, tfc).alias("risk_score"),
        text_length.alias("text_length"),
        F.coalesce(g("page_count", "int"), F.lit(0)).cast("int").alias("page_count"),
    )


__all__ = ["FACT_COLUMNS", "expiry_metrics", "fact_table", "risk_score_bi", "MISSING_BI"]
