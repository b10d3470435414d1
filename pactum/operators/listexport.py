"""The strict list export (B9, B11): a declared schema of names, order, types and fills.

``Field`` rows say for each output column where it comes from and what it is filled with;
``enforce`` turns any table into exactly these columns by one projection: a column that the
table lacks is filled, one that the list lacks is dropped, the order is the list's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import TYPE_FULL_NAMES

MISSING_PARENT = "[MISSING - Requires Review]"
CONTENT_TYPE = "Contract Processing"
SUMMARY_CHARS = 500            # the list's own limit of its summary field


@dataclass(frozen=True)
class Field:
    """An output column: its type and what stands where the source has nothing."""
    name: str
    type: str = "string"
    fill: str | None = ""


def _fields(names: str, type_: str = "string", fill: str | None = "") -> list[Field]:
    return [Field(n.strip(), type_, fill) for n in names.split(",")]


# The 46 columns of the list, in its order.
STRICT_SCHEMA = tuple(
    _fields("Name, Content Type, ContractId, ContractTitle, ContractDuration, Party1 Name, Party1 Address, Party2 Name, "
            "Party2 Address, Jurisdiction")
    + _fields("EffectiveDate, RenewalDate, ExpirationDate, ExecutionDate", fill=None)
    + _fields("Autorenew")
    + _fields("Notification Period in days, NotificationPeriodDays, Notification_Buffer_Days", "int", None)
    + _fields("TerminationNotice, RenewalNotice, PerpetualAgreement")
    + _fields("PerpetualTerminationNoticeDays", "int", None)
    + _fields("Audit Flag, AuditReason, Lifecycle Stage, Risk Level, Archive Flag, ArchiveReason, GDPR_Applicable, Department, "
              "Contract_Owner, Contract_CoOwner")
    + _fields("ContractValue", "double", None)
    + _fields("ContractCurrency, ContractSummary, InitialTerm, RenewalTerm, CounterpartyRegion, ContractFamily, ParentContractId, "
              "ContractHierarchy")
    + _fields("DaysToExpiry", "int", None)
    + _fields("TermsInherited")
    + _fields("SOWStartDate, SOWEndDate", fill=None)
    + _fields("ParentAgreementDate"))


def enforce(df: DataFrame, schema: tuple[Field, ...] = STRICT_SCHEMA) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types.  Names are matched as they
    are (case counts); of two equal names in ``df`` the first is taken."""
    have: dict[str, Column] = {}
    unique = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    for i, name in enumerate(df.columns):
        have.setdefault(name, unique[f"c{i}"])
    out = []
    for f in schema:
        c = have.get(f.name, F.lit(None)).try_cast(f.type)
        out.append((c if f.fill is None else F.coalesce(c, F.lit(f.fill).cast(f.type))).alias(f.name))
    return unique.select(*out)


def compare_schema(df: DataFrame, schema: tuple[Field, ...] = STRICT_SCHEMA) -> dict[str, list[str]]:
    """Names of ``schema`` that ``df`` lacks, and names of ``df`` that ``schema`` lacks."""
    names = [f.name for f in schema]
    return {"missing": [n for n in names if n not in df.columns], "extra": [c for c in df.columns if c not in names]}


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def money(value: Column, region: Column) -> Column:
    """struct(amount, currency) of a stored value: the currency by sign or code, else by region;
    '' for a missing value."""
    v = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    none = v.isin("", "Unknown", "Not found")
    low = F.lower(v)
    currency = (F.when(v.contains("£"), "GBP").when(v.contains("€"), "EUR").when(low.contains("kr") | low.contains("dkk"), "DKK")
                .when(v.contains("$"), "USD").when(F.lower(F.coalesce(region, F.lit(""))).contains("emea"), "EUR").otherwise("USD"))
    digits = F.regexp_replace(F.regexp_replace(v, r"[£$€,\s]", ""), "(?i)USD|GBP|EUR|DKK|kr", "")
    amount = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits.try_cast("double"))
    return F.struct(F.when(~none, amount).alias("amount"), F.when(none, "").otherwise(currency).alias("currency"))


def type_code_of(hierarchy: Column, contract_id: Column, prefix: str) -> Column:
    """SOW and amendments by hierarchy, others by the second part of the registry id."""
    part = F.get(F.split(contract_id, "-"), F.lit(1))
    return (F.when(hierarchy == "SOW", "SOW").when(hierarchy == "Amendment", "AMD")
            .when(contract_id.startswith(f"{prefix}-"), F.coalesce(part, F.lit("MSA"))).otherwise("MSA"))


def strict_list(rows: DataFrame, id_prefix: str) -> DataFrame:
    """The list's rows from an export table whose columns have the list's names (dates as
    timestamps, value and counts as stored).  Everything is one projection."""
    h, cid = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("ContractHierarchy", "ContractId"))
    code = type_code_of(h, cid, id_prefix)
    full = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in TYPE_FULL_NAMES], F.when(h != "", h), F.lit("Contract"))
    us = lambda c: F.date_format(c, "MM/dd/yyyy")
    duration = F.when(F.col("EffectiveDate").isNotNull(), F.concat_ws(" - ", us("EffectiveDate"), us("ExpirationDate"))).otherwise("")
    value = money(F.col("ContractValue"), F.col("CounterpartyRegion"))
    parent = F.coalesce("ParentContractId", F.lit(""))
    set_ = {
        "Content Type": F.lit(CONTENT_TYPE), "ContractTitle": full, "ContractDuration": duration,
        "ContractValue": value["amount"], "ContractCurrency": value["currency"],
        "ContractSummary": F.left(F.coalesce("ContractSummary", F.lit("")), F.lit(SUMMARY_CHARS)),
        "NotificationPeriodDays": F.col("`Notification Period in days`"), "PerpetualTerminationNoticeDays": F.col("PerpetualNoticeDays"),
        "ParentContractId": F.when(h.isin("SOW", "Amendment", "Schedule") & (parent == ""), MISSING_PARENT).otherwise(parent),
        **{c: day_text(F.col(c)) for c in ("EffectiveDate", "RenewalDate", "ExpirationDate", "ExecutionDate", "SOWStartDate",
                                           "SOWEndDate", "ParentAgreementDate")},
    }
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in set_]
    return enforce(rows.select(*kept, *[v.alias(k) for k, v in set_.items()]))
