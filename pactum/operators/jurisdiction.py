"""Jurisdiction of a contract record (E28) as one ordered chain of column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import CHILD_CLASSES, jurisdiction_valid

# Words of an address and the jurisdiction they stand for, in search order
# (substrings, so "uk" is also found inside other words).
COUNTRY_JURISDICTIONS = (
    ("england", "England and Wales"), ("united kingdom", "England and Wales"), ("uk", "England and Wales"),
    ("germany", "Germany"), ("deutschland", "Germany"), ("france", "France"), ("netherlands", "Netherlands"),
    ("australia", "Australia"), ("singapore", "Singapore"), ("hong kong", "Hong Kong"), ("japan", "Japan"),
    ("canada", "Ontario, Canada"),
)
# States and their postal codes, in search order.
US_STATES = (
    ("Colorado", "co"), ("California", "ca"), ("New York", "ny"), ("Texas", "tx"), ("Florida", "fl"), ("Michigan", "mi"),
    ("Illinois", "il"), ("Georgia", "ga"), ("Delaware", "de"), ("Massachusetts", "ma"), ("Washington", "wa"),
    ("Virginia", "va"), ("North Carolina", "nc"), ("Arizona", "az"), ("Nevada", "nv"), ("Oregon", "or"),
    ("Minnesota", "mn"), ("Wisconsin", "wi"), ("Tennessee", "tn"), ("Ohio", "oh"), ("Pennsylvania", "pa"),
)
HOME_STATE = "Colorado"
HOME_REGION = "North America"
REVIEW = "Requires Review"


def address_country(address: Column) -> Column:
    low = F.lower(F.coalesce(address, F.lit("")))
    return F.coalesce(*(F.when(low.contains(word), F.lit(name)) for word, name in COUNTRY_JURISDICTIONS))


def address_state(address: Column) -> Column:
    low = F.lower(F.coalesce(address, F.lit("")))
    return F.coalesce(*(F.when(low.rlike(rf"\b{name.lower()}\b|\b{code}\s+[0-9]{{5}}"), F.lit(name)) for name, code in US_STATES))


def resolve_jurisdiction(law: Column, jurisdiction: Column, hierarchy: Column, inherited: Column, address: Column,
                         region: Column) -> Column:
    """Own governing law, own jurisdiction, the parent's (child documents), the
    address's country, for the home region the address's state or the home state."""
    own = [F.when(jurisdiction_valid(c), c) for c in (law, jurisdiction)]
    parent = F.when(hierarchy.isin(*CHILD_CLASSES) & jurisdiction_valid(inherited), F.concat(inherited, F.lit(" (from MSA)")))
    home = F.when(region == HOME_REGION, F.coalesce(
        address_state(address), F.lit(f"{HOME_STATE} (default - requires verification)")))
    return F.coalesce(*own, parent, address_country(address), home, F.lit(REVIEW))


def jurisdictions(reg: DataFrame, inherited: DataFrame, meta: DataFrame) -> DataFrame:
    """E28 per registry row: ``inherited`` has (contract_id, inherited_jurisdiction),
    ``meta`` the record columns."""
    own = meta.select("contract_id", "governing_law", "counterparty_address", "region")
    rows = reg.select("contract_id", "hierarchy").join(own, "contract_id").join(inherited, "contract_id", "left")
    return rows.select("contract_id", resolve_jurisdiction(
        F.col("governing_law"), F.lit(None).cast("string"), F.col("hierarchy"), F.col("inherited_jurisdiction"),
        F.col("counterparty_address"), F.col("region")).alias("jurisdiction"))


def clean_jurisdiction(value: Column) -> Column:
    """A label without its verification mark; one that is missing or empty asks for review."""
    v = F.trim(F.coalesce(value, F.lit("")))
    marked = F.lower(v).contains("default - requires verification")
    bare = F.when(marked, F.trim(F.substring_index(v, "(", 1))).otherwise(v)
    return F.when(bare == "", REVIEW).otherwise(bare)


def export_jurisdiction(extra: list[Column], law: Column, jurisdiction: Column, hierarchy: Column, inherited: Column,
                        address: Column, region: Column) -> Column:
    """E28 at export: the first valid of the extra fields, a valid inherited value, else as
    ``resolve_jurisdiction``; then the label is cleaned."""
    first = [F.when(jurisdiction_valid(c), c) for c in extra]
    parent = F.when(jurisdiction_valid(inherited), F.concat(inherited, F.lit(" (from MSA)")))
    return clean_jurisdiction(F.coalesce(*first, parent, resolve_jurisdiction(law, jurisdiction, hierarchy, inherited, address, region)))
