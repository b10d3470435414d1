"""Engine configuration.

Every literal that the original pipeline hard-coded (company names, id prefix,
cut-over dates, thresholds) lives here with a neutral default.  ``as_of`` is
never read from the clock: every operator that needs "now" takes it explicitly.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    # identity of "our" side of every contract
    primary_company_names: tuple[str, ...] = ("Our Company",)
    primary_company_display: str = "Our Company"
    primary_role_hints: tuple[str, ...] = ("our company",)
    # address fragments (lower case) that tell our side where no name does (C20)
    primary_company_addresses: tuple[str, ...] = ()
    # registry id prefix
    id_prefix: str = "CTR"
    # legacy threshold: effective date before this (or unknown) => -LEG (I8)
    legacy_threshold: _dt.date = _dt.date(2025, 1, 1)
    # address cut-over date for the primary entity
    address_cutover: _dt.date = _dt.date(2024, 12, 1)
    # fuzzy dedupe threshold (I4)
    fuzzy_threshold: int = 92
    # input screening
    blocked_keywords: tuple[str, ...] = ("block",)
    # restricted-party screening
    restricted_parties: tuple[str, ...] = ("Blocked Vendor LLC",)
    # thresholds used by BI measures and alerts
    expiring_days: int = 90
    critical_days: int = 30
    high_risk: int = 70
    # routing owners
    default_owner: str = "contracts-owner"
    default_co_owner: str = "contracts-co-owner"
    distribution_owner: str = "distribution-owner"
    # ingest routing owners (E5); empty = not configured
    owner_legal: str = "legal-owner"
    owner_marketing: str = "marketing-owner"
    owner_procurement: str = "procurement-owner"
    owner_distribution_emea: str = "distribution-emea-owner"
    owner_distribution_na_apac: str = "distribution-na-apac-owner"
    owner_distribution_na: str = "distribution-na-owner"
    default_contract_owner: str = ""
    default_contract_co_owner: str = ""
    # partition sizing hints (used by plans that repartition explicitly)
    range_partitions: int = 16
    extras: dict = field(default_factory=dict)


DEFAULT = EngineConfig()

# The as-of instant used by every test and by the driver fixture
# (expirations in the fixture run from 1995 to 2005).
FIXTURE_AS_OF = _dt.datetime(2000, 1, 1, 10, 0, 0)
FIXTURE_CONFIG = EngineConfig(
    legacy_threshold=_dt.date(1998, 1, 1),
    address_cutover=_dt.date(1998, 1, 1),
    primary_role_hints=("supplier", "vendor"),
    primary_company_addresses=("9 hafenweg",),
)
