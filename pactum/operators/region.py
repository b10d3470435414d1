"""Region and GDPR rules.

Place names and entity patterns are rule lists folded into ordered ``when``
chains over one text column — no per-row Python, no join (the lists are
configuration of fixed, small size).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import let

# European legal-entity patterns (case-sensitive), in order.
EU_ENTITY_PATTERNS = (
    r"\b[A-Z][A-Za-z&\s]+ Limited\b", r"\b[A-Z][A-Za-z&\s]+ Ltd\.?\b", r"\b[A-Z][A-Za-z&\s]+ GmbH\b",
    r"\b[A-Z][A-Za-z&\s]+ ApS\b", r"\b[A-Z][A-Za-z&\s]+ BV\b", r"\b[A-Z][A-Za-z&\s]+ NV\b",
    r"\b[A-Z][A-Za-z&\s]+ AG\b", r"\b[A-Z][A-Za-z&\s]+ SA\b", r"\b[A-Z][A-Za-z&\s]+ SAS\b",
)
# The same patterns read right-to-left (suffix first) with their labels: on the
# reversed text the literal suffix anchors every attempt, so the scan is linear
# instead of re-running the open letter class from every capital letter.  Only
# presence and the suffix label are used, and both are direction-independent.
def _right_to_left(pattern: str) -> tuple[str, str, str]:
    """(pattern on the reversed text, label, text that must occur) of an entity pattern."""
    suffix = pattern.split("]+ ")[1].removesuffix(r"\b")
    word = suffix.removesuffix(r"\.?")
    dot = suffix[len(word):]
    return rf"\b{dot}{word[::-1]} [A-Za-z&\s]+[A-Z]\b", word.upper(), " " + word


EU_ENTITY_REVERSED = tuple(_right_to_left(p) for p in EU_ENTITY_PATTERNS)
# Place names by region, in search order.
EMEA_COUNTRIES = (
    "Denmark", "Germany", "France", "UK", "United Kingdom", "England", "Scotland", "Netherlands",
    "Belgium", "Sweden", "Norway", "Finland", "Ireland", "Spain", "Italy", "Austria", "Switzerland",
    "Poland", "Czech Republic", "Portugal", "Greece", "Hungary", "Romania", "Bulgaria", "Croatia",
    "Slovakia", "Lithuania", "Latvia", "Estonia", "Iceland", "Luxembourg", "Liechtenstein", "Malta",
)
NA_LOCATIONS = (
    "United States", "USA", "U.S.", "Canada", "Mexico", "Colorado", "California", "Texas",
    "New York", "Delaware", "Florida", "Illinois", "Massachusetts", "Washington", "Virginia",
)
APAC_COUNTRIES = (
    "China", "Japan", "Korea", "Singapore", "Australia", "India", "Thailand", "Malaysia", "Indonesia",
    "Philippines", "Vietnam", "Taiwan", "Hong Kong", "New Zealand",
)
# Export-side address keywords (lower case).
EMEA_KEYWORDS = (
    "united kingdom", "england", "scotland", "wales", "ireland", "denmark", "germany",
    "france", "spain", "portugal", "sweden", "norway", "finland", "switzerland", "austria",
    "italy", "belgium", "netherlands", "luxembourg", "poland", "czech", "slovak", "hungary",
    "romania", "bulgaria", "slovenia", "croatia", "serbia", "estonia", "latvia", "lithuania",
    "iceland", "greece",
)
NA_ADDRESS_KEYWORDS = ("united states", "usa", "canada", "mexico")
APAC_ADDRESS_KEYWORDS = ("singapore", "japan", "china", "australia", "new zealand")


# What a text says of its region itself.
EXPLICIT_NAMES = ("EMEA", "North America", "APAC", "Asia Pacific")


def _by_prefix(names) -> str:
    """A pattern of the (lower-case) names, their common beginnings read once."""
    heads: dict[str, list[str]] = {}
    for n in names:
        heads.setdefault(n[:1], []).append(n[1:])
    if not heads.get(""):
        tails = [re.escape(h) + _by_prefix(rest) for h, rest in heads.items()]
        return tails[0] if len(tails) == 1 else "(?:" + "|".join(tails) + ")"
    del heads[""]
    return "(?:" + _by_prefix([h + r for h, rest in heads.items() for r in rest]) + ")?" if heads else ""


# All names but those with a wildcard by one scan: none begins within another, so a scan finds each.
# No name begins behind a letter, which is seen at less cost than a word's boundary.
SCANNED_NAMES = tuple(n for n in (*EXPLICIT_NAMES, *EMEA_COUNTRIES, *NA_LOCATIONS, *APAC_COUNTRIES) if "." not in n)
NAME_SCAN = r"(?i)(?<![a-z])\b" + _by_prefix(dict.fromkeys(n.lower() for n in SCANNED_NAMES)) + r"\b"
# What every European entity pattern holds.
EU_SUFFIX = r" (?=[LGABNS])(?:Limited|Ltd|GmbH|ApS|BV|NV|AG|SA)"


def _names_in(text: Column) -> Column:
    """The names found as whole words, case-insensitive, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAME_SCAN), F.lit(0)), lambda n: F.lower(n)))


def _first_name(text: Column, names, found: Column) -> Column:
    """The first name (in list order) found as a whole word, case-insensitive.
    Names are used as patterns as written ('U.S.' keeps its dots as wildcards, Q14, so it
    is looked for by itself); the others are those of :func:`_names_in`."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        hit = text.rlike(rf"(?i)\b{n}\b") if "." in n else F.array_contains(found, n.lower())
        out = F.when(hit, F.lit(n)).otherwise(out)
    return out


def detect_region_gdpr(text: Column, address: Column | None = None, emea_entity_pattern: str | None = None,
                       emea_entity_reason: str = "Primary company EMEA entity") -> Column:
    """struct(region, subject_to_gdpr, gdpr_reason) from the text plus the
    address blob; each check only fills what earlier checks left empty."""
    t = F.coalesce(text, F.lit(""))
    if address is not None:
        t = F.when(F.coalesce(address, F.lit("")) != "", F.concat(t, F.lit(" "), address)).otherwise(t)
    # each step is one value that the next ones read, so no search runs twice
    return let(t, lambda t: let(_names_in(t), lambda names: _detect(t, names, emea_entity_pattern, emea_entity_reason)))


def _detect(t: Column, names: Column, emea_entity_pattern: str | None, emea_entity_reason: str) -> Column:
    has = lambda n: F.array_contains(names, n.lower())
    explicit = (F.when(has("EMEA"), F.lit("EMEA")).when(has("North America"), F.lit("North America"))
                .when(has("APAC") | has("Asia Pacific"), F.lit("APAC")))

    def entity(rev: Column) -> Column:
        label = F.lit(None).cast("string")
        for pattern, lab, suffix in reversed(EU_ENTITY_REVERSED):
            label = F.when(t.contains(suffix) & rev.rlike(pattern), F.lit(lab)).otherwise(label)
        return label

    label = F.when(t.rlike(EU_SUFFIX), let(F.reverse(t), entity))
    hit = t.rlike("(?i)" + emea_entity_pattern) if emea_entity_pattern else F.lit(False)
    found = F.struct(explicit.alias("explicit"), label.alias("label"), hit.alias("hit"))
    # a country only tells where no check before it did
    told = lambda f: (F.coalesce(f["explicit"], F.lit("")) == "EMEA") | f["hit"] | f["label"].isNotNull()
    return let(found, lambda f: let(F.when(~told(f), _first_name(t, EMEA_COUNTRIES, names)), lambda country: _decide(
        t, names, f["explicit"], f["label"], country, f["hit"], emea_entity_reason)))


def _decide(t: Column, names: Column, explicit: Column, entity: Column, country: Column, hit: Column,
            emea_entity_reason: str) -> Column:
    gdpr = F.when((explicit == "EMEA") | hit, F.lit(True))
    reason = F.when(hit, F.lit(emea_entity_reason)).when(explicit == "EMEA", F.lit("EMEA region"))
    region = F.coalesce(explicit, F.when(hit, F.lit("EMEA")))
    reason = F.when(gdpr.isNull() & entity.isNotNull(),
                    F.concat(F.lit("European legal entity type ("), entity, F.lit(")"))).otherwise(reason)
    gdpr = F.when(gdpr.isNull() & entity.isNotNull(), F.lit(True)).otherwise(gdpr)
    region = F.coalesce(region, F.when(entity.isNotNull(), F.lit("EMEA")))
    reason = F.when(gdpr.isNull() & country.isNotNull(),
                    F.concat(F.lit("European address ("), country, F.lit(")"))).otherwise(reason)
    gdpr = F.when(gdpr.isNull() & country.isNotNull(), F.lit(True)).otherwise(gdpr)
    region = F.coalesce(region, F.when(country.isNotNull(), F.lit("EMEA")),
                        F.when(_first_name(t, NA_LOCATIONS, names).isNotNull(), F.lit("North America")),
                        F.when(_first_name(t, APAC_COUNTRIES, names).isNotNull(), F.lit("APAC")))
    return F.struct(region.alias("region"), gdpr.alias("subject_to_gdpr"), reason.alias("gdpr_reason"))


def _contains_any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def region_from_addresses(*addresses: Column) -> Column:
    """EMEA over all addresses first, then North America, then APAC."""
    lows = [F.lower(F.coalesce(a, F.lit(""))) for a in addresses]

    def any_addr(words):
        out = F.lit(False)
        for low in lows:
            out = out | _contains_any(low, [w.lower() for w in words])
        return out
    return (F.when(any_addr(EMEA_COUNTRIES), F.lit("EMEA")).when(any_addr(NA_LOCATIONS), F.lit("North America"))
            .when(any_addr(APAC_COUNTRIES), F.lit("APAC")))


def infer_region_from_address(address: Column) -> Column:
    low = F.lower(F.coalesce(address, F.lit("")))
    return (F.when(low == "", F.lit(None).cast("string"))
            .when(_contains_any(low, EMEA_KEYWORDS), F.lit("EMEA"))
            .when(_contains_any(low, NA_ADDRESS_KEYWORDS), F.lit("North America"))
            .when(_contains_any(low, APAC_ADDRESS_KEYWORDS), F.lit("APAC")))


def resolve_region(counterparty_region: Column, region: Column, address: Column, folder_hint: Column) -> Column:
    """Explicit region (any non-blank value, 'Unknown' included, Q15), else
    address keywords, else a folder hint."""
    explicit = F.coalesce(F.when(F.coalesce(counterparty_region, F.lit("")) != "", counterparty_region),
                          F.when(F.coalesce(region, F.lit("")) != "", region))
    explicit = F.when(F.trim(F.coalesce(explicit, F.lit(""))) != "", explicit)
    hint = F.lower(F.coalesce(folder_hint, F.lit("")))
    from_folder = (F.when(hint.contains("emea") | hint.contains("europe"), F.lit("EMEA"))
                   .when(_contains_any(hint, ("north america", "na_", "na-", "na ")), F.lit("North America"))
                   .when(hint.contains("apac") | hint.contains("asia"), F.lit("APAC")))
    return F.coalesce(explicit, infer_region_from_address(address), from_folder)


def gdpr_decision(gdpr_applicable: Column, gdpr_reason: Column, subject_to_gdpr: Column, region: Column,
                  address: Column) -> Column:
    """struct(gdpr, reason): the stored flag (title-cased; absent = 'No'),
    then the subject flag, then an EMEA region, then an EMEA address.  A stored
    'Unknown' is not 'No', so nothing is inferred for it (Q16)."""
    flag = F.initcap(F.coalesce(gdpr_applicable.cast("string"), F.lit("No")))
    reason = F.coalesce(gdpr_reason, F.lit(""))
    subj = F.lower(F.coalesce(subject_to_gdpr.cast("string"), F.lit("No"))).isin("yes", "true", "1")
    emea_region = F.lower(F.coalesce(region, F.lit(""))) == "emea"
    emea_addr = (F.coalesce(address, F.lit("")) != "") & _contains_any(F.lower(F.coalesce(address, F.lit(""))),
                                                                       EMEA_KEYWORDS)
    is_no = flag == "No"
    out_flag = F.when(is_no & (subj | emea_region | emea_addr), F.lit("Yes")).otherwise(flag)
    out_reason = (F.when(~is_no, reason)
                  .when(subj, F.when(reason != "", reason).otherwise(F.lit("Subject to GDPR per extraction")))
                  .when(emea_region, F.when(reason != "", reason).otherwise(F.lit("Counterparty region in EMEA")))
                  .when(emea_addr, F.when(reason != "", reason).otherwise(F.lit("Counterparty address in EMEA")))
                  .otherwise(reason))
    return F.struct(out_flag.alias("gdpr"), out_reason.alias("gdpr_reason"))


# Department fallback by contract-type keyword, in order.
DEPARTMENT_MAP = (
    ("reseller", "Sales"), ("distributor", "Sales"), ("channel", "Sales"), ("partner", "Sales"),
    ("nda", "Legal"), ("non-disclosure", "Legal"), ("confidentiality", "Legal"),
    ("employment", "HR"), ("contractor", "HR"), ("consultant", "HR"),
    ("marketing", "Marketing"), ("joint marketing", "Marketing"),
    ("procurement", "Procurement"), ("vendor", "Procurement"), ("supplier", "Procurement"),
    ("oem", "Engineering"), ("development", "Engineering"), ("license", "Legal"),
    ("software", "Engineering"), ("master service", "Operations"), ("msa", "Operations"),
)
NA_APAC_REGION_KEYS = ("north america", "na", "apac", "asia pac", "asia-pacific", "asia pacific")


def department_and_owner(department: Column, owner: Column, co_owner: Column, contract_type: Column,
                         region: Column, cfg) -> Column:
    """struct(department, owner, co_owner): stored department else the
    first keyword of the type; distributors in NA/APAC route to the
    distribution team; owner / co-owner fall back to the configured ones."""
    t = F.lower(F.coalesce(contract_type, F.lit("")))
    fallback = F.lit("General")
    for k, d in reversed(DEPARTMENT_MAP):
        fallback = F.when(t.contains(k), F.lit(d)).otherwise(fallback)
    dept = F.coalesce(F.when(F.coalesce(department, F.lit("")) != "", department), fallback)
    own = F.coalesce(F.when(F.coalesce(owner, F.lit("")) != "", owner), F.lit(cfg.default_owner))
    dist = t.contains("distributor") & F.lower(F.coalesce(region, F.lit(""))).isin(*NA_APAC_REGION_KEYS)
    dept = F.when(dist, F.lit("NA APAC Distributor Management")).otherwise(dept)
    if cfg.distribution_owner:
        own = F.when(dist, F.lit(cfg.distribution_owner)).otherwise(own)
    own = F.when(own == "", F.lit(cfg.default_owner)).otherwise(own)
    co = F.coalesce(co_owner, F.lit(""))
    d_co = F.lit(cfg.default_co_owner)
    co = (F.when(co == "", F.when(d_co != own, d_co).otherwise(F.lit("")))
          .when((co == own) & (d_co != own), d_co).otherwise(co))
    return F.struct(dept.alias("department"), own.alias("owner"), co.alias("co_owner"))


# Ingest routing keywords (E5).
DISTRIBUTION_KEYWORDS = ("distributor", "distribution", "reseller", "partner program")
PROCUREMENT_KEYWORDS = ("supplier", "manufactur", "oem", "vendor", "hotel", "credit card", "procurement")
MARKETING_KEYWORDS = ("marketing", "campaign", "advertising", "joint marketing")


def _owners(*names: str, cfg=None) -> list[str]:
    """Order-preserving unique non-empty owners plus the configured defaults."""
    out: list[str] = []
    for n in names:
        if n and n not in out:
            out.append(n)
    if not out and cfg.default_contract_owner:
        out.append(cfg.default_contract_owner)
    if cfg.default_contract_co_owner and cfg.default_contract_co_owner not in out:
        out.append(cfg.default_contract_co_owner)
    return out


def _arr(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def assign_owners(contract_type: Column, region: Column, cfg) -> Column:
    """E5: struct(department, owners) by type keywords (marketing, then
    procurement, then distribution by region), owners de-duplicated in order.
    Owner names are configuration, so every branch is a literal array."""
    t = F.lower(F.coalesce(contract_type, F.lit("")))
    r = F.lower(F.coalesce(region, F.lit("")))
    legal = _owners(cfg.owner_legal, cfg=cfg)
    dist = (F.when(r.isin("emea", "europe", "europe, middle east and africa"), F.struct(
                F.lit("EMEA Distribution").alias("department"),
                _arr(_owners(cfg.owner_distribution_emea, cfg.owner_legal, cfg=cfg) or legal).alias("owners")))
            .when(r.isin("north america", "na", "apac", "asia pac", "asia-pacific"), F.struct(
                F.lit("NA APAC Distributor Management").alias("department"),
                _arr(_owners(cfg.owner_distribution_na_apac, cfg.owner_legal, cfg=cfg) or legal).alias("owners")))
            .otherwise(F.struct(F.lit("NA Distribution").alias("department"),
                                _arr(_owners(cfg.owner_distribution_na, cfg.owner_legal, cfg=cfg) or legal)
                                .alias("owners"))))
    return (F.when(_contains_any(t, MARKETING_KEYWORDS), F.struct(
                F.lit("Marketing").alias("department"),
                _arr(_owners(cfg.owner_legal, cfg.owner_marketing, cfg=cfg)).alias("owners")))
            .when(_contains_any(t, PROCUREMENT_KEYWORDS), F.struct(
                F.lit("Procurement").alias("department"),
                _arr(_owners(cfg.owner_legal, cfg.owner_procurement, cfg=cfg)).alias("owners")))
            .when(_contains_any(t, DISTRIBUTION_KEYWORDS), dist)
            .otherwise(F.struct(F.lit("Legal").alias("department"), _arr(legal).alias("owners"))))
