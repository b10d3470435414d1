"""Risk rules, input screening and access audit.

Rules are data: an ordered list of (level, risk, pattern, negate) folded into
one array of conditional structs and exploded, so a document produces one row
per fired rule in a single narrow stage.  Clearance filtering joins a
three-row dimension (broadcast).  Java patterns use ``(?d)`` so that ``.``
stops only at ``\\n``, like the original engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.spans import let
from .clauses import _guard, renewal_terms
from .pii import pii_types

# Pipeline rule set (E34) — (level, risk, pattern, fires when absent).
PIPELINE_RULES = (
    ("high", "Unlimited liability exposure", r"unlimited liability|no cap|uncapped", False),
    ("high", "Auto-renewal without clear opt-out", r"automatically renew", False),
    ("medium", "Indemnification clauses present - review scope", r"indemnif", False),
    ("medium", "No explicit liability limitations found", r"limitation of liability", True),
    ("low", "Flexible termination options available", r"termination for convenience", False),
)
# Enterprise rule set (E35); the auto-renewal rule uses C18.
ENTERPRISE_RULES = (
    ("high", "Unlimited Liability Clause", r"unlimited.*liability", False),
    ("high", "Non-Compete Clause", r"non-compete", False),
    ("medium", "Auto-Renewal Clause", None, False),
    ("medium", "Indemnification Provisions", r"indemnif", False),
    ("low", "No Confidentiality Clause", r"confidential", True),
)
# Multi-agent high-risk patterns (E36), in report order.
MULTI_AGENT_RULES = (
    ("unlimited liability", r"unlimited\s+liability"),
    ("no liability cap", r"no\s+(?:cap|limit).*?liability"),
    ("auto-renewal without notice", r"automatically\s+renew(?!.*notice)"),
    ("exclusive arrangement", r"exclusiv(?:e|ity)"),
    ("minimum purchase requirements", r"minimum.*?(?:order|purchase|commitment)"),
    ("liquidated damages", r"liquidated\s+damages"),
    ("IP ownership transfer", r"(?:transfer|assign).*?(?:intellectual\s+property|IP)"),
)
# Words of the lower-cased text that a pattern needs (see ``clauses._guard``).
RULE_GUARDS = {
    r"unlimited liability|no cap|uncapped": ("unlimited liability", "no cap", "uncapped"),
    r"automatically renew": ("automatically renew",), r"indemnif": ("indemnif",),
    r"limitation of liability": ("limitation of liability",), r"termination for convenience": ("termination for convenience",),
    r"unlimited.*liability": (("unlimited", "liability"),), r"non-compete": ("non-compete",), r"confidential": ("confidential",),
    r"unlimited\s+liability": (("unlimited", "liability"),), r"no\s+(?:cap|limit).*?liability": (("no", "liability"),),
    r"automatically\s+renew(?!.*notice)": (("automatically", "renew"),), r"exclusiv(?:e|ity)": ("exclusive", "exclusivity"),
    r"minimum.*?(?:order|purchase|commitment)": (("minimum", "order"), ("minimum", "purchase"), ("minimum", "commitment")),
    r"liquidated\s+damages": (("liquidated", "damages"),),
    r"(?:transfer|assign).*?(?:intellectual\s+property|IP)": (("transfer", "ip"), ("assign", "ip"), ("transfer", "intellectual"),
                                                              ("assign", "intellectual")),
}
# Levels visible per clearance.
CLEARANCE_LEVELS = (("confidential", "high"), ("confidential", "medium"), ("confidential", "low"),
                    ("internal", "high"), ("internal", "medium"), ("public", "high"))
# Injection phrases of the two screening policies.
INJECTION_WARN = (r"ignore previous instructions", r"disregard.*rules", r"you are now")
INJECTION_BLOCK = (r"ignore\s+previous\s+instructions", r"disregard\s+all\s+prior",
                   r"forget\s+your\s+instructions", r"system\s*:\s*you\s+are")


def _fired(text: Column, rules) -> Column:
    t = F.coalesce(text, F.lit(""))

    def of(low: Column) -> Column:
        items = []
        for ordinal, (level, risk, pattern, negate) in enumerate(rules):
            hit = renewal_terms(t)["has_auto_renewal"] if pattern is None else _hit(t, low, pattern)
            if negate:
                hit = ~hit
            items.append(F.when(hit, F.struct(F.lit(ordinal).alias("ordinal"), F.lit(level).alias("level"),
                                              F.lit(risk).alias("risk"))))
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    return let(F.lower(t), of)


def _hit(text: Column, low: Column, pattern: str) -> Column:
    """Whether a rule's pattern matches; it only runs where its words occur."""
    hit, g = text.rlike("(?id)" + pattern), _guard(low, RULE_GUARDS.get(pattern))
    return hit if g is None else g & hit


def clause_risks(docs: DataFrame, id_col: str, text_col: str = "text", rule_set: str = "pipeline") -> DataFrame:
    """One row per (document, fired rule)."""
    rules = PIPELINE_RULES if rule_set == "pipeline" else ENTERPRISE_RULES
    return (docs.select(id_col, F.explode(_fired(F.col(text_col), rules)).alias("r"))
            .select(id_col, "r.ordinal", "r.level", "r.risk"))


def visible_risks(risks: DataFrame, clearance: str | Column) -> DataFrame:
    """Keep the levels a clearance may see (three-row dimension)."""
    spark = risks.sparkSession
    dim = spark.createDataFrame(list(CLEARANCE_LEVELS), "clearance STRING, level STRING")
    c = F.lit(clearance) if isinstance(clearance, str) else clearance
    return risks.withColumn("clearance", c).join(F.broadcast(dim), ["clearance", "level"], "inner")


def recommendations(sensitivity: Column) -> Column:
    """E35 recommendations by sensitivity."""
    return F.when(sensitivity.isin("confidential", "restricted"), F.array(
        F.lit("Recommend executive review for high-sensitivity contract"),
        F.lit("Ensure data classification labels are properly applied"))).otherwise(
        F.array(F.lit("Standard risk review process applies")))


def multi_agent_risks(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Fired high-risk flags (the lookahead rule: 'automatically renew'
    with no 'notice' later on the same line, Q23)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    fired = let(F.lower(t), lambda low: F.filter(F.array(*[
        F.when(_hit(t, low, p), F.struct(F.lit(i).alias("ordinal"), F.lit(n.upper()).alias("risk")))
        for i, (n, p) in enumerate(MULTI_AGENT_RULES)]), lambda x: x.isNotNull()))
    return (docs.select(id_col, F.explode(fired).alias("r"))
            .select(id_col, "r.ordinal", "r.risk"))


def screen_inputs(messages: DataFrame, text_col: str = "text", policy: str = "block",
                  cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Verdict per message, first hit wins.

    policy 'block': PII -> blocked, then blocked keyword, then injection.
    policy 'warn': PII is only flagged; keyword and injection block."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(t)
    pii = pii_types(t)
    kw = F.lit(None).cast("string")
    for k in reversed(cfg.blocked_keywords):
        kw = F.when(low.contains(k.lower()), F.lit(k)).otherwise(kw)
    inj_patterns = INJECTION_BLOCK if policy == "block" else INJECTION_WARN
    inj = t.rlike("(?id)(?:" + "|".join(f"(?:{p})" for p in inj_patterns) + ")")
    has_pii = F.size(pii) > 0
    if policy == "block":
        verdict = (F.when(has_pii, "blocked_pii").when(kw.isNotNull(), "blocked_keyword")
                   .when(inj, "blocked_injection").otherwise("allowed"))
    else:
        verdict = (F.when(kw.isNotNull(), "blocked_keyword").when(inj, "blocked_injection")
                   .when(has_pii, "warn_pii").otherwise("allowed"))
    return messages.select("*", F.array_join(pii, ",").alias("pii_types"), kw.alias("blocked_keyword"),
                           verdict.alias("verdict")).drop(text_col)


def restricted_party_hits(docs: DataFrame, id_col: str, text_col: str = "text",
                          cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(document, restricted party) for every configured party contained
    in the text (case-insensitive).  The party list is configuration — a
    bounded broadcast side of a non-equi join."""
    spark = docs.sparkSession
    parties = spark.createDataFrame([(p,) for p in cfg.restricted_parties], "party STRING")
    low = docs.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    return (low.join(F.broadcast(parties), F.col("_low").contains(F.lower(F.col("party"))), "inner")
            .select(id_col, "party"))


def access_audit(access: DataFrame) -> DataFrame:
    """A public-clearance user reading metadata or risks -> audit row."""
    return (access.where((F.col("clearance") == "public")
                         & F.col("action").isin("metadata_extraction", "risk_analysis"))
            .select("user_id", "ts", "action", F.col("clearance").alias("user_level"),
                    F.concat(F.lit("Public user ran "), F.col("action")).alias("warning")))


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                    salt_col: str, salt_buckets: int = 64) -> DataFrame:
    """W1 pattern: the n first rows per group without one task holding a hot
    group.  Phase 1 ranks inside (group, salt) buckets and keeps n per bucket;
    phase 2 ranks the at most n x buckets survivors per group."""
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salt_buckets))  # deterministic on retry
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return stage1.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n) \
        .drop("_salt", "_r1")


def last_n_per_user(events: DataFrame, n: int = 10, user_col: str = "user_id", ts_col: str = "ts",
                    id_col: str = "event_id") -> DataFrame:
    """The last n events of each user (newest first, ties by id)."""
    return top_n_per_group(events, [user_col], [F.desc(ts_col), F.desc(id_col)], n, id_col)
