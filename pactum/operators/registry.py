"""Registry identity and lineage for the list export (E13, E15-E18, E21, E23,
E24, E31, E32, C29, I6-I10, J2, J4, J5, G13).

Plan (no nested loops, no collected lists):

* ``classify``: one narrow stage — hierarchy class, clean counterparty,
  family id, type code, parsed dates, legacy and draft flags, sort key.
* ``parent_search`` (J2): works on *distinct normalised names*.  Parent
  candidates are pre-aggregated per name (``min`` of the priority key, a
  partial aggregation, so a hot name costs one row); name containment is an
  equi-join between every substring of one side and the names of the other
  (exact, shuffle-able); then one ``min`` per child name and an equi-join back
  to the children (one build row per name).
* ``allocate_ids`` (I6): parents and parent-less children share one dense
  sequence in (hierarchy rank, date with NULL = 1900-01-01, position) order,
  computed by ``dense_index`` (range partitions + per-partition offsets).
  Running child numbers (I7) use the same machinery per (parent, class).

Because MSAs sort by date with NULL first, "the first MSA dated on or before
the child" and "the first MSA" are the same row whenever the child has an
MSA match at all; the search therefore keeps one MSA key per name (Q24).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.dates import as_of_lit, floor_days, parse_date_export
from ..functions.missing import col_or_null, yes_no
from ..functions.sequence import dense_index, rank_within_groups
from ..functions.textrules import party_garbage
from ..session import ensure_checkpoint_dir
from ..session import materialize as checkpointed
from .clauses import notice_days

# Hierarchy ranks of the id allocation order.
HIERARCHY_ORDER = {"MSA": 0, "NDA": 1, "Standalone": 2, "SOW": 3, "Amendment": 4, "Schedule": 5}
CHILD_CLASSES = ("SOW", "Amendment", "Schedule")
PARENT_CLASSES = ("MSA", "NDA", "Standalone")

# Hierarchy rules (E13), filename first, then contract type.
SOW_FILE_PATTERNS = (r"\bsow\s*#?\d+", r"\bsow\b", r"statement\s+of\s+work", r"work\s+order",
                     r"project\s+order", r"task\s+order")
AMENDMENT_FILE_WORDS = ("amendment", "addendum", "modification", "change order", "supplement")
NDA_FILE_WORDS = ("nda", "non-disclosure", "confidentiality", "mutual nda")
MSA_FILE_WORDS = ("master service", "master agreement", " msa ", "_msa_", "-msa-", "_msa.",
                  "framework agreement", "umbrella agreement")
SCHEDULE_FILE_WORDS = ("schedule", "exhibit", "appendix", "annex", "attachment")
SOW_TYPE_WORDS = ("statement of work", "sow", "work order", "project order")
AMENDMENT_TYPE_WORDS = ("amendment", "addendum", "modification")
NDA_TYPE_WORDS = ("nda", "non-disclosure", "confidentiality")
MSA_TYPE_WORDS = ("master service", "master agreement", "msa", "framework")

# Contract type -> 3-letter code, in lookup order.
TYPE_CODES = (
    ("master service agreement", "MSA"), ("master service agreement (msa)", "MSA"),
    ("master agreement", "MSA"), ("msa", "MSA"),
    ("service agreement", "SVC"), ("consulting agreement", "SVC"),
    ("professional services agreement", "SVC"),
    ("distributor agreement", "DST"), ("distribution agreement", "DST"),
    ("reseller agreement", "RSL"), ("var agreement", "RSL"), ("value added reseller", "RSL"),
    ("partner program agreement", "RSL"),
    ("oem agreement", "OEM"), ("odm agreement", "OEM"), ("original equipment manufacturer", "OEM"),
    ("original design manufacturing", "OEM"),
    ("purchase agreement", "PUR"), ("purchase order agreement", "PUR"),
    ("sales agreement", "DST"), ("direct sales agreement", "DST"),
    ("vendor/supplier agreement", "VND"), ("vendor agreement", "VND"), ("supplier agreement", "VND"),
    ("development agreement", "DEV"),
    ("non-disclosure agreement (nda)", "NDA"), ("nda", "NDA"), ("confidentiality agreement", "NDA"),
    ("mutual nda", "NDA"), ("cda", "NDA"),
    ("statement of work (sow)", "SOW"), ("sow", "SOW"), ("work order", "SOW"),
    ("project order", "SOW"), ("task order", "SOW"),
    ("amendment/addendum", "AMD"), ("amendment", "AMD"), ("addendum", "AMD"),
    ("modification", "AMD"), ("change order", "AMD"),
    ("termination agreement", "TRM"), ("correspondence/notice", "COR"), ("schedule", "SCH"),
    ("standalone", "MSA"),
)
# Company-suffix words dropped by the name normaliser.
NAME_SUFFIXES = ("inc", "inc.", "llc", "ltd", "limited", "corp", "corporation", "co", "company",
                 "pty", "gmbh", "ag", "sa", "nv", "bv")
# Child-number patterns from filenames (C29), lower-cased input.
SOW_NUMBER_PATTERNS = (r"\bsow\s*#?\s*(\d+)", r"statement\s+of\s+work\s*#?\s*(\d+)", r"\bsow(\d+)\b")
AMENDMENT_NUMBER_PATTERNS = (r"\bamendment\s*#?\s*(\d+)", r"\baddendum\s*#?\s*(\d+)",
                             r"\bmodification\s*#?\s*(\d+)")
SCHEDULE_NUMBER_PATTERNS = (r"\bschedule\s*#?\s*(\d+)", r"\bschedule(\d+)\b", r"\bsched\s*#?\s*(\d+)",
                            r"\bexhibit\s*#?\s*(\d+)")


def _has_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def hierarchy_class(contract_type: Column, filename: Column) -> Column:
    """SOW -> Amendment -> NDA -> MSA -> Schedule on the filename, then
    SOW -> Amendment -> NDA -> MSA on the type, else Standalone."""
    t = F.lower(F.coalesce(contract_type, F.lit("")))
    f = F.lower(F.coalesce(filename, F.lit("")))
    sow_file = f.rlike("|".join(f"(?:{p})" for p in SOW_FILE_PATTERNS))
    return (F.when(sow_file, "SOW")
            .when(_has_any(f, AMENDMENT_FILE_WORDS), "Amendment")
            .when(_has_any(f, NDA_FILE_WORDS), "NDA")
            .when(_has_any(f, MSA_FILE_WORDS), "MSA")
            .when(_has_any(f, SCHEDULE_FILE_WORDS), "Schedule")
            .when(_has_any(t, SOW_TYPE_WORDS), "SOW")
            .when(_has_any(t, AMENDMENT_TYPE_WORDS), "Amendment")
            .when(_has_any(t, NDA_TYPE_WORDS), "NDA")
            .when(_has_any(t, MSA_TYPE_WORDS), "MSA")
            .otherwise("Standalone"))


def type_code(contract_type: Column, hierarchy: Column) -> Column:
    """Hierarchy override, exact key, first two-way substring match in key
    order (an empty type matches the first key), else MSA (Q19)."""
    t = F.lower(F.trim(F.coalesce(contract_type, F.lit(""))))
    exact = F.create_map(*[x for k, v in TYPE_CODES for x in (F.lit(k), F.lit(v))])
    partial = F.lit("MSA")
    for k, v in reversed(TYPE_CODES):
        partial = F.when(t.contains(k) | F.lit(k).contains(t), F.lit(v)).otherwise(partial)
    return (F.when(hierarchy == "SOW", "SOW").when(hierarchy == "Amendment", "AMD")
            .when(hierarchy == "NDA", "NDA")
            .otherwise(F.coalesce(F.try_element_at(exact, t), partial)))


def child_number(filename: Column, hierarchy: Column) -> Column:
    """Number parsed from the filename for the child's class, else NULL."""
    f = F.lower(F.coalesce(filename, F.lit("")))

    def first(patterns):
        return F.coalesce(*[F.when(f.rlike(p), F.regexp_extract(f, p, 1).try_cast("int"))
                            for p in patterns])
    return (F.when(hierarchy == "SOW", first(SOW_NUMBER_PATTERNS))
            .when(hierarchy == "Amendment", first(AMENDMENT_NUMBER_PATTERNS))
            .when(hierarchy == "Schedule", first(SCHEDULE_NUMBER_PATTERNS)))


def clean_counterparty(df: DataFrame) -> Column:
    """First non-garbage of the name fields, then the folder fields, then
    the filename prefix (>= 3 chars), else 'Unknown'."""
    cands = []
    for f in ("counterparty_name", "party_counterparty", "party_counterparty_name",
              "parent_folder_name", "doc_parent_folder_name", "company_folder"):
        v = col_or_null(df, f)
        cands.append(F.when((F.coalesce(v, F.lit("")) != "") & ~party_garbage(v), F.trim(v)))
    fn = col_or_null(df, "filename")
    stem = F.regexp_replace(fn, r"(?i)\.(pdf|docx?|xlsx?)$", "")
    part = F.trim(F.element_at(F.split(stem, r"(?i)\s*[-_]\s*|\s+(?:Agreement|Contract|NDA|MSA|SOW)\b"), 1))
    cands.append(F.when((F.length(part) >= 3) & ~party_garbage(part), part))
    return F.coalesce(*cands, F.lit("Unknown"))


def family_id(cp: Column, folder: Column, pad: Column, effective: Column,
              as_of: _dt.datetime) -> Column:
    """``Name20-Year``; year from the parent-agreement reference, else the
    effective date, else the as-of year.  ``folder`` is the first non-empty
    folder field ('' when none)."""
    folder = F.when(folder != "", folder).otherwise(F.lit("Unknown"))
    # ``cp`` comes from ``clean_counterparty``: every candidate there already
    # passed the garbage test, so only the empty / 'Unknown' cases remain.
    use = F.coalesce(F.nullif(F.nullif(cp, F.lit("")), F.lit("Unknown")), folder)
    name = F.substring(F.regexp_replace(use, "[^a-zA-Z0-9]", ""), 1, 20)
    name = F.when(name == "", F.lit("Unknown")).otherwise(name)
    pyear = F.regexp_extract(F.coalesce(pad, F.lit("")), r"((19|20)\d{2})", 1)
    year = (F.when(pyear != "", pyear)
            .when(effective.isNotNull(), F.year(effective).cast("string"))
            .otherwise(F.lit(str(as_of.year))))
    return F.concat(name, F.lit("-"), year)


def normalise_name(c: Column) -> Column:
    """J2 name key: lower, keep [a-z0-9] and spaces, drop suffix words, join."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[^a-zA-Z0-9\s]", "")
    words = F.split(F.trim(t), r"\s+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*NAME_SUFFIXES))
    return F.array_join(kept, "")


def classify(contracts: DataFrame, as_of: _dt.datetime, cfg: EngineConfig = DEFAULT,
             materialize: bool = False) -> DataFrame:
    """Phase 1: one narrow stage over the collection.

    With ``materialize`` the regex-heavy projection (hierarchy, counterparty)
    is checkpointed before the columns derived from it, so those derivations
    (and every later join that reads phase 1) never re-run the rules."""
    g = lambda n: col_or_null(contracts, n)
    eff = F.coalesce(*[parse_date_export(g(f)) for f in
                       ("effective_date", "effective_date_extracted", "start_date",
                        "commencement_date", "sow_start_date")])
    ctype = F.coalesce(F.when(g("contract_type") != "", g("contract_type")), F.lit("Unknown"))
    fname = F.coalesce(F.when(g("filename") != "", g("filename")),
                       F.when(g("document_name") != "", g("document_name")), F.col("contract_id"))
    hier = hierarchy_class(ctype, fname)
    cp = clean_counterparty(contracts)
    folder = F.coalesce(*[F.when(g(f) != "", g(f)) for f in
                          ("parent_folder_name", "doc_parent_folder_name", "company_folder")],
                        F.lit(""))
    draft = (F.coalesce(g("is_draft").cast("boolean"), F.lit(False))
             | F.lower(F.coalesce(g("contract_status"), F.lit(""))).contains("draft"))
    h_order = F.create_map(*[x for k, v in HIERARCHY_ORDER.items() for x in (F.lit(k), F.lit(v))])
    out = contracts.select(
        "_pos", "contract_id",
        fname.alias("filename"), ctype.alias("contract_type"), hier.alias("hierarchy"),
        cp.alias("counterparty"), folder.alias("folder"), eff.alias("effective_ts"),
        draft.alias("is_draft"), g("parent_agreement_date").alias("parent_agreement_date"),
    )
    if materialize:
        out = checkpointed(out)
    out = out.withColumn("h_order", F.element_at(h_order, F.col("hierarchy")))
    out = out.withColumn("sort_date", F.coalesce(F.col("effective_ts"),
                                                 F.lit(_dt.datetime(1900, 1, 1)).cast("timestamp")))
    out = out.withColumn("family", family_id(F.col("counterparty"), F.col("folder"),
                                             F.col("parent_agreement_date"), F.col("effective_ts"), as_of))
    out = out.withColumn("type_code", type_code(F.col("contract_type"), F.col("hierarchy")))
    out = out.withColumn("legacy", F.coalesce(F.col("effective_ts") < F.lit(cfg.legacy_threshold),
                                              F.lit(True)))
    out = out.withColumn("parsed_num", child_number(F.col("filename"), F.col("hierarchy")))
    yymm = F.coalesce(F.date_format("effective_ts", "yyMM"), F.lit(as_of.strftime("%y%m")))
    return out.withColumn("yymm", yymm)


def substrings(df: DataFrame, name_col: str, lengths: list[int], *keep: str) -> DataFrame:
    """(s, keep...) for every substring of ``name_col`` that has one of ``lengths``."""
    n = F.length(F.col(name_col))
    spans = df.select(name_col, *keep, F.explode(F.array(*[F.lit(x) for x in lengths]) if lengths
                                                 else F.array().cast("array<int>")).alias("_ln")).where(F.col("_ln") <= n)
    starts = spans.select(name_col, *keep, "_ln", F.explode(F.sequence(F.lit(1), n - F.col("_ln") + 1)).alias("_st"))
    return starts.select(F.substring(F.col(name_col), F.col("_st"), F.col("_ln")).alias("s"), *keep)


_FIELD = 10 ** 18


def parent_order(hierarchy: Column, h_order: Column, sort_date: Column, pos: Column) -> Column:
    """Priority of a parent row as one number (MSA first, then allocation order), so
    that ``min`` runs as a hash aggregate; the position is its last 18 digits."""
    d = "decimal(38,0)"
    rank = (F.when(hierarchy == "MSA", 0).otherwise(1) * 10 + h_order).cast("decimal(2,0)")
    micros = (F.unix_micros(sort_date) + F.lit(10 ** 17)).cast("decimal(18,0)")
    return ((rank * F.lit(_FIELD).cast("decimal(19,0)") + micros).cast("decimal(20,0)")
            * F.lit(_FIELD).cast("decimal(19,0)") + pos.cast("decimal(18,0)")).cast(d)


def order_pos(key: Column) -> Column:
    return (key % F.lit(_FIELD).cast("decimal(19,0)")).cast("bigint")


def _lengths(names: DataFrame) -> list[int]:
    """Distinct lengths of non-empty names (as many rows as the longest name at most)."""
    return sorted(r.n for r in names.select(F.length("name").alias("n")).where("n > 0").distinct().collect())


def parent_search(cls: DataFrame) -> DataFrame:
    """Best parent (_pos of the parent row) for every child row.

    Priority: MSA first (earliest in allocation order), else the first
    NDA/Standalone in allocation order; a parent matches by its counterparty
    or its folder name, if the names are equal or one contains the other.

    No pair of names is ever formed: the best key is reduced per substring of the
    parents' names before children look up their whole name there, and children's
    substrings look up the best key of a whole parent name.  Only substrings as long
    as some name of the other side are made."""
    parents = cls.where(F.col("hierarchy").isin(*PARENT_CLASSES))
    key = parent_order(F.col("hierarchy"), F.col("h_order"), F.col("sort_date"), F.col("_pos"))
    pnames = parents.select(normalise_name(F.col("counterparty")).alias("name"), key.alias("key")) \
        .unionByName(parents.where(F.col("folder") != "")
                     .select(normalise_name(F.col("folder")).alias("name"), key.alias("key")))
    best_by_pname = checkpointed(pnames.groupBy("name").agg(F.min("key").alias("key")))
    children = cls.where(F.col("hierarchy").isin(*CHILD_CLASSES)) \
        .withColumn("cname", normalise_name(F.col("counterparty")))
    cnames = checkpointed(children.select(F.col("cname").alias("name")).distinct())
    in_parent = (substrings(best_by_pname.where("name <> ''"), "name", _lengths(cnames), "key")
                 .groupBy("s").agg(F.min("key").alias("key")))
    up = cnames.join(in_parent, F.col("name") == F.col("s")).select("name", "key")
    own = cnames.where("name <> ''").withColumn("c", F.col("name"))
    down = (substrings(own, "c", _lengths(best_by_pname), "name").distinct()
            .join(best_by_pname.withColumnRenamed("name", "s"), "s").select("name", "key"))
    same = cnames.join(best_by_pname, "name").select("name", "key")
    best = up.unionByName(down).unionByName(same).groupBy("name").agg(F.min("key").alias("key"))
    return (children.join(best.withColumnRenamed("name", "cname"), "cname", "left")
            .select("_pos", order_pos(F.col("key")).alias("parent_pos")))


def allocate_ids(cls: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Registry id per row, plus parent position, notes, child number.

    Returns cls columns + parent_pos, child_num, seq, registry_id (raw),
    id_notes."""
    links = parent_search(cls)
    # the parent links feed three consumers (sequence, running numbers, ids):
    # materialise them once instead of re-running the name search per consumer
    rows = checkpointed(cls.join(links, "_pos", "left"))
    is_child = F.col("hierarchy").isin(*CHILD_CLASSES)
    # one dense sequence over parents and parent-less children
    seq_rows = rows.where(~is_child | F.col("parent_pos").isNull()).select("_pos", "h_order", "sort_date")
    seq = dense_index(seq_rows, ["h_order", "sort_date", "_pos"]).select("_pos", "seq")
    rows = rows.join(seq, "_pos", "left")
    # running numbers for unnumbered children of each (parent, class)
    unnumbered = rows.where(is_child & F.col("parent_pos").isNotNull() & F.col("parsed_num").isNull()) \
        .select("_pos", "parent_pos", "hierarchy", "h_order", "sort_date")
    running = rank_within_groups(unnumbered, ["parent_pos", "hierarchy"], ["h_order", "sort_date", "_pos"],
                                 "run_num").select("_pos", "run_num")
    rows = rows.join(running, "_pos", "left") \
        .withColumn("child_num", F.coalesce(F.col("parsed_num"), F.col("run_num"), F.lit(1)))
    pfx = cfg.id_prefix
    base = F.concat_ws("-", F.lit(pfx), F.col("type_code"), F.col("yymm"),
                       F.format_string("%04d", F.col("seq")))
    leg = F.when(F.col("legacy"), F.lit("-LEG")).otherwise(F.lit(""))
    own_id = (F.when(is_child, F.concat(base, leg))
              .when(F.col("is_draft"), F.concat(base, F.lit("-D01"), leg))
              .otherwise(F.concat(base, leg)))
    rows = rows.withColumn("own_id", F.when(F.col("seq").isNotNull(), own_id))
    parent_ids = rows.where(~is_child).select(F.col("_pos").alias("parent_pos"),
                                              F.col("own_id").alias("parent_id"))
    # rows without a parent get a key of their own, or they would all meet in one task
    own_key = F.coalesce("parent_pos", -1 - F.col("_pos"))
    rows = (rows.withColumn("_link", own_key)
            .join(parent_ids.withColumnRenamed("parent_pos", "_link"), "_link", "left").drop("_link"))
    suffix = (F.when(F.col("hierarchy") == "SOW", "SOW").when(F.col("hierarchy") == "Amendment", "A")
              .otherwise("SCH"))
    num = F.when(F.col("child_num") > 0, F.format_string("%02d", F.col("child_num"))).otherwise("01")
    child_id = F.concat(F.regexp_replace("parent_id", "-LEG", ""), F.lit("-"), suffix, num, leg)
    rid = F.when(is_child & F.col("parent_id").isNotNull(), child_id).otherwise(F.col("own_id"))
    notes = F.when(is_child & F.col("parent_pos").isNull(),
                   F.concat(F.lit("Missing Parent Link - "), F.col("hierarchy"),
                            F.lit(" without governing MSA"))).otherwise(F.lit(""))
    return rows.withColumn("registry_id", rid).withColumn("id_notes", notes) \
        .drop("own_id", "run_num")


def normalise_registry_id(c: Column) -> Column:
    """``--`` -> ``-``, ``_`` -> ``-``, trim dashes, ``-LEG`` moved last."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), "--", "-"), "_", "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    has_leg = t.contains("-LEG")
    core = F.regexp_replace(F.regexp_replace(t, "-LEG", ""), "^-+|-+$", "")
    return F.when(has_leg, F.concat(F.regexp_replace(core, "-+$", ""), F.lit("-LEG"))).otherwise(core)


def duplicate_ids(reg: DataFrame) -> DataFrame:
    """Ids that more than one row got (equal parsed numbers under one parent)."""
    return reg.groupBy("norm_id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1") \
        .select(F.col("norm_id").alias("registry_id"), "n_rows")


def family_parents(ids: DataFrame) -> DataFrame:
    """Per family, the parent-class row with the best (MSA, Standalone,
    NDA; date, NULL last; allocation order) key."""
    prio = F.when(F.col("hierarchy") == "MSA", 0).when(F.col("hierarchy") == "Standalone", 1).otherwise(2)
    far = F.lit(_dt.datetime(9999, 12, 31)).cast("timestamp")
    key = F.struct(prio.alias("p"), F.coalesce("effective_ts", far).alias("d"), F.col("h_order"),
                   F.col("sort_date"), F.col("_pos"))
    return (ids.where(F.col("hierarchy").isin(*PARENT_CLASSES) & (F.col("family") != ""))
            .groupBy("family").agg(F.min_by(F.col("norm_id"), key).alias("family_parent_id")))


def registry(contracts: DataFrame, as_of: _dt.datetime, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """I6-I10 + J5: normalised registry id and parent registry id per contract
    (non-contract files excluded, see ``non_contract_file``)."""
    ensure_checkpoint_dir(contracts.sparkSession)
    # phase 1 is read by several later joins: materialise it once (checkpoint
    # into the shared folder; also cuts the lineage for executor loss)
    cls = classify(contracts.where(~non_contract_file(col_or_null(contracts, "filename"))), as_of, cfg,
                   materialize=True)
    ids = allocate_ids(cls, cfg).withColumn("norm_id", normalise_registry_id(F.col("registry_id")))
    fam = family_parents(ids)
    out = ids.join(fam, "family", "left")
    # The parent that the search found, by its id; the family only where it found none
    linked = F.when(F.col("parent_id").isNotNull(), normalise_registry_id(F.col("parent_id")))
    fam_fallback = F.when(F.col("family_parent_id").isNotNull() & (F.col("family_parent_id") != F.col("norm_id")),
                          F.col("family_parent_id")).otherwise(F.lit(""))
    parent = F.coalesce(linked, fam_fallback)
    return out.withColumn("parent_registry_id", parent)


# Supporting-document filename patterns.
NON_CONTRACT_PATTERNS = (
    r"\bchecklist\b", r"\bsummary\b", r"\btemplate\b", r"\bdraft\s*v?\d*\b", r"\bnotes?\b",
    r"\breview\b", r"\bcomments?\b", r"\bredline\b", r"\btracking\b", r"\bnotification\b",
    r"\bnotice\b", r"end[-\s]*of[-\s]*life", r"\beol\b", r"power\s+of\s+attorney",
    r"\bappendix\b", r"\bappendixes\b", r"\bappendices\b", r"\bconsent\s+letter\b",
)


def non_contract_file(filename: Column) -> Column:
    """Supporting documents (checklists, summaries, ...) by filename."""
    f = F.lower(F.coalesce(filename, F.lit("")))
    return f.rlike("|".join(f"(?:{p})" for p in NON_CONTRACT_PATTERNS))


# ------------------------------------------------------------ governance columns

def lifecycle_stage(status: Column, is_terminated: Column, is_draft: Column, effective: Column,
                    expiration: Column, as_of) -> Column:
    """Terminated -> Draft -> Archive -> Expired -> Review (<= 90 days)
    -> Pending -> Active."""
    s = F.lower(F.coalesce(status, F.lit("")))
    now = as_of_lit(as_of)
    days = floor_days(expiration, now)
    return (F.when(F.coalesce(is_terminated, F.lit(False)) | (s == "terminated"), "Terminated")
            .when(F.coalesce(is_draft, F.lit(False)) | (s == "draft"), "Draft")
            .when(s.isin("archive", "superseded"), "Archive")
            .when(expiration.isNotNull() & (expiration < now), "Expired")
            .when(expiration.isNotNull() & (days <= 90), "Review")
            .when(effective.isNotNull() & (effective > now), "Pending")
            .otherwise("Active"))


def risk_level(raw_effective: Column, raw_type: Column, gdpr: Column, tfc: Column,
               expiration: Column, as_of) -> Column:
    """40/30/20 by days to expiry, +10 unknown effective date (raw value
    'Unknown' or absent, Q34), +10 unknown type, +10 GDPR, +15 no termination
    for convenience; High >= 50, Medium >= 25."""
    days = floor_days(expiration, as_of_lit(as_of))
    score = (F.when(days < 0, 40).when(days < 30, 30).when(days < 90, 20).otherwise(0)
             + F.when(F.coalesce(raw_effective, F.lit("Unknown")) == "Unknown", 10).otherwise(0)
             + F.when(F.coalesce(raw_type, F.lit("Unknown")) == "Unknown", 10).otherwise(0)
             + F.when(F.lower(F.coalesce(gdpr, F.lit("No"))).isin("yes", "true"), 10).otherwise(0)
             + F.when(F.coalesce(tfc, F.lit("Unknown")) == "No", 15).otherwise(0))
    return F.when(score >= 50, "High").when(score >= 25, "Medium").otherwise("Low")


def days_to_expiry(expiration: Column, sow_end: Column, as_of) -> Column:
    """Days until the SOW end date when present, else the expiration."""
    return floor_days(F.coalesce(sow_end, expiration), as_of_lit(as_of))


def audit_flag(effective: Column, as_of) -> Column:
    """E24: 'Yes' when the effective date is at least 730 days ago."""
    d = floor_days(as_of_lit(as_of), effective)
    return F.when(effective.isNotNull() & (d >= 730), "Yes").otherwise("No")


def duration_label(effective: Column, expiration: Column) -> Column:
    """``yyyy-MM-dd - yyyy-MM-dd`` with whichever ends are known."""
    return F.concat_ws(" - ", F.date_format(effective, "yyyy-MM-dd"), F.date_format(expiration, "yyyy-MM-dd"))


def renewal_date(explicit: Column, expiration: Column, auto_renewal_yes: Column) -> Column:
    """Explicit renewal date, else the expiration when auto-renewing."""
    return F.coalesce(explicit, F.when(auto_renewal_yes, expiration))


# Jurisdiction validity lists.
INVALID_JURISDICTIONS = (
    "north america", "south america", "latin america", "americas", "emea", "europe", "middle east", "africa",
    "apac", "asia pacific", "asia", "pacific", "global", "worldwide", "international", "not found", "unknown",
    "n/a", "none", "tbd", "to be determined", "region", "territory",
)
VALID_JURISDICTION_WORDS = (
    "colorado", "california", "new york", "delaware", "texas", "florida", "massachusetts", "washington",
    "illinois", "georgia", "michigan", "ohio", "pennsylvania", "virginia", "north carolina", "arizona",
    "nevada", "oregon", "minnesota", "wisconsin", "tennessee", "england", "wales", "scotland", "ireland",
    "germany", "france", "netherlands", "switzerland", "singapore", "hong kong", "australia", "canada",
    "ontario", "british columbia", "quebec", "japan", "china", "india", "brazil", "mexico", "state of",
    "commonwealth of", "laws of", "courts of",
)
PERPETUAL_WORDS = ("perpetual", "evergreen", "no fixed term")


def jurisdiction_valid(value: Column) -> Column:
    """A legal jurisdiction rather than a region: not in the invalid list,
    and (a known indicator, a 2-letter code, or longer than 4 characters)."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    indicator = F.lit(False)
    for w in VALID_JURISDICTION_WORDS:
        indicator = indicator | v.contains(w)
    return (F.when(F.coalesce(value, F.lit("")) == "", F.lit(False))
            .when(v.isin(*INVALID_JURISDICTIONS), F.lit(False))
            .when(indicator, F.lit(True))
            .when((F.length(v) == 2) & v.rlike("^[a-z]{2}$"), F.lit(True))
            .otherwise(F.length(v) > 4))


def default_notice_days(contract_type: Column) -> Column:
    """E26 default by type: NDA 30, master/MSA 90, reseller/distributor 60, else 30."""
    t = F.lower(F.coalesce(contract_type, F.lit("")))
    return (F.when(t.contains("nda"), 30).when(t.contains("master") | t.contains("msa"), 90)
            .when(t.contains("reseller") | t.contains("distributor"), 60).otherwise(30))


def _days_of(value: Column) -> Column:
    """A stored number as it is, a text like "30 days" in days, else NULL."""
    text = value.cast("string")
    return F.coalesce(F.floor(text.try_cast("double")).cast("int"), notice_days(text))


def notification_days(fields: list[Column], fallbacks: list[Column], contract_type: Column) -> Column:
    """The first stored field that tells days (a number or a notice text), else the first
    fallback, else the type's default."""
    return F.coalesce(*[_days_of(f) for f in fields], *[f.cast("int") for f in fallbacks], default_notice_days(contract_type))


def notification_buffer(fields: list[Column]) -> Column:
    """The buffer in days from the first filled field; 30 where that tells none."""
    first = F.coalesce(*[F.nullif(F.trim(f.cast("string")), F.lit("")) for f in fields])
    return F.coalesce(_days_of(first), F.lit(30))


def perpetual_info(contract_type: Column, texts: list[Column], flags: list[Column], notice: Column) -> Column:
    """struct(perpetual, notice, notice_days): 'Yes' by a keyword in the type or the texts, or
    by a stored flag; the perpetual notice text and its days."""
    flagged = reduce(lambda a, b: a | b, (F.coalesce(yes_no(f, "No") == "Yes", F.lit(False)) for f in flags), F.lit(False))
    yes = F.when((perpetual_flag(contract_type, *texts) == "Yes") | flagged, "Yes").otherwise("No")
    return F.struct(yes.alias("perpetual"), F.coalesce(notice, F.lit("")).alias("perpetual_notice"),
                    notice_days(notice).alias("perpetual_notice_days"))


def perpetual_flag(contract_type: Column, *texts: Column) -> Column:
    """E25: 'Yes' when a perpetual keyword appears in the type or term texts."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(contract_type, F.lit("")), *texts))
    hit = F.lit(False)
    for w in PERPETUAL_WORDS:
        hit = hit | blob.contains(w)
    return F.when(hit, "Yes").otherwise("No")


def folder_context(df: DataFrame, folder_col: str) -> DataFrame:
    """Documents per folder (rows, Q17 fixed), related-documents flag
    and the folder group id.  The count is a partial aggregation joined back
    (one row per folder), not a window over a possibly huge folder."""
    folder = F.coalesce(F.col(folder_col), F.lit(""))
    counts = df.where(folder != "").groupBy(F.col(folder_col).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    # rows without a folder match nothing: spread them instead of joining on '', by what they
    # hold, so a repeated task sends each the same way
    key = F.when(folder != "", folder).otherwise(F.concat(F.lit("\u0000"), F.xxhash64(*df.columns).cast("string")))
    out = df.withColumn("_key", key).join(counts, F.col("_key") == F.col("_f"), "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    gid = F.when(folder != "", F.substring(F.md5(F.lower(folder)), 1, 12)).otherwise(F.lit(""))
    return out.select(*df.columns, n.alias("folder_document_count"), (n > 1).alias("has_related_documents"),
                      gid.alias("folder_group_id"))


def folder_actions(lifecycle: Column, is_draft: Column, folder_name: Column, contract_status: Column,
                   doc_created: Column, as_of) -> Column:
    """struct(archive_flag, archive_reason, review_flag, lifecycle).
    Drafts older than 90 days and terminated folders archive; an archived row
    that is not Terminated/Archive becomes Archive (so Expired never reaches
    the output, Q20)."""
    folder = F.lower(F.coalesce(folder_name, F.lit("")))
    draft = F.coalesce(is_draft, F.lit(False)) | folder.contains("draft")
    terminated = folder.contains("terminated") | (F.lower(F.coalesce(contract_status, F.lit(""))) == "terminated")
    age = floor_days(as_of_lit(as_of), doc_created)
    old_draft = draft & doc_created.isNotNull() & (age > 90)
    archive = lifecycle.isin("Archive", "Terminated", "Expired") | old_draft | terminated
    reason = F.concat_ws("; ", F.when(old_draft, F.lit("Draft folder older than 90 days")),
                         F.when(terminated, F.lit("Agreement folder marked terminated")))
    review = (F.when(draft & doc_created.isNull(), F.lit("Draft folder (age unknown)"))
              .when(draft & ~old_draft, F.concat(F.lit("Draft folder "), age.cast("string"), F.lit(" days old")))
              .otherwise(F.lit("")))
    final = F.when(archive & ~lifecycle.isin("Terminated", "Archive"), F.lit("Archive")).otherwise(lifecycle)
    return F.struct(archive.alias("archive_flag"), reason.alias("archive_reason"), review.alias("review_flag"),
                    final.alias("lifecycle"))


def inherit_terms(reg: DataFrame, meta: DataFrame) -> DataFrame:
    """Export-time inheritance for child documents.

    A child (SOW / Amendment / Schedule with a parent registry id) that lacks
    a valid jurisdiction, termination notice, renewal terms or a notification
    period copies the missing groups from the row whose registry id equals
    its parent id (equi left join; parent ids are unique).  Only non-empty
    values count; the law is copied only when valid (E27).
    ``meta`` carries contract_id and the term columns (absent ones are NULL)."""
    g = lambda n: col_or_null(meta, n)
    m = meta.select("contract_id",
                    F.coalesce(F.when(g("governing_law") != "", g("governing_law")),
                               F.when(g("jurisdiction") != "", g("jurisdiction"))).alias("law"),
                    F.coalesce(*[F.when(g(c) != "", g(c)) for c in
                                 ("termination_notice", "termination_notice_period", "termination_clause")])
                    .alias("termination"),
                    F.coalesce(*[F.when(g(c).cast("string") != "", g(c).cast("string"))
                                 for c in ("renewal_term", "auto_renewal")]).alias("renewal"),
                    F.coalesce(*[F.when(g(c) != "", g(c)) for c in ("notification_period", "notice_period")])
                    .alias("notification"),
                    F.when(g("initial_term") != "", g("initial_term")).alias("initial_term"))
    rows = reg.select("contract_id", "hierarchy", "registry_id", "parent_registry_id").join(m, "contract_id", "left")
    parents = rows.select(F.col("registry_id").alias("parent_registry_id"),
                          *[F.col(c).alias("p_" + c) for c in ("law", "termination", "renewal", "notification",
                                                               "initial_term")])
    # parent rows have no parent id: spread them instead of joining on ''
    link = F.when(F.coalesce("parent_registry_id", F.lit("")) != "", F.col("parent_registry_id")) \
        .otherwise(F.concat(F.lit("\u0000"), F.col("contract_id")))
    j = rows.withColumn("_link", link).join(parents.withColumnRenamed("parent_registry_id", "_link"), "_link", "left")
    is_child = F.col("hierarchy").isin(*CHILD_CLASSES) & (F.coalesce(F.col("parent_registry_id"), F.lit("")) != "")
    has_law = jurisdiction_valid(F.col("law"))
    complete = has_law & F.col("termination").isNotNull() & F.col("renewal").isNotNull() \
        & F.col("notification").isNotNull()
    law_in = F.when(is_child & ~complete & ~has_law & jurisdiction_valid(F.col("p_law")), F.col("p_law"))
    term_in = F.when(is_child & ~complete & F.col("termination").isNull(), F.col("p_termination"))
    ren_in = F.when(is_child & ~complete & F.col("renewal").isNull(), F.col("p_renewal"))
    not_in = F.when(is_child & ~complete & F.col("notification").isNull(), F.col("p_notification"))
    init_in = F.when(is_child & ~complete & F.col("initial_term").isNull(), F.col("p_initial_term"))
    any_in = law_in.isNotNull() | term_in.isNotNull() | ren_in.isNotNull() | not_in.isNotNull() | init_in.isNotNull()
    return j.select(
        "contract_id", "registry_id", "parent_registry_id",
        F.when(any_in, "Yes").otherwise("No").alias("terms_inherited"),
        law_in.alias("inherited_jurisdiction"),
        F.when(term_in.isNotNull(), F.concat(F.lit("[Inherited from MSA] "), term_in)).alias("termination_notice"),
        F.when(init_in.isNotNull(), F.concat(F.lit("[Inherited from MSA] "), init_in)).alias("initial_term"))


def relationship_text(current_type: Column) -> Column:
    """struct(document_hierarchy, parent_contracts, child_contracts,
    related_documents) for the current contract type (exact labels)."""
    sow = current_type == "Statement of Work (SOW)"
    amd = current_type == "Amendment"
    msa = current_type == "Master Service Agreement (MSA)"
    return F.struct(
        F.when(sow, "MSA (Parent) -> SOW (Current)").when(amd, "Original Contract -> Amendment (Current)")
        .when(msa, "MSA (Current) -> SOWs (Children)").otherwise("").alias("document_hierarchy"),
        F.when(sow, "Master Service Agreement (MSA)").when(amd, "Original Contract").otherwise("")
        .alias("parent_contracts"),
        F.when(msa, "Statements of Work (SOWs)").otherwise("").alias("child_contracts"),
        F.when(sow, "Review parent MSA for governing terms")
        .when(amd, "Identify base contract for amendment tracking")
        .when(msa, "Track all SOWs executed under this MSA").otherwise("").alias("related_documents"))


def party_role(contract_type: Column, is_primary: bool) -> Column:
    """Role name of a party by contract type (primary company or
    counterparty)."""
    t = F.lower(F.coalesce(contract_type, F.lit("")))
    if is_primary:
        return (F.when(t.contains("reseller") | t.contains("distributor"), "Vendor")
                .when(t.contains("nda"), "Discloser").otherwise("Client"))
    return (F.when(t.contains("reseller"), "Reseller").when(t.contains("distributor"), "Distributor")
            .when(t.contains("nda"), "Recipient").when(t.contains("procurement") | t.contains("vendor"), "Vendor")
            .when(t.contains("hotel"), "Hotel").when(t.contains("contractor"), "Contractor").otherwise("Party"))


# Full names per type code and the title map per hierarchy.
TYPE_FULL_NAMES = (
    ("MSA", "Master Service Agreement"), ("SVC", "Service Agreement"), ("DST", "Distributor Agreement"),
    ("RSL", "Reseller Agreement"), ("OEM", "OEM Agreement"), ("PUR", "Purchase Agreement"),
    ("VND", "Vendor Agreement"), ("DEV", "Development Agreement"), ("NDA", "Non-Disclosure Agreement"),
    ("SOW", "Statement of Work"), ("AMD", "Amendment"), ("TRM", "Termination Agreement"),
    ("COR", "Correspondence"), ("SCH", "Schedule"),
)
HIERARCHY_TITLES = (
    ("MSA", "Master Service Agreement"), ("NDA", "Non-Disclosure Agreement"), ("SOW", "Statement of Work"),
    ("SCHEDULE", "Schedule"), ("SCH", "Schedule"), ("AMENDMENT", "Amendment"), ("STANDALONE", "Service Agreement"),
)


def clean_title_text(c: Column) -> Column:
    """Drop the file extension and 'final / executed' words, '_' and '-'
    runs to spaces, collapse spaces, trim ' -_/'."""
    t = F.regexp_replace(F.trim(c), r"(?i)\.(pdf|docx?|xlsx?)$", "")
    t = F.regexp_replace(t, r"(?i)\b(fully\s+executed|final|final\s+clean|executed copy)\b", "")
    t = F.regexp_replace(t, r"[_\-]+", " ")
    t = F.regexp_replace(t, r"\s{2,}", " ")
    return F.regexp_replace(t, r"^[ \-_/]+|[ \-_/]+$", "")


def contract_title(title_candidates: list[Column], hierarchy: Column, code: Column, counterparty: Column,
                   primary_name: str) -> Column:
    """The first title candidate that is >= 6 chars after cleaning, else
    '<full type name> - <counterparty or primary company>'."""
    cleaned = [F.when(F.length(clean_title_text(c)) >= 6, clean_title_text(c)) for c in title_candidates]
    full = F.lit(None).cast("string")
    for k, v in reversed(TYPE_FULL_NAMES):
        full = F.when(code == k, F.lit(v)).otherwise(full)
    full = F.coalesce(full, F.when(hierarchy != "", hierarchy), F.lit("Contract"))
    frag = F.when(F.coalesce(counterparty, F.lit("")).isin("", "Unknown"), F.lit(primary_name)).otherwise(counterparty)
    return F.coalesce(*cleaned, F.concat(full, F.lit(" - "), frag))


def simplify_title(title: Column, hierarchy: Column) -> Column:
    """Hierarchy title when the hierarchy is known, else the part before ' - '."""
    t = F.trim(F.coalesce(title, F.lit("")))
    head = F.when(t.contains(" - "), F.trim(F.substring_index(t, " - ", 1))).otherwise(t)
    key = F.upper(F.trim(F.coalesce(hierarchy, F.lit(""))))
    mapped = F.lit(None).cast("string")
    for k, v in reversed(HIERARCHY_TITLES):
        mapped = F.when(key == k, F.lit(v)).otherwise(mapped)
    return F.coalesce(mapped, head)
