"""What a document's path tells: status, role, lineage, company and agreement folder.

Paths use ``/``.  All of it is a projection over the row; the status of a path is an ordered
fold over its parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.dates import numeric_token_date
from ..functions.spans import collapse, let, strip

# Path words of a status, by falling weight.
STATUS_WORDS = (("Terminated", "terminat"), ("Draft", "draft"), ("Archive", "archive"))
# Role words, in match order ("Contract Summary" stands behind "summary", so it never wins).
ROLE_WORDS = (
    ("Statement of Work", ("statement of work", "sow")),
    ("Amendment/Addendum", ("amendment", "addendum", "appendix", "schedule", "exhibit")),
    ("Termination Letter", ("termination letter", "notice of termination")),
    ("Summary/Checklist", ("summary", "checklist", "processing checklist")),
    ("Contract Summary", ("contract summary",)),
    ("Master Agreement", ("master services agreement", "master agreement", "msa")),
)
# Documents that a role expects beside it.
EXPECTED = (("Statement of Work", "Master Services Agreement (MSA)"),
            ("Amendment/Addendum", "Underlying Agreement referenced in amendment"),
            ("Termination Letter", "Agreement referenced in termination notice"))
DRAFT_HEAD = 5000              # the rule looks for "draft" at the head of a text only


def _any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def _part(parts: Column, back: int) -> Column:
    """The part ``back`` places before the file name, '' where there is none."""
    return F.when(F.size(parts) > back, F.element_at(parts, -1 - back)).otherwise("")


def document_context(path: Column, text: Column) -> Column:
    """Struct of everything that path and text tell about a document."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda t: let(_role(path, t), lambda role: _context(path, t, role)))


def _role(path: Column, t: Column) -> Column:
    """The first role that file name or text name; a master agreement by its file's name is none of work."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    role = F.coalesce(*[F.when(_any(name, words) | _any(t, words), F.lit(r)) for r, words in ROLE_WORDS])
    master = (name.contains("msa") | name.contains("master service agreement")) & ~name.contains("sow")
    return F.when((role == "Statement of Work") & master, "Master Agreement").otherwise(role)


def _context(path: Column, t: Column, role: Column) -> Column:
    parts = F.split(path, "/")
    low_parts, name = F.transform(parts, F.lower), F.lower(F.element_at(parts, -1))
    # the fold carries which words a part has had so far
    seen = F.aggregate(low_parts, F.array(*[F.lit(False)] * len(STATUS_WORDS)), lambda had, p: F.array(
        *[F.get(had, F.lit(i)) | p.contains(w) for i, (_, w) in enumerate(STATUS_WORDS)]))
    ended = t.contains("notice of termination") | t.contains("terminated effective")
    has = [F.get(seen, F.lit(0)) | ended, F.get(seen, F.lit(1)) | F.left(t, F.lit(DRAFT_HEAD)).contains("draft"), F.get(seen, F.lit(2))]
    labels = F.array_sort(F.array_compact(F.array(*[F.when(h, F.lit(s)) for h, (s, _) in zip(has, STATUS_WORDS)])))
    labels = F.when(F.size(labels) == 0, F.array(F.lit("Active"))).otherwise(labels)
    status = F.coalesce(*[F.when(h, F.lit(s)) for h, (s, _) in zip(has, STATUS_WORDS)], F.lit("Active"))

    sow_no, body_no = F.regexp_extract(name, r"sow[\s_\-]*(\d+)", 1), F.regexp_extract(t, r"statement of work\s*(?:number|no\.?|#)\s*(\d+)", 1)
    amendment_no = F.regexp_extract(name, r"(?:amendment|addendum)\s*(?:number|no\.?|#)?\s*(\d+)", 1)
    label = F.coalesce(F.when(sow_no != "", F.concat(F.lit("SOW #"), sow_no)),
                       F.when((role == "Statement of Work") & (body_no != ""), F.concat(F.lit("SOW #"), body_no)),
                       F.when((role == "Amendment/Addendum") & (amendment_no != ""), F.concat(F.lit("Amendment #"), amendment_no)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    token = numeric_token_date(F.regexp_extract(stem, r"(\d{6,8})", 1))
    lineage = F.filter(F.array(_part(parts, 3), _part(parts, 2), _part(parts, 1)), lambda p: p != "")
    parent = F.array_join(F.slice(lineage, F.greatest(F.size(lineage) - 1, F.lit(1)), F.lit(2)), " / ")
    child = role.isin("Statement of Work", "Amendment/Addendum")
    hints = F.array_compact(F.array(
        F.when(child, "References underlying master agreement"),
        F.when(t.contains("master services agreement") | t.contains("master agreement"), "Mentions master services agreement in body"),
        F.when(name.contains("schedule") & t.contains("statement of work"), "Schedule references SOW terms"),
        F.when(token.isNotNull(), F.concat(F.lit("Sequence date token: "), token.cast("string"))),
        F.when((parent != "") & (child | (role == "Termination Letter")), F.concat(F.lit("Likely tied to "), parent))))
    return F.struct(
        _part(parts, 1).alias("folder_name"), _part(parts, 2).alias("parent_folder_name"),
        _part(parts, 3).alias("grandparent_folder_name"), F.size(parts).alias("folder_depth"),
        F.array_join(labels, ", ").alias("document_status_label"), status.alias("contract_status"),
        (status == "Draft").alias("is_draft"), (status == "Terminated").alias("is_terminated"), (status == "Archive").alias("is_archive"),
        role.alias("document_role"), F.coalesce(*[F.when(role == r, F.lit(d)) for r, d in EXPECTED], F.lit("")).alias("expected_related_documents"),
        F.nullif(F.array_join(F.array_distinct(hints), "; "), F.lit("")).alias("related_contract_hint"),
        label.alias("document_sequence_label"), parent.alias("document_parent_reference"))


def folders(path: Column) -> Column:
    """struct(company, agreement) folder by the path's depth, and the company's clean name
    (without archive prefix and status words; NULL when two characters or fewer are left)."""
    parts = F.split(path, "/")
    company = F.when(F.size(parts) >= 3, F.element_at(parts, -3)).when(F.size(parts) == 2, F.element_at(parts, -2))
    agreement = F.when(F.size(parts) >= 3, F.element_at(parts, -2))
    bare = F.when(F.lower(company).startswith("archive"), strip(F.regexp_replace(company, r"(?i)^archive\s*\d{4}\s*", ""))).otherwise(company)
    bare = strip(F.regexp_replace(bare, r"(?i)\b(terminated|draft|superseded)\b", ""))
    bare = strip(collapse(bare), r" \-_,")
    return F.struct(company.alias("company"), agreement.alias("agreement"), F.when(F.char_length(bare) > 2, bare).alias("company_clean"))


def folder_status(agreement: Column, status: Column, termination_date: Column) -> Column:
    """struct(contract_status, termination_date) after the agreement folder's say."""
    low = F.lower(F.coalesce(agreement, F.lit("")))
    when = F.regexp_extract(low, r"terminated\s+([a-z]{3}\s+\d{1,2}\s+\d{4})", 1)
    found = F.when(low.contains("terminated") & (when != "") & (termination_date == "Unknown"), when)
    return F.struct(F.when(low.contains("terminated"), "Terminated").when(low.contains("superseded"), "Archive")
                    .when(low.contains("draft"), "Draft").otherwise(status).alias("contract_status"),
                    F.coalesce(found, termination_date).alias("termination_date"))


def garbage_name(name: Column) -> Column:
    """A name that is missing, over 150 characters, less than half letters, or scanning noise."""
    n = F.char_length(name)
    letters = F.char_length(F.regexp_replace(name, r"[^\p{L}]", ""))
    bad = name.rlike(r"#{2,}|`+|\\[A-Za-z]|<[A-Z]\\") | (letters / n < 0.5) | name.rlike(r"\\[A-Za-z0-9_-]+\\") | (n > 150)
    return F.when(F.coalesce(name, F.lit("")) == "", True).otherwise(bad)


def assign_sides(primary: Column, counterparty: Column, company: Column, company_clean: Column,
                 cfg: EngineConfig = DEFAULT) -> Column:
    """struct(primary_party_name, counterparty_name, ours): which name is ours and who the
    other side is; the company folder overrules names that read badly."""
    word = cfg.primary_company_names[0].lower()
    first, second = F.when(~garbage_name(primary), primary), F.when(~garbage_name(counterparty), counterparty)
    holds = lambda c: F.coalesce(F.lower(c).contains(word), F.lit(False))
    assumed = ~holds(first) & ~holds(second) & ~holds(company)
    a = F.when(assumed, F.lit(cfg.primary_company_display)).otherwise(first)
    b = F.when(assumed, company).otherwise(second)
    is_a = holds(first) | assumed
    is_b = F.when(assumed, holds(company)).otherwise(holds(second))
    ours, other = F.when(is_a, a).otherwise(b), F.when(is_a, b).otherwise(a)
    low = F.lower(company)
    better = ((F.char_length(other) > 80) | other.rlike(r"\d{4}") | ~low.contains(word)) & ~low.startswith("archive") & (F.char_length(company) > 2)
    other = F.coalesce(F.when((F.coalesce(other, F.lit("")) != "") & (F.coalesce(company, F.lit("")) != "") & better, company),
                       F.nullif(other, F.lit("")), company)
    abroad = F.lower(ours).contains("europe") | F.lower(ours).contains("aps")
    name = F.when(abroad, F.lit(f"{cfg.primary_company_display} Europe ApS")).otherwise(F.lit(cfg.primary_company_display))
    return (F.when(is_a, F.struct(name.alias("primary_party_name"), F.coalesce(F.nullif(other, F.lit("")), second).alias("counterparty_name"),
                                  F.lit("primary").alias("ours")))
            .when(is_b, F.struct(F.coalesce(F.nullif(company, F.lit("")), other).alias("primary_party_name"), name.alias("counterparty_name"),
                                 F.lit("counterparty").alias("ours")))
            .otherwise(F.struct(F.coalesce(company_clean, first).alias("primary_party_name"), second.alias("counterparty_name"),
                                F.lit("neither").alias("ours"))))


def table_summary(tables: Column) -> Column:
    """struct(summary, previews) of array<array<array<string>>> (tables of rows of cells): how
    many, and the first two rows of each of the first three, as JSON text."""
    n = F.coalesce(F.size(tables), F.lit(0))
    previews = F.transform(F.slice(tables, F.lit(1), F.lit(3)), lambda t: F.to_json(F.slice(t, F.lit(1), F.lit(2))))
    return F.struct(F.when(n > 0, F.concat(n.cast("string"), F.lit(" tables found"))).alias("summary"),
                    F.when(n > 0, previews).alias("previews"))
