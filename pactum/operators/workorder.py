"""Durations, work-order dates, parent-agreement references and department facts
(C12c, C13k, C13l, C32) as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import normalise_date_text
from ..functions.spans import let
from .clauses import _guard, any_match, first_capture, found_sections, normalise_ws

# Duration and date patterns, in search order.
DURATION_WORDS = (r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|eighteen|twenty|twenty-?four"
                  r"|thirty|thirty-?six|forty-?five|sixty|ninety|one\s+hundred\s+(?:twenty|eighty))\s*\(\d+\)")
DURATION_UNITS = r"(?:days?|months?|years?)"
DURATIONS = (rf"({DURATION_WORDS}\s*{DURATION_UNITS})", rf"(\d{{1,3}}\s*{DURATION_UNITS})")
# The written-out form from its bracket, a rare character: what stands before it is read backwards,
# longer words first, as the leftmost match takes them.
BRACKET = rf"(?i)\(\d+\)\s*(?={DURATION_UNITS})"
WORD_BACKWARDS = (r"(?i)^\s*(?:(?:ytnewt|ythgie)\s+derdnuh\s+eno|ruof-?ytnewt|xis-?ytriht|evif-?ytrof|eno|owt|eerht|ruof|evif"
                  r"|xis|neves|thgie|enin|net|nevele|evlewt|neetfif|neethgie|ytnewt|ytriht|ytxis|ytenin)")
DATE = r"(?:\d{1,2}\s+[A-Za-z]+,?\s+\d{4}|[A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"
# No optional words lead a pattern: only its dates are read, and they are the same without them.
START_AND_END = rf"start\s+date\s+(?:shall\s+be|is)\s+({DATE})\s+and\s+(?:shall\s+)?end\s+({DATE})"
STARTS = (
    rf"start\s+date\s+(?:shall\s+be|is|:)\s*({DATE})",
    rf"commence(?:ment)?\s+(?:date\s+)?(?:shall\s+be|is|on|:)\s*({DATE})",
    rf"services?\s+(?:shall\s+)?(?:commence|begin)\s+(?:on\s+)?({DATE})",
)
ENDS = (
    rf"end\s+date\s+(?:shall\s+be|is|:)\s*({DATE})",
    rf"end\s+(?:on\s+)?({DATE})",
    rf"completion\s+date\s+(?:shall\s+be|is|of|:)\s*({DATE})",
    rf"services?\s+(?:shall\s+)?(?:end|terminate|conclude)\s+(?:on\s+)?({DATE})",
)
COMPLETION = (
    r"(?:shall|will)\s+terminate\s+upon\s+completion",
    r"terminat(?:e|es)\s+upon\s+(?:the\s+)?completion\s+of\s+(?:the\s+)?services",
    r"until\s+(?:the\s+)?completion\s+of\s+(?:the\s+)?(?:project|services|work)",
)
PARENT_REFS = (
    rf"(?:Master\s+)?(?:Services?\s+)?Agreement.*?(?:dated|effective)\s+(?:as\s+of\s+)?({DATE})",
    rf"pursuant\s+to\s+(?:the\s+)?(?:Master\s+)?(?:Services?\s+)?Agreement.*?dated\s+({DATE})",
    rf"under\s+(?:the\s+)?(?:MSA|Master\s+(?:Services?\s+)?Agreement).*?dated\s+({DATE})",
    rf"Statement\s+of\s+Work.*?(?:appended|attached|subject).*?(?:dated|effective)\s+(?:as\s+of\s+)?({DATE})",
)
# What every match holds: digits found by a scan that starts at a rare character, and words of
# the lower-cased text (white space collapsed for the work-order dates).
DURATION_GUARDS = (r"\(\d+\)\s*[DdMmYy]", r"\d\s*[DdMmYy]")
DATE_GUARD = r"[\s/]\d{4}"
DATED_EVENT = r"(?=[bcdet])(?:date |commence|begin|end |terminate |conclude )[a-z: ]*+\d"
START_GUARDS = (("start date ",), ("commence",), (("service", "commence"), ("service", "begin")))
END_GUARDS = (("end date ",), ("end ",), ("completion date ",), (("service", "end"), ("service", "terminate"), ("service", "conclude")))
PARENT_GUARD = r"(?:dated|effective)\s+(?:as\s+of\s+)?(?:\d|[a-z]+\s+\d)"
PARENT_WORDS = tuple((w, d) for w in ("agreement", "msa", "master", "statement") for d in ("dated", "effective"))
PARENT_GUARDS = (("agreement",), (("pursuant", "agreement", "dated"),), (("under", "msa", "dated"), ("under", "master", "dated")),
                 (("statement", "work", "subject"), ("statement", "work", "appended"), ("statement", "work", "attached")))
DEPARTMENTS = ("Legal", "Sales", "Procurement")


def _date(found: Column) -> Column:
    return F.when(found.isNotNull(), normalise_date_text(found))


def duration(text: Column) -> Column:
    """The first ``word (n) unit``, else the first ``n unit``, or NULL."""
    def written(s: Column) -> Column:
        none = F.lit("")
        all_ = F.transform(s["m"], lambda m, i: F.concat_ws("", F.reverse(F.nullif(F.regexp_extract(
            F.reverse(F.get(s["p"], i)), WORD_BACKWARDS, 0), none)), m, F.regexp_extract(F.get(s["p"], i + 1), "(?i)^" + DURATION_UNITS, 0)))
        return F.get(F.filter(all_, lambda d: ~d.startswith("(")), F.lit(0))

    first = let(F.struct(F.split(text, BRACKET, -1).alias("p"), F.regexp_extract_all(text, F.lit(BRACKET), F.lit(0)).alias("m")), written)
    return F.trim(F.coalesce(F.when(text.rlike(DURATION_GUARDS[0]), first),
                             F.when(text.rlike(DURATION_GUARDS[1]), first_capture(text, DURATIONS[1:]))))


def work_order_dates(text: Column) -> Column:
    """C13k: struct(sow_start_date, sow_end_date, sow_completion_based).  One phrase
    that gives both dates beats the separate start and end phrases."""
    def of(t: Column, low: Column, dated: Column) -> Column:
        both = F.when(dated & low.contains("start date ") & low.contains("end "),
                      F.nullif(F.regexp_extract(t, "(?i)" + START_AND_END, 0), F.lit("")))
        # the two dates of the phrase are read off the phrase
        date = lambda b, g, alone, guards: let(F.trim(
            F.when(b.isNotNull(), F.regexp_extract(b, "(?i)" + START_AND_END, g))
            .when(dated, first_capture(t, alone, guards=guards, low=low))), _date)
        return let(both, lambda b: F.struct(
            date(b, 1, STARTS, START_GUARDS).alias("sow_start_date"), date(b, 2, ENDS, END_GUARDS).alias("sow_end_date"),
            (_guard(low, (("terminat", "completion"), ("until", "completion"))) & any_match(t, COMPLETION)).alias("sow_completion_based")))

    def read(t: Column) -> Column:
        return let(F.lower(t), lambda low: let(t.rlike(DATE_GUARD) & low.rlike(DATED_EVENT), lambda dated: of(t, low, dated)))

    # without a year and without the word there is nothing to find: such texts are not rewritten
    raw, null = F.coalesce(text, F.lit("")), F.lit(None).cast("string")
    return F.when(raw.rlike(DATE_GUARD) | raw.rlike("(?i)completion"), let(normalise_ws(text), read)).otherwise(F.struct(
        null.alias("sow_start_date"), null.alias("sow_end_date"), F.lit(False).alias("sow_completion_based")))


def parent_reference(text: Column) -> Column:
    """C13l: struct(parent_agreement_date, parent_agreement_type) of the first pattern
    that matches; the type is read off the matched phrase."""
    t = F.coalesce(text, F.lit(""))

    def of(found: Column) -> Column:
        phrase = F.lower(found)
        kind = (F.when(phrase.contains("master") | phrase.contains("msa"), "MSA")
                .when(phrase.contains("service"), "Services Agreement").when(phrase.isNotNull(), "Agreement"))
        # the patterns look at nothing around a match, so the phrase alone gives the same date
        return F.struct(let(F.trim(first_capture(found, PARENT_REFS)), _date).alias("parent_agreement_date"),
                        kind.alias("parent_agreement_type"))

    phrases = tuple(f"({p})" for p in PARENT_REFS)
    return let(let(F.lower(t), lambda low: F.when(
        _guard(low, PARENT_WORDS) & low.rlike(PARENT_GUARD), first_capture(t, phrases, guards=PARENT_GUARDS, low=low))), of)


def department_facts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """For each department what its summary states of a contract: the sections
    found (Legal), whether payment and termination terms were found (Sales), the
    number of sections (Procurement).  The wording around the facts is a display matter."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = F.transform(found_sections(t), lambda s: s["section"])
    mark = lambda s: F.when(F.array_contains("found", s), "found").otherwise("not found")
    fact = (F.when(F.col("department") == "Legal", F.array_join(F.transform("found", lambda s: F.upper(s)), ", "))
            .when(F.col("department") == "Sales", F.concat(F.lit("payment "), mark("payment_terms"),
                                                           F.lit(", termination "), mark("term_and_termination")))
            .otherwise(F.concat(F.size("found").cast("string"), F.lit(" sections"))))
    return (df.select(id_col, found.alias("found"))
            .withColumn("department", F.explode(F.array(*(F.lit(d) for d in DEPARTMENTS))))
            .select(id_col, "department", fact.alias("facts")))
