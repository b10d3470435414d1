"""Clause and term extraction over a text column (C2, C4, C13, C15, C16, C18,
C25-C28, C30, C31).

Every extractor is a column expression (``rlike`` / ``regexp_extract`` /
``regexp_extract_all``) evaluated over the *whole* text of each row in one
narrow stage.  "First pattern that matches" becomes a ``coalesce`` of
``when(rlike(p), regexp_extract(p))`` in pattern order.  Context windows
("50 chars before, 300 after the first match") are captured inside the pattern
itself, so no per-row Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import collapse, let

# Duration vocabulary.
DURATION_WORD_NUM = (r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|"
                     r"fifteen|eighteen|twenty|twenty-?four|thirty|thirty-?six|forty-?five|"
                     r"sixty|ninety|one\s+hundred\s+(?:twenty|eighty))\s*\(\d+\)")
# The same matches, the words by their first letters, so that one character tells most places.  A
# word is followed by its digits in brackets, so at most one word fits a place.
WORD_NUM_BY_LETTER = (r"(?:(?=[otfsen])(?:o(?:ne(?:\s+hundred\s+(?:twenty|eighty))?)|t(?:wo|hree|en|welve|wenty(?:-?four)?|hirty(?:-?six)?)|"
                      r"f(?:our|ive|ifteen|orty-?five)|s(?:ix|even|ixty)|e(?:ight|leven|ighteen)|n(?:ine|inety)))\s*\(\d+\)")
DURATION_NUM_ONLY = r"\d{1,3}"
DURATION_PERIOD = r"(?:days?|months?|years?)"
DURATION_FULL = rf"(?:(?:{DURATION_WORD_NUM}|{DURATION_NUM_ONLY})\s*{DURATION_PERIOD})"
NOTICE_DURATION = rf"(?:(?:{DURATION_WORD_NUM}|{DURATION_NUM_ONLY})\s*(?:days?|months?))"

# Renewal-term fallbacks.
RENEWAL_TERM_PATTERNS = (
    rf"(?:automatically\s+)?renew(?:s|ed)?\s+for\s+(?:additional\s+|successive\s+)?({DURATION_FULL})\s+(?:terms?|periods?)",
    rf"renew(?:s|ed)?\s+for\s+(?:successive|additional)\s+({DURATION_FULL})\s+(?:terms?|periods?)",
    rf"(?:each\s+)?renewal\s+term\s+(?:shall\s+be|of)\s+({DURATION_FULL})",
    rf"renew\s+for\s+an?\s+additional\s+({DURATION_FULL})\s+term",
)
# Renewal notice.
RENEWAL_NOTICE_PATTERNS = (
    rf"({NOTICE_DURATION})['’]?\s+(?:prior\s+)?(?:written\s+)?notice\s+(?:of\s+)?(?:non[- ]?renewal|intent\s+not\s+to\s+renew)",
    rf"notice\s+of\s+non[- ]?renewal[^.]*?({NOTICE_DURATION})",
    rf"(?:non[- ]?renewal|not\s+to\s+renew)[^.]*?({NOTICE_DURATION})\s+(?:prior\s+)?(?:written\s+)?notice",
)
# Termination notice.
TERMINATION_NOTICE_PATTERNS = (
    rf"terminat(?:e|ion)[^.]*?(?:without\s+cause\s+)?(?:with|upon|by\s+giving)\s+({NOTICE_DURATION})['s]?\s+(?:prior\s+)?(?:written\s+)?notice",
    rf"({NOTICE_DURATION})['s]?\s+(?:prior\s+)?(?:written\s+)?notice\s+(?:of\s+)?terminat(?:e|ion)",
    rf"upon\s+({NOTICE_DURATION})['s]?\s+(?:prior\s+)?(?:written\s+)?notice",
    rf"(?:by\s+)?giving\s+(?:at\s+least\s+)?({NOTICE_DURATION})['s]?\s+(?:prior\s+)?(?:written\s+)?notice",
    rf"with\s+({DURATION_NUM_ONLY}\s*\(\w+\)\s*(?:days?|months?))['s]?\s+notice",
    rf"(?:terminat(?:e|ion)\s+)?(?:shall\s+be\s+)?effective\s+({NOTICE_DURATION})\s+(?:from|after)\s+(?:receipt|notice)",
    rf"at\s+least\s+({NOTICE_DURATION})['s]?\s+(?:prior\s+)?(?:written\s+)?notice",
)
# Perpetual / evergreen detection (C13d).
PERPETUAL_PATTERNS = (
    r"(?:shall\s+)?continue\s+(?:in\s+(?:full\s+)?(?:force|effect)\s+)?until\s+terminat(?:e|ed|ion)",
    r"continue\s+indefinitely",
    r"perpetual\s+(?:license|agreement|term)",
    r"remain\s+in\s+(?:full\s+)?(?:force\s+and\s+)?effect\s+until\s+terminat",
    r"no\s+fixed\s+(?:term|expiration)",
    r"(?:shall\s+|will\s+)?(?:be\s+|remain\s+)?(?:effective\s+|valid\s+|in\s+force\s+)?until\s+(?:either\s+party\s+)?terminat(?:e|ed|es|ion)",
    r"until\s+(?:such\s+time\s+as\s+)?(?:either\s+)?party\s+(?:gives\s+notice|terminates)",
    r"effective\s+until\s+terminat",
    r"in\s+force\s+until\s+terminat",
    r"(?:agreement|contract)\s+may\s+be\s+terminated\s+upon\s+.*?notice\s+by\s+either\s+party",
    r"(?:may|can)\s+be\s+terminated\s+(?:at\s+any\s+time\s+)?(?:upon|with|by\s+giving)\s+.*?(?:days?|months?)\s+.*?notice",
    r"(?:this\s+)?agreement\s+(?:shall\s+)?(?:continue|remain)\s+(?:in\s+effect\s+)?(?:unless|until)\s+(?:and\s+until\s+)?terminat",
    r"evergreen\s+(?:agreement|contract|term)",
)
# Auto-renewal detection (C13e).
AUTO_RENEW_PATTERNS = (
    r"(?:will\s+|shall\s+)?automatically\s+renew",
    r"auto[- ]?renew(?:s|al)?",
    r"renew(?:s|ed)?\s+automatically",
    r"successive\s+(?:renewal\s+)?(?:terms?|periods?)",
)
GOVERNING_LAW = (r"govern(?:ed|ing)\s+(?:by|under)\s+(?:the\s+)?laws?\s+of\s+(?:the\s+)?(?:State\s+of\s+)?"
                 r"([A-Z][A-Za-z\s]+?)(?:\s+without|\s+excluding|\.|,|;|\s+and)")
TFC_CLAUSE = (r"terminat(?:e|ing)\s+this\s+(?:Agreement|Contract)\s+(?:for\s+(?:any\s+reason|no\s+reason|"
              r"convenience)|without\s+cause)[^.]{0,200}")
LATE_CHARGE = r"late\s+(?:charge|fee|payment)[^.]{0,100}"
PURPOSE = (r"Purpose[)\].]\s+(?:In order to facilitate|To facilitate|For the purpose of)?.*?"
           r"relat(?:ing|es?)\s+to\s+([^(]{10,200})\s*\((?:the\s+)?\"Purpose\"\)")
NOTICE_AFTER = rf"({NOTICE_DURATION})['s]?\s+(?:prior\s+)?(?:written\s+)?notice"
RENEWAL_CONTEXT_DURATION = rf"(?:additional\s+|successive\s+)?({DURATION_FULL})\s*(?:terms?|periods?)?"

# Enterprise contract types (C2), in match order.
ENTERPRISE_TYPES = ("Master Service Agreement (MSA)", "Non-Disclosure Agreement (NDA)", "OEM Agreement",
                    "Distributor Agreement", "Statement of Work (SOW)", "License Agreement", "Amendment",
                    "Work Order")
# Section finder (C16), in output order.
SECTION_PATTERNS = (
    ("preamble", r"(THIS AGREEMENT.{0,100}WHEREAS)"),
    ("term_and_termination", r"(TERM AND TERMINATION|Term of Agreement)"),
    ("payment_terms", r"(PAYMENT|Compensation|Fees)"),
    ("confidentiality", r"(CONFIDENTIALITY|Non-Disclosure)"),
    ("signatures", r"(IN WITNESS WHEREOF|EXECUTED|Signature:)"),
)
SECTION_GUARDS = ((("this agreement", "whereas"),), ("term and termination", "term of agreement"),
                  ("payment", "compensation", "fees"), ("confidentiality", "non-disclosure"),
                  ("in witness whereof", "executed", "signature:"))
CONTRACT_REF = r"(?:MSA|SOW|NDA|Agreement)\s*[#-]?\s*(\d{4}-\d{3,4}|\d+)"
DEFINED_MARKER = r"\((?:the\s+)?\"([^\"]+)\"\)"


def quick(p: str) -> str:
    """``p`` with its written-out numbers read by their first letters."""
    return p.replace(DURATION_WORD_NUM, WORD_NUM_BY_LETTER)


def _i(p: str) -> str:
    return "(?i)" + quick(p)


# Necessary (lower-case) words per pattern: a cheap ``contains`` on the
# lower-cased text decides whether the case-insensitive regex can match at
# all, so most documents skip most scans.  Same results, far less work.  Of a
# guard's entries one must hold; an entry of several words needs all of them.
# The term and notice guards expect the text's white space collapsed.
RENEWAL_TERM_GUARDS = (("renew for", "renews for", "renewed for"), ("renew for", "renews for", "renewed for"),
                       ("renewal term ",), ("renew for a",))
RENEWAL_NOTICE_GUARDS = ((("notice", "renew"),), (("notice of non", "renew"),), (("notice", "renew"),))
TERMINATION_NOTICE_GUARDS = ((("terminat", " notice"),), ("notice terminat", "notice of terminat"), (("upon ", " notice"),),
                             (("giving ", " notice"),), (("with ", " notice", "("),),
                             (("effective ", " receipt"), ("effective ", " notice")), (("at least ", " notice"),))
PERPETUAL_GUARDS = ((("continue ", "until terminat"),), ("continue indefinitely",), ("perpetual ",), (("remain in ", "until terminat"),),
                    ("no fixed ",), ("until terminat", "until either party terminat"),
                    (("until ", "party gives notice"), ("until ", "party terminates")), ("effective until terminat",),
                    ("in force until terminat",), (("may be terminated upon ", "notice by either party"),), (("be terminated ", "notice"),),
                    (("agreement ", "terminat", "continue"), ("agreement ", "terminat", "remain")), ("evergreen ",))
# Of these each of the patterns needs one.
TERMINATION_NOTICE_ANY = ("notice", "receipt")
PERPETUAL_ANY = ("terminat", "indefinitely", "perpetual ", "no fixed ", "party gives notice", "evergreen ")
AUTO_RENEW_ANY = ("renew", "successive ")
AUTO_RENEW_GUARDS = (("automatically renew",), ("autorenew", "auto-renew", "auto renew"),
                     ("renew automatically", "renews automatically", "renewed automatically"),
                     ("successive term", "successive period", "successive renewal"))


def _guard(low: Column | None, words) -> Column | None:
    if low is None or not words:
        return None
    g = F.lit(False)
    for w in words:
        every = F.lit(True)
        for x in (w,) if isinstance(w, str) else w:
            every = every & low.contains(x)
        g = g | every
    return g


def first_capture(text: Column, patterns, flags: str = "(?i)", group: int = 1,
                  guards=None, low: Column | None = None) -> Column:
    """Group ``group`` of the first pattern (in order) that matches.  The
    patterns' groups never match empty, so '' means "no match" and each
    pattern is scanned once (and only when its guard words occur)."""
    outs = []
    for i, p in enumerate(patterns):
        e = F.nullif(F.regexp_extract(text, flags + quick(p), group), F.lit(""))
        g = _guard(low, guards[i]) if guards is not None else None
        outs.append(e if g is None else F.when(g, e))
    return F.coalesce(*outs)


def first_match_window(text: Column, patterns, before: int, after: int,
                       flags: str = "(?i)", guards=None, low: Column | None = None) -> Column:
    """``text[start-before : end+after]`` around the first match of the first
    matching pattern, or NULL.  The match is located with ``locate`` on the
    matched string (the first occurrence of that string is where the leftmost
    match starts), so the scan stays linear."""
    outs = []
    for i, p in enumerate(patterns):
        m = F.nullif(F.regexp_extract(text, flags + "(" + p + ")", 1), F.lit(""))
        g = _guard(low, guards[i]) if guards is not None else None
        m = m if g is None else F.when(g, m)
        pos = F.position(m, text)  # 1-based
        start = F.greatest(pos - before, F.lit(1))
        outs.append(F.when(m.isNotNull(), F.substring(text, start, pos - start + F.length(m) + after)))
    return F.coalesce(*outs)


def any_match(text: Column, patterns, flags: str = "(?i)") -> Column:
    return text.rlike(flags + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def normalise_ws(text: Column) -> Column:
    return collapse(F.coalesce(text, F.lit("")))


def clause_terms(df: DataFrame, text_col: str = "text") -> DataFrame:
    """C13a-C13j: term, notice, perpetual, renewal, payment and law fields."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    t = normalise_ws(F.col(text_col))
    base = df.select("*", t.alias("_tn")).withColumn("_low", F.lower(F.col("_tn")))
    tn = F.col("_tn")
    low = F.col("_low")
    found = lambda c, words, p, g: F.when(_guard(low, words), F.nullif(F.regexp_extract(c, p, g), F.lit("")))
    # columns of their own, so that each is computed once.
    # perpetual: first matching pattern, context -50/+300 around its first match
    base = base.select(
        "*", F.when(_guard(low, PERPETUAL_ANY), first_match_window(tn, PERPETUAL_PATTERNS, 50, 300, guards=PERPETUAL_GUARDS, low=low))
        .alias("_perp"),
        F.when(_guard(low, AUTO_RENEW_ANY), first_match_window(tn, AUTO_RENEW_PATTERNS, 0, 200, guards=AUTO_RENEW_GUARDS, low=low))
        .alias("_auto"),
        F.coalesce(found(tn, ("terminate this ", "terminating this "), _i(TFC_CLAUSE), 0), F.lit("")).alias("_tfc"))
    perp_ctx, auto_ctx, tfc = F.col("_perp"), F.col("_auto"), F.col("_tfc")
    renews = _guard(low, ("renew",))
    renewal_fallback = F.when(renews, first_capture(tn, RENEWAL_TERM_PATTERNS, guards=RENEWAL_TERM_GUARDS, low=low))
    renewal_from_auto = F.when(auto_ctx.rlike(_i(RENEWAL_CONTEXT_DURATION)),
                               F.regexp_extract(auto_ctx, _i(RENEWAL_CONTEXT_DURATION), 1))
    out = base.select(
        *[c for c in df.columns if c != text_col],
        F.trim(F.coalesce(renewal_fallback, renewal_from_auto)).alias("renewal_term"),
        F.trim(F.when(renews, first_capture(tn, RENEWAL_NOTICE_PATTERNS, guards=RENEWAL_NOTICE_GUARDS, low=low)))
        .alias("renewal_notice_period"),
        F.trim(F.when(_guard(low, TERMINATION_NOTICE_ANY),
                      first_capture(tn, TERMINATION_NOTICE_PATTERNS, guards=TERMINATION_NOTICE_GUARDS, low=low)))
        .alias("termination_notice_period"),
        perp_ctx.isNotNull().alias("perpetual"),
        F.trim(F.when(perp_ctx.rlike(_i(NOTICE_AFTER)), F.regexp_extract(perp_ctx, _i(NOTICE_AFTER), 1)))
        .alias("perpetual_notice_period"),
        auto_ctx.isNotNull().alias("auto_renewal"),
        found(tn, ("payment",), _i(r"payments?[^.]*?(" + NOTICE_DURATION + ")"), 1).alias("payment_terms"),
        F.trim(found(tn, ("late charge", "late fee", "late payment"), _i(LATE_CHARGE), 0)).alias("late_charge"),
        F.when(tfc != "", "Yes").otherwise("No").alias("termination_for_convenience"),
        F.when((tfc != "") & tfc.rlike(_i(f"({NOTICE_DURATION})")),
               F.regexp_extract(tfc, _i(f"({NOTICE_DURATION})"), 1)).alias("termination_for_convenience_notice"),
        F.when(tfc != "", F.substring(F.trim(tfc), 1, 250)).alias("termination_for_convenience_clause"),
        F.trim(found(raw, (("govern", "law"),), _i(GOVERNING_LAW), 1)).alias("governing_law"),
        collapse(F.trim(found(raw, (('"purpose"', "relat"),), "(?is)" + PURPOSE, 1))).alias("purpose"),
    )
    return out


def renewal_terms(text: Column) -> Column:
    """struct(has_auto_renewal, notice_period 'N days', renewal_term).
    ``(\\d+)\\s*days?...notice`` misses "thirty (30) days" (Q12)."""
    t = F.coalesce(text, F.lit(""))
    notice = r"(?i)(\d+)\s*days?\s*(?:prior\s*)?notice"
    term = r"(?i)renew for (?:an additional |a )?(\d+[- ](year|month|day))"
    return F.struct(
        t.rlike(r"(?i)automatically renew").alias("has_auto_renewal"),
        F.when(t.rlike(notice), F.concat(F.regexp_extract(t, notice, 1), F.lit(" days"))).alias("notice_period"),
        F.when(t.rlike(term), F.regexp_extract(t, term, 1)).alias("renewal_term"))


def sections(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per (document, section found) with the first 200 chars."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(id_col, F.explode(found_sections(t)).alias("s")) \
        .select(id_col, "s.section", "s.snippet")


def found_sections(text: Column) -> Column:
    """array<struct(section, snippet)> of the sections found, in output order."""
    def of(low: Column) -> Column:
        hits = [F.when(_guard(low, g), F.nullif(F.substring(F.regexp_extract(text, "(?is)" + p, 1), 1, 200), F.lit("")))
                for (_, p), g in zip(SECTION_PATTERNS, SECTION_GUARDS)]
        return F.filter(F.array(*[F.struct(F.lit(name).alias("section"), hit.alias("snippet"))
                                  for (name, _), hit in zip(SECTION_PATTERNS, hits)]), lambda s: s["snippet"].isNotNull())
    return let(F.lower(text), of)


def defined_terms(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``Full Term ("Short")`` pairs, one row each, in text order.

    Written linearly: the text is split at each ``("X")`` / ``(the "X")``
    marker and the full term is the trailing run of characters other than
    ``( ) "`` of the piece before it (a marker with no such run yields no
    pair), read from the reversed piece so the scan is anchored."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    shorts = F.regexp_extract_all(t, F.lit(DEFINED_MARKER), 1)
    pieces = F.split(t, DEFINED_MARKER)
    run = lambda p: F.reverse(F.regexp_extract(F.reverse(p), r'^([^()"]+)', 1))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pairs = F.transform(shorts, lambda s, i: F.struct(
        strip(run(F.element_at(pieces, i + 1))).alias("full_term"), strip(s).alias("short_term"),
        (F.length(run(F.element_at(pieces, i + 1))) > 0).alias("ok")))
    kept = F.filter(pairs, lambda p: p["ok"])
    return (df.select(id_col, F.posexplode(kept).alias("pos", "p"))
            .select(id_col, (F.col("pos") + 1).alias("ordinal"), "p.full_term", "p.short_term"))


def contract_refs(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Distinct referenced contract numbers per document."""
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")),
                                                 F.lit("(?i)" + CONTRACT_REF), 1))
    return df.select(id_col, F.explode(refs).alias("ref"))


def relationship_flags(text: Column) -> Column:
    """Amendment language; mentions a master service agreement."""
    t = F.coalesce(text, F.lit(""))
    return let(F.lower(t), lambda low: F.struct(
        (_guard(low, ("amends", "amendment", "amending")) & t.rlike(r"(?i)amend(?:s|ment|ing)")).alias("amendment_language"),
        (_guard(low, (("master", "service", "agreement"),)) & t.rlike(r"(?i)master\s+service\s+agreement")).alias("mentions_msa")))


def term_length(text: Column) -> Column:
    """``n year(s)`` / ``n month(s)`` after 'initial term' / 'term of'."""
    p = r"(?i)(?:initial\s+term|term\s+of).*?(\d+)\s+(year|month)"
    t = F.coalesce(text, F.lit(""))
    # the guard starts at the rare word and reads it in either case
    hit = t.rlike(r"[Tt][Ee][Rr][Mm]") & t.rlike(r"\d\s+[YyMm]") & t.rlike(p)
    return F.when(hit, F.concat(F.regexp_extract(t, p, 1), F.lit(" "), F.regexp_extract(t, p, 2), F.lit("(s)")))


def enterprise_type(text: Column) -> Column:
    """First enterprise type label contained in the text (case-insensitive)."""
    return _first_label(text, ENTERPRISE_TYPES)


def _first_label(text: Column, labels) -> Column:
    """The first label (in order) that the text contains, without case."""
    def of(low: Column) -> Column:
        return F.coalesce(*[F.when(low.contains(label.lower()), F.lit(label)) for label in labels])
    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def notice_days(value: Column, paren: bool = False) -> Column:
    """Notice text -> days: 'N days', else months x 30, else weeks x 7.
    "thirty (30) days" gives NULL (Q13) unless ``paren``."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    ok = (v != "") & ~v.isin("Unknown", "Not found")
    gap = r"\)?\s*" if paren else r"\s*"

    def n(unit):
        return F.regexp_extract(v, rf"(?i)(\d+){gap}(?:{unit}s?|{unit})", 1).try_cast("int")
    days = F.coalesce(n("day"), n("month") * 30, n("week") * 7)
    return F.when(ok, days)


def contract_value(value: Column, region: Column) -> Column:
    """(amount DOUBLE, currency) from a money string: symbol currency,
    else EUR for EMEA, else USD."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    cur = (F.when(v.contains("£"), "GBP").when(v.contains("€"), "EUR").when(v.contains("$"), "USD")
           .when(F.upper(F.coalesce(region, F.lit(""))) == "EMEA", "EUR").otherwise("USD"))
    amount = F.regexp_replace(v, r"[^0-9.]", "").try_cast("double")
    return F.struct(F.when(amount.isNotNull(), amount).alias("amount"), cur.alias("currency"))


# Date literal patterns (C4), in order.
_MONTHS = (r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
           r"Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)")
DATE_LITERAL_PATTERNS = (
    rf"{_MONTHS}\s+\d{{1,2}},?\s+\d{{4}}",
    rf"\b\d{{1,2}}\s+{_MONTHS}\s+\d{{4}}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{1,2}-\d{1,2}-\d{2,4}\b",
    r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
)
# What every match of a pattern holds, found by a scan that starts at a rare character.
DATE_LITERAL_GUARDS = (r"\s\d{1,2},?\s+\d{4}", r"\d\s+[A-Za-z]{3,9}\s+\d{4}", r"/\d{1,2}/\d\d", r"-\d{1,2}-\d\d",
                       r"\.\d{1,2}\.\d\d", r"-\d{2}-\d{2}")
YEAR_ONLY = r"\b(\d{4})\b"


def date_literal(text: Column) -> Column:
    """C4: first date literal by pattern order; the last pattern (a bare
    4-digit number) counts only when its first match lies in 1900-2099."""
    t = F.coalesce(text, F.lit(""))
    hits = [F.when(t.rlike(g), F.regexp_replace(F.regexp_replace(
        F.nullif(F.regexp_extract(t, "(?i)(" + p + ")", 1), F.lit("")), "  ", " "), r"^[ ,.;]+|[ ,.;]+$", ""))
        for p, g in zip(DATE_LITERAL_PATTERNS, DATE_LITERAL_GUARDS)]
    year = let(F.regexp_extract(t, YEAR_ONLY, 1), lambda y: F.when(y.try_cast("int").between(1900, 2099), y))
    return F.coalesce(*hits, year)


# Effective date in the preamble (C13f), in order.
EFFECTIVE_DATE_PATTERNS = (
    r"effective\s+(?:as\s+of\s+)?([A-Za-z]+\s+\d{1,2},?\s+\d{4})\s*\((?:the\s+)?[\"']?Effective\s+Date",
    r"(?:dated|entered\s+into)\s+(?:as\s+of\s+)?([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
    r"this\s+(\d{1,2}(?:st|nd|rd|th)?\s+day\s+of\s+[A-Za-z]+,?\s+\d{4})",
    r"\"?Effective\s+Date\"?\s+(?:shall\s+)?mean[^.]*?([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
    r"(?:dated|effective|as\s+of)\s+(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
)
EFFECTIVE_DATE_GUARDS = ((("effective", "date", "("),), ("dated", "entered"), (("this", "day", "of"),),
                         (("effective", "date", "mean"),), ("dated", "effective", "as"))
# The digits of a match, found by a scan that starts at a rare character.
EFFECTIVE_DATE_DIGITS = (r"\s\d{1,2},?\s+\d{4}", r"\s\d{1,2},?\s+\d{4}", r"\s\d{4}", r"\s\d{1,2},?\s+\d{4}",
                         r"\s\d{1,2}\s+[A-Za-z]+\s+\d{4}")


def effective_date_from_preamble(text: Column) -> Column:
    """C13f: raw effective-date literal from the first matching pattern."""
    t = F.coalesce(text, F.lit(""))
    # every pattern needs a year behind white space: other texts are not lower-cased
    return F.when(t.rlike(EFFECTIVE_DATE_DIGITS[2]), let(F.lower(t), lambda low: F.trim(F.coalesce(*[
        F.when(t.rlike(d), first_capture(t, (p,), guards=(g,), low=low))
        for p, g, d in zip(EFFECTIVE_DATE_PATTERNS, EFFECTIVE_DATE_GUARDS, EFFECTIVE_DATE_DIGITS)]))))


# Section blocks (C17).  The original's block splitter is not available; our
# definition: a numbered heading is a line "<n>. <Capital>"; the preamble is
# the text before the first heading (all of it when there is none); the term
# block runs from the first heading line containing "TERM" to the next
# heading; the signature block runs from "IN WITNESS WHEREOF" to the end.
HEADING = r"\n[ \t]*\d+\.[ \t]+[A-Z]"
TERM_BLOCK = r"(?s)(\n[ \t]*\d+\.[ \t]+[^\n]*TERM[^\n]*.*?)(?:" + HEADING + r"|$)"
PREAMBLE = r"(?s)^(.*?)(?:" + HEADING + r"|$)"
LAST_BREAK = "(?:\r\n|[\n\r\u0085\u2028\u2029])\\z"
SIGNATURES = r"(?s)(IN WITNESS WHEREOF.*)$"
# Preamble contract-type labels (C3), in order.
PREAMBLE_TYPES = ("Master Service Agreement", "Distributor Agreement", "OEM Agreement", "NDA", "SOW",
                  "Statement of Work", "License Agreement")


def section_blocks(text: Column) -> Column:
    """C17 (our definition): struct(preamble, term_termination, signatures)."""
    t = F.coalesce(text, F.lit(""))
    # a heading holds all that it needs, so its first occurrence is where the first match starts
    preamble = let(F.regexp_extract(t, HEADING, 0), lambda h: F.when(h != "", F.left(t, F.position(h, t) - 1)).otherwise(
        F.when(F.right(t, F.lit(1)).rlike(LAST_BREAK), F.regexp_replace(t, LAST_BREAK, "")).otherwise(t)))
    return F.struct(
        preamble.alias("preamble"),
        F.when(t.contains("TERM"), F.nullif(F.regexp_extract(t, TERM_BLOCK, 1), F.lit(""))).alias("term_termination"),
        F.when(t.contains("IN WITNESS WHEREOF"), F.regexp_extract(t, SIGNATURES, 1)).alias("signatures"))


def preamble_type(preamble: Column) -> Column:
    """First label contained in the preamble (case-insensitive)."""
    return _first_label(preamble, PREAMBLE_TYPES)


def signature_dates(signatures: Column) -> Column:
    """Every ``DATE: ...`` line value of the signature block, joined."""
    found = F.regexp_extract_all(F.coalesce(signatures, F.lit("")), F.lit(r"DATE:\s*([^\n]+)"), 1)
    return F.when(F.size(found) > 0, F.array_join(found, ", "))
