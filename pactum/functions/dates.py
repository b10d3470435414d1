"""Multi-format date parsing and day arithmetic (C4, C7-C10, E22 helpers).

Every parser is a ``coalesce`` of ``try_to_timestamp`` calls: JVM-side, no UDF,
NULL on failure (ANSI mode stays on).  Format order is semantic: the first
format that parses wins (``03/04/2024`` is 4 March because month-first comes
before day-first).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

# Format lists of the two consumers, in their order.
# BI form (C8): %Y-%m-%d, %m/%d/%Y, %d/%m/%Y, %B %d, %Y, %Y
BI_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "yyyy")
BI_MISSING = ("", "Unknown", "Not specified")
# Export form (C9): %Y-%m-%d, %m/%d/%Y, %d/%m/%Y, %B %d, %Y, %b %d, %Y,
# %d %B %Y, %d %b %Y, %Y, %m/%d/%y
EXPORT_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy",
                  "d MMMM yyyy", "d MMM yyyy", "yyyy")
EXPORT_MISSING = ("", "Unknown", "Not specified", "Not found")

MICROS_PER_DAY = 86_400_000_000


# Shape guards: a format is only tried on strings of its shape, so failed
# parses (which cost an exception each inside the JVM) are rare.
_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "yyyy": r"^\d{4}$",
    "yyyyMMddHHmmss": r"^\d{14}$",
    "yyyyMMdd": r"^\d{8}$",
    "MMddyyyy": r"^\d{8}$",
    "MMddyy": r"^\d{6}$",
}


def _wordy(fmt: str) -> str:
    """Shape of a format with a month's name: what it begins with, and whether it has a comma."""
    return (r"^\d{1,2}\s*[A-Za-z]" if fmt.startswith("d") else r"^\s*[A-Za-z]") + ("[^,]*," if "," in fmt else "[^,]*$")


def _try_ts(c: Column, fmt: str) -> Column:
    shape = _SHAPES.get(fmt) or _wordy(fmt)
    return F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt)))


def _two_digit_year(c: Column) -> Column:
    """``M/d/yy`` with the C library pivot: 69-99 -> 19xx, 00-68 -> 20xx."""
    ts = _try_ts(c, "M/d/yy")
    return F.when(F.year(ts) >= 2069, F.add_months(ts, -1200).cast("timestamp")).otherwise(ts)


def parse_date_bi(c: Column) -> Column:
    """BI export date parse -> TIMESTAMP (NULL when missing or unparseable)."""
    s = c.cast("string")
    parsed = F.coalesce(*[_try_ts(s, f) for f in BI_FORMATS])
    return F.when(s.isNull() | s.isin(*BI_MISSING), F.lit(None).cast("timestamp")).otherwise(parsed)


def parse_date_export(c: Column) -> Column:
    """List-export date parse, adds the PDF ``D:yyyyMMddHHmmss`` form."""
    s = F.trim(c.cast("string"))
    pdf = F.when(s.startswith("D:") & (F.length(s) > 8),
                 F.coalesce(_try_ts(F.substring(s, 3, 14), "yyyyMMddHHmmss"),
                            _try_ts(F.substring(s, 3, 8), "yyyyMMdd")))
    parsed = F.coalesce(pdf, *[_try_ts(s, f) for f in EXPORT_FORMATS], _two_digit_year(s))
    return F.when(c.isNull() | c.cast("string").isin(*EXPORT_MISSING),
                  F.lit(None).cast("timestamp")).otherwise(parsed)


def numeric_token_date(c: Column) -> Column:
    """Digits-only token -> DATE.  6 digits MMddyy, 8 digits yyyyMMdd then
    MMddyyyy, 4 digits a year (1900-2100); anything else NULL."""
    t = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    n = F.length(t)
    six = _try_ts(t, "MMddyy")
    six = F.when(F.year(six) >= 2069, F.add_months(six, -1200).cast("timestamp")).otherwise(six)
    yr = t.try_cast("int")
    four = F.when((yr >= 1900) & (yr <= 2100), F.make_date(yr, F.lit(1), F.lit(1)))
    ok = lambda ts: F.when((F.year(ts) >= 1900) & (F.year(ts) <= 2100), ts.cast("date"))
    return (F.when(n == 6, ok(six))
            .when(n == 8, F.coalesce(ok(_try_ts(t, "yyyyMMdd")), ok(_try_ts(t, "MMddyyyy"))))
            .when(n == 4, four))


def as_of_lit(as_of: _dt.datetime | _dt.date) -> Column:
    if isinstance(as_of, _dt.datetime):
        return F.lit(as_of).cast("timestamp")
    return F.lit(_dt.datetime(as_of.year, as_of.month, as_of.day)).cast("timestamp")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days of ``later - earlier``, floored like a Python timedelta (Q21)."""
    diff = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("int")


# Month-name typo fixes applied before parsing.
MONTH_TYPOS = (
    ("Seplember", "September"), ("Septmber", "September"), ("Sepetmber", "September"),
    ("Janurary", "January"), ("Febuary", "February"), ("Feburary", "February"), ("Apirl", "April"),
    ("Augest", "August"), ("Augst", "August"), ("Ocotber", "October"), ("Novmber", "November"),
    ("Decmber", "December"),
)
# C7 formats in order (%B %d, %Y ... %d/%m/%Y).
NORMALISE_FORMATS = ("MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM, yyyy",
                     "d MMMM yyyy", "d MMM, yyyy", "d MMM yyyy", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy")
DAY_OF = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+day\s+of\s+([A-Za-z]+),?\s+(\d{4})"


def normalise_date_text(c: Column) -> Column:
    """Typo fixes, "19th day of October, 2005" -> "October 19, 2005", then
    the first of 11 formats -> MM/dd/yyyy; the (fixed) text when none parses."""
    def fixed(s: Column) -> Column:
        out = s
        for typo, right in MONTH_TYPOS:
            out = F.regexp_replace(out, "(?i)" + typo, right)
        return F.when(s.rlike("(?i)" + "|".join(typo for typo, _ in MONTH_TYPOS)), out).otherwise(s)

    def worded(s: Column) -> Column:
        return F.when(s.rlike(DAY_OF), F.concat(F.regexp_extract(s, DAY_OF, 2), F.lit(" "),
                                                F.regexp_extract(s, DAY_OF, 1), F.lit(", "),
                                                F.regexp_extract(s, DAY_OF, 3))).otherwise(s)

    def parsed(s: Column) -> Column:
        found = let(F.trim(s), lambda t: F.coalesce(*[_try_ts(t, f) for f in NORMALISE_FORMATS]))
        return F.coalesce(F.date_format(found, "MM/dd/yyyy"), s)

    # each step computed once, also inside a lambda
    return let(c.cast("string"), lambda s: let(fixed(s), lambda f: let(worded(f), parsed)))
