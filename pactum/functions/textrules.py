"""Text-quality predicates as column expressions.

All rules run JVM-side (``rlike`` / ``regexp_replace`` / ``length``); patterns
are the fixed rule lists of the original pipeline, written for Java regex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# OCR artefact patterns (short form, B14).
OCR_PATTERNS = (
    r"#{2,}",
    r"`{2,}",
    r"\\[A-Za-z]",
    r"\d{1,2}\s+[A-Z][a-z]+\s+\d{4}\s+##",
    r"[^\x00-\x7F]{3,}",
    r"\*{3,}",
    r"_{3,}",
    r"\.{5,}",
)
# Extra artefact of the export form.
OCR_PATTERNS_EXPORT = OCR_PATTERNS + (r"\[©\s*\)\s*\(©\]",)
# Contract-language phrases that are never party names (B15),
# matched on the lower-cased text.
CONTRACT_PHRASES = (
    r"\bshall\s+(end|begin|commence|terminate|expire)",
    r"\bsubject\s+to\s+the\b",
    r"\bpursuant\s+to\b",
    r"\bin\s+accordance\s+with\b",
    r"\bnotwithstanding\b",
    r"\bwhereas\b",
    r"\bhereby\b",
    r"\bhereunder\b",
    r"\bherein\b",
    r"\bthe\s+company\b",
    r"\bthe\s+parties\b",
    r"\bthe\s+msa\b",
    r"\bthis\s+(agreement|contract|sow)\b",
    r"\bterms\s+(of\s+this|and\s+conditions)\b",
    r"\beffective\s+date\b",
    r"\bexecution\s+date\b",
    r"\btermination\s+(notice|period|date)\b",
    r"\brenewal\s+(term|period|notice)\b",
    r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}\b",
    r"\bdistribute\s+their\b",
    r"\bfocus:\s*\w+",
    r"\bpeople,\s*objects",
    r"\benterprise[- ]grade\b",
    r"\bproprietary\s+technology\b",
    r"\bwill\s+terminate\s+upon\b",
)
# Sentence-fragment cues (B15), plain substrings of the lower text.
SENTENCE_CUES = (
    "shall ", "will ", "may ", "must ", "should ", "upon ", "under ",
    "with respect to", "in the event", "including ", "excluding ", "provided that",
)
SYMBOLS_SHORT = r"#@$%^&*_+={}\[\]|\\"
SYMBOLS_EXPORT = r"#@$%^&*_+={}\[\]|\\`"


def _any_rlike(c: Column, patterns) -> Column:
    # patterns that all start at a word boundary share one leading \b, so the
    # alternation is only tried at word starts (same matches, far fewer steps)
    if all(p.startswith(r"\b") for p in patterns):
        return c.rlike(r"\b(?:" + "|".join(f"(?:{p[2:]})" for p in patterns) + ")")
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def _count(c: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{char_class}]", ""))


def _symbol_heavy(t: Column, symbols: str) -> Column:
    letters = _count(t, r"\p{L}")
    digsym = _count(t, r"\p{Nd}" + symbols)
    return (F.length(t) > 10) & (digsym > letters)


def ocr_garbage(c: Column) -> Column:
    """empty/short, an artefact pattern, or digits+symbols outnumber
    letters in a text longer than 10 characters."""
    t = c.cast("string")
    bad = (t.isNull() | (F.length(t) < 2) | _any_rlike(t, OCR_PATTERNS)
           | _symbol_heavy(t, SYMBOLS_SHORT))
    return F.coalesce(bad, F.lit(True))


def party_garbage(c: Column) -> Column:
    """B14 on the stripped value plus length > 150, contract phrases,
    a lower-case first letter (except 'e') and sentence cues."""
    raw = c.cast("string")
    t = F.trim(raw)
    low = F.lower(t)
    first = F.substring(t, 1, 1)
    bad = (raw.isNull() | (F.length(raw) < 2)
           | _any_rlike(t, OCR_PATTERNS_EXPORT)
           | _symbol_heavy(t, SYMBOLS_EXPORT)
           | (F.length(t) > 150)
           | _any_rlike(low, CONTRACT_PHRASES)
           | (first.rlike(r"^\p{Ll}") & (first != "e")))
    for cue in SENTENCE_CUES:
        bad = bad | low.contains(cue)
    return F.coalesce(bad, F.lit(True))


def name_garbage(c: Column) -> Column:
    """Party-name artefacts, alphabetic ratio < 0.5, path-like, > 150 chars."""
    t = c.cast("string")
    n = F.length(t)
    bad = (t.isNull() | (n == 0)
           | t.rlike(r"#{2,}|`+|\\[A-Za-z]|<[A-Z]\\")
           | (_count(t, r"\p{L}") / n < 0.5)
           | t.rlike(r"\\[A-Za-z0-9_-]+\\")
           | (n > 150))
    return F.coalesce(bad, F.lit(True))
