"""Missing-value handling and small coercions.

The collection has four encodings of "missing": NULL, '', 'Unknown' and
'Not found'/'Not specified'.  Every consumer uses its own subset; the subsets
are named here and each operator says which one it uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Missing-token sets of the individual consumers.
MISSING_BI = ("", "Unknown")  # BI fact export (NULL = absent key)
MISSING_DATE_BI = ("", "Unknown", "Not specified")  # BI date parse
MISSING_EXPORT = ("", "Unknown", "Not found", "Not specified", "N/A", "None")  # list export pick
MISSING_GAP = ("", "unknown", "n/a", "na", "not found", "tbd", "pending")  # gap scan, lower(trim)
YES_TOKENS = ("yes", "true", "1", "y")
NO_TOKENS = ("no", "false", "0", "n")
GDPR_TRUE = ("Yes", "True", "1")


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column when the frame has it, else a typed NULL (an absent key)."""
    if name in df.columns:
        return F.col(name)
    return F.lit(None).cast(dtype)


def pick(*cols: Column, missing=MISSING_BI, default=None) -> Column:
    """B1: first candidate that is neither NULL nor one of ``missing``."""
    cands = [F.when(c.isNotNull() & ~c.isin(*missing), c) for c in cols]
    return F.coalesce(*cands, F.lit(default))


def value_missing(c: Column) -> Column:
    """B4 for string columns: NULL or lower(trim(c)) in the gap-scan token set."""
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING_GAP)


def value_missing_bool(c: Column) -> Column:
    """B4 for boolean / numeric columns: only NULL is missing."""
    return c.isNull()


def yes_no(c: Column, default: str = "No") -> Column:
    """Normalise yes/true/1/y and no/false/0/n (case-insensitive) to Yes/No."""
    s = F.lower(F.trim(c.cast("string")))
    return (F.when(s.isin(*YES_TOKENS), F.lit("Yes"))
            .when(s.isin(*NO_TOKENS), F.lit("No"))
            .otherwise(F.lit(default)))


def display_text(c: Column) -> Column:
    """NULL -> 'Unknown', booleans -> Yes/No, else the string value."""
    return F.coalesce(c.cast("string"), F.lit("Unknown"))


def display_bool(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("Unknown")).when(c, F.lit("Yes")).otherwise(F.lit("No"))


def gdpr_flag(c: Column) -> Column:
    """GDPR string -> boolean by the BI export's truth set (absent = 'No')."""
    return F.coalesce(c.cast("string").isin(*GDPR_TRUE), F.lit(False))


def humanise_key(c: Column) -> Column:
    """``gdpr_reason`` -> ``GDPR Reason``; 'gdpr' and 'msa' parts are
    upper-cased, every other part capitalised."""
    parts = F.split(c, "_")
    words = F.transform(parts, lambda w: F.when(F.lower(w).isin("gdpr", "msa"), F.upper(w))
                        .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))))
    return F.array_join(words, " ")


def excerpt(c: Column, n: int) -> Column:
    """First n characters, plus an ellipsis when longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


# Standard string defaults (D5/B3); an empty default becomes 'Unknown'.
STRING_DEFAULTS = (
    ("contract_type", "Auto-detected"), ("parties", "Unknown"), ("gdpr_applicable", "Unknown"),
    ("gdpr_reason", ""), ("region", "Unknown"), ("sharepoint_department", "General"),
    ("sharepoint_owner_primary", ""), ("termination_for_convenience", "Unknown"),
    ("governing_law", "Unknown"), ("effective_date", "Unknown"), ("termination_date", "Unknown"),
    ("initial_term", "Unknown"), ("renewal_term", "Unknown"),
)
# Boolean defaults (D5/B3), applied when the key is absent.
BOOLEAN_DEFAULTS = (
    ("auto_renewal", False), ("perpetual", False), ("has_related_documents", False), ("has_tables", False),
    ("ocr_applied", False), ("is_draft", False), ("is_archive", False), ("is_terminated", False),
    ("subject_to_gdpr", False),
)


def default_backfill(df: DataFrame, owner_default: str = "") -> DataFrame:
    """Fill the 13 standard string keys (NULL or '' is missing) and the 9
    boolean keys (NULL is missing); other columns pass through."""
    out = df
    for name, default in STRING_DEFAULTS:
        d = owner_default if name == "sharepoint_owner_primary" else default
        d = d if d else "Unknown"
        c = col_or_null(df, name)
        out = out.withColumn(name, F.when(c.isNull() | (c.cast("string") == ""), F.lit(d))
                             .otherwise(c.cast("string")))
    for name, default in BOOLEAN_DEFAULTS:
        out = out.withColumn(name, F.coalesce(col_or_null(df, name, "boolean"), F.lit(default)))
    return out


def _json_str(c: Column) -> Column:
    """A string as a JSON string literal (quoted, escaped)."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def flatten_list(c: Column) -> Column:
    """B2/D3: list -> ', '-joined non-empty items; an empty result is NULL
    (the key is dropped)."""
    items = F.filter(c.cast("array<string>"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.trim(x)), ", "))


def flatten_map(c: Column, sort_keys: bool = False) -> Column:
    """B2: dict -> JSON text with the original separators (', ' and ': ');
    ``sort_keys`` is the repair-path mode (D4).  NULL map -> NULL."""
    entries = F.map_entries(c.cast("map<string,string>"))
    if sort_keys:
        entries = F.array_sort(entries)
    body = F.array_join(F.transform(entries, lambda e: F.concat(
        _json_str(e["key"]), F.lit(": "),
        F.when(e["value"].isNull(), F.lit("null")).otherwise(_json_str(e["value"])))), ", ")
    return F.when(c.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))


def flatten_list_json(c: Column) -> Column:
    """List -> JSON array text (repair path)."""
    items = F.transform(c.cast("array<string>"), lambda x: F.when(x.isNull(), F.lit("null")).otherwise(_json_str(x)))
    return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
