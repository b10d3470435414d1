"""Operator 5: personal data and information-theoretic sanitisation, in DataFrame functions only.

**Base.** E-mail addresses, IP addresses, card numbers and phone numbers are found over
whole texts, leftmost and non-overlapping per kind; positions are code points, the end
exclusive.  The patterns are written so that the JVM's matcher needs linear time:
possessive repeats, and a start only where a run of the pattern's characters begins
(or where the last match ended).  They match exactly what the plain patterns match.

**Disclosing terms.** Each distinct base value is a protected entity e.  The words within
``WINDOW`` code points of an occurrence are its context; words with a digit, ``@`` or ``+``
are left out.  With T words in all texts, c(t) of them the term t, n(e) words in contexts of e
and c(t, e) of them t:

    information of e           IC(e)     = log2(T / n(e))
    information t gives on e   PMI(t; e) = log2((c(t, e) / n(e)) / (c(t) / T))
    disclosure                 PMI(t; e) / IC(e)      (1: t occurs near e only)

A term that occurs in at least ``MIN_CONTEXTS`` differing contexts of e (copies of one
text are one context) is generalised from ``GENERALISE_AT`` on and removed from
``REMOVE_AT`` on, where it stands in a context of e.

Corpus counts c(t) cover all words of all texts; a semi-join with the hash buckets of the
candidate terms (at most ``BUCKETS`` numbers, so it may be broadcast) drops the other words
before they are shuffled, and exact counts are joined by term.

NULL texts count as empty and stay NULL when sanitised.  Repeated rows are found each; rows
are told apart by (id, hash of the text), so equal ids with differing texts don't mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import run_folder, stage

KINDS = ("email", "ip", "card", "phone")
WINDOW = 60
MIN_CONTEXTS = 2
GENERALISE_AT = 0.85
REMOVE_AT = 0.98
BUCKETS = 1 << 20
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: As the plain patterns, for a backtracking matcher in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # only whole runs of 16 to 19 digits; other runs would be dropped anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"

_SPAN = "array<struct<s:int,e:int,m:string>>"


def matches(text: Column, pattern: str) -> Column:
    """(s, e, m) of every match: the texts between matches give the positions."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sized = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                       lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("l"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + x["l"]
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).cast(_SPAN)
        return F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.when(F.size(hits) == 0, F.array().cast(_SPAN)).otherwise(
        F.aggregate(sized, start, step, lambda acc: acc["out"]))


def base_spans(text: Column, kind: str) -> Column:
    """Valid base matches of one kind."""
    found = matches(text, PATTERNS[kind])
    digits = lambda x: F.regexp_replace(x["m"], "[^0-9]", "")
    if kind == "ip":
        found = F.filter(found, lambda x: x["m"].rlike(IP_PARTS))
    elif kind == "card":
        found = F.filter(found, lambda x: F.call_function("luhn_check", digits(x)))
    elif kind == "phone":
        found = F.filter(found, lambda x: F.length(digits(x)).between(8, 15))
    none = F.array().cast(_SPAN)
    has = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]{2}|[0-9][ -]")
    return F.when(has, found).otherwise(none)


def find_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text, n_words, one array of spans per kind)."""
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return src.select("id", F.xxhash64("text").alias("th"), "text", F.regexp_count("text", F.lit(WORD)).alias("n_words"),
                      *(base_spans(F.col("text"), k).alias(k) for k in KINDS))


def contexts(found: DataFrame) -> DataFrame:
    """One row for each base span: id, th, kind, value, its windows and their places."""
    tagged = [F.transform(F.col(k), _tagger(k)) for k in KINDS]
    from_ = F.greatest(F.col("x.s") - WINDOW, F.lit(0))
    return (found.filter(sum((F.size(k) for k in KINDS), F.lit(0)) > 0)
            .select("id", "th", "text", F.explode(F.concat(*tagged)).alias("x"))
            .select("id", "th", F.concat_ws(":", "x.kind", "x.m").alias("entity"),
                    from_.alias("l_at"), F.col("text").substr(from_ + 1, F.col("x.s") - from_).alias("l"),
                    F.col("x.e").alias("r_at"), F.col("text").substr(F.col("x.e") + 1, F.lit(WINDOW)).alias("r"),
                    (F.col("x.e") + WINDOW >= F.length("text")).alias("r_last")))


def _tagger(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))


def context_terms(ctx: DataFrame) -> DataFrame:
    """(id, th, entity, ctx, term, s, e): whole words of the windows."""
    words = lambda c: matches(F.col(c), WORD)
    left = F.filter(words("l"), lambda x: ((x["s"] > 0) | (F.col("l_at") == 0)) & (x["e"] < F.length("l")))
    right = F.filter(words("r"), lambda x: (x["s"] > 0) & ((x["e"] < F.length("r")) | F.col("r_last")))
    place = lambda at: lambda x: F.struct(
        (x["s"] + F.col(at)).alias("s"), (x["e"] + F.col(at)).alias("e"), F.lower(x["m"]).alias("term"))
    return (ctx.select("id", "th", "entity", F.xxhash64("l", "r").alias("ctx"),
                       F.explode(F.concat(F.transform(left, place("l_at")), F.transform(right, place("r_at")))).alias("w"))
            .select("id", "th", "entity", "ctx", F.col("w.term").alias("term"), F.col("w.s").alias("s"), F.col("w.e").alias("e"))
            .filter(~F.col("term").rlike("[0-9@+]")))


def disclosing_terms(docs: DataFrame, terms: DataFrame, total: Column, text_col: str, folder: str) -> DataFrame:
    """(entity, term, action) of the terms that disclose an entity."""
    # an occurrence near an entity counts once, however often the entity stands around it
    near = terms.select("entity", "term", "ctx", "id", "th", "s").distinct()
    joint = stage(near.groupBy("entity", "term", "ctx").agg(F.count(F.lit(1)).alias("c"))
                  .groupBy("entity", "term").agg(F.sum("c").alias("c_te"), F.count(F.lit(1)).alias("n_ctx")), folder, "joint")
    of_entity = joint.groupBy("entity").agg(F.sum("c_te").alias("n_e"))
    candidates = joint.filter(F.col("n_ctx") >= MIN_CONTEXTS)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    buckets = candidates.select(bucket("term").alias("b")).distinct()            # at most BUCKETS rows
    words = docs.select(F.explode(F.split(F.lower(docs[text_col]), BLANK)).alias("term")) \
        .withColumn("b", bucket("term")).join(F.broadcast(buckets), "b", "left_semi")
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
    pmi = F.log2((F.col("c_te") / F.col("n_e")) / (F.col("c_t") / total))
    ratio = pmi / F.log2(total / F.col("n_e"))
    return (candidates.join(of_entity, "entity").join(counts, "term")
            .withColumn("ratio", ratio).filter(F.col("ratio") >= GENERALISE_AT)
            .select("entity", "term", F.when(F.col("ratio") >= REMOVE_AT, "remove").otherwise("generalise").alias("action")))


def analyse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row (id, th, spans per kind), and (id, th, terms) of the rows with disclosing terms."""
    folder = run_folder(docs.sparkSession)
    found = find_base(docs, id_col, text_col)
    spans = stage(found.drop("text"), folder, "spans")
    terms = stage(context_terms(contexts(found)), folder, "terms")
    n = spans.agg(F.sum("n_words")).first()[0] or 1                # one number
    flagged = disclosing_terms(docs, terms, F.lit(float(n)), text_col, folder)
    marked = (terms.join(flagged, ["entity", "term"])
              .groupBy("id", "th", "s", "e").agg(F.max("action").alias("action"))    # remove wins
              .groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e", "action"))).alias("terms")))
    return spans, stage(marked, folder, "marked")


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms of every row."""
    spans, marked = analyse(docs, id_col, text_col)
    other = marked.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "terms")
    both = spans.join(other, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    base = F.concat(*(_joined(k, F.col(k)) for k in KINDS))
    terms = F.coalesce(_joined("term", F.col("terms")), F.array().cast("array<string>"))
    return both.select(
        F.col("id").alias(id_col), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"), F.size(terms).cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets, and disclosing terms
    by ``[TERM]`` (generalised) or nothing (removed).  Other columns stay."""
    marked = analyse(docs, id_col, text_col)[1].select(F.col("id").alias("_id"), F.col("th").alias("_th"), "terms")
    # without a digit or @ there is no personal data, hence no context either
    may = F.coalesce(docs[text_col].rlike("[0-9@]"), F.lit(False))
    rows = docs.filter(may).withColumn("_own", F.xxhash64(text_col))
    text = F.col(text_col)
    tag = lambda name: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(name).alias("tag"))
    term_tag = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"),
                                  F.when(x["action"] == "remove", "").otherwise("[TERM]").alias("tag"))
    kind = "array<struct<s:int,e:int,tag:string>>"
    spans = F.concat(*(F.transform(base_spans(text, k), tag(f"[{k.upper()}]")).cast(kind) for k in KINDS),
                     F.coalesce(F.transform("terms", term_tag).cast(kind), F.array().cast(kind)))

    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]                       # overlaps what is replaced already
        gap = F.when(inside, "").otherwise(F.concat(text.substr(acc["at"] + 1, x["s"] - acc["at"]), x["tag"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    new = F.aggregate(F.sort_array("_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                      lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    match = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th"))
    changed = (rows.join(marked, match, "left").withColumn("_spans", spans)
               .withColumn(text_col, F.when(F.size("_spans") > 0, new).otherwise(text)).select(*docs.columns))
    return changed.union(docs.filter(~may))
