"""Spans, terms, place names and numbers are read in the row's own task: plans and plain patterns."""
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from pactum.operators import classify as CL
from pactum.operators import clauses as C
from pactum.operators import definitions as D
from pactum.operators import parties as P
from pactum.operators import region as RG


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_exchanged_for_their_parties(spark):
    """c12, c6, c21 and c22 read the view once and send no row anywhere behind it; c14 deals its terms."""
    view = plan(E.queries()["e7_path_context"](spark, SMALL)).count("Exchange")
    for name in ("c12_terms", "c6_key_dates", "c22_party_details", "c23_simple_parties", "e11_sides", "c21_party_names"):
        assert plan(E.queries()[name](spark, SMALL)).count("Exchange") <= view, name
        assert "Window" not in plan(E.queries()[name](spark, SMALL))


def test_repeated_ids_keep_their_own_texts(spark):
    """Events of rows that share an id were counted through one another."""
    rows = [(1, "between Ab and Cd."), (1, "between Ab and Cd."), (1, "x between Ef and Gh, and"), (None, "between I and J,")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted((r.party1, r.party2) for r in P.simple_parties(df, "id").collect())
    assert got == [("Ab", "Cd"), ("Ab", "Cd"), ("Ef", "Gh"), ("I", "J")]


def test_terms_of_a_row_are_those_of_the_table(spark):
    rnd = random.Random(3)
    marks = ['(the "Place")', '("Initial Term")', '("Effective Date")', '(the "Supplier")', '("Other Thing")']
    texts = [" ".join(rnd.choice(marks) if rnd.random() < .4 else rnd.choice(["two (2) years", "May 3, 2001", "x", "and", "\n"])
                      for _ in range(rnd.randint(0, 30))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumns(
        {"primary_clause": F.lit("Our Company Inc, having x"), "counterparty_clause": F.lit(None).cast("string")})
    table = D.defined_terms(D.term_markers(df, "id"), "id").collect()
    own = D.terms_of_row(D.marked_terms(F.col("text"), F.col("primary_clause"), F.col("counterparty_clause")))
    rows = df.select("id", own.alias("t")).collect()
    assert sorted((r.id, r["first"], r.term, r.snippet) for r in table) == [(r.id, *t) for r in rows for t in r.t] and len(table) > 60
    names = {"a": "Place", "b": "Initial Term"}
    joined, col = (sorted(map(tuple, D.term_columns(df.select("id", own.alias("t")), t, "id", names).select("id", "a", "b").collect()))
                   for t in (D.defined_terms(D.term_markers(df, "id"), "id"), F.col("t")))
    assert joined == col


def test_numbers_by_letter_match_the_plain_words():
    rnd = random.Random(4)
    words = ["one", "twenty", "four", "-", " ", "hundred", "eighty", "thirty", "six", "ten", "nine", "forty", "five", "(", "30", ")", "days", "ONE "]
    hits = 0
    for _ in range(20_000):
        t = "".join(rnd.choice(words) for _ in range(rnd.randint(2, 10))) + rnd.choice(["", " (12) years"])
        for p in (C.DURATION_FULL, C.NOTICE_DURATION):
            one, two = (re.search(q, t, re.I | re.A) for q in (p, C.quick(p)))
            assert (one and one.span()) == (two and two.span()), t
            hits += one is not None
    assert hits > 1000 and C.WORD_NUM_BY_LETTER in C._i(C.NOTICE_AFTER)


def test_one_scan_finds_the_names_of_each(spark):
    names = RG.SCANNED_NAMES
    assert not [(a, b) for a in names for b in names if a != b and re.search(rf"\b{re.escape(b.lower())}", a.lower())]
    rnd = random.Random(6)
    parts = [*names, "U.S.", "UxSy", "xUSA", "Chinax", "NEW york", "new", "é", "_", "-", "."]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", "", ",", "é"]) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    each = F.array(*[F.when(F.col("text").rlike(rf"(?i)\b{n}\b"), F.lit(n.lower())) for n in dict.fromkeys(names)])
    wrong = df.filter(F.array_sort(F.array_compact(each)) != F.array_sort(RG._names_in(F.col("text"))))
    assert wrong.count() == 0


def test_texts_left_out_fit_no_type_rule(spark):
    rnd = random.Random(7)
    parts = sorted({w for p, _ in CL.TEXT_RULES for w in re.findall(r"[a-z]{2,}|#", p)}) + ["this", "sow", "msa", "12", "no", "to", "non-"]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", "  ", "\n", "", "x"]) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    texts += ["software\n\nlicense", "licensing  agreement", "sow  #1", "this msa ", "first amendment", "master  service agreement", "mutual nda"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    fits = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(1)) for p, _ in CL.TEXT_RULES], F.lit(0)) == 1
    got = df.select(fits.alias("f"), CL._may_fit(F.col("text")).alias("m")).groupBy("f", "m").count().collect()
    n = {(r.f, r.m): r["count"] for r in got}
    assert n.get((True, False), 0) == 0 and n[True, True] > 50 and n[False, False] > 50
