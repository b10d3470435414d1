"""Parties, defined terms, dated addresses and the strict list: against plain regexes and by hand."""
import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from pactum.config import FIXTURE_CONFIG as CFG
from pactum.functions.spans import matches
from pactum.operators import addresses as AD
from pactum.operators import definitions as D
from pactum.operators import listexport as L
from pactum.operators import parties as P
from pactum.operators import paths as PT


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string").repartition(3)


def test_context_of_markers(spark):
    rnd = random.Random(1)
    rows = ["".join(rnd.choice("ab(x)(xy) é") for _ in range(rnd.randint(0, 60))) for _ in range(200)] + [None, "", "(a)"]
    got = {r.id: [tuple(m) for m in r.m] for r in texts(spark, rows).select("id", matches(F.col("text"), r"\([a-z]+\)", 7, 5, 3).alias("m")).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        assert got[i] == [(k, m[0], t[max(0, m.start() - 7):m.start()], t[m.end():m.end() + 5])
                          for k, m in enumerate(re.finditer(r"\([a-z]+\)", t))]


@pytest.mark.parametrize("least,most,ends", [(3, 20, P.LONG_ENDS), (30, 4000, P.LONG_ENDS), (1, 60, P.SHORT_ENDS)])
def test_clauses_against_the_plain_pattern(spark, least, most, ends):
    rnd = random.Random(least)
    words = ["between", "Between", "and", "&", "x", "word", "longer word", "1.5", ";", ".", "\n\n", "\n", ",", "zz " * 12, "q" * (most // 3)]
    rows = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + [None, "", "between", "between a and b."]
    rows.append("between " + "x" * (most + 1) + " and " + "y" * least + ". between " + "u" * most + " and " + "v" * most + ".")
    plain = re.compile(rf"between\s+(\S.{{{least - 1},{most - 1}}}?)\s+(?:and|&)\s+(\S.{{{least - 1},{most - 1}}}?)(?:{ends})", re.I | re.S)
    spans = P.clause_spans(texts(spark, rows), "id", "text", least, most, ends).groupBy("id").agg(
        F.min_by(F.struct("at", "x_end", "y_start", "y_end"), "at").alias("s"))
    got = {r.id: r.s for r in spans.collect()}
    n = 0
    for i, t in enumerate(rows):
        m, s = plain.search(t or ""), got.get(i)
        assert (m is None) == (s is None), t
        if m:
            n += 1
            assert (t[s.at:s.x_end], t[s.y_start:s.y_end]) == (m[1], m[2])
    assert n > 20


def test_hostile_texts_take_linear_time(spark):
    big = ["between and " * 80_000, "This " * 200_000 + "between", "(the " * 200_000, " " * 900_000 + '("Initial Term")', "Aa " * 300_000,
           '("Initial Term")' * 20_000]
    start = time.time()
    rows = P.party_clauses(texts(spark, big), "id").cache()
    terms = D.defined_terms(D.term_markers(rows, "id"), "id")
    assert P.party_names(P.party_candidates(rows, terms, "id"), "id").count() == len(big)
    assert rows.select(D.snippet_before(F.col("text"), "Initial Term").alias("s")).collect()
    assert time.time() - start < 240


def test_snippets_against_the_plain_pattern(spark):
    q = "[\"“”'\\s]*"
    plain = re.compile(rf"([\s\S]{{1,300}})\s*\({q}(?:each\s*,?\s*a\s+|the\s+|a\s+)?{q}(?:\*\*)?\s*Initial Term\s*(?:\*\*)?{q}\)", re.I)

    def voted(t):
        clauses = []
        for m in plain.finditer(t or ""):
            s = re.sub(r"\s+", " ", m[1]).replace("**", "")
            mark = next((d for d in ".;:" if d in s and len(s) - s.rfind(d) <= 250), None)
            clauses.append((s[s.rfind(mark) + 1:] if mark else s).strip(" ,;"))
        fine = [c for c in clauses if not any(w in c.lower() for w in D.REFERS)]
        return next((c for c in fine if any(w in c.lower() for w in D.DEFINES)), fine[0] if fine else None) or None

    rnd = random.Random(5)
    marks = ['("Initial Term")', '(the "Initial Term")', '(each, a " **initial term** ")', '("Other")', "Initial Term"]
    words = ["shall have", "during the", "a term of five", "x;", "end.", "  ", "\n\n", "of: ", "**b**", "word " * 8, "zz"]
    rows = ["".join(rnd.choice(marks) if rnd.random() < .25 else rnd.choice(words) + rnd.choice(["", " ", "  "])
                    for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, "", ' ("Initial Term")']
    got = {r.id: r.s for r in texts(spark, rows).select("id", D.snippet_before(F.col("text"), "Initial Term").alias("s")).collect()}
    assert [got[i] for i in range(len(rows))] == [voted(t) for t in rows]


def test_the_last_definition_of_a_term_wins(spark):
    rows = texts(spark, ['One (the "Place"). Two (the "Effective Date") from 2001-02-03. Three (the "Place"), and four (the "Supplier").', None, "()"])
    rows = rows.withColumn("primary_clause", F.lit("Our Company Inc, a Delaware corporation")).withColumn("counterparty_clause", F.lit(None).cast("string"))
    got = {(r.id, r.term): r.snippet for r in D.defined_terms(D.term_markers(rows, "id", CFG), "id").collect()}
    assert got[0, "Effective Date"] == "2001-02-03" and got[0, "Supplier"] == "Our Company Inc"
    assert got[0, "Place"].endswith("Three") and len(got) == 3


def ratio(a, b):
    """Token-set similarity by a plain table of common subsequences."""
    def indel(p, q):
        row = [0] * (len(q) + 1)
        for c in p:
            last = row[:]
            for j, d in enumerate(q, 1):
                row[j] = last[j - 1] + 1 if c == d else max(last[j], row[j - 1])
        return 200 * row[-1] / (len(p) + len(q))
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(z))])) for z in (x - y, y - x))
    if not x or not y:
        return 0
    return 100 if both and (x <= y or y <= x) else max(indel(one, two), *([indel(both, one), indel(both, two)] if both else [0]))


def test_fuzzy_names_first_wins(spark):
    rnd = random.Random(2)
    base = ["Acme Trading Corporation", "Acme Tradin Corporation", "Trading Corporation Acme", "Zeta GmbH", "Zeta", "Gamma Works Ltd"]
    lists = [None, [], [None, "", "A"]]
    for _ in range(60):
        lists.append(["".join(c for c in rnd.choice(base) if rnd.random() > 0.03) for _ in range(rnd.randint(0, 8))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "id int, names array<string>")
    got = {r.id: r.k for r in df.select("id", P.fuzzy_dedupe(CFG.fuzzy_threshold)("names").alias("k")).collect()}
    for i, names in enumerate(lists):
        kept = []
        for n in names or []:
            if n and all(ratio(n, k) < CFG.fuzzy_threshold for k in kept):
                kept.append(n)
        assert got[i] == kept
    assert any(len(got[i]) < len(v or []) for i, v in enumerate(lists))


def test_address_on_the_boundary_day(spark):
    home = AD.entity_names(CFG)[3]
    cut = CFG.address_cutover
    rows = spark.createDataFrame([(1, home, cut), (2, home, cut - dt.timedelta(days=1)), (3, home, None), (4, "Nobody", cut), (5, None, cut)],
                                 "id int, entity string, day date")
    got = {r.id: r.address for r in AD.as_of_join(rows, AD.address_book(spark, CFG), "entity", "day").collect()}
    assert got[1].startswith("305") and got[2].startswith("2560") and got[3] == got[2] and got[4] is got[5] is None
    assert len(got) == 5


def test_overlapping_periods_double_no_row(spark):
    d = dt.date
    book = spark.createDataFrame([("e", d(2000, 1, 1), None, "a"), ("e", d(2001, 1, 1), d(2001, 6, 30), "b"), ("e", d(2001, 1, 1), d(2001, 3, 31), "c"),
                                  ("e", d(2002, 1, 1), None, "d")], AD.PERIODS)
    days = [d(1999, 12, 31), d(2000, 1, 1), d(2000, 12, 31), d(2001, 1, 1), d(2001, 6, 30), d(2001, 7, 1), d(2003, 1, 1)]
    rows = spark.createDataFrame([("e", x) for x in days], "entity string, day date")
    got = AD.as_of_join(rows, book, "entity", "day").orderBy("day").collect()
    assert [r.address for r in got] == [None, "a", "a", "b", "b", None, "d"]


def test_schema_is_enforced(spark):
    df = spark.createDataFrame([("n", "x", "7", "12.5", "7.9x")], ["Name", "Extra", "DaysToExpiry", "ContractValue", "Notification_Buffer_Days"])
    out = L.enforce(df)
    assert out.columns == [f.name for f in L.STRICT_SCHEMA] and len(out.columns) == 46
    r = out.first()
    assert (r["Name"], r["DaysToExpiry"], r["ContractValue"], r["Notification_Buffer_Days"], r["Autorenew"], r["RenewalDate"]) == ("n", 7, 12.5, None, "", None)
    found = L.compare_schema(df)
    assert found["extra"] == ["Extra"] and len(found["missing"]) == 42
    assert [t for _, t in out.dtypes if t != "string"] == ["int"] * 4 + ["double", "int"]


def test_quoted_names(spark):
    rows = [("a.b (c)*", "axb (c)* at 1 Some Street, X 12345. A.B (C)* at 7 Other Road, Y 54321 end"), ("\\Eq", "\\Eq 5 Long Way 11111"),
            ("", "7 Other Road 54321"), (None, "x"), ("n", None), ("n", "n. 7 Other Road 54321")]
    df = spark.createDataFrame(rows, "name string, text string")
    got = [r.a for r in df.select(P.address_near(F.col("text"), F.col("name")).alias("a")).collect()]
    assert got == ["7 Other Road, Y 54321", "5 Long Way 11111", None, None, None, None]


def test_roles_and_states_of_paths(spark):
    rows = [("c/MSA 1.pdf", "x"), ("c/a/Terminated/sow 3.pdf", "x"), ("draft/Exhibit.pdf", "x"), ("archive/checklist.pdf", ""), ("x.pdf", "a termination letter"), ("x.pdf", None)]
    df = spark.createDataFrame(rows, "p string, t string").select(PT.document_context(F.col("p"), F.col("t")).alias("c"))
    got = [(r.c.document_role, r.c.contract_status) for r in df.collect()]
    assert got == [("Master Agreement", "Active"), ("Statement of Work", "Terminated"), ("Amendment/Addendum", "Draft"),
                   ("Summary/Checklist", "Archive"), ("Termination Letter", "Active"), (None, "Active")]


VARIED = ("c22_party_details", "c14_defined_terms", "c21_party_names", "c23_simple_parties", "c24_counterparty_address", "c12_terms", "c6_key_dates",
          "e7_path_context", "e10_folders", "e11_sides", "i4_name_dedupe", "e29_entity_address")


@pytest.mark.parametrize("name", VARIED)
def test_no_checked_column_is_constant(spark, name):
    out = E.queries()[name](spark, SMALL)
    seen = out.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))).alias(c) for c in out.columns]).first().asDict()
    assert not [c for c, n in seen.items() if n < 2]


def test_all_sources_and_roles_appear(spark):
    assert {r.source for r in E.queries()["c21_candidate_sources"](spark, SMALL).collect()} == set(range(1, 9))
    rows = E.queries()["e7_path_context"](spark, SMALL).select("document_role", "contract_status").distinct().collect()
    assert {r.document_role for r in rows} >= {"Statement of Work", "Amendment/Addendum", "Termination Letter", "Summary/Checklist", "Master Agreement"}
    assert {r.contract_status for r in rows} == {"Active", "Terminated", "Draft", "Archive"}
