"""C12c, C13k, C7: the rules that read less of a text against the plain patterns, and what they skip."""

import re

from pyspark.sql import functions as F

from pactum.functions.dates import normalise_date_text
from pactum.operators import clauses as C
from pactum.operators import workorder as WO

HEAVY = "The quick parties shall renew the services of this order without any further word. " * 3
TEXTS = [
    None, "", "twenty-four (24) months", "for TwentyFour(24)months and six (6) days", "one  hundred\n eighty \t(180)  Days",
    "a hundred twenty (120) days", "stone (1) day", "(1) (2) days", "(1) dayseven (7) days", "x (3) years or nine (9) year",
    "none (x) days, 12 months", "éleven (11) yearséß", "the 5 day and forty-five (45) days", "forty five (45) days", "1234 months",
    "Project  start date shall be 25 November 2024 and shall end 28 February 2025, later.",
    "start date is March 5, 2001. The end date: 1/2/2003", "Project Start Date : 5 May 1999", "shall end on June 1, 2002",
    "commencement date shall be 1 Janurary 2003", "commence on\n7 July 2007 and\tthe services shall conclude 8 August 2008",
    "project start date 3 and start date is 4 April 2004", "services begin on 5/6/2007; completion date of 19 Octobar, 2010",
    "until the completion of the Work", "shall terminate upon COMPLETION", "completion only", "end in 2004", "the year\t2005",
    "effective as of March 1, 2014 (the \"Effective Date\")", "dated as of Seplember 3, 2005", "this 19th day of October, 2005",
    "Effective Date shall mean the day 4 of June 5, 2006", "as of 7 May 2008", "dated 2009", "dated as of Mar 3 2010",
]


def plain(p, text, group=1):
    m = re.search(p, text, re.I | re.A)
    return m.group(group).strip(" ") if m else None


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def test_duration_equals_plain_patterns(spark):
    texts = TEXTS + [f"{HEAVY}{t} {HEAVY}" for t in TEXTS if t]
    found = {r.i: r.d for r in frame(spark, texts).select("i", WO.duration(F.col("text")).alias("d")).collect()}
    want = {i: None if t is None else plain(WO.DURATIONS[0], t) or plain(WO.DURATIONS[1], t) for i, t in enumerate(texts)}
    assert found == want and sum(v is not None for v in want.values()) > 20


def test_duration_reads_words_from_their_brackets():
    """Every word of the patterns has its form read backwards; no pattern tries words at every character."""
    words = [w for w in re.sub(r"\\s\*.*", "", WO.DURATION_WORDS[3:]).rstrip(")").replace("one\\s+hundred\\s+(?:twenty|eighty", "one hundred twenty|one hundred eighty")
             .replace("-?", "-").split("|")]
    assert len(words) > 20 and all(re.fullmatch(WO.WORD_BACKWARDS, w[::-1]) for w in words), words


def test_work_order_dates_equal_plain_patterns(spark):
    texts = TEXTS + [f"{HEAVY}{t} {HEAVY}" for t in TEXTS if t]
    w = frame(spark, texts).select("i", WO.work_order_dates(F.col("text")).alias("w")).select("i", "w.*").collect()
    lead = lambda p: p if p.startswith(("services", "completion", "commence")) else r"(?:project\s+|shall\s+)?" + p
    raw = {}
    for i, t in enumerate(texts):
        t = re.sub(r"\s+", " ", t or "", flags=re.A)
        both = [plain(lead(WO.START_AND_END), t, g) for g in (1, 2)]
        one = [next((d for d in (plain(lead(p), t) for p in ps) if d), None) for ps in (WO.STARTS, WO.ENDS)]
        raw[i] = (*(both if both[0] else one), any(plain(p, t, 0) for p in WO.COMPLETION))
    given = spark.createDataFrame([(i, *v) for i, v in raw.items()], "i int, s string, e string, c boolean")
    want = {r.i: (r.s, r.e, r.c) for r in given.select("i", normalise_date_text(F.col("s")).alias("s"), normalise_date_text(F.col("e")).alias("e"), "c").collect()}
    assert {r.i: (r.sow_start_date, r.sow_end_date, r.sow_completion_based) for r in w} == want
    assert sum(v[0] is not None for v in want.values()) > 10 and sum(v[2] for v in want.values()) >= 4


def test_effective_date_and_normal_form(spark):
    d = frame(spark, TEXTS).select("i", C.effective_date_from_preamble(F.col("text")).alias("raw"))
    found = {r.i: (r.raw, r.day) for r in d.select("i", "raw", normalise_date_text(F.col("raw")).alias("day")).collect()}
    want = {i: next((v for v in (plain(p, t or "") for p in C.EFFECTIVE_DATE_PATTERNS) if v), None) for i, t in enumerate(TEXTS)}
    assert {i: v[0] for i, v in found.items()} == want
    days = {v[0]: v[1] for v in found.values() if v[0]}
    assert days["Seplember 3, 2005"] == "09/03/2005" and days["19th day of October, 2005"] == "10/19/2005" and days["7 May 2008"] == "05/07/2008"


def test_normal_form_computes_a_step_once(spark):
    """The chain of typo fixes stands in the plan once (and in the test for it), not once for each use."""
    plan = frame(spark, ["x"]).select(normalise_date_text(F.col("text")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Seplember") <= 4
