"""Guarded text rules against their plain patterns; repair rows; tasks of the text views."""
import random

from pyspark.sql import functions as F

from pactum.operators import clauses as C
from pactum.operators import gaps as G
from pactum.operators import workorder as WO
from pactum.sources.contracts import contract_documents

from conftest import SMALL

PARTS = ("March 1, 2014", "25 November  2024", "1/2/03", "3-4-2005", "6.7.89", "2003-05-06", "1987", "thirty (30) days", "12 months", "\n1. TERM of it\n",
         "\n 2. Next", "IN WITNESS WHEREOF", "DATE: 5 May", "Agreement", "Master Services Agreement", "dated as of", "effective", "EFFECTIVE", "under the MSA",
         "start date shall be", "and shall end", "end on", "commence on", "services shall begin", "until the completion of the work", "automatically renew",
         "renew for additional", "terms", "prior written notice", "of non-renewal", "upon", "terminate", "shall continue until terminated", "either party",
         "Payment", "late fee", "\r\n", "\n", "\t", "  ", " ", "İK", "é", "(the \"Effective Date\")", "this 3rd day of May, 2001", "WHEREAS", "THIS AGREEMENT")


def texts():
    rnd = random.Random(7)
    rows = ["", "a\n", "a\r\n", "a\n\n", "\n", "x ", "x\u0085\n"]
    return rows + [rnd.choice((" ", " ", "")).join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 14))) for _ in range(400)]


def test_guarded_rules_equal_plain_patterns(spark):
    t = F.col("text")
    tn = F.regexp_replace(t, r"\s+", " ")
    first = lambda c, ps: C.first_capture(c, ps)
    windows = lambda ps, a, b: C.first_match_window(tn, ps, a, b)
    plain_date = F.coalesce(*[F.when(t.rlike("(?i)" + p), F.regexp_replace(F.regexp_replace(
        F.regexp_extract(t, "(?i)(" + p + ")", 1), "  ", " "), r"^[ ,.;]+|[ ,.;]+$", "")) for p in C.DATE_LITERAL_PATTERNS])
    low = F.lower(tn)
    guarded = lambda ps, gs: C.first_capture(tn, ps, guards=gs, low=low)
    pairs = {
        "space": (C.normalise_ws(t), tn),
        "date": (F.when(plain_date.isNotNull(), C.date_literal(t)), plain_date),
        "effective": (C.effective_date_from_preamble(t), F.trim(first(t, C.EFFECTIVE_DATE_PATTERNS))),
        "preamble": (C.section_blocks(t)["preamble"], F.regexp_extract(t, C.PREAMBLE, 1)),
        "term": (C.section_blocks(t)["term_termination"], F.nullif(F.regexp_extract(t, C.TERM_BLOCK, 1), F.lit(""))),
        "duration": (WO.duration(t), F.trim(first(t, WO.DURATIONS))),
        "start": (WO.work_order_dates(t)["sow_start_date"].isNotNull(), first(tn, (WO.START_AND_END, *WO.STARTS)).isNotNull()),
        "end": (WO.work_order_dates(t)["sow_end_date"].isNotNull(), first(tn, (WO.START_AND_END, *WO.ENDS)).isNotNull()),
        "done": (WO.work_order_dates(t)["sow_completion_based"], C.any_match(tn, WO.COMPLETION)),
        "parent": (WO.parent_reference(t)["parent_agreement_type"].isNotNull(), first(t, WO.PARENT_REFS).isNotNull()),
        "renewal": (guarded(C.RENEWAL_TERM_PATTERNS, C.RENEWAL_TERM_GUARDS), first(tn, C.RENEWAL_TERM_PATTERNS)),
        "renewal notice": (guarded(C.RENEWAL_NOTICE_PATTERNS, C.RENEWAL_NOTICE_GUARDS), first(tn, C.RENEWAL_NOTICE_PATTERNS)),
        "notice": (guarded(C.TERMINATION_NOTICE_PATTERNS, C.TERMINATION_NOTICE_GUARDS), first(tn, C.TERMINATION_NOTICE_PATTERNS)),
        "perpetual": (C.first_match_window(tn, C.PERPETUAL_PATTERNS, 50, 300, guards=C.PERPETUAL_GUARDS, low=low), windows(C.PERPETUAL_PATTERNS, 50, 300)),
        "auto": (C.first_match_window(tn, C.AUTO_RENEW_PATTERNS, 0, 200, guards=C.AUTO_RENEW_GUARDS, low=low), windows(C.AUTO_RENEW_PATTERNS, 0, 200)),
        "sections": (F.array_join(F.transform(C.found_sections(t), lambda s: s["section"]), ","),
                     F.concat_ws(",", *[F.when(t.rlike("(?is)" + p), F.lit(n)) for n, p in C.SECTION_PATTERNS])),
    }
    df = spark.createDataFrame([(x,) for x in texts()], "text string").repartition(4)
    for name, (got, want) in pairs.items():
        wrong = df.select("text", got.alias("got"), want.alias("want")).filter("NOT (got <=> want)").take(1)
        assert not wrong, (name, wrong)


def test_repair_rows_of_repeated_ids(spark):
    """An entry comes once for each pair of its id's responses; without a response it stays once."""
    entries = spark.createDataFrame(
        [(i, ["payment_terms"], {}, None) for i in ("a", "a", "b", "c", None)],
        "contract_id string, missing_fields array<string>, inherited map<string,string>, inherited_from string")
    good = '{"contract_id": "%s", "payment_terms": "1 day", "notes": " x "} {"payment_terms": "2 days", "notes": "y"}'
    responses = spark.createDataFrame([("a", good % "a"), ("a", "none"), ("b", good % "b"), (None, "none")], "contract_id string, raw_text string")
    got = sorted((r.contract_id or "", r.status, (r.applied_fields or {}).get("payment_terms") or "")
                 for r in G.run_repair(entries, responses).collect())
    assert got == sorted([("a", "applied", "2 days")] * 4 + [("a", "parse_failed", "")] * 4
                         + [("b", "applied", "2 days"), ("c", "agent_error", ""), ("", "agent_error", "")])
    payloads = {r.contract_id: r.payload for r in G.parse_responses(responses.filter("contract_id = 'b'")).collect()}
    assert payloads == {"b": {"contract_id": "b", "payment_terms": "2 days", "notes": "x | y"}}


def test_texts_come_in_several_tasks(spark):
    """The rows that get a document's text are dealt over tasks, however small their bytes are."""
    tasks = contract_documents(spark, SMALL).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
