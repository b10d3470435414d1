"""Hand-checked cases (FIXTURES.md §3) on tiny in-memory inputs."""
import datetime as dt

from pyspark.sql import functions as F

from pactum.functions.dates import numeric_token_date, parse_date_bi, parse_date_export
from pactum.operators import registry as R
from pactum.operators.pii import pii_types
from pactum.plans.fact import expiry_metrics, risk_score_bi


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("o")).first()["o"]


def test_child_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ["SOW #10.pdf", "SOW#10", "SOW 10", "SOW10",
                                               "Statement of Work 5", "acme_sow_1.pdf"]], "f string")
    got = [r[0] for r in df.select(R.child_number(F.col("f"), F.lit("SOW"))).collect()]
    assert got == [10, 10, 10, 10, 5, None]


def test_bi_and_export_dates(spark):
    assert one(spark, parse_date_bi, "03/04/2024") == dt.datetime(2024, 3, 4)
    assert one(spark, parse_date_bi, "31/12/2024") == dt.datetime(2024, 12, 31)
    assert one(spark, parse_date_export, "D:20070806102619") == dt.datetime(2007, 8, 6, 10, 26, 19)
    assert one(spark, parse_date_bi, "Unknown") is None


def test_numeric_token_dates(spark):
    got = [one(spark, numeric_token_date, v) for v in ["20151016", "101615", "2015", "12345"]]
    assert got == [dt.date(2015, 10, 16), dt.date(2015, 10, 16), dt.date(2015, 1, 1), None]


def test_hierarchy_and_type_codes(spark):
    rows = [("Standard Terms.pdf", "x"), ("Addendum.pdf", "x"), ("Schedule 4.pdf", "x"),
            ("agreement.pdf", "Reseller Agreement")]
    df = spark.createDataFrame(rows, "f string, t string")
    got = [r[0] for r in df.select(R.hierarchy_class(F.col("t"), F.col("f"))).collect()]
    assert got == ["NDA", "Amendment", "Schedule", "Standalone"]
    codes = spark.createDataFrame([("Distributor Agreement", "Standalone"), ("", "MSA"),
                                   ("Unknown", "Standalone"), ("x", "Amendment")], "t string, h string")
    got = [r[0] for r in codes.select(R.type_code(F.col("t"), F.col("h"))).collect()]
    assert got == ["DST", "MSA", "MSA", "AMD"]


def test_expiry_and_risk(spark):
    as_of = dt.datetime(2000, 1, 1, 10, 0)
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1),)], "e timestamp")
    days, expired, soon = expiry_metrics(F.col("e"), as_of)
    r = df.select(days.alias("d"), expired.alias("x"), soon.alias("s")).first()
    assert (r.d, r.x, r.s) == (-1, True, False)
    score = df.select(risk_score_bi(days, F.lit(None).cast("timestamp"), F.lit("Unknown"),
                                   F.lit("Unknown"), F.lit(True), F.lit("No")).alias("r")).first().r
    assert score == 100


def test_pii(spark):
    assert one(spark, pii_types, "mail me: a.b@example.com now") == ["email"]
    assert one(spark, pii_types, "card 4111 1111 1111 1111") == ["credit_card"]


def test_parent_search_by_names(spark):
    """A parent matches if one normalised name equals or contains the other; empty names match
    empty names only."""
    rows = [(1, "Master", 0, "Acme Holdings LLC", ""), (2, "SOW", 3, "Acme Inc", "Acme"), (3, "SOW", 3, "Zeta GmbH", "Zeta"),
            (4, "NDA", 1, "Zet", "Nobody"), (5, "SOW", 3, "Inc", ""), (6, "NDA", 1, "Ltd", "")]
    rows = [(p, {"Master": "MSA"}.get(h, h), o, dt.datetime(2000, 1, p), c, f) for p, h, o, c, f in rows]
    cls = spark.createDataFrame(rows, "_pos long, hierarchy string, h_order int, sort_date timestamp, counterparty string, folder string")
    assert [one(spark, R.normalise_name, v) for v in ("Acme Inc", "Acme Holdings LLC", "Inc")] == ["acme", "acmeholdings", ""]
    got = {r._pos: r.parent_pos for r in R.parent_search(cls).collect()}
    assert got == {2: 1, 3: 4, 5: 6}


def test_date_normalisation(spark):
    from pactum.functions.dates import normalise_date_text
    got = [one(spark, normalise_date_text, v) for v in
           ["19th day of October, 2005", "Seplember 5, 2020", "2025-10-21", "soon"]]
    assert got == ["10/19/2005", "09/05/2020", "10/21/2025", "soon"]


def test_notice_days_and_contract_value(spark):
    from pactum.operators.clauses import contract_value, notice_days
    got = [one(spark, notice_days, v) for v in ["30 days", "2 months", "3 weeks", "thirty (30) days", "Unknown"]]
    assert got == [30, 60, 21, None, None]
    df = spark.createDataFrame([("£27,335", "EMEA"), ("50000", "EMEA"), ("$1,000", "APAC"), ("abc", "APAC")],
                               "v string, r string")
    rows = [tuple(r.x) for r in df.select(contract_value(F.col("v"), F.col("r")).alias("x")).collect()]
    assert rows == [(27335.0, "GBP"), (50000.0, "EUR"), (1000.0, "USD"), (None, "USD")]


def test_jurisdiction_validity(spark):
    got = [one(spark, R.jurisdiction_valid, v) for v in ["EMEA", "Colorado", "CO", "N/A", "Peru"]]
    assert got == [False, True, True, False, False]
