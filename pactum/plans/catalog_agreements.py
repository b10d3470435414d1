"""Registered queries over the ``agreements`` view: parties, defined terms, key dates, path
context, dated addresses and the strict list export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE_AS_OF as AS_OF
from ..config import FIXTURE_CONFIG as CFG
from ..functions.dates import parse_date_export
from ..operators import addresses as AD
from ..operators import definitions as D
from ..operators import listexport as L
from ..operators import parties as P
from ..operators import paths as PT
from ..operators import registry as R
from ..operators.jurisdiction import export_jurisdiction
from ..sources.agreements import agreements
from ..sources.contracts import contracts
from ..sources.tables import table
from .catalog import governance_columns, register

ID = "contract_id"


def _clauses(spark, sf):
    return P.party_clauses(agreements(spark, sf), ID, cfg=CFG)


def _terms(clauses):
    return D.defined_terms(D.term_markers(clauses, ID, CFG), ID)


def _own_terms():
    """The same of one row of the clauses, as a column: nothing is sent to a join."""
    return D.terms_of_row(D.marked_terms(F.col("text"), F.col("primary_clause"), F.col("counterparty_clause"), CFG))


@register("c22_party_details")
def q_c22(spark, sf):
    """The two clauses told apart, and each party's name and address."""
    return _clauses(spark, sf).select(
        ID, "primary_clause", "counterparty_clause", "party1_name", "party1_address", "party2_name", "party2_address",
        "primary_party_name", "primary_party_address", "counterparty_name", "counterparty_address")


@register("c14_defined_terms")
def q_c14(spark, sf):
    return _terms(_clauses(spark, sf)).select(ID, "term", "snippet")


@register("c21_party_names")
def q_c21(spark, sf):
    c = _clauses(spark, sf)
    return P.party_names(P.party_candidates(c, _own_terms(), ID, cfg=CFG), ID, CFG)


@register("c21_candidate_sources")
def q_c21_sources(spark, sf):
    """How many candidates each of the eight sources gives."""
    c = _clauses(spark, sf)
    # the outer form: Spark would compute the candidates of the plain one again, to filter by their number
    found = P.party_candidates(c, _own_terms(), ID, cfg=CFG).select(F.explode_outer("candidates.source").alias("source"))
    found = found.filter("source IS NOT NULL")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("c23_simple_parties")
def q_c23(spark, sf):
    return P.simple_parties(agreements(spark, sf), ID)


@register("c24_counterparty_address")
def q_c24(spark, sf):
    """The address behind the counterparty's name; names with regex characters among them."""
    a = agreements(spark, sf)
    name = F.regexp_extract("text", r"\b([A-Z]+ [A-Z][a-z]x (?:Ltd|Corporation|Industries))", 1)
    name = F.when(F.col("_pos") % 5 == 0, F.concat(F.lit("("), name, F.lit(".*")))\
        .when(F.col("_pos") % 5 == 1, F.concat(name, F.lit("\\E"))).otherwise(name)
    return a.select(ID, name.alias("name"), P.address_near(F.col("text"), name).alias("address"))


TERMS = {"initial": "Initial Term", "renewal": "Renewal Term", "effective": "Effective Date", "expiration": "Expiration Date",
         "termination": "Termination Date"}


@register("c12_terms")
def q_c12(spark, sf):
    """The lengths of the terms, and the clauses before their markers."""
    t = F.col("text")
    rows = _clauses(spark, sf).select(ID, *[D.snippet_before(t, TERMS[k]).alias(f"before_{k}") for k in ("initial", "renewal")],
                                      D.initial_term_of_text(t).alias("_initial"), D.renewal_term_of_text(t).alias("_renewal"),
                                      _own_terms().alias("terms"))
    rows = D.term_columns(rows, F.col("terms"), ID, TERMS)

    def term(k: str):
        snippet = F.coalesce(F.col(k), F.col(f"before_{k}"))
        return F.coalesce(D.duration(snippet), snippet, F.col(f"_{k}")).alias(f"{k}_term")

    return rows.select(ID, "before_initial", "before_renewal", term("initial"), term("renewal"))


@register("c6_key_dates")
def q_c6(spark, sf):
    """Dates of the defined terms, the effective date's fallbacks."""
    rows = _clauses(spark, sf).select(ID, "file_path", "pdf_created", D.text_dates(F.col("text")).alias("of_text"), _own_terms().alias("terms"))
    rows = D.term_columns(rows, F.col("terms"), ID, TERMS)
    d = D.key_dates(F.col("of_text"), F.col("effective"), F.col("expiration"), F.col("termination"))
    near = [F.col(f"of_text.{k}").alias(f"near_{k}") for k in ("expiration", "termination")]
    rows = rows.select(ID, "file_path", "pdf_created", d.alias("d"), *near)
    return rows.select(ID, "d.*", "near_expiration", "near_termination",
                       D.effective_date_chain(F.col("d.effective_date"), F.col("file_path"), F.col("pdf_created")).alias("effective_date_chain"))


@register("e7_path_context")
def q_e7(spark, sf):
    return agreements(spark, sf).select(ID, PT.document_context(F.col("file_path"), F.col("text")).alias("c")).select(ID, "c.*")


@register("e10_folders")
def q_e10(spark, sf):
    """The folders by depth, and what the agreement folder says."""
    a = agreements(spark, sf).select(ID, "_pos", PT.folders(F.col("file_path")).alias("f"))
    stored = F.when(F.col("_pos") % 3 == 0, "Unknown").otherwise("01/02/2003")
    return a.select(ID, "f.*", PT.folder_status(F.col("f.agreement"), F.lit("Active"), stored).alias("s")).select(
        ID, "company", "agreement", "company_clean", "s.*")


@register("e11_sides")
def q_e11(spark, sf):
    rows = _clauses(spark, sf).withColumn("f", PT.folders(F.col("file_path")))
    sides = PT.assign_sides(F.coalesce("primary_party_name", "our_name"), F.col("counterparty_name"), F.col("f.company"),
                            F.col("f.company_clean"), CFG)
    return rows.select(ID, sides.alias("s")).select(ID, "s.*")


@register("i4_name_dedupe")
def q_i4(spark, sf):
    """I4 (equality form) and I5 over the names known for a contract."""
    ct = contracts(spark, sf).select(ID, "counterparty_name", "parent_folder_name")
    a = agreements(spark, sf).select(F.col(ID).alias("id"), "our_name")
    rows = ct.join(a, ct[ID] == a["id"])
    names = F.array("counterparty_name", F.upper("counterparty_name"), "parent_folder_name", "our_name", F.lower("parent_folder_name"))
    rows = rows.select(ID, P.dedupe_names(names).alias("kept"))
    return rows.select(ID, F.array_join("kept", "|").alias("names"), F.array_join(P.ours_first(F.col("kept"), CFG), "|").alias("ours_first"))


@register("b20_table_summary")
def q_b20(spark, sf):
    """A document's tables: the lines of an order, one table for each return flag."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.struct("l_linenumber", cells.alias("r")).alias("x"))
    tables = rows.groupBy("l_orderkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("t"))
    docs = tables.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "t"))), lambda x: x["t"]).alias("t"))
    orders = table(spark, sf, "orders").select("o_orderkey")
    out = orders.join(docs, orders["o_orderkey"] == docs["l_orderkey"], "left").select("o_orderkey", PT.table_summary(F.col("t")).alias("s"))
    preview = [F.get("s.previews", F.lit(i)).alias(f"table_{i + 1}_preview") for i in range(3)]
    return out.select("o_orderkey", F.col("s.summary").alias("table_summary"), *preview)


@register("e29_entity_address")
def q_e29(spark, sf):
    """Our entity and its address on the contract's day."""
    a = agreements(spark, sf).withColumn("day", parse_date_export(F.col("effective_date")).cast("date"))
    stored = F.when(F.col("_pos") % 11 == 0, F.lit(" 1 Stored Road "))
    rows = AD.party_two(a, AD.address_book(spark, CFG), [F.col("our_name")], [stored], F.col("region"), "day", CFG)
    return rows.select(ID, F.date_format("day", "yyyy-MM-dd").alias("day"), "party2_name", "party2_address")


def export_rows(spark, sf):
    """The list export before the strict schema: the columns that the collection's operators give."""
    ct = contracts(spark, sf)
    a = agreements(spark, sf).withColumn("day", parse_date_export(F.col("effective_date")))
    reg = R.registry(ct, AS_OF, CFG).select(ID, "norm_id", "parent_registry_id", "hierarchy", "family")
    g = governance_columns(ct, "filename", "counterparty_name", "counterparty_address", "governing_law", "gdpr_applicable", "expiration_date")
    two = AD.party_two(a.select(ID, "_pos", "our_name", "region", "day"), AD.address_book(spark, CFG), [F.col("our_name")], [], F.col("region"), "day", CFG)
    rows = reg.join(g, ID).join(two, ID)
    k, text = F.col("_pos"), lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (F.col("_pos") % len(v) + 1).cast("int"))
    return rows.select(
        F.col("filename").alias("Name"), F.col("norm_id").alias("ContractId"), F.col("counterparty_name").alias("Party1 Name"),
        F.col("counterparty_address").alias("Party1 Address"), F.col("party2_name").alias("Party2 Name"),
        F.col("party2_address").alias("Party2 Address"), F.col("governing_law").alias("Jurisdiction"), F.col("day").alias("EffectiveDate"),
        F.to_timestamp("renewal_date").alias("RenewalDate"), parse_date_export(F.col("expiration_date")).alias("ExpirationDate"),
        F.lit(None).cast("timestamp").alias("ExecutionDate"), (k % 90).cast("double").alias("Notification Period in days"),
        F.when(k % 3 == 0, (k % 60).cast("double")).alias("PerpetualNoticeDays"), F.col("audit_flag").alias("Audit Flag"),
        F.col("lifecycle_stage").alias("Lifecycle Stage"), F.col("risk_level").alias("Risk Level"),
        F.col("gdpr_applicable").alias("GDPR_Applicable"), text("$1,250.50", "kr 900", "€7", "12 USD", "Unknown", None, "n/a", "£3").alias("ContractValue"),
        F.repeat(F.col("filename"), 50).alias("ContractSummary"), F.col("region").alias("CounterpartyRegion"),
        F.col("family").alias("ContractFamily"), F.col("parent_registry_id").alias("ParentContractId"),
        F.col("hierarchy").alias("ContractHierarchy"), F.col("days_to_expiry").alias("DaysToExpiry"),
        F.lit(None).cast("timestamp").alias("SOWStartDate"), F.lit(None).cast("timestamp").alias("SOWEndDate"), F.col("day").alias("ParentAgreementDate"),
        F.lit("not in the list").alias("InternalNote"))


@register("b11_strict_export")
def q_b11(spark, sf):
    out = L.strict_list(export_rows(spark, sf), CFG.id_prefix)
    return out.toDF(*[c.replace(" ", "_") for c in out.columns])


@register("e28_export_jurisdiction")
def q_e28_export(spark, sf):
    """E28 at export; two of the extra fields and the own jurisdiction by residues of the position."""
    ct = contracts(spark, sf)
    reg = R.registry(ct, AS_OF, CFG)
    inherited = R.inherit_terms(reg, ct.select(ID, "governing_law")).select(ID, "inherited_jurisdiction")
    rows = reg.select(ID, "hierarchy").join(ct.select(ID, "_pos", "governing_law", "counterparty_address", "region"), ID) \
        .join(inherited, ID, "left")
    k = F.col("_pos")
    extra = [F.when(k % 13 == 0, F.lit("Denmark")), F.when(k % 13 == 1, F.lit("N/A"))]
    own = F.when(k % 7 == 1, F.lit("Republic of Peru"))
    return rows.select(ID, export_jurisdiction(extra, F.col("governing_law"), own, F.col("hierarchy"), F.col("inherited_jurisdiction"),
                                               F.col("counterparty_address"), F.col("region")).alias("jurisdiction"))


@register("e26_notification_terms")
def q_e26_terms(spark, sf):
    """E25 and E26 with stored fields: numbers, texts and flags by residues of the position."""
    ct = contracts(spark, sf)
    k, terms = F.col("_pos"), F.col("payment_terms")
    kind = F.coalesce(F.nullif("contract_type", F.lit("")), F.lit("Unknown"))
    info = R.perpetual_info(kind, [F.when(k % 10 == 0, F.lit("an Evergreen term"))], [F.when(k % 9 == 0, F.lit("true")), F.lit(None).cast("string")],
                            F.when(k % 3 == 0, terms))
    days = R.notification_days([F.when(k % 5 == 0, (k % 90).cast("string")), F.when(k % 5 == 1, terms)], [F.when(k % 4 == 0, k % 50)], kind)
    buffer = R.notification_buffer([F.when(k % 6 == 0, F.lit(" ")), F.when(k % 6 == 0, F.lit("2 weeks")), F.when(k % 6 == 1, F.lit("17.9")), terms])
    return ct.select(ID, info.alias("i"), days.alias("notification_days"), buffer.alias("buffer_days")).select(
        ID, "i.*", "notification_days", "buffer_days")
