"""The ``contracts`` collection view over the driver's TPC-H-like tables.

The collection (one row per contract: identity, lineage, parties, dates in
mixed formats, terms, compliance flags and text) is derived from
``orders ⋈ customer ⋈ nation ⋈ region``.  The derivation is fixed input data
(see FIXTURES.md §2); ``CONTRACTS_CTE`` is the same statement in portable SQL
and is used by the DuckDB oracle.

Scale notes: orders is the fact side; customer joins on its key (sort-merge or
broadcast, chosen by AQE from runtime sizes); nation/region are tiny dimension
tables that the planner broadcasts from their file statistics.  The clause bank
is a literal array indexed by ``k % 7``: a projection, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dealt, table

# The seven-sentence clause bank of the fixture (FIXTURES.md §2).
CLAUSES = (
    'This Agreement is effective as of March 1, 2014 (the "Effective Date"). It shall automatically renew for additional one (1) year terms unless either party gives sixty (60) days prior written notice of non-renewal.',
    'The initial term of five (5) years (the "Initial Term") applies. Governed by the laws of the State of Delaware. Payment is due within 45 days.',
    'Either party may terminate this Agreement for convenience upon 30 days written notice. Supplier shall indemnify Customer. Limitation of Liability applies.',
    'This Agreement shall continue until terminated by either party. Unlimited liability. Contact jane.roe@example.com or 303-555-0147.',
    'Project start date shall be 25 November 2024 and shall end 28 February 2025, pursuant to the Master Services Agreement dated October 16, 2015.',
    'Confidentiality obligations survive. Restricted vendor: Blocked Vendor LLC. Minimum purchase of 500 units; exclusivity applies.',
    'No commercial terms.',
)

# Per-residue labels of the fixture columns.
CONTRACT_TYPES = (
    "Master Service Agreement (MSA)", "Non-Disclosure Agreement (NDA)",
    "Statement of Work (SOW)", "Amendment/Addendum", "Reseller Agreement",
    "Distributor Agreement", "OEM Agreement", "Unknown", None,
)
FILENAMES = (
    "Master Agreement.pdf", "SOW 12.docx", "Statement of Work #3.pdf",
    "Amendment 2.pdf", "Mutual NDA.pdf", "Schedule 4.pdf",
    "Processing Checklist.pdf", "SOW.pdf", "acme_sow_1.pdf",
    "Standard Terms.pdf", "Addendum.pdf", "agreement.pdf", "agreement.pdf",
)
ADDRESSES = (
    "12 Main Street, Boulder, CO 80301", "5 Lake Ave, Milwaukee",
    "1 High Street, England", "9 Hafenweg, Germany", "", None,
)
GDPR_VALUES = ("Yes", "No", "Unknown", None, "true")
LAW_VALUES = ("State of Delaware", "EMEA", "Unknown", "England and Wales", "", None)
PAYMENT_VALUES = ("30 days", "thirty (30) days", "2 months", "tbd", None, None, None)
TFC_VALUES = ("Yes", "No", "Unknown")


def _pick(values, idx: Column) -> Column:
    """``values[idx]`` as a column expression (NULL entries allowed)."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (idx + 1).cast("int"))


def contracts(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The collection; with ``spread`` its rows come in many even tasks."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    if spread:
        o = dealt(o, "o_orderkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    base = (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey))
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    iso = d.cast("string")
    stem = F.concat(
        F.col("c_mktsegment"), F.lit(" "),
        F.char(F.lit(65) + F.col("o_custkey") % 26),
        F.char(F.lit(97) + F.floor(F.col("o_custkey") / 26) % 26),
        F.lit("x"))
    base = base.select(k.alias("k"), d.alias("d"), iso.alias("iso"),
                       F.col("o_orderstatus").alias("st"), stem.alias("stem"),
                       "r_name", "n_nationkey")
    k = F.col("k")
    stem = F.col("stem")
    iso = F.col("iso")
    m11 = k % 11
    counterparty = (F.when(m11 == 0, F.lit("Unknown"))
                    .when(m11 == 1, F.concat(F.lit("## "), stem))
                    .when(m11 == 2, F.concat(stem, F.lit(" Inc")))
                    .when(m11 == 3, F.concat(stem, F.lit(" Holdings LLC")))
                    .otherwise(stem))
    m5 = k % 5
    eff = (F.when(m5 == 0, iso)
           .when(m5 == 1, F.concat(F.substring(iso, 6, 2), F.lit("/"),
                                   F.substring(iso, 9, 2), F.lit("/"),
                                   F.substring(iso, 1, 4)))
           .when(m5 == 2, F.lit("Unknown"))
           .when(m5 == 3, iso))
    exp = F.when(k % 4 != 3, F.date_add(F.col("d"), (k % 1500).cast("int")).cast("string"))
    region = (F.when(k % 13 == 2, F.lit("Unknown"))
              .when(k % 17 == 0, F.lit(None).cast("string"))
              .when(F.col("r_name") == "AMERICA", F.lit("North America"))
              .when(F.col("r_name") == "ASIA", F.lit("APAC"))
              .otherwise(F.lit("EMEA")))
    status = (F.when(k % 19 == 0, F.lit("Terminated"))
              .when(k % 23 == 0, F.lit("Draft"))
              .when(F.col("st") == "P", F.lit("Archive"))
              .otherwise(F.lit("Active")))
    return base.select(
        k.alias("_pos"),
        F.concat(F.lit("c-"), F.lpad(k.cast("string"), 9, "0")).alias("contract_id"),
        counterparty.alias("counterparty_name"),
        stem.alias("parent_folder_name"),
        _pick(CONTRACT_TYPES, k % 9).alias("contract_type"),
        _pick(FILENAMES, k % 13).alias("filename"),
        eff.alias("effective_date"),
        exp.alias("expiration_date"),
        region.alias("region"),
        _pick(ADDRESSES, F.col("n_nationkey") % 6).alias("counterparty_address"),
        _pick(GDPR_VALUES, k % 5).alias("gdpr_applicable"),
        _pick(LAW_VALUES, k % 6).alias("governing_law"),
        _pick(PAYMENT_VALUES, k % 7).alias("payment_terms"),
        _pick(TFC_VALUES, k % 3).alias("termination_for_convenience"),
        status.alias("contract_status"),
        (k % 23 == 0).alias("is_draft"),
        F.substring(F.md5(F.lower(stem)), 1, 12).alias("contract_group_id"),
        _pick(CLAUSES, k % 7).alias("text"),
    )


def contract_documents(spark: SparkSession, sf_dir: str, with_lineage: bool = False) -> DataFrame:
    """Contract text at a realistic size: document prose around the clause.

    ``text = doc + ' ' + clause + ' ' + doc`` where ``doc`` is the document with
    ``doc_id = _pos % count(documents)`` (left join; a missing doc gives '').
    The document count is a scalar subquery, the join a shuffled equi-join on
    the derived key (both sides grow with the data).
    """
    extra = ["filename", "parent_folder_name", "counterparty_address"] if with_lineage else []
    ct = contracts(spark, sf_dir, spread=True).select("_pos", "contract_id", *extra, F.col("text").alias("clause"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc"))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    joined = ct.join(docs, F.col("_pos") % n_docs == F.col("doc_id"), "left")
    doc = F.coalesce(F.col("doc"), F.lit(""))
    return joined.select(
        "_pos", "contract_id", *extra,
        F.concat(doc, F.lit(" "), F.col("clause"), F.lit(" "), doc).alias("text"))


# Portable SQL of the same view (DuckDB oracle; also runs in Spark SQL).
CONTRACTS_CTE = """clause(cid, clause_text) AS (VALUES
 (0,'This Agreement is effective as of March 1, 2014 (the "Effective Date"). It shall automatically renew for additional one (1) year terms unless either party gives sixty (60) days prior written notice of non-renewal.'),
 (1,'The initial term of five (5) years (the "Initial Term") applies. Governed by the laws of the State of Delaware. Payment is due within 45 days.'),
 (2,'Either party may terminate this Agreement for convenience upon 30 days written notice. Supplier shall indemnify Customer. Limitation of Liability applies.'),
 (3,'This Agreement shall continue until terminated by either party. Unlimited liability. Contact jane.roe@example.com or 303-555-0147.'),
 (4,'Project start date shall be 25 November 2024 and shall end 28 February 2025, pursuant to the Master Services Agreement dated October 16, 2015.'),
 (5,'Confidentiality obligations survive. Restricted vendor: Blocked Vendor LLC. Minimum purchase of 500 units; exclusivity applies.'),
 (6,'No commercial terms.')),
base AS (
 SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, o.o_orderstatus AS st,
        CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(10)) AS iso,
        CONCAT(c.c_mktsegment,' ',CHR(CAST(65+o.o_custkey%26 AS INT)),CHR(CAST(97+FLOOR(o.o_custkey/26)%26 AS INT)),'x') AS stem,
        r.r_name, n.n_nationkey
 FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey
 JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey),
contracts AS (
SELECT k AS _pos, CONCAT('c-',LPAD(CAST(k AS VARCHAR(20)),9,'0')) AS contract_id,
 CASE WHEN k%11=0 THEN 'Unknown' WHEN k%11=1 THEN CONCAT('## ',stem) WHEN k%11=2 THEN CONCAT(stem,' Inc')
      WHEN k%11=3 THEN CONCAT(stem,' Holdings LLC') ELSE stem END AS counterparty_name,
 stem AS parent_folder_name,
 CASE k%9 WHEN 0 THEN 'Master Service Agreement (MSA)' WHEN 1 THEN 'Non-Disclosure Agreement (NDA)' WHEN 2 THEN 'Statement of Work (SOW)'
   WHEN 3 THEN 'Amendment/Addendum' WHEN 4 THEN 'Reseller Agreement' WHEN 5 THEN 'Distributor Agreement' WHEN 6 THEN 'OEM Agreement'
   WHEN 7 THEN 'Unknown' ELSE NULL END AS contract_type,
 CASE k%13 WHEN 0 THEN 'Master Agreement.pdf' WHEN 1 THEN 'SOW 12.docx' WHEN 2 THEN 'Statement of Work #3.pdf' WHEN 3 THEN 'Amendment 2.pdf'
   WHEN 4 THEN 'Mutual NDA.pdf' WHEN 5 THEN 'Schedule 4.pdf' WHEN 6 THEN 'Processing Checklist.pdf' WHEN 7 THEN 'SOW.pdf'
   WHEN 8 THEN 'acme_sow_1.pdf' WHEN 9 THEN 'Standard Terms.pdf' WHEN 10 THEN 'Addendum.pdf' ELSE 'agreement.pdf' END AS filename,
 CASE k%5 WHEN 0 THEN iso WHEN 1 THEN CONCAT(SUBSTR(iso,6,2),'/',SUBSTR(iso,9,2),'/',SUBSTR(iso,1,4)) WHEN 2 THEN 'Unknown' WHEN 3 THEN iso ELSE NULL END AS effective_date,
 CASE WHEN k%4=3 THEN NULL ELSE CAST(d + CAST(k%1500 AS INT) AS VARCHAR(10)) END AS expiration_date,
 CASE WHEN k%13=2 THEN 'Unknown' WHEN k%17=0 THEN NULL WHEN r_name='AMERICA' THEN 'North America' WHEN r_name='ASIA' THEN 'APAC' ELSE 'EMEA' END AS region,
 CASE n_nationkey%6 WHEN 0 THEN '12 Main Street, Boulder, CO 80301' WHEN 1 THEN '5 Lake Ave, Milwaukee' WHEN 2 THEN '1 High Street, England' WHEN 3 THEN '9 Hafenweg, Germany'
   WHEN 4 THEN '' ELSE NULL END AS counterparty_address,
 CASE k%5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Unknown' WHEN 3 THEN NULL ELSE 'true' END AS gdpr_applicable,
 CASE k%6 WHEN 0 THEN 'State of Delaware' WHEN 1 THEN 'EMEA' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'England and Wales' WHEN 4 THEN '' ELSE NULL END AS governing_law,
 CASE k%7 WHEN 0 THEN '30 days' WHEN 1 THEN 'thirty (30) days' WHEN 2 THEN '2 months' WHEN 3 THEN 'tbd' ELSE NULL END AS payment_terms,
 CASE k%3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unknown' END AS termination_for_convenience,
 CASE WHEN k%19=0 THEN 'Terminated' WHEN k%23=0 THEN 'Draft' WHEN st='P' THEN 'Archive' ELSE 'Active' END AS contract_status,
 (k%23=0) AS is_draft, SUBSTR(MD5(LOWER(stem)),1,12) AS contract_group_id,
 cl.clause_text AS text
FROM base JOIN clause cl ON cl.cid = k%7),
contract_documents AS (
 SELECT ct._pos, ct.contract_id, ct.filename, ct.parent_folder_name, ct.counterparty_address,
        CONCAT(COALESCE(dd.text,''),' ',ct.text,' ',COALESCE(dd.text,'')) AS text
 FROM contracts ct LEFT JOIN documents dd
   ON dd.doc_id = ct._pos % (SELECT COUNT(*) FROM documents))"""
