"""Portable SQL (DuckDB dialect) used as the correctness oracle.

Each entry re-derives one registered query from the driver tables with plain
SQL, independently of the DataFrame code.  The shared CTEs below rebuild the
fixture collection and the BI fact table.
"""

from __future__ import annotations

from ..sources.contracts import CONTRACTS_CTE

AS_OF = "TIMESTAMP '2000-01-01 10:00:00'"


def _pk(default: str | None, *cols: str, missing=("", "Unknown")) -> str:
    miss = ", ".join(f"'{m}'" for m in missing)
    parts = [f"CASE WHEN {c} NOT IN ({miss}) THEN {c} END" for c in cols]
    d = "NULL" if default is None else f"'{default}'"
    return f"COALESCE({', '.join(parts)}, {d})"


def _bi_date(c: str) -> str:
    fmts = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%B %d, %Y", "%Y")
    tries = ", ".join(f"try_strptime({c}, '{f}')" for f in fmts)
    return (f"CASE WHEN {c} IS NULL OR {c} IN ('', 'Unknown', 'Not specified') THEN NULL "
            f"ELSE COALESCE({tries}) END")


def _days(c: str) -> str:
    return f"CAST(floor((epoch_us({c}) - epoch_us({AS_OF})) / 86400000000.0) AS INTEGER)"


FACT_CTE = CONTRACTS_CTE + f""",
fact0 AS (
 SELECT *, {_bi_date('effective_date')} AS eff_ts, {_bi_date('expiration_date')} AS exp_ts
 FROM contracts),
fact1 AS (
 SELECT *, {_days('exp_ts')} AS days_raw,
   {_pk('Unknown', 'parent_folder_name')} AS cpty,
   {_pk('Unknown', 'governing_law')} AS law,
   {_pk('Unknown', 'termination_for_convenience')} AS tfc,
   COALESCE(gdpr_applicable IN ('Yes', 'True', '1'), FALSE) AS gdpr
 FROM fact0),
fact AS (
 SELECT contract_id,
   {_pk('Unknown', 'filename')} AS document_name,
   '' AS file_path,
   {_pk('Unknown', 'parent_folder_name')} AS company_folder,
   'Our Company' AS party_primary,
   cpty AS party_counterparty,
   '' AS all_parties,
   {_pk('Unknown', 'contract_type')} AS contract_type,
   'Unknown' AS document_role,
   {_pk('Active', 'contract_status')} AS status,
   FALSE AS terminated,
   eff_ts AS effective_date, exp_ts AS expiration_date,
   CAST(NULL AS TIMESTAMP) AS termination_date, CAST(NULL AS TIMESTAMP) AS ingestion_date,
   COALESCE(days_raw, 0) AS days_until_expiration,
   COALESCE(days_raw < 0, FALSE) AS is_expired,
   COALESCE(days_raw >= 0 AND days_raw <= 90, FALSE) AS is_expiring_soon,
   tfc AS termination_for_convenience,
   'Unknown' AS auto_renewal,
   law AS governing_law,
   {_pk('', 'payment_terms')} AS payment_terms,
   {_pk('Unknown', 'region')} AS region,
   gdpr AS gdpr_applicable,
   '' AS gdpr_reason,
   {_pk('', 'parent_folder_name')} AS parent_folder,
   '' AS grandparent_folder, '' AS sequence_label, '' AS relationship_hints,
   '' AS sharepoint_owner, 'Legal' AS sharepoint_department,
   CAST(0.0 AS DOUBLE) AS contract_value_usd,
   CAST(LEAST(
     CASE WHEN days_raw IS NULL THEN 0 WHEN days_raw < 0 THEN 40 WHEN days_raw < 30 THEN 30
          WHEN days_raw < 90 THEN 20 WHEN days_raw < 180 THEN 10 ELSE 0 END
     + CASE WHEN eff_ts IS NULL THEN 10 ELSE 0 END
     + CASE WHEN cpty IS NULL OR cpty IN ('', 'Unknown') THEN 10 ELSE 0 END
     + CASE WHEN law IS NULL OR law IN ('', 'Unknown') THEN 10 ELSE 0 END
     + CASE WHEN gdpr THEN 15 ELSE 0 END
     + CASE WHEN tfc = 'No' THEN 15 ELSE 0 END, 100) AS INTEGER) AS risk_score,
   CASE WHEN text IS NULL OR text = '' THEN 0 ELSE length(text) END AS text_length,
   0 AS page_count
 FROM fact1)"""


def with_fact(select: str, ctes: str = "") -> str:
    """``WITH <fixture + fact CTEs>[, extra CTEs] <select>``."""
    extra = f",\n{ctes.strip()}" if ctes.strip() else ""
    return f"WITH {FACT_CTE}{extra}\n{select}"


TS = "'%Y-%m-%d %H:%M:%S'"

ORACLE: dict[str, str] = {}

ORACLE["b10_fact_table"] = with_fact(f"""
SELECT contract_id, document_name, file_path, company_folder, party_primary, party_counterparty,
  all_parties, contract_type, document_role, status, terminated,
  strftime(effective_date, {TS}) AS effective_date, strftime(expiration_date, {TS}) AS expiration_date,
  strftime(termination_date, {TS}) AS termination_date, strftime(ingestion_date, {TS}) AS ingestion_date,
  days_until_expiration, is_expired, is_expiring_soon, termination_for_convenience, auto_renewal,
  governing_law, payment_terms, region, gdpr_applicable, gdpr_reason, parent_folder,
  grandparent_folder, sequence_label, relationship_hints, sharepoint_owner, sharepoint_department,
  contract_value_usd, risk_score, text_length, page_count
FROM fact""")

ORACLE["k1_portfolio_kpis"] = with_fact("""
SELECT COUNT(*) AS total_contracts,
  COUNT(*) FILTER (WHERE status = 'Active') AS active_contracts,
  COUNT(*) FILTER (WHERE terminated) AS terminated_contracts,
  COUNT(*) FILTER (WHERE is_expiring_soon) AS expiring_soon,
  COUNT(*) FILTER (WHERE is_expired) AS expired_contracts,
  ROUND(AVG(risk_score), 6) AS avg_risk_score,
  COUNT(*) FILTER (WHERE risk_score >= 70) AS high_risk_contracts,
  COUNT(*) FILTER (WHERE gdpr_applicable) AS gdpr_contracts,
  COUNT(DISTINCT company_folder) AS unique_companies
FROM fact""")

ORACLE["k2_counts_by_type"] = with_fact("""
SELECT contract_type, COUNT(*) AS n_contracts FROM fact GROUP BY contract_type""")

ORACLE["k2_counts_by_region"] = with_fact("""
SELECT region, COUNT(*) AS n_contracts FROM fact GROUP BY region""")

ORACLE["k3_dax_measures"] = with_fact("""
SELECT COUNT(*) AS total_contracts,
  COUNT(*) FILTER (WHERE status = 'Active' AND NOT is_expired) AS active_contracts,
  COUNT(*) FILTER (WHERE is_expiring_soon) AS expiring_soon,
  ROUND(AVG(risk_score), 6) AS avg_risk_score,
  COUNT(*) FILTER (WHERE is_expired) + COUNT(*) FILTER (WHERE days_until_expiration <= 30 AND NOT is_expired) AS critical_alerts,
  COUNT(*) FILTER (WHERE is_expired) + COUNT(*) FILTER (WHERE days_until_expiration <= 30 AND NOT is_expired AND expiration_date IS NOT NULL) AS critical_alerts_strict
FROM fact""")

ORACLE["k4_top_companies"] = with_fact("""
SELECT company_folder, COUNT(*) AS n_contracts FROM fact GROUP BY company_folder
ORDER BY n_contracts DESC, company_folder LIMIT 10""")

ORACLE["k5_expirations_by_month"] = with_fact("""
SELECT strftime(expiration_date, '%Y-%m') AS expiration_month, status, COUNT(*) AS n_contracts
FROM fact WHERE expiration_date IS NOT NULL GROUP BY 1, 2""")

ORACLE["k6_status_distribution"] = with_fact("""
SELECT status, COUNT(*) AS n_contracts,
  ROUND(COUNT(*) / (SELECT COUNT(*) FROM fact), 6) AS share
FROM fact GROUP BY status""")

ORACLE["k7_risk_matrix"] = with_fact(ctes="""
firsts AS (SELECT DISTINCT company_folder FROM fact ORDER BY company_folder LIMIT 20),
rows_ AS (SELECT f.company_folder, COALESCE(f.contract_type, 'Unknown') AS contract_type, f.risk_score
          FROM fact f JOIN firsts USING (company_folder)),
types AS (SELECT DISTINCT contract_type FROM rows_),
means AS (SELECT company_folder, contract_type, AVG(risk_score) AS m FROM rows_ GROUP BY 1, 2)""", select="""
SELECT g.company_folder, t.contract_type, ROUND(COALESCE(m.m, 0.0), 6) AS avg_risk
FROM firsts g CROSS JOIN types t
LEFT JOIN means m ON m.company_folder = g.company_folder AND m.contract_type = t.contract_type""")

ORACLE["k8_gdpr_distribution"] = with_fact("""
SELECT region, gdpr_applicable, COUNT(*) AS n_contracts,
  region || chr(10) || CASE WHEN gdpr_applicable THEN 'GDPR' ELSE 'Non-GDPR' END || chr(10)
    || CAST(COUNT(*) AS VARCHAR) || ' contracts' AS label
FROM fact GROUP BY region, gdpr_applicable""")

ORACLE["k9_lifecycle_funnel"] = with_fact(ctes="""
stages(stage_order, stage) AS (VALUES (0,'Draft'),(1,'Active'),(2,'Expiring Soon'),(3,'Expired'),(4,'Terminated')),
sc AS (SELECT status AS stage, COUNT(*) AS n FROM fact GROUP BY status),
soon AS (SELECT 'Expiring Soon' AS stage, COUNT(*) FILTER (WHERE is_expiring_soon) AS n FROM fact),
cnt AS (SELECT stage, n FROM sc UNION ALL
        SELECT stage, n FROM soon WHERE n > 0 AND stage NOT IN (SELECT stage FROM sc)),
st AS (SELECT s.stage_order, s.stage, c.n AS n_contracts FROM stages s JOIN cnt c USING (stage))""", select="""
SELECT stage_order, stage, n_contracts, ROUND(n_contracts / (SELECT MAX(n_contracts) FROM st), 6) AS width
FROM st""")

ORACLE["k10_expiration_calendar"] = with_fact(ctes="""
cells AS (SELECT CAST(i // 12 AS INTEGER) AS year_offset, CAST(i % 12 + 1 AS INTEGER) AS month FROM range(24) t(i)),
m AS (SELECT date_trunc('month', expiration_date) AS mo, COUNT(*) AS n FROM fact
      WHERE expiration_date >= DATE '2000-01-01' AND expiration_date < DATE '2002-01-01' GROUP BY 1)""", select="""
SELECT c.year_offset, c.month, COALESCE(m.n, 0) AS n_contracts
FROM cells c LEFT JOIN m ON year(m.mo) - 2000 = c.year_offset AND month(m.mo) = c.month""")

ORACLE["k11_expiration_timeline"] = with_fact(f"""
SELECT contract_id, document_name, status, strftime(effective_date, {TS}) AS effective_date,
  strftime(expiration_date, {TS}) AS expiration_date,
  CAST(date_diff('day', effective_date, expiration_date) AS INTEGER) AS duration_days,
  risk_score > 70 AS emphasis
FROM fact WHERE effective_date IS NOT NULL AND expiration_date IS NOT NULL
ORDER BY fact.expiration_date, contract_id LIMIT 30""")

ORACLE["k12_party_network"] = with_fact(ctes="""
e AS (SELECT LEAST(party_primary, party_counterparty) AS a, GREATEST(party_primary, party_counterparty) AS b,
             COUNT(*) AS n FROM fact
        WHERE party_counterparty IS NOT NULL AND party_counterparty NOT IN ('Unknown', '') GROUP BY 1, 2),
ends AS (SELECT a AS node, n FROM e UNION ALL SELECT b AS node, n FROM e)""", select="""
SELECT node, COUNT(*) AS degree, CAST(SUM(n) AS BIGINT) AS n_contracts FROM ends GROUP BY node""")

ORACLE["k14_owner_digest"] = with_fact(f"""
SELECT CASE WHEN sharepoint_owner = '' THEN 'Unassigned' ELSE sharepoint_owner END AS owner,
  contract_id, document_name, company_folder AS company,
  strftime(expiration_date, {TS}) AS expiration_date, days_until_expiration, risk_score
FROM fact WHERE is_expiring_soon AND days_until_expiration <= 90""")

ORACLE["k15_sliced_kpis"] = with_fact("""
SELECT COUNT(*) AS total_contracts,
  COUNT(*) FILTER (WHERE status = 'Active') AS active_contracts,
  COUNT(*) FILTER (WHERE is_expired) AS expired_contracts,
  ROUND(AVG(risk_score), 6) AS avg_risk_score,
  COUNT(DISTINCT company_folder) AS unique_companies
FROM fact WHERE region IN ('EMEA', 'APAC')
  AND contract_type IN ('Master Service Agreement (MSA)', 'Reseller Agreement', 'Unknown')
  AND expiration_date >= TIMESTAMP '1997-01-01' AND expiration_date <= TIMESTAMP '2001-12-31'""")

ORACLE["e40_high_risk_list"] = with_fact("""
SELECT contract_id, company_folder, risk_score FROM fact WHERE risk_score >= 70""")

ORACLE["e42_display_bands"] = with_fact("""
SELECT contract_id, days_until_expiration, risk_score,
  CASE WHEN days_until_expiration < 30 THEN 'red' WHEN days_until_expiration <= 60 THEN 'yellow'
       ELSE 'green' END AS days_band,
  risk_score > 70 AS risk_flag
FROM fact""")


# ------------------------------------------------------------------ gaps (G*)
GAP_FIELDS = ("auto_renewal", "perpetual", "perpetual_notice_period", "renewal_notice_period",
              "termination_notice_period", "termination_for_convenience_notice", "payment_terms",
              "gdpr_applicable", "subject_to_gdpr", "counterparty_address", "primary_party_address",
              "governing_law", "counterparty_name", "primary_party_name")
GAP_PRESENT = ("payment_terms", "gdpr_applicable", "counterparty_address", "governing_law",
               "counterparty_name")
_MISS = "('', 'unknown', 'n/a', 'na', 'not found', 'tbd', 'pending')"


def _m(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN {_MISS})"


def _gap_ctes() -> str:
    raw = ", ".join(
        (f"CASE WHEN {_m(f)} THEN '{f}' END" if f in GAP_PRESENT else f"'{f}'") for f in GAP_FIELDS)
    keys = ("master service agreement", "msa", "master sales agreement", "distributor agreement",
            "oem agreement", "partner program agreement", "reseller agreement", "master agreement")
    master = " OR ".join(f"contains(combined, '{k}')" for k in keys)
    inh = ", ".join(
        f"CASE WHEN list_contains(filtered, '{f}') AND NOT {_m('p_' + f)} THEN '{f}' END" for f in GAP_PRESENT)
    inh_pairs = ", ".join(
        f"CASE WHEN list_contains(filtered, '{f}') AND NOT {_m('p_' + f)} THEN '{f}=' || p_{f} END"
        for f in GAP_PRESENT)
    pcols = ", ".join(
        f"CASE WHEN c.is_child THEN CASE WHEN m1.contract_id <> c.contract_id THEN m1.{f} ELSE m2.{f} END END AS p_{f}"
        for f in GAP_PRESENT)
    fl = ", ".join(GAP_PRESENT)
    return f"""
g0 AS (SELECT _pos, contract_id, contract_group_id AS group_id, is_draft, {fl},
         lower(trim(coalesce(contract_type, ''))) AS ctype, lower(trim(coalesce(filename, ''))) AS fname
       FROM contracts),
g1 AS (SELECT *, concat_ws(' ', nullif(ctype, ''), nullif(fname, '')) AS combined FROM g0),
g2 AS (SELECT *, ({master}) AS is_master,
         (contains(ctype, 'statement of work') OR contains(' ' || fname || ' ', ' sow')) AS is_sow,
         contains(fname, 'schedule') AS is_schedule,
         (contains(combined, 'nda') OR contains(combined, 'non-disclosure') OR contains(combined, 'confidentiality')) AS is_nda
       FROM g1),
g3 AS (SELECT *, (contains(combined, 'change order') OR (is_schedule AND NOT is_master)) AS is_amendment FROM g2),
g4 AS (SELECT *,
         list_filter([CASE WHEN is_master THEN 'master' END, CASE WHEN is_sow AND NOT is_master THEN 'sow' END,
                      CASE WHEN is_amendment THEN 'amendment' END,
                      CASE WHEN is_schedule AND NOT is_amendment THEN 'schedule' END,
                      CASE WHEN is_nda THEN 'nda' END], lambda x: x IS NOT NULL) AS cats,
         list_filter([{raw}], lambda x: x IS NOT NULL) AS raw_missing,
         ((is_sow AND NOT is_master) OR is_amendment OR (is_schedule AND NOT is_amendment)) AS is_child
       FROM g3),
gm AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY _pos) AS rn FROM g4
       WHERE is_master AND group_id IS NOT NULL AND group_id <> ''),
m1 AS (SELECT * FROM gm WHERE rn = 1), m2 AS (SELECT * FROM gm WHERE rn = 2),
g5 AS (SELECT c._pos, c.contract_id, c.cats, c.raw_missing,
         CASE WHEN list_contains(c.cats, 'nda') AND list_contains(c.raw_missing, 'payment_terms')
              THEN ['payment_terms'] ELSE [] END AS suppressed,
         list_filter(c.raw_missing, lambda x: NOT (list_contains(c.cats, 'nda') AND x = 'payment_terms')) AS filtered,
         CASE WHEN c.is_child THEN CASE WHEN m1.contract_id <> c.contract_id THEN m1.contract_id ELSE m2.contract_id END END AS parent_id,
         {pcols}
       FROM g4 c LEFT JOIN m1 ON m1.group_id = c.group_id LEFT JOIN m2 ON m2.group_id = c.group_id
       WHERE NOT coalesce(c.is_draft, FALSE) AND len(c.raw_missing) > 0),
g6 AS (SELECT *, list_filter([{inh}], lambda x: x IS NOT NULL) AS inherited,
         list_filter([{inh_pairs}], lambda x: x IS NOT NULL) AS inherited_pairs FROM g5),
gaps AS (SELECT *, list_filter(filtered, lambda x: NOT list_contains(inherited, x)) AS missing FROM g6
         WHERE len(list_filter(filtered, lambda x: NOT list_contains(inherited, x))) > 0 OR len(inherited) > 0)"""


_GAP_SELECT = """
SELECT contract_id, array_to_string(missing, ',') AS missing_fields,
  array_to_string(suppressed, ',') AS suppressed_fields, array_to_string(cats, ',') AS categories,
  array_to_string(inherited_pairs, ';') AS inherited,
  CASE WHEN len(inherited) > 0 THEN parent_id END AS inherited_from,
  CAST(len(missing) AS INTEGER) AS n_missing
FROM gaps"""

ORACLE["g1_gap_scan"] = with_fact(_GAP_SELECT, ctes=_gap_ctes())
ORACLE["g6_work_list"] = with_fact(_GAP_SELECT + " ORDER BY len(missing) DESC, _pos LIMIT 20",
                                   ctes=_gap_ctes())
ORACLE["g5_gap_summary"] = with_fact("""
SELECT field, CAST(SUM(m) AS BIGINT) AS contracts_missing, CAST(SUM(i) AS BIGINT) AS contracts_inherited FROM (
  SELECT unnest(missing) AS field, 1 AS m, 0 AS i FROM gaps
  UNION ALL SELECT unnest(inherited) AS field, 0 AS m, 1 AS i FROM gaps) GROUP BY field""", ctes=_gap_ctes())


# ------------------------------------------------------------- registry
def _sqlq(s: str) -> str:
    return s.replace("'", "''")


def _garbage_sql(x: str) -> str:
    from ..functions.textrules import CONTRACT_PHRASES, OCR_PATTERNS_EXPORT, SENTENCE_CUES
    t = f"trim({x})"
    ocr = "|".join(f"(?:{p})" for p in OCR_PATTERNS_EXPORT)
    phr = "|".join(f"(?:{p})" for p in CONTRACT_PHRASES)
    cues = " OR ".join(f"contains(lower({t}), '{c}')" for c in SENTENCE_CUES)
    return (f"({x} IS NULL OR length({x}) < 2 OR regexp_matches({t}, '{_sqlq(ocr)}') "
            f"OR (length({t}) > 10 AND length(regexp_replace({t}, '[^\\p{{Nd}}#@$%^&*_+={{}}\\[\\]|\\\\`]', '', 'g'))"
            f" > length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))) "
            f"OR length({t}) > 150 OR regexp_matches(lower({t}), '{_sqlq(phr)}') "
            f"OR (regexp_matches(left({t}, 1), '^\\p{{Ll}}') AND left({t}, 1) <> 'e') OR {cues})")


def _norm_name_sql(x: str) -> str:
    from ..operators.registry import NAME_SUFFIXES
    suf = ", ".join(f"'{s}'" for s in NAME_SUFFIXES)
    return (f"array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(trim({x})), "
            f"'[^a-zA-Z0-9\\s]', '', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ({suf})), '')")


def _registry_ctes() -> str:
    from ..operators import registry as R
    ncf = "|".join(f"(?:{p})" for p in R.NON_CONTRACT_PATTERNS)
    sowf = "|".join(f"(?:{p})" for p in R.SOW_FILE_PATTERNS)

    def has(c, words):
        return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    hier = (f"CASE WHEN regexp_matches(f, '{sowf}') THEN 'SOW' "
            f"WHEN {has('f', R.AMENDMENT_FILE_WORDS)} THEN 'Amendment' "
            f"WHEN {has('f', R.NDA_FILE_WORDS)} THEN 'NDA' WHEN {has('f', R.MSA_FILE_WORDS)} THEN 'MSA' "
            f"WHEN {has('f', R.SCHEDULE_FILE_WORDS)} THEN 'Schedule' "
            f"WHEN {has('t', R.SOW_TYPE_WORDS)} THEN 'SOW' WHEN {has('t', R.AMENDMENT_TYPE_WORDS)} THEN 'Amendment' "
            f"WHEN {has('t', R.NDA_TYPE_WORDS)} THEN 'NDA' WHEN {has('t', R.MSA_TYPE_WORDS)} THEN 'MSA' "
            f"ELSE 'Standalone' END")
    exact = " ".join(f"WHEN tt = '{k}' THEN '{v}'" for k, v in R.TYPE_CODES)
    partial = " ".join(f"WHEN contains(tt, '{k}') OR contains('{k}', tt) THEN '{v}'" for k, v in R.TYPE_CODES)
    tcode = (f"CASE WHEN hierarchy = 'SOW' THEN 'SOW' WHEN hierarchy = 'Amendment' THEN 'AMD' "
             f"WHEN hierarchy = 'NDA' THEN 'NDA' ELSE CASE {exact} ELSE CASE {partial} ELSE 'MSA' END END END")

    def num(pats):
        return "COALESCE(" + ", ".join(
            f"TRY_CAST(NULLIF(regexp_extract(f, '{p}', 1), '') AS INTEGER)" for p in pats) + ")"
    pnum = (f"CASE WHEN hierarchy = 'SOW' THEN {num(R.SOW_NUMBER_PATTERNS)} "
            f"WHEN hierarchy = 'Amendment' THEN {num(R.AMENDMENT_NUMBER_PATTERNS)} "
            f"WHEN hierarchy = 'Schedule' THEN {num(R.SCHEDULE_NUMBER_PATTERNS)} END")
    fmts = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y")
    eff = ("CASE WHEN effective_date IS NULL OR effective_date IN ('', 'Unknown', 'Not specified', 'Not found') "
           "THEN NULL ELSE COALESCE(" + ", ".join(f"try_strptime(trim(effective_date), '{f}')" for f in fmts) + ") END")
    part = ("trim(string_split_regex(regexp_replace(filename, '(?i)\\.(pdf|docx?|xlsx?)$', ''), "
            "'(?i)\\s*[-_]\\s*|\\s+(?:Agreement|Contract|NDA|MSA|SOW)\\b')[1])")
    cp = (f"COALESCE(CASE WHEN coalesce(counterparty_name, '') <> '' AND NOT {_garbage_sql('counterparty_name')} "
          f"THEN trim(counterparty_name) END, "
          f"CASE WHEN coalesce(parent_folder_name, '') <> '' AND NOT {_garbage_sql('parent_folder_name')} "
          f"THEN trim(parent_folder_name) END, "
          f"CASE WHEN length({part}) >= 3 AND NOT {_garbage_sql(part)} THEN {part} END, 'Unknown')")
    h_order = "CASE hierarchy WHEN 'MSA' THEN 0 WHEN 'NDA' THEN 1 WHEN 'Standalone' THEN 2 WHEN 'SOW' THEN 3 WHEN 'Amendment' THEN 4 ELSE 5 END"
    pfx = "CTR"
    return f"""
r0 AS (SELECT *, lower(coalesce(filename, '')) AS f, lower(coalesce(contract_type, 'Unknown')) AS t,
         {eff} AS effective_ts
       FROM contracts WHERE NOT regexp_matches(lower(coalesce(filename, '')), '{_sqlq(ncf)}')),
r1 AS (SELECT *, {hier} AS hierarchy, {cp} AS counterparty,
         coalesce(nullif(parent_folder_name, ''), '') AS folder,
         (coalesce(is_draft, FALSE) OR contains(lower(coalesce(contract_status, '')), 'draft')) AS draft
       FROM r0),
r2 AS (SELECT *, {h_order} AS h_order, coalesce(effective_ts, TIMESTAMP '1900-01-01') AS sort_date,
         lower(trim(coalesce(contract_type, 'Unknown'))) AS tt,
         coalesce(effective_ts < TIMESTAMP '1998-01-01', TRUE) AS legacy,
         coalesce(strftime(effective_ts, '%y%m'), '0001') AS yymm
       FROM r1),
r3 AS (SELECT *, {tcode} AS type_code, {pnum} AS parsed_num,
         CASE WHEN counterparty = '' OR counterparty = 'Unknown' OR {_garbage_sql('counterparty')}
              THEN coalesce(nullif(folder, ''), 'Unknown') ELSE counterparty END AS fam_src
       FROM r2),
r4 AS (SELECT *, coalesce(nullif(left(regexp_replace(fam_src, '[^a-zA-Z0-9]', '', 'g'), 20), ''), 'Unknown')
         || '-' || coalesce(CAST(year(effective_ts) AS VARCHAR), '2000') AS family,
         {_norm_name_sql('counterparty')} AS cname,
         CASE WHEN folder <> '' THEN {_norm_name_sql('folder')} END AS fname_norm
       FROM r3),
par AS (SELECT _pos, cname, fname_norm, CASE WHEN hierarchy = 'MSA' THEN 0 ELSE 1 END AS k0, h_order, sort_date
        FROM r4 WHERE hierarchy IN ('MSA', 'NDA', 'Standalone')),
pn AS (SELECT cname AS name, k0, h_order, sort_date, _pos FROM par
       UNION ALL SELECT fname_norm, k0, h_order, sort_date, _pos FROM par WHERE fname_norm IS NOT NULL),
pdn AS (SELECT DISTINCT name FROM pn),
chd AS (SELECT * FROM r4 WHERE hierarchy IN ('SOW', 'Amendment', 'Schedule')),
cdn AS (SELECT DISTINCT cname AS c FROM chd),
mt AS (SELECT c, name FROM cdn JOIN pdn ON c = name OR (c <> '' AND name <> '' AND (contains(name, c) OR contains(c, name)))),
cand AS (SELECT mt.c, pn.k0, pn.h_order, pn.sort_date, pn._pos AS ppos FROM mt JOIN pn ON pn.name = mt.name),
bestc AS (SELECT c, ppos FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k0, h_order, sort_date, ppos) AS rn FROM cand) WHERE rn = 1),
r5 AS (SELECT r4.*, CASE WHEN r4.hierarchy IN ('SOW', 'Amendment', 'Schedule') THEN b.ppos END AS parent_pos
       FROM r4 LEFT JOIN bestc b ON b.c = r4.cname),
sq AS (SELECT _pos, row_number() OVER (ORDER BY h_order, sort_date, _pos) AS seq FROM r5
       WHERE hierarchy NOT IN ('SOW', 'Amendment', 'Schedule') OR parent_pos IS NULL),
rn AS (SELECT _pos, row_number() OVER (PARTITION BY parent_pos, hierarchy ORDER BY h_order, sort_date, _pos) AS run_num
       FROM r5 WHERE hierarchy IN ('SOW', 'Amendment', 'Schedule') AND parent_pos IS NOT NULL AND parsed_num IS NULL),
r6 AS (SELECT r5.*, sq.seq, coalesce(r5.parsed_num, rn.run_num, 1) AS child_num,
         CASE WHEN legacy THEN '-LEG' ELSE '' END AS leg
       FROM r5 LEFT JOIN sq USING (_pos) LEFT JOIN rn USING (_pos)),
r7 AS (SELECT *, CASE WHEN seq IS NOT NULL THEN
         '{pfx}-' || type_code || '-' || yymm || '-' || printf('%04d', seq)
         || CASE WHEN hierarchy NOT IN ('SOW', 'Amendment', 'Schedule') AND draft THEN '-D01' ELSE '' END || leg END AS own_id
       FROM r6),
r8 AS (SELECT c.*, p.own_id AS parent_id FROM r7 c LEFT JOIN r7 p ON p._pos = c.parent_pos),
r9 AS (SELECT *, CASE WHEN hierarchy IN ('SOW', 'Amendment', 'Schedule') AND parent_id IS NOT NULL THEN
         replace(parent_id, '-LEG', '') || '-' || CASE hierarchy WHEN 'SOW' THEN 'SOW' WHEN 'Amendment' THEN 'A' ELSE 'SCH' END
         || CASE WHEN child_num > 0 THEN printf('%02d', child_num) ELSE '01' END || leg ELSE own_id END AS registry_id,
         CASE WHEN hierarchy IN ('SOW', 'Amendment', 'Schedule') AND parent_pos IS NULL
              THEN 'Missing Parent Link - ' || hierarchy || ' without governing MSA' ELSE '' END AS id_notes
       FROM r8),
r10 AS (SELECT *, CASE WHEN contains(registry_id, '-LEG') THEN rtrim(replace(registry_id, '-LEG', ''), '-') || '-LEG'
                  ELSE registry_id END AS norm_id FROM r9),
fam AS (SELECT family, arg_min(norm_id, [CASE hierarchy WHEN 'MSA' THEN 0 WHEN 'Standalone' THEN 1 ELSE 2 END,
                 epoch_us(coalesce(effective_ts, TIMESTAMP '9999-12-31')), h_order, epoch_us(sort_date), _pos]) AS family_parent_id
        FROM r10 WHERE hierarchy IN ('MSA', 'NDA', 'Standalone') GROUP BY family),
r11 AS (SELECT r10.*, fam.family_parent_id FROM r10 LEFT JOIN fam USING (family)),
registry AS (SELECT *, COALESCE(CASE WHEN contains(parent_id, '-LEG') THEN rtrim(replace(parent_id, '-LEG', ''), '-') || '-LEG'
                  ELSE parent_id END, CASE WHEN family_parent_id IS NOT NULL AND family_parent_id <> norm_id
                                             THEN family_parent_id ELSE '' END) AS parent_registry_id FROM r11)"""


ORACLE["i6_registry_ids"] = with_fact("""
SELECT contract_id, hierarchy, counterparty, family, type_code, norm_id AS registry_id, parent_registry_id,
  id_notes, CAST(child_num AS INTEGER) AS child_num
FROM registry""", ctes=_registry_ctes())


ORACLE["i6_duplicate_ids"] = with_fact("""
SELECT norm_id AS registry_id, count(*) AS n_rows FROM registry GROUP BY 1 HAVING count(*) > 1""", ctes=_registry_ctes())


# ------------------------------------------------------------------ PII
def _wb(p: str) -> str:
    """Unicode-aware word boundary written out for RE2 (yes/no tests)."""
    return p.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])", 1)[::-1].replace(
        r"\b"[::-1], r"(?:^|$|[^\p{L}\p{N}_])"[::-1], 1)[::-1]


def _pii_sql(t: str) -> str:
    from ..operators.pii import PII_PATTERNS
    parts = ", ".join(f"CASE WHEN regexp_matches({t}, '{_wb(p)}') THEN '{n}' END" for n, p in PII_PATTERNS)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


ORACLE["c19_pii_scan"] = f"""
SELECT doc_id, lang, source, array_to_string(pt, ',') AS pii_types, CAST(len(pt) AS INTEGER) AS n_types
FROM (SELECT doc_id, lang, source, {_pii_sql("coalesce(text, '')")} AS pt FROM documents)"""

ORACLE["c19_pii_counts"] = f"""
SELECT lang, source, pii_type, COUNT(*) AS n_docs FROM (
  SELECT lang, source, unnest({_pii_sql("coalesce(text, '')")}) AS pii_type FROM documents)
GROUP BY lang, source, pii_type"""


# ---------------------------------------------------------------- search (S*)
_CENTROIDS = """
cen AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM (
  SELECT label, i, avg(CAST(e AS DOUBLE)) AS m FROM (
    SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label)"""

ORACLE["s1_cosine_topk"] = f"""
WITH {_CENTROIDS.strip()},
sc AS (SELECT c.query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.qv) AS cosine
       FROM cen c, embeddings e),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM sc)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, CAST(rank AS INTEGER) AS rank, ROUND(cosine, 4) AS cosine
FROM rk WHERE rank <= 5"""

ORACLE["s4_similar_neighbours"] = """
WITH sc AS (SELECT q.vec_id AS query_id, e.vec_id, e.label AS neighbour_label,
                   list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS cosine
            FROM embeddings q, embeddings e),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM sc)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, neighbour_label FROM rk WHERE rank <= 3"""

ORACLE["s6_dimension_check"] = """
SELECT CAST(len(embedding) AS INTEGER) AS dim, COUNT(*) AS n_vectors FROM embeddings GROUP BY 1"""


def _hybrid_sql(query: str, n: int, cols: str) -> str:
    words = [w for w in query.lower().split() if len(w) > 2]
    ms = " + ".join(
        f"CASE WHEN contains(lower(contract_id), '{w}') THEN 50 ELSE 0 END"
        f" + CASE WHEN contains(lower(coalesce(contract_type, '')), '{w}') THEN 20 ELSE 0 END" for w in words)
    return with_fact(f"""
SELECT {cols} FROM (
  SELECT contract_id, text, metadata_score, semantic_score,
         metadata_score * 0.7 + semantic_score * 0.3 AS hybrid_score FROM (
    SELECT ct.contract_id, ct.text, LEAST({ms}, 100) AS metadata_score,
           (1 - COALESCE(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cen.qv), 2.0)) * 100 AS semantic_score
    FROM contracts ct LEFT JOIN embeddings e ON e.vec_id = ct._pos % (SELECT COUNT(*) FROM embeddings)
    CROSS JOIN (SELECT qv FROM cen WHERE query_id = 0) cen))
ORDER BY hybrid_score DESC, contract_id LIMIT {n}""", ctes=_CENTROIDS)


ORACLE["s3_hybrid_search"] = _hybrid_sql(
    "furniture reseller agreement", 10, "contract_id, metadata_score, ROUND(hybrid_score, 3) AS hybrid_score")
ORACLE["s5_render_results"] = _hybrid_sql(
    "oem distributor", 5,
    "contract_id, printf('Match: %.1f%% (Name/Party: %.0f%%, Content: %.1f%%)', hybrid_score, "
    "CAST(metadata_score AS DOUBLE), semantic_score) AS score_line, substr(coalesce(text, ''), 1, 300) || '...' AS excerpt")


# -------------------------------------------------------------- clauses (C*)
def _rx(p: str) -> str:
    return "'" + _sqlq(p) + "'"


def _first(t: str, patterns, flags="(?i)", group=1) -> str:
    return "COALESCE(" + ", ".join(
        f"CASE WHEN regexp_matches({t}, {_rx(flags + p)}) THEN regexp_extract({t}, {_rx(flags + p)}, {group}) END"
        for p in patterns) + ")"


def _clause_sql() -> str:
    from ..operators import clauses as C
    tn = "tn"
    perp = "COALESCE(" + ", ".join(
        f"CASE WHEN regexp_matches(tn, {_rx('(?i)' + p)}) THEN regexp_extract(tn, {_rx('(?i)(.{0,50}(?:' + p + ').{0,300})')}, 1) END"
        for p in C.PERPETUAL_PATTERNS) + ")"
    auto = "COALESCE(" + ", ".join(
        f"CASE WHEN regexp_matches(tn, {_rx('(?i)' + p)}) THEN regexp_extract(tn, {_rx('(?i)((?:' + p + ').{0,200})')}, 1) END"
        for p in C.AUTO_RENEW_PATTERNS) + ")"
    ren_ctx = "(?i)" + C.RENEWAL_CONTEXT_DURATION
    notice_after = "(?i)" + C.NOTICE_AFTER
    pay = "(?i)payments?[^.]*?(" + C.NOTICE_DURATION + ")"
    nd = "(?i)(" + C.NOTICE_DURATION + ")"
    return f"""
cd0 AS (SELECT contract_id, text AS raw, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS tn FROM contract_documents),
cd1 AS (SELECT *, {perp} AS perp_ctx, {auto} AS auto_ctx, regexp_extract(tn, {_rx('(?i)' + C.TFC_CLAUSE)}, 0) AS tfc,
          {_first(tn, C.RENEWAL_TERM_PATTERNS)} AS ren_fb FROM cd0),
clause_terms AS (
 SELECT contract_id,
   trim(COALESCE(ren_fb, CASE WHEN regexp_matches(auto_ctx, {_rx(ren_ctx)}) THEN regexp_extract(auto_ctx, {_rx(ren_ctx)}, 1) END)) AS renewal_term,
   trim({_first(tn, C.RENEWAL_NOTICE_PATTERNS)}) AS renewal_notice_period,
   trim({_first(tn, C.TERMINATION_NOTICE_PATTERNS)}) AS termination_notice_period,
   perp_ctx IS NOT NULL AS perpetual,
   trim(CASE WHEN regexp_matches(perp_ctx, {_rx(notice_after)}) THEN regexp_extract(perp_ctx, {_rx(notice_after)}, 1) END) AS perpetual_notice_period,
   auto_ctx IS NOT NULL AS auto_renewal,
   CASE WHEN regexp_matches(tn, {_rx(pay)}) THEN regexp_extract(tn, {_rx(pay)}, 1) END AS payment_terms,
   CASE WHEN regexp_matches(tn, {_rx('(?i)' + C.LATE_CHARGE)}) THEN trim(regexp_extract(tn, {_rx('(?i)' + C.LATE_CHARGE)}, 0)) END AS late_charge,
   CASE WHEN tfc <> '' THEN 'Yes' ELSE 'No' END AS termination_for_convenience,
   CASE WHEN tfc <> '' AND regexp_matches(tfc, {_rx(nd)}) THEN regexp_extract(tfc, {_rx(nd)}, 1) END AS termination_for_convenience_notice,
   CASE WHEN tfc <> '' THEN substr(trim(tfc), 1, 250) END AS termination_for_convenience_clause,
   CASE WHEN regexp_matches(coalesce(raw, ''), {_rx('(?i)' + C.GOVERNING_LAW)}) THEN trim(regexp_extract(coalesce(raw, ''), {_rx('(?i)' + C.GOVERNING_LAW)}, 1)) END AS governing_law,
   CASE WHEN regexp_matches(coalesce(raw, ''), {_rx('(?is)' + C.PURPOSE)}) THEN regexp_replace(trim(regexp_extract(coalesce(raw, ''), {_rx('(?is)' + C.PURPOSE)}, 1)), '\\s+', ' ', 'g') END AS purpose
 FROM cd1)"""


ORACLE["c13_clause_terms"] = with_fact("SELECT * FROM clause_terms", ctes=_clause_sql())

ORACLE["c18_renewal_terms"] = with_fact("""
SELECT contract_id, regexp_matches(t, '(?i)automatically renew') AS has_auto_renewal,
  CASE WHEN regexp_matches(t, '(?i)(\\d+)\\s*days?\\s*(?:prior\\s*)?notice') THEN regexp_extract(t, '(?i)(\\d+)\\s*days?\\s*(?:prior\\s*)?notice', 1) || ' days' END AS notice_period,
  CASE WHEN regexp_matches(t, '(?i)renew for (?:an additional |a )?(\\d+[- ](year|month|day))') THEN regexp_extract(t, '(?i)renew for (?:an additional |a )?(\\d+[- ](year|month|day))', 1) END AS renewal_term
FROM (SELECT contract_id, coalesce(text, '') AS t FROM contract_documents)""")


def _sections_sql() -> str:
    from ..operators.clauses import SECTION_PATTERNS
    parts = " UNION ALL ".join(
        f"SELECT contract_id, '{n}' AS section, substr(regexp_extract(t, {_rx('(?is)' + p)}, 1), 1, 200) AS snippet "
        f"FROM cdx WHERE regexp_matches(t, {_rx('(?is)' + p)})" for n, p in SECTION_PATTERNS)
    return parts


ORACLE["c16_sections"] = with_fact(
    _sections_sql(), ctes="cdx AS (SELECT contract_id, coalesce(text, '') AS t FROM contract_documents)")

ORACLE["c25_contract_refs"] = with_fact("""
SELECT contract_id, ref FROM (
  SELECT contract_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '(?i)(?:MSA|SOW|NDA|Agreement)\\s*[#-]?\\s*(\\d{4}-\\d{3,4}|\\d+)', 1))) AS ref
  FROM contract_documents)""")


def _c26_sql() -> str:
    from ..operators.clauses import ENTERPRISE_TYPES
    et = "CASE " + " ".join(f"WHEN contains(lower(t), '{x.lower()}') THEN '{x}'" for x in ENTERPRISE_TYPES) + " END"
    tl = "(?i)(?:initial\\s+term|term\\s+of).*?(\\d+)\\s+(year|month)"
    return f"""
SELECT contract_id, regexp_matches(t, '(?i)amend(?:s|ment|ing)') AS amendment_language,
  regexp_matches(t, '(?i)master\\s+service\\s+agreement') AS mentions_msa,
  CASE WHEN regexp_matches(t, '{tl}') THEN regexp_extract(t, '{tl}', 1) || ' ' || regexp_extract(t, '{tl}', 2) || '(s)' END AS term_length,
  {et} AS enterprise_type
FROM (SELECT contract_id, coalesce(text, '') AS t FROM contract_documents)"""


ORACLE["c26_relationship_flags"] = with_fact(_c26_sql())


def _c4_sql() -> str:
    from ..operators.clauses import DATE_LITERAL_PATTERNS
    hits = ", ".join(
        f"CASE WHEN regexp_matches(t, {_rx('(?i)' + p)}) THEN regexp_replace(replace(regexp_extract(t, {_rx('(?i)(' + p + ')')}, 1), '  ', ' '), '^[ ,.;]+|[ ,.;]+$', '', 'g') END"
        for p in DATE_LITERAL_PATTERNS)
    y = "regexp_extract(t, '\\b(\\d{4})\\b', 1)"
    return f"""
SELECT contract_id, COALESCE({hits},
  CASE WHEN regexp_matches(t, '\\b(\\d{{4}})\\b') AND TRY_CAST({y} AS INTEGER) BETWEEN 1900 AND 2099 THEN {y} END) AS date_literal
FROM (SELECT contract_id, coalesce(text, '') AS t FROM contract_documents)"""


ORACLE["c4_date_literal"] = with_fact(_c4_sql())

ORACLE["c30_notice_days"] = with_fact("""
SELECT contract_id, payment_terms,
  CASE WHEN coalesce(payment_terms, '') <> '' AND payment_terms NOT IN ('Unknown', 'Not found') THEN
    COALESCE(TRY_CAST(NULLIF(regexp_extract(payment_terms, '(?i)(\\d+)\\s*(?:days?|day)', 1), '') AS INTEGER),
             TRY_CAST(NULLIF(regexp_extract(payment_terms, '(?i)(\\d+)\\s*(?:months?|month)', 1), '') AS INTEGER) * 30,
             TRY_CAST(NULLIF(regexp_extract(payment_terms, '(?i)(\\d+)\\s*(?:weeks?|week)', 1), '') AS INTEGER) * 7) END AS days,
  CASE WHEN coalesce(payment_terms, '') <> '' AND payment_terms NOT IN ('Unknown', 'Not found') THEN
    COALESCE(TRY_CAST(NULLIF(regexp_extract(payment_terms, '(?i)(\\d+)\\)?\\s*(?:days?|day)', 1), '') AS INTEGER),
             TRY_CAST(NULLIF(regexp_extract(payment_terms, '(?i)(\\d+)\\)?\\s*(?:months?|month)', 1), '') AS INTEGER) * 30,
             TRY_CAST(NULLIF(regexp_extract(payment_terms, '(?i)(\\d+)\\)?\\s*(?:weeks?|week)', 1), '') AS INTEGER) * 7) END AS days_paren
FROM contracts""")

ORACLE["c31_contract_value"] = """
WITH j AS (SELECT o.o_orderkey, o.o_totalprice, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
           JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
v AS (SELECT o_orderkey, CASE WHEN r_name IN ('EUROPE', 'MIDDLE EAST', 'AFRICA') THEN 'EMEA' ELSE 'Other' END AS region,
        CASE o_orderkey % 4 WHEN 0 THEN '£' || printf('%.2f', o_totalprice) WHEN 1 THEN printf('%.2f', o_totalprice)
             WHEN 2 THEN '$' || printf('%.2f', o_totalprice) ELSE '€' || printf('%.2f', o_totalprice) END AS value_text FROM j)
SELECT o_orderkey, value_text, region,
  ROUND(TRY_CAST(regexp_replace(value_text, '[^0-9.]', '', 'g') AS DOUBLE), 2) AS amount,
  CASE WHEN contains(value_text, '£') THEN 'GBP' WHEN contains(value_text, '€') THEN 'EUR' WHEN contains(value_text, '$') THEN 'USD'
       WHEN region = 'EMEA' THEN 'EUR' ELSE 'USD' END AS currency
FROM v"""


# ------------------------------------------------------------ guard
def _rules_sql(rules, clearance_levels=None) -> str:
    parts = []
    for i, (level, risk, pattern, negate) in enumerate(rules):
        if pattern is None:
            cond = "regexp_matches(t, '(?i)automatically renew')"
        else:
            cond = f"regexp_matches(t, {_rx('(?i)' + pattern)})"
        if negate:
            cond = f"NOT {cond}"
        if clearance_levels is not None and level not in clearance_levels:
            continue
        parts.append(f"SELECT contract_id, {i} AS ordinal, '{level}' AS level, '{_sqlq(risk)}' AS risk "
                     f"FROM gx WHERE {cond}")
    return " UNION ALL ".join(parts)


_GX = "gx AS (SELECT contract_id, coalesce(text, '') AS t FROM contract_documents)"


def _e34() -> str:
    from ..operators.guard import PIPELINE_RULES
    return with_fact(_rules_sql(PIPELINE_RULES, {"high", "medium"}), ctes=_GX)


def _e35() -> str:
    from ..operators.guard import ENTERPRISE_RULES
    return with_fact(_rules_sql(ENTERPRISE_RULES), ctes=_GX)


def _e36() -> str:
    from ..operators.guard import MULTI_AGENT_RULES
    parts = []
    for i, (n, p) in enumerate(MULTI_AGENT_RULES):
        if "(?!" in p:
            # lookahead rewritten: some line has the phrase with no 'notice' after it on that line
            cond = ("list_bool_or(list_transform(string_split(t, chr(10)), lambda l: "
                    "regexp_matches(l, '(?i)automatically\\s+renew') AND NOT regexp_matches("
                    "regexp_extract(l, '(?i)^.*automatically\\s+renew(.*)$', 1), '(?i)notice')))")
        else:
            cond = f"regexp_matches(t, {_rx('(?i)' + p)})"
        parts.append(f"SELECT contract_id, {i} AS ordinal, '{_sqlq(n.upper())}' AS risk FROM gx WHERE {cond}")
    return with_fact(" UNION ALL ".join(parts), ctes=_GX)


ORACLE["e34_clause_risks"] = _e34()
ORACLE["e35_enterprise_risks"] = _e35()
ORACLE["e36_multi_agent_risks"] = _e36()


def _e37(policy: str) -> str:
    from ..config import FIXTURE_CONFIG
    from ..operators.guard import INJECTION_BLOCK, INJECTION_WARN
    kw = "CASE " + " ".join(f"WHEN contains(lower(t), '{k.lower()}') THEN '{k}'"
                            for k in FIXTURE_CONFIG.blocked_keywords) + " END"
    inj = "(?i)(?:" + "|".join(f"(?:{p})" for p in (INJECTION_BLOCK if policy == "block" else INJECTION_WARN)) + ")"
    if policy == "block":
        verdict = ("CASE WHEN len(pt) > 0 THEN 'blocked_pii' WHEN kw IS NOT NULL THEN 'blocked_keyword' "
                   "WHEN inj THEN 'blocked_injection' ELSE 'allowed' END")
    else:
        verdict = ("CASE WHEN kw IS NOT NULL THEN 'blocked_keyword' WHEN inj THEN 'blocked_injection' "
                   "WHEN len(pt) > 0 THEN 'warn_pii' ELSE 'allowed' END")
    return f"""
SELECT conv_id, turn, array_to_string(pt, ',') AS pii_types, kw AS blocked_keyword, {verdict} AS verdict FROM (
  SELECT conv_id, turn, {_pii_sql('t')} AS pt, {kw} AS kw, regexp_matches(t, {_rx(inj)}) AS inj
  FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'))"""


ORACLE["e37_input_screening"] = _e37("block")
ORACLE["e37_input_screening_warn"] = _e37("warn")


def _e38() -> str:
    from ..config import FIXTURE_CONFIG
    vals = ", ".join(f"('{_sqlq(p)}')" for p in FIXTURE_CONFIG.restricted_parties)
    return with_fact(f"""
SELECT d.contract_id, p.party FROM contract_documents d JOIN (VALUES {vals}) p(party)
  ON contains(lower(coalesce(d.text, '')), lower(p.party))""")


ORACLE["e38_restricted_parties"] = _e38()

ORACLE["e41_access_audit"] = f"""
WITH a AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'metadata_extraction' WHEN 'click' THEN 'risk_analysis'
                  ELSE event_type END AS action,
             ['public', 'internal', 'confidential'][CAST(((TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 3) + 3) % 3 + 1 AS INTEGER)] AS clearance
           FROM events)
SELECT user_id, strftime(ts, {TS}) AS ts, action, clearance AS user_level, 'Public user ran ' || action AS warning
FROM a WHERE clearance = 'public' AND action IN ('metadata_extraction', 'risk_analysis')"""

ORACLE["w1_last_events_per_user"] = f"""
SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank, strftime(ts, {TS}) AS ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
WHERE rank <= 10"""


# ------------------------------------------------------- projections (B*)
def _b3() -> str:
    from ..functions.missing import BOOLEAN_DEFAULTS, STRING_DEFAULTS
    present = {"contract_type", "gdpr_applicable", "region", "termination_for_convenience", "governing_law",
               "effective_date", "is_draft"}
    cols = ["contract_id"]
    for n, d in STRING_DEFAULTS:
        d = d or "Unknown"
        cols.append(f"CASE WHEN {n} IS NULL OR {n} = '' THEN '{d}' ELSE {n} END AS {n}" if n in present
                    else f"'{d}' AS {n}")
    for n, d in BOOLEAN_DEFAULTS:
        cols.append(f"coalesce({n}, {str(d).upper()}) AS {n}" if n in present else f"{str(d).upper()} AS {n}")
    return with_fact("SELECT " + ", ".join(cols) + " FROM contracts")


ORACLE["b3_default_backfill"] = _b3()

ORACLE["b5_value_coercions"] = with_fact("""
SELECT contract_id,
  CASE WHEN lower(trim(termination_for_convenience)) IN ('yes','true','1','y') THEN 'Yes'
       WHEN lower(trim(termination_for_convenience)) IN ('no','false','0','n') THEN 'No' ELSE 'Unknown' END AS tfc_yes_no,
  CASE WHEN lower(trim(gdpr_applicable)) IN ('yes','true','1','y') THEN 'Yes'
       WHEN lower(trim(gdpr_applicable)) IN ('no','false','0','n') THEN 'No' ELSE 'Unknown' END AS gdpr_yes_no,
  coalesce(governing_law, 'Unknown') AS law_display,
  CASE WHEN is_draft IS NULL THEN 'Unknown' WHEN is_draft THEN 'Yes' ELSE 'No' END AS draft_display,
  coalesce(gdpr_applicable IN ('Yes', 'True', '1'), FALSE) AS gdpr_flag,
  (payment_terms IS NULL OR lower(trim(payment_terms)) IN ('', 'unknown', 'n/a', 'na', 'not found', 'tbd', 'pending')) AS payment_missing,
  COALESCE(CASE WHEN counterparty_name NOT IN ('', 'Unknown', 'Not found', 'Not specified', 'N/A', 'None') THEN counterparty_name END,
           CASE WHEN parent_folder_name NOT IN ('', 'Unknown', 'Not found', 'Not specified', 'N/A', 'None') THEN parent_folder_name END,
           'Unknown') AS counterparty_pick,
  CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS excerpt
FROM contracts""")


def _b17() -> str:
    from ..sources.contracts import CONTRACT_TYPES  # noqa: F401  (column list below is the view's)
    cols = ["_pos", "contract_id", "counterparty_name", "parent_folder_name", "contract_type", "filename",
            "effective_date", "expiration_date", "region", "counterparty_address", "gdpr_applicable",
            "governing_law", "payment_terms", "termination_for_convenience", "contract_status", "is_draft",
            "contract_group_id", "text"]
    vals = ", ".join(f"('{c}')" for c in cols)
    return with_fact(f"""
SELECT c.contract_id, k.key, array_to_string(list_transform(string_split(k.key, '_'), lambda w:
    CASE WHEN lower(w) IN ('gdpr', 'msa') THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS label
FROM contracts c, (VALUES {vals}) k(key)""")


ORACLE["b17_humanised_keys"] = _b17()


# ------------------------------------------------------------- ingest (A*, I*)
_BATCH = """
b0 AS (SELECT doc_id AS _pos, source || '-' || lang || '.pdf' AS file_name, octet_length(encode(coalesce(text, ''))) AS size,
         text, sha1(lower(source || '-' || lang || '.pdf') || CAST(octet_length(encode(coalesce(text, ''))) AS VARCHAR) || '-' || coalesce(text, '')) AS source_hash
       FROM documents),
b1 AS (SELECT *, left(coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(file_name, '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'contract'), 40)
          || '-' || left(source_hash, 10) AS contract_id,
        CASE WHEN starts_with(file_name, '~$') OR starts_with(file_name, '.~$') THEN 'lock_file'
             WHEN size < 500 THEN 'too_small'
             WHEN lower(regexp_extract(file_name, '(\\.[^.]+)$', 1)) NOT IN ('.pdf', '.docx', '.doc') THEN 'unsupported_extension'
             WHEN length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 50 THEN 'no_text' END AS junk_reason,
        length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 400
          AND length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) = 0 AS needs_ocr
       FROM b0),
win AS (SELECT contract_id, min(_pos) AS w FROM b1 WHERE junk_reason IS NULL GROUP BY contract_id),
outcomes AS (SELECT b1.*, CASE WHEN junk_reason IS NOT NULL THEN 'failed' WHEN _pos <> win.w THEN 'skipped'
                               ELSE 'processed' END AS status
             FROM b1 LEFT JOIN win USING (contract_id))"""

ORACLE["a3_ingest_outcomes"] = f"""WITH {_BATCH.strip()}
SELECT _pos, file_name, size, source_hash, contract_id, junk_reason, needs_ocr, status FROM outcomes"""

ORACLE["a9_ingest_tally"] = f"""WITH {_BATCH.strip()}
SELECT status, COUNT(*) AS n_files, COUNT(*) FILTER (WHERE coalesce(needs_ocr, FALSE)) AS n_ocr FROM outcomes GROUP BY status"""

ORACLE["a7_idempotent_ingest"] = f"""WITH {_BATCH.strip()}
SELECT contract_id, _pos, file_name, source_hash FROM outcomes WHERE status = 'processed'"""

ORACLE["a5_collection_count"] = with_fact("SELECT COUNT(*) AS n_contracts FROM contracts")

ORACLE["a6_recent_listing"] = with_fact(
    "SELECT contract_id, filename FROM contracts ORDER BY _pos DESC, contract_id LIMIT 5")

ORACLE["a4_point_lookup"] = with_fact("""
SELECT c.contract_id, c.filename FROM contracts c
WHERE c.contract_id IN (SELECT contract_id FROM gaps ORDER BY len(missing) DESC, _pos LIMIT 20)""", ctes=_gap_ctes())


# ---------------------------------------------------------- streaming (T*)
ORACLE["t1_auto_ingest_stream"] = ORACLE["a7_idempotent_ingest"]
ORACLE["t6_session_history_stream"] = ORACLE["w1_last_events_per_user"]
ORACLE["t5_intake_queue"] = f"""WITH {_BATCH.strip()}
SELECT _pos AS submission_id, file_name, 'Processed' AS status, contract_id FROM b1"""
ORACLE["t2_high_risk_alerts"] = with_fact("SELECT contract_id, risk_score, 1 AS version FROM fact WHERE risk_score >= 70")


# ------------------------------------------------------- governance
def _export_date(c: str) -> str:
    fmts = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y")
    tries = ", ".join(f"try_strptime(trim({c}), '{f}')" for f in fmts)
    return (f"CASE WHEN {c} IS NULL OR {c} IN ('', 'Unknown', 'Not specified', 'Not found') THEN NULL "
            f"ELSE COALESCE({tries}) END")


def _e18_select(extra: str = "") -> str:
    return f"""
SELECT contract_id,{extra}
  CASE WHEN lower(coalesce(contract_status, '')) = 'terminated' THEN 'Terminated'
       WHEN coalesce(is_draft, FALSE) OR lower(coalesce(contract_status, '')) = 'draft' THEN 'Draft'
       WHEN lower(coalesce(contract_status, '')) IN ('archive', 'superseded') THEN 'Archive'
       WHEN ex IS NOT NULL AND ex < {AS_OF} THEN 'Expired'
       WHEN ex IS NOT NULL AND {_days('ex')} <= 90 THEN 'Review'
       WHEN ef IS NOT NULL AND ef > {AS_OF} THEN 'Pending' ELSE 'Active' END AS lifecycle_stage,
  CASE WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS risk_level,
  {_days('ex')} AS days_to_expiry,
  CASE WHEN ef IS NOT NULL AND CAST(floor((epoch_us({AS_OF}) - epoch_us(ef)) / 86400000000.0) AS INTEGER) >= 730
       THEN 'Yes' ELSE 'No' END AS audit_flag,
  concat_ws(' - ', strftime(ef, '%Y-%m-%d'), strftime(ex, '%Y-%m-%d')) AS contract_duration,
  CAST(NULL AS VARCHAR) AS renewal_date
FROM (SELECT *,
  CASE WHEN {_days('ex')} < 0 THEN 40 WHEN {_days('ex')} < 30 THEN 30 WHEN {_days('ex')} < 90 THEN 20 ELSE 0 END
  + CASE WHEN coalesce(effective_date, 'Unknown') = 'Unknown' THEN 10 ELSE 0 END
  + CASE WHEN coalesce(contract_type, 'Unknown') = 'Unknown' THEN 10 ELSE 0 END
  + CASE WHEN lower(coalesce(gdpr_applicable, 'No')) IN ('yes', 'true') THEN 10 ELSE 0 END
  + CASE WHEN coalesce(termination_for_convenience, 'Unknown') = 'No' THEN 15 ELSE 0 END AS score
  FROM (SELECT *, {_export_date('effective_date')} AS ef, {_export_date('expiration_date')} AS ex FROM contracts))"""


ORACLE["e18_governance_columns"] = with_fact(_e18_select())

ORACLE["k13_weekly_summary"] = with_fact("""
SELECT 'kpi' AS section, 0 AS rank, key, value FROM (
  SELECT unnest(['total_contracts', 'active_contracts', 'expiring_soon', 'high_risk_contracts', 'unique_companies']) AS key,
         unnest([COUNT(*), COUNT(*) FILTER (WHERE status = 'Active'), COUNT(*) FILTER (WHERE is_expiring_soon),
                 COUNT(*) FILTER (WHERE risk_score >= 70), COUNT(DISTINCT company_folder)]) AS value FROM fact)
UNION ALL SELECT 'by_type', 0, coalesce(contract_type, 'Unknown'), COUNT(*) FROM fact GROUP BY contract_type
UNION ALL SELECT * FROM (SELECT 'top_expiring', 0, company_folder, CAST(days_until_expiration AS BIGINT) FROM fact
  WHERE is_expiring_soon ORDER BY days_until_expiration, contract_id LIMIT 5)""")


# ------------------------------------------------------ classification
def _rule_cond(s: str, pattern: str) -> str:
    """RE2 has no lookbehind: 'p not preceded by X' holds when p occurs more
    often than 'X p' does."""
    import re as _re
    parts = []
    for alt in _split_top(pattern):
        lbs = _re.findall(r"\(\?<!([^()]*)\)", alt)
        core = _re.sub(r"\(\?<![^()]*\)", "", alt)
        if not lbs:
            parts.append(f"regexp_matches({s}, {_rx(core)})")
        else:
            neg = " + ".join(f"len(regexp_extract_all({s}, {_rx(lb + core)}))" for lb in lbs)
            parts.append(f"(len(regexp_extract_all({s}, {_rx(core)})) > {neg})")
    return "(" + " OR ".join(parts) + ")"


def _split_top(p: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in p:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "|" and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


def _chain_sql(s: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_rule_cond(s, p)} THEN '{_sqlq(t)}'" for p, t in rules) + " END"


def _c1_sql(use_filename: bool) -> str:
    from ..operators import classify as CL
    folder = f"CASE WHEN coalesce(parent_folder_name, '') <> '' THEN {_chain_sql('lower(parent_folder_name)', CL.FOLDER_RULES)} END"
    fname = f"CASE WHEN coalesce(filename, '') <> '' THEN {_chain_sql('lower(filename)', CL.FILENAME_RULES)} END"
    text = _chain_sql("lower(coalesce(text, ''))", CL.TEXT_RULES)
    tiers = [("folder", folder)] + ([("filename", fname)] if use_filename else []) + [("text", text)]
    label = "COALESCE(" + ", ".join(t for _, t in tiers) + ", 'Auto-detected')"
    tier = "CASE " + " ".join(f"WHEN {t} IS NOT NULL THEN '{n}'" for n, t in tiers) + " ELSE 'default' END"
    return f"SELECT contract_id, {label} AS contract_type, {tier} AS tier FROM contract_documents"


ORACLE["c1_contract_type"] = with_fact(_c1_sql(True))
ORACLE["c1_type_counts"] = with_fact(
    f"SELECT contract_type, tier, COUNT(*) AS n_docs FROM ({_c1_sql(False)}) GROUP BY contract_type, tier")


# ------------------------------------------------------------ region
def _first_name_sql(t: str, names) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {_rx('(?i)' + _wb2(n))}) THEN '{n}'" for n in names) + " END"


def _wb2(n: str) -> str:
    """Whole-word test for RE2: Unicode-aware boundaries written out where the
    name starts / ends with a word character."""
    import re as _re
    left = r"(?:^|[^\p{L}\p{N}_])" if _re.match(r"\w", n) else r"\b"
    right = r"(?:$|[^\p{L}\p{N}_])" if _re.match(r"\w", n[-1]) else r"\b"
    return left + n + right


def _e1_sql(source: str = "contract_documents", extra: str = "") -> str:
    from ..operators import region as RG
    ent = "COALESCE(" + ", ".join(f"NULLIF(regexp_extract(t, {_rx(p)}, 0), '')" for p in RG.EU_ENTITY_PATTERNS) + ")"
    return f"""
SELECT contract_id,{extra}
  COALESCE(explicit, CASE WHEN ent IS NOT NULL THEN 'EMEA' END, CASE WHEN country IS NOT NULL THEN 'EMEA' END,
           CASE WHEN na IS NOT NULL THEN 'North America' END, CASE WHEN ap IS NOT NULL THEN 'APAC' END) AS region,
  CASE WHEN explicit = 'EMEA' OR ent IS NOT NULL OR country IS NOT NULL THEN TRUE END AS subject_to_gdpr,
  CASE WHEN explicit = 'EMEA' THEN 'EMEA region'
       WHEN ent IS NOT NULL THEN 'European legal entity type (' || upper(regexp_replace(list_last(string_split_regex(trim(ent), '\\s+')), '\\.+$', '')) || ')'
       WHEN country IS NOT NULL THEN 'European address (' || country || ')' END AS gdpr_reason
FROM (SELECT contract_id,{extra} t,
  CASE WHEN regexp_matches(t, {_rx('(?i)' + _wb2('EMEA'))}) THEN 'EMEA'
       WHEN regexp_matches(t, {_rx('(?i)' + _wb2('North America'))}) THEN 'North America'
       WHEN regexp_matches(t, {_rx('(?i)' + _wb2('APAC'))}) OR regexp_matches(t, {_rx('(?i)' + _wb2('Asia Pacific'))}) THEN 'APAC' END AS explicit,
  {ent} AS ent,
  {_first_name_sql('t', RG.EMEA_COUNTRIES)} AS country,
  {_first_name_sql('t', RG.NA_LOCATIONS)} AS na,
  {_first_name_sql('t', RG.APAC_COUNTRIES)} AS ap
  FROM (SELECT contract_id,{extra} CASE WHEN coalesce(counterparty_address, '') <> '' THEN coalesce(text, '') || ' ' || counterparty_address
                                 ELSE coalesce(text, '') END AS t FROM {source}))"""


def _e3_sql() -> str:
    from ..operators import region as RG

    def has(c, words):
        return "(" + " OR ".join(f"contains({c}, '{w.lower()}')" for w in words) + ")"
    low = "lower(coalesce(counterparty_address, ''))"
    infer = (f"CASE WHEN {low} = '' THEN NULL WHEN {has(low, RG.EMEA_KEYWORDS)} THEN 'EMEA' "
             f"WHEN {has(low, RG.NA_ADDRESS_KEYWORDS)} THEN 'North America' "
             f"WHEN {has(low, RG.APAC_ADDRESS_KEYWORDS)} THEN 'APAC' END")
    addr_region = (f"CASE WHEN {has(low, RG.EMEA_COUNTRIES)} THEN 'EMEA' WHEN {has(low, RG.NA_LOCATIONS)} THEN 'North America' "
                   f"WHEN {has(low, RG.APAC_COUNTRIES)} THEN 'APAC' END")
    emea_addr = f"({low} <> '' AND {has(low, RG.EMEA_KEYWORDS)})"
    return with_fact(f"""
SELECT contract_id, rr AS resolved_region,
  CASE WHEN flag = 'No' AND (lower(coalesce(rr, '')) = 'emea' OR {emea_addr}) THEN 'Yes' ELSE flag END AS gdpr,
  CASE WHEN flag <> 'No' THEN '' WHEN lower(coalesce(rr, '')) = 'emea' THEN 'Counterparty region in EMEA'
       WHEN {emea_addr} THEN 'Counterparty address in EMEA' ELSE '' END AS gdpr_reason,
  {addr_region} AS address_region
FROM (SELECT *, COALESCE(CASE WHEN trim(coalesce(region, '')) <> '' THEN region END, {infer}) AS rr,
        upper(substr(coalesce(gdpr_applicable, 'No'), 1, 1)) || lower(substr(coalesce(gdpr_applicable, 'No'), 2)) AS flag
      FROM contracts)""")


ORACLE["e1_region_gdpr_detection"] = with_fact(_e1_sql())
ORACLE["e3_region_gdpr_export"] = _e3_sql()


def _e26_sql() -> str:
    from ..operators import registry as R
    inv = ", ".join(f"'{x}'" for x in R.INVALID_JURISDICTIONS)
    ind = " OR ".join(f"contains(v, '{w}')" for w in R.VALID_JURISDICTION_WORDS)
    return with_fact(f"""
SELECT contract_id,
  CASE WHEN contains(lower(ct), 'perpetual') OR contains(lower(ct), 'evergreen') OR contains(lower(ct), 'no fixed term')
       THEN 'Yes' ELSE 'No' END AS perpetual,
  CASE WHEN contains(lower(ct), 'nda') THEN 30 WHEN contains(lower(ct), 'master') OR contains(lower(ct), 'msa') THEN 90
       WHEN contains(lower(ct), 'reseller') OR contains(lower(ct), 'distributor') THEN 60 ELSE 30 END AS notification_days,
  CASE WHEN coalesce(governing_law, '') = '' THEN FALSE WHEN v IN ({inv}) THEN FALSE WHEN {ind} THEN TRUE
       WHEN length(v) = 2 AND regexp_matches(v, '^[a-z]{{2}}$') THEN TRUE ELSE length(v) > 4 END AS jurisdiction_valid
FROM (SELECT *, coalesce(nullif(contract_type, ''), 'Unknown') AS ct, lower(trim(coalesce(governing_law, ''))) AS v FROM contracts)""")


ORACLE["e26_term_defaults"] = _e26_sql()
ORACLE["e8_folder_context"] = with_fact("""
SELECT contract_id, CAST(count(*) OVER (PARTITION BY parent_folder_name) AS BIGINT) AS folder_document_count,
  count(*) OVER (PARTITION BY parent_folder_name) > 1 AS has_related_documents,
  substr(md5(lower(parent_folder_name)), 1, 12) = contract_group_id AS group_id_matches
FROM contracts""")


ORACLE["e19_archive_review"] = with_fact("""
SELECT contract_id,
  (lifecycle_stage IN ('Archive', 'Terminated', 'Expired') OR lower(coalesce(contract_status, '')) = 'terminated') AS archive_flag,
  CASE WHEN lower(coalesce(contract_status, '')) = 'terminated' THEN 'Agreement folder marked terminated' ELSE '' END AS archive_reason,
  CASE WHEN coalesce(is_draft, FALSE) THEN 'Draft folder (age unknown)' ELSE '' END AS review_flag,
  CASE WHEN (lifecycle_stage IN ('Archive', 'Terminated', 'Expired') OR lower(coalesce(contract_status, '')) = 'terminated')
        AND lifecycle_stage NOT IN ('Terminated', 'Archive') THEN 'Archive' ELSE lifecycle_stage END AS lifecycle
FROM g""", ctes="g AS (" + _e18_select(" is_draft, contract_status,") + ")")


def _g13_sql() -> str:
    from ..operators import registry as R
    inv = ", ".join(f"'{x}'" for x in R.INVALID_JURISDICTIONS)

    def valid(c):
        v = f"lower(trim(coalesce({c}, '')))"
        ind = " OR ".join(f"contains({v}, '{w}')" for w in R.VALID_JURISDICTION_WORDS)
        return (f"(CASE WHEN coalesce({c}, '') = '' THEN FALSE WHEN {v} IN ({inv}) THEN FALSE WHEN {ind} THEN TRUE "
                f"WHEN length({v}) = 2 AND regexp_matches({v}, '^[a-z]{{2}}$') THEN TRUE ELSE length({v}) > 4 END)")
    return with_fact(f"""
SELECT c.contract_id,
  CASE WHEN c.is_child AND NOT {valid('c.law')} AND {valid('p.law')} THEN 'Yes' ELSE 'No' END AS terms_inherited,
  CASE WHEN c.is_child AND NOT {valid('c.law')} AND {valid('p.law')} THEN p.law END AS inherited_jurisdiction
FROM (SELECT r.contract_id, r.registry_id, r.parent_registry_id, nullif(k.governing_law, '') AS law,
        r.hierarchy IN ('SOW', 'Amendment', 'Schedule') AND coalesce(r.parent_registry_id, '') <> '' AS is_child
      FROM registry r JOIN contracts k USING (contract_id)) c
LEFT JOIN (SELECT r.registry_id, nullif(k.governing_law, '') AS law FROM registry r JOIN contracts k USING (contract_id)) p
  ON p.registry_id = c.parent_registry_id""", ctes=_registry_ctes())
ORACLE["g13_export_inheritance"] = _g13_sql()


def _e28_sql() -> str:
    def valid(c):
        from ..operators import registry as R
        v = f"lower(trim(coalesce({c}, '')))"
        ind = " OR ".join(f"contains({v}, '{w}')" for w in R.VALID_JURISDICTION_WORDS)
        inv = ", ".join(f"'{x}'" for x in R.INVALID_JURISDICTIONS)
        return (f"(CASE WHEN coalesce({c}, '') = '' THEN FALSE WHEN {v} IN ({inv}) THEN FALSE WHEN {ind} THEN TRUE "
                f"WHEN length({v}) = 2 AND regexp_matches({v}, '^[a-z]{{2}}$') THEN TRUE ELSE length({v}) > 4 END)")
    countries = (("england", "England and Wales"), ("united kingdom", "England and Wales"), ("uk", "England and Wales"),
                 ("germany", "Germany"), ("deutschland", "Germany"), ("france", "France"), ("netherlands", "Netherlands"),
                 ("australia", "Australia"), ("singapore", "Singapore"), ("hong kong", "Hong Kong"), ("japan", "Japan"),
                 ("canada", "Ontario, Canada"))
    # States and their codes.
    states = (("colorado", "co"), ("california", "ca"), ("new york", "ny"), ("texas", "tx"), ("florida", "fl"), ("michigan", "mi"),
              ("illinois", "il"), ("georgia", "ga"), ("delaware", "de"), ("massachusetts", "ma"), ("washington", "wa"), ("virginia", "va"),
              ("north carolina", "nc"), ("arizona", "az"), ("nevada", "nv"), ("oregon", "or"), ("minnesota", "mn"), ("wisconsin", "wi"),
              ("tennessee", "tn"), ("ohio", "oh"), ("pennsylvania", "pa"))
    country = " ".join(f"WHEN contains(a, '{w}') THEN '{j}'" for w, j in countries)
    state = " ".join(f"WHEN regexp_matches(a, '\\b{n}\\b|\\b{code}\\s+[0-9]{{5}}') THEN '{n.title()}'" for n, code in states)
    inherited = ORACLE["g13_export_inheritance"]
    head, tail = inherited.rsplit("SELECT c.contract_id,", 1)
    return f"""{head}
SELECT contract_id, CASE WHEN {valid('law')} THEN law
    WHEN child AND {valid('inherited_jurisdiction')} THEN inherited_jurisdiction || ' (from MSA)'
    {country} WHEN region = 'North America' THEN CASE {state} ELSE 'Colorado (default - requires verification)' END
    ELSE 'Requires Review' END AS jurisdiction
FROM (SELECT r.contract_id, r.hierarchy IN ('SOW', 'Amendment', 'Schedule') AS child, k.governing_law AS law, k.region,
             lower(coalesce(k.counterparty_address, '')) AS a, i.inherited_jurisdiction
      FROM registry r JOIN contracts k USING (contract_id)
      LEFT JOIN (SELECT c.contract_id, {tail}) i USING (contract_id))"""


ORACLE["e28_jurisdiction"] = _e28_sql()


def _e6_sql() -> str:
    from ..config import FIXTURE_CONFIG as C
    from ..operators import region as RG
    t = "lower(coalesce(contract_type, ''))"
    fb = "CASE " + " ".join(f"WHEN contains({t}, '{k}') THEN '{d}'" for k, d in RG.DEPARTMENT_MAP) + " ELSE 'General' END"
    keys = ", ".join(f"'{k}'" for k in RG.NA_APAC_REGION_KEYS)
    low = "lower(coalesce(counterparty_address, ''))"
    emea = " OR ".join(f"contains({low}, '{w}')" for w in RG.EMEA_KEYWORDS)
    na = " OR ".join(f"contains({low}, '{w}')" for w in RG.NA_ADDRESS_KEYWORDS)
    ap = " OR ".join(f"contains({low}, '{w}')" for w in RG.APAC_ADDRESS_KEYWORDS)
    rr = (f"COALESCE(CASE WHEN trim(coalesce(region, '')) <> '' THEN region END, CASE WHEN {low} = '' THEN NULL "
          f"WHEN {emea} THEN 'EMEA' WHEN {na} THEN 'North America' WHEN {ap} THEN 'APAC' END)")
    return with_fact(f"""
SELECT contract_id, CASE WHEN dist THEN 'NA APAC Distributor Management' ELSE {fb} END AS department,
  CASE WHEN dist THEN '{C.distribution_owner}' ELSE '{C.default_owner}' END AS owner,
  CASE WHEN '{C.default_co_owner}' <> (CASE WHEN dist THEN '{C.distribution_owner}' ELSE '{C.default_owner}' END)
       THEN '{C.default_co_owner}' ELSE '' END AS co_owner
FROM (SELECT *, contains({t}, 'distributor') AND lower(coalesce({rr}, '')) IN ({keys}) AS dist FROM contracts)""")


ORACLE["e6_department_owner"] = _e6_sql()


def _b2_sql() -> str:
    from ..operators.gaps import FIELD_NAMES  # noqa: F401
    pairs = ("list_transform(inherited_kv, lambda p: to_json(p[1]) || ': ' || to_json(p[2]))")
    return with_fact(f"""
SELECT contract_id,
  CASE WHEN len(missing) > 0 THEN array_to_string(missing, ', ') END AS missing_text,
  '[' || array_to_string(list_transform(cats, lambda x: to_json(x)), ', ') || ']' AS categories_json,
  '{{' || array_to_string({pairs}, ', ') || '}}' AS inherited_json,
  '{{' || array_to_string(list_transform(list_sort(inherited_kv), lambda p: to_json(p[1]) || ': ' || to_json(p[2])), ', ') || '}}' AS inherited_json_sorted
FROM (SELECT *, list_transform(inherited_pairs, lambda s: [split_part(s, '=', 1), substr(s, strpos(s, '=') + 1)]) AS inherited_kv FROM gaps)""",
                     ctes=_gap_ctes())


ORACLE["b2_flatten_metadata"] = _b2_sql()


# Literals written out here, apart from the DataFrame code's patterns.
_DATE = r"(?:\d{1,2}\s+[A-Za-z]+,?\s+\d{4}|[A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"
_UNIT = r"\s*(?:days?|months?|years?))"
_WORD_NUMBER = (r"(?i)((?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|eighteen|twenty|twenty-?four|"
                r"thirty|thirty-?six|forty-?five|sixty|ninety|one\s+hundred\s+(?:twenty|eighty))\s*\(\d+\)")


def _date_text(c: str, out: str, src: str) -> str:
    """``src`` with a column ``out``: the date text ``c`` normalised as in C7."""
    s = c
    for typo, right in (("Seplember", "September"), ("Septmber", "September"), ("Sepetmber", "September"),
                        ("Janurary", "January"), ("Febuary", "February"), ("Feburary", "February"), ("Apirl", "April"),
                        ("Augest", "August"), ("Augst", "August"), ("Ocotber", "October"), ("Novmber", "November"),
                        ("Decmber", "December")):
        s = f"regexp_replace({s}, '{typo}', '{right}', 'gi')"
    tries = ", ".join(f"try_strptime(trim({out}0), '{f}')" for f in (
        "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y", "%d %B, %Y", "%d %B %Y", "%d %b, %Y", "%d %b %Y", "%Y-%m-%d",
        "%m/%d/%Y", "%d/%m/%Y"))
    return (f"(SELECT *, CASE WHEN COALESCE({tries}) IS NOT NULL THEN strftime(COALESCE({tries}), '%m/%d/%Y') "
            f"ELSE {out}0 END AS {out} FROM (SELECT *, {s} AS {out}0 FROM {src}))")


def _work_order_sql() -> dict[str, str]:
    docs = "(SELECT contract_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS tn FROM contract_documents)"
    both = rf"(?i)(?:project\s+)?start\s+date\s+(?:shall\s+be|is)\s+({_DATE})\s+and\s+(?:shall\s+)?end\s+({_DATE})"
    starts = [rf"(?:project\s+)?start\s+date\s+(?:shall\s+be|is|:)\s*({_DATE})",
              rf"(?:commencement|commence)\s+(?:date\s+)?(?:shall\s+be|is|on|:)\s*({_DATE})",
              rf"services?\s+(?:shall\s+)?(?:commence|begin)\s+(?:on\s+)?({_DATE})"]
    ends = [rf"(?:project\s+)?end\s+date\s+(?:shall\s+be|is|:)\s*({_DATE})", rf"(?:shall\s+)?end\s+(?:on\s+)?({_DATE})",
            rf"completion\s+date\s+(?:shall\s+be|is|of|:)\s*({_DATE})",
            rf"services?\s+(?:shall\s+)?(?:end|terminate|conclude)\s+(?:on\s+)?({_DATE})"]
    done = (r"(?i)(?:shall|will)\s+terminate\s+upon\s+completion|terminat(?:e|es)\s+upon\s+(?:the\s+)?completion\s+of\s+(?:the\s+)?services"
            r"|until\s+(?:the\s+)?completion\s+of\s+(?:the\s+)?(?:project|services|work)")
    refs = [rf"(?:Master\s+)?(?:Services?\s+)?Agreement.*?(?:dated|effective)\s+(?:as\s+of\s+)?({_DATE})",
            rf"pursuant\s+to\s+(?:the\s+)?(?:Master\s+)?(?:Services?\s+)?Agreement.*?dated\s+({_DATE})",
            rf"under\s+(?:the\s+)?(?:MSA|Master\s+(?:Services?\s+)?Agreement).*?dated\s+({_DATE})",
            rf"Statement\s+of\s+Work.*?(?:appended|attached|subject).*?(?:dated|effective)\s+(?:as\s+of\s+)?({_DATE})"]

    def pick(g, alone):
        return f"trim(CASE WHEN regexp_matches(tn, {_rx(both)}) THEN regexp_extract(tn, {_rx(both)}, {g}) ELSE {_first('tn', alone)} END)"
    raw = f"(SELECT contract_id, {pick(1, starts)} AS s, {pick(2, ends)} AS e, regexp_matches(tn, {_rx(done)}) AS sow_completion_based FROM {docs})"
    dates = _date_text("e", "sow_end_date", _date_text("s", "sow_start_date", raw))
    ref = f"(SELECT contract_id, trim({_first('t', refs)}) AS d, lower({_first('t', refs, group=0)}) AS phrase FROM {docs})"
    sections = (("PREAMBLE", r"THIS AGREEMENT.{0,100}WHEREAS"), ("TERM_AND_TERMINATION", "TERM AND TERMINATION|Term of Agreement"),
                ("PAYMENT_TERMS", "PAYMENT|Compensation|Fees"), ("CONFIDENTIALITY", "CONFIDENTIALITY|Non-Disclosure"),
                ("SIGNATURES", "IN WITNESS WHEREOF|EXECUTED|Signature:"))
    found = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(?is){p}') THEN '{n}' END" for n, p in sections) + "], lambda x: x IS NOT NULL)"
    return {
        "c12c_duration": with_fact(f"SELECT contract_id, trim({_first('t', [])}) AS duration FROM {docs}".replace(
            "COALESCE()", f"COALESCE(nullif(regexp_extract(t, {_rx(_WORD_NUMBER + _UNIT)}, 1), ''), "
                          f"nullif(regexp_extract(t, {_rx('(?i)([0-9]{1,3}' + _UNIT)}, 1), ''))")),
        "c13k_work_order_dates": with_fact(f"SELECT contract_id, sow_start_date, sow_end_date, sow_completion_based FROM {dates}"),
        "c13l_parent_reference": with_fact(f"""SELECT contract_id, parent_agreement_date,
            CASE WHEN contains(phrase, 'master') OR contains(phrase, 'msa') THEN 'MSA' WHEN contains(phrase, 'service') THEN 'Services Agreement'
                 WHEN phrase IS NOT NULL THEN 'Agreement' END AS parent_agreement_type FROM {_date_text('d', 'parent_agreement_date', ref)}"""),
        "c32_department_facts": with_fact(f"""
            SELECT contract_id, department, CASE department WHEN 'Legal' THEN array_to_string(found, ', ')
              WHEN 'Sales' THEN 'payment ' || CASE WHEN list_contains(found, 'PAYMENT_TERMS') THEN 'found' ELSE 'not found' END
                || ', termination ' || CASE WHEN list_contains(found, 'TERM_AND_TERMINATION') THEN 'found' ELSE 'not found' END
              ELSE CAST(len(found) AS VARCHAR) || ' sections' END AS facts
            FROM (SELECT contract_id, {found} AS found, unnest(['Legal', 'Sales', 'Procurement']) AS department FROM {docs})"""),
    }


ORACLE.update(_work_order_sql())


def _c7_sql() -> str:
    from ..functions.dates import MONTH_TYPOS
    from ..operators.clauses import EFFECTIVE_DATE_PATTERNS
    raw = "trim(" + _first("t", EFFECTIVE_DATE_PATTERNS) + ")"
    s = "raw"
    for typo, right in MONTH_TYPOS:
        s = f"regexp_replace({s}, '{typo}', '{right}', 'gi')"
    dof = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+day\s+of\s+([A-Za-z]+),?\s+(\d{4})"
    fixed = (f"CASE WHEN regexp_matches(s1, '{dof}') THEN regexp_extract(s1, '{dof}', 2) || ' ' || "
             f"regexp_extract(s1, '{dof}', 1) || ', ' || regexp_extract(s1, '{dof}', 3) ELSE s1 END")
    fmts = ("%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y", "%d %B, %Y", "%d %B %Y", "%d %b, %Y", "%d %b %Y",
            "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y")
    parsed = "COALESCE(" + ", ".join(f"try_strptime(trim(s2), '{f}')" for f in fmts) + ")"
    return with_fact(f"""
SELECT contract_id, raw, CASE WHEN {parsed} IS NOT NULL THEN strftime({parsed}, '%m/%d/%Y') ELSE s2 END AS effective_date_extracted
FROM (SELECT *, {fixed} AS s2 FROM (SELECT *, {s} AS s1 FROM (SELECT contract_id, {raw} AS raw FROM
  (SELECT contract_id, coalesce(text, '') AS t FROM contract_documents))))""")


ORACLE["c7_effective_date_extracted"] = _c7_sql()



def _e5_sql() -> str:
    from ..config import FIXTURE_CONFIG as C
    from ..operators import region as RG

    def has(c, words):
        return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"

    def owners(*names):
        out = []
        for n in names:
            if n and n not in out:
                out.append(n)
        if not out and C.default_contract_owner:
            out.append(C.default_contract_owner)
        if C.default_contract_co_owner and C.default_contract_co_owner not in out:
            out.append(C.default_contract_co_owner)
        return out
    legal = owners(C.owner_legal)

    def arr(v):
        return "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
    low = "lower(coalesce(counterparty_address, ''))"
    addr = (f"CASE WHEN {has(low, [w.lower() for w in RG.EMEA_COUNTRIES])} THEN 'EMEA' "
            f"WHEN {has(low, [w.lower() for w in RG.NA_LOCATIONS])} THEN 'North America' "
            f"WHEN {has(low, [w.lower() for w in RG.APAC_COUNTRIES])} THEN 'APAC' END")
    t = "lower(coalesce(contract_type, ''))"
    r = "lower(coalesce(rg, ''))"
    dist_dep = (f"CASE WHEN {r} IN ('emea', 'europe', 'europe, middle east and africa') THEN 'EMEA Distribution' "
                f"WHEN {r} IN ('north america', 'na', 'apac', 'asia pac', 'asia-pacific') THEN 'NA APAC Distributor Management' "
                f"ELSE 'NA Distribution' END")
    dist_own = (f"CASE WHEN {r} IN ('emea', 'europe', 'europe, middle east and africa') THEN {arr(owners(C.owner_distribution_emea, C.owner_legal) or legal)} "
                f"WHEN {r} IN ('north america', 'na', 'apac', 'asia pac', 'asia-pacific') THEN {arr(owners(C.owner_distribution_na_apac, C.owner_legal) or legal)} "
                f"ELSE {arr(owners(C.owner_distribution_na, C.owner_legal) or legal)} END")
    dep = (f"CASE WHEN {has(t, RG.MARKETING_KEYWORDS)} THEN 'Marketing' WHEN {has(t, RG.PROCUREMENT_KEYWORDS)} THEN 'Procurement' "
           f"WHEN {has(t, RG.DISTRIBUTION_KEYWORDS)} THEN {dist_dep} ELSE 'Legal' END")
    own = (f"CASE WHEN {has(t, RG.MARKETING_KEYWORDS)} THEN {arr(owners(C.owner_legal, C.owner_marketing))} "
           f"WHEN {has(t, RG.PROCUREMENT_KEYWORDS)} THEN {arr(owners(C.owner_legal, C.owner_procurement))} "
           f"WHEN {has(t, RG.DISTRIBUTION_KEYWORDS)} THEN {dist_own} ELSE {arr(legal)} END")
    e1 = _e1_sql("contracts", " contract_type, counterparty_address,")
    return with_fact(f"""
SELECT contract_id, rg AS region, {dep} AS sharepoint_department, ({own})[1] AS sharepoint_owner_primary,
  array_to_string({own}, ', ') AS sharepoint_owners
FROM (SELECT *, COALESCE(region, {addr}) AS rg FROM ({e1}))""")


ORACLE["e5_ingest_routing"] = _e5_sql()


def _e39_sql() -> str:
    from ..operators.clauses import ENTERPRISE_TYPES
    et = "CASE " + " ".join(f"WHEN contains(lower(coalesce(d.text, '')), '{x.lower()}') THEN '{x}'"
                            for x in ENTERPRISE_TYPES) + " END"
    t = "lower(coalesce(c.contract_type, ''))"
    return with_fact(f"""
SELECT contract_id, current_type,
  CASE current_type WHEN 'Statement of Work (SOW)' THEN 'MSA (Parent) -> SOW (Current)'
    WHEN 'Amendment' THEN 'Original Contract -> Amendment (Current)'
    WHEN 'Master Service Agreement (MSA)' THEN 'MSA (Current) -> SOWs (Children)' ELSE '' END AS document_hierarchy,
  CASE current_type WHEN 'Statement of Work (SOW)' THEN 'Master Service Agreement (MSA)'
    WHEN 'Amendment' THEN 'Original Contract' ELSE '' END AS parent_contracts,
  CASE WHEN current_type = 'Master Service Agreement (MSA)' THEN 'Statements of Work (SOWs)' ELSE '' END AS child_contracts,
  CASE current_type WHEN 'Statement of Work (SOW)' THEN 'Review parent MSA for governing terms'
    WHEN 'Amendment' THEN 'Identify base contract for amendment tracking'
    WHEN 'Master Service Agreement (MSA)' THEN 'Track all SOWs executed under this MSA' ELSE '' END AS related_documents,
  primary_role, counterparty_role
FROM (SELECT d.contract_id, {et} AS current_type,
  CASE WHEN contains({t}, 'reseller') OR contains({t}, 'distributor') THEN 'Vendor' WHEN contains({t}, 'nda') THEN 'Discloser'
       ELSE 'Client' END AS primary_role,
  CASE WHEN contains({t}, 'reseller') THEN 'Reseller' WHEN contains({t}, 'distributor') THEN 'Distributor'
       WHEN contains({t}, 'nda') THEN 'Recipient' WHEN contains({t}, 'procurement') OR contains({t}, 'vendor') THEN 'Vendor'
       WHEN contains({t}, 'hotel') THEN 'Hotel' WHEN contains({t}, 'contractor') THEN 'Contractor' ELSE 'Party' END AS counterparty_role
  FROM contract_documents d JOIN contracts c USING (contract_id))""")


ORACLE["e39_relationship_map"] = _e39_sql()


ORACLE["c15_defined_terms"] = with_fact(r"""
SELECT contract_id, CAST(ordinal AS INTEGER) AS ordinal,
  regexp_replace(f, '^\s+|\s+$', '', 'g') AS full_term, regexp_replace(s, '^\s+|\s+$', '', 'g') AS short_term
FROM (SELECT contract_id, unnest(range(1, len(fl) + 1)) AS ordinal, unnest(fl) AS f, unnest(sl) AS s FROM (
  SELECT contract_id, regexp_extract_all(coalesce(text, ''), '([^()"]+?)\s*\((?:the\s+)?"([^"]+)"\)', 1) AS fl,
         regexp_extract_all(coalesce(text, ''), '([^()"]+?)\s*\((?:the\s+)?"([^"]+)"\)', 2) AS sl
  FROM contract_documents))""")


def _e30_sql() -> str:
    from ..config import FIXTURE_CONFIG as C
    from ..operators import registry as R
    full = "CASE " + " ".join(f"WHEN type_code = '{k}' THEN '{v}'" for k, v in R.TYPE_FULL_NAMES) + " END"
    mapped = "CASE upper(trim(hierarchy)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.HIERARCHY_TITLES) + " END"
    title = (f"COALESCE({full}, NULLIF(hierarchy, ''), 'Contract') || ' - ' || "
             f"CASE WHEN coalesce(counterparty, '') IN ('', 'Unknown') THEN '{C.primary_company_display}' ELSE counterparty END")
    return with_fact(f"""
SELECT contract_id, {title} AS contract_title,
  COALESCE({mapped}, CASE WHEN contains({title}, ' - ') THEN trim(split_part({title}, ' - ', 1)) ELSE trim({title}) END) AS simplified_title
FROM r4""", ctes=_registry_ctes())


ORACLE["e30_contract_titles"] = _e30_sql()


def _c17_sql() -> str:
    from ..operators import clauses as C
    ptype = "CASE " + " ".join(f"WHEN contains(lower(pre), '{x.lower()}') THEN '{x}'" for x in C.PREAMBLE_TYPES) + " END"
    return with_fact(f"""
SELECT contract_id, CAST(length(pre) AS INTEGER) AS preamble_chars, {ptype} AS preamble_type,
  NULLIF(regexp_extract(t, {_rx(C.TERM_BLOCK)}, 1), '') IS NOT NULL AS has_term_block,
  CASE WHEN len(regexp_extract_all(coalesce(sig, ''), 'DATE:\\s*([^\\n]+)', 1)) > 0
       THEN array_to_string(regexp_extract_all(coalesce(sig, ''), 'DATE:\\s*([^\\n]+)', 1), ', ') END AS signature_dates
FROM (SELECT contract_id, t, regexp_extract(t, {_rx(C.PREAMBLE)}, 1) AS pre,
        CASE WHEN contains(t, 'IN WITNESS WHEREOF') THEN regexp_extract(t, {_rx(C.SIGNATURES)}, 1) END AS sig
      FROM (SELECT contract_id, coalesce(text, '') AS t FROM contract_documents))""")


ORACLE["c17_section_blocks"] = _c17_sql()
ORACLE["a8_force_reprocess"] = ORACLE["a7_idempotent_ingest"]


from .oracle_agreements import ORACLE as _AGREEMENTS  # noqa: E402
from .oracle_agreements import strict_export as _strict_export  # noqa: E402

ORACLE.update(_AGREEMENTS)
ORACLE["b11_strict_export"] = _strict_export(_registry_ctes(), _e18_select(
    " filename, counterparty_name, counterparty_address, governing_law, gdpr_applicable, expiration_date,"), FACT_CTE)


# ------------------------------------------------------------- repair
_REPLY = """
rp0 AS (
 SELECT g.*, k._pos % 4 AS shape, regexp_extract(k.text, '[Pp]ayment is due within (\\d+ days)', 1) AS pay,
  regexp_extract(k.text, 'laws of the ((?:State of )?[A-Z][a-z]+)', 1) AS law
 FROM gaps g JOIN contracts k USING (contract_id)),
rp AS (
 SELECT *, list_transform(missing, lambda f: CASE WHEN f = 'payment_terms' AND pay <> '' THEN pay WHEN f = 'governing_law' AND law <> '' THEN law
   ELSE 'per master agreement' END) AS vals,
  CASE WHEN len(missing) = 0 THEN 'prefilled' WHEN shape = 2 THEN 'parse_failed' WHEN shape = 3 THEN 'rejected' ELSE 'applied' END AS status FROM rp0),
rl AS (
 SELECT *, list_transform(list_zip(missing, vals), lambda z: '"' || z[1] || '":"' || z[2] || '"') AS pairs FROM rp)"""
ORACLE["g9_parse_responses"] = with_fact("""
SELECT contract_id, CASE WHEN shape <> 2 THEN '{' || array_to_string(list_concat(list_reverse(pairs),
   ['"confidence":"' || CASE shape WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END || '"', '"contract_id":"' || contract_id || '"'],
   CASE WHEN shape = 1 AND pay <> '' AND NOT list_contains(missing, 'payment_terms') THEN ['"payment_terms":"' || pay || '"'] ELSE [] END,
   CASE WHEN shape = 1 THEN ['"notes":"first pass | second pass"'] ELSE [] END), ',') || '}' END AS payload
FROM rl""", ctes=_gap_ctes() + "," + _REPLY)
ORACLE["g12_repair_log"] = with_fact("""
SELECT contract_id, status, CASE WHEN shape = 3 THEN 'Confidence not provided or too low' ELSE '' END AS notes,
  CASE WHEN status = 'applied' THEN '{' || array_to_string(pairs, ',') || '}' END AS applied_fields
FROM rl""", ctes=_gap_ctes() + "," + _REPLY)
ORACLE["g12_repair_summary"] = with_fact("""
SELECT count(*) AS attempted, count(*) FILTER (WHERE status IN ('prefilled', 'applied')) AS successful FROM rl""", ctes=_gap_ctes() + "," + _REPLY)


def _patched(f: str) -> str:
    new = (f"CASE WHEN list_contains(inherited, '{f}') THEN p_{f} WHEN status = 'applied' AND list_contains(missing, '{f}') "
           f"THEN vals[list_position(missing, '{f}')] END")
    return f"CASE WHEN {_m('k.' + f)} AND {new} IS NOT NULL THEN {new} ELSE k.{f} END AS {f}"


ORACLE["g11_patched_snapshot"] = with_fact(f"""
SELECT k.contract_id, {', '.join(_patched(f) for f in ('payment_terms', 'governing_law', 'counterparty_address', 'counterparty_name', 'gdpr_applicable'))}
FROM contracts k LEFT JOIN rl USING (contract_id)""", ctes=_gap_ctes() + "," + _REPLY)
ORACLE["e28_export_jurisdiction"] = f"""
SELECT contract_id, CASE WHEN _pos % 13 = 0 THEN 'Denmark' WHEN jurisdiction LIKE '%(from MSA)' OR jurisdiction = governing_law THEN jurisdiction
  WHEN _pos % 7 = 1 THEN 'Republic of Peru' WHEN jurisdiction LIKE '%(default - requires verification)' THEN trim(string_split(jurisdiction, '(')[1])
  ELSE jurisdiction END AS jurisdiction
FROM ({ORACLE["e28_jurisdiction"]}) JOIN (SELECT contract_id, _pos, governing_law FROM ({with_fact("SELECT * FROM contracts")})) USING (contract_id)"""


def _notice(c: str) -> str:
    one = lambda u, n: f"TRY_CAST(NULLIF(regexp_extract({c}, '(?i)(\\d+)\\s*{u}', 1), '') AS INTEGER) * {n}"
    return f"CASE WHEN {c} NOT IN ('', 'Unknown', 'Not found') THEN COALESCE({one('day', 1)}, {one('month', 30)}, {one('week', 7)}) END"


ORACLE["e26_notification_terms"] = with_fact(f"""
SELECT contract_id, CASE WHEN _pos % 10 = 0 OR _pos % 9 = 0 THEN 'Yes' ELSE 'No' END AS perpetual,
  CASE WHEN _pos % 3 = 0 THEN coalesce(payment_terms, '') ELSE '' END AS perpetual_notice,
  CASE WHEN _pos % 3 = 0 THEN {_notice('payment_terms')} END AS perpetual_notice_days,
  CAST(COALESCE(CASE WHEN _pos % 5 = 0 THEN _pos % 90 WHEN _pos % 5 = 1 THEN {_notice('payment_terms')} END, CASE WHEN _pos % 4 = 0 THEN _pos % 50 END,
    CASE WHEN contains(lower(coalesce(contract_type, '')), 'nda') THEN 30 WHEN contains(lower(coalesce(contract_type, '')), 'master')
      OR contains(lower(coalesce(contract_type, '')), 'msa') THEN 90 WHEN contains(lower(coalesce(contract_type, '')), 'reseller')
      OR contains(lower(coalesce(contract_type, '')), 'distributor') THEN 60 ELSE 30 END) AS INTEGER) AS notification_days,
  CAST(CASE WHEN _pos % 6 = 0 THEN 14 WHEN _pos % 6 = 1 THEN 17 ELSE COALESCE({_notice('payment_terms')}, 30) END AS INTEGER) AS buffer_days
FROM contracts""")
