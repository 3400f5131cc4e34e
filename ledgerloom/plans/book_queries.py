"""Queries over the book of business: functions, checks, tie-out, clean tables, runs, revenue, versions, gates, mapping."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, identifiers, money, redaction, text
from ledgerloom.operators import checks, clean, compare_runs, findings, gates, mapping, multivalue, numbering, replay, revenue, tieout, versions
from ledgerloom.runtime import bounded, durable, stamp, table

#: The day on which ages and ends are judged, tolerances and terms of the queries below.
AS_OF = "2026-10-31"
LINE_USD, LINE_PCT, TOTAL_PCT, NEW_MONTHS = "1.00", "0.01", "0.005", 12
STATUSES = ["ACTIVE", "PENDING", "TERMINATED", "CANCELLED", "UNKNOWN"]
CATEGORIES = ["NEW", "RENEWAL", "OVERRIDE", "CHARGEBACK", "unclassified"]
LINE_CONTENT = ["carrier", "statement_period", "line_no", "carrier_member_id", "member_name", "member_dob", "policy_ref", "agent_npn", "amount", "commission_type", "paid_date"]
POLICY_CONTENT = ["client_id", "carrier", "plan_id", "line_of_business", "state", "effective_date", "termination_date", "status", "writing_agent_npn", "monthly_premium", "carrier_member_id"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


# functions ----------------------------------------------------------------------------------------------
@query(f"SELECT line_id, {dates.sql_date_loose('member_dob')} AS born FROM statement_lines")
def fn_dates_loose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statement_lines").select("line_id", dates.parse_date_loose(F.col("member_dob")).alias("born"))


@query("SELECT line_id, CAST(amount AS DECIMAL(12,2)) AS value, CASE WHEN amount IS NULL THEN 'BLANK' END AS problem FROM statement_lines")
def fn_money_loose(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written as statements write them, with sign, brackets and commas, and read back."""
    lines = table(spark, d, "statement_lines")
    written = F.when(F.col("amount") < 0, F.concat(F.lit("("), F.format_number(-F.col("amount"), 2), F.lit(")"))).otherwise(F.concat(F.lit("$ "), F.format_number("amount", 2)))
    return lines.select("line_id", money.parse_money(written).alias("m")).select("line_id", "m.*")


@query(r"""SELECT rec_id, regexp_replace(lower(first_name || ' ' || last_name), '[^a-z]', '', 'g') AS name_key,
  array_to_string(CASE WHEN len(list_filter(w, lambda x: x NOT IN ('jr','sr','ii','iii'))) > 0 THEN list_filter(w, lambda x: x NOT IN ('jr','sr','ii','iii')) ELSE w END, ' ') AS normalized
  FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(first_name || ' ' || last_name), '[''’]', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM clients)""")
def fn_names(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat("first_name", F.lit(" "), "last_name")
    return table(spark, d, "clients").select("rec_id", text.name_key(full).alias("name_key"), text.normalize_name(full).alias("normalized"))


_T = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query(rf"""SELECT rec_id, regexp_full_match(upper(replace({_T.format(c='mbi')}, '-', '')), '[1-9][AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9][AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9][AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y][0-9]{{2}}') AS card_ok,
  regexp_full_match({_T.format(c='zip')}, '\d{{5}}(-?\d{{4}})?') AS zip_ok,
  CASE WHEN regexp_full_match({_T.format(c='zip')}, '\d{{5}}(-?\d{{4}})?') THEN substr({_T.format(c='zip')}, 1, 3) END AS zip3,
  CASE WHEN length(p) = 10 THEN p END AS phone10,
  CASE WHEN regexp_full_match(lower({_T.format(c='email')}), '[^@\s]+@[^@\s]+\.[^@\s]+') THEN lower({_T.format(c='email')}) END AS email_norm
  FROM (SELECT *, CASE WHEN length(q) = 11 AND q[1] = '1' THEN substr(q, 2) ELSE q END AS p FROM (SELECT *, regexp_replace(regexp_replace(phone, '(?i)\s*(x|ext\.?)\s*\d+\s*$', ''), '\D', '', 'g') AS q FROM clients))""")
def fn_identifiers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "clients").select(
        "rec_id", identifiers.is_medicare_card(c("mbi")).alias("card_ok"), identifiers.is_zip(c("zip")).alias("zip_ok"), identifiers.zip3(c("zip")).alias("zip3"),
        identifiers.normalize_phone(c("phone")).alias("phone10"), identifiers.normalize_email(c("email")).alias("email_norm"))


@query(r"""SELECT rec_id, CASE WHEN ok THEN regexp_extract(t, '^([HRS])(\d{4})', 0) END AS contract, CASE WHEN ok THEN regexp_extract(t, '^[HRS]\d{4}-(\d{3})', 1) END AS plan,
  CASE WHEN ok THEN CASE WHEN t[1] = 'S' THEN 'drug' ELSE 'health' END END AS kind, regexp_full_match(trim(plan_id), '\d{5}[A-Z]{2}\d{7}(-\d{2})?') AS marketplace, regexp_full_match(trim(plan_id), '(?i)(PLAN\s+)?[ABCDFGKLMN](\s+HIGH\s+DEDUCTIBLE)?') AS medigap
  FROM (SELECT *, upper(trim(plan_id)) AS t, regexp_full_match(upper(trim(plan_id)), '([HRS])(\d{4})-(\d{3})(?:-(\d{1,3}))?') AS ok FROM policies)""")
def fn_plan_ids(spark: SparkSession, d: str) -> DataFrame:
    p, c = identifiers.plan_parts(F.col("plan_id")), F.col("plan_id")
    return table(spark, d, "policies").select("rec_id", p["contract"].alias("contract"), p["plan"].alias("plan"), p["kind"].alias("kind"), identifiers.is_marketplace_plan(c).alias("marketplace"), identifiers.is_medigap_letter(c).alias("medigap"))


@query(r"""SELECT rec_id, CASE WHEN length(m) > 32 THEN substr(m, 1, 32) || '...' ELSE m END AS masked,
  substr(regexp_replace(regexp_replace(address_line1, '\p{N}', '9', 'g'), '\p{L}', 'A', 'g'), 1, 32) AS shape
  FROM (SELECT *, substr(email, 1, least(2, length(email) // 3)) || regexp_replace(substr(email, CAST(least(2, length(email) // 3) + 1 AS BIGINT)), '[\p{L}\p{N}]', '*', 'g') AS m FROM clients)""")
def fn_masks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clients").select("rec_id", text.mask(F.col("email")).alias("masked"), text.shape(F.col("address_line1")).alias("shape"))


@query("""SELECT rec_id, CAST(year(DATE '2026-10-31') - year(dob) - CASE WHEN (10, 31) < (month(dob), day(dob)) THEN 1 ELSE 0 END AS INT) AS age,
  CAST((2026 - year(dob)) * 12 + 10 - month(dob) AS INT) AS months, last_day(dob) AS month_end FROM clients""")
def fn_ages(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit(AS_OF).cast("date")
    return table(spark, d, "clients").select("rec_id", dates.age_on(F.col("dob"), day).alias("age"), dates.months_between(F.col("dob"), day).alias("months"), F.last_day("dob").alias("month_end"))


_HASHED = ["carrier", "carrier_member_id", "member_name", "member_dob", "policy_ref", "agent_npn"]


@query("SELECT line_id, sha256(" + " || chr(31) || ".join(f"coalesce({c}, '')" for c in _HASHED) + ") AS row_hash FROM statement_lines")
def fn_row_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statement_lines").select("line_id", text.row_hash([F.col(c) for c in _HASHED]).alias("row_hash"))


@query(r"""SELECT rec_id, CASE WHEN regexp_matches(ltrim(email), '^[=+@-]') OR regexp_matches(email, '^[\t\r\n]') THEN '''' || email ELSE email END AS guarded,
  array_to_string(list_filter(regexp_split_to_array(upper(license_states), '[|,;/\s]+'), lambda x: x <> ''), '|') AS states FROM agents""")
def fn_lists_and_guards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agents").select("rec_id", text.formula_guard(F.col("email")).alias("guarded"), F.array_join(text.split_list(F.col("license_states")), "|").alias("states"))


# checks -------------------------------------------------------------------------------------------------
@query(f"""SELECT row_id, first_id FROM (SELECT line_id AS row_id, min(line_id) OVER (PARTITION BY {', '.join(LINE_CONTENT)}) AS first_id FROM statement_lines) WHERE row_id > first_id""")
def chk_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return checks.later_copies(table(spark, d, "statement_lines"), "line_id", LINE_CONTENT)


_PC = ", ".join(POLICY_CONTENT)


@query(rf"""WITH t AS (SELECT rec_id, {_T.format(c='policy_id')} AS identity, ({_PC}) AS c FROM policies WHERE policy_id IS NOT NULL)
  SELECT t.rec_id AS row_id, t.identity FROM t JOIN (SELECT identity, arg_min(c, rec_id) AS c FROM t GROUP BY 1) f USING (identity) WHERE t.c IS DISTINCT FROM f.c""")
def chk_conflicting_ids(spark: SparkSession, d: str) -> DataFrame:
    return checks.conflicting_keys(table(spark, d, "policies"), "rec_id", "policy_id", POLICY_CONTENT)


@query(rf"""WITH t AS (SELECT n.rec_id AS row_id, c.client_id AS owner, n.normalized AS who, c.dob FROM ({SQL['fn_names']}) n JOIN clients c USING (rec_id) WHERE n.normalized <> '' AND c.dob IS NOT NULL)
  SELECT row_id, owner, group_id FROM (SELECT *, min(owner) OVER w AS group_id, max(owner) OVER w AS other FROM t WINDOW w AS (PARTITION BY who, dob)) WHERE group_id <> other""")
def chk_name_dob_collision(spark: SparkSession, d: str) -> DataFrame:
    return checks.shared_identity(table(spark, d, "clients"), "rec_id", F.concat("first_name", F.lit(" "), "last_name"), F.col("dob"), "client_id")


@query(rf"SELECT rec_id FROM policies p WHERE client_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM clients c WHERE {_T.format(c='c.client_id')} = {_T.format(c='p.client_id')})")
def chk_orphans(spark: SparkSession, d: str) -> DataFrame:
    clients = table(spark, d, "clients").select(text.strip(F.col("client_id")).alias("k")).distinct()
    return table(spark, d, "policies").where("client_id is not null").withColumn("k", text.strip(F.col("client_id"))).join(clients, "k", "left_anti").select("rec_id")


def _appointments(policies: DataFrame) -> DataFrame:
    """Stand-in for an appointment table: per agent, carrier and year, from a fortnight after the first sale to the first end."""
    return policies.where("writing_agent_npn is not null and effective_date is not null").groupBy("writing_agent_npn", "carrier", F.year("effective_date").alias("plan_year")).agg(
        F.date_add(F.min("effective_date"), 14).alias("start"), F.min("termination_date").alias("end"))


_APPOINT = "SELECT writing_agent_npn, carrier, CAST(year(effective_date) AS INT) AS plan_year, min(effective_date) + 14 AS b, min(termination_date) AS e FROM policies WHERE writing_agent_npn IS NOT NULL AND effective_date IS NOT NULL GROUP BY 1, 2, 3"


@query(f"""SELECT p.rec_id AS row_id, CASE WHEN p.writing_agent_npn IS NULL OR p.effective_date IS NULL THEN NULL WHEN a.b <= p.effective_date AND (a.e IS NULL OR a.e >= p.effective_date) THEN 'HELD' WHEN a.b <= p.effective_date THEN 'EXPIRED' ELSE 'MISSING' END AS state,
  CASE WHEN a.b <= p.effective_date AND a.e < p.effective_date THEN a.e END AS last_end
  FROM policies p LEFT JOIN ({_APPOINT}) a ON a.writing_agent_npn = p.writing_agent_npn AND a.carrier = p.carrier AND a.plan_year = year(p.effective_date)""")
def chk_interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "policies").withColumn("plan_year", F.year("effective_date"))
    return checks.interval_state(p, _appointments(p), ["writing_agent_npn", "carrier", "plan_year"], "rec_id", "effective_date")


_LIC = f"SELECT DISTINCT npn AS agent, upper(substr(license_value, 1, 2)) AS state FROM (SELECT v.license_value, a.npn FROM (SELECT * FROM p4) v JOIN agents a USING (rec_id)) WHERE npn IS NOT NULL AND regexp_matches(license_value, '^[A-Za-z]{{2}}($|[ ,;])')"


def _licences(spark: SparkSession, d: str) -> DataFrame:
    agents = table(spark, d, "agents")
    v = multivalue.explode_values(agents, "rec_id", "license_states").where(F.col("license_value").rlike("^[A-Za-z]{2}($|[ ,;])"))
    return v.join(agents.select("rec_id", F.col("npn").alias("agent")), "rec_id").where("agent is not null").select("agent", F.upper(F.substring("license_value", 1, 2)).alias("state")).distinct()


def _p4_sql() -> str:
    from ledgerloom.plans.data_quality_queries import SQL as other

    return other["p4_found"]


@query(f"""WITH p4 AS ({_p4_sql()}), lic AS ({_LIC})
  SELECT coalesce(l.agent, u.agent) AS agent, coalesce(l.state, u.state) AS state, CASE WHEN l.agent IS NULL THEN 'GAP' WHEN u.agent IS NULL THEN 'HELD' ELSE 'HELD_USED' END AS cell, coalesce(u.n, 0) AS events
  FROM lic l FULL OUTER JOIN (SELECT writing_agent_npn AS agent, state, count(*) AS n FROM policies WHERE writing_agent_npn IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2) u ON l.agent = u.agent AND l.state = u.state""")
def chk_coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "policies").where("writing_agent_npn is not null and state is not null").select(F.col("writing_agent_npn").alias("agent"), "state")
    m = checks.coverage_matrix(used.withColumnRenamed("state", "st"), _licences(spark, d).withColumnRenamed("state", "st"), ["agent", "st"])
    return m.select("agent", F.col("st").alias("state"), F.col("state").alias("cell"), "events")


@query(f"""WITH p4 AS ({_p4_sql()}), lic AS ({_LIC})
  SELECT rec_id AS row_id, writing_agent_npn AS agent, state FROM policies p WHERE state IS NOT NULL AND writing_agent_npn IN (SELECT agent FROM lic) AND NOT EXISTS (SELECT 1 FROM lic WHERE lic.agent = p.writing_agent_npn AND lic.state = p.state)""")
def chk_license_gap(spark: SparkSession, d: str) -> DataFrame:
    return checks.licence_gaps(table(spark, d, "policies"), _licences(spark, d), "rec_id", "writing_agent_npn", "state")


_CELLS = "SELECT writing_agent_npn AS agent, carrier || ' ' || CAST(year(effective_date) AS VARCHAR) AS cell FROM policies WHERE writing_agent_npn IS NOT NULL AND effective_date IS NOT NULL"


@query(f"SELECT agent, cell, n, CAST(sum(n) OVER (PARTITION BY agent) AS BIGINT) AS agent_total FROM (SELECT agent, cell, count(*) AS n FROM ({_CELLS}) GROUP BY 1, 2)")
def dash_agent_cells(spark: SparkSession, d: str) -> DataFrame:
    """The agent matrix in long form: sales by agent, carrier and year. The total per agent is a window over aggregated cells."""
    p = table(spark, d, "policies").where("writing_agent_npn is not null and effective_date is not null")
    cells = p.groupBy(F.col("writing_agent_npn").alias("agent"), F.concat_ws(" ", "carrier", F.year("effective_date").cast("string")).alias("cell")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return cells.withColumn("agent_total", F.sum("n").over(Window.partitionBy("agent")).cast("bigint"))


#: The carriers of the test tables, which SQL needs as columns.
_CARRIERS = ["Brackenfold", "Fennimore Shield", "Ostrana Care", "Penhallow Life", "Quillmark Mutual", "Tessaly Health"]


@query("SELECT writing_agent_npn AS agent, " + ", ".join(f"count(*) FILTER (carrier = '{c}') AS \"{c}\"" for c in _CARRIERS) + " FROM policies WHERE writing_agent_npn IS NOT NULL GROUP BY 1")
def dash_agent_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Sales by agent, a column per carrier; the carriers make the schema, so they are read first."""
    p = table(spark, d, "policies").where("writing_agent_npn is not null")
    carriers = sorted(r[0] for r in bounded(p.select("carrier").distinct(), 2_000, "carriers as columns") if r[0] is not None)
    return p.groupBy(F.col("writing_agent_npn").alias("agent")).agg(*[F.count_if(F.col("carrier") == c).cast("bigint").alias(c) for c in carriers])


# row rules ------------------------------------------------------------------------------------------------
def _client_findings(spark: SparkSession, d: str) -> DataFrame:
    clients = table(spark, d, "clients")
    rows = findings.with_zip_states(clients, findings.learn_zip_states(clients))
    return findings.run_checks(rows, "rec_id", findings.client_checks(F.lit(AS_OF).cast("date"), "zip_states"), "clients")


def _policy_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.with_roster(table(spark, d, "policies"), table(spark, d, "agents"))
    return findings.run_checks(rows, "rec_id", findings.policy_checks(STATUSES, F.lit(AS_OF).cast("date"), "agent_in_roster"), "policies")


_ZS = rf"""z AS (SELECT rec_id, CASE WHEN regexp_full_match({_T.format(c='zip')}, '\d{{5}}(-?\d{{4}})?') THEN substr({_T.format(c='zip')}, 1, 3) END AS zip3, state FROM clients),
  zn AS (SELECT zip3, state, count(*) AS n, sum(count(*)) OVER (PARTITION BY zip3) AS t FROM z WHERE zip3 IS NOT NULL AND regexp_matches(state, '^[A-Z]{{2}}$') GROUP BY 1, 2), zs AS (SELECT zip3, state FROM zn WHERE n >= t * 0.9)"""


def _given(c: str) -> str:
    return rf"coalesce(regexp_replace({c}, '^\s+|\s+$', '', 'g') <> '', false)"


_SC = r"upper(regexp_replace(state, '^\s+|\s+$', '', 'g'))"
_STATES = ", ".join(f"'{x}'" for x in identifiers.STATES)
_CLIENT_RULES = f"""
  SELECT rec_id AS row_id, 'DOB-002' AS rule_id, 'error' AS severity, 'dob' AS field FROM ({SQL['fn_ages']}) WHERE NOT age BETWEEN 0 AND 115
  UNION ALL SELECT rec_id, 'MBI-001', 'error', 'mbi' FROM ({SQL['fn_identifiers']}) JOIN clients USING (rec_id) WHERE {_given('mbi')} AND NOT card_ok
  UNION ALL SELECT rec_id, 'ADR-001', 'error', 'zip' FROM ({SQL['fn_identifiers']}) JOIN clients USING (rec_id) WHERE {_given('zip')} AND NOT zip_ok
  UNION ALL SELECT rec_id, 'ADR-003', 'error', 'state' FROM clients WHERE {_given('state')} AND {_SC} NOT IN ({_STATES})
  UNION ALL SELECT rec_id, 'ADR-002', 'error', 'zip' FROM (WITH {_ZS} SELECT rec_id FROM z WHERE {_SC} IN ({_STATES}) AND zip3 IN (SELECT zip3 FROM zs) AND (zip3, {_SC}) NOT IN (SELECT zip3, state FROM zs))
  UNION ALL SELECT rec_id, 'CON-001', 'warning', 'email' FROM ({SQL['fn_identifiers']}) JOIN clients USING (rec_id) WHERE {_given('email')} AND email_norm IS NULL
  UNION ALL SELECT rec_id, 'CON-002', 'warning', 'phone' FROM ({SQL['fn_identifiers']}) JOIN clients USING (rec_id) WHERE {_given('phone')} AND phone10 IS NULL"""


@query(_CLIENT_RULES)
def rule_client_findings(spark: SparkSession, d: str) -> DataFrame:
    return _client_findings(spark, d).select("row_id", "rule_id", "severity", "field")


_ST, _LOB = r"upper(regexp_replace(status, '^\s+|\s+$', '', 'g'))", r"upper(regexp_replace(line_of_business, '^\s+|\s+$', '', 'g'))"
_POLICY_RULES = rf"""
  SELECT rec_id AS row_id, 'NPN-001' AS rule_id, 'error' AS severity, 'writing_agent_npn' AS field FROM policies WHERE {_given('writing_agent_npn')} AND NOT regexp_full_match({_T.format(c='writing_agent_npn')}, '[1-9][0-9]{{0,9}}')
  UNION ALL SELECT rec_id, 'PLN-001', 'error', 'plan_id' FROM policies JOIN ({SQL['fn_plan_ids']}) USING (rec_id) WHERE {_given('plan_id')} AND {_LOB} IN ('MA', 'PDP') AND contract IS NULL
  UNION ALL SELECT rec_id, 'PLN-002', 'error', 'plan_id' FROM policies JOIN ({SQL['fn_plan_ids']}) USING (rec_id) WHERE {_given('plan_id')} AND {_LOB} = 'ACA' AND NOT marketplace
  UNION ALL SELECT rec_id, 'PLN-003', 'error', 'plan_id' FROM policies JOIN ({SQL['fn_plan_ids']}) USING (rec_id) WHERE {_LOB} IN ('MA', 'PDP') AND contract IS NOT NULL AND {_LOB} <> CASE kind WHEN 'drug' THEN 'PDP' ELSE 'MA' END
  UNION ALL SELECT rec_id, 'PLN-004', 'error', 'plan_id' FROM policies JOIN ({SQL['fn_plan_ids']}) USING (rec_id) WHERE {_given('plan_id')} AND {_LOB} = 'MEDSUPP' AND NOT medigap
  UNION ALL SELECT rec_id, 'NPN-002', 'error', 'writing_agent_npn' FROM policies WHERE regexp_full_match({_T.format(c='writing_agent_npn')}, '[1-9][0-9]{{0,9}}') AND {_T.format(c='writing_agent_npn')} NOT IN (SELECT {_T.format(c='npn')} FROM agents WHERE npn IS NOT NULL)
  UNION ALL SELECT rec_id, 'DAT-002', 'error', 'termination_date' FROM policies WHERE termination_date < effective_date
  UNION ALL SELECT rec_id, 'DAT-003', 'error', 'status' FROM policies WHERE {_ST} = 'ACTIVE' AND termination_date < DATE '{AS_OF}'
  UNION ALL SELECT rec_id, 'DAT-004', 'info', 'effective_date' FROM policies WHERE day(effective_date) <> 1 AND {_LOB} IN ('MA', 'PDP')
  UNION ALL SELECT rec_id, 'STA-001', 'warning', 'status' FROM policies WHERE {_given('status')} AND {_ST} NOT IN ({', '.join(f"'{s}'" for s in STATUSES)})"""


@query(_POLICY_RULES)
def rule_policy_findings(spark: SparkSession, d: str) -> DataFrame:
    return _policy_findings(spark, d).select("row_id", "rule_id", "severity", "field")


@query(f"WITH {_ZS} SELECT z.rec_id, z.zip3, z.state FROM z WHERE zip3 IN (SELECT zip3 FROM zs) AND state IS NOT NULL AND (zip3, state) NOT IN (SELECT zip3, state FROM zs)")
def rule_zip_state(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "clients")
    return findings.zip_state_mismatch(c, findings.learn_zip_states(c)).select("rec_id", "zip3", "state")


@query(f"""SELECT f.row_id, f.rule_id, f.field, c.state, NULL AS carrier FROM ({_CLIENT_RULES}) f JOIN clients c ON c.rec_id = f.row_id
  UNION ALL SELECT f.row_id, f.rule_id, f.field, p.state, p.carrier FROM ({_POLICY_RULES}) f JOIN policies p ON p.rec_id = f.row_id""")
def run_findings_with_rows(spark: SparkSession, d: str) -> DataFrame:
    both = _client_findings(spark, d).unionByName(_policy_findings(spark, d))
    frames = {"clients": (table(spark, d, "clients"), "rec_id"), "policies": (table(spark, d, "policies"), "rec_id")}
    return findings.attach_rows(both, frames, ["state", "carrier"]).select("row_id", "rule_id", "field", "state", "carrier")


@query(f"SELECT severity, rule_id, count(*) AS findings, count(DISTINCT (source, row_id)) AS rows_hit FROM (SELECT 'clients' AS source, * FROM ({_CLIENT_RULES}) UNION ALL SELECT 'policies', * FROM ({_POLICY_RULES})) GROUP BY 1, 2")
def run_severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return findings.severity_rollup(_client_findings(spark, d).unionByName(_policy_findings(spark, d)))


@query(f"""SELECT kind, count(*) AS planted, count(hit) AS detected FROM (SELECT p.rec_id, 'status_wording' AS kind, f.row_id AS hit FROM policies p LEFT JOIN (SELECT DISTINCT row_id FROM ({_POLICY_RULES}) WHERE rule_id = 'STA-001') f ON f.row_id = p.rec_id WHERE p.status NOT IN ('ACTIVE','PENDING','TERMINATED','CANCELLED','UNKNOWN')) GROUP BY 1
  UNION ALL SELECT '(clean rows)', count(*), count(f.row_id) FROM policies p LEFT JOIN (SELECT DISTINCT row_id FROM ({_POLICY_RULES})) f ON f.row_id = p.rec_id WHERE NOT coalesce(p.status NOT IN ('ACTIVE','PENDING','TERMINATED','CANCELLED','UNKNOWN'), false)""")
def score_detection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "policies")
    planted = p.where(~F.col("status").isin(*STATUSES)).select(F.col("rec_id").alias("row_id"), F.lit("status_wording").alias("kind"), F.lit("STA-001").alias("rule_id"))
    return compare_runs.detection_score(_policy_findings(spark, d).select("row_id", "rule_id"), planted, p.select(F.col("rec_id").alias("row_id")))


# tie-out ----------------------------------------------------------------------------------------------------
def _blank(c: str) -> str:
    return f"coalesce(nullif(trim({c}), ''), '(blank)')"


_TIE = rf"""
 book AS (SELECT policy_id, client_id, carrier, carrier_member_id, upper(trim(line_of_business)) AS line_of_business, effective_date, termination_date, upper(trim(status)) AS status, {_blank('writing_agent_npn')} AS agent_npn, rec_id AS _rec
   FROM policies QUALIFY row_number() OVER (PARTITION BY carrier, policy_id ORDER BY rec_id) = 1),
 lines AS (SELECT line_id, carrier, statement_period, TRY_CAST(statement_period || '-01' AS DATE) AS period_start, line_no, carrier_member_id, member_name, {dates.sql_date_loose('member_dob')} AS born, policy_ref, {_blank('agent_npn')} AS agent_npn, amount,
   upper(trim(commission_type)) AS commission_type, coalesce(upper(trim(commission_type)) = 'CHARGEBACK', false) OR coalesce(amount < 0, false) AS is_chargeback FROM statement_lines),
 people AS (SELECT DISTINCT b.carrier, b.policy_id, b._rec, regexp_replace(lower(c.first_name || ' ' || c.last_name), '[^a-z]', '', 'g') AS k, c.dob AS born FROM book b JOIN clients c ON c.client_id = b.client_id),
 edges AS (SELECT line_id, policy_id, policy_rec, bit_or(bit) AS mask FROM (
     SELECT l.line_id, b.policy_id, b._rec AS policy_rec, 1 AS bit FROM lines l JOIN book b ON b.carrier = l.carrier AND trim(b.carrier_member_id) = trim(l.carrier_member_id) WHERE trim(l.carrier_member_id) <> '' AND trim(l.carrier) <> ''
     UNION ALL SELECT l.line_id, b.policy_id, b._rec, 2 FROM lines l JOIN book b ON b.carrier = l.carrier AND trim(b.policy_id) = trim(l.policy_ref) WHERE trim(l.policy_ref) <> '' AND trim(l.carrier) <> ''
     UNION ALL SELECT l.line_id, p.policy_id, p._rec, 4 FROM lines l JOIN people p ON p.carrier = l.carrier AND p.k = regexp_replace(lower(l.member_name), '[^a-z]', '', 'g') AND p.born = l.born WHERE p.k <> '' AND trim(l.carrier) <> '') GROUP BY 1, 2, 3),
 facts AS (SELECT line_id, count(*) AS n, count(*) FILTER (mask & 3 <> 0) AS s, count(*) FILTER (mask & 4 <> 0) AS w, bit_or(mask) AS met, max(CASE WHEN mask & 3 <> 0 THEN policy_id END) AS sole,
     max(CASE WHEN mask & 3 <> 0 THEN mask END) AS sole_mask, max(CASE WHEN mask & 3 <> 0 THEN CAST(policy_rec IN (SELECT _rec FROM people) AS INT) END) AS known FROM edges GROUP BY 1),
 linked AS (SELECT *, CASE WHEN link_state = 'confirmed' THEN sole END AS policy_id, CASE WHEN link_state = 'confirmed' AND met & 1 <> 0 THEN 'MEMBER_ID' WHEN link_state = 'confirmed' THEN 'POLICY_REF' WHEN link_state = 'provisional' THEN 'NAME_DOB' END AS match_method FROM (
   SELECT *, CASE link_reason WHEN 'strong_key' THEN 'confirmed' WHEN 'name_dob_only' THEN 'provisional' WHEN 'no_candidate' THEN 'unmatched' ELSE 'ambiguous' END AS link_state FROM (
    SELECT l.*, coalesce(n, 0) AS candidates, sole, coalesce(met, 0) AS met, CASE WHEN coalesce(n, 0) = 0 THEN 'no_candidate' WHEN s > 1 THEN 'multiple_candidates'
      WHEN (coalesce(trim(carrier_member_id) <> '', false) AND met & 1 = 0) OR (coalesce(trim(policy_ref) <> '', false) AND met & 2 = 0) THEN 'unmatched_strong_key'
      WHEN s = 1 AND w > 0 AND sole_mask & 4 = 0 AND (known = 1 OR met & 3 <> 3) THEN 'conflicting_name_dob' WHEN s = 1 THEN 'strong_key' WHEN w > 1 THEN 'multiple_candidates' ELSE 'name_dob_only' END AS link_reason
    FROM lines l LEFT JOIN facts USING (line_id)))),
 months AS (SELECT DISTINCT carrier, statement_period, period_start FROM lines WHERE period_start IS NOT NULL),
 rates AS (SELECT b.line_of_business, l.commission_type, max(l.amount) AS monthly_amount FROM linked l JOIN book b USING (carrier, policy_id) WHERE l.commission_type IN ('NEW', 'RENEWAL') GROUP BY 1, 2),
 force AS (SELECT f.*, r.monthly_amount AS expected FROM (SELECT b.*, m.statement_period, m.period_start, s.carrier IS NOT NULL AS has_statement, CASE WHEN (year(m.period_start) - year(b.effective_date)) * 12 + month(m.period_start) - month(b.effective_date) < {NEW_MONTHS} THEN 'NEW' ELSE 'RENEWAL' END AS kind
   FROM book b JOIN (SELECT DISTINCT statement_period, period_start FROM months) m ON b.effective_date <= last_day(m.period_start) AND (b.termination_date IS NULL OR b.termination_date >= m.period_start)
   LEFT JOIN months s ON s.carrier = b.carrier AND s.statement_period = m.statement_period WHERE b.status = 'ACTIVE') f LEFT JOIN rates r ON r.line_of_business = f.line_of_business AND r.commission_type = f.kind),
 due AS (SELECT f.*, p.weak IS NOT NULL AS is_paid, coalesce(p.weak, false) AS weak FROM force f LEFT JOIN (SELECT carrier, policy_id, statement_period, bool_and(match_method = 'NAME_DOB') AS weak FROM linked WHERE policy_id IS NOT NULL GROUP BY 1, 2, 3) p USING (carrier, policy_id, statement_period) WHERE f.has_statement),
 legc AS (SELECT p.*, b.status, b.agent_npn, coalesce(b.status = 'ACTIVE', false) AS agrees FROM (SELECT carrier, policy_id, max(statement_period) AS statement_period, arg_max(line_no, (period_start, line_id)) AS line_no FROM linked WHERE NOT is_chargeback AND policy_id IS NOT NULL GROUP BY 1, 2) p JOIN book b USING (carrier, policy_id)),
 expected AS (SELECT x.*, r.monthly_amount AS expected FROM (SELECT l.*, b.line_of_business AS lob, CASE WHEN (year(l.period_start) - year(b.effective_date)) * 12 + month(l.period_start) - month(b.effective_date) < {NEW_MONTHS} THEN 'NEW' ELSE 'RENEWAL' END AS kind,
   l.is_chargeback AND coalesce(b.status IN ('CANCELLED', 'TERMINATED') OR coalesce(b.termination_date <= last_day(l.period_start), false), false) AS expected_chargeback FROM linked l JOIN book b USING (carrier, policy_id)) x LEFT JOIN rates r ON r.line_of_business = x.lob AND r.commission_type = x.kind)"""


class Tie:
    """The stages of the tie-out over one input; each is written out once, when it is first asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.clients = table(spark, d, "clients")
        self.policies, self.statement_lines = table(spark, d, "policies"), table(spark, d, "statement_lines")

    @functools.cached_property
    def book(self) -> DataFrame:
        return durable(tieout.book_of(self.policies))

    @functools.cached_property
    def lines(self) -> DataFrame:
        return durable(tieout.lines_of(self.statement_lines))

    @functools.cached_property
    def edges(self) -> DataFrame:
        return durable(tieout.candidate_edges(self.lines, self.book, self.clients))

    @functools.cached_property
    def _linked(self) -> DataFrame:
        return durable(tieout.classify_links(self.lines, self.edges, self.book, self.clients))

    def linked(self) -> DataFrame:
        return self._linked

    @functools.cached_property
    def _rates(self) -> DataFrame:
        paid = self._linked.where("commission_type in ('NEW', 'RENEWAL')").join(self.book.select("carrier", "policy_id", "line_of_business"), ["carrier", "policy_id"])
        return durable(paid.groupBy("line_of_business", "commission_type").agg(F.max("amount").alias("monthly_amount")))

    @functools.cached_property
    def _force(self) -> DataFrame:
        return durable(tieout.with_expected(tieout.in_force(self.book, tieout.statement_months(self.lines)), self._rates, NEW_MONTHS))

    def money(self):
        """(linked, force, due, status, expected) with scheduled amounts: the largest paid per line of business and kind."""
        linked, force = self._linked, self._force
        return linked, force, tieout.leg_book(force, linked), tieout.leg_status(linked, self.book), tieout.line_expected(linked, self.book, self._rates, NEW_MONTHS)


_TIES: dict[tuple, Tie] = {}


def tie_of(spark: SparkSession, d: str) -> Tie:
    """The tie-out of an input, kept in this session as long as the files it read stay as they were."""
    stamps = [stamp(spark, f"{d}/{n}.parquet") for n in ("policies", "statement_lines", "clients")]
    key = (spark.sparkContext.applicationId, d, *stamps)
    if None in stamps:
        return Tie(spark, d)
    if key not in _TIES:
        _TIES.clear()
        _TIES[key] = Tie(spark, d)
    return _TIES[key]


@query(f"WITH {_TIE} SELECT carrier, policy_id, _rec, client_id, status, agent_npn FROM book")
def tie_book_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tieout.book_of(table(spark, d, "policies")).select("carrier", "policy_id", "_rec", "client_id", "status", "agent_npn")


@query(f"WITH {_TIE} SELECT line_id, policy_id, policy_rec, mask FROM edges")
def tie_line_candidates(spark: SparkSession, d: str) -> DataFrame:
    return tie_of(spark, d).edges


@query(f"WITH {_TIE} SELECT line_id, candidates, link_reason, link_state, policy_id, match_method FROM linked")
def tie_line_match(spark: SparkSession, d: str) -> DataFrame:
    return tie_of(spark, d).linked().select("line_id", "candidates", "link_reason", "link_state", "policy_id", "match_method")


@query(f"WITH {_TIE} SELECT carrier, policy_id, statement_period, has_statement FROM force")
def tie_in_force(spark: SparkSession, d: str) -> DataFrame:
    book, lines = tieout.book_of(table(spark, d, "policies")), tieout.lines_of(table(spark, d, "statement_lines"))
    return tieout.in_force(book, tieout.statement_months(lines)).select("carrier", "policy_id", "statement_period", "has_statement")


@query(f"""WITH {_TIE} SELECT 'BOOK_VS_STATEMENT' AS leg, carrier, count(*) FILTER (is_paid) AS matched, count(*) FILTER (NOT is_paid) AS unmatched, count(*) FILTER (is_paid AND weak) AS weak FROM due GROUP BY carrier
  UNION ALL SELECT 'STATEMENT_VS_BOOK', carrier, count(*) FILTER (policy_id IS NOT NULL), count(*) FILTER (policy_id IS NULL), 0 FROM linked GROUP BY carrier
  UNION ALL SELECT 'CRM_VS_STATEMENT', carrier, count(*) FILTER (agrees), count(*) FILTER (NOT agrees), 0 FROM legc GROUP BY carrier""")
def tie_leg_counts(spark: SparkSession, d: str) -> DataFrame:
    linked, _, due, status, _ = tie_of(spark, d).money()

    def leg(df: DataFrame, name: str, ok, weak) -> DataFrame:
        return df.groupBy("carrier").agg(F.count_if(ok).cast("bigint").alias("matched"), F.count_if(~ok).cast("bigint").alias("unmatched"), F.count_if(weak).cast("bigint").alias("weak")).select(F.lit(name).alias("leg"), "carrier", "matched", "unmatched", "weak")

    no = F.lit(False)
    return leg(due, "BOOK_VS_STATEMENT", F.col("is_paid"), F.col("is_paid") & F.col("weak")).unionByName(leg(linked, "STATEMENT_VS_BOOK", F.col("policy_id").isNotNull(), no)).unionByName(leg(status, "CRM_VS_STATEMENT", F.col("agrees"), no))


@query(f"WITH {_TIE} SELECT carrier, policy_id, statement_period, line_no, status, agrees FROM legc")
def tie_leg_status(spark: SparkSession, d: str) -> DataFrame:
    t = tie_of(spark, d)
    return tieout.leg_status(t.linked(), t.book).select("carrier", "policy_id", "statement_period", "line_no", "status", "agrees")


@query(f"WITH {_TIE} SELECT line_id, CAST(expected AS DECIMAL(12,2)) AS expected, expected_chargeback FROM expected")
def tie_expected(spark: SparkSession, d: str) -> DataFrame:
    return tie_of(spark, d).money()[4].select("line_id", F.col("expected").cast("decimal(12,2)").alias("expected"), "expected_chargeback")


@query(f"WITH {_TIE} SELECT carrier, statement_period, count(*) AS policies, CAST(sum(coalesce(expected, 0)) AS DECIMAL(18,2)) AS expected FROM force WHERE NOT has_statement GROUP BY 1, 2")
def tie_missing_statement(spark: SparkSession, d: str) -> DataFrame:
    force = tie_of(spark, d).money()[1]
    return force.where("not has_statement").groupBy("carrier", "statement_period").agg(F.count(F.lit(1)).cast("bigint").alias("policies"), F.sum(F.coalesce("expected", F.lit(0))).cast("decimal(18,2)").alias("expected"))


@query(f"""WITH {_TIE}
  SELECT 'TIE-001' AS rule_id, 'NO_PAYMENT' AS reason_code, carrier, statement_period, NULL::BIGINT AS line_no, policy_id, agent_npn, NULL::DECIMAL(12,2) AS paid, CAST(expected AS DECIMAL(12,2)) AS expected FROM due WHERE NOT is_paid
  UNION ALL SELECT 'TIE-002', CASE WHEN link_state = 'unmatched' THEN 'ORPHAN_PAYMENT' ELSE 'UNRESOLVED_LINK' END, carrier, statement_period, line_no, NULL, agent_npn, amount, NULL FROM linked WHERE policy_id IS NULL
  UNION ALL SELECT 'TIE-003', 'AMOUNT_OFF_SCHEDULE', carrier, statement_period, line_no, policy_id, agent_npn, amount, expected FROM expected WHERE NOT expected_chargeback AND abs(amount - expected) > greatest({LINE_USD}, expected * {LINE_PCT})
  UNION ALL SELECT 'TIE-003', 'AMOUNT_BLANK', carrier, statement_period, line_no, policy_id, agent_npn, NULL, NULL FROM linked WHERE amount IS NULL
  UNION ALL SELECT 'TIE-004', 'STATUS_CONFLICT', carrier, statement_period, line_no, policy_id, agent_npn, NULL, NULL FROM legc WHERE NOT agrees
  UNION ALL SELECT 'TIE-005', 'MISSING_STATEMENT', carrier, statement_period, NULL, NULL, NULL, NULL, CAST(sum(coalesce(expected, 0)) AS DECIMAL(12,2)) FROM force WHERE NOT has_statement GROUP BY carrier, statement_period
  UNION ALL SELECT 'TIE-006', 'WEAK_MATCH', carrier, statement_period, line_no, policy_id, agent_npn, amount, NULL FROM linked WHERE match_method = 'NAME_DOB'""")
def tie_variances(spark: SparkSession, d: str) -> DataFrame:
    linked, force, due, status, expected = tie_of(spark, d).money()
    return tieout.variances(linked, due, status, expected, force, LINE_USD, LINE_PCT)


@query(f"""WITH {_TIE}, b AS (SELECT carrier, agent_npn, coalesce(expected, 0) AS e FROM force UNION ALL SELECT carrier, agent_npn, amount FROM expected WHERE expected_chargeback),
  bt AS (SELECT 'carrier' AS group_by, carrier AS key, sum(e) AS e FROM b GROUP BY 2 UNION ALL SELECT 'agent', agent_npn, sum(e) FROM b GROUP BY 2),
  pt AS (SELECT 'carrier' AS group_by, carrier AS key, sum(amount) AS a, sum(CASE WHEN policy_id IS NULL THEN amount ELSE 0 END) AS o FROM linked GROUP BY 2 UNION ALL SELECT 'agent', agent_npn, sum(amount), sum(CASE WHEN policy_id IS NULL THEN amount ELSE 0 END) FROM linked GROUP BY 2)
  SELECT group_by, key, CAST(coalesce(e, 0) AS DECIMAL(18,2)) AS book_expected, CAST(coalesce(a, 0) AS DECIMAL(18,2)) AS statement_paid, CAST(coalesce(a, 0) - coalesce(e, 0) AS DECIMAL(18,2)) AS difference, CAST(coalesce(o, 0) AS DECIMAL(18,2)) AS unexplained_revenue,
  abs(coalesce(a, 0) - coalesce(e, 0)) <= abs(coalesce(e, 0)) * {TOTAL_PCT} AS within_tolerance FROM bt FULL OUTER JOIN pt USING (group_by, key)""")
def tie_totals(spark: SparkSession, d: str) -> DataFrame:
    linked, force, _, _, expected = tie_of(spark, d).money()
    return tieout.totals(linked, force, expected, TOTAL_PCT)


@query(rf"""WITH {_TIE}, strong AS (SELECT line_id, max(policy_rec) AS policy_rec FROM edges WHERE mask & 3 <> 0 GROUP BY 1 HAVING count(*) = 1 AND max(mask) & 3 = 3),
  ppl AS (SELECT DISTINCT trim(client_id) AS client, regexp_replace(lower(first_name || ' ' || last_name), '[^a-z]', '', 'g') AS k, dob FROM clients WHERE client_id IS NOT NULL AND dob IS NOT NULL),
  v AS (SELECT s.policy_rec, trim(b.client_id) AS filed, CASE WHEN bool_or(p.client = trim(b.client_id)) THEN trim(b.client_id) WHEN count(DISTINCT p.client) = 1 THEN max(p.client) END AS named
    FROM strong s JOIN lines l USING (line_id) JOIN book b ON b._rec = s.policy_rec JOIN ppl p ON p.k = regexp_replace(lower(l.member_name), '[^a-z]', '', 'g') AND p.dob = l.born WHERE p.k <> '' AND trim(b.client_id) IN (SELECT client FROM ppl) GROUP BY s.line_id, s.policy_rec, b.client_id)
  SELECT policy_rec, filed AS filed_client, max(named) AS named_client, count(*) AS lines FROM v WHERE named IS NOT NULL GROUP BY 1, 2 HAVING min(named) = max(named) AND max(named) <> filed""")
def chk_misfiled(spark: SparkSession, d: str) -> DataFrame:
    t = tie_of(spark, d)
    return checks.misfiled(t.edges, t.lines, t.book, t.clients)


@query(f"""WITH {_TIE} SELECT l.line_id, e.evidence FROM lines l LEFT JOIN (SELECT line_id, array_to_string(list_sort(list(policy_id || ':' || array_to_string(list_filter([CASE WHEN mask & 1 <> 0 THEN 'MEMBER_ID' END, CASE WHEN mask & 2 <> 0 THEN 'POLICY_REF' END, CASE WHEN mask & 4 <> 0 THEN 'NAME_DOB' END], lambda x: x IS NOT NULL), '+'))), '|') AS evidence FROM edges GROUP BY 1) e USING (line_id)""")
def tie_link_evidence(spark: SparkSession, d: str) -> DataFrame:
    t = tie_of(spark, d)
    return tieout.link_evidence(t.lines, t.edges)


def _no(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


@query(f"""WITH {_TIE}, u AS (SELECT l.line_id, l.born, s.member_name, s.member_dob, s.carrier_member_id, s.policy_ref FROM linked l JOIN statement_lines s USING (line_id) WHERE l.link_state <> 'confirmed')
  SELECT line_id, 'name_blank' AS reason FROM u WHERE {_no('member_name')} UNION ALL SELECT line_id, 'dob_blank' FROM u WHERE {_no('member_dob')}
  UNION ALL SELECT line_id, 'dob_malformed' FROM u WHERE NOT {_no('member_dob')} AND born IS NULL UNION ALL SELECT line_id, 'keys_blank' FROM u WHERE {_no('carrier_member_id')} AND {_no('policy_ref')}""")
def tie_unresolved_reasons(spark: SparkSession, d: str) -> DataFrame:
    return tieout.unresolved_reasons(tie_of(spark, d).linked(), table(spark, d, "statement_lines"))


@query(f"SELECT rule_id, reason_code, count(*) AS variances, CAST(sum(abs(coalesce(paid, 0) - coalesce(expected, 0))) AS DECIMAL(18,2)) AS dollars FROM ({SQL['tie_variances']}) GROUP BY 1, 2")
def tie_variance_dollars(spark: SparkSession, d: str) -> DataFrame:
    return tieout.variance_dollars(tie_variances(spark, d))


@query(f"SELECT rule_id, row_id, field, row_number() OVER (ORDER BY rule_id, row_id, field) AS number FROM ({_POLICY_RULES})")
def run_numbered_findings(spark: SparkSession, d: str) -> DataFrame:
    return numbering.number_rows(_policy_findings(spark, d).select("rule_id", "row_id", "field"), ["rule_id", "row_id", "field"])


@query(f"SELECT severity, rule_id, row_id, field FROM ({_POLICY_RULES}) ORDER BY CASE severity WHEN 'blocker' THEN 1 WHEN 'error' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END, rule_id, row_id, field LIMIT 50")
def run_report_top(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty findings of a report; the limit is the report's feature."""
    rank = F.array_position(F.lit(list(findings.SEVERITIES)), F.col("severity"))
    return _policy_findings(spark, d).select("severity", "rule_id", "row_id", "field").orderBy(rank, "rule_id", "row_id", "field").limit(50)


@query(rf"""SELECT 'DUPLICATE_CLIENT' AS issue, {_T.format(c='client_id')} AS key, count(*) AS rows FROM clients WHERE client_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'DUPLICATE_POLICY', {_T.format(c='policy_id')}, count(*) FROM policies WHERE policy_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'MISSING_CLIENT', {_T.format(c='client_id')}, count(*) FROM policies WHERE client_id IS NOT NULL AND {_T.format(c='client_id')} NOT IN (SELECT {_T.format(c='client_id')} FROM clients WHERE client_id IS NOT NULL) GROUP BY 2""")
def pkt_issues(spark: SparkSession, d: str) -> DataFrame:
    return checks.packet_issues(table(spark, d, "clients"), table(spark, d, "policies"))


@query(rf"""WITH c AS (SELECT {_T.format(c='client_id')} AS ck, arg_min(state, rec_id) FILTER (state IS NOT NULL) AS cs, true AS hc FROM clients WHERE client_id IS NOT NULL GROUP BY 1), c2 AS (SELECT ck, hc, (SELECT state FROM clients x WHERE {_T.format(c='x.client_id')} = c.ck ORDER BY rec_id LIMIT 1) AS cs FROM c), a AS (SELECT DISTINCT {_T.format(c='npn')} AS ak, true AS ha FROM agents WHERE npn IS NOT NULL)
  SELECT carrier, count(*) AS policies, count(hc) AS with_client, count(ha) AS with_agent, count(*) FILTER (hc AND ha) AS with_both, count(*) FILTER (state <> cs) AS other_state
  FROM policies p LEFT JOIN c2 ON ck = {_T.format(c='p.client_id')} LEFT JOIN a ON ak = {_T.format(c='p.writing_agent_npn')} GROUP BY 1""")
def chk_cross_counts(spark: SparkSession, d: str) -> DataFrame:
    return checks.cross_counts(table(spark, d, "policies"), table(spark, d, "clients"), table(spark, d, "agents"), "carrier")


# clean tables -------------------------------------------------------------------------------------------------
@query(rf"""WITH f AS ({_POLICY_RULES}), k AS (SELECT rec_id, policy_id, client_id FROM policies p WHERE rec_id NOT IN (SELECT row_id FROM f WHERE severity IN ('blocker', 'error')) AND policy_id IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY {_T.format(c='policy_id')} ORDER BY rec_id) = 1)
  SELECT k.rec_id, w.warning_ids FROM k LEFT JOIN (SELECT row_id, array_to_string(list_sort(list(DISTINCT rule_id)), '|') AS warning_ids FROM f WHERE severity = 'warning' GROUP BY 1) w ON w.row_id = k.rec_id
  WHERE {_T.format(c='client_id')} IN (SELECT {_T.format(c='client_id')} FROM clients WHERE rec_id NOT IN (SELECT row_id FROM ({_CLIENT_RULES}) WHERE severity IN ('blocker', 'error')))""")
def clean_policies(spark: SparkSession, d: str) -> DataFrame:
    good_clients = clean.without_errors(table(spark, d, "clients"), "rec_id", _client_findings(spark, d))
    kept = clean.first_per_key(clean.without_errors(table(spark, d, "policies"), "rec_id", _policy_findings(spark, d)), "policy_id", "rec_id")
    return clean.with_parent(kept, "client_id", good_clients, "client_id").select("rec_id", "warning_ids")


@query("""WITH m AS (SELECT household_id, client_id, min(rec_id) AS rec_id FROM clients WHERE household_id IS NOT NULL GROUP BY 1, 2)
  SELECT household_id, arg_min(client_id, rec_id) AS primary_client_id, string_agg(client_id, '|' ORDER BY rec_id) AS members, count(*) AS size FROM m GROUP BY 1""")
def clean_households(spark: SparkSession, d: str) -> DataFrame:
    return clean.households(table(spark, d, "clients"))


@query(rf"SELECT rec_id AS row_id, field FROM (SELECT rec_id, unnest(['address_line1', 'city', 'state', 'zip']) AS field, unnest([address_line1, city, state, zip]) AS v FROM clients) WHERE coalesce({_T.format(c='v')}, '') = ''")
def clean_missing_required(spark: SparkSession, d: str) -> DataFrame:
    return clean.missing_required(table(spark, d, "clients"), "rec_id", ["address_line1", "city", "state", "zip"])


# text ---------------------------------------------------------------------------------------------------------
@query(r"""SELECT coalesce(lang, '(none)') AS lang, count(*) AS documents, count(*) FILTER (regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.-]+')) AS with_email, count(*) FILTER (regexp_matches(text, '\d{3}-\d{2}-\d{4}')) AS with_ssn,
  count(*) FILTER (regexp_matches(text, '(?i)\b(diagnos|condition|disab|surger|cancer|diabet|hospital|medicat|prescri|generic)')) AS with_health FROM documents GROUP BY 1""")
def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(
        F.count(F.lit(1)).cast("bigint").alias("documents"), F.count_if(t.rlike(r"[\w.+-]+@[\w-]+\.[\w.-]+")).cast("bigint").alias("with_email"),
        F.count_if(t.rlike(r"\d{3}-\d{2}-\d{4}")).cast("bigint").alias("with_ssn"), F.count_if(redaction.health_hint(t)).cast("bigint").alias("with_health"))


_PLACED = "marked"
for _k in redaction.KINDS:
    _PLACED = f"replace({_PLACED}, '{redaction.mark(_k)}', '[REDACTED:{_k}]')"
_FOUND_KINDS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(marked, '{redaction.mark(k)}') THEN '{k}' END" for k in sorted(redaction.KINDS)) + "], lambda k: k IS NOT NULL), '|')"
_MARKED = redaction.sql_marked("notes").replace("{source}", "clients WHERE notes IS NOT NULL", 1)


@query(f"SELECT rec_id, {_PLACED} AS text, {_FOUND_KINDS} AS kinds FROM ({_MARKED})")
def pii_redact_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Notes with what published formats show replaced by placeholders, and the kinds that were found."""
    notes = table(spark, d, "clients").where("notes is not null").select("rec_id", redaction.redact(F.col("notes")).alias("r"))
    return notes.select("rec_id", F.col("r.text").alias("text"), F.array_join("r.kinds", "|").alias("kinds"))


_HINTS = " OR ".join(f"regexp_matches(notes, '{p}')" for p in (redaction.HEALTH, redaction.DRUG, redaction.DATE))


@query(f"SELECT rec_id, coalesce(marked <> notes OR {_HINTS}, false) AS refused FROM ({redaction.sql_marked('notes').replace('{source}', 'clients', 1)})")
def pii_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Which notes would be refused as a label: a personal detail, or a hint of health, a drug or a date."""
    return table(spark, d, "clients").select("rec_id", redaction.flagged(F.col("notes")).alias("refused"))


@query(r"""SELECT rec_id, h AS withheld, CASE WHEN h THEN '[redacted]' ELSE notes END AS notes FROM (SELECT *, coalesce(regexp_matches(notes, '(?i)\b(diagnos|condition|disab|surger|cancer|diabet|hospital|medicat|prescri|generic)'), false) AS h FROM clients)""")
def pii_gate_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes gated with no recorded answers at all: everything that hints at health is withheld."""
    none = spark.createDataFrame([], "question string, answer double")
    return replay.gate_notes(table(spark, d, "clients").select("rec_id", "notes"), "notes", none).select("rec_id", "withheld", "notes")


# runs, revenue, versions ------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT carrier, status, count(*) FILTER (loaded_at < TIMESTAMP '2025-06-01') AS x, count(*) FILTER (loaded_at >= TIMESTAMP '2025-06-01') AS y FROM policies GROUP BY 1, 2)
  SELECT carrier, status, greatest(x - y, 0) AS resolved, greatest(y - x, 0) AS fresh, least(x, y) AS unchanged FROM a""")
def run_diff_multiset(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "policies")
    return compare_runs.multiset_diff(p.where("loaded_at < timestamp_ntz '2025-06-01'"), p.where("loaded_at >= timestamp_ntz '2025-06-01'"), ["carrier", "status"])


@query("SELECT carrier, statement_period, " + ", ".join(f"CAST(coalesce(sum(amount) FILTER (c = '{c}'), 0) AS DECIMAL(18,2)) AS \"{c}\"" for c in CATEGORIES)
       + ", CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS total FROM (SELECT *, CASE WHEN commission_type IN ('NEW', 'RENEWAL', 'OVERRIDE', 'CHARGEBACK') THEN commission_type ELSE 'unclassified' END AS c FROM statement_lines) GROUP BY 1, 2")
def fin_category_totals(spark: SparkSession, d: str) -> DataFrame:
    lookup = spark.createDataFrame([(c, c) for c in CATEGORIES[:-1]], "label string, category string")
    return revenue.category_totals(revenue.classify(table(spark, d, "statement_lines"), lookup, "commission_type"), ["carrier", "statement_period"], CATEGORIES)


@query("SELECT carrier, statement_period, count(amount) AS valid_lines, count(*) FILTER (amount IS NULL) AS excluded_lines, CAST(sum(amount) AS DECIMAL(18,2)) AS received FROM statement_lines GROUP BY 1, 2")
def fin_received_totals(spark: SparkSession, d: str) -> DataFrame:
    return revenue.received_totals(table(spark, d, "statement_lines"), ["carrier", "statement_period"])


@query("SELECT carrier, statement_period, CASE WHEN count(amount) = 0 THEN 'UNAVAILABLE' WHEN count(amount) < count(*) THEN 'PARTIAL' ELSE 'AVAILABLE' END AS state FROM statement_lines GROUP BY 1, 2")
def fin_statement_state(spark: SparkSession, d: str) -> DataFrame:
    t = revenue.received_totals(table(spark, d, "statement_lines"), ["carrier", "statement_period"])
    return t.select("carrier", "statement_period", F.when(F.col("valid_lines") == 0, "UNAVAILABLE").when(F.col("excluded_lines") > 0, "PARTIAL").otherwise("AVAILABLE").alias("state"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mapping_review").groupBy("file_id").agg(
        F.min("source").alias("source"), F.min("file_name").alias("file_name"), F.min("received_at").alias("received_at"), F.min("format_fingerprint").alias("sha"))


_FILES = "SELECT file_id, min(source) AS source, min(file_name) AS file_name, min(received_at) AS received_at, min(format_fingerprint) AS sha FROM mapping_review GROUP BY 1"


_RECEIPTS = f"""SELECT source AS scope, row_number() OVER w AS seq, CAST(file_id AS VARCHAR) AS receipt_id, file_name AS revision, sha AS digest, file_name AS declared, lag(file_name) OVER w AS replaces
  FROM ({_FILES}) WINDOW w AS (PARTITION BY source ORDER BY received_at, file_id)"""
_NO_NAME = "chr(1)"


@query(f"""WITH RECURSIVE q AS ({_RECEIPTS}),
  step AS (
    SELECT scope, CAST(0 AS BIGINT) AS seq, NULL::VARCHAR AS receipt_id, NULL::VARCHAR AS revision, NULL::VARCHAR AS digest, NULL::VARCHAR AS state, NULL::VARCHAR AS reason,
      NULL::VARCHAR AS live, []::VARCHAR[] AS contents, []::VARCHAR[] AS names, []::VARCHAR[] AS disputed, []::VARCHAR[] AS claims, []::VARCHAR[] AS claimed FROM (SELECT DISTINCT scope FROM q)
    UNION ALL
    SELECT scope, seq, receipt_id, revision, digest, v[1], v[2], CASE WHEN v[1] = 'active' THEN coalesce(revision, {_NO_NAME}) ELSE live END,
      CASE WHEN v[1] = 'active' THEN list_append(contents, digest) ELSE contents END, list_append(names, coalesce(revision, {_NO_NAME})),
      CASE v[1] WHEN 'active' THEN list_filter(disputed, lambda x: x <> digest) WHEN 'conflict' THEN list_append(disputed, digest) ELSE disputed END,
      CASE WHEN list_contains(claims, declared) THEN claims ELSE list_append(claims, declared) END, CASE WHEN list_contains(claims, declared) THEN claimed ELSE list_append(claimed, digest) END
    FROM (SELECT *, CASE
        WHEN list_contains(disputed, digest) AND NOT (heir AND NOT clash) THEN ['duplicate', 'duplicate_conflict_evidence']
        WHEN clash THEN ['conflict', 'declared_hash_collision'] WHEN heir THEN ['active', NULL]
        WHEN list_contains(contents, digest) THEN CASE WHEN replaces IS NULL OR replaces IS NOT DISTINCT FROM live THEN ['duplicate', NULL] ELSE ['conflict', 'replacement_not_current'] END
        WHEN list_contains(names, coalesce(revision, {_NO_NAME})) THEN ['conflict', 'revision_id_reused']
        WHEN live IS NULL AND replaces IS NOT NULL THEN ['conflict', 'replacement_without_original'] WHEN live IS NOT NULL THEN ['conflict', 'replacement_not_current'] ELSE ['active', NULL] END AS v
      FROM (SELECT q.*, s.live, s.contents, s.names, s.disputed, s.claims, s.claimed, s.live IS NOT NULL AND q.replaces IS NOT DISTINCT FROM s.live AND NOT list_contains(s.names, coalesce(q.revision, {_NO_NAME})) AS heir,
          coalesce(s.claimed[list_position(s.claims, q.declared)] <> q.digest, false) AS clash FROM q JOIN step s ON q.scope = s.scope AND q.seq = s.seq + 1)))
  SELECT scope, seq, receipt_id, revision, digest, CASE WHEN state = 'active' AND seq < max(CASE WHEN state = 'active' THEN seq END) OVER (PARTITION BY scope) THEN 'superseded' ELSE state END AS state, reason
  FROM step WHERE seq > 0""")
def fin_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Files as receipts: a source's deliveries in order, each under its file name, replacing the one before."""
    return versions.receipt_ledger(_receipts(spark, d))


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("received_at", "file_id")
    return _files(spark, d).select(
        F.col("source").alias("scope"), F.row_number().over(w).cast("bigint").alias("seq"), F.col("file_id").cast("string").alias("receipt_id"), F.col("file_name").alias("revision"),
        F.col("sha").alias("digest"), F.col("file_name").alias("declared"), F.lag("file_name").over(w).alias("replaces"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source", "file_name").orderBy("received_at", "file_id")
    return _files(spark, d).select(F.col("file_id").alias("version"), F.lag("file_id").over(w).alias("parent"), "source", "file_name", "sha", F.to_date("received_at").alias("source_date"))


@query(f"WITH f AS ({_FILES}) SELECT a.file_id AS version, b.file_id AS ancestor FROM f a JOIN f b ON a.source = b.source AND a.file_name = b.file_name AND (b.received_at, b.file_id) < (a.received_at, a.file_id)")
def ready_supersession(spark: SparkSession, d: str) -> DataFrame:
    return versions.ancestors(_versions(spark, d))


@query(f"SELECT DISTINCT ancestor AS version FROM ({SQL['ready_supersession']}) x JOIN ({_FILES}) f ON f.file_id = x.version WHERE f.received_at < TIMESTAMP '2025-01-01'")
def ready_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Files that a file received before 2025 replaces, at any distance."""
    delivered = _files(spark, d).where("received_at < timestamp_ntz '2025-01-01'").select(F.col("file_id").alias("version"))
    return versions.superseded(_versions(spark, d), delivered)


@query(f"""WITH f AS ({_FILES}), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source, file_name ORDER BY received_at DESC, file_id DESC) = 1)
  SELECT source, file_name, CASE WHEN CAST(received_at AS DATE) < DATE '2024-06-01' THEN 'stale' ELSE 'current' END AS state FROM l""")
def ready_states(spark: SparkSession, d: str) -> DataFrame:
    v = durable(_versions(spark, d))
    expected = v.select("source", "file_name").distinct().withColumn("least_date", F.lit("2024-06-01").cast("date"))
    return versions.readiness(expected, v, v.select("version"), ["source", "file_name"])


# gates and mapping ------------------------------------------------------------------------------------------------
_GATED = ["carrier_member_id", "member_dob", "policy_ref", "agent_npn"]


@query(" UNION ALL ".join(rf"SELECT '{c}' AS column_name, count(*) FILTER (trim({c}) <> '') AS filled, count(*) FILTER (regexp_full_match({c}, '\s*\d{{3}}[- ]\d{{2}}[- ]\d{{4}}\s*')) AS dashed, count(*) FILTER (regexp_full_match({c}, '\s*\d{{9}}\s*')) AS bare, count(*) FILTER (regexp_full_match({c}, '\s*\d{{9}}\s*') AND NOT regexp_full_match(trim({c}), '[1-9][0-9]{{0,9}}')) AS bare_not_producer FROM statement_lines" for c in _GATED))
def gate_column_shares(spark: SparkSession, d: str) -> DataFrame:
    return gates.column_shares(table(spark, d, "statement_lines"), _GATED)


@query("""SELECT lineage_source_file, max(lineage_row_number) AS expected_rows, count(*) AS received_rows, CASE WHEN count(*) < max(lineage_row_number) THEN 'SHORT' WHEN count(*) > max(lineage_row_number) THEN 'EXTRA' ELSE 'COMPLETE' END AS state FROM statement_lines WHERE lineage_source_file IS NOT NULL GROUP BY 1""")
def gate_completeness(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "statement_lines").where("lineage_source_file is not null")
    return gates.completeness(lines, lines.groupBy("lineage_source_file").agg(F.max("lineage_row_number").alias("expected_rows")), "lineage_source_file")


@query(r"""SELECT column_name, chars, cells, most_blanks, nine_digits FROM (SELECT 'notes' AS column_name, CAST(sum(length(notes)) AS BIGINT) AS chars, count(notes) AS cells, max(length(notes) - length(replace(notes, ' ', ''))) AS most_blanks, bool_or(regexp_matches(notes, '\d{9}')) AS nine_digits FROM clients
  UNION ALL SELECT 'email', CAST(sum(length(email)) AS BIGINT), count(email), max(length(email) - length(replace(email, ' ', ''))), bool_or(regexp_matches(email, '\d{9}')) FROM clients)""")
def gate_free_text(spark: SparkSession, d: str) -> DataFrame:
    return gates.free_text_columns(table(spark, d, "clients"), ["notes", "email"])


_WORDING = r"lower(trim(regexp_replace(header, '\s+', ' ', 'g')))"


@query(f"SELECT proposed_field AS field, {_WORDING} AS wording, count(DISTINCT file_id) AS files FROM mapping_review WHERE proposed_field <> 'none' GROUP BY 1, 2 HAVING count(DISTINCT file_id) >= 2")
def map_learned_wordings(spark: SparkSession, d: str) -> DataFrame:
    return mapping.learn_synonyms(table(spark, d, "mapping_review"))


@query("SELECT file_id, proposed_field, count(DISTINCT header) AS headers FROM mapping_review WHERE proposed_field <> 'none' GROUP BY 1, 2 HAVING count(DISTINCT header) > 1")
def map_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return mapping.mapping_conflicts(table(spark, d, "mapping_review"))


@query(f"SELECT file_id, source FROM (SELECT *, lag(sha) OVER (PARTITION BY source ORDER BY received_at, file_id) AS b FROM ({_FILES})) WHERE b <> sha")
def map_format_changes(spark: SparkSession, d: str) -> DataFrame:
    return mapping.format_changes(table(spark, d, "mapping_review"))


@query()
def map_header_topk(spark: SparkSession, d: str) -> DataFrame:
    return mapping.header_candidates(table(spark, d, "mapping_review"))
