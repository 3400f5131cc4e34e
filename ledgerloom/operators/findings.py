"""Row checks as one pass: every check is a condition over the row, and a row's hits come out of one array.

Twenty checks over a table are one scan and one narrow stage, not twenty scans united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, identifiers, text
from ledgerloom.runtime import lookup_join

SEVERITIES = ("blocker", "error", "warning", "info")


@dataclass(frozen=True)
class Check:
    rule: str
    severity: str
    field: str
    hit: Column
    message: str

    def as_struct(self) -> Column:
        return F.when(F.coalesce(self.hit, F.lit(False)), F.struct(
            F.lit(self.rule).alias("rule_id"), F.lit(self.severity).alias("severity"), F.lit(self.field).alias("field"),
            text.mask(F.col(self.field).cast("string")).alias("shown"), F.lit(self.message).alias("message")))


def run_checks(rows: DataFrame, key: str, checks: list[Check], source: str) -> DataFrame:
    """(finding_id, source, row_id, rule_id, severity, field, shown, message) for every check that hits. Values are
    masked. A condition that is null does not hit."""
    hits = F.filter(F.array(*[c.as_struct() for c in checks]), lambda h: h.isNotNull())
    return rows.select(F.col(key).alias("row_id"), F.explode(hits).alias("h")).select(
        text.short_id(source, [F.col("h.rule_id"), F.col("row_id"), F.col("h.field")]).alias("finding_id"),
        F.lit(source).alias("source"), "row_id", "h.*",
    )


def _given(c: str) -> Column:
    return F.coalesce(text.strip(F.col(c).cast("string")) != "", F.lit(False))


def _day(c: str) -> Column:
    """A day given as a date or written in any known way."""
    return dates.parse_date_loose(F.col(c).cast("string"))


def _unreadable(c: str) -> Column:
    return _given(c) & _day(c).isNull()


def _code(c: str) -> Column:
    return F.upper(text.strip(F.col(c)))


def client_checks(as_of: Column, zip_states: str | None = None) -> list[Check]:
    """Checks on client rows; as_of is the day on which ages are taken. zip_states names a column with the states of
    the row's ZIP prefix (null where the prefix is unknown), as with_zip_states adds it."""
    age = dates.age_on(_day("dob"), as_of)
    known = _code("state").isin(*identifiers.STATES)
    out = [
        Check("DOB-001", "error", "dob", _unreadable("dob"), "no date"),
        Check("DOB-002", "error", "dob", ~age.between(0, 115), "age outside 0 to 115"),
        Check("MBI-001", "error", "mbi", _given("mbi") & ~identifiers.is_medicare_card(F.col("mbi")), "no Medicare card number"),
        Check("ADR-001", "error", "zip", _given("zip") & ~identifiers.is_zip(F.col("zip")), "no ZIP code"),
        Check("ADR-003", "error", "state", _given("state") & ~known, "no state code"),
        Check("CON-001", "warning", "email", _given("email") & identifiers.normalize_email(F.col("email")).isNull(), "no email address"),
        Check("CON-002", "warning", "phone", _given("phone") & identifiers.normalize_phone(F.col("phone")).isNull(), "no ten-digit telephone"),
    ]
    if zip_states:
        out.append(Check("ADR-002", "error", "zip", known & ~F.array_contains(F.col(zip_states), _code("state")), "ZIP code of another state"))
    return out


def policy_checks(statuses: list[str], as_of: Column, in_roster: str | None = None) -> list[Check]:
    """Checks on policy rows; statuses are the wordings that count as known. in_roster names a column that is true
    where the writing agent stands in the roster, as with_roster adds it."""
    start, end = _day("effective_date"), _day("termination_date")
    status, line = _code("status"), _code("line_of_business")
    plan, given = identifiers.plan_parts(F.col("plan_id")), _given("plan_id")
    producer = identifiers.is_producer_number(F.col("writing_agent_npn"))
    out = [
        Check("NPN-001", "error", "writing_agent_npn", _given("writing_agent_npn") & ~producer, "no producer number"),
        Check("PLN-001", "error", "plan_id", given & line.isin("MA", "PDP") & plan.isNull(), "no Medicare plan id"),
        Check("PLN-002", "error", "plan_id", given & (line == "ACA") & ~identifiers.is_marketplace_plan(F.col("plan_id")), "no marketplace plan id"),
        Check("PLN-003", "error", "plan_id", line.isin("MA", "PDP") & (line != F.when(plan["kind"] == "drug", "PDP").otherwise("MA")) & plan.isNotNull(), "plan id of another line of business"),
        Check("PLN-004", "error", "plan_id", given & (line == "MEDSUPP") & ~identifiers.is_medigap_letter(F.col("plan_id")), "no Medigap plan letter"),
        Check("DAT-001", "error", "effective_date", _unreadable("effective_date"), "no date"),
        Check("DAT-001", "error", "termination_date", _unreadable("termination_date"), "no date"),
        Check("DAT-002", "error", "termination_date", end < start, "ends before it starts"),
        Check("DAT-003", "error", "status", (status == "ACTIVE") & (end < as_of), "active after its end"),
        Check("DAT-004", "info", "effective_date", line.isin("MA", "PDP") & (F.dayofmonth(start) != 1), "does not start on the first"),
        Check("STA-001", "warning", "status", _given("status") & ~status.isin(*statuses), "unknown wording"),
    ]
    if in_roster:
        out.append(Check("NPN-002", "error", "writing_agent_npn", _given("writing_agent_npn") & producer & ~F.coalesce(F.col(in_roster), F.lit(False)), "agent not in the roster"))
    return out


def with_roster(policies: DataFrame, agents: DataFrame, name: str = "agent_in_roster") -> DataFrame:
    """policies with a column that is true where the trimmed writing agent is one of the roster's. The house account's
    rows do not meet in one task: the roster is broadcast if counted small, else the join is salted."""
    roster = agents.where(_given("npn")).select(text.strip(F.col("npn")).alias("__npn")).distinct().withColumn(name, F.lit(True))
    return lookup_join(policies.withColumn("__npn", text.strip(F.col("writing_agent_npn"))), roster, ["__npn"]).drop("__npn")


def with_zip_states(rows: DataFrame, pairs: DataFrame, name: str = "zip_states") -> DataFrame:
    """rows with the states of their ZIP prefix, null where pairs (zip3, state) do not list it."""
    known = pairs.groupBy("zip3").agg(F.collect_set("state").alias(name))
    return lookup_join(rows.withColumn("zip3", identifiers.zip3(F.col("zip"))), known, ["zip3"])


def zip_state_mismatch(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose ZIP prefix is known but not for their state. pairs (zip3, state) is a lookup of under 1,100 rows."""
    return with_zip_states(rows, pairs, "states").where("states is not null").where(~F.array_contains("states", F.col("state")))


def severity_rollup(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "rule_id").agg(F.count(F.lit(1)).cast("bigint").alias("findings"), F.countDistinct("source", "row_id").cast("bigint").alias("rows_hit"))


def fix_first(findings: DataFrame) -> DataFrame:
    """Findings in the order they should be looked at: by severity, rule, then id."""
    rank = F.array_position(F.lit(list(SEVERITIES)), F.col("severity"))
    return findings.orderBy(rank, "rule_id", "finding_id")


def run_status(findings: DataFrame) -> DataFrame:
    worst = F.min(F.array_position(F.lit(list(SEVERITIES)), F.col("severity")))
    return findings.agg(F.when(worst <= 2, "FAILED").when(worst == 3, "PASSED_WITH_WARNINGS").otherwise("PASSED").alias("status"))


def attach_rows(findings: DataFrame, frames: dict[str, tuple[DataFrame, str]], columns: list[str]) -> DataFrame:
    """findings with fields of the row they point at, looked up in the frame of their source (frame, key)."""
    out = None
    for source, (df, key) in frames.items():
        have = [c for c in columns if c in df.columns]
        side = df.select(F.col(key).alias("row_id"), *[F.col(c).cast("string").alias(c) for c in have], *[F.lit(None).cast("string").alias(c) for c in columns if c not in have])
        one = findings.where(F.col("source") == source).join(side, "row_id", "left")
        out = one if out is None else out.unionByName(one)
    return out


def learn_zip_states(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """(zip3, state) pairs that hold for at least this share of the rows with a readable ZIP code and a two-letter state;
    at most a thousand prefixes."""
    known = rows.select(identifiers.zip3(F.col("zip")).alias("zip3"), F.col("state")).where(F.col("zip3").isNotNull() & F.col("state").rlike("^[A-Z]{2}$"))
    counts = known.groupBy("zip3", "state").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("zip3").agg(F.sum("n").alias("all_n"))
    return counts.join(F.broadcast(total), "zip3").where(F.col("n") >= F.col("all_n") * least).select("zip3", "state")
