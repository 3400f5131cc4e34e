"""Three-way reconciliation of a book of policies, payment lines and policy status, exact to the cent.

Candidate edges between lines and policies carry a mask of the keys that made them (1 member id, 2 policy
number, 4 name and birth date). One aggregation of the edges per line is enough to classify its link, since
the mask of the sole strong edge also tells whether the weak evidence agrees; no edge is looked up twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, text

BLANK = "(blank)"
MEMBER, POLICY, PERSON = 1, 2, 4


def _or_blank(c: str) -> Column:
    return F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(BLANK))


def _given(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def book_of(policies: DataFrame) -> DataFrame:
    """The first row (smallest rec_id) of each carrier and policy."""
    first = policies.groupBy("carrier", "policy_id").agg(F.min_by(F.struct(*[c for c in policies.columns if c not in ("carrier", "policy_id")]), "rec_id").alias("r"))
    return first.select("carrier", "policy_id", "r.*").select(
        "policy_id", "client_id", "carrier", "carrier_member_id", F.upper(F.trim("line_of_business")).alias("line_of_business"), F.col("effective_date").cast("date").alias("effective_date"),
        F.col("termination_date").cast("date").alias("termination_date"), F.upper(F.trim("status")).alias("status"), _or_blank("writing_agent_npn").alias("agent_npn"), F.col("rec_id").alias("_rec"))


def lines_of(statement_lines: DataFrame) -> DataFrame:
    kind = F.upper(F.trim("commission_type"))
    amount = F.col("amount").cast("decimal(12,2)")
    return statement_lines.select(
        "line_id", "carrier", "statement_period", F.try_to_date(F.concat("statement_period", F.lit("-01")), "yyyy-MM-dd").alias("period_start"), "line_no", "carrier_member_id", "member_name",
        dates.parse_date_loose(F.col("member_dob")).alias("born"), "policy_ref", _or_blank("agent_npn").alias("agent_npn"), amount.alias("amount"), kind.alias("commission_type"),
        (F.coalesce(kind == "CHARGEBACK", F.lit(False)) | F.coalesce(amount < 0, F.lit(False))).alias("is_chargeback"))


def candidate_edges(lines: DataFrame, book: DataFrame, clients: DataFrame) -> DataFrame:
    """(line_id, policy_id, policy_rec, mask). Blank keys never match. Key pairs are distinct before the join, so a
    key repeated on many lines meets the book once."""
    usable = lines.where(_given("carrier"))
    by_member = usable.where(_given("carrier_member_id")).select("line_id", "carrier", F.trim("carrier_member_id").alias("k")).join(
        book.where(_given("carrier_member_id")).select("carrier", F.trim("carrier_member_id").alias("k"), "policy_id", F.col("_rec").alias("policy_rec")), ["carrier", "k"])
    by_policy = usable.where(_given("policy_ref")).select("line_id", "carrier", F.trim("policy_ref").alias("k")).join(
        book.select("carrier", F.trim("policy_id").alias("k"), "policy_id", F.col("_rec").alias("policy_rec")), ["carrier", "k"])
    people = book_people(book, clients).where("k <> '' and born is not null")
    by_person = usable.select("line_id", "carrier", text.name_key(F.col("member_name")).alias("k"), "born").where("k <> '' and born is not null").join(people, ["carrier", "k", "born"])
    parts = [d.select("line_id", "policy_id", "policy_rec", F.lit(bit).alias("bit")) for d, bit in ((by_member, MEMBER), (by_policy, POLICY), (by_person, PERSON))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("line_id", "policy_id", "policy_rec").agg(F.bit_or("bit").alias("mask"))


def book_people(book: DataFrame, clients: DataFrame) -> DataFrame:
    """The persons of each policy's client, by the client_id as written: (carrier, policy_id, policy_rec, k, born)."""
    who = clients.select("client_id", text.name_key(F.concat("first_name", F.lit(" "), "last_name")).alias("k"), F.col("dob").cast("date").alias("born")).distinct()
    return book.join(who, "client_id").select("carrier", "policy_id", F.col("_rec").alias("policy_rec"), "k", "born").distinct()


def classify_links(lines: DataFrame, edges: DataFrame, book: DataFrame, clients: DataFrame) -> DataFrame:
    """Each line with link_reason, link_state, candidates, policy_id (confirmed links only) and match_method."""
    known = book_people(book, clients).select("policy_rec").distinct().withColumn("known", F.lit(True))
    strong = F.col("mask").bitwiseAND(MEMBER | POLICY) != 0
    weak = F.col("mask").bitwiseAND(PERSON) != 0
    per_line = edges.join(known, "policy_rec", "left").groupBy("line_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(strong).alias("strong_n"), F.count_if(weak).alias("weak_n"),
        F.max(F.when(strong, F.struct("policy_id", "mask", F.coalesce("known", F.lit(False)).alias("known")))).alias("sole"),
        F.bit_or("mask").alias("met"))
    n = lambda c: F.coalesce(c, F.lit(0))
    met = n("met")
    unmet = (_given("carrier_member_id") & (met.bitwiseAND(MEMBER) == 0)) | (_given("policy_ref") & (met.bitwiseAND(POLICY) == 0))
    both = met.bitwiseAND(MEMBER | POLICY) == (MEMBER | POLICY)
    against = (n("weak_n") > 0) & (F.col("sole.mask").bitwiseAND(PERSON) == 0) & (F.col("sole.known") | ~both)
    reason = (
        F.when(n("candidates") == 0, "no_candidate").when(n("strong_n") > 1, "multiple_candidates").when(unmet, "unmatched_strong_key")
        .when((n("strong_n") == 1) & against, "conflicting_name_dob").when(n("strong_n") == 1, "strong_key").when(n("weak_n") > 1, "multiple_candidates").otherwise("name_dob_only"))
    state = F.when(F.col("link_reason") == "strong_key", "confirmed").when(F.col("link_reason") == "name_dob_only", "provisional").when(F.col("link_reason") == "no_candidate", "unmatched").otherwise("ambiguous")
    j = lines.join(per_line, "line_id", "left").withColumn("link_reason", reason).withColumn("link_state", state)
    confirmed = F.col("link_state") == "confirmed"
    return j.select(
        *lines.columns, n("candidates").cast("bigint").alias("candidates"), "link_reason", "link_state", F.when(confirmed, F.col("sole.policy_id")).alias("policy_id"),
        F.when(confirmed & (met.bitwiseAND(MEMBER) != 0), "MEMBER_ID").when(confirmed, "POLICY_REF").when(F.col("link_state") == "provisional", "NAME_DOB").alias("match_method"))


def statement_months(lines: DataFrame) -> DataFrame:
    return lines.where("period_start is not null").select("carrier", "statement_period", "period_start").distinct()


def in_force(book: DataFrame, months: DataFrame) -> DataFrame:
    """Active policies in every month of the run in which they are in force, with whether the carrier reported.

    A policy's own months are generated and met with the run's months on equality, where the obvious form is a
    product of policies and months with a range filter. The run's months are few (a calendar's length).
    """
    run = months.select("statement_period", "period_start").distinct()
    ends = run.agg(F.min("period_start").alias("lo"), F.max("period_start").alias("hi")).first()
    lo, hi = F.lit(ends["lo"]).cast("date"), F.lit(ends["hi"]).cast("date")
    first = F.greatest(F.trunc("effective_date", "MM"), lo)
    last = F.least(F.trunc(F.coalesce("termination_date", hi), "MM"), hi)
    own = book.where("status = 'ACTIVE' and effective_date is not null").where(first <= last).withColumn("period_start", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    reported = months.select("carrier", "statement_period", F.lit(True).alias("has_statement"))
    return own.join(F.broadcast(run), "period_start").join(F.broadcast(reported), ["carrier", "statement_period"], "left").withColumn("has_statement", F.coalesce("has_statement", F.lit(False)))


def leg_book(force: DataFrame, linked: DataFrame) -> DataFrame:
    """Policies due in reported months: whether they were paid, and whether by weak links alone."""
    paid = linked.where("policy_id is not null").groupBy("carrier", "policy_id", "statement_period").agg(F.bool_and(F.col("match_method") == "NAME_DOB").alias("weak"))
    return force.where("has_statement").join(paid, ["carrier", "policy_id", "statement_period"], "left").withColumn("is_paid", F.col("weak").isNotNull()).withColumn("weak", F.coalesce("weak", F.lit(False)))


def leg_status(linked: DataFrame, book: DataFrame) -> DataFrame:
    """Per paid policy (chargebacks aside) its latest month and that month's last line, and whether it is active."""
    paid = linked.where("not is_chargeback and policy_id is not null").groupBy("carrier", "policy_id").agg(
        F.max("statement_period").alias("statement_period"), F.max(F.struct("period_start", "line_id", "line_no")).alias("x"))
    return paid.join(book.select("carrier", "policy_id", "status", "agent_npn", "_rec"), ["carrier", "policy_id"]).select(
        "carrier", "policy_id", "statement_period", F.col("x.line_no").alias("line_no"), "status", "agent_npn", "_rec", F.coalesce(F.col("status") == "ACTIVE", F.lit(False)).alias("agrees"))


def rate_kind(effective: Column, month: Column, new_months: int) -> Column:
    return F.when(dates.months_between(effective, month) < new_months, "NEW").otherwise("RENEWAL")


def with_expected(rows: DataFrame, rates: DataFrame, new_months: int) -> DataFrame:
    """rows with the scheduled amount of their line of business and kind; rates is a lookup of a few rows."""
    keyed = rows.withColumn("rate_kind", rate_kind(F.col("effective_date"), F.col("period_start"), new_months))
    return keyed.join(F.broadcast(rates.select("line_of_business", F.col("commission_type").alias("rate_kind"), F.col("monthly_amount").alias("expected"))), ["line_of_business", "rate_kind"], "left")


def line_expected(linked: DataFrame, book: DataFrame, rates: DataFrame, new_months: int) -> DataFrame:
    """Confirmed lines with their scheduled amount, and whether a chargeback was to be expected."""
    b = book.select("carrier", "policy_id", "line_of_business", "effective_date", "termination_date", "status")
    j = with_expected(linked.where("policy_id is not null").join(b, ["carrier", "policy_id"]), rates, new_months)
    ended = F.col("status").isin("CANCELLED", "TERMINATED") | F.coalesce(F.col("termination_date") <= F.last_day("period_start"), F.lit(False))
    return j.withColumn("expected_chargeback", F.col("is_chargeback") & F.coalesce(ended, F.lit(False)))


VARIANCE = ("rule_id", "reason_code", "carrier", "statement_period", "line_no", "policy_id", "agent_npn", "paid", "expected")


def variances(linked: DataFrame, due: DataFrame, status: DataFrame, expected: DataFrame, force: DataFrame, line_usd: str, line_pct: str) -> DataFrame:
    """What does not agree, with a reason. A null amount on either side is no amount off schedule."""
    none = lambda t: F.lit(None).cast(t)
    money = "decimal(12,2)"

    def rows(df: DataFrame, rule: str, reason: Column, line_no: Column, policy: Column, agent: Column, paid: Column, want: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule_id"), reason.alias("reason_code"), "carrier", "statement_period", line_no.cast("bigint").alias("line_no"), policy.alias("policy_id"), agent.alias("agent_npn"), paid.cast(money).alias("paid"), want.cast(money).alias("expected"))

    no, c = none("string"), F.col
    tolerance = F.greatest(F.lit(line_usd).cast(money), (c("expected") * F.lit(line_pct).cast("decimal(6,4)")).cast("decimal(20,6)"))
    absent = force.where("not has_statement").groupBy("carrier", "statement_period").agg(F.sum(F.coalesce("expected", F.lit(0))).cast(money).alias("expected"))
    parts = [
        rows(due.where("not is_paid"), "TIE-001", F.lit("NO_PAYMENT"), none("bigint"), c("policy_id"), c("agent_npn"), none(money), c("expected")),
        rows(linked.where("policy_id is null"), "TIE-002", F.when(c("link_state") == "unmatched", "ORPHAN_PAYMENT").otherwise("UNRESOLVED_LINK"), c("line_no"), no, c("agent_npn"), c("amount"), none(money)),
        rows(expected.where(~c("expected_chargeback") & (F.abs(c("amount") - c("expected")) > tolerance)), "TIE-003", F.lit("AMOUNT_OFF_SCHEDULE"), c("line_no"), c("policy_id"), c("agent_npn"), c("amount"), c("expected")),
        rows(linked.where("amount is null"), "TIE-003", F.lit("AMOUNT_BLANK"), c("line_no"), c("policy_id"), c("agent_npn"), none(money), none(money)),
        rows(status.where("not agrees"), "TIE-004", F.lit("STATUS_CONFLICT"), c("line_no"), c("policy_id"), c("agent_npn"), none(money), none(money)),
        rows(absent, "TIE-005", F.lit("MISSING_STATEMENT"), none("bigint"), no, no, none(money), c("expected")),
        rows(linked.where("match_method = 'NAME_DOB'"), "TIE-006", F.lit("WEAK_MATCH"), c("line_no"), c("policy_id"), c("agent_npn"), c("amount"), none(money)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals(linked: DataFrame, force: DataFrame, expected: DataFrame, total_pct: str) -> DataFrame:
    """Book and paid totals per carrier and per agent, from one aggregation each: rows are doubled into the two
    groupings after they have been summed per carrier and agent."""
    money = "decimal(18,2)"

    def by_both(pre: DataFrame, sums: list[str]) -> DataFrame:
        keys = F.explode(F.array(F.struct(F.lit("carrier").alias("group_by"), F.col("carrier").alias("key")), F.struct(F.lit("agent").alias("group_by"), F.col("agent_npn").alias("key"))))
        return pre.select(keys.alias("g"), *sums).groupBy("g.group_by", "g.key").agg(*[F.sum(s).alias(s) for s in sums])

    book = force.select("carrier", "agent_npn", F.coalesce("expected", F.lit(0)).cast("decimal(12,2)").alias("e")).unionByName(
        expected.where("expected_chargeback").select("carrier", "agent_npn", F.col("amount").alias("e"))).groupBy("carrier", "agent_npn").agg(F.sum("e").alias("book_expected"))
    paid = linked.groupBy("carrier", "agent_npn").agg(F.sum("amount").alias("statement_paid"), F.sum(F.when(F.col("policy_id").isNull(), F.col("amount")).otherwise(F.lit(0).cast("decimal(12,2)"))).alias("unexplained_revenue"))
    j = by_both(book, ["book_expected"]).join(by_both(paid, ["statement_paid", "unexplained_revenue"]), ["group_by", "key"], "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0)).cast(money)
    diff = z("statement_paid") - z("book_expected")
    return j.select("group_by", "key", z("book_expected").alias("book_expected"), z("statement_paid").alias("statement_paid"), diff.cast(money).alias("difference"), z("unexplained_revenue").alias("unexplained_revenue"),
                    (F.abs(diff) <= F.abs(z("book_expected")) * F.lit(total_pct).cast("decimal(6,4)")).alias("within_tolerance"))


METHODS = ((MEMBER, "MEMBER_ID"), (POLICY, "POLICY_REF"), (PERSON, "NAME_DOB"))


def link_evidence(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Every line with its candidates and the keys that made each, in order of policy: policy:KEY+KEY|policy:KEY."""
    keys = F.array_join(F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(bit) != 0, F.lit(name)) for bit, name in METHODS]), lambda k: k.isNotNull()), "+")
    per_line = edges.select("line_id", F.concat("policy_id", F.lit(":"), keys).alias("e")).groupBy("line_id").agg(F.array_join(F.array_sort(F.collect_list("e")), "|").alias("evidence"))
    return lines.select("line_id").join(per_line, "line_id", "left")


def unresolved_reasons(linked: DataFrame, raw: DataFrame) -> DataFrame:
    """Why unconfirmed lines lack evidence: (line_id, reason) of name_blank, dob_blank, dob_malformed, keys_blank."""
    j = linked.where("link_state <> 'confirmed'").select("line_id", "born").join(raw.select("line_id", "member_name", "member_dob", "carrier_member_id", "policy_ref"), "line_id")
    reasons = F.array(
        F.when(~_given("member_name"), "name_blank"), F.when(~_given("member_dob"), "dob_blank"), F.when(_given("member_dob") & F.col("born").isNull(), "dob_malformed"),
        F.when(~_given("carrier_member_id") & ~_given("policy_ref"), "keys_blank"))
    return j.select("line_id", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def variance_dollars(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id", "reason_code").agg(F.count(F.lit(1)).cast("bigint").alias("variances"), F.sum(F.abs(F.coalesce("paid", F.lit(0)) - F.coalesce("expected", F.lit(0)))).cast("decimal(18,2)").alias("dollars"))
