"""A drop folder through reading, mapping, checks and tie-out: a clean world gives nothing, planted defects are found."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.cli import main
from ledgerloom.operators import canonicalize, checks, tieout
from ledgerloom.runtime import durable
from ledgerloom.sources import drop, fixtures


def run(spark, folder):
    rows = drop.read_drop(spark, folder)
    clients, policies = canonicalize.book_tables(rows.where("source = 'crm'"))
    lines_raw = durable(canonicalize.payment_lines(rows))
    book, lines = tieout.book_of(policies), tieout.lines_of(lines_raw)
    edges = durable(tieout.candidate_edges(lines, book, clients))
    linked = durable(tieout.classify_links(lines, edges, book, clients))
    rates = spark.createDataFrame([("MA", k, v) for k, v in fixtures.RATE.items()], "line_of_business string, commission_type string, monthly_amount string").withColumn("monthly_amount", F.col("monthly_amount").cast("decimal(12,2)"))
    force = tieout.with_expected(tieout.in_force(book, tieout.statement_months(lines)), rates, 12)
    found = tieout.variances(linked, tieout.leg_book(force, linked), tieout.leg_status(linked, book), tieout.line_expected(linked, book, rates, 12), force, "1.00", "0.01")
    out = {(r["reason_code"], r["policy_id"], r["statement_period"]) for r in found.collect()}
    ids = {r["_rec"]: r["policy_id"] for r in book.collect()}
    mis = {ids[r["policy_rec"]] for r in checks.misfiled(edges, lines, book, clients).collect()}
    issues = {(r["issue"], r["key"]) for r in checks.packet_issues(clients, policies).collect()}
    copies = checks.later_copies(lines_raw, "line_id", ["carrier", "statement_period", "carrier_member_id", "policy_ref", "amount", "commission_type"]).count()
    return out, mis, issues, copies, len(ids), lines_raw.count()


def test_clean_world(spark, tmp_path):
    fixtures.write_drop(fixtures.clean_world(), str(tmp_path))
    assert run(spark, str(tmp_path)) == (set(), set(), set(), 0, 60, 180)


def test_planted_world(spark, tmp_path):
    w = fixtures.plant(fixtures.clean_world())
    fixtures.write_drop(w, str(tmp_path))
    found, misfiled, issues, copies, _, _ = run(spark, str(tmp_path))
    have = {(k, f"{p}/{m}") for k, p, m in found} | {(k, p) for k, p, _ in found} | {("MISFILED", p) for p in misfiled} | issues
    wanted = [x for x in w.planted if x[0] not in ("REPEATED_LINE", "ORPHAN_PAYMENT")]
    assert set(wanted) <= have and copies == 1
    assert {k for k, _, _ in found} == {"NO_PAYMENT", "AMOUNT_OFF_SCHEDULE", "STATUS_CONFLICT", "ORPHAN_PAYMENT"}
    assert len([1 for k, _, _ in found if k == "ORPHAN_PAYMENT"]) == 1


def test_command_line(tmp_path, spark):
    fixtures.write_drop(fixtures.plant(fixtures.clean_world()), str(tmp_path / "drop"))
    assert main(["run", str(tmp_path / "drop"), str(tmp_path / "run")]) == 0
    assert main(["run", str(tmp_path / "drop"), str(tmp_path / "run")]) == 2
    assert main(["diff", str(tmp_path / "run"), str(tmp_path / "run")]) == 0 and main(["version"]) == 0
    (tmp_path / "drop" / "crm.csv").unlink()
    assert main(["run", str(tmp_path / "drop"), str(tmp_path / "run"), "--overwrite"]) == 1
    with pytest.raises(SystemExit):
        main([])
