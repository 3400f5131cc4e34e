"""Core operators on small tables: nulls, blanks, ties, repeats, empty tables, extra columns, hot keys."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom import runtime
from ledgerloom.operators import checks, clean, compare_runs, findings, gates, mapping, multivalue, references, revenue, schema_drift, tieout, versions

T = datetime.datetime


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def split_plain(text):
    """The same by a character loop."""
    out, buf, lit, i = [], "", False, 0
    delims = ",;|/&\n\r\t"

    def close():
        nonlocal buf, lit
        v = buf.strip()
        if lit:
            out.append(v)
        elif re.fullmatch(r"[A-Za-z]{2}(\s+[A-Za-z]{2})+", v):
            out.extend(v.split())
        elif v:
            out.append(v)
        buf, lit = "", False

    while i < len(text):
        c = text[i]
        if c in "\"'" and not buf.strip() and not lit:
            j, val = i + 1, ""
            while j < len(text):
                if text[j] == c:
                    if text[j + 1 : j + 2] == c:
                        val += c
                        j += 2
                        continue
                    break
                val += text[j]
                j += 1
            if j < len(text):
                buf, lit, i = val, True, j + 1
                continue
        if c in delims:
            close()
        elif re.match(r"and\b", text[i:], re.I) and (i == 0 or not text[i - 1].isalnum()):
            close()
            i += 3
            continue
        elif not (lit and c == " "):
            buf += c
        i += 1
    close()
    return [v for v in out if v]


def test_split_values_against_loop(spark):
    r = random.Random(4)
    words = ["FL", "ga", "New York", '"TX, res"', "'O''Hara; x'", '"A ""q"" b"', "OH L123", "and", "WA", "in"]
    texts = ["", " ", ",;|", '"open', "O'Neil", None, "FL GA  TX", "x" * 5000]
    for _ in range(300):
        texts.append("".join(r.choice(words) + r.choice([", ", ";", " | ", "/", "\n", "\t", " & ", " and ", " ,", ";;"]) for _ in range(r.randint(1, 6))))
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "rec_id long, license_states string, pos_no string")
    got = {}
    for i, p, v in rows(multivalue.explode_values(df, "rec_id", "license_states")):
        got.setdefault(i, []).append(v)
    for i, t in enumerate(texts):
        assert got.get(i, []) == split_plain(t or ""), t


PARENTS = "client_id string, loaded_at timestamp_ntz, key string"


def ref_tables(spark, policies, clients, removed=()):
    return {
        "policies": spark.createDataFrame(policies, "rec_id long, client_id string, loaded_at timestamp_ntz, key string, n long"),
        "clients": spark.createDataFrame(clients, PARENTS),
        "removed_keys": spark.createDataFrame(list(removed), "table_name string, field_name string, key_value string, removed_at timestamp_ntz, carrier string"),
    }


def test_orphans(spark):
    jan, feb, mar = T(2024, 1, 5), T(2024, 2, 5), T(2024, 3, 5)
    p = [(1, "A", feb, "x", 0), (2, " a\t", feb, "x", 0), (3, "B", jan, "x", 0), (4, "C", feb, "x", 0), (5, None, feb, "x", 0), (6, "D", feb, "x", 0), (7, "D", jan, "x", 0), (8, "E", mar, "x", 0), (9, "", jan, "x", 0)]
    c = [("a", jan, "x"), ("B", feb, "x"), ("B", mar, "x"), ("D", jan, "x"), (None, jan, "x")]
    rem = [("clients", "client_id", "d", T(2024, 1, 20), None), ("clients", "client_id", "E", T(2024, 9, 9), None), ("agents", "npn", "A", jan, None)]
    tables = ref_tables(spark, p, c, rem)
    ref = (references.REFERENCES[0],)
    want = [(3, "late", "2024-01"), (4, "missing", "2024-02"), (6, "deleted", "2024-02"), (8, "deleted", "2024-03"), (9, "missing", "2024-01")]
    for share in (references.HEAVY_SHARE, 0.9):
        assert rows(references.find_orphans(tables, ref, share).select("rec_id", "orphan_kind", "load_month")) == want
    counts = {(k, m): n for k, m, n in rows(references.orphan_counts(tables, ref).select("orphan_kind", "load_month", "orphan_rows"))}
    assert counts == {(k, m): sum(1 for _, kk, mm in want if (kk, mm) == (k, m)) for _, k, m in want}


def test_orphans_against_loop(spark):
    """Random keys, removals and dates, with a share that makes keys heavy and one that makes none."""
    r = random.Random(8)
    day = lambda: T(2024, r.randint(1, 4), r.randint(1, 28)) if r.random() < 0.93 else None
    p = [(i, r.choice(["HOT", "hot ", f"k{r.randint(0, 30)}", f"K{r.randint(0, 30)}", None]), day(), "x", 0) for i in range(400)]
    c = [(f"k{i}", day(), "x") for i in range(30) if i % 4] + [("Hot", T(2024, 2, 10), "x")]
    rem = [("clients", "client_id", f"K{i}", day(), None) for i in range(0, 30, 3)] + [("clients", "client_id", "HOT", T(2024, 3, 10), None)]
    norm = lambda k: k.strip().lower()
    want = []
    for i, k, at, _, _ in p:
        if k is None:
            continue
        loads, gone = [x for n, x, _ in c if norm(n) == norm(k)], [x for _, _, n, x, _ in rem if norm(n) == norm(k)]
        if gone and (not loads or (at and any(g and g <= at for g in gone))):
            kind = "deleted"
        elif not loads:
            kind = "missing"
        elif at and any(loads) and min(x for x in loads if x) > at:
            kind = "late"
        else:
            continue
        want.append((i, kind, at.strftime("%Y-%m") if at else None))
    tables, ref = ref_tables(spark, p, c, rem), (references.REFERENCES[0],)
    for share in (references.HEAVY_SHARE, 0.1):
        got = [tuple(x) for x in references.find_orphans(tables, ref, share).select("rec_id", "orphan_kind", "load_month").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        counts = {(x["orphan_kind"], x["load_month"]): x["orphan_rows"] for x in references.orphan_counts(tables, ref, share).collect()}
        assert counts == {km: sum(1 for _, k, m in want if (k, m) == km) for km in {(k, m) for _, k, m in want}}


def test_orphans_hot_key_and_empty(spark):
    jan = T(2024, 1, 5)
    p = [(i, "HOT" if i % 3 else f"K{i}", jan, "x", 0) for i in range(600)]
    tables = ref_tables(spark, p, [("K3", jan, "x")])
    ref = (references.REFERENCES[0],)
    assert references.find_orphans(tables, ref).count() == 599
    empty = ref_tables(spark, [], [])
    assert references.find_orphans(empty, ref).count() == 0 and references.orphan_counts(empty, ref).count() == 0


REVIEW = "item_id string, file_id long, source string, received_at timestamp_ntz, header string, header_no long, proposed_field string, samples array<string>, samples_withheld boolean, allowed_fields array<string>"


def review(spark, files):
    out = []
    for file_id, source, day, cols in files:
        for k, (h, field, samples) in enumerate(cols, 1):
            out.append((f"{file_id}-{k}", file_id, source, T(2024, 1, day), h, k, field, samples, samples is None, ["t.zip", "t.name", "none"]))
    return spark.createDataFrame(out + out[:2], REVIEW)


def test_schema_changes(spark):
    files = [
        (1, "crm_1", 1, [("Zip", "t.zip", ["12345", "54321"]), ("Name", "t.name", ["Ann Lee"]), ("Paid", "none", ["1.5", "2.5"])]),
        (2, "crm_1", 2, [(" NAME ", "t.name", ["Bob Ray"]), ("Postal Code", "t.zip", ["11111"]), ("Paid", "none", ["5", "7", "-"])]),
        (3, "crm_1", 3, [("Postal  Code", "t.zip", ["2/3/2020", "4/5/2021", "12345"]), ("Smoker?", "none", None)]),
        (4, "crm_2", 2, [("Postal Code", "t.zip", ["x"]), ("Zip Code", "t.zip", ["x"])]),
    ]
    got = rows(schema_drift.changes(review(spark, files)).select("file_id", "change_kind", "old_header", "new_header"))
    assert got == sorted([
        (2, "renamed", "Zip", "Postal Code"), (2, "retyped", "Paid", "Paid"),
        (3, "removed", " NAME ", ""), (3, "removed", "Paid", ""), (3, "retyped", "Postal Code", "Postal  Code"), (3, "added", "", "Smoker?")])


def test_renames_beyond_the_list(spark):
    """Wordings that are alike carry a column on; wordings that replace each other are learnt."""
    files = [
        (1, "crm_1", 1, [("Smoker", "none", ["Y", "N"]), ("Quux", "none", ["AB-1"])]),
        (2, "crm_1", 2, [("Smoker Flag", "none", ["N", "Y"]), ("Zorg", "none", ["AB-2"])]),
        (3, "crm_2", 1, [("Desk", "none", ["East"]), ("Zorg", "none", ["CD-3"])]),
        (4, "crm_2", 2, [("Desk Name", "none", ["West"]), ("Quux", "none", ["CD-4"])]),
        (5, "pay_1", 1, [("Smoker", "none", ["Y"])]), (6, "pay_1", 2, [("Submit Dt", "none", ["1/2/2024"])]),
    ]
    got = rows(schema_drift.changes(review(spark, files)).select("file_id", "change_kind", "old_header", "new_header"))
    assert got == sorted([
        (2, "renamed", "Smoker", "Smoker Flag"), (2, "renamed", "Quux", "Zorg"), (4, "renamed", "Desk", "Desk Name"), (4, "renamed", "Zorg", "Quux"),
        (6, "removed", "Smoker", ""), (6, "added", "", "Submit Dt")])


def test_file_pairs_follow_order_over_partitions(spark):
    r = random.Random(1)
    files = [(i, f"crm_{'7' if r.random() < 0.5 else i % 5}", 1 + r.randint(0, 20), [("A", None, ["1"])]) for i in range(60)]
    df = review(spark, files)
    got = {f: p for f, p in rows(schema_drift.file_pairs(df, 7).select("file_id", "prev_id").where("prev_id is not null"))}
    want = {}
    for s in {x[1] for x in files}:
        order = [f for _, f in sorted((d, i) for i, ss, d, _ in files if ss == s)]
        want |= dict(zip(order[1:], order))
    assert got == want


def test_consistent_table(spark):
    files = [(1, "crm_1", 1, [("Zip", "t.zip", ["12345"]), ("Other", "none", ["x"])]), (2, "crm_1", 2, [("Postal Code", "t.zip", ["11111"]), ("Zip", "t.zip", ["1"])])]
    df = review(spark, files)
    raw = spark.createDataFrame([(1, 1, 1, ["12345", "o"]), (2, 2, 1, ["11111", None, "extra"]), (3, 9, 1, None)], "raw_id long, file_id long, row_number long, cells array<string>")
    got = {r["raw_id"]: r for r in schema_drift.consistent_table(df, raw, schema_drift.changes(df)).collect()}
    assert got[1]["t__zip"] == "12345" and got[1]["other_columns"] == {"other": "o"}
    assert got[2]["t__zip"] == "11111" and got[2]["other_columns"]["column_3"] == "extra" and got[3]["t__zip"] is None


def test_schema_drift_edges(spark):
    df = review(spark, [(1, "crm_1", 1, [("Zip", "t.zip", ["12345", None]), (None, None, None)]), (2, "crm_1", 2, [(None, None, ["x"]), ("x" * 5000, None, [])]), (3, None, 3, [("A", None, ["1"])]), (4, None, 4, [("A", None, None), ("A", None, ["q"])])])
    df = df.unionByName(df.where("file_id = 2").withColumn("item_id", F.lit(None).cast("string"))).unionByName(df.limit(1).withColumn("file_id", F.lit(None).cast("long")))
    df = df.withColumn("norm", F.lit("clash")).withColumn("concept", F.lit("clash")).withColumn("format_fingerprint", F.lit("f"))
    got = rows(schema_drift.changes(df).select("file_id", "change_kind"))
    assert {f for f, _ in got} == {2, 4} and (4, "added") in got
    empty = df.limit(0)
    assert schema_drift.changes(empty).count() == 0
    raw = spark.createDataFrame([(1, 1, 1, ["a"], "clash")], "raw_id long, file_id long, row_number long, cells array<string>, source string")
    t = schema_drift.consistent_table(df, raw, schema_drift.changes(df)).collect()
    assert len(t) == 1 and t[0]["t__zip"] == "a"
    assert schema_drift.consistent_table(df, raw.limit(0), schema_drift.changes(df)).count() == 0


def test_split_values_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "rec_id long, license_states string")
    assert multivalue.explode_values(df, "rec_id", "license_states").count() == 0 and multivalue.explode_values(df.limit(0), "rec_id", "license_states").count() == 0
    long = spark.createDataFrame([(1, ",".join(["FL"] * 20000))], "rec_id long, license_states string")
    assert multivalue.explode_values(long, "rec_id", "license_states").count() == 20000


def test_sample_kinds(spark):
    texts = ["12", "20240101", "$1,234.50", "(6.5)", "3/4/20", "07-Mar-1956", "Y", "TRUE", "RD-12", "-", "N/A", None, " 12 ", "2024-01-05T10:00", "Mar 3, 2024"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.select("i", schema_drift.sample_kind(F.col("t")).alias("k")).orderBy("i").select("k").collect()]
    assert got == ["whole", "whole", "decimal", "decimal", "date", "date", "flag", "flag", "text", None, None, None, "whole", "date", "date"]
    cols = spark.createDataFrame([(1, ["1", "2", "x"]), (2, ["1", "x"]), (3, None), (4, ["AB-1", "n/a", "Xy 22"])], "i int, s array<string>")
    kinds = {r["i"]: (r["k"], r["h"]) for r in cols.select("i", schema_drift.column_kind(F.col("s")).alias("k"), schema_drift.sample_shapes(F.col("s")).alias("h")).collect()}
    assert kinds[1][0] == "whole" and kinds[2][0] is None and kinds[3] == (None, None) and kinds[4] == ("text", ["A-9", "a 9"])


def test_consistent_types(spark):
    files = [(1, "crm_1", 1, [("Zip", "t.zip", ["1.5", "2.25"]), ("Name", "t.name", ["1/2/2024"])]), (2, "crm_1", 2, [("Zip", "t.zip", ["7", "8"]), ("Name", "t.name", ["2024-03-04"])])]
    df = review(spark, files)
    raw = spark.createDataFrame([(1, 1, 1, ["(1,200.50)", "1/2/2024"]), (2, 2, 1, ["oops", "soon"]), (3, 2, 2, [None, ""])], "raw_id long, file_id long, row_number long, cells array<string>")
    t = schema_drift.consistent_table(df, raw, schema_drift.changes(df))
    got = {r["raw_id"]: r for r in t.collect()}
    assert str(got[1]["t__zip"]) == "-1200.500000" and got[1]["t__name"] == datetime.date(2024, 1, 2) and got[1]["other_columns"] == {}
    assert got[2]["t__zip"] is None and got[2]["other_columns"] == {"t.zip as written": "oops", "t.name as written": "soon"} and got[3]["other_columns"] == {}


def test_copies_conflicts_identities(spark):
    df = spark.createDataFrame([(1, "P1", "a"), (2, "P1", "a"), (3, " P1 ", "b"), (4, None, None), (5, None, None), (6, "P2", None)], "id long, pid string, v string")
    assert rows(checks.later_copies(df, "id", ["pid", "v"])) == [(2, 1), (5, 4)]
    assert rows(checks.conflicting_keys(df, "id", "pid", ["v"])) == [(3, "P1")]
    ppl = spark.createDataFrame([(1, "Ann Lee", "1950-01-01", "A"), (2, "ANN  lee Jr", "1950-01-01", "B"), (3, "Ann Lee", None, "C"), (4, "Bob", "1950-01-01", "A")], "id long, n string, d string, o string")
    assert rows(checks.shared_identity(ppl, "id", F.col("n"), F.col("d").cast("date"), "o")) == [(1, "A", "A"), (2, "B", "A")]
    assert checks.later_copies(df.limit(0), "id", ["v"]).count() == 0


def test_intervals(spark):
    d = lambda s: datetime.date.fromisoformat(s) if s else None
    ev = spark.createDataFrame([(1, "x", d("2024-05-01")), (2, "x", d("2024-01-01")), (3, "x", d("2025-01-01")), (4, "y", d("2024-05-01")), (5, None, d("2024-05-01")), (6, "x", None)], "id long, k string, day date")
    iv = spark.createDataFrame([("x", d("2024-02-01"), d("2024-06-30")), ("x", d("2024-03-01"), d("2024-04-30")), (None, d("2020-01-01"), None)], "k string, start date, end date")
    assert {r[0]: (r[1], r[2]) for r in checks.interval_state(ev, iv, ["k"], "id", "day").collect()} == {
        1: ("HELD", None), 2: ("MISSING", None), 3: ("EXPIRED", d("2024-06-30")), 4: ("MISSING", None), 5: (None, None), 6: (None, None)}


def book_fixture(spark):
    p = "rec_id long, policy_id string, client_id string, carrier string, carrier_member_id string, line_of_business string, effective_date date, termination_date date, status string, writing_agent_npn string"
    d = datetime.date
    pol = [(1, "P1", "C1", "X", "M1", "MA", d(2024, 1, 1), None, "active ", "7"), (2, "P1", "C9", "X", "M9", "MA", d(2024, 1, 1), None, "ACTIVE", "8"), (3, "P2", "C2", "X", "M2", "MA", d(2024, 1, 1), d(2024, 1, 31), "CANCELLED", None),
           (4, "P3", "C3", "X", " ", "MA", d(2024, 1, 1), None, "ACTIVE", "7"), (5, "P4", "C3", "X", None, "MA", d(2024, 2, 1), None, "ACTIVE", "7")]
    cli = [("C1", "Ann", "Lee", d(1950, 1, 1)), ("C2", "Bob", "Ray", d(1951, 1, 1)), ("C3", "Cy", "Fox", d(1952, 1, 1))]
    lin = "line_id long, carrier string, statement_period string, line_no long, carrier_member_id string, member_name string, member_dob string, policy_ref string, agent_npn string, amount decimal(12,2), commission_type string"
    lines = [(1, "X", "2024-01", 1, "M1", "Ann Lee", "1/1/1950", "P1", "7", 10, "NEW"), (2, "X", "2024-01", 2, "M1", "Bob Ray", "1/1/1951", None, None, 11, "NEW"), (3, "X", "2024-01", 3, "M7", "Zed", None, None, "7", 12, "NEW"),
             (4, "X", "2024-01", 4, "M1", "q", None, "P2", "7", 13, "NEW"), (5, "X", "2024-01", 5, None, "Bob Ray", "19510101", " ", "7", 14, "NEW"), (6, "X", "2024-01", 6, None, "Cy Fox", "1952-01-01", None, "7", 15, "NEW"),
             (7, "X", "2024-01", 7, "M2", "Bob Ray", "1951-01-01", "P9", "7", None, "chargeback"), (8, "Y", "2024-02", 8, "M1", "Ann Lee", "1/1/1950", "P1", "7", 16, "NEW")]
    from decimal import Decimal

    lines = [(*r[:9], None if r[9] is None else Decimal(r[9]), r[10]) for r in lines]
    clients = spark.createDataFrame(cli, "client_id string, first_name string, last_name string, dob date")
    return tieout.book_of(spark.createDataFrame(pol, p)), tieout.lines_of(spark.createDataFrame(lines, lin)), clients


def test_link_classifier(spark):
    book, lines, clients = book_fixture(spark)
    assert rows(book.select("policy_id", "_rec", "agent_npn", "status")) == [("P1", 1, "7", "ACTIVE"), ("P2", 3, "(blank)", "CANCELLED"), ("P3", 4, "7", "ACTIVE"), ("P4", 5, "7", "ACTIVE")]
    edges = tieout.candidate_edges(lines, book, clients)
    got = {r["line_id"]: (r["link_reason"], r["link_state"], r["policy_id"]) for r in tieout.classify_links(lines, edges, book, clients).collect()}
    assert got == {
        1: ("strong_key", "confirmed", "P1"), 2: ("conflicting_name_dob", "ambiguous", None), 3: ("no_candidate", "unmatched", None), 4: ("multiple_candidates", "ambiguous", None),
        5: ("name_dob_only", "provisional", None), 6: ("multiple_candidates", "ambiguous", None), 7: ("unmatched_strong_key", "ambiguous", None), 8: ("no_candidate", "unmatched", None)}
    force = rows(tieout.in_force(book, tieout.statement_months(lines)).select("policy_id", "statement_period", "has_statement"))
    assert force == [("P1", "2024-01", True), ("P1", "2024-02", False), ("P3", "2024-01", True), ("P3", "2024-02", False), ("P4", "2024-02", False)]


def test_totals_keep_all_money(spark):
    book, lines, clients = book_fixture(spark)
    linked = tieout.classify_links(lines, tieout.candidate_edges(lines, book, clients), book, clients)
    rates = spark.sql("select 'MA' line_of_business, 'NEW' commission_type, cast(10 as decimal(12,2)) monthly_amount")
    force = tieout.with_expected(tieout.in_force(book, tieout.statement_months(lines)), rates, 12)
    t = tieout.totals(linked, force, tieout.line_expected(linked, book, rates, 12), "0.005").collect()
    for g in ("carrier", "agent"):
        assert sum(r["statement_paid"] for r in t if r["group_by"] == g) == 91 and sum(r["book_expected"] for r in t if r["group_by"] == g) == 50
    assert sum(r["unexplained_revenue"] for r in t if r["group_by"] == "carrier") == 81


@pytest.mark.parametrize("paid,flag", [("101.00", False), ("101.01", True), ("99.00", False), ("98.99", True)])
def test_tolerance_edges(spark, paid, flag):
    df = spark.sql(f"select cast({paid} as decimal(12,2)) amount, cast(100 as decimal(12,2)) expected, false expected_chargeback, 'X' carrier, '2024-01' statement_period, 1L line_no, 'P' policy_id, 'a' agent_npn")
    none = spark.sql("select 'X' carrier, '2024-01' statement_period, 1L line_no, 'P' policy_id, 'a' agent_npn, cast(1 as decimal(12,2)) amount, cast(1 as decimal(12,2)) expected, 'unmatched' link_state, 'q' match_method, true is_paid, true agrees, true has_statement")
    v = tieout.variances(none, none, none, df, none, "1.00", "0.01").collect()
    assert bool(v) == flag


def test_findings_and_clean(spark):
    df = spark.createDataFrame([(1, "1EG4TE5MK73", "12345", None, "2125550100", datetime.date(1950, 1, 1), "NY"), (2, "bad", "1", "x@y.zz", "1", datetime.date(1850, 1, 1), None)], "rec_id long, mbi string, zip string, email string, phone string, dob date, state string")
    f = findings.run_checks(df, "rec_id", findings.client_checks(F.lit("2026-01-01").cast("date")), "clients")
    assert rows(f.select("row_id", "rule_id")) == [(2, "ADR-001"), (2, "CON-002"), (2, "DOB-002"), (2, "MBI-001")]
    assert f.select("finding_id").distinct().count() == 4 and all("bad" != r["shown"] for r in f.collect())
    assert rows(clean.without_errors(df, "rec_id", f).select("rec_id", "warning_ids")) == [(1, None)]
    assert findings.run_status(f).first()[0] == "FAILED" and findings.run_status(f.limit(0)).first()[0] == "PASSED"
    hh = spark.createDataFrame([("H", "B", 1), ("H", "A", 2), ("H", "B", 3), (None, "C", 4)], "household_id string, client_id string, rec_id long")
    assert rows(clean.households(hh)) == [("H", "B", "B|A", 2)]
    t = clean.typed(spark.createDataFrame([("1", "x"), (None, "2024-01-01")], "a string, b string"), {"a": "int", "b": "date"})
    assert sorted((r["a"] or 0, str(r["b"]), r["lost_cells"]) for r in t.collect()) == [(0, "2024-01-01", 0), (1, "None", 1)]


def test_runs(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    assert {tuple(r) for r in compare_runs.multiset_diff(a, b, ["k"]).collect()} == {("x", 1, 0, 1), ("y", 1, 0, 0), ("z", 0, 1, 0), (None, 0, 0, 1)}


def test_versions(spark):
    chain = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(1, 60)], "version long, parent long")
    got = set(rows(versions.ancestors(chain)))
    want = {(i, j) for i in range(1, 60) for j in range(i - i % 10, i) if i % 10}
    assert got == want
    loop = spark.createDataFrame([(1, 2), (2, 1)], "version long, parent long")
    with pytest.raises(ValueError):
        versions.ancestors(loop)
    d = datetime.date
    v = spark.createDataFrame([(1, None, "a", "s1", d(2024, 1, 1)), (2, 1, "a", "s2", d(2024, 5, 1)), (3, None, "b", "s3", d(2024, 1, 1)), (4, None, "b", "s4", d(2024, 1, 1)), (5, None, "c", "s5", None), (6, None, "d", "s6", d(2023, 1, 1)), (7, None, "e", "s7", d(2024, 1, 1))],
                              "version long, parent long, k string, sha string, source_date date")
    want = spark.createDataFrame([(k, d(2024, 1, 1)) for k in "abcdez"], "k string, least_date date")
    states = versions.readiness(want, v, v.where("version <> 7").select("version"), ["k"])
    assert dict(rows(states)) == {"a": "current", "b": "conflicting", "c": "unknown", "d": "stale", "e": "missing", "z": "missing"}
    assert versions.overall_state(states).first()[0] == "conflicting" and versions.overall_state(states.limit(0)).first()[0] == "unknown"


def test_row_rules(spark):
    day = F.lit("2026-01-01").cast("date")
    c = spark.createDataFrame([(1, "1950-02-30", None, "10001", "NY", None, None, ["NY"]), (2, "3/4/1950", None, "10001", "TX", None, None, ["NY"]), (3, None, None, "99999", "Texas", None, None, None), (4, " ", " ", "", " ny", " ", "", ["NJ"])],
                              "rec_id long, dob string, mbi string, zip string, state string, email string, phone string, zs array<string>")
    got = {(r["row_id"], r["rule_id"]) for r in findings.run_checks(c, "rec_id", findings.client_checks(day, "zs"), "clients").collect()}
    assert got == {(1, "DOB-001"), (2, "ADR-002"), (3, "ADR-003"), (4, "ADR-002")}
    p = spark.createDataFrame(
        [(1, " 77 ", "H1234-001", "PDP", "soon", "2024-05-01", "Active"), (2, "78", "S1234-001", "PDP", "2024-05-02", "x", "odd"), (3, "0x", "Plan Z", "medsupp", "2024-05-02", None, "ACTIVE"), (4, None, "Plan G", "MEDSUPP", None, "2025-01-01", "active"), (5, "77", None, "MA", None, None, None)],
        "rec_id long, writing_agent_npn string, plan_id string, line_of_business string, effective_date string, termination_date string, status string")
    roster = spark.createDataFrame([("77",), ("77",), (None,), (" 79",)], "npn string")
    found = findings.run_checks(findings.with_roster(p, roster), "rec_id", findings.policy_checks(["ACTIVE"], day, "agent_in_roster"), "policies")
    assert {(r["row_id"], r["rule_id"], r["field"]) for r in found.collect()} == {
        (1, "PLN-003", "plan_id"), (1, "DAT-001", "effective_date"), (1, "DAT-003", "status"), (2, "NPN-002", "writing_agent_npn"), (2, "DAT-001", "termination_date"), (2, "DAT-004", "effective_date"),
        (2, "STA-001", "status"), (3, "NPN-001", "writing_agent_npn"), (3, "PLN-004", "plan_id"), (4, "DAT-003", "status")}


def test_ledger_decisions(spark):
    def decide(*receipts):
        rows_ = [("s", n, f"id{n}", rev, dig, dec or dig, rep) for n, (rev, dig, rep, dec) in enumerate(receipts)]
        df = spark.createDataFrame(rows_ + [("other", 0, "o", None, None, None, None)], "scope string, seq long, receipt_id string, revision string, digest string, declared string, replaces string")
        out = versions.receipt_ledger(df)
        return [(r["state"], r["reason"]) for r in out.where("scope = 's'").orderBy("seq").collect()]

    r = lambda rev, dig, rep=None, dec=None: (rev, dig, rep, dec)
    got = decide(r("r1", "a"), r("r1", "a"), r("r2", "b"), r("r2", "b"), r("r3", "c", "r1"), r("r4", "d", "r1"), r("r5", "e", "r3", "a"), r("r6", "b", "r3"), r("r7", "a", "zz"))
    assert got == [("superseded", None), ("duplicate", None), ("conflict", "replacement_not_current"), ("duplicate", "duplicate_conflict_evidence"), ("superseded", None), ("conflict", "replacement_not_current"),
                   ("conflict", "declared_hash_collision"), ("active", None), ("conflict", "replacement_not_current")]
    assert decide(r("r1", "a", "r0")) == [("conflict", "replacement_without_original")]
    assert decide(r("r1", "a"), r("r1", "b", "r1")) == [("active", None), ("conflict", "revision_id_reused")]
    assert decide(r(None, None), r(None, None)) == [("active", None), ("duplicate", None)]


def test_ledger_totals_and_digest(spark):
    decided = spark.createDataFrame([("a", "active"), ("b", "superseded")], "receipt_id string, state string")
    lines = spark.sql("select * from values ('a', 'X', 'NEW', 1.10BD), ('a', 'X', 'odd', 2.00BD), ('a', 'Y', 'NEW', null), ('b', 'X', 'NEW', 9.00BD) as t(receipt_id, carrier, category, amount)")
    assert {tuple(map(str, r)) for r in versions.ledger_totals(decided, lines, ["carrier"], ["NEW", "odd"]).collect()} == {("X", "1.10", "2.00", "3.10"), ("Y", "0.00", "0.00", "0.00")}
    p = spark.createDataFrame([("p", 1, "x"), ("p", 2, None), ("q", 2, None), ("q", 1, "x"), ("r", 1, "x")], "k string, a int, b string")
    d = dict(rows(versions.package_digest(p, ["k"], ["a", "b"])))
    assert d["p"] == d["q"] != d["r"] and len(d["p"]) == 64


def test_superseded_by_pointers(spark):
    n = 300
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(1000, 5), (2000, None)], "version long, parent long")
    got = {r[0] for r in versions.superseded(chain, spark.createDataFrame([(200,), (1000,), (2000,)], "version long")).collect()}
    assert got == set(range(200))
    loop = spark.createDataFrame([(1, 2), (2, 1)], "version long, parent long")
    with pytest.raises(ValueError):
        versions.superseded(loop, loop.select("version"), rounds=6)


def test_intermediate_data_needs_a_shared_folder(spark):
    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Session:
        conf = Conf({"spark.master": "spark://somewhere:7077"})

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
    Session.conf = Conf({"spark.master": "spark://somewhere:7077", "spark.checkpoint.dir": "hdfs://x/y"})
    assert runtime.shared_dir(Session()) == "hdfs://x/y"
    with pytest.raises(ValueError):
        runtime.bounded(spark.range(4), 3, "numbers")


def test_packed_values_of_any_length(spark):
    long, codes = "x" * 1_000_000, " ".join(["TX"] * 50_000)
    df = spark.createDataFrame([(1, f'"{long}", TX'), (2, '"' + 'a""' * 200_000 + '" ; FL'), (3, codes), (4, "'" + long + "' and 'b'")], "i int, t string")
    got = {r["i"]: [len(x) for x in r["v"]] for r in df.select("i", multivalue.split_values(F.col("t")).alias("v")).collect()}
    assert got == {1: [1_000_000, 2], 2: [400_000, 2], 3: [2] * 50_000, 4: [1_000_000, 1]}


def test_revenue_and_gates(spark):
    df = spark.sql("select 'X' c, 'NEW' t, cast(1.10 as decimal(12,2)) amount union all select 'X', 'odd', 2.00 union all select null, 'NEW', null")
    look = spark.sql("select 'NEW' label, 'NEW' category")
    t = revenue.category_totals(revenue.classify(df, look, "t"), ["c"], ["NEW", "unclassified"])
    assert {tuple(map(str, r)) for r in t.collect()} == {("X", "1.10", "2.00", "3.10"), ("None", "0.00", "0.00", "0.00")}
    rec = revenue.received_totals(df, ["c"])
    assert {(r["c"], r["valid_lines"], r["excluded_lines"], r["received"] is None) for r in rec.collect()} == {("X", 2, 0, False), (None, 0, 1, True)}
    s = spark.createDataFrame([("123-45-6789", "012345678"), ("x", "112345678"), (None, None)], "a string, b string")
    assert {r["column_name"]: r["blocked"] for r in gates.refuse_ssn(gates.column_shares(s, ["a", "b"])).collect()} == {"a": True, "b": True}


def test_mapping():
    syn = {"clients.dob": ["birth date", "born"], "clients.zip": ["postal code"]}
    m = mapping.map_headers(["Birth Dt", "Born", "Zip", "Shoe"], syn, required=["clients.dob", "clients.city"])
    assert m["mapped"] == {"Birth Dt": "clients.dob", "Zip": "clients.zip"} and m["doubles"] == {"Born": "clients.dob"} and m["missing"] == ["clients.city"]
    assert mapping.candidates("Postal Cd", syn)[0][0] == "clients.zip"


def test_mapping_benchmark_and_learning(spark):
    truth = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "z")], "header string, field string")
    got = spark.createDataFrame([("a", "x"), ("b", "q"), ("d", None)], "header string, field string")
    assert tuple(mapping.benchmark(got, truth).first()) == (4, 2, 2, 1, 1)
    df = review(spark, [(1, "s_1", 1, [("Zip", "t.zip", None), ("ZIP ", "t.zip", None)]), (2, "s_1", 2, [("zip", "t.zip", None), ("Nm", "none", None)])])
    assert rows(mapping.learn_synonyms(df)) == [("t.zip", "zip", 2)]
    assert rows(mapping.mapping_conflicts(df)) == [(1, "t.zip", 2)]
    assert {(r["header"], r["field"]) for r in mapping.header_candidates(df).collect()} >= {("zip", "t.zip")}


def test_numbering(spark):
    from ledgerloom.operators import numbering

    df = spark.createDataFrame([(i % 7, f"r{i:03}") for i in range(100)] + [(None, "n")], "a long, b string")
    got = numbering.number_rows(df, ["a", "b"], parts=5).collect()
    want = sorted(((r["a"] is not None, r["a"] or 0, r["b"]) for r in df.collect()))
    assert [(r["a"] is not None, r["a"] or 0, r["b"]) for r in sorted(got, key=lambda r: r["number"])] == want and sorted(r["number"] for r in got) == list(range(1, 102))
    assert numbering.number_rows(df.limit(0), ["a"]).count() == 0
    ids = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 1)], "id string, n long")
    assert rows(numbering.unique_ids(ids, "id", "n")) == [("x", 1), ("x-2", 2), ("y", 1)]


def test_replay(spark):
    from ledgerloom.operators import replay

    notes = spark.createDataFrame([(1, "hospital stay 5"), (2, "hospital stay 7"), (3, "call back"), (4, None), (5, "new surgery")], "rec_id long, notes string")
    known = notes.where("rec_id = 1").select(replay.question_hash(F.regexp_replace("notes", r"\d", "#")).alias("question"), F.lit(0.1).alias("answer"))
    got = {r["rec_id"]: (r["notes"], r["withheld"]) for r in replay.gate_notes(notes, "notes", known).collect()}
    assert got == {1: ("hospital stay 5", False), 2: ("hospital stay 7", False), 3: ("call back", False), 4: (None, False), 5: ("[redacted]", True)}


def test_attach_and_zip_states(spark):
    found = spark.createDataFrame([("c", 1, "R"), ("p", 1, "R"), ("p", 9, "R")], "source string, row_id long, rule_id string")
    c, p = spark.createDataFrame([(1, "NY")], "rec_id long, state string"), spark.createDataFrame([(1, "CA", "X")], "rec_id long, state string, carrier string")
    got = {(r["source"], r["row_id"], r["state"], r["carrier"]) for r in findings.attach_rows(found, {"c": (c, "rec_id"), "p": (p, "rec_id")}, ["state", "carrier"]).collect()}
    assert got == {("c", 1, "NY", None), ("p", 1, "CA", "X"), ("p", 9, None, None)}
    z = spark.createDataFrame([(i, "12345", "NY") for i in range(20)] + [(99, "12399", "CA"), (100, "99999", "CA"), (101, None, "CA")], "rec_id long, zip string, state string")
    assert [r["rec_id"] for r in findings.zip_state_mismatch(z, findings.learn_zip_states(z)).collect()] == [99]


def test_out_of_order(spark):
    df = spark.createDataFrame([("s", 1, T(2024, 1, 2)), ("s", 2, T(2024, 1, 1)), ("t", 1, T(2024, 1, 1))], "scope string, seq long, received_at timestamp_ntz")
    assert rows(versions.out_of_order(df)) == [("s", 2)]
