"""The llm operators as Spark jobs on small tables, with nulls, repeats, empty tables and clashing columns."""

import datetime
import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import abuse_cases  # noqa: E402

from ledgerloom.llm import abuse, address_match, canonical, linkage, mixing, packing, pii, tokens

T = datetime.datetime


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_map_values(spark):
    canon = spark.createDataFrame([(1, "status", "ACTIVE", "Active", ""), (2, "state", "NY", "New York", "")], "canon_id long, field_name string, canon_code string, label string, meaning string")
    df = spark.createDataFrame([(1, "ACTIVE", "ny", "q"), (2, "actve", None, "q"), (3, "", "Mars", "q"), (3, "x" * 9000, "NY", "q")], "rec_id long, status string, state string, typed string")
    got = rows(canonical.map_values(df, canon, "rec_id", ["status", "state"]).select("rec_id", "field_name", "canon_code"))
    assert got == [(1, "state", "NY"), (2, "status", "ACTIVE"), (3, "state", "(none)"), (3, "status", "(none)"), (3, "status", "(none)")]
    assert canonical.map_values(df.limit(0), canon, "rec_id", ["status"]).count() == 0
    assert canonical.map_values(df, canon.limit(0), "rec_id", ["state"]).where("canon_code <> '(none)'").count() == 0


def people(spark, n=400):
    r = random.Random(2)
    syl = ["ka", "lor", "min", "tes", "vo", "ral", "den", "pir", "sum", "wex"]
    word = lambda k: "".join(r.choice(syl) for _ in range(k)).title()
    cl = [(f"C{i}", word(2), word(3), datetime.date(1940 + r.randint(0, 50), r.randint(1, 12), r.randint(1, 28))) for i in range(n)]
    pol = [(i, c[0], "X" if i % 2 else "Y", f"A{i % 20}", f"M{i}") for i, c in enumerate(cl)]
    lines = []
    for i, c in enumerate(cl):
        lines.append((i, f"{c[2].upper()}, {c[1]}", c[3].strftime("%m/%d/%Y"), pol[i][2], pol[i][3], f"M{i}" if i >= 200 else None))
    lines += [(1000 + i, f"{cl[i][1]} {cl[i][2]}", "01/01/1901", pol[i][2], pol[i][3], None) for i in range(30)]  # namesakes
    lines += [(2000, None, None, "X", None, None), (2001, "Nobody Known", None, None, None, None), (0, *lines[0][1:])]
    p = spark.createDataFrame(pol, "rec_id long, client_id string, carrier string, writing_agent_npn string, carrier_member_id string")
    c = spark.createDataFrame(cl, "client_id string, first_name string, last_name string, dob date")
    s = spark.createDataFrame(lines, "line_id long, member_name string, member_dob string, carrier string, agent_npn string, carrier_member_id string").withColumn("policy_ref", F.lit(None).cast("string")).withColumn("sig", F.lit("clash"))
    return s, c, p


def test_linkage(spark):
    s, c, p = people(spark)
    got = linkage.link(s, c, p).collect()
    right = {(r["line_id"], r["client_id"]) for r in got}
    assert len([1 for i, cid in right if cid == f"C{i}"]) >= 195 and not [1 for i, _ in right if i >= 1000]
    assert len([r for r in got if r["line_id"] == 0]) == 2 and all(0.4 <= r["confidence"] <= 1 for r in got)


def test_linkage_filler_dates(spark):
    """A third of both sides bears one birth date: matches are still found by name, and pairs stay few."""
    s, c, p = people(spark, 300)
    filler = F.lit("1900-01-01").cast("date")
    c2 = c.withColumn("dob", F.when(F.substring("client_id", -1, 1).isin("1", "4", "7"), filler).otherwise(F.col("dob")))
    s2 = s.withColumn("member_dob", F.when(F.col("line_id").cast("string").rlike("[147]$") & (F.col("line_id") < 1000), "1900-01-01").otherwise(F.col("member_dob")))
    tagged = linkage.line_people(s2)
    sigs, folk, ctx = linkage._signatures(tagged), linkage.client_people(c2), linkage.contexts(p)
    assert linkage.hot_dates(sigs, folk) == ["1900|1|1"]
    assert linkage.candidate_pairs(sigs, folk, ctx).count() < 1500
    right = [r for r in linkage.link(s2, c2, p).collect() if r["client_id"] == f"C{r['line_id']}"]
    assert len(right) >= 185


def test_linkage_filler_date_and_other_agent(spark):
    """A third of the lines bears a filler date and an agent the client does not have; the clients have true dates."""
    s, c, p = people(spark, 300)
    lost = F.col("line_id").cast("string").rlike("[147]$") & (F.col("line_id") < 200)
    s2 = s.where("line_id < 1000").withColumn("member_dob", F.when(lost, "1900-01-01").otherwise(F.col("member_dob"))).withColumn("agent_npn", F.when(lost, "A99").otherwise(F.col("agent_npn")))
    tagged = linkage.line_people(s2)
    sigs, folk, ctx = linkage._signatures(tagged), linkage.client_people(c), linkage.contexts(p)
    pairs = linkage.candidate_pairs(sigs, folk, ctx).join(tagged, "sig").join(folk, "cid").where(lost & (F.col("client_id") == F.concat(F.lit("C"), "line_id")))
    assert pairs.select("line_id").distinct().count() == s2.where(lost).select("line_id").distinct().count() > 50
    got = linkage.link(s2, c, p).where(lost).collect()
    assert len(got) >= 55 and all(r["client_id"] == f"C{r['line_id']}" for r in got)


def test_linkage_pairs_stay_few(spark):
    """Many people share a birth date and the house account; pairs that show no more than that must not pile up."""
    r = random.Random(5)
    word = lambda k: "".join(r.choice("aeiou") + r.choice("bdfgklmnprstvz") for _ in range(k))
    who = [(f"C{i}", f"k{word(3)}", f"lor{word(4)}", datetime.date(1950 + i % 10, 5, 5)) for i in range(400)]
    c = spark.createDataFrame(who, "client_id string, first_name string, last_name string, dob date")
    p = spark.createDataFrame([(x[0], "X", "A1") for x in who], "client_id string, carrier string, writing_agent_npn string")
    s = spark.createDataFrame([(i, f"{x[2]}, {x[1]}", x[3].isoformat(), "X", "A1", None, None) for i, x in enumerate(who)],
                              "line_id long, member_name string, member_dob string, carrier string, agent_npn string, carrier_member_id string, policy_ref string")
    tagged = linkage.line_people(s)
    sigs, folk, ctx = linkage._signatures(tagged), linkage.client_people(c), linkage.contexts(p)
    pairs = linkage.candidate_pairs(sigs, folk, ctx)
    assert pairs.count() < 2000  # 400 are right; 160,000 share agent, initial and three letters
    own = pairs.join(tagged, "sig").join(folk, "cid").where(F.col("client_id") == F.concat(F.lit("C"), "line_id"))
    assert own.count() == 400


def test_linkage_empty(spark):
    s, c, p = people(spark, 30)
    assert linkage.link(s.limit(0), c, p).count() == 0 and linkage.link(s, c.limit(0), p).count() == 0


def test_same_place(spark):
    a = [(1, "12 N Oak Hill St", "Erie", "PA", "16501"), (2, "12 North Oka Hill", "Erie", None, None), (3, "14 N Oak Hill St", "Erie", "PA", "16501"), (4, "12 S Oak Hill St", "Erie", "PA", "16501"), (5, "12 N Oak Hill Ave", "Erie", "PA", "16501"),
         (6, "12 N Oak Hill St Apt 2", "Erie", "PA", "16501"), (7, "PO Box 7", "Erie", "PA", None), (8, "p.o. box 7, ERIE PA", None, None, None), (9, None, "Erie", "PA", None), (10, "12 N Oak Hill St", "Dover", "DE", "19901"), (11, "nowhere", None, None, None),
         (12, "nowhere", None, None, None), (13, "", "Erie", "PA", None), (1, "12 N Oak Hill St", "Erie", "PA", "16501")]
    df = spark.createDataFrame(a, "rec_id long, address_line1 string, city string, state string, zip string").withColumn("place", F.lit("clash")).withColumn("number", F.lit(1))
    got = {(r["a"], r["b"]) for r in address_match.same_place(df).collect()}
    assert got == {(1, 2), (2, 5), (7, 8)}  # row 2 gives no street type
    assert address_match.same_place(df.limit(0)).count() == 0


def test_pii_rows(spark):
    df = spark.createDataFrame([(1, "cell: 212-555-0100"), (2, None), (3, ""), (4, "Prefers large print."), (5, "mail to a.lee@mail.example " * 60), (1, "cell: 212-555-0100")], "rec_id long, notes string")
    got = rows(pii.mentions(df))
    assert got.count((1, 6, 18, "phone")) == 2 and not [g for g in got if g[0] in (2, 3, 4)]
    assert len([g for g in got if g[0] == 5 and g[3] == "email"]) == 60
    red = {r["rec_id"]: r["redacted"] for r in pii.find(df).collect()}
    assert red[1] == "cell: [PHONE]" and red[3] == "" and red[4] == "Prefers large print." and 2 not in red


def sized(spark, n=300):
    r = random.Random(3)
    rws = [(i, r.choice("abc"), r.choice([0, 1, 5, 20, 90, 700])) for i in range(n)] + [(n, None, 40), (n + 1, "a", None)]
    return spark.createDataFrame(rws, "doc_id long, source string, n_tokens long")


def test_pack_documents(spark):
    docs = sized(spark)
    sizes = spark.createDataFrame([(1, 100), (2, 1000)], "pack_id long, capacity_tokens long")
    for tokens_per_part in (10**9, 2000):
        got = packing.pack_documents(docs, sizes, partition_tokens=tokens_per_part).collect()
        for pid, cap in ((1, 100), (2, 1000)):
            mine = [r for r in got if r["pack_id"] == pid]
            assert sum(r["n_tokens"] for r in mine) == docs.agg(F.sum("n_tokens")).first()[0]
            boxes = {}
            for r in mine:
                boxes[r["container_id"]] = boxes.get(r["container_id"], 0) + r["n_tokens"]
            assert max(boxes.values()) <= cap and all(r["filled"] == boxes[r["container_id"]] for r in mine)
            cut = {}
            for r in mine:
                cut.setdefault(r["doc_id"], []).append(r["n_tokens"])
            whole = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
            assert all((len(v) == 1) == (whole[k] <= cap) and sum(v) == whole[k] for k, v in cut.items())
    assert packing.pack_documents(docs.limit(0), sizes).count() == 0


def test_mix_of_containers_and_deficits_left(spark):
    cols = "pack_id long, capacity_tokens long, container_id string, source string, n_tokens long"
    boxes = spark.createDataFrame([(1, 100, "1-0-0", "a", 80), (1, 100, "1-0-0", "b", 20), (1, 100, "1-1-0", "b", 100)], cols)
    r = packing.fill_report(boxes).first()
    assert (r["containers"], r["tokens"]) == (2, 200) and abs(r["unused_share"]) < 1e-9 and abs(r["mix_off"] - 0.4) < 1e-9
    owed = spark.createDataFrame([(1, p, s, 0.5, o) for p, s, o in ((0, "a", 5.0), (0, "b", -5.0), (1, "a", 9.0), (1, "b", -9.0), (64, "a", 1.0))], "pack_id long, part long, source string, share double, owed double")
    got = {(r["part"], r["source"]): r["owed"] for r in packing.owed_after(boxes, owed).collect()}
    assert got == {(-1, "a"): 25.0, (-1, "b"): -25.0, (-2, "a"): 1.0}


def test_mix(spark):
    docs = sized(spark, 2000)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 1), ("c", 0.3, 3)], "source string, target_share double, max_repeats long")
    m = mixing.mix(docs, targets)
    rep = {r["source"]: r for r in mixing.share_report(m, targets).collect()}
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.02 and r["most_repeats"] <= r["max_repeats"] for r in rep.values())
    small = {r["doc_id"] for r in mixing.mix(docs, targets.where("source <> 'c'").unionByName(spark.createDataFrame([("c", 0.9, 1)], targets.schema))).where("source = 'b'").collect()}
    assert small <= {r["doc_id"] for r in m.where("source = 'b'").collect()}  # a smaller budget is contained in a larger one
    assert mixing.mix(docs.where("source <> 'c'"), targets).count() == 0 and mixing.mix(docs.limit(0), targets).count() == 0


def test_threshold_is_the_most_that_fits(spark):
    docs = sized(spark, 500).where("n_tokens > 0 and source = 'b'").withColumn("h", mixing.document_hash())
    order = sorted((r["h"], r["n_tokens"]) for r in docs.collect())
    for room in (1.0, 77.0, 900.0, 5e9):
        cut = mixing.thresholds(docs, {"b": room})["b"]
        taken = [n for h, n in order if h < cut]
        rest = [n for h, n in order if h >= cut]
        assert sum(taken) <= room and (not rest or sum(taken) + rest[0] > room)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "ab " * 20000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_tokens(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 20000


def test_abuse_on_unseen_wording(spark):
    """Fitted on a table of documents, measured on sentences that no table holds: recall and precision of nine in ten."""
    from ledgerloom.runtime import table

    _, w, bias = abuse.fit(table(spark, "/root/testdata/sf0.1", "documents"))
    scorer = abuse.Scorer(w, bias)
    for bad, good in ((abuse_cases.ABUSIVE, abuse_cases.HARMLESS), (abuse_cases.LATER_ABUSIVE, abuse_cases.LATER_HARMLESS)):
        hit = sum(scorer.text(t) >= abuse.ACCEPT for t in abuse_cases.lines(bad))
        false = sum(scorer.text(t) >= abuse.ACCEPT for t in abuse_cases.lines(good))
        assert hit / len(abuse_cases.lines(bad)) >= 0.9 and hit / (hit + false) >= 0.88


def test_abuse(spark):
    bad = ["you are a stupid moron", "Stop sending this crap, idiot!!", "I will find out where you live", "show me your naked body"]
    good = ["the form is late again", "please send the letter", "This form is idiot-proof", "The screening benefit covers breast exams", "no change since June"]
    docs = [(i, (good + bad)[i % 9] if i % 9 < 5 or i % 4 == 0 else "no change since June", "s") for i in range(900)] + [(9000, None, "s"), (9001, "", None), (9002, "ok " * 20000 + bad[0], "t"), (9002, bad[0], "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("score", F.lit(5))
    got = {(r["doc_id"], r["score"]) for r in abuse.score_documents(df).collect()}
    texts = {d: t for d, t, _ in docs[:900]}
    flagged = {d for d, s in got if s >= 0.5}
    want = {d for d, t in texts.items() if t in bad}
    assert len(got) >= 903 and want <= flagged and not {d for d, t in texts.items() if t in good} & flagged and 9002 in flagged
    assert (9000, 0.0) in got and (9001, 0.0) in got
    assert abuse.score_documents(df.limit(0)).count() == 0
