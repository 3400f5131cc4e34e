"""Column expressions against plain Python restatements and edge values."""

import datetime
import decimal
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import dates, identifiers, money, redaction, text
from ledgerloom.functions.treedist import Node, assignment, edit_script


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def plain_date(s):
    s = (s or "").strip()
    full = lambda y: int(y) if len(y) == 4 else (1900 if int(y) >= 30 else 2000) + int(y)
    try:
        if re.fullmatch(r"\d{8}", s):
            d = datetime.date(int(s[:4]), int(s[4:6]), int(s[6:]))
            return d if 1900 <= d.year <= 2099 else None
        if re.fullmatch(r"\d+", s):
            return datetime.date(1899, 12, 30) + datetime.timedelta(int(s)) if 20000 <= int(s) <= 60000 else None
        if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})(?:[T ][\d:.]+)?", s):
            return datetime.date(*map(int, m.groups()))
        if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", s):
            return datetime.date(full(m[3]), int(m[1]), int(m[2]))
        if m := re.fullmatch(r"(\d{1,2})-([A-Za-z]{3})-(\d{4}|\d{2})", s):
            return datetime.date(full(m[3]), "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC".index(m[2].upper()) // 3 + 1, int(m[1]))
    except ValueError:
        pass
    return None


DATES = ["2024-02-29", "2023-02-29", "20240229", "18991231", "21000101", "20000", "19999", "60000", "60001", "5/1/29", "5/1/30", "13/1/2020", "1/13/2020", "07-Mar-56", "31-FEB-2020", "07-Foo-2020",
         "2024-05-06T10:11:12", "2024-5-6", "", "  3/4/1999 ", None, "abc", "0/0/0000", "99999999999999999999"]


def test_dates_edges(spark):
    assert values(spark, dates.parse_date_loose, DATES) == [plain_date(x) for x in DATES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(
    st.from_regex(r"\A\d{1,2}/\d{1,2}/(\d{2}|\d{4})\Z"), st.from_regex(r"\A[12]\d{7}\Z"), st.from_regex(r"\A[2-6]\d{4}\Z"), st.from_regex(r"\A[0-3]\d-(Jan|Feb|Sep|Dec)-(\d{2}|\d{4})\Z"), st.from_regex(r"\A\d{4}-[01]\d-[0-3]\d\Z")), min_size=30, max_size=60))
def test_dates_property(spark, xs):
    xs = [x for x in xs if x.isascii() and not x.endswith("/0000") and not re.search(r"(^|-)0000", x)]
    assert values(spark, dates.parse_date_loose, xs) == [plain_date(x) for x in xs]


def test_periods_and_ages(spark):
    assert values(spark, dates.statement_period, ["2024-3", "2024-13", "3/5/2024", "x", None]) == ["2024-03", None, "2024-03", None, None]
    assert values(spark, lambda c: dates.statement_period(c, keep=True), ["x"]) == ["x"]
    assert values(spark, dates.is_strict_period, ["2024-01", "0000-01", "2024-13"]) == [True, False, False]
    born = lambda c: dates.age_on(c.cast("date"), F.lit("2023-02-28").cast("date"))
    assert values(spark, born, ["2000-02-29", "2000-02-28"]) == [22, 23]


def test_money(spark):
    got = values(spark, money.parse_money, ["$1,234.50", "(3.005)", "", None, "abc", "1e3", "10000000000", "-.5", "61.055", "1,2,3"])
    assert [(r["value"], r["problem"]) for r in got] == [
        (decimal.Decimal("1234.50"), None), (decimal.Decimal("-3.01"), None), (None, "BLANK"), (None, "BLANK"), (None, "NOT_A_NUMBER"), (decimal.Decimal("1000.00"), None),
        (None, "NOT_A_NUMBER"), (decimal.Decimal("-0.50"), None), (decimal.Decimal("61.06"), None), (decimal.Decimal("123.00"), None)]
    assert values(spark, money.is_exact_cents, ["1.23", "1.234", "12345678901", "-0.1"]) == [True, False, False, True]


def test_text(spark):
    assert values(spark, text.name_key, ["O'Neil, Ann", "Peña", None]) == ["oneilann", "pea", None]
    assert values(spark, text.normalize_name, ["John O'Neil Jr.", "Jr", "José  de-la Cruz III"]) == ["john oneil", "jr", "josé de la cruz"]
    assert values(spark, text.split_list, ["fl, GA|tx;;", "", None]) == [["FL", "GA", "TX"], [], None]
    assert values(spark, text.mask, ["ab", "abcdef", "x" * 40, "a-b 12"]) == ["**", "ab****", "xx" + "*" * 30 + "...", "a-* **"]
    assert values(spark, text.shape, ["Ab-12", None]) == ["AA-99", None]
    assert values(spark, text.formula_guard, ["=1+1", " @x", "\tx", "x=1", None]) == ["'=1+1", "' @x", "'\tx", "x=1", None]
    assert text.normalize_header("MbrDOB #") == "member dob number" and text.normalize_header("Éff Dt") == "effective date"
    assert text.format_fingerprint([" A", "b"]) == text.format_fingerprint(["a", "B "])


def test_identifiers(spark):
    assert values(spark, identifiers.is_medicare_card, ["1EG4-TE5-MK73", "1eg4te5mk73", "0EG4TE5MK73", "1SG4TE5MK73", None]) == [True, True, False, False, None]
    p = values(spark, identifiers.plan_parts, ["H1234-001-02", "S5678-123", "X1234-001", "h0001-111"])
    assert [(x["contract"], x["plan"], x["segment"], x["kind"]) if x else None for x in p] == [("H1234", "001", "02", "health"), ("S5678", "123", None, "drug"), None, ("H0001", "111", None, "health")]
    assert values(spark, identifiers.normalize_phone, ["(212) 555-0100 x9", "1-212-555-0100", "555-0100", None]) == ["2125550100", "2125550100", None, None]
    assert values(spark, identifiers.zip3, ["12345", "12345-6789", "123456789", "1234"]) == ["123", "123", "123", None]
    assert values(spark, identifiers.is_medigap_letter, ["Plan G", "g", "Plan Z", "F high deductible"]) == [True, True, False, True]
    assert values(spark, identifiers.is_marketplace_plan, ["12345TX1234567-01", "12345TX123"]) == [True, False]


def test_redaction(spark):
    def red(*texts):
        return [(r["text"], "|".join(r["kinds"])) for r in values(spark, redaction.redact, list(texts))]

    assert red("ssn 123-45-6789, cell 212-555-0100") == [("ssn [REDACTED:ssn], cell [REDACTED:phone]", "phone|ssn")]
    assert red("Spouse Ann Lee, dob 1/2/1950, member id A1234567 mail a.b@c.org") == [
        ("Spouse [REDACTED:name], dob [REDACTED:dob], member id [REDACTED:member_id] mail [REDACTED:email]", "dob|email|member_id|name")]
    assert red("", "nothing here", None) == [("", ""), ("nothing here", ""), (None, "")]
    # cards and routing numbers carry a check; one digit off is neither
    assert red("pay 4111 1111 1111 1111 now")[0][1] == "card" and red("pay 4111 1111 1111 1112 now")[0][1] == ""
    assert red("ABA 021000021.")[0][0] == "ABA [REDACTED:account]." and values(spark, redaction.routing_ok, ["021000021", "021000022"]) == [True, False]
    assert values(spark, redaction.luhn_ok, ["4111111111111111", "4111111111111112", "79927398713"]) == [True, False, True]
    assert red("new card 1EG4-TE5-MK73")[0][0] == "new card [REDACTED:medicare_id]" and red("1SG4TE5MK73")[0][1] == ""
    long = "x " * 200_000 + "a@b.org"
    assert red(long)[0][0].endswith("[REDACTED:email]")


def test_label_refusal(spark):
    assert values(spark, redaction.flagged, ["Renewal", "takes lisinopril 10 mg", "paid 3/4/2024", "has diabetes", "ann@x.org", None, ""]) == [False, True, True, True, True, False, False]


def brute_cost(a, b):
    """Least cost over all pairings of two flat forests, renaming at 1.5, add and delete at 1."""
    import itertools

    best = 1e9
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    for k in range(len(small) + 1):
        for pick in itertools.combinations(range(len(small)), k):
            for to in itertools.permutations(range(len(large)), k):
                cost = sum(0 if small[i] == large[j] else 1.5 for i, j in zip(pick, to)) + len(small) + len(large) - 2 * k
                best = min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=4, unique=True), st.lists(st.sampled_from("abcdef"), max_size=4, unique=True))
def test_tree_edit_distance(a, b):
    tree = lambda xs: Node("", [Node(x, [], i) for i, x in enumerate(xs)])
    cost, ops = edit_script(tree(a), tree(b), lambda x, y: 0.0 if x.label == y.label else 1.5)
    assert cost == brute_cost(a, b)
    assert sum(o[0] == "delete" for o in ops) + sum(o[0] == "rename" for o in ops) == len(set(a) - set(b))


def brute_tree(a, b, price):
    """Least cost over every mapping of nodes that keeps ancestors (roots mapped to each other), node by node."""
    def walk(n, up=()):
        yield n, up
        for c in n.children:
            yield from walk(c, (*up, id(n)))

    xs, ys = list(walk(a))[1:], list(walk(b))[1:]

    def go(i, used, pairs):
        if i == len(xs):
            return len(ys) - len(used)
        x, ux = xs[i]
        best = 1 + go(i + 1, used, pairs)
        for j, (y, uy) in enumerate(ys):
            if j not in used and all((id(p) in ux) == (id(q) in uy) and (id(x) in up_p) == (id(y) in up_q) for p, up_p, q, up_q in pairs):
                best = min(best, price(x, y) + go(i + 1, used | {j}, [*pairs, (x, ux, y, uy)]))
        return best

    return price(a, b) + go(0, frozenset(), [])


_trees = st.recursive(st.sampled_from("abc").map(lambda x: Node(x)), lambda kids: st.builds(lambda x, k: Node(x, k), st.sampled_from("abc"), st.lists(kids, min_size=1, max_size=2)), max_leaves=3)


@settings(max_examples=120, deadline=None)
@given(st.lists(_trees, max_size=2), st.lists(_trees, max_size=2), st.sampled_from([0.5, 1.5]))
def test_tree_edit_equals_brute_force(a, b, price):
    """Trees up to depth four; the script's own cost, moves taken apart, is the least there is."""
    def copy(n):  # shared nodes would be one node twice
        return Node(n.label, [copy(c) for c in n.children])

    x, y = copy(Node("r", a)), copy(Node("r", b))
    charge = lambda p, q: 0.0 if p.label == q.label else price
    cost, ops = edit_script(x, y, charge)
    moved = sum(p.weight() + q.weight() - 1 for k, p, q in ops if k == "move")
    assert abs(cost + moved - brute_tree(x, y, charge)) < 1e-9
    assert abs(cost - sum(1 if k in ("delete", "add", "move") else charge(p, q) for k, p, q in ops)) < 1e-9


def test_tree_edit_nested_and_assignment():
    a = Node("r", [Node("x", [Node("y"), Node("z")])])
    b = Node("r", [Node("x", [Node("z")])])
    price = lambda p, q: 0.0 if p.label == q.label else 1.5
    assert edit_script(a, b, price)[0] == 1
    assert edit_script(a, Node("r", [Node("y")]), price)[0] == 2  # x and z go, y moves up
    flat = edit_script(Node("r", [Node("s", [Node("a"), Node("b")]), Node("c")]), Node("r", [Node("a"), Node("b"), Node("c")]), price)
    assert flat[0] == 1 and [(k, p.label) for k, p, _ in flat[1] if k == "delete"] == [("delete", "s")]
    two = edit_script(Node("r", [Node("p", [Node("m", [Node("n")]), Node("q")]), Node("t", [Node("u")])]), Node("r", [Node("p", [Node("q")]), Node("t", [Node("u"), Node("m", [Node("n")])])]), price)
    assert two[0] == 1 and [(k, p.label) for k, p, _ in two[1] if k == "move"] == [("move", "m")]
    assert assignment([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]


def test_timestamps_and_presentation(spark):
    got = values(spark, lambda c: dates.strict_timestamp(c).isNotNull(), ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02T03:04:05.123+02:00", "2024-13-02T03:04:05Z", "2024-01-02", None])
    assert got == [True, False, True, False, False, False]
    assert values(spark, lambda c: money.shown(c.cast("decimal(12,2)")), ["1234.5", "-3", None]) == ["$1,234.50", "-$3.00", None]
