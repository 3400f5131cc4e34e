"""Shapes of identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published formats.
_A, _AN = "[AC-HJKMNP-RT-Y]", "[AC-HJKMNP-RT-Y0-9]"
MEDICARE_CARD = rf"^[1-9]{_A}{_AN}[0-9]{_A}{_AN}[0-9]{_A}{_A}[0-9]{{2}}$"
PRODUCER = r"^[1-9][0-9]{0,9}$"
MEDICARE_PLAN = r"^([HRS])(\d{4})-(\d{3})(?:-(\d{1,3}))?$"
MEDIGAP = r"(?i)^(PLAN\s+)?[ABCDFGKLMN](\s+HIGH\s+DEDUCTIBLE)?$"
MARKETPLACE_PLAN = r"^\d{5}[A-Z]{2}\d{7}(-\d{2})?$"
#: Postal codes of the states, the federal district, the territories and free states, and the forces.
STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY "
    "AA AE AP AS FM GU MH MP PR PW VI"
).split()
ZIP = r"^\d{5}(-?\d{4})?$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _t(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_medicare_card(c: Column) -> Column:
    return F.upper(F.replace(_t(c), F.lit("-"), F.lit(""))).rlike(MEDICARE_CARD)


def is_producer_number(c: Column) -> Column:
    return _t(c).rlike(PRODUCER)


def plan_parts(c: Column) -> Column:
    """struct(prefix, contract, plan, segment, kind) of a Medicare plan id, null if it is none; kind is drug or health."""
    t = F.upper(_t(c))
    part = lambda k: F.regexp_extract(t, MEDICARE_PLAN, k)
    segment = F.when(part(4) != "", part(4))
    return F.when(t.rlike(MEDICARE_PLAN), F.struct(
        part(1).alias("prefix"), F.concat(part(1), part(2)).alias("contract"), part(3).alias("plan"), segment.alias("segment"),
        F.when(part(1) == "S", "drug").otherwise("health").alias("kind")))


def is_medigap_letter(c: Column) -> Column:
    return _t(c).rlike(MEDIGAP)


def is_marketplace_plan(c: Column) -> Column:
    return _t(c).rlike(MARKETPLACE_PLAN)


def is_zip(c: Column) -> Column:
    return _t(c).rlike(ZIP)


def zip3(c: Column) -> Column:
    return F.when(is_zip(c), F.substring(_t(c), 1, 3))


def normalize_phone(c: Column) -> Column:
    """Ten digits, without extension and leading 1; null if there are not ten."""
    digits = F.regexp_replace(F.regexp_replace(c, r"(?i)\s*(x|ext\.?)\s*\d+\s*$", ""), r"\D", "")
    ten = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(ten) == 10, ten)


def normalize_email(c: Column) -> Column:
    t = F.lower(_t(c))
    return F.when(t.rlike(EMAIL), t)
