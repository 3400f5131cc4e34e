"""Dates, statement periods and ages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit years from the pivot on are 19xx; spreadsheet serials count from day zero.
PIVOT = 30
SERIAL_FROM, SERIAL_TO, DAY_ZERO = 20000, 60000, "1899-12-30"
COMPACT_FROM, COMPACT_TO = 1900, 2099
_MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date of three number texts, null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _full_year(y: Column) -> Column:
    return F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(y.try_cast("int") >= PIVOT, "19").otherwise("20"), y))


def parse_date_loose(c: Column) -> Column:
    """Eight digits as year month day (1900 to 2099), other digits as a spreadsheet serial, ISO with or without a
    time, month/day/year, and day-Mon-year; anything else, and impossible days, give null."""
    t = _strip(c)
    part = lambda rx, k: F.regexp_extract(t, rx, k)
    us, mon, iso = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4}|\d{2})$", r"^(\d{4})-(\d{2})-(\d{2})(?:[T ][0-9:.]+)?$"
    number = t.try_cast("bigint")
    month = F.array_position(F.lit(_MONTHS), F.upper(part(mon, 2))).cast("string")
    return (
        F.when(t.rlike(r"^\d{8}$"), F.when(F.substring(t, 1, 4).try_cast("int").between(COMPACT_FROM, COMPACT_TO), F.try_to_date(t, "yyyyMMdd")))
        .when(t.rlike(r"^\d+$"), F.when(number.between(SERIAL_FROM, SERIAL_TO), F.date_add(F.lit(DAY_ZERO).cast("date"), number.try_cast("int"))))
        .when(t.rlike(iso), _day(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(us), _day(_full_year(part(us, 3)), part(us, 1), part(us, 2)))
        .when(t.rlike(mon) & (month != "0"), _day(_full_year(part(mon, 3)), month, part(mon, 1)))
    )


def statement_period(c: Column, keep: bool = False) -> Column:
    """YYYY-MM of 'YYYY-M' or any loose date; else null, or the input itself if keep is set."""
    t = _strip(c)
    rx = r"^(\d{4})-(\d{1,2})$"
    m = F.regexp_extract(t, rx, 2)
    short = F.when(t.rlike(rx) & m.try_cast("int").between(1, 12), F.concat(F.substring(t, 1, 5), F.lpad(m, 2, "0")))
    out = F.coalesce(short, F.date_format(parse_date_loose(t), "yyyy-MM"))
    return F.coalesce(out, c) if keep else out


def is_strict_period(c: Column) -> Column:
    return c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$") & ~c.startswith("0000")


def age_on(born: Column, day: Column) -> Column:
    """Whole years lived; a birthday on 29 February counts from 1 March in other years."""
    before = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(born), F.dayofmonth(born))
    return F.year(day) - F.year(born) - before.cast("int")


def months_between(start: Column, end: Column) -> Column:
    """Difference of calendar months, whatever the days."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def sql_date_loose(c: str) -> str:
    """parse_date_loose as DuckDB SQL, for checks."""
    t = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    g = lambda rx, k: f"regexp_extract({t}, '{rx}', {k})"
    year = lambda y: f"(CASE WHEN length({y}) = 4 THEN {y} WHEN CAST({y} AS INT) >= {PIVOT} THEN '19' || {y} ELSE '20' || {y} END)"
    us, mon, iso = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4}|\d{2})$", r"^(\d{4})-(\d{2})-(\d{2})(?:[T ][0-9:.]+)?$"
    names = "[" + ", ".join(f"'{m}'" for m in _MONTHS) + "]"
    day = lambda y, m, d: f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
    return rf"""(CASE
      WHEN regexp_full_match({t}, '\d{{8}}') THEN CASE WHEN CAST(substr({t}, 1, 4) AS INT) BETWEEN {COMPACT_FROM} AND {COMPACT_TO} THEN {day(f"substr({t}, 1, 4)", f"substr({t}, 5, 2)", f"substr({t}, 7, 2)")} END
      WHEN regexp_full_match({t}, '\d+') THEN CASE WHEN TRY_CAST({t} AS BIGINT) BETWEEN {SERIAL_FROM} AND {SERIAL_TO} THEN DATE '{DAY_ZERO}' + TRY_CAST({t} AS INT) END
      WHEN regexp_matches({t}, '{iso}') THEN {day(g(iso, 1), g(iso, 2), g(iso, 3))}
      WHEN regexp_matches({t}, '{us}') THEN {day(year(g(us, 3)), g(us, 1), g(us, 2))}
      WHEN regexp_matches({t}, '{mon}') THEN {day(year(g(mon, 3)), f"CAST(list_position({names}, upper({g(mon, 2)})) AS VARCHAR)", g(mon, 1))}
    END)"""


def strict_timestamp(c: Column) -> Column:
    """The moment of an ISO text with seconds and a zone; anything else, a text without a zone too, is null."""
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
    return F.when(ok, F.try_to_timestamp(c))
