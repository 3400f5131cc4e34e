"""Amounts of money as exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LIMIT = 10_000_000_000


def _digits(c: Column) -> Column:
    """The text without blanks, currency sign and thousands commas; brackets as a minus sign."""
    bare = F.regexp_replace(c, r"[\s$,]", "")
    return F.when(bare.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(bare, r"[()]", ""))).otherwise(bare)


def parse_money(c: Column) -> Column:
    """struct(value decimal(12,2), problem): rounded half up to cents. problem is BLANK, NOT_A_NUMBER (also for ten
    billion and beyond) or null."""
    t = _digits(c)
    number = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    fits = number.isNotNull() & (F.abs(number) < LIMIT)
    exact = F.when(fits, t.try_cast("decimal(38,10)"))
    blank = c.isNull() | (t == "")
    return F.struct(
        F.round(exact, 2).try_cast(MONEY).alias("value"),
        F.when(blank, "BLANK").when(~fits | exact.isNull(), "NOT_A_NUMBER").alias("problem"),
    )


def is_exact_cents(c: Column) -> Column:
    """Plain decimal text with at most ten digits before and two after the point."""
    return c.rlike(r"^-?\d{1,10}(\.\d{1,2})?$")


def shown(c: Column) -> Column:
    """Money for people: $1,234.50, with a minus sign in front."""
    return F.when(c < 0, F.concat(F.lit("-$"), F.format_number(-c, 2))).otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))
