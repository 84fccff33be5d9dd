"""Rounding rules and numbers that stand for something else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Ties go to the even neighbour, as decimal text shows them."""
    return F.bround(col(c).cast("double"), digits)


def half_away(c: Column | str, digits: int = 3) -> Column:
    """Ties go away from zero, in exact decimals, as a database's numeric type rounds."""
    return F.round(col(c).cast("decimal(38,18)"), digits).cast("double")


def whole(c: Column | str) -> Column:
    """The nearest whole number, ties to the even one."""
    return F.bround(col(c).cast("double")).cast("int")


def zero_as_missing(c: Column | str) -> Column:
    """For parity with code that takes 0 for "no value"; use the column itself where 0 is a value."""
    return F.nullif(col(c), F.lit(0))
