"""Lenient parsing of text fields: null where a field doesn't parse as a whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_long(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(bare.rlike("^[+-]?[0-9]+$"), bare.try_cast("bigint"))


def to_double(text: Column) -> Column:
    """Digits only: Java's suffixes (`75d`) are no numbers here."""
    bare = F.trim(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def to_timestamp(text: Column) -> Column:
    """A date and a time with a space between; a date or a year alone is no timestamp."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), text.try_cast("timestamp_ntz"))


def before_point(text: Column) -> Column:
    """`123.0` as `123`; blank as null."""
    return F.nullif(F.element_at(F.split(text, r"\."), 1), F.lit(""))


def split_first(text: Column | str, parts: int = 2, by: str = ",") -> Column:
    """At most ``parts`` pieces of a text; the last one keeps the separators that are left."""
    if parts < 1:
        raise ValueError("parts must be above 0")
    return F.split(text, "[" + by + "]", parts)


def total(amount: Column) -> Column:
    """The sum of amounts (double) as a double.

    Amounts are added as decimals, so that the order of rows doesn't matter; those that no decimal of ten
    places holds (1e18 and more, not a number) are added apart.
    """
    exact = amount.try_cast("decimal(28,10)")
    rest = F.when(exact.isNull(), amount)
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(rest), F.lit(0.0))
