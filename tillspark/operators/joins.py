"""Lookups of names and birthdates by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import ORDER


def last_wins(side: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One row per trimmed key with its trimmed value: the one that comes last by ``order`` (else by the place
    of its line, else the largest value)."""
    order = order or (ORDER if ORDER in side.columns else None)
    rows = side.select(F.trim(key).alias(key), F.trim(value).alias(value), *([order] if order else []))
    best = F.max_by(value, order) if order else F.max(value)
    return rows.groupBy(key).agg(best.alias(value))


def name_lookup(left: DataFrame, side: DataFrame, key: str, name: str, order: str | None = None) -> DataFrame:
    """``left`` with ``key`` replaced by the side table's name, in its place; rows without a name go."""
    found = left.withColumn(key, F.trim(key)).join(last_wins(side, key, name, order), key).where(F.col(name) != "")
    return found.select(*(name if c == key else c for c in left.columns))


def passthrough_lookup(left: DataFrame, side: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """``left`` with ``key`` replaced by the side table's value where there is one, as column ``value``.

    A key that has a value's form already (it holds a dash) stays.  The side table may be large: it is cut
    to the keys of ``left`` before it is reduced.
    """
    wanted = left.select(F.trim(key).alias(key)).distinct()
    values = last_wins(side.withColumn(key, F.trim(key)).join(wanted, key, "left_semi"), key, value, order)
    found = left.withColumn("_key", F.trim(key)).join(values.withColumnRenamed(key, "_key"), "_key", "left")
    shown = F.when(F.contains(F.col(key), F.lit("-")), F.col(key)).otherwise(F.coalesce(value, key))
    return found.select(*(shown.alias(value) if c == key else c for c in left.columns))


def join_items(left: DataFrame, menu: DataFrame) -> DataFrame:
    return name_lookup(left, menu, "item_id", "item_name")


def join_stores(left: DataFrame, stores: DataFrame) -> DataFrame:
    return name_lookup(left, stores, "store_id", "store_name")


def join_users(left: DataFrame, users: DataFrame) -> DataFrame:
    return passthrough_lookup(left, users, "user_id", "birthdate")


JOINS = {"items": join_items, "store": join_stores, "users": join_users}


def lookup(left: DataFrame, side: DataFrame, kind: str) -> DataFrame:
    if kind not in JOINS:
        raise ValueError(f"unknown join type: {kind}")
    return JOINS[kind](left, side)
