"""Row filters on year, hour, amount and user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Params


def filter_year(df: DataFrame, from_year: int, to_year: int) -> DataFrame:
    """Rows of the years from to to, both included; a half-open range reaches the Parquet scan."""
    at = F.col("created_at")
    return df.where((at >= F.lit(f"{from_year:04d}-01-01").cast("timestamp_ntz")) & (at < F.lit(f"{to_year + 1:04d}-01-01").cast("timestamp_ntz")))


def in_hours(from_hour: int, to_hour: int, mode: str = "compat") -> Column:
    """Whether a row is of the hours from to to; see Params for how the last hour ends."""
    hour, minute, second = F.hour("created_at"), F.minute("created_at"), F.second("created_at")
    late = (minute > 0) & (second > 0) if mode == "compat" else (minute > 0) | (second > 0)
    return hour.between(from_hour, to_hour) & ~((hour == to_hour) & late)


def filter_hour(df: DataFrame, from_hour: int, to_hour: int, mode: str = "compat") -> DataFrame:
    return df.where(in_hours(from_hour, to_hour, mode))


def filter_amount(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("final_amount") >= least)


def known_user() -> Column:
    return F.col("user_id").isNotNull() & (F.col("user_id") != "")


def filter_known_user(df: DataFrame) -> DataFrame:
    return df.where(known_user())


FILTERS: dict[str, Callable[[DataFrame, Params], DataFrame]] = {
    "year": lambda df, p: filter_year(df, p.from_year, p.to_year),
    "hour": lambda df, p: filter_hour(df, p.from_hour, p.to_hour, p.hour_mode),
    "amount": lambda df, p: filter_amount(df, p.min_amount),
    "user": lambda df, p: filter_known_user(df),
}


def apply_filter(df: DataFrame, kind: str, params: Params) -> DataFrame:
    if kind not in FILTERS:
        raise ValueError(f"unknown filter type: {kind}")
    return FILTERS[kind](df, params)
