"""From raw lines to cleaned, typed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import before_point, to_double, to_long, to_timestamp
from ..sources.files import ORDER
from ..sources.schemas import LEAST_FIELDS


def _transactions(f: Callable[[int], Column]) -> list[Column]:
    return [f(0).alias("transaction_id"), f(1).alias("store_id"), before_point(f(4)).alias("user_id"), to_double(f(7)).alias("final_amount"), to_timestamp(f(8)).alias("created_at")]


def _items(f: Callable[[int], Column]) -> list[Column]:
    return [f(1).alias("item_id"), to_long(f(2)).alias("quantity"), to_double(f(4)).alias("subtotal"), to_timestamp(f(5)).alias("created_at")]


COLUMNS: dict[str, Callable[[Callable[[int], Column]], list[Column]]] = {
    "transactions": _transactions,
    "transaction_items": _items,
    "menu": lambda f: [f(0).alias("item_id"), f(1).alias("item_name")],
    "store": lambda f: [f(0).alias("store_id"), f(1).alias("store_name")],
    "users": lambda f: [f(0).alias("user_id"), f(2).alias("birthdate")],
}


def clean(lines: DataFrame, table: str, bad_rows: str = "fail") -> DataFrame:
    """The columns of ``table`` that are used, from ``lines`` (value).

    Fields behind the known ones are ignored; a line with too few raises, or is left out if ``bad_rows`` is
    "drop".  A table without a cleaner passes as it is.  The lines' place, if they have one, is kept.
    """
    if table not in COLUMNS:
        return lines
    least = LEAST_FIELDS[table]
    place = [ORDER] if ORDER in lines.columns else []
    fields = lines.select(F.split("value", ",", -1).alias("_f"), *place)
    enough = F.size("_f") >= least
    if bad_rows == "drop":
        fields = fields.where(enough)
    else:
        failed = F.raise_error(F.concat(F.lit(f"{table}: a line has under {least} fields: "), F.concat_ws(",", "_f")))
        fields = fields.select(F.when(enough, F.col("_f")).otherwise(failed).alias("_f"), *place)
    return fields.select(*COLUMNS[table](lambda i: F.get("_f", F.lit(i))), *place)
