"""Result lines, the JSON shape of the semester totals, and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .result_file import write_file


def as_lines(df: DataFrame, *columns: str) -> DataFrame:
    """One comma-separated line per row; doubles with six decimals."""
    kinds = dict(df.dtypes)
    parts = [F.format_string("%.6f", c) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]
    return df.select(F.concat_ws(",", *parts).alias("line"))


def semester_json(totals: DataFrame) -> DataFrame:
    """One JSON object per semester: its `store,total` strings in order of the store.

    A semester has a string per store.
    """
    entry = F.concat_ws(",", "store_id", F.format_string("%.6f", "tpv"))
    rows = totals.groupBy("semester").agg(F.array_sort(F.collect_list(F.struct("store_id", entry.alias("line")))).alias("rows"))
    return rows.select("semester", F.to_json(F.map_from_arrays(F.array("semester"), F.array("rows.line"))).alias("json"))


def from_semester_json(rows: DataFrame) -> DataFrame:
    """semester, store_id and tpv from the JSON of ``semester_json``; a text that is no such object has none."""
    found = rows.select(F.explode(F.from_json("json", "map<string, array<string>>")).alias("semester", "_entries"))
    entry = found.select("semester", F.explode("_entries").alias("_entry"))
    fields = F.split("_entry", ",", -1)
    return entry.select("semester", F.get(fields, F.lit(0)).alias("store_id"), F.get(fields, F.lit(1)).try_cast("double").alias("tpv"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Replaces what is at ``path`` by the lines, as text files."""
    lines.select(F.col(lines.columns[0]).alias("value")).write.mode("overwrite").text(path)


def write_results(results: dict[int, DataFrame], folder: str, one_file: bool = False) -> None:
    """Lines of each numbered question to the folder ``folder``/results_q{n}, or the file results_q{n}.txt."""
    if unknown := [n for n in results if n not in (1, 2, 3, 4)]:
        raise ValueError(f"no such question: {unknown}")
    for n, df in results.items():
        if one_file:
            write_file(as_lines(df), f"{folder}/results_q{n}.txt")
        else:
            write_lines(as_lines(df), f"{folder}/results_q{n}")
