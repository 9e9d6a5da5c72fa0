"""Command line: cleans a folder of text tables and writes the answers.

    python -m tillspark.cli DATA OUT [--from-year 2024 --to-year 2025 ...]
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from .config import Params
from .operators.cleaners import clean
from .plans.questions import run_all
from .shared import fresh_path
from .sources.files import ORDER, scan_lines, selected_tables
from .sources.ingest import ingest
from .sources.schemas import TABLES
from .sources.sinks import write_results


#: Tables in which the last line of an id counts.
SIDES = ("menu", "store", "users")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("data")
    parser.add_argument("out")
    parser.add_argument("--tables", default=",".join(TABLES))
    parser.add_argument("--one-file", action="store_true", help="each result as one file results_q{n}.txt, in a folder that all machines mount")
    for f in fields(Params):
        parser.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    found = vars(parser.parse_args(args))
    data, out, names = found.pop("data"), found.pop("out"), selected_tables(found.pop("tables"))
    one_file = found.pop("one_file")
    params = Params(**found)
    spark = SparkSession.builder.appName("tillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()

    def stage(df: DataFrame) -> DataFrame:
        path = fresh_path(spark, "staged")
        df.write.parquet(path)
        return spark.read.parquet(path)

    if params.bad_rows == "file":
        loaded = {n: ingest(spark, f"{data}/{n}", "", n) for n in names}
        for n, x in loaded.items():
            x.rejects.write.mode("overwrite").json(f"{out}/rejects_{n}")
        tables = {n: x.good if n in SIDES else x.good.drop(ORDER) for n, x in loaded.items()}
    else:
        strict = params.bad_rows == "fail"
        tables = {n: clean(scan_lines(spark, f"{data}/{n}", "", blank=strict, order=n in SIDES), n, params.bad_rows) for n in names}
        if "transactions" in tables:  # several questions read it: parsed once
            tables["transactions"] = stage(tables["transactions"])
    write_results(run_all(tables, params, stage), out, one_file)


if __name__ == "__main__":
    main()
