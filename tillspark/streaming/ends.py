"""Groups of a client that are given out when its input ends.

Rows and end marks of many clients come on one stream.  State is kept per client and share of its groups; at a
client's end mark its groups are given out and deleted, while other clients go on.  Groups are dealt to
``SHARES`` by their keys, so that a client with most of the rows doesn't land in one task; an end mark goes to
all of them.

A mark must not come in an earlier batch than its client's rows; within a batch their order doesn't matter.
What comes after the mark starts the client anew.  A client without rows gives nothing at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

SHARES = 16
_KIND = DecimalType(38, 10)


def end_marks(clients: DataFrame, like: DataFrame) -> DataFrame:
    """A mark for each client_id of ``clients``, with the columns of the rows ``like``."""
    rest = [F.lit(None).cast(t).alias(c) for c, t in like.dtypes if c not in ("client_id", "is_end")]
    return clients.select("client_id", *rest, F.lit(True).alias("is_end")).select(like.columns)


class _Groups(StatefulProcessor):
    """Sums of a client's groups in one share; sums are exact decimals."""

    def __init__(self, keys: list[str], sums: list[str]) -> None:
        self.keys, self.sums = keys, sums

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType([StructField(k, StringType()) for k in self.keys])
        self.groups = handle.getMapState("groups", key, StructType([StructField(s, _KIND) for s in self.sums]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ended = False
        for batch in rows:
            ended |= bool(batch["is_end"].any())
            found = batch[~batch["is_end"].astype(bool)]
            for group, part in found.groupby(self.keys, dropna=False, sort=False):
                group = tuple(None if pd.isna(g) else g for g in group)
                old = self.groups.getValue(group) if self.groups.containsKey(group) else [Decimal(0)] * len(self.sums)
                self.groups.updateValue(group, tuple(o + sum(part[s], Decimal(0)) for o, s in zip(old, self.sums, strict=True)))
        if ended:
            given = [(key[0], *group, *sums) for group, sums in self.groups.iterator()]
            self.groups.clear()
            if given:
                yield pd.DataFrame(given, columns=["client_id", *self.keys, *self.sums])

    def close(self) -> None:
        pass


def groups_at_end(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """client_id, ``keys`` and the totals of ``sums`` of each client whose end mark came (``is_end``).

    ``rows`` is a stream in a session that ``state_session`` made.  Keys are strings, sums decimals; a row with a
    null among the sums doesn't count.
    """
    whole = F.col("is_end")
    for s in sums:
        whole = whole | F.col(s).isNotNull()
    share = F.when(F.col("is_end"), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.pmod(F.hash(*keys), F.lit(SHARES))))
    dealt = rows.where(whole).select("client_id", *(F.col(k).cast("string").alias(k) for k in keys), *(F.col(s).cast(_KIND).alias(s) for s in sums), "is_end", F.explode(share).alias("_share"))
    schema = StructType([StructField("client_id", StringType()), *(StructField(k, StringType()) for k in keys), *(StructField(s, _KIND) for s in sums)])
    return dealt.groupBy("client_id", "_share").transformWithStateInPandas(_Groups(keys, sums), schema, "Append", "None")
