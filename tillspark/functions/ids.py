"""Ids of clients: random UUIDs, shown by their first eight hexadecimal digits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def new_client_id() -> str:
    """Made once, on the driver: a random function in a plan would give other ids when a task is repeated."""
    return str(uuid.uuid4())


def short_id(client_id: Column | str) -> Column:
    """An id without dashes, cut to eight characters."""
    return F.left(F.replace(client_id, F.lit("-")), F.lit(8))
