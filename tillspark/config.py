"""Parameters of the four questions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Years and hours are inclusive.  ``hour_mode``: "compat" lets the last hour's whole minutes and first
    seconds pass (only rows with a minute and a second above zero are out), "strict" ends it on the hour.
    ``bad_rows``: "fail" raises on a line with too few fields, "drop" leaves it out, "file" its whole file."""

    from_year: int = 2024
    to_year: int = 2025
    from_hour: int = 6
    to_hour: int = 23
    min_amount: float = 75.0
    k: int = 3
    hour_mode: str = "compat"
    bad_rows: str = "fail"

    def __post_init__(self) -> None:
        if self.k <= 0:
            raise ValueError("k must be above 0")
        if self.hour_mode not in ("compat", "strict") or self.bad_rows not in ("fail", "drop", "file"):
            raise ValueError("unknown mode")
