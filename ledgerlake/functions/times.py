"""Epoch milliseconds and integer windows: the same numbers in any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def window_start(ms: str | Column, width: int) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return ms - F.pmod(ms, F.lit(width))
