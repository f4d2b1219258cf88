"""Date helpers (D-rows). Pure arithmetic / formatting: no dependence on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import ColumnOrName, col


def epoch_ms_to_date(ms: ColumnOrName) -> Column:
    """Epoch milliseconds → calendar date in UTC (integer days since 1970-01-01)."""
    return F.date_from_unix_date(F.floor(col(ms) / 86400000).cast("int"))


def seen_stamp(ts: ColumnOrName) -> Column:
    """D02: 'yyyy-MM-dd HH:mm:ss' text of a timestamp."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def run_stamp(ts: ColumnOrName) -> Column:
    """D02: 'yyyyMMdd_HHmmss' run suffix."""
    return F.date_format(col(ts), "yyyyMMdd_HHmmss")
