"""Times as microseconds, the same in every session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_micros(interval: str) -> str:
    """SQL of an interval's microseconds."""
    return f"cast(cast(cast({interval} as interval second) as decimal(18, 6)) * 1000000 as bigint)"


def micros(df: DataFrame, at: str) -> Column:
    """Microseconds of a column of times since 1970; those without a zone are counted as they stand."""
    if df.schema[at].dataType.typeName() == "timestamp_ntz":
        return F.expr(interval_micros(f"`{at}` - timestamp_ntz'1970-01-01'"))
    return F.unix_micros(F.col(at))
