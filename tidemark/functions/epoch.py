"""Conversion of zone-free timestamps. Nothing here depends on the session's time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a ``timestamp_ntz``, by interval arithmetic."""
    gap = ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), gap)
    whole = part("DAY").cast("bigint") * 86_400 + part("HOUR").cast("bigint") * 3_600 + part("MINUTE").cast("bigint") * 60
    return whole * 1_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def timestamp_micros(ts: Column, unit_micros: int) -> Column:
    """``epoch_micros`` in whole units, rounded down also before 1970; no step goes through a double."""
    x = epoch_micros(ts)
    return ((x - F.pmod(x, F.lit(unit_micros))).cast("decimal(20,0)") / unit_micros).cast("bigint")
