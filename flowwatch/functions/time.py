"""Time expressions.  All are epoch based and keep the input's timestamp type
(``timestamp`` or ``timestamp_ntz``), so results do not depend on the zone of
the session that runs them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), ts)


def _late_enough() -> Column:
    # A day after the epoch in every zone: from here on truncating and rounding down are the same.
    return F.lit("1970-01-03 00:00:00").cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, rounded down; costs less than a difference in microseconds."""
    return F.when(ts >= _late_enough(), F.unix_timestamp(ts)).otherwise(F.floor(epoch_micros(ts) / 1_000_000))


def epoch_millis(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", _epoch(), ts)


def shift_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ts)


def tumbling_start(ts: Column, seconds: Column | int) -> Column:
    """Start of the epoch-aligned tumbling window of ``seconds`` holding ``ts``.

    ``seconds`` may be a column, so several rules with different window sizes
    can share one projection and one shuffle.
    """
    width = (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("long") * F.lit(1_000_000)
    return shift_micros(ts, -F.pmod(epoch_micros(ts), width))
