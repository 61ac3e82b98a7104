"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency_ok(currency: Column) -> Column:
    """Three upper-case ASCII letters, whole string (a trailing newline fails)."""
    return F.coalesce(currency.rlike(r"^[A-Z]{3}\z"), F.lit(False))


def sorted_join(values: Column, sep: str = ",") -> Column:
    """Set-valued column as one deterministic string (for reports and checks)."""
    return F.array_join(F.sort_array(values), sep)
