"""Column expressions shared by the operators (all JVM-side, no UDFs)."""

from flowwatch.functions.ids import (
    all_canonical, arrival, is_canonical_uuid, name_uuid, not_blank, not_empty, pack_uuid, unpack_uuid,
)
from flowwatch.functions.time import (
    epoch_micros, epoch_millis, epoch_seconds, shift_micros, tumbling_start,
)
from flowwatch.functions.text import currency_ok, sorted_join

__all__ = [
    "all_canonical", "arrival", "is_canonical_uuid", "name_uuid", "not_blank", "not_empty", "pack_uuid", "unpack_uuid",
    "epoch_micros", "epoch_millis", "epoch_seconds", "shift_micros", "tumbling_start",
    "currency_ok", "sorted_join",
]
