"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the hex digit of the RFC 4122 variant nibble, indexed by the
# original digit 0..f ((x & 0x3) | 0x8).
_VARIANT_FROM = "0123456789abcdef"
_VARIANT_TO = "89ab89ab89ab89ab"

_UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"

# Characters Java's String.isBlank treats as blank (Character.isWhitespace):
# ASCII controls TAB..CR, FS..US and every Unicode space separator except the
# three no-break spaces.
_BLANK_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\p{Z}&&[^\u00A0\u2007\u202F]]"


def name_uuid(text: Column) -> Column:
    """Name-based (version 3) UUID of the UTF-8 bytes of ``text``, no namespace.

    MD5 of the bytes with the version nibble set to 3 and the variant bits set
    to 10, printed in canonical lower-case form.  Null in, null out.  Dashes and
    both nibbles are put in from the right, so that places further left stay.
    """
    digits = F.md5(text.cast("binary"))
    variant = F.translate(F.substring(digits, 17, 1), _VARIANT_FROM, _VARIANT_TO)
    out = F.overlay(digits, F.lit("-"), 21, 0)
    out = F.overlay(out, F.concat(F.lit("-"), variant), 17, 1)
    out = F.overlay(out, F.lit("-3"), 13, 1)
    return F.overlay(out, F.lit("-"), 9, 0)


def is_canonical_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(_UUID_PATTERN), F.lit(False))


_PLAIN_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def all_canonical(texts: list[Column]) -> Column:
    """Aggregate: whether every text that is not null is a canonical lower-case UUID (null where there is none)."""
    plain = [F.coalesce(t.rlike(_PLAIN_UUID), F.lit(True)) for t in texts]
    return F.bool_and(F.array_min(F.array(*plain))) if plain else F.lit(None).cast("boolean")


def pack_uuid(text: Column) -> Column:
    """The 16 bytes of a canonical lower-case UUID; they sort as the texts do."""
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def unpack_uuid(packed: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(packed)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def not_blank(text: Column) -> Column:
    """Not null and not made only of whitespace (Java ``isBlank`` semantics); a visible ASCII character in front settles it."""
    visible = F.substring(text, 1, 1).between("!", "~")
    return F.coalesce(visible | (F.length(F.regexp_replace(text, _BLANK_CLASS, "")) > 0), F.lit(False))


def not_empty(text: Column) -> Column:
    """Not null and not the empty string (the graph's device/ip test)."""
    return F.coalesce(text != F.lit(""), F.lit(False))


def arrival(ingested_at: str = "ingested_at", event_id: str = "event_id") -> Column:
    """Arrival order of an event: ``(ingested_at, event_id)`` ascending."""
    return F.struct(F.col(ingested_at).alias("ts"), F.col(event_id).alias("id"))
