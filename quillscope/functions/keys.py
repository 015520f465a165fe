"""Normal forms of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIM = r"^\s+|\s+$"


def norm_key(col: Column) -> Column:
    """An identifier as it is compared everywhere: trimmed and in lower case."""
    return F.lower(F.regexp_replace(col, _TRIM, ""))


def pack_key(col: Column) -> Column:
    """A normal identifier in few bytes: 1 and 32 bytes for 64 hex digits, else 0 and its UTF-8."""
    return F.when(col.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"\x01"), F.unhex(col))).otherwise(
        F.concat(F.lit(b"\x00"), F.encode(col, "UTF-8"))
    )


def unpack_key(col: Column) -> Column:
    """Inverse of :func:`pack_key`."""
    body = F.substring(col, 2, 1 << 30)
    return F.when(F.substring(col, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(body))).otherwise(F.decode(body, "UTF-8"))
