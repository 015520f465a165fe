"""Numbers as text of fixed width and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, rounded as C does: by its exact binary value, ties to even."""
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def left(x: Column, width: int) -> Column:
    """Filled up with spaces on the right to ``width``; longer texts stay whole."""
    text = x.cast("string")
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))))


def right(x: Column, width: int) -> Column:
    """Filled up with spaces on the left."""
    text = x.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))), text)
