"""Numbers in strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Column) -> Column:
    """A string that reads as a whole number or, within 19 bytes, as a double becomes that number's text; others stay."""
    whole = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))
    real = F.when((F.octet_length(value) <= 19) & value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?$"), F.regexp_replace(value, "[fFdD]$", "").try_cast("double"))
    return F.coalesce(whole.cast("string"), real.cast("string"), value)


def up2(x: Column) -> Column:
    """Two places, away from zero, as a decimal."""
    return (F.signum(x) * F.ceil(F.abs(x.cast("decimal(20,6)")) * 100) / 100).cast("decimal(20,2)")
