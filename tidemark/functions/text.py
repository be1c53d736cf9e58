"""Column expressions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def entity_key(c: Column) -> Column:
    """Letter case and outer blanks aside; what is empty then counts as null."""
    key = F.upper(trimmed(c))
    return F.when(key != "", key)
