"""Three-valued logic on nullable booleans: NULL is unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tri_and(*parts: Column) -> Column:
    """False if any part is false, else unknown if any is unknown, else true."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tri_or(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def tri_all(part: Column) -> Column:
    """``tri_and`` over the rows of a group; SQL's own aggregate would pass over unknowns."""
    return F.when(F.bool_or(~part), False).when(F.count(part) < F.count(F.lit(1)), F.lit(None).cast("boolean")).otherwise(True)


def tri_any(part: Column) -> Column:
    return F.when(F.bool_or(part), True).when(F.count(part) < F.count(F.lit(1)), F.lit(None).cast("boolean")).otherwise(False)


def tri_name(part: Column) -> Column:
    return F.when(part.isNull(), "UNKNOWN").when(part, "TRUE").otherwise("FALSE")
