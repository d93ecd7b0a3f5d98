"""What the function modules take as arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column, or the name of one.
Value = Column | str


def col(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x) -> Column:
    """A column, the name of one, or a number."""
    return F.lit(x) if isinstance(x, int | float) else col(x)


def text(x: Value) -> Column:
    """A column, or a string taken as it is."""
    return F.lit(x) if isinstance(x, str) else x
