"""Conversions between types: what cannot be converted is NULL or the ``on_error`` value, NULL is the ``on_null`` value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import Value, col

#: Type names and their other names.
NAMES = {
    "bool": "boolean", "bit": "boolean", "boolean": "boolean", "int": "int", "integer": "int", "smallint": "int", "long": "bigint", "bigint": "bigint",
    "double": "double", "float": "double", "real": "double", "double precision": "double", "decimal": "decimal(38,18)", "dec": "decimal(38,18)", "numeric": "decimal(38,18)",
    "string": "string", "varchar": "string", "char": "string", "character": "string", "timestamp": "timestamp", "bson_date": "timestamp",
}
_NUMBERS = ("int", "bigint", "double", "decimal(38,18)")


def convert(x: Value, source: str, target: str, on_null: Column | None = None, on_error: Column | None = None) -> Column:
    """``x``, of type ``source``, as ``target``.

    A string or a date is a true boolean; doubles lose their fraction as integers and are NULL out of range; dates are
    milliseconds as numbers and ISO text as strings.
    """
    c, a, b = col(x), NAMES[source.lower()], NAMES[target.lower()]
    if a == "timestamp":
        c = c.cast("timestamp")  # also of a column without a time zone
    if a == b:
        out = c
    elif b == "boolean":
        out = c != 0 if a in _NUMBERS else c.isNotNull()
    elif a == "timestamp":
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if b == "string" else F.unix_millis(c).try_cast(b)
    elif b == "timestamp":
        out = F.try_to_timestamp(c) if a == "string" else F.timestamp_millis(c.try_cast("bigint"))
    elif a == "string" and b in ("int", "bigint"):
        out = F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast(b))
    else:
        out = c.try_cast(b)
    if on_error is not None:
        out = F.coalesce(out, F.when(c.isNotNull(), on_error))
    return out if on_null is None else F.when(c.isNull(), on_null).otherwise(out)
