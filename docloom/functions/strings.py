"""Strings: positions count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import Value, col, number, text


def position(needle: Value, haystack: Value) -> Column:
    """Place of the first match, -1 without one. ``needle``: a column, or a string as it is."""
    return F.instr(col(haystack), text(needle)) - 1


def substring(x: Value, start, length=-1) -> Column:
    """From ``start``; a negative length reaches to the end, a negative start is NULL."""
    s, n = number(start), number(length)
    cut = F.substring(col(x), s + 1, F.when(n < 0, F.length(col(x))).otherwise(n))
    return F.when(s >= 0, cut)


def split_part(x: Value, delimiter: str, part: int) -> Column:
    """The part of that number, from 1, or from the right if negative; '' beyond the parts, NULL for an empty delimiter."""
    if delimiter == "":
        return F.lit(None).cast("string")
    if part == 0:
        return F.when(col(x).isNotNull(), F.lit(""))
    return F.split_part(col(x), F.lit(delimiter), F.lit(part))


def like(x: Value, pattern: str, escape: str = "\\", case_sensitive: bool = False) -> Column:
    """SQL LIKE over all lines; upper and lower case are alike unless ``case_sensitive``."""
    name, op = ("like", F.like) if case_sensitive else ("ilike", F.ilike)
    return op(col(x), F.lit(pattern), F.lit(escape)).alias(name)


def trim(x: Value, chars: str = " ", side: str = "both") -> Column:
    """Without the characters of ``chars`` at its start, end or both ('leading', 'trailing', 'both')."""
    return {"leading": F.ltrim, "trailing": F.rtrim, "both": F.btrim}[side](col(x), F.lit(chars))


def replace(x: Value, find: str, by: str) -> Column:
    """All matches; an empty ``find`` changes nothing."""
    return F.replace(col(x), F.lit(find), F.lit(by))


def concat(*parts: Value) -> Column:
    """NULL if any part is."""
    return F.concat(*map(col, parts))


def char_length(x: Value) -> Column:
    return F.char_length(col(x))


def octet_length(x: Value) -> Column:
    return F.octet_length(col(x))


def bit_length(x: Value) -> Column:
    return F.bit_length(col(x))


def upper(x: Value) -> Column:
    return F.upper(col(x))


def lower(x: Value) -> Column:
    return F.lower(col(x))


def compare_case_insensitive(a: Value, b: Value) -> Column:
    """-1, 0 or 1."""
    x, y = F.lower(col(a)), F.lower(col(b))
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def replace_first(x: Value, find: str, by: str) -> Column:
    at = F.instr(col(x), F.lit(find))
    return F.when(at > 0, F.overlay(col(x), F.lit(by), at, F.lit(len(find)))).otherwise(col(x))
