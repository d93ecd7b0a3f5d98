"""Dates: differences count the boundaries crossed, and weeks start on the day that is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import Value, col, number

#: Days as counted from Sunday, and the other names of parts.
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
ALIASES = {
    "sql_tsi_year": "year", "sql_tsi_quarter": "quarter", "sql_tsi_month": "month", "sql_tsi_week": "week", "sql_tsi_day": "day",
    "sql_tsi_dayofyear": "day_of_year", "dayofyear": "day_of_year", "dayofweek": "day_of_week", "dayofmonth": "day",
    "sql_tsi_hour": "hour", "sql_tsi_minute": "minute", "sql_tsi_second": "second",
}
_MICROS = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000}


def _part(name: str) -> str:
    return ALIASES.get(name.lower(), name.lower())


def _epoch_day(ts: Column) -> Column:
    return F.unix_date(ts.cast("date"))


def _week_start(ts: Column, first_day: str) -> Column:
    return F.date_sub(ts.cast("date"), F.pmod(F.dayofweek(ts) - 1 - DAYS.index(first_day.lower()), F.lit(7)))


def extract(part: str, ts: Value) -> Column:
    t = col(ts)
    sunday_week = F.floor((F.dayofyear(t) + 6 - (F.dayofweek(t) - 1)) / 7).cast("int")
    return {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
        "day_of_year": F.dayofyear, "day_of_week": F.dayofweek, "iso_week": F.weekofyear,
        "iso_weekday": lambda x: F.weekday(x) + 1,
        "millisecond": lambda x: F.pmod(F.unix_millis(x.cast("timestamp")), F.lit(1000)).cast("int"),
        "week": lambda x: F.when(x.isNotNull(), sunday_week),
        "iso_year": lambda x: F.extract(F.lit("YEAROFWEEK"), x),
    }[_part(part)](t)


def date_add(part: str, n, ts: Value) -> Column:
    """Months and years keep the day, or the month's last."""
    return F.timestamp_add(_part(part).upper().replace("DAY_OF_YEAR", "DAY"), number(n).cast("int"), col(ts))


def date_diff(part: str, start: Value, end: Value, first_day: str = "sunday") -> Column:
    """How many boundaries of the part lie between the two, a bigint; negative if the end comes first."""
    a, b, part = col(start), col(end), _part(part)
    if part in _MICROS:
        unit = F.lit(_MICROS[part])
        return F.floor(F.unix_micros(b.cast("timestamp")) / unit) - F.floor(F.unix_micros(a.cast("timestamp")) / unit)
    place = {
        "year": F.year,
        "quarter": lambda t: F.year(t) * 4 + F.quarter(t),
        "month": lambda t: F.year(t) * 12 + F.month(t),
        "week": lambda t: F.floor((_epoch_day(t) + 4 - DAYS.index(first_day.lower())) / 7),
        "day": _epoch_day,
        "day_of_year": _epoch_day,
    }[part]
    return (place(b) - place(a)).cast("long")


def date_trunc(part: str, ts: Value, first_day: str = "sunday") -> Column:
    """Start of the part; weeks start on ``first_day``."""
    t, part = col(ts), _part(part)
    return _week_start(t, first_day).cast("timestamp") if part == "week" else F.date_trunc("day" if part == "day_of_year" else part, t)


def now() -> Column:
    """One value for the whole query."""
    return F.current_timestamp()


def from_parts(year, month=1, day=1, hour=0, minute=0, second=0) -> Column:
    """Parts beyond their range carry over."""
    start = F.make_timestamp(number(year).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    out = F.timestamp_add("MONTH", (number(month) - 1).cast("int"), start)
    for unit, n in (("DAY", number(day) - 1), ("HOUR", number(hour)), ("MINUTE", number(minute)), ("SECOND", number(second))):
        out = F.timestamp_add(unit, n.cast("int"), out)
    return out


def to_parts(ts: Value) -> Column:
    return F.struct(*(extract(p, ts).alias(p) for p in ("year", "month", "day", "hour", "minute", "second", "millisecond")))


def to_text(ts: Value, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") -> Column:
    return F.date_format(col(ts), pattern)


def from_text(x: Value, pattern: str | None = None) -> Column:
    """NULL where the text is no date."""
    return F.try_to_timestamp(col(x), F.lit(pattern)) if pattern else F.try_to_timestamp(col(x))
