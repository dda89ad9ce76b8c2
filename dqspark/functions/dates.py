"""Calendar keys and microsecond positions of date and time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MICROS = 86_400_000_000


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def weekday_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def weekday_number(c: Column) -> Column:
    """0 is Monday, 6 is Sunday."""
    return F.weekday(c)


def year_month(c: Column) -> Column:
    """``2023-01``."""
    return F.date_format(c, "yyyy-MM")


def month_of_number(c: Column) -> Column:
    """1 is January, 12 is December; other numbers have no name."""
    return F.date_format(F.make_date(F.lit(2024), F.when(c.between(1, 12), c).cast("int"), F.lit(1)), "MMMM")


def weekday_of_number(c: Column) -> Column:
    """0 is Monday, 6 is Sunday; other numbers have no name."""
    # the first of January 2024 was a Monday
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.when(c.between(0, 6), c).cast("int")), "EEEE")


def iso_week(c: Column) -> Column:
    """``2023-W05``, with the ISO year of that week."""
    year = F.extract(F.lit("YEAROFWEEK"), c)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


# Month and weekday are all-years keys and carry their calendar position so
# that a result can be put in calendar order.
BUCKETS = {
    "month": (month_name, F.month),
    "year_month": (year_month, None),
    "week": (iso_week, None),
    "weekday": (weekday_name, weekday_number),
    "year": (F.year, None),
    "day": (F.to_date, None),
}


# The same for columns that hold the number already.
NUMBER_BUCKETS = {"month": month_of_number, "weekday": weekday_of_number}


def micros(c: Column, data_type: T.DataType) -> Column:
    """Microseconds since 1970 as bigint; no time-zone shift for zone-less values."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(data_type, T.DateType):
        return F.unix_date(c).cast("bigint") * DAY_MICROS
    seconds = F.extract(F.lit("SECOND"), c)
    return (
        F.unix_date(F.to_date(c)).cast("bigint") * DAY_MICROS
        + F.hour(c).cast("bigint") * 3_600_000_000
        + F.minute(c).cast("bigint") * 60_000_000
        + (seconds * 1_000_000).cast("bigint")
    )


def from_micros(c: Column, data_type: T.DataType) -> Column:
    """Back from microseconds to the given date or time type."""
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(c.cast("bigint"))
    if isinstance(data_type, T.DateType):
        return F.date_from_unix_date(F.floor(c / DAY_MICROS).cast("int"))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    zero = F.lit(0)
    span = F.make_dt_interval(zero, zero, zero, (c.cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)"))
    return epoch + span
