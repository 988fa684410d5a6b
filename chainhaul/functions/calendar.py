"""Calendar fields of epoch seconds at a fixed offset; the session time zone plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 7200  # GMT+2, no daylight saving


def local(t: Column) -> Column:
    return t + F.lit(OFFSET)


def day_number(t: Column) -> Column:
    return F.floor(local(t) / 86400).cast("long")


def date_of(t: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(t).cast("int"))


def second_of_day(t: Column) -> Column:
    return F.pmod(local(t), F.lit(86400)).cast("long")


def hour_of(t: Column) -> Column:
    return F.floor(second_of_day(t) / 3600).cast("int")


def day_of_week(t: Column) -> Column:
    """Sunday 1 to Saturday 7; 1970-01-01 was a Thursday."""
    return (F.pmod(day_number(t) + 4, F.lit(7)) + 1).cast("int")


def day_of_year(t: Column) -> Column:
    return F.dayofyear(date_of(t))


def month_key(t: Column) -> Column:
    return F.date_format(date_of(t), "yyyyMM")


def day_type(t: Column, abnormal_days: list[int]) -> Column:
    """The day of the week, or 8 on abnormal days of the year."""
    return F.when(day_of_year(t).isin(*abnormal_days), 8).otherwise(day_of_week(t)) if abnormal_days else day_of_week(t)


def day_type_by_date(t: Column, abnormal_dates: list[str]) -> Column:
    """As day_type, for dates given as YYYY/MM/DD."""
    return F.when(F.date_format(date_of(t), "yyyy/MM/dd").isin(*abnormal_dates), 8).otherwise(day_of_week(t)) if abnormal_dates else day_of_week(t)



def stamp(t: Column) -> Column:
    """yyyyMMdd HH:mm:ss."""
    s = second_of_day(t)
    return F.concat(F.date_format(date_of(t), "yyyyMMdd"), F.format_string(" %02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def parse_stamp(text: Column) -> Column:
    """Epoch seconds of yyyyMMdd HH:mm:ss; null if it isn't one."""
    days = F.datediff(F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")).cast("date"), F.lit("1970-01-01").cast("date"))
    part = lambda at: F.substring(text, at, 2).try_cast("int")
    return days.cast("long") * 86400 + part(10) * 3600 + part(13) * 60 + part(16) - OFFSET


def months(first: str = "201001", last: str = "201405") -> list[str]:
    """Month keys from first to last."""
    a, b = int(first[:4]) * 12 + int(first[4:]) - 1, int(last[:4]) * 12 + int(last[4:])
    return [f"{m // 12}{m % 12 + 1:02d}" for m in range(a, b)]


def surplus_days(seconds: Column) -> Column:
    """Whole days to deduct until at most one day is left."""
    return F.greatest(F.ceil(seconds / 86400) - 1, F.lit(0))
