"""Cleaning of ids, dates and times as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ID = ("", "nan", "none", "null")
NO_ROUTE = ("0", "X", "x")


def trimmed(c: Column | str) -> Column:
    """Text without surrounding blanks and tabs."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c.cast("string"), F.lit(" \t"))


def clean_id(c: Column | str) -> Column:
    """Trimmed text without a final ``.0`` after digits only; null where there is no id."""
    t = trimmed(c)
    t = F.when(t.endswith(".0") & t.rlike(r"^[0-9]+\.0\z"), F.left(t, F.length(t) - 2)).otherwise(t)
    return F.when(~F.lower(t).isin(*NO_ID), t)


def clean_route(c: Column | str) -> Column:
    """clean_id for routes, where 0 and X mean that there is none."""
    t = clean_id(c)
    return F.when(~t.isin(*NO_ROUTE), t)


def digits(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def readable_time(c: Column | str) -> Column:
    """YYYYMMDDHHMMSS text of a readable time, else null (14, 12 or 10 digits, real date, 00-23 h)."""
    d = digits(F.regexp_replace(trimmed(c), r"\.0\z", ""))
    t = F.rpad(d, 14, "0")
    real = F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")).isNotNull() & (d >= "0001")
    return F.when(F.length(d).isin(10, 12, 14) & real, t)


def service_day(service_date: Column | str, ride: Column | str) -> Column:
    """The clean service date if it is eight digits, else the first eight digits of the ride time."""
    day = clean_id(service_date)
    first = F.left(digits(ride), F.lit(8))
    return F.when(day.rlike(r"^[0-9]{8}\z"), day).otherwise(F.when(F.length(first) == 8, first))


def text_to_timestamp(c: Column) -> Column:
    """Timestamp without zone of canonical YYYYMMDDHHMMSS text."""
    s = [F.substring(c, a, n) for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    return F.concat(s[0], F.lit("-"), s[1], F.lit("-"), s[2], F.lit(" "), s[3], F.lit(":"), s[4], F.lit(":"), s[5]).try_cast("timestamp_ntz")
