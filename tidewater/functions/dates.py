"""Dates of articles, and the 14-day calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = 14


def parse_pub_date(text: Column) -> Column:
    """The calendar date as written, in its own zone, as yyyy-MM-dd; the first such string as a last resort, unchecked; else ''.

    The zone is cut off before parsing, so that the day never moves.
    """
    text = F.trim(text)
    local = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    local = F.regexp_replace(local, "( [A-Z]{3,4}| [+-][0-9]{4})$", "")
    local = F.regexp_replace(local, "^([0-9]{4}-[0-9]{2}-[0-9]{2})T[0-9:]{8}(\\.[0-9]{1,6})?(Z|[+-][0-9]{2}:?[0-9]{2})?$", "$1")
    tries = [F.try_to_timestamp(local, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss", "yyyy-M-d", "d/M/yyyy", "d MMMM yyyy", "d MMM yyyy")]
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), F.regexp_extract(F.coalesce(text, F.lit("")), "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))


def date_from_url(url: Column) -> Column:
    """yyyy-MM-dd from /read/Y/M/D/, or from /Y/M/D/ with a year of 2018 to 2027, else ''."""
    read = "/read/([0-9]{4})/([0-9]{2})/([0-9]{2})/"
    plain = "/([0-9]{4})/([0-9]{2})/([0-9]{2})/"
    joined = lambda p: F.concat_ws("-", *[F.regexp_extract(url, p, i) for i in (1, 2, 3)])
    year = F.regexp_extract(url, plain, 1)
    return F.coalesce(F.when(url.rlike(read), joined(read)).when(year.between("2018", "2027"), joined(plain)), F.lit(""))


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def period_number(date: Column, anchor: dt.date) -> Column:
    """1, 2, .. for each 14 days from the anchor; NULL before it and for no date."""
    days = F.datediff(date, F.lit(anchor))
    return F.when(days >= 0, (F.floor(days / DAYS) + 1).cast("int"))


def period_id(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("BW%04d", number))


def period_start(number: Column, anchor: dt.date) -> Column:
    return F.date_add(F.lit(anchor), ((number - 1) * DAYS).cast("int"))


def period_end(number: Column, anchor: dt.date) -> Column:
    return F.date_add(F.lit(anchor), ((number - 1) * DAYS + DAYS - 1).cast("int"))


def periods_until(anchor: dt.date, end: dt.date) -> int:
    return (end - anchor).days // DAYS + 1


def coerced(text: Column) -> Column:
    """The day that yyyy-MM-dd names; NULL for what names none."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
