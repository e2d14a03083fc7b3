"""Dates and times without a local time zone: what can't be parsed stays as it is, beside a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _separated(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"[年/.月]", "-"), "日", "")


def date_value(value: Column) -> Column:
    """The day of a year-month-day text with any of the usual separators, else null."""
    text = F.trim(_separated(value))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "y-M-d")).when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_date(F.substring(text, 1, 10)))


def date_text(value: Column) -> Column:
    """date_value as ISO text; unparseable text is kept, null and empty are empty."""
    return F.coalesce(F.date_format(date_value(value), "yyyy-MM-dd"), value, F.lit(""))


def log_time(value: Column) -> Column:
    """A log's time: day/month/year with a zone offset, or ISO with / or - between."""
    iso = F.regexp_replace(value, "/", "-")
    combined = F.try_to_timestamp(F.when(value.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"), value), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.coalesce(combined, F.try_to_timestamp(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), iso)))


#: Formats of a sitemap's dates and of dates in page data: a day, or a time with its zone. Fractions have one digit up to as many as there are S.
SITEMAP_DATES = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX][XX]")
PAGE_DATES = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm[:ss[.SSS]][XXX][XX]")


def _one_of(value: Column, formats: tuple[str, ...]) -> Column:
    zoned = value.endswith("Z") | F.substring(value, -6, 6).contains("+") | F.substring(value, -6, 6).contains("-")
    parsed = F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in formats))
    return parsed.isNotNull() & ((F.length(value) == 10) | zoned)


def is_sitemap_date(value: Column) -> Column:
    """Empty, or an ISO day with an optional time that exists."""
    return (F.coalesce(value, F.lit("")) == "") | _one_of(value, SITEMAP_DATES)


def is_iso_date(value: Column) -> Column:
    return _one_of(value, PAGE_DATES)
