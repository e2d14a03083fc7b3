"""Numeric columns: lenient parsing, ratios that are null or zero without a denominator, half-up rounding, sample-size grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_value(value: Column, percent: bool = False) -> Column:
    """A cell as a double: parentheses negate, separators, currency signs and blanks go, what isn't a plain number is 0; percent signs (or ``percent``) divide by 100."""
    text = F.coalesce(value, F.lit(""))
    negative = F.trim(text).rlike(r"^\(.*\)$")
    plain = F.regexp_replace(text, r"[,%￥¥$€£\s()]", "")
    number = F.when(plain.rlike(NUMBER), plain.try_cast("double")).otherwise(F.lit(0.0))
    number = F.when(negative & (number != 0), -number).otherwise(number)
    hundredth = F.lit(True) if percent else text.contains("%")
    return F.when(hundredth, number / 100).otherwise(number)


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio_or_null(numerator, denominator), F.lit(0.0))


def change(current: Column, previous: Column) -> Column:
    """Relative change; null unless the previous value is positive."""
    return F.when(previous > 0, current / previous - 1)


def half_up(value: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(value + 0.5)


def grade(high: Column, medium: Column) -> Column:
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def search_sample_grade(impressions: Column, clicks: Column) -> Column:
    return grade((impressions >= 5000) & (clicks >= 100), (impressions >= 1000) & (clicks >= 30))


def ads_sample_grade(clicks: Column, conversions: Column) -> Column:
    return grade((clicks >= 100) & (conversions >= 10), (clicks >= 30) & (conversions >= 3))


def rows_grade(rows: Column) -> Column:
    return grade(rows >= 30, rows >= 10)


def pages_grade(pages: Column) -> Column:
    return grade(pages >= 50, pages >= 20)
