"""Amounts as plain decimal strings with two places; null where the text is no positive amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import let


def plain(value: Column) -> Column:
    """A positive number as text."""
    return F.when(value > 0, F.format_string("%.2f", value))


def value(c: Column) -> Column:
    """Number without currency signs, spaces and thousands commas; may be zero or negative."""
    return F.regexp_replace(c, r"(?U)[£€$¥₹\s,]", "").try_cast("double")


def normalise(c: Column) -> Column:
    """Currency signs, spaces and thousands commas dropped."""
    return let(value(c), plain)


def normalise_v5(c: Column) -> Column:
    """Also reads 1.871,86; a value whose integer part is a year from 1900 to 2099 without cents is no amount."""
    s = F.regexp_replace(c, r"(?U)[£$€¥₹\s]", "")
    european = s.rlike(r"^\d{1,3}(?:\.\d{3})*,\d{1,2}$")
    number = F.when(european, F.translate(F.translate(s, ".", ""), ",", ".")).otherwise(F.translate(s, ",", ""))
    year = lambda x: F.floor(x).between(1900, 2099) & (x - F.floor(x) < 0.01)
    return let(number.try_cast("double"), lambda x: F.when((x > 0) & ~year(x), F.format_string("%.2f", x)))


def normalise_line(c: Column) -> Column:
    """The last separator decides which one is decimal; a comma before two final digits is."""
    s = F.regexp_replace(c, r"[^\d,.\-]", "")
    comma, dot = F.length(s) - F.locate(",", F.reverse(s)), F.length(s) - F.locate(".", F.reverse(s))
    both = s.contains(",") & s.contains(".")
    as_european = F.translate(F.translate(s, ".", ""), ",", ".")
    as_english = F.translate(s, ",", "")
    number = (
        F.when(both & (comma > dot), as_european)
        .when(both, as_english)
        .when(s.contains(",") & s.rlike(r",\d{2}$"), as_european)
        .otherwise(as_english)
    )
    return let(number.try_cast("double"), plain)


def to_number(c: Column) -> Column:
    """Digits and dots only, as a number; for tolerant comparison."""
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("double")
