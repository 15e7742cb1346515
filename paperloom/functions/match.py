"""Tolerant comparison of extracted values with gold values; false wherever either side is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.amounts import to_number
from paperloom.functions.text import contains_either_way, empty, fold_accents, squash, strip


def key(c: Column) -> Column:
    """Lower case, white space squashed; null as the empty string."""
    return F.lower(strip(squash(empty(c))))


def match_string(gold: Column, predicted: Column, accents: bool = True) -> Column:
    """One contains the other, or would without accents."""
    g, p = key(gold), key(predicted)
    plain = contains_either_way(g, p)
    if not accents:
        return plain
    gf, pf = fold_accents(g), fold_accents(p)
    return (g != "") & (p != "") & (plain | gf.contains(pf) | pf.contains(gf))


def match_number(gold: Column, predicted: Column) -> Column:
    """Equal without leading zeros."""
    g, p = (F.regexp_replace(key(x), "^0+", "") for x in (gold, predicted))
    return (g != "") & (g == p)


def match_date(gold: Column, predicted: Column, check_year: bool = True) -> Column:
    """Equal, or the same first three numbers in any order (and the same year)."""
    g, p = key(gold), key(predicted)
    year = lambda x: F.nullif(F.regexp_extract(x, r"\b(\d{4})\b", 1), F.lit(""))
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))
    gn, pn = numbers(g), numbers(p)
    same = (F.size(gn) >= 3) & (F.size(pn) >= 3) & (F.array_sort(F.slice(gn, 1, 3)) == F.array_sort(F.slice(pn, 1, 3)))
    if check_year:
        same = same & ~F.coalesce(year(g) != year(p), F.lit(False))
    return (g != "") & (p != "") & ((g == p) | same)


def match_amount(gold: Column, predicted: Column) -> Column:
    """Within one per cent, or a hundredth."""
    g, p = to_number(gold), to_number(predicted)
    return F.coalesce(F.abs(g - p) <= F.greatest(F.lit(0.01), 0.01 * F.abs(g)), F.lit(False))


MATCHERS = {
    "recipient_name": match_string,
    "issuer_name": match_string,
    "invoice_number": match_number,
    "invoice_date": match_date,
    "due_date": match_date,
    "total_amount": match_amount,
}
