"""Dates as YYYY-MM-DD strings. They stay strings: payment terms and impossible dates share these fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import let

# Fixed values.
MONTHS = "january february march april may june july august september october november december".split()
_MONTH_RE = "(" + "|".join(MONTHS + ["jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]) + ")"
_NUMBERS = {m[:3]: i for i, m in enumerate(MONTHS, 1)}


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y, m, d)


def _month_number(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in _NUMBERS.items():
        out = F.when(F.lower(F.substring(name, 1, 3)) == k, v).otherwise(out)
    return out


def parse_numeric(a: Column, b: Column, c: Column, reject_first: bool = True) -> Column:
    """Three numbers as a date.

    Rules from version 1 on (``reject_first``): first or second above 31 is no date, which comes before the year
    test, so ISO dates are never read; two-digit years pivot at 50; a first number above 12 is the day.
    Version 0 reads a leading year and has no pivot.
    """
    p1, p2, p3 = (x.try_cast("int") for x in (a, b, c))
    if not reject_first:
        full = F.when(p3 < 100, 2000 + p3).otherwise(p3)
        return F.when(p1 > 1900, _ymd(p1, p2, p3)).when(p1 > 12, _ymd(full, p2, p1)).otherwise(_ymd(full, p1, p2))
    year = F.when(p3 >= 100, p3).when(p3 < 50, 2000 + p3).otherwise(1900 + p3)
    return F.when((p1 > 31) | (p2 > 31), None).when(p1 > 12, _ymd(year, p2, p1)).otherwise(_ymd(year, p1, p2))


_NUM_A = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
_NUM_B = r"(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})"


def parse_named(c: Column) -> Column:
    """First numeric date, else a month name with the first short number and the first four-digit year."""
    s = F.substring(F.trim(c), 1, 50)
    return let(F.regexp_replace(s, r"(?U)\s+[a-zA-Z]\s+(?=\d{4})", " "), _parse_named)


def _parse_named(s: Column) -> Column:
    either = rf"{_NUM_A}|{_NUM_B}"
    group = lambda i: F.regexp_extract(s, either, i)
    first = group(1) != ""
    numeric = F.when(
        s.rlike(either),  # no group is read otherwise
        parse_numeric(
            F.when(first, group(1)).otherwise(group(4)),
            F.when(first, group(2)).otherwise(group(5)),
            F.when(first, group(3)).otherwise(group(6)),
        ),
    )
    month = F.regexp_extract(s, f"(?i){_MONTH_RE}", 1)
    rest = F.regexp_replace(s, f"(?i)^(.*?){_MONTH_RE}", "$1")
    day = F.regexp_extract(rest, r"(\d{1,2})", 1).try_cast("int")
    year = F.regexp_extract(s, r"(\d{4})", 1).try_cast("int")
    named = F.when((month != "") & day.between(1, 31) & year.between(1900, 2100), _ymd(year, _month_number(month), day))
    return F.coalesce(numeric, named)


def _to_iso(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.date_format(F.try_to_date(c, f), "yyyy-MM-dd") for f in formats])


def parse_baseline(c: Column) -> Column:
    """Month before day, years 1960 to 2005 only; numeric parts above 31 are rejected."""
    return let(F.trim(F.regexp_replace(c, r"(?U)\s+[a-zA-Z]\s+(?=\d{2,4})", " ")), _parse_baseline)


def _parse_baseline(s: Column) -> Column:
    num = lambda i: F.regexp_extract(s, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", i).try_cast("int")
    a, b, y = num(1), num(2), num(3)
    full = F.when(y >= 100, y).when(y < 70, 2000 + y).otherwise(1900 + y)
    numeric = F.when((a <= 12) & (b >= 1), _ymd(full, a, b)).when((b <= 12) & (a >= 1), _ymd(full, b, a))
    month = F.regexp_extract(s, rf"(?i)^{_MONTH_RE}", 1)
    part = lambda i: F.regexp_extract(s, r"(?i)^[a-z]+\s+(\d{1,2}),?\s+(\d{4})$", i).try_cast("int")
    named = F.when(month != "", _ymd(part(2), _month_number(month), part(1)))
    parsed = F.when(a.isNotNull(), F.when((a <= 31) & (b <= 31), numeric)).otherwise(named)
    real = lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull() & F.substring(d, 1, 4).cast("int").between(1960, 2005)
    return let(parsed, lambda d: F.when(real(d), d))


# The date forms of the line extractor, and formats in the order they are tried.
LINE_PATTERNS = [
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{1,2}-[A-Za-z]{3}-\d{4}\b",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b",
]
LINE_FORMATS = ["yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d/M/yy", "M/d/yy", "d-MMM-yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]


def parse_line(c: Column) -> Column:
    """First date-like piece, tried day before month in a fixed order of formats."""
    piece = F.coalesce(*[F.nullif(F.regexp_extract(c, f"(?i){p}", 0), F.lit("")) for p in LINE_PATTERNS])
    s = F.regexp_replace(F.regexp_replace(F.translate(piece, ".", "/"), ",", ", "), r"\s+", " ")
    s = F.initcap(s)
    short_year = s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$")
    four, two = [f for f in LINE_FORMATS if not f.endswith("/yy")], [f for f in LINE_FORMATS if f.endswith("/yy")]
    return F.when(short_year, _to_iso(s, *two)).otherwise(_to_iso(s, *four))


def looks_like_date(c: Column) -> Column:
    months = "|".join(m for m in [x[:3] for x in MONTHS] + MONTHS)
    return (
        c.rlike(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b") | c.rlike(r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b") | c.rlike(rf"(?i)\b(?:{months})\b")
    )


_CANDIDATES = [
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b",
]


def candidates(c: Column) -> Column:
    """All dates in a text, form by form, each once."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(f"(?i)({p})"), F.lit(1)) for p in _CANDIDATES])
    return F.array_distinct(F.filter(F.transform(found, parse_named), lambda x: x.isNotNull()))
