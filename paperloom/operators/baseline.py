"""Baseline extraction of invoice fields from plain text, with quality and likeness scores.

Every function adds columns to the row; null or empty text has quality 0 and no fields. Where line order decides,
the first line wins a tie; between equal amounts scores the greater amount wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import amounts, dates
from paperloom.functions.text import EOL, clean_name, count_chars, count_of, digits, empty, has, is_upper, let, lines, strip, token_count
from paperloom.operators import patterns as P
from paperloom.operators.rules import any_of, best_line, block_after, extract, first_match, first_matching, indexed

FIELDS = ["invoice_number", "invoice_date", "due_date", "issuer_name", "recipient_name", "total_amount"]


def valid_number(c: Column) -> Column:
    """4 to 24 characters with a digit, no label word, no single letter with three digits, nothing but word marks, - and /."""
    return (
        F.length(c).between(4, 24)
        & has(c, r"\d")
        & ~c.rlike(r"^[A-Z]\d{3}$")
        & ~has(c, r"^(amount|date|number|total|page|client|reference|explanation)$")
        & ~c.rlike("^[a-z]{5,}$")
        & ~c.rlike(r"(?U)[^\w\-/]")
    )


def invoice_number(text: Column) -> Column:
    return first_match(text, P.BASELINE_NUMBER, lambda v: F.when(valid_number(v), v))


def invoice_date(text: Column) -> Column:
    return first_match(text, P.BASELINE_DATE, dates.parse_baseline)


def due_date(text: Column) -> Column:
    """Of the first pattern that matches, even if its date can't be read."""
    return first_matching(text, P.BASELINE_DUE, dates.parse_baseline)


def payment_terms(text: Column) -> Column:
    return first_match(text, P.PAYMENT_TERMS)


def bad_name(c: Column) -> Column:
    return ~F.length(c).between(4, 90) | (digits(c) > 6) | has(c, r"\b\d{5,}\b") | any_of(c, P.BAD_NAME)


def _points(condition: Column, n: int) -> Column:
    return F.when(condition, n).otherwise(0)


def issuer_name(text_lines: Column, company: str = P.COMPANY, top: int = 10, most_words: int = 8, upper: bool = True) -> Column:
    """Best of the first lines by company word, position, length and absence of digits; at least 4 points."""

    def score(i: Column, line: Column) -> Column:
        s = (
            _points(has(line, company), 4)
            + _points(i <= 2, 2)
            + _points(token_count(line).between(2, most_words), 2)
            + _points(digits(line) == 0, 1)
            + _points(line.rlike("[A-Za-z]"), 1)
        )
        if upper:
            s = s + _points(is_upper(line), 1)
        return F.when(~bad_name(line), s)

    return best_line(indexed(F.slice(text_lines, 1, top)), score, 4, clean_name)


def recipient_name(text: Column) -> Column:
    """First usable line of the block under a label, else the name on an attention line."""
    all_lines = F.transform(F.split(empty(text), EOL), strip)
    block = block_after(all_lines, P.RECIPIENT_LABEL, 4, P.BLOCK_STOP)
    cleaned = F.transform(
        F.filter(block, lambda x: (token_count(x) >= 2) & (digits(x) <= 4)),
        lambda x: strip(F.get(F.split(x, r"(?iU)\b(?:p\.?o\.?\s*box|\d{5,})\b", 2), F.lit(0))),
    )
    first = F.get(F.filter(cleaned, lambda x: F.length(x) >= 3), F.lit(0))
    return F.coalesce(clean_name(first), clean_name(extract(text, P.ATTENTION)))


def total_amount(text_lines: Column) -> Column:
    """Best-scored amount, the greater on ties; at least 2 points."""
    n = F.size(text_lines)

    def of_line(x: Column, i: Column) -> Column:
        low = F.lower(x)
        totalish = low.rlike(r"\b(total|amount due|balance due|net amount)\b")
        score = (
            F.when(low.contains("total amount due"), 6)
            .when(low.contains("amount due") | low.contains("balance due"), 5)
            .when(low.rlike(r"(?U)\btotal\b"), 4)
            .otherwise(0)
            + _points(i >= F.floor(n * 0.5), 1)
            - _points(count_of(x, r"\.") > 8, 2)
        )
        raw = F.filter(F.regexp_extract_all(x, F.lit(P.AMOUNT), F.lit(1)), lambda a: a.contains(".") | totalish)
        top = F.array_max(F.filter(F.transform(raw, amounts.value), lambda v: v > 0))
        # Of one line only the greatest amount can win.
        return F.when(x.rlike(r"\d"), let(top, lambda v: F.when(v.isNotNull(), F.struct(score.alias("s"), v.alias("v")))))

    return let(F.array_max(F.transform(text_lines, of_line)), lambda b: F.when(b["s"] >= 2, amounts.plain(b["v"])))


def ocr_quality(text: Column) -> Column:
    """1 less penalties for few letters, few spaces, short lines, odd signs, many digits."""
    t = empty(text)
    n = F.length(t)
    ls = lines(text)
    mean = F.aggregate(ls, F.lit(0), lambda a, x: a + F.length(x)) / F.size(ls)
    share = lambda p: count_chars(t, p) / n
    score = (
        F.lit(1.0)
        - F.when(share(r"\p{L}") < 0.45, 0.25).otherwise(0.0)
        - F.when(share(r"\s") < 0.08, 0.15).otherwise(0.0)
        - F.when(mean < 12, 0.15).otherwise(0.0)
        - F.when(share(r"[^A-Za-z0-9\s.,:/\-&()$#]") > 0.08, 0.20).otherwise(0.0)
        - F.when(share(r"\p{Nd}") > 0.35, 0.10).otherwise(0.0)
    )
    return F.when(F.trim(F.regexp_replace(t, r"\s+", " ")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.round(score, 2)))


def invoice_like(text: Column) -> Column:
    low = F.lower(empty(text))
    plus = sum((has(low, p).cast("int") for p in P.LIKE_POSITIVE), F.lit(0))
    minus = sum((has(low, p).cast("int") for p in P.LIKE_NEGATIVE), F.lit(0))
    return (plus - minus).cast("int")


def confidence(like: Column) -> Column:
    return F.when(like >= 2, "high").when(like == 1, "medium").otherwise("low")


def validate(fields: dict[str, Column]) -> dict[str, Column]:
    """Values of impossible form become null."""
    out = dict(fields)
    rules = {
        "invoice_number": valid_number,
        "issuer_name": lambda v: (digits(v) <= 5) & ~has(v, P.BAD_PARTY) & (v != ""),
        "due_date": lambda v: v.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "total_amount": lambda v: v.rlike(r"^\d+\.\d{2}$"),
    }
    rules["recipient_name"] = rules["issuer_name"]
    for k, ok in rules.items():
        out[k] = let(out[k], _keep_if(ok))
    return out


def _keep_if(ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.when(ok(v), v)


def extract_fields(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds the six fields, payment_terms, invoice_like_score, ocr_quality_score and document_confidence.

    Stages of columns keep each generated method small; unreadable text (quality under 0.35) has no fields.
    """
    t = F.col(text)
    df = df.withColumns({"_lines": lines(t), "invoice_like_score": invoice_like(t), "ocr_quality_score": ocr_quality(t)})
    df = df.withColumn("document_confidence", confidence(F.col("invoice_like_score")))
    ls = F.col("_lines")
    raw = {
        "invoice_number": invoice_number(t),
        "invoice_date": invoice_date(t),
        "due_date": due_date(t),
        "payment_terms": payment_terms(t),
        "issuer_name": issuer_name(ls),
        "recipient_name": recipient_name(t),
        "total_amount": total_amount(ls),
    }
    readable = F.col("ocr_quality_score") >= 0.35
    df = df.withColumns({k: F.when(readable, v) for k, v in raw.items()})
    return df.withColumns(validate({k: F.col(k) for k in FIELDS})).drop("_lines")
