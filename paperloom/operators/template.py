"""Template detection, and extraction rules that depend on the template.

All templates are columns of one projection chosen by CASE; the baseline runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import amounts
from paperloom.functions.text import clean_name, digits, empty, has, let, lines, squash, token_count
from paperloom.operators import baseline as B
from paperloom.operators import patterns as P
from paperloom.operators.rules import any_of, best_line, block_after, extract, indexed, weighted_presence

# Fixed values.
_BLOCK_STOP = r"\b(invoice|date|terms|amount|total|description|qty|quantity|unit price)\b"
_BAD_RECIPIENT = [
    r"^\s*(remit to|explanation|reference|purchase order|po number|invoice|date|terms|amount|total)\b",
    r"^\s*(ship to|sold to|bill to|to:?)\s*$",
    r"\b(telephone|telex|fax|p\.?o\.?\s*box)\b",
    r"^\d+\s+[A-Za-z]",
    r"\b(street|avenue|road|rd\.?|blvd|boulevard|lane|drive|suite|floor)\b",
]
_MONEY = {
    "lab_invoice": [(r"\btotal amount due\b", 6), (r"\bamount due\b", 5), (r"\btotal\b", 4), (r"\bnet amount\b", 4)],
    "law_firm_letterbill": [(r"\bthis bill total\b", 8), (r"\bcurrent disbursements\b", 5), (r"\bcurrent professional services\b", 4), (r"\btotal\b", 3)],
    "remittance_advice": [(r"\bremittance total\b", 8), (r"\bclient total\b", 7), (r"\binvoice amount\b", 5), (r"\bamount less\b", 3), (r"\btotal\b", 3)],
    "tabular_invoice": [(r"\btotal amount due\b", 8), (r"\bamount due\b", 7), (r"\bnet amount\b", 6), (r"\bbalance due\b", 6), (r"\btotal\b", 4)],
}
_NUMBERS = {
    "lab_invoice": [rf"(?:invoice|invorce|lnvoice)\s*[#:.-]?\s*{P.CODE}", r"\b([A-Z]{1,4}\-?\d{3,10})\b"],
    "law_firm_letterbill": [rf"\bour\s*file\s*no\.?\s*[:\-]?\s*{P.CODE}"],
    "remittance_advice": [rf"\breference\s*no\.?\s*{P.CODE}", rf"\bdocument\s*no\.?\s*{P.CODE}", rf"\binvoice\s*no\.?\s*{P.CODE}"],
    "tabular_invoice": [rf"(?:invoice|invorce|lnvoice)\s*(?:no|number|#)?\.?\s*[:\-#]?\s*{P.CODE}"],
}
_LABELS = {
    "lab_invoice": r"(?:^to\s*:?|\bbill\s*to\b|\bsold\s*to\b|\battention\b|\battn\b)",
    "tabular_invoice": r"(?:\bbill\s*to\b|\bsold\s*to\b|\bshipped to\b|\bship to\b|^to\s*:?$)",
}
_FALLBACK = r"(?:\blorillard\b|\bphilip morris\b|\bresearch center\b|\bcompany\b)"
_ORG = r"\b(center|company|inc\.?|corp\.?|ltd\.?|laboratories?|research|associates?|institute)\b"
_CLIENTS = r"\b(lorillard|philip morris|reynolds|tobacco)\b"
_LETTER_DATE = r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}$"
_LETTER_STOP = r"^\b(re:|our file no|this bill total|we appreciate)\b"
TOP = {"lab_invoice": 8, "law_firm_letterbill": 8, "remittance_advice": 6, "tabular_invoice": 8}


def detect(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``template_name`` and ``template_score``: most points, the first on ties; under 3 points generic."""
    low = F.lower(empty(F.col(text)))
    scores = [
        F.struct(weighted_presence(low, [(p, w) for p in pats]).cast("int").alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name"))
        for i, (name, (w, pats)) in enumerate(P.TEMPLATES.items())
    ]
    df = df.withColumn("_best", F.array_max(F.array(*scores)))
    name = F.when(F.col("_best.s") < 3, "generic_invoice").otherwise(F.col("_best.name"))
    return df.withColumns({"template_name": name, "template_score": F.col("_best.s")}).drop("_best")


def _candidate(c: Column) -> Column:
    s = F.get(F.split(c, r"(?iU)\b(?:p\.?o\.?\s*box|telephone|telex|fax)\b", 2), F.lit(0))
    return let(F.trim(squash(s), F.lit(" ,:-")), lambda x: F.when(F.length(x) >= 3, clean_name(x)))


def _best_recipient(block: Column, issuer: Column) -> Column:
    """Best candidate of a block that is neither an address nor the issuer."""

    def score(i: Column, line: Column) -> Column:
        return let(_candidate(line), points)

    def points(c: Column) -> Column:
        bad = c.isNull() | (digits(c) > 6) | any_of(c, _BAD_RECIPIENT) | F.coalesce(c == issuer, F.lit(False))
        s = (
            F.when(has(c, _ORG), 4).otherwise(0)
            + F.when(token_count(c).between(2, 6), 2).otherwise(0)
            + F.when(digits(c) == 0, 2).otherwise(0)
            + F.when(has(c, _CLIENTS), 3).otherwise(0)
            - F.when(has(c, r"\b(street|avenue|road|suite|floor)\b"), 4).otherwise(0)
        )
        return F.when(~bad, s)

    return best_line(indexed(block), score, -999, _candidate)


def _money(ls: Column, rules: list[tuple[str, int]]) -> Column:
    n = F.size(ls)

    def of_line(x: Column, i: Column) -> Column:
        score = weighted_presence(F.lower(x), rules) + F.when(i >= F.floor(n * 0.5), 1).otherwise(0)
        found = F.transform(F.regexp_extract_all(x, F.lit(P.AMOUNT), F.lit(1)), amounts.value)
        top = F.array_max(F.filter(found, lambda v: v > 0))
        return F.when(x.rlike(r"\d"), let(top, lambda v: F.when(v.isNotNull(), F.struct(score.alias("s"), v.alias("v")))))

    return let(F.array_max(F.transform(ls, of_line)), lambda b: F.when(b["s"] >= 2, amounts.plain(b["v"])))


def extract_fields(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Baseline columns overridden by the rules of the detected template, plus template_name and template_score."""
    df = detect(B.extract_fields(df, text), text).withColumn("_lines", lines(F.col(text)))
    ls, t, name = F.col("_lines"), F.col(text), F.col("template_name")
    active = ~((F.col("document_confidence") == "low") & (F.col("invoice_like_score") <= 0))

    def by_template(values: dict[str, Column]) -> Column:
        out = F.lit(None).cast("string")
        for k, v in values.items():
            out = F.when(active & (name == k), v).otherwise(out)
        return out

    issuer = by_template({k: F.substring(_issuer(ls, top), 1, 100) for k, top in TOP.items()})
    df = df.withColumn("issuer_name", F.coalesce(issuer, "issuer_name"))
    issuer = F.col("issuer_name")
    lab = _best_recipient(block_after(ls, _LABELS["lab_invoice"], 5, _BLOCK_STOP), issuer)
    usable = lambda c: F.when(c.isNotNull() & ~any_of(c, _BAD_RECIPIENT) & (digits(c) <= 6) & ~F.coalesce(c == issuer, F.lit(False)), c)
    fallback = let(_candidate(F.get(F.filter(F.slice(ls, 1, 20), lambda x: has(x, _FALLBACK)), F.lit(0))), usable)
    other = lambda block: F.get(F.filter(F.transform(block, _candidate), lambda c: c.isNotNull() & ~F.coalesce(c == issuer, F.lit(False))), F.lit(0))
    letter = block_after(F.slice(ls, 1, 31), _LETTER_DATE, 6, _LETTER_STOP)
    client = F.filter(F.slice(ls, 1, 15), lambda x: has(x, r"\bclient\b"))
    recipient = by_template(
        {
            "lab_invoice": F.coalesce(lab, "recipient_name", fallback),
            "law_firm_letterbill": other(letter),
            "remittance_advice": other(client),
            "tabular_invoice": _best_recipient(block_after(ls, _LABELS["tabular_invoice"], 5, _BLOCK_STOP), issuer),
        }
    )
    number = by_template({k: F.coalesce(*[_valid(extract(t, p)) for p in pats]) for k, pats in _NUMBERS.items()})
    total = by_template({k: _money(ls, rules) for k, rules in _MONEY.items()})
    df = df.withColumns(
        {
            "recipient_name": F.coalesce(recipient, "recipient_name"),
            "invoice_number": F.coalesce("invoice_number", number),
            "total_amount": F.coalesce(total, "total_amount"),
        }
    )
    return df.withColumns(B.validate({k: F.col(k) for k in B.FIELDS})).drop("_lines")


def _valid(v: Column) -> Column:
    return let(v, lambda x: F.when(B.valid_number(x), x))


def _issuer(ls: Column, top: int) -> Column:
    return _candidate(B.issuer_name(ls, P.COMPANY_TEMPLATE, top, 9, upper=False))


def breakdown(df: DataFrame) -> DataFrame:
    """(template_name, n), most frequent first."""
    return df.groupBy("template_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template_name")
