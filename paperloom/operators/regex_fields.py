"""Regex extraction of invoice fields in six versions; versions differ by rule rows and switches.

``mode``: "text_only" applies the patterns; "full" adds cleaning of the issuer, the issuer from an e-mail domain and
the removal of implausible names, as for a document with a file.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import amounts, dates
from paperloom.functions.text import EOL, empty, has, is_title, is_upper, let, letters, lines, squash, strip, strip_issuer_prefix, token_count
from paperloom.operators import patterns as P
from paperloom.operators.rules import extract

FIELDS = ["invoice_number", "invoice_date", "due_date", "issuer_name", "recipient_name", "total_amount"]


@dataclass(frozen=True)
class Version:
    """What a version looks for and how."""

    number: tuple[str, ...]
    tail: bool  # a short number after a code belongs to it
    dates: tuple[str, ...]
    early_date: bool  # the first written date before "due date", if no label has one
    due: tuple[str, ...]
    immediate: bool  # terms payable at once take the invoice date
    amounts: tuple[tuple[str, bool], ...]
    amount_v5: bool  # European amounts, years excluded
    floor: float
    seller_above: bool  # issuer from the lines above the recipient's label
    shortest: bool  # shortest candidate of the header instead of the first one
    same_line: int  # how many same-line recipient patterns
    all_caps: bool
    lower: bool = False


_V5 = Version(
    number=tuple(P.V5_NUMBER), tail=True, dates=tuple(P.V5_DATE), early_date=True, due=tuple(P.V5_DUE), immediate=True,
    amounts=tuple(P.V5_AMOUNT), amount_v5=True, floor=0.5, seller_above=True, shortest=True, same_line=4, all_caps=True,
)
_V4 = replace(
    _V5, number=tuple(P.V5_NUMBER[:9]), tail=False, immediate=False, amounts=tuple(P.V5_AMOUNT[:6]), amount_v5=False, same_line=3, all_caps=False
)
_V2 = replace(
    _V4, number=tuple(P.V5_NUMBER[:7]), dates=tuple(P.V5_DATE[:3]), early_date=False, due=tuple(P.V5_DUE[:3]), floor=0.0, shortest=False, same_line=2
)
_V1 = replace(_V2, number=tuple(P.V5_NUMBER[:3]), due=tuple(P.V5_DUE[:2]), amounts=tuple(P.V5_AMOUNT[:1] + P.V5_AMOUNT[2:4]))
_V0 = replace(_V1, seller_above=False, same_line=1, lower=True)
VERSIONS = {"v0": _V0, "v1": _V1, "v2": _V2, "v3": _V4, "v4": _V4, "v5": _V5}


def invoice_number(text: Column, v: Version) -> Column:
    def one(pattern: str) -> Column:
        return let(strip(extract(text, pattern, 1, "i")), lambda value: checked(pattern, value))

    def checked(pattern: str, value: Column) -> Column:
        ok = value.rlike(r"\d") & (F.length(value) >= 3) & ~has(value, P.V5_NUMBER_STOP)
        if v.tail:
            tail = F.nullif(F.regexp_extract(text, rf"(?i){pattern}(?=\s+(\d{{3,6}})(?:\s|$))", 2), F.lit(""))
            year = (F.length(tail) == 4) & tail.cast("int").between(1900, 2099)
            value = F.when(tail.isNotNull() & value.rlike("[A-Za-z]") & ~year, F.concat_ws(" ", value, tail)).otherwise(value)
        cut = strip(F.regexp_replace(value, r"\s+[A-Za-z]+$", ""))
        return let(cut, lambda x: F.when(ok & (F.length(x) >= 3), F.upper(x)))

    return F.coalesce(*[one(p) for p in v.number])


def dates_of(text: Column, v: Version) -> tuple[Column, Column]:
    """Invoice and due date; the due date may be a payment-terms phrase and differs from the invoice date."""
    invoice = F.coalesce(*[dates.parse_named(extract(text, p, 1, "im")) for p in v.dates])
    if v.early_date:
        before = F.get(F.split(text, r"(?i)due\s*date", 2), F.lit(0))
        invoice = F.coalesce(invoice, dates.parse_named(extract(before, P.WRITTEN_DATE, 1, "i")))
    return invoice, F.coalesce(*[_due(text, p, invoice) for p in v.due], _terms(text, invoice, v))


def _due(text: Column, pattern: str, invoice: Column) -> Column:
    found = dates.parse_named(extract(text, pattern, 1, "im"))
    return let(found, lambda d: F.when(~d.eqNullSafe(invoice), d))


def _terms(text: Column, invoice: Column, v: Version) -> Column:
    phrase = strip(extract(text, P.V5_TERMS, 1, "i"))
    if not v.immediate:
        return phrase
    return let(phrase, lambda x: F.when(has(x, "receipt|immediately"), F.coalesce(invoice, x)).otherwise(x))


def total_amount(text: Column, v: Version) -> Column:
    """Last labelled amount by position, else the last other one.

    Positions come from the text itself: each pattern's matches are replaced one by one in a scan over the pieces
    before them, so no Python is needed. The start of the k-th match is the length of everything before it.
    """
    normal = amounts.normalise_v5 if v.amount_v5 else amounts.normalise

    def found(pattern: str) -> Column:
        whole = F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), F.lit(1))
        values = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1))
        gaps = F.split(text, f"(?i){pattern}")
        at = F.transform(
            whole,
            lambda x, i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g))
            + F.aggregate(F.slice(whole, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g)),
        )
        rows = F.zip_with(at, values, lambda p, x: F.struct(p.alias("at"), normal(x).alias("a")))
        return F.filter(rows, lambda r: r["a"].isNotNull() & (r["a"].cast("double") >= v.floor))

    def last(labelled: bool) -> Column:
        parts = [found(p) for p, lab in v.amounts if lab == labelled]
        return F.array_max(F.concat(*parts))["a"] if parts else F.lit(None).cast("string")

    return F.coalesce(last(True), last(False))


def _alpha(c: Column) -> Column:
    return letters(c) / F.greatest(F.length(c), F.lit(1))


def issuer_name(text: Column, ls: Column, v: Version) -> Column:
    labelled = strip(squash(extract(text, P.V5_SELLER_LABEL, 1, "im")))
    labelled = let(labelled, lambda x: F.when((F.length(x) > 4) & (F.length(x) < 100), x))
    parts = [labelled]
    readable = lambda x: (_alpha(x) >= 0.35) & F.length(x).between(4, 120)
    if v.seller_above:
        above = F.when(has(text, P.V5_BILL_TO), lines(F.get(F.split(text, f"(?i){P.V5_BILL_TO}", 2), F.lit(0))))
        last = F.reverse(F.when(F.size(above) > 6, F.slice(above, -6, 6)).otherwise(above))
        parts.append(F.get(F.filter(last, lambda x: readable(x) & has(x, P.V5_COMPANY)), F.lit(0)))
        parts.append(F.get(F.filter(F.slice(above, 1, 4), lambda x: (_alpha(x) >= 0.5) & (token_count(x) >= 2)), F.lit(0)))

    def candidate(x: Column) -> Column:
        name_like = token_count(x).between(1, 3) & (_alpha(x) >= 0.7) & ~x.rlike(r"\d") & (is_upper(x) | is_title(x))
        return readable(x) & ~F.lower(x).isin(P.V5_DOC_TYPES) & (has(x, P.V5_COMPANY) | name_like)

    header = F.filter(F.slice(ls, 1, 6), candidate)
    if v.shortest:
        parts.append(F.array_min(F.transform(header, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))["x"])
    else:
        parts.append(F.get(header, F.lit(0)))
    return strip(squash(F.coalesce(*parts)))


def _party(c: Column) -> Column:
    return let(F.trim(squash(strip(F.regexp_replace(c, f"(?i){P.V5_PARTY_STRIP}", ""))), F.lit(" -:|,;")), _party_value)


def _party_value(s: Column) -> Column:
    mail = extract(s, f"({P.EMAIL})", 1, "iU")
    plain = ~has(s, P.V5_PARTY_BAD) & ~s.rlike(r"\d") & F.length(s).between(2, 80) & ~has(s, P.V5_PARTY_EXACT)
    return F.coalesce(mail, F.when(plain, s))


def recipient_name(text: Column, ls: Column, v: Version) -> Column:
    squashed = F.transform(ls, squash)
    parts = [_party(extract(text, p, 1, "im")) for p in P.V5_PARTY_SAME_LINE[: v.same_line]]

    def anchored(line: Column, i: Column) -> Column:
        own = let(_party(line), lambda x: F.when(F.lower(x) != F.lower(line), x))
        following = F.filter(F.transform(F.slice(squashed, i + 2, 3), _party), lambda x: x.isNotNull())
        return F.when(has(line, P.V5_PARTY_LABEL), F.coalesce(own, F.get(following, F.lit(0))))

    parts.append(F.get(F.filter(F.transform(squashed, anchored), lambda x: x.isNotNull()), F.lit(0)))
    parts.append(extract(extract(text, P.V5_PARTY_EMAIL, 1, "im"), f"({P.EMAIL})", 1, "iU"))
    if v.all_caps:
        bare = F.transform(F.slice(squashed, 1, 60), lambda x: strip(F.regexp_replace(x, r"\s*\([A-Z ]+\)\s*$", "")))
        caps = F.filter(bare, lambda x: x.rlike(P.ALL_CAPS_NAME) & ~has(x, P.V5_PARTY_BAD) & ~has(x, P.ALL_CAPS_STOP))
        parts.append(F.get(caps, F.lit(0)))
    return F.coalesce(*parts)


def bad_recipient(c: Column) -> Column:
    s = strip(c)
    return c.isNull() | (F.length(s) < 2) | has(s, P.BAD_RECIPIENT_EXACT) | has(s, P.BAD_RECIPIENT_WORD) | has(s, P.BAD_RECIPIENT_COUNTRY)


def bad_issuer(c: Column) -> Column:
    s = strip(c)
    long_title = has(s, r"\b(neon\s+sign|tax\s+invoice|purchase\s+order)\b") & (token_count(s) > 4)
    return (
        c.isNull()
        | (F.length(s) < 2)
        | has(s, P.BAD_ISSUER_EXACT)
        | has(s, P.BAD_ISSUER_PLACE)
        | (s.rlike(P.BAD_ISSUER_CAPS) & ~has(s, P.V5_COMPANY))
        | has(s, P.BAD_ISSUER_TEXT)
        | has(s, P.BAD_ISSUER_COUNTRY)
        | long_title
    )


def strong_company(c: Column) -> Column:
    s = strip(c)
    plain = token_count(s).between(1, 5) & (_alpha(s) >= 0.60) & ~s.rlike(r"\d")
    return ~bad_issuer(c) & (has(s, P.V5_COMPANY) | plain)


def email_domain_issuer(text: Column) -> Column:
    """Domain of the first address in the first 25 lines that isn't the recipient's or a mail provider's."""
    first = F.slice(F.split(empty(text), EOL), 1, 25)
    domains = F.transform(
        F.filter(first, lambda x: ~has(x, P.RECIPIENT_ANCHOR)),
        lambda x: F.lower(F.regexp_extract(x, r"(?U)[\w.-]+@([\w-]+)\.[\w.-]+", 1)),
    )
    ok = F.filter(domains, lambda d: (F.length(d) >= 3) & ~d.isin(P.GENERIC_DOMAINS))
    return F.upper(F.get(ok, F.lit(0)))


def extract_fields(df: DataFrame, version: str = "v5", mode: str = "text_only", text: str = "raw_text") -> DataFrame:
    """Adds the six fields; null or empty text has none."""
    v = VERSIONS[version]
    source = F.lower(empty(F.col(text))) if v.lower else empty(F.col(text))
    df = df.withColumn("_t", source).withColumn("_lines", lines(F.col("_t")))
    t, ls = F.col("_t"), F.col("_lines")
    invoice, _ = dates_of(t, v)
    df = df.withColumns({"invoice_number": invoice_number(t, v), "invoice_date": invoice})
    d = F.col("invoice_date")
    df = df.withColumn("due_date", F.coalesce(*[_due(t, p, d) for p in v.due], _terms(t, d, v)))
    df = df.withColumns(
        {"total_amount": total_amount(t, v), "issuer_name": issuer_name(t, ls, v), "recipient_name": recipient_name(t, ls, v)}
    )
    if v.lower:
        df = df.withColumns({k: F.lower(F.col(k)) for k in FIELDS})
    if mode == "full":
        df = df.withColumn("issuer_name", strip_issuer_prefix(F.col("issuer_name")))
        df = df.withColumn("issuer_name", F.when(bad_issuer(F.col("issuer_name")), email_domain_issuer(t)).otherwise(F.col("issuer_name")))
        df = df.withColumns(
            {
                "issuer_name": F.when(~bad_issuer(F.col("issuer_name")), F.col("issuer_name")),
                "recipient_name": F.when(~bad_recipient(F.col("recipient_name")), F.col("recipient_name")),
            }
        )
    return df.drop("_t", "_lines")


def version_matrix(df: DataFrame, key: str = "doc_id", text: str = "raw_text", versions: list[str] | None = None) -> DataFrame:
    """(version, key, fields...) of several versions in one long table, from one scan of the texts."""
    df = df.select(key, text)
    names = versions or list(VERSIONS)
    for name in names:
        df = extract_fields(df, name, text=text).withColumn(f"_{name}", F.struct(F.lit(name).alias("version"), key, *FIELDS)).drop(*FIELDS)
    return df.select(F.explode(F.array(*[f"_{name}" for name in names])).alias("x")).select("x.*")
