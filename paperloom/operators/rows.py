"""Fields from recognised rows (lines split at gaps), and the rescue of what plain text didn't give.

Rows: key, line_idx, top, left, text, as ``layout.gap_split`` gives them. Following rows are reached by an equi-join on the
document and the line's number, candidates are ranked by aggregation; nothing sorts or collects a document's rows beyond
its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dates
from paperloom.functions.text import has, is_title, is_upper, let, squash, strip, strip_issuer_prefix, token_count
from paperloom.operators import layout
from paperloom.operators import patterns as P
from paperloom.operators.regex_fields import bad_issuer, bad_recipient, email_domain_issuer, strong_company
from paperloom.operators.rules import extract

# Fixed values.
_NUMBER_ANCHOR = r"(?:invoice|inv|factura|facture|reference|ref|booking|confirmation|folio)\s*(?:no|number|num|n[oº°]?|id|#)?"
_NUMBER_BAD = r"(total|amount|eur|usd|vat|tax|date|due|balance)"
_DATE_ANCHOR = r"(invoice\s*date|issue\s*date|billing\s*date|document\s*issue\s*date|date\s*of\s*issue|fecha|fecha\s*de\s*emisi[oó]n)"
_DUE_ANCHOR = (
    r"(due\s*date|payment\s*due|pay(?:ment)?\s*by|valid\s*until|expiry|maturity|vencimiento|fecha\s*l[ií]mite|fecha\s*de\s*vencimiento|"
    r"ech[eé]ance|date\s*d[' ]ech[eé]ance)"
)
_PARTY = (
    r"bill(?:ed)?\s*to|sold\s*to|ship\s*to|invoice\s*to|billed\s*to|customer(?:\s*name)?|customer\s*data|client(?:\s*name)?|buyer(?:\s*name)?|"
    r"recipient(?:\s*name)?|guest(?:\s*name)?|invoice\s*recipient|attn(?:ention)?|cliente|comprador|destinatario|facturer\s*[àa]|acheteur|guest\s*name"
)
_PARTY_BAD = (
    r"\b(invoice|date|due|subtotal|total|amount|balance|vat|tax|supplier code|badge|hotel details|check in|check out|room|"
    r"bank|swift|iban|gst|nif|cif|data|details|phone|telephone|tel|fax|www\.|http|method of payment|payment method|customer service)\b"
)


def _following(rows: DataFrame, anchors: DataFrame, n: int, key: str) -> DataFrame:
    """Rows 1 to ``n`` after each anchor, with its number as ``a_idx`` and the distance ``k``."""
    steps = F.explode(F.array(*[F.lit(i) for i in range(1, n + 1)]))
    want = anchors.select(key, F.col("line_idx").alias("a_idx"), steps.alias("k")).withColumn("line_idx", F.col("a_idx") + F.col("k"))
    return rows.join(want, [key, "line_idx"])


def _number_value(c: Column) -> Column:
    s = F.trim(squash(c), F.lit(" -:|,;"))
    ok = lambda x: F.when(
        (x != "") & ~has(x, _NUMBER_BAD) & ~dates.looks_like_date(x) & x.rlike(r"\d") & F.length(x).between(3, 40), strip(F.regexp_replace(x, r"\s+[A-Za-z]+$", ""))
    )
    return let(let(s, ok), lambda x: F.when(F.length(x) >= 3, x))


def number(rows: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, invoice_number): labelled value on the anchor's row, else values of the next two rows; mixed codes score more."""
    mixed = lambda c: F.when(c.rlike("[A-Z]") & c.rlike(r"\d"), 1).otherwise(0)
    head = rows.filter("line_idx < 40")
    anchors = head.filter(has(F.col("text"), _NUMBER_ANCHOR))
    own = _number_value(extract(F.col("text"), rf"{_NUMBER_ANCHOR}\s*[:#\-]?\s*([A-Z0-9][A-Z0-9/_\-. ]{{2,40}})"))
    same = anchors.select(key, "line_idx", own.alias("v")).withColumn("s", F.lit(4) + mixed(F.col("v")))
    after = _following(head, anchors, 2, key)
    whole = after.select(key, "line_idx", _number_value(F.col("text")).alias("v")).filter(token_count(F.col("v")) <= 4).withColumn("s", F.lit(3))
    parts = after.select(key, "line_idx", F.explode(F.split(F.regexp_replace("text", r"[|]", " "), r"\s+")).alias("p"))
    each = parts.select(key, "line_idx", _number_value(F.col("p")).alias("v")).withColumn("s", F.lit(3) + mixed(F.col("v")))
    cands = same.unionByName(whole).unionByName(each).filter("v IS NOT NULL")
    order = F.struct((-F.col("s")).alias("s"), "line_idx", (-F.length("v")).alias("n"), "v")
    return cands.groupBy(key).agg(F.min_by("v", order).alias("invoice_number"))


def _date(rows: DataFrame, anchor: str, last: bool, name: str, key: str) -> DataFrame:
    head = rows.filter("line_idx < 42")
    anchors = head.filter((F.col("line_idx") < 40) & has(F.col("text"), anchor))
    here = anchors.select("*", F.col("line_idx").alias("a_idx"), F.lit(0).alias("k"))
    found = here.unionByName(_following(head, anchors, 2, key)).withColumn("c", dates.candidates(F.col("text"))).filter(F.size("c") > 0)
    value = F.element_at("c", -1) if last else F.element_at("c", 1)
    return found.groupBy(key).agg(F.min_by(value, F.struct("a_idx", "k")).alias(name))


def invoice_date(rows: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, invoice_date): first date on the first labelled row or the two after it."""
    return _date(rows, _DATE_ANCHOR, False, "invoice_date", key)


def due_date(rows: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, due_date): last date on the first labelled row or the two after it."""
    return _date(rows, _DUE_ANCHOR, True, "due_date", key)


def _party_value(c: Column) -> Column:
    s = F.trim(squash(strip(F.regexp_replace(c, rf"(?i)^(?:{_PARTY})\s*[:\-]?\s*", ""))), F.lit(" -:|,;"))

    def ok(x: Column) -> Column:
        plain = ~has(x, _PARTY_BAD) & ~x.rlike(r"\d") & ~has(x, r"\bcustomer\b$") & ~has(x, "^(bill|code|sold|from|ship|remit|name)$") & F.length(x).between(2, 80)
        return F.coalesce(extract(x, f"({P.EMAIL})"), F.when(plain & ~has(x, P.BAD_RECIPIENT_COUNTRY), x))

    return let(s, ok)


def recipient(rows: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, recipient_name): labelled value or the three rows after it; else a name in capitals; else the best short line."""
    anchors = rows.filter(has(F.col("text"), f"({_PARTY})"))
    own = let(_party_value(F.col("text")), lambda x: F.when(F.lower(x) != F.lower("text"), x))
    here = anchors.select(key, F.col("line_idx").alias("a_idx"), F.lit(0).alias("k"), own.alias("v"))
    after = _following(rows, anchors, 3, key).select(key, "a_idx", "k", _party_value(F.col("text")).alias("v"))
    labelled = here.unionByName(after).filter("v IS NOT NULL").groupBy(key).agg(F.min_by("v", F.struct("a_idx", "k")).alias("v1"))
    page = rows.groupBy(key).agg(F.max("top").alias("max_top"))
    r = rows.join(page, key)
    bare = strip(F.regexp_replace("text", r"\s*\([A-Z ]+\)\s*$", ""))
    caps = r.filter((F.col("line_idx") < 40) & (F.col("top") <= F.col("max_top") * 0.60)).withColumn("b", bare)
    caps = caps.filter(F.col("b").rlike(P.ALL_CAPS_NAME) & ~has(F.col("b"), _PARTY_BAD) & ~strong_company(F.col("b")) & ~has(F.col("b"), P.ALL_CAPS_STOP))
    second = caps.groupBy(key).agg(F.min_by("b", "line_idx").alias("v2"))
    nxt = rows.select(key, (F.col("line_idx") - 1).alias("line_idx"), F.col("text").rlike(r"\d").alias("address"))
    t = F.col("text")
    short = r.filter((F.col("line_idx") < 25) & (F.col("top") <= F.col("max_top") * 0.55) & ~has(t, _PARTY_BAD) & ~strong_company(t) & ~t.rlike(r"\d"))
    short = short.filter(F.length(t).between(3, 60) & token_count(t).between(1, 5)).join(nxt, [key, "line_idx"], "left")
    pts = F.when(F.col("address"), 2).otherwise(0) + (is_upper(t) | is_title(t)).cast("int") + (token_count(t) <= 4).cast("int")
    third = short.withColumn("s", pts).filter("s > 0").groupBy(key).agg(F.min_by("text", F.struct((-F.col("s")).alias("s"), "line_idx")).alias("v3"))
    out = page.select(key).join(labelled, key, "left").join(second, key, "left").join(third, key, "left")
    return out.select(key, F.coalesce("v1", "v2", "v3").alias("recipient_name"))


def issuer(rows: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, issuer_name): by a seller label, else the best company-like row above the recipient's label."""
    anchored = layout.band_issuer(rows, key).withColumnRenamed("issuer_name", "v1")
    first = rows.filter(has(F.col("text"), f"({_PARTY})")).groupBy(key).agg(F.greatest(F.min("line_idx"), F.lit(1)).alias("stop"))
    head = rows.filter("line_idx < 30").join(first, key, "left").filter("stop IS NULL OR line_idx < stop")
    c = head.withColumn("c", layout.clean_company(F.col("text"))).filter(F.col("c").isNotNull() & strong_company(F.col("c")))
    x = F.col("c")
    pts = (
        F.when(has(x, P.V5_COMPANY), 3).otherwise(0) + (is_upper(x) | is_title(x)).cast("int") + (token_count(x) <= 5).cast("int")
        + F.greatest(F.lit(0.0), 3 - F.col("line_idx") * 0.2)
    )
    second = c.groupBy(key).agg(F.min_by("c", F.struct((-pts).alias("s"), F.length("c").alias("n"), "line_idx")).alias("v2"))
    return rows.select(key).distinct().join(anchored, key, "left").join(second, key, "left").select(key, F.coalesce("v1", "v2").alias("issuer_name"))


def rescue(df: DataFrame, rows: DataFrame, text: str = "raw_text", key: str = "file_stem", entities=None) -> DataFrame:
    """Fields of plain text completed from rows.

    A missing or date-like number, missing dates, an implausible recipient or issuer are replaced; a total is replaced
    by one over 5 % and 1 greater, or by any greater one if it is under 5. ``entities``: optional hook, DataFrame ->
    DataFrame, for names from entity recognition where the issuer or recipient is still implausible.
    """
    parts = {
        "invoice_number": number(rows, key), "invoice_date": invoice_date(rows, key), "due_date": due_date(rows, key),
        "total_amount": layout.rows_total(rows, key), "recipient_name": recipient(rows, key), "issuer_name": issuer(rows, key),
    }
    for f, part in parts.items():
        df = df.join(part.withColumnRenamed(f, f"_o_{f}"), key, "left")
    c, o = F.col, lambda f: F.col(f"_o_{f}")
    old, new = c("total_amount").cast("double"), o("total_amount").cast("double")
    greater = ((new > old * 1.05) & (new - old >= 1.0)) | ((old < 5.0) & (new > old))
    df = df.withColumns(
        {
            "invoice_number": F.when(c("invoice_number").isNull() | dates.looks_like_date(c("invoice_number")), F.coalesce(o("invoice_number"), "invoice_number")).otherwise(c("invoice_number")),
            "invoice_date": F.coalesce("invoice_date", o("invoice_date")),
            "total_amount": F.when(old.isNull() | greater, F.coalesce(o("total_amount"), "total_amount")).otherwise(c("total_amount")),
            "recipient_name": F.when(bad_recipient(c("recipient_name")) & ~bad_recipient(o("recipient_name")), o("recipient_name")).otherwise(c("recipient_name")),
            "issuer_name": F.when(
                o("issuer_name").isNotNull() & (bad_issuer(c("issuer_name")) | (strong_company(o("issuer_name")) & ~strong_company(c("issuer_name")))), o("issuer_name")
            ).otherwise(c("issuer_name")),
        }
    )
    df = df.withColumn("due_date", F.coalesce("due_date", F.when(~o("due_date").eqNullSafe(c("invoice_date")), o("due_date"))))
    df = df.withColumn("issuer_name", strip_issuer_prefix(c("issuer_name"))).drop(*[f"_o_{f}" for f in parts])
    if entities is not None:
        df = entities(df)
    df = df.withColumn("issuer_name", F.when(bad_issuer(c("issuer_name")), email_domain_issuer(c(text))).otherwise(c("issuer_name")))
    return df.withColumns(
        {"issuer_name": F.when(~bad_issuer(c("issuer_name")), c("issuer_name")), "recipient_name": F.when(~bad_recipient(c("recipient_name")), c("recipient_name"))}
    )
