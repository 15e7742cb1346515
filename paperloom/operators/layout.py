"""Extraction from recognised words with their places: lines, zones, column gaps, scored lines.

Words: a document key, text, left, top, width, height, conf, block_num, par_num, line_num, word_num. Repeated rows count
once; blank and null texts are dropped; a null confidence is -1. Groups are single lines of a document, so no group
grows with the data; best lines are picked by aggregation, not by sorting documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import amounts, dates
from paperloom.functions.text import clean_name, count_of, digits, has, let, post_ocr_cleanup, squash, strip, token_count
from paperloom.operators import baseline as B
from paperloom.operators import patterns as P
from paperloom.operators.regex_fields import strong_company
from paperloom.operators.rules import any_of, extract, first_match

LINE_KEY = ["block_num", "par_num", "line_num"]


def words(boxes: DataFrame, key: str = "file_stem", left: str = "left_px", top: str = "top_px") -> DataFrame:
    """Usable words under common names, each once."""
    return (
        boxes.select(key, "text", F.col(left).alias("left"), F.col(top).alias("top"), "width", "height", "conf", *LINE_KEY, "word_num")
        .filter(F.trim(F.coalesce("text", F.lit(""))) != "")
        .withColumn("conf", F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)))
        .distinct()
    )


def to_lines(w: DataFrame, key: str = "file_stem") -> DataFrame:
    """One row a line: text in reading order, outline, mean confidence (summed exactly, so that order doesn't matter)."""
    items = F.array_sort(F.collect_list(F.struct("left", "word_num", "text")))
    lines = w.groupBy(key, *LINE_KEY).agg(
        F.array_join(F.transform(items, lambda x: F.trim(x["text"])), " ").alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        (F.sum(F.col("conf").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("conf"),
    )
    return lines.withColumns({"width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top")})


def zones(lines: DataFrame, key: str = "file_stem") -> DataFrame:
    """Adds x_rel, y_rel and the zone flags; the page is as wide and high as its words reach."""
    page = lines.groupBy(key).agg(
        F.greatest(F.max("right"), F.lit(1)).alias("page_w"), F.greatest(F.max("bottom"), F.lit(1)).alias("page_h")
    )
    return (
        lines.join(page, key)
        .withColumns({"x_rel": F.col("left") / F.col("page_w"), "y_rel": F.col("top") / F.col("page_h")})
        .withColumns(
            {
                "is_header": F.col("y_rel") < 0.25,
                "is_middle": (F.col("y_rel") >= 0.25) & (F.col("y_rel") < 0.70),
                "is_bottom": F.col("y_rel") >= 0.70,
                "is_left_half": F.col("x_rel") < 0.5,
                "is_right_half": F.col("x_rel") >= 0.5,
            }
        )
    )


def _first(score: Column) -> Column:
    """Sort key: best score, then reading order; the least is wanted."""
    return F.struct((-score).alias("s"), "top", "left", *LINE_KEY)


def best(lines: DataFrame, score: Column, key: str, value: str = "text") -> DataFrame:
    """(key, value, score) of the best line, the first in reading order on ties."""
    scored = lines.withColumn("_score", score).withColumn("_key", _first(F.col("_score")))
    return scored.groupBy(key).agg(F.min_by(value, "_key").alias(value), F.max("_score").alias("score"))


def _pts(c: Column, n: int) -> Column:
    return F.when(c, n).otherwise(0)


def issuer_score() -> Column:
    t = F.col("text")
    return (
        _pts(B.bad_name(t), -10)
        + _pts(has(t, P.LAYOUT_COMPANY), 5)
        + _pts(F.col("y_rel") < 0.12, 3)
        + _pts(F.col("is_left_half"), 2)
        + _pts(digits(t) == 0, 1)
        + _pts(token_count(t).between(2, 8), 2)
    )


def issuer(zoned: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, issuer_name): best header line; null if it is no name."""
    found = best(zoned.filter("is_header"), issuer_score(), key)
    name = clean_name(F.col("text"))
    ok = lambda x: F.when((x != "") & ~has(x, r"\b(pay to|reference|explanation|client copy|check request)\b") & (digits(x) <= 5), x)
    return found.select(key, let(name, ok).alias("issuer_name"))


def recipient_score(issuer_name: Column) -> Column:
    t = F.col("text")
    low = F.lower(t)
    return (
        _pts(F.coalesce(F.lower(issuer_name) == low, F.lit(False)), -10)
        + _pts(has(low, r"\b(bill to|sold to|ship to|to:)\b"), 4)
        + _pts(has(low, r"\b(attention|attn)\b"), 2)
        + _pts(has(t, P.LAYOUT_COMPANY), 7)
        + _pts(has(low, r"\b(street|avenue|road|suite|floor|telephone|fax|telex)\b"), -3)
        + _pts(has(low, r"\b(remit to|reference|explanation|client copy)\b"), -5)
        + _pts(digits(t) > 6, -3)
        + _pts(token_count(t).between(2, 8), 2)
        + _pts(has(low, r"\b(pay to|remit to|reference|explanation|client copy|check request)\b"), -7)
        + _pts(has(t, r"^(mr|mrs|ms|dr)\.?\b"), 1)
    )


_BAD_RECIPIENT = [r"\b(remit to|reference|explanation|client copy|check request)\b", r"\b(street|avenue|road|suite|floor|telephone|fax|telex)\b", r"^\s*(pay to)\b"]


def recipient(zoned: DataFrame, issuers: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, recipient_name): best line of the left half above the bottom."""
    cands = zoned.filter("(is_header OR is_middle) AND is_left_half").join(issuers, key, "left")
    cands = cands.withColumn("_score", recipient_score(F.col("issuer_name")))
    found = cands.withColumn("_key", _first(F.col("_score"))).groupBy(key).agg(
        F.min_by("text", "_key").alias("text"), F.first("issuer_name").alias("issuer_name")
    )
    name = clean_name(F.regexp_replace("text", r"(?iU)^(attention|attn)\s*:\s*", ""))
    same = lambda x: F.coalesce(F.lower(x) == F.lower("issuer_name"), F.lit(False))
    ok = lambda x: F.when((x != "") & ~same(x) & ~any_of(F.lower(x), _BAD_RECIPIENT) & (digits(x) <= 5), x)
    return found.select(key, let(name, ok).alias("recipient_name"))


def total(zoned: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, total_amount): best-scored amount of at least 10 at the bottom or right, else anywhere."""
    low = F.lower("text")
    strong, weak = has(low, P.STRONG_TOTAL), has(low, r"\btotal\b")
    place = F.coalesce(F.col("is_bottom") | F.col("is_right_half"), F.lit(False))
    raw = F.regexp_extract_all("text", F.lit(P.AMOUNT), F.lit(1))
    marked = zoned.withColumns({"_strong": strong, "_weak": weak, "_place": place})
    each = marked.select("*", F.posexplode(F.transform(raw, amounts.normalise)).alias("_n", "_amount"))
    each = each.withColumn("_value", F.col("_amount").cast("double")).filter("_value >= 10")
    score = (
        F.when(F.col("_strong"), 10).when(F.col("_weak"), 5).otherwise(-2)
        + _pts(F.col("is_bottom"), 2)
        + _pts(F.col("is_right_half"), 2)
        - _pts((F.col("_value") > 100000) & ~F.col("_strong"), 6)
        + _pts(count_of(F.col("text"), r"\.") > 8, 1)
    )
    order = F.struct((~F.col("_place")).alias("p"), (-score).alias("s"), "top", "left", *LINE_KEY, "_n")
    return each.withColumn("_key", order).groupBy(key).agg(F.min_by("_amount", "_key").alias("total_amount"))


def _first_value(lines: DataFrame, value: Column, key: str, name: str) -> DataFrame:
    """(key, name): first non-null value in reading order."""
    order = F.struct("top", "left", *LINE_KEY)
    return lines.withColumn("_v", value).filter("_v IS NOT NULL").withColumn("_key", order).groupBy(key).agg(F.min_by("_v", "_key").alias(name))


_DATE = r"(\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
_TERMS = r"\b(net\s*\d{1,3}(?:\s*days?)?|due\s+upon\s+receipt|cash\s+\d+\s*days?|cod)\b"


def number(zoned: DataFrame, key: str = "file_stem") -> DataFrame:
    value = first_match(F.col("text"), P.BASELINE_NUMBER[:4], lambda v: F.when(B.valid_number(v), v))
    return _first_value(zoned.filter("is_header"), value, key, "invoice_number")


def invoice_date(zoned: DataFrame, key: str = "file_stem") -> DataFrame:
    labelled = has(F.col("text"), r"\b(date|invoice date|dated)\b")
    return _first_value(zoned.filter("is_header"), F.when(labelled, dates.parse_baseline(extract(F.col("text"), _DATE))), key, "invoice_date")


def due_date(zoned: DataFrame, key: str = "file_stem") -> DataFrame:
    labelled = has(F.col("text"), r"\b(due date|payment due|due)\b")
    return _first_value(zoned, F.when(labelled, dates.parse_baseline(extract(F.col("text"), _DATE))), key, "due_date")


def terms(zoned: DataFrame, key: str = "file_stem") -> DataFrame:
    return _first_value(zoned, extract(F.col("text"), _TERMS), key, "payment_terms")


def extract_fields(documents: DataFrame, boxes: DataFrame, text: str = "raw_text", key: str = "file_stem") -> DataFrame:
    """Documents (with ``key``) with fields from layout, four of them backfilled from the baseline.

    Documents that aren't invoice-like have no layout fields; layout_confidence follows the number found.
    """
    base = B.extract_fields(documents, text)
    gate = base.filter("invoice_like_score > 0").select(key).distinct()
    zoned = zones(to_lines(words(boxes, key).join(gate, key, "left_semi"), key), key)
    issuers = issuer(zoned, key)
    parts = [issuers, recipient(zoned, issuers, key), number(zoned, key), invoice_date(zoned, key), due_date(zoned, key), terms(zoned, key), total(zoned, key)]
    seen = zoned.select(key).distinct().withColumn("_seen", F.lit(True))
    out = base.withColumnsRenamed({k: f"_base_{k}" for k in [*B.FIELDS, "payment_terms"]}).join(seen, key, "left")
    for p in parts:
        out = out.join(p, key, "left")
    for k in ("invoice_number", "invoice_date", "due_date", "payment_terms"):
        out = out.withColumn(k, F.when(F.col("_seen"), F.coalesce(k, f"_base_{k}")))
    found = sum((F.col(k).isNotNull().cast("int") for k in B.FIELDS), F.lit(0))
    level = F.when(found >= 4, "high").when(found >= 2, "medium").otherwise("low")
    out = out.withColumn("layout_confidence", F.when(F.col("invoice_like_score") <= 0, "low").when(F.col("_seen"), level).otherwise("none"))
    out = out.withColumns(B.validate({k: F.col(k) for k in B.FIELDS}))
    return out.drop("_seen", *[f"_base_{k}" for k in [*B.FIELDS, "payment_terms"]])


# Lines split at wide gaps, and extraction from them --------------------------------------------------------------


def gap_split(w: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, line_idx, top, left, text): lines split where the gap between words exceeds max(140, 8 % of the page)."""
    page = w.groupBy(key).agg(F.max(F.col("left") + F.col("width")).alias("page_w"))
    line = Window.partitionBy(key, *LINE_KEY).orderBy("left", "word_num", "text")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(line)
    wide = gap > F.greatest(F.lit(140), F.floor(F.col("page_w") * 0.08))
    # Numbering of pieces is a running sum within one line; the line's top is its least.
    pieces = (
        w.join(page, key)
        .withColumn("_new", F.coalesce(wide, F.lit(False)).cast("int"))
        .withColumn("_piece", F.sum("_new").over(line))
        .groupBy(key, *LINE_KEY, "_piece")
        .agg(
            F.min("left").alias("left"),
            F.min("top").alias("_top"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word_num", "text"))), lambda x: F.trim(x["text"])), " ").alias("text"),
        )
        .withColumn("top", F.min("_top").over(Window.partitionBy(key, *LINE_KEY)))
        .withColumn("_line_left", F.min("left").over(Window.partitionBy(key, *LINE_KEY)))
    )
    text = post_ocr_cleanup(squash(F.col("text")))
    order = Window.partitionBy(key).orderBy("top", "_line_left", *LINE_KEY, "_piece")
    return (
        pieces.withColumn("text", text)
        .filter((F.col("text") != "") & ~has(F.col("text"), "(translated from .* to .*|onlinedoc|onlinedoctranslator|translator)"))
        .select(key, (F.row_number().over(order) - 1).alias("line_idx"), "top", "left", "text")
    )


_SELLER = (
    r"(vendor|seller|supplier|from|issued\s+by|billed\s+from|merchant|provider|proveedor|emitido\s+por|fournisseur|"
    r"declared\s+by|sold\s+by|vat\s+has\s+been\s+declared\s+by)"
)
_COMPANY_BAD = (
    r"(spanish to english|onlinedoc|onlinedoctranslator|translation|translated by|www\.|http|@|supplier code|badge|data|details|"
    r"date|due|total|subtotal|amount|balance|vat|tax|phone|tel|fax|bank|swift|iban)"
)


def clean_company(c: Column) -> Column:
    """A company name without document words around it; null if it holds anything that isn't a name."""
    s = F.regexp_replace(c, r"(?iU)^\s*(?:tax\s+invoice|commercial\s+invoice|invoice|original|copy|bill)\s*[:\-]?\s*", "")
    s = F.get(F.split(s, r"(?i)\b(?:ORIGINAL|Billing information|Invoice recipient|Customer data|Billing address|Mailing address)\b", 2), F.lit(0))
    s = F.trim(squash(s), F.lit(" -:|,;"))
    ok = lambda x: F.when(
        (x != "")
        & ~has(x, _COMPANY_BAD)
        & ~F.lower(x).isin("bill", "paid", "code", "no")
        & ~has(x, "^(united states|spain|españa|france|ecuador|ireland|germany|netherlands)$")
        & (digits(x) / F.length(x) <= 0.12),
        x,
    )
    return let(s, ok)


def band_issuer(rows: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, issuer_name): company beside, on or below a seller label.

    A band join: pieces within 18 pixels of the label's height and over 60 to its right. Joined on the document and
    the band of 18 pixels (and its neighbours), so that a page's pieces are not all compared with each other.
    """
    anchors = rows.filter(has(F.col("text"), _SELLER) & (F.col("line_idx") < 35)).select(
        key, F.col("top").alias("a_top"), F.col("left").alias("a_left"), F.col("line_idx").alias("a_idx"), F.col("text").alias("a_text")
    )
    band = F.floor(F.col("a_top") / 18)
    near = anchors.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    beside = (
        rows.withColumn("band", F.floor(F.col("top") / 18))
        .join(near, [key, "band"])
        .filter((F.abs(F.col("top") - F.col("a_top")) <= 18) & (F.col("left") > F.col("a_left") + 60))
        .select(key, F.lit(8).alias("base"), clean_company(F.col("text")).alias("name"))
    )
    own = anchors.select(
        key, F.lit(7).alias("base"), clean_company(strip(F.regexp_replace("a_text", rf"(?iU)^(?:{_SELLER})\s*[:\-]?\s*", ""))).alias("name")
    )
    below = (
        rows.join(anchors.select(key, "a_idx", F.explode(F.array(F.col("a_idx") + 1, F.col("a_idx") + 2)).alias("line_idx")), [key, "line_idx"])
        .select(key, F.lit(6).alias("base"), clean_company(F.col("text")).alias("name"))
    )
    cands = beside.unionByName(own).unionByName(below).filter(F.col("name").isNotNull() & strong_company(F.col("name")))
    order = F.struct((-(F.col("base") + _pts(has(F.col("name"), P.V5_COMPANY), 2))).alias("s"), F.length("name").alias("n"), "name")
    return cands.withColumn("_key", order).groupBy(key).agg(F.min_by("name", "_key").alias("issuer_name"))


_TOTAL_STRONG = (
    r"(total\s+amount\s+due|amount\s+due|balance\s+due|grand\s+total|total\s+invoice\s+value|net\s+amount\s+due|total\s+to\s+pay|"
    r"total\s+including\s+taxes|total\s+invoice|total\s*\(?eur\)?|total\s+fra|importe\s+total|montant\s+total|total\s+ttc|total\s+price|total\b)"
)
_TOTAL_WEAK = (
    r"(unit\s+price|vat\s+excluded|excluding|base|taxes\s+see\s+the\s+rates|net\s+amount|subtotal|discount|shipment|price\s+unitary|"
    r"unitary\s+price|vat\s*%|tax\s*%|re\s+quota)"
)


def rows_total(rows: DataFrame, key: str = "file_stem") -> DataFrame:
    """(key, total_amount): greatest amount of the best total row, else the greatest with cents in the bottom part."""
    page = rows.groupBy(key).agg(F.max("top").alias("max_top"))
    r = rows.join(page, key).filter(~has(F.col("text"), _TOTAL_WEAK))
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"((?:[$€£¥]\s*)?\d[\d.,]{0,20}\d)"), F.lit(1)), amounts.normalise_v5), lambda x: x.isNotNull())
    amount = F.array_max(F.transform(found, lambda x: x.cast("double")))
    score = (
        F.when(has(F.col("text"), r"(grand\s+total|amount\s+due|balance\s+due|total\s+to\s+pay|total\s+ttc|importe\s+total)"), 4).otherwise(2)
        + _pts(F.col("top") > F.col("max_top") * 0.45, 2)
        + _pts(F.col("top") > F.col("max_top") * 0.65, 1)
    )
    labelled = r.filter(has(F.col("text"), _TOTAL_STRONG)).withColumn("_amount", amount).filter("_amount IS NOT NULL")
    first = labelled.groupBy(key).agg(F.max(F.struct(score.alias("s"), F.col("top").alias("t"), F.col("_amount").alias("a"))).alias("best"))
    cents = F.transform(F.regexp_extract_all("text", F.lit(r"((?<!\d)(?:[$€£¥]\s*)?\d{1,6}[.,]\d{2}(?!\d))"), F.lit(1)), lambda x: amounts.normalise_v5(x).cast("double"))
    low = r.filter(F.col("top") >= F.col("max_top") * 0.60).select(key, F.explode(cents).alias("v")).filter("v >= 1 AND v < 1000000")
    second = low.groupBy(key).agg(F.max("v").alias("v"))
    found = page.select(key).join(first, key, "left").join(second, key, "left").select(key, F.coalesce("best.a", "v").alias("a"))
    return found.filter("a IS NOT NULL").select(key, F.format_string("%.2f", "a").alias("total_amount"))  # %.2f makes "nu" of null
