"""Lines as training rows: labels from gold values, features, and value parsers."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import amounts, boxes, dates
from paperloom.functions import text as X
from paperloom.operators.models import char_grams
from paperloom.operators.rules import extract

FIELDS = ["recipient_name", "invoice_number", "total_amount"]
# Fixed values.
_NUMBER = [
    r"(?:invoice|invoice\s*number|invoice\s*no|invoice\s*#|inv\s*#|inv\s*no)\s*[:#-]?\s*([A-Z0-9][A-Z0-9/_\-]{2,31})",
    r"\b([A-Z]{2,}[A-Z0-9/_\-]{2,31}\d[A-Z0-9/_\-]*)\b",
    r"\b([A-Z0-9]{3,}[/-][A-Z0-9/_\-]{2,31})\b",
    r"\b([A-Z0-9]{5,32})\b",
]
_PARTY = r"(?iU)^(bill\s*to|buyer|customer|client|ship\s*to|to|from|vendor|seller)\s*[:\-]?\s*"


def number_of(line: Column) -> Column:
    return F.coalesce(*[X.let(extract(line, p), lambda v: F.when(v.rlike(r"\d"), v)) for p in _NUMBER])


def amount_of(line: Column) -> Column:
    """The last amount of a line."""
    found = F.regexp_extract_all(line, F.lit(r"((?:[$€£¥]\s*)?\d[\d.,]{0,20}\d)"), F.lit(1))
    return amounts.normalise_line(F.when(F.size(found) > 0, F.element_at(found, -1)))


def party_of(line: Column) -> Column:
    s = F.trim(X.squash(X.strip(F.regexp_replace(line, _PARTY, ""))), F.lit(" -:|"))
    return X.let(s, lambda v: F.when(F.length(v) >= 3, v))


def date_of(line: Column) -> Column:
    return dates.parse_line(line)


def positive(line_text: Column, gold_text: Column, line_box: boxes.Box | None = None, gold_box: boxes.Box | None = None, text_only: bool = False) -> Column:
    """A line is positive if its text matches the gold text, or its box overlaps the gold box enough."""
    a, b = X.box_text(line_text), X.box_text(gold_text)
    hit = X.contains_either_way(a, b)
    if gold_box is not None and line_box is not None and not text_only:
        near = (boxes.iou(line_box, gold_box) >= 0.15) | (boxes.vertical_overlap(line_box, gold_box) >= 0.60)
        hit = hit | F.coalesce(near, F.lit(False))
    return F.coalesce(hit, F.lit(False))


def label_lines(zoned: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Lines of documents with gold values and a 0/1 column ``y_<field>`` for each field."""
    df = zoned.join(gold, key)
    y = {f"y_{f}": F.when(F.col(f).isNotNull(), positive(F.col("text"), F.col(f))).otherwise(False).cast("int") for f in FIELDS}
    return df.withColumns(y).select(key, "block_num", "par_num", "line_num", "text", F.round("x_rel", 4).alias("x_rel"), F.round("y_rel", 4).alias("y_rel"), *y)


TEXT_FLAGS = {
    "has_digit": r"\d",
    "has_currency": r"[$€£¥]",
    "has_date": r"\d{1,4}[/-]\d{1,2}[/-]\d{1,4}",
    "has_invoice": r"\binvoice\b",
    "has_total": r"\btotal\b",
    "has_due": r"\bdue\b",
    "has_to": r"\b(bill|ship|sold)\s*to\b",
}


def with_features(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds the text flags, the length and ``grams`` (character 3-5-grams)."""
    c = F.col(text)
    df = lines.withColumns({n: X.flag(c, p) for n, p in TEXT_FLAGS.items()})
    return char_grams(df.withColumn("text_len", F.length(c)), text)


def train(lines: DataFrame, field: str, size: int = 40_000):
    """Line ranker of a field: character grams, place and flags; balanced logistic regression (C = 2)."""
    df = lines.withColumn("label", F.col(f"y_{field}").cast("double"))
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    total = sum(counts.values())
    w = F.lit(1.0)
    for k, n in counts.items():
        w = F.when(F.col("label") == k, total / (len(counts) * n)).otherwise(w)
    gather = VectorAssembler(inputCols=["counts", "x_rel", "y_rel", "text_len", *TEXT_FLAGS], outputCol="features")
    lr = LogisticRegression(weightCol="_w", regParam=0.5 / max(total, 1), maxIter=50)
    return Pipeline(stages=[CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=size, minDF=2.0), gather, lr]).fit(df.withColumn("_w", w))


def best_lines(model, lines: DataFrame, key: str) -> DataFrame:
    """(key, text, score): the most probable line of each document, the first in reading order on ties."""
    scored = model.transform(lines).withColumn("_p", F.round(vector_to_array("probability")[1], 9))
    order = F.struct((-F.col("_p")).alias("p"), "y_rel", "x_rel", "block_num", "par_num", "line_num")
    return scored.groupBy(key).agg(F.min_by("text", order).alias("text"), F.max("_p").alias("score"))


def hybrid(from_lines: DataFrame, from_regex: DataFrame, key: str) -> DataFrame:
    """Dates prefer the line, other fields the regex; both sides have the field columns."""
    other = from_regex.withColumnsRenamed({c: f"_r_{c}" for c in from_regex.columns if c != key})
    df = from_lines.join(other, key, "full")
    first = {"invoice_date": "line"}
    cols = []
    for f in ("invoice_number", "invoice_date", "due_date", "recipient_name", "total_amount"):
        have = [c for c in (f, f"_r_{f}") if c in df.columns]
        cols.append(F.coalesce(*(have if first.get(f) == "line" else have[::-1])).alias(f))
    return df.select(key, *cols)
