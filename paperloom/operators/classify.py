"""Document class by weighted keywords, invoice signals, and the gate for field extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import count_of, empty
from paperloom.operators.patterns import CLASSES, KEYWORDS, SIGNALS, STRONG_SIGNALS
from paperloom.operators.rules import weighted_count


def keyword_scores(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """``score_<class>`` columns; null text scores 0."""
    low = F.lower(empty(F.col(text)))
    return df.withColumns({f"score_{c}": weighted_count(low, KEYWORDS[c]).cast("int") for c in CLASSES})


def keyword_classify(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``predicted_class``, ``confidence`` (map, four places) and ``method``.

    The greatest score wins, the first class on ties; without any hit the class is form at 0.25 each.
    """
    scored = keyword_scores(df, text)
    scores = [F.col(f"score_{c}") for c in CLASSES]
    total = sum(scores[1:], scores[0])
    top = F.greatest(*scores)
    predicted = F.lit(CLASSES[-1])
    for c in reversed(CLASSES[:-1]):
        predicted = F.when(F.col(f"score_{c}") == top, c).otherwise(predicted)
    share = lambda c: F.when(F.col("score_total") == 0, 0.25).otherwise(F.round(F.col(f"score_{c}") / F.col("score_total"), 4))
    return (
        scored.withColumn("score_total", total)
        .withColumn("predicted_class", F.when(F.col("score_total") == 0, "form").otherwise(predicted))
        .withColumn("confidence", F.create_map(*[x for c in CLASSES for x in (F.lit(c), share(c))]))
        .withColumn("method", F.lit("keyword_fallback"))
        .drop("score_total", *[f"score_{c}" for c in CLASSES])
    )


def invoice_signals(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``signals``: score, matches (signal, count, weight), strong_anchor_count, should_override."""
    low = F.lower(empty(F.col(text)))
    counts = {f"_n_{name}": count_of(low, p).cast("int") for name, p, _ in SIGNALS}
    df = df.withColumns(counts)
    score = sum((F.col(f"_n_{name}") * w for name, _, w in SIGNALS), F.lit(0)).cast("int")
    anchors = sum(((F.col(f"_n_{name}") > 0).cast("int") for name in STRONG_SIGNALS), F.lit(0)).cast("int")
    matches = F.filter(
        F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"_n_{n}").alias("count"), F.lit(w).alias("weight")) for n, _, w in SIGNALS]),
        lambda x: x["count"] > 0,
    )
    override = ((score >= 6) & (anchors >= 2)) | (score >= 10)
    signals = F.struct(score.alias("score"), matches.alias("matches"), anchors.alias("strong_anchor_count"), override.alias("should_override"))
    return df.withColumn("signals", signals).drop(*counts)


def extraction_gate(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``run_extraction``, ``reason`` and ``invoice_confidence`` to classified documents with signals.

    Both inputs are columns of the same row, so text is scanned once and nothing is joined.
    """
    if "predicted_class" not in df.columns:
        df = keyword_classify(df, text)
    if "signals" not in df.columns:
        df = invoice_signals(df, text)
    invoice = F.col("predicted_class") == "invoice"
    override = F.col("signals.should_override")
    return df.withColumns(
        {
            "run_extraction": invoice | override,
            "reason": F.when(invoice, "predicted_invoice").when(override, "invoice_override").otherwise("not_invoice"),
            "invoice_confidence": F.col("confidence")["invoice"],
        }
    )


def confidence_of(predicted: Column, confidence: Column) -> Column:
    """Confidence of the predicted class."""
    return F.element_at(confidence, predicted)


def classify(df: DataFrame, model=None, text: str = "raw_text") -> DataFrame:
    """A fitted model if there is one, else keywords."""
    return model.transform(df) if model is not None else keyword_classify(df, text)
