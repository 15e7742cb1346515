"""Keyword classification, signals, gate, and the metrics of the keyword classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import classify, evaluate
from paperloom.operators.patterns import CLASSES, KEYWORDS, SIGNALS, STRONG_SIGNALS
from paperloom.plans import sql as S
from paperloom.plans.base import raw
from paperloom.plans.registry import query

_SCORES = f"SELECT *, {', '.join(f'{S.weighted("t", KEYWORDS[c])} AS s_{c}' for c in CLASSES)} FROM (SELECT doc_id, label, lower(coalesce(raw_text, '')) AS t FROM {S.RAW})"
_TOP = "greatest(" + ", ".join(f"s_{c}" for c in CLASSES) + ")"
_SUM = " + ".join(f"s_{c}" for c in CLASSES)
_CLASS = "CASE WHEN total = 0 THEN 'form' " + " ".join(f"WHEN s_{c} = {_TOP} THEN '{c}'" for c in CLASSES) + " END"
_KEYWORD = (
    f"SELECT doc_id, label, t, {_CLASS} AS predicted_class, "
    + ", ".join(f"CASE WHEN total = 0 THEN 0.25 ELSE round(s_{c} / total, 4) END AS conf_{c}" for c in CLASSES)
    + f" FROM (SELECT *, {_SUM} AS total FROM ({_SCORES}))"
)


@query(f"SELECT doc_id, predicted_class, {', '.join(f'conf_{c}' for c in CLASSES)} FROM ({_KEYWORD})")
def keyword_classify(spark, d):
    df = classify.keyword_classify(raw(spark, d))
    return df.select("doc_id", "predicted_class", *[F.col("confidence")[c].alias(f"conf_{c}") for c in CLASSES])


_N = ", ".join(f"{S.count('t', p)} AS n_{name}" for name, p, _ in SIGNALS)
_SIGNALS = (
    f"SELECT *, CAST({' + '.join(f'n_{n} * {w}' for n, _, w in SIGNALS)} AS INT) AS score, CAST({' + '.join(f'CAST(n_{n} > 0 AS INT)' for n in STRONG_SIGNALS)} AS INT) AS anchors "
    f"FROM (SELECT *, {_N} FROM ({_KEYWORD}))"
)
_OVERRIDE = "((score >= 6 AND anchors >= 2) OR score >= 10)"


@query(f"SELECT doc_id, score, anchors AS strong_anchor_count, {_OVERRIDE} AS should_override FROM ({_SIGNALS})")
def invoice_signals(spark, d):
    return classify.invoice_signals(raw(spark, d)).select("doc_id", "signals.score", "signals.strong_anchor_count", "signals.should_override")


@query(
    "SELECT signal, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(CAST(n > 0 AS INT)) AS BIGINT) AS docs FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS signal, {S.count('lower(raw_text)', p)} AS n FROM {S.RAW} WHERE raw_text IS NOT NULL" for n, p, _ in SIGNALS)
    + ") GROUP BY signal HAVING sum(n) > 0"
)
def signal_counts(spark, d):
    df = classify.invoice_signals(raw(spark, d)).select(F.explode("signals.matches").alias("m"))
    return df.groupBy("m.signal").agg(F.sum("m.count").alias("occurrences"), F.count("*").alias("docs"))


_REASON = f"CASE WHEN predicted_class = 'invoice' THEN 'predicted_invoice' WHEN {_OVERRIDE} THEN 'invoice_override' ELSE 'not_invoice' END"


@query(f"SELECT predicted_class, reason, count(*) AS n FROM (SELECT predicted_class, {_REASON} AS reason FROM ({_SIGNALS})) GROUP BY ALL")
def extraction_gate(spark, d):
    return classify.extraction_gate(raw(spark, d)).groupBy("predicted_class", "reason").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_REASON} <> 'not_invoice' AS run_extraction, {_REASON} AS reason, conf_invoice AS invoice_confidence FROM ({_SIGNALS})")
def gate_decisions(spark, d):
    return classify.extraction_gate(raw(spark, d)).select("doc_id", "run_extraction", "reason", "invoice_confidence")


@query(
    f"SELECT label, count(*) AS docs, CAST(sum(CAST(predicted_class = 'invoice' AS INT)) AS BIGINT) AS before_override, "
    f"CAST(sum(CAST(predicted_class = 'invoice' OR {_OVERRIDE} AS INT)) AS BIGINT) AS after_override FROM ({_SIGNALS}) GROUP BY label"
)
def gate_override_counts(spark, d):
    """What the override adds, by true class."""
    df = classify.extraction_gate(raw(spark, d))
    return df.groupBy("label").agg(
        F.count("*").alias("docs"), F.sum((F.col("predicted_class") == "invoice").cast("int")).alias("before_override"), F.sum(F.col("run_extraction").cast("int")).alias("after_override")
    )


@query(f"SELECT doc_id, predicted_class, CASE predicted_class {' '.join(f"WHEN '{c}' THEN conf_{c}" for c in CLASSES)} END AS top_confidence FROM ({_KEYWORD})")
def top_class_confidence(spark, d):
    df = classify.keyword_classify(raw(spark, d))
    return df.select("doc_id", "predicted_class", classify.confidence_of(F.col("predicted_class"), F.col("confidence")).alias("top_confidence"))


_GRID = (
    f"SELECT g.a AS true_class, g.b AS predicted_class, count(k.doc_id) AS n FROM (SELECT unnest({CLASSES}) AS a, unnest({CLASSES}) AS c) x "
    f"JOIN (SELECT a, b FROM (SELECT unnest({CLASSES}) AS a), (SELECT unnest({CLASSES}) AS b)) g ON x.a = g.a "
    f"LEFT JOIN ({_KEYWORD}) k ON k.label = g.a AND k.predicted_class = g.b GROUP BY ALL"
)


def _matrix(spark, d):
    return evaluate.confusion(classify.keyword_classify(raw(spark, d)), CLASSES)


@query(_GRID)
def confusion_matrix(spark, d):
    return _matrix(spark, d)


_METRICS = (
    f"SELECT class, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM ("
    f"SELECT c AS class, (SELECT sum(n) FROM m WHERE true_class = c) AS support, (SELECT sum(n) FROM m WHERE predicted_class = c) AS predicted, "
    f"(SELECT sum(n) FROM m WHERE true_class = c AND predicted_class = c) AS tp FROM (SELECT unnest({CLASSES}) AS c))"
)
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END"


@query(f"WITH m AS ({_GRID}) SELECT class, CAST(support AS BIGINT) AS support, round(p, 4) AS precision, round(r, 4) AS recall, round({_F1}, 4) AS f1 FROM ({_METRICS})")
def prf_metrics(spark, d):
    return evaluate.class_metrics(_matrix(spark, d))


@query(
    f"WITH m AS ({_GRID}) SELECT round(sum(tp) / sum(support), 4) AS accuracy, round(avg({_F1}), 4) AS macro_f1, "
    f"round(sum({_F1} * support) / sum(support), 4) AS weighted_f1 FROM ({_METRICS})"
)
def average_metrics(spark, d):
    return evaluate.averages(_matrix(spark, d))


@query(f"SELECT label AS true_class, predicted_class, count(*) AS n FROM ({_KEYWORD}) WHERE label <> predicted_class GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 10")
def confusion_pairs(spark, d):
    return evaluate.confusion_pairs(classify.keyword_classify(raw(spark, d)))


@query(f"SELECT doc_id, label, predicted_class, substring(t, 1, 80) AS snippet FROM ({_KEYWORD}) WHERE label <> predicted_class")
def misclassified(spark, d):
    df = classify.keyword_classify(raw(spark, d))
    return evaluate.misclassified(df.select("doc_id", "label", "predicted_class", F.substring(F.lower(F.coalesce("raw_text", F.lit(""))), 1, 80).alias("snippet")))
