"""Evaluation of extracted fields against gold values, and of classes against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.match import MATCHERS
from paperloom.session import computed_once


def unpivot(df: DataFrame, fields: Sequence[str], value: str, key: str = "doc_id") -> DataFrame:
    """(key, field, value): one row a field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value)) for f in fields]))
    return df.select(key, each.alias("x")).select(key, "x.*")


def detail(gold: DataFrame, predictions: DataFrame, method: str, fields: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(method, key, field, gold, predicted, correct): fields without a gold value are left out, missing predictions are wrong.

    ``skip_policy`` of documents that a gate dropped is the caller's: leave them out of ``gold``, or keep them to count
    as wrong.
    """
    g = unpivot(gold, fields, "gold", key).filter("gold IS NOT NULL")
    p = unpivot(predictions, fields, "predicted", key)
    joined = g.join(p, [key, "field"], "left")
    correct = F.lit(False)
    for f in fields:
        correct = F.when(F.col("field") == f, MATCHERS[f](F.col("gold"), F.col("predicted"))).otherwise(correct)
    return joined.select(F.lit(method).alias("method"), key, "field", "gold", "predicted", correct.cast("int").alias("correct"))


def summary(details: DataFrame) -> DataFrame:
    """(method, field, gold_docs, correct, accuracy, predicted, missed)."""
    return details.groupBy("method", "field").agg(
        F.count("*").alias("gold_docs"),
        F.sum("correct").alias("correct"),
        F.round(F.sum("correct") / F.count("*"), 4).alias("accuracy"),
        F.count("predicted").alias("predicted"),
        F.sum((F.coalesce("predicted", F.lit("")) == "").cast("int")).alias("missed"),
    )


def pivot(summaries: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row a method: accuracy of each field and their mean."""
    wide = summaries.groupBy("method").pivot("field", list(fields)).agg(F.first("accuracy"))
    n = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    total = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in fields), F.lit(0.0))
    return wide.withColumn("mean_accuracy", F.round(total / n, 4))


def overall(details: DataFrame) -> DataFrame:
    """(method, field, correct, total, accuracy) with a row OVERALL a method."""
    return (
        details.groupBy("method", "field").agg(F.sum("correct").alias("c"), F.count("*").alias("n"))
        .withColumn("field", F.explode(F.array("field", F.lit("OVERALL"))))
        .groupBy("method", "field")
        .agg(F.sum("c").alias("correct"), F.sum("n").alias("total"))
        .withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 4))
    )


def regressions(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, before, after) of the fields right before and wrong after."""
    b = before.select(key, "field", F.col("correct").alias("before"))
    a = after.select(key, "field", F.col("correct").alias("after"))
    return b.join(a, [key, "field"]).filter("after < before")


def coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, found, total, pct) of non-null values."""
    counts = df.agg(F.count("*").alias("total"), *[F.count(f).alias(f) for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("found")) for f in fields]))
    return counts.select("total", each.alias("x")).select("x.field", "x.found", "total", F.round(F.col("found") * 100 / F.col("total"), 1).alias("pct"))


def confusion(df: DataFrame, classes: Sequence[str], label: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """(true_class, predicted_class, n) over the full grid of classes (a few rows, made without a join)."""
    # Counted first, so that whatever computes the prediction runs once and only counts move.
    counts = df.groupBy(F.col(label).alias("_t"), F.col(predicted).alias("_p")).agg(F.count("*").alias("n"))
    row = counts.groupBy("_t").agg(*[F.sum(F.when(F.col("_p") == c, F.col("n"))).alias(c) for c in classes])
    grid = df.sparkSession.createDataFrame([(c,) for c in classes], "true_class string")
    wide = grid.join(F.broadcast(row), grid["true_class"] == row["_t"], "left")  # a row a class
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("predicted_class"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in classes]))
    return wide.select("true_class", each.alias("x")).select("true_class", "x.*")


def _by_class(matrix: DataFrame) -> DataFrame:
    """(class, support, predicted, tp, p, r, f): each cell of the matrix counts for its row and for its column."""
    hit = F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("true_class").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
            F.struct(F.col("predicted_class").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
        )
    )
    sums = matrix.select(sides.alias("x")).select("x.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sums = sums.withColumns({"p": ratio(F.col("tp"), F.col("predicted")), "r": ratio(F.col("tp"), F.col("support"))})
    return sums.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1) from a confusion matrix; no prediction or no support gives 0."""
    rounded = [F.round(c, 4).alias(name) for c, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))]
    return _by_class(matrix).select("class", "support", *rounded)


def averages(matrix: DataFrame) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1) of a confusion matrix."""
    return _by_class(matrix).agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.avg("f"), 4).alias("macro_f1"),
        F.round(F.sum(F.col("f") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
    )


def confusion_pairs(df: DataFrame, n: int = 10, label: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """The ``n`` most frequent mistakes."""
    # Counted once for all rows: the counts are a few rows, the prediction may be costly.
    pairs = computed_once(df.select(F.col(label).alias("true_class"), F.col(predicted).alias("predicted_class")))
    counts = pairs.groupBy("true_class", "predicted_class").agg(F.count("*").alias("n"))
    return counts.filter("true_class <> predicted_class").orderBy(F.desc("n"), "true_class", "predicted_class").limit(n)


def misclassified(df: DataFrame, label: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """The rows whose prediction isn't their label; null labels are left out."""
    return computed_once(df).filter(F.col(label) != F.col(predicted))


def doc_top1(df: DataFrame, score: str, gold: str, group: str = "doc_id", order: str = "line_idx") -> DataFrame:
    """(docs, hits, accuracy): is the best-scored row a positive, over the groups that have one."""
    best = df.groupBy(group).agg(F.max(F.struct(F.col(score), (-F.col(order)).alias("o"), F.col(gold).alias("g"))).alias("b"), F.max(gold).alias("any"))
    ok = best.filter("any > 0")
    return ok.agg(F.count("*").alias("docs"), F.sum("b.g").alias("hits"), F.round(F.avg("b.g"), 4).alias("accuracy"))


def deltas(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, before, after, change) of the fields whose correctness changed: 1 improved, -1 regressed."""
    b = before.select(key, "field", F.col("correct").alias("before"))
    a = after.select(key, "field", F.col("correct").alias("after"))
    return b.join(a, [key, "field"]).filter("after <> before").withColumn("change", F.col("after") - F.col("before"))


def override_effect(before: DataFrame, after: DataFrame, fields: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(field, docs, filled_before, filled_after, gained, lost, changed) over the documents of both results.

    ``before`` and ``after`` hold the fields as extracted without and with the gate's override; null is unfilled. A
    value that is there on both sides and differs counts as changed.
    """
    b, a = unpivot(before, fields, "before", key), unpivot(after, fields, "after", key)
    had, has_ = F.col("before").isNotNull(), F.col("after").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return b.join(a, [key, "field"]).groupBy("field").agg(
        F.count("*").alias("docs"),
        count(had).alias("filled_before"),
        count(has_).alias("filled_after"),
        count(~had & has_).alias("gained"),
        count(had & ~has_).alias("lost"),
        count(had & has_ & (F.col("before") != F.col("after"))).alias("changed"),
    )


def not_inherited(parent: DataFrame, child: DataFrame, fields: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, field, parent, child): values of the parent's result that a result built on it doesn't have, over common keys."""
    p, c = unpivot(parent, fields, "parent", key), unpivot(child, fields, "child", key)
    return p.join(c, [key, "field"]).filter("parent IS NOT NULL AND NOT parent <=> child")


def label_counts(rows: DataFrame, fields: Sequence[str], split: str = "_split", key: str = "doc_id") -> DataFrame:
    """(split, field, docs, rows, positives): rows with a 0/1 column ``y_<field>`` for each field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"y_{f}").alias("y")) for f in fields]))
    long = rows.select(split, key, each.alias("x")).select(split, key, "x.*")
    # Counted by document first, so that the distinct count shuffles one row a document and field.
    by_doc = long.groupBy(split, "field", key).agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    return by_doc.groupBy(split, "field").agg(F.count("*").alias("docs"), F.sum("n").alias("rows"), F.sum("p").alias("positives"))
