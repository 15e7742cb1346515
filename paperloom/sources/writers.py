"""Sinks. Tables go to Parquet by default; reports are formatted from aggregates of a few rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """With header and doubled quotes, white space at the ends of values kept; replaces what was there."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**kept).option("header", True).option("escape", '"').csv(path)


def parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def json_records(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """One object a row; ``fields`` are nested under "fields"."""
    if fields:
        df = df.select(*[c for c in df.columns if c not in fields], F.struct(*fields).alias("fields"))
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def text_by_label(df: DataFrame, path: str, label: str = "label", text: str = "raw_text") -> None:
    """A folder of text a label."""
    df.select(label, F.coalesce(text, F.lit("")).alias("value")).write.mode("overwrite").partitionBy(label).option("lineSep", "\n").text(path)


def report(df: DataFrame, path: str, title: str) -> None:
    """A Markdown table of an aggregate (at most 1000 rows)."""
    rows = df.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a report is for aggregates of up to 1000 rows")
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}\n"
    Path(path).write_text(head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows))


def labelling_batches(df: DataFrame, path: str, chunk: str = "chunk", line: str = "line") -> None:
    """One text file set a chunk, for labelling by hand or by a service."""
    df.select(chunk, F.col(line).alias("value")).write.mode("overwrite").partitionBy(chunk).text(path)


def run_result(df: DataFrame) -> DataFrame:
    """(file_name, result): the result of a document as JSON; documents without text have an error instead."""
    ok = F.to_json(
        F.struct(
            F.col("file_name").alias("file"),
            F.col("predicted_class").alias("classification"),
            "confidence",
            F.struct("run_extraction", "reason", "invoice_confidence").alias("extraction_decision"),
            "extracted_fields",
        )
    )
    bad = F.to_json(F.struct(F.col("file_name").alias("file"), F.lit("unknown").alias("classification"), F.lit("no text").alias("error")))
    blank = F.trim(F.coalesce("raw_text", F.lit(""))) == ""
    return df.select("file_name", F.when(blank, bad).otherwise(ok).alias("result"))
