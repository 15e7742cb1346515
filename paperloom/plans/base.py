"""Tables as the queries use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import distinct_rows, table


def raw(spark: SparkSession, d: str) -> DataFrame:
    """Captured documents, each row once."""
    return distinct_rows(table(spark, d, "raw_documents").select("doc_id", "file_name", "label", "source_dataset", "raw_text"))


def invoices(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).filter("label = 'invoice'")


def with_stem(df: DataFrame) -> DataFrame:
    """Adds the file name without its ending."""
    return df.withColumn("file_stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))
