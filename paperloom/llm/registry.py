"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.session import distinct_rows, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different item of personal information in each captured document."""
    from paperloom.llm import pii

    return pii.found(table(spark, sf_dir, "raw_documents"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each captured document with placeholders for personal information."""
    from paperloom.llm import pii

    return pii.redacted(distinct_rows(table(spark, sf_dir, "raw_documents").select("doc_id", "raw_text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    from paperloom.llm import names

    return names.found(table(spark, sf_dir, "invoice_extractions_ml"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each readable spelling and its entity."""
    from paperloom.llm import names

    return names.entities(table(spark, sf_dir, "invoice_extractions_ml"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of noise in each captured document."""
    from paperloom.llm import scans

    return scans.found(table(spark, sf_dir, "raw_documents"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of each captured document."""
    from paperloom.llm import scans

    return scans.repaired(distinct_rows(table(spark, sf_dir, "raw_documents").select("doc_id", "raw_text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and name fields with a value that isn't in the consistent form."""
    from paperloom.llm import confusables

    return confusables.found(table(spark, sf_dir, "invoice_extractions_ml"))


def p4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the name fields beside its consistent form."""
    from paperloom.llm import confusables

    return confusables.normalized(table(spark, sf_dir, "invoice_extractions_ml"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation document with the same page."""
    from paperloom.llm import overlap

    return overlap.found(table(spark, sf_dir, "gold_dataset"), table(spark, sf_dir, "raw_documents"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping documents per evaluation split and source."""
    from paperloom.llm import overlap

    return overlap.report(table(spark, sf_dir, "gold_dataset"), table(spark, sf_dir, "raw_documents"))


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gold record's page, and how many records have it in all and on either side of the split."""
    from paperloom.llm import overlap

    return overlap.pages(table(spark, sf_dir, "gold_dataset"), table(spark, sf_dir, "raw_documents"))


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked pairs of different texts: coverage, number and longest of their merged spans."""
    from paperloom.llm import overlap

    return overlap.span_report(table(spark, sf_dir, "gold_dataset"), table(spark, sf_dir, "raw_documents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    from paperloom.llm import bpe

    return bpe.encode(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text after encoding and decoding (null texts come back empty)."""
    from paperloom.llm import bpe

    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container of each capacity every document, or piece of one, goes to."""
    from paperloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and unused share of every container."""
    from paperloom.llm import packing

    return packing.fill(packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with wrongly decoded text."""
    from paperloom.llm import mojibake

    return mojibake.found(table(spark, sf_dir, "documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored text of each of them, the encoding pairs undone, and whether all of it came back."""
    from paperloom.llm import mojibake

    return mojibake.repaired(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_entities, p3_found, p3_repaired, p4_found, p4_normalized, p5_found, p5_report, p5_pages, p5_spans, p6_ids, p6_roundtrip, p7_containers, p7_fill, p8_found, p8_restored)}

ORACLES = {
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
