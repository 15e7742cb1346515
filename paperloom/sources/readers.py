"""Sources: files by kind, manifests, box files, ground truth, label metadata; OCR and PDF through pluggable engines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom import schemas
from paperloom.operators.corpus import running_index

# File endings by kind, and label ids of the archive's classes.
IMAGE = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"]
PDF = [".pdf"]
TEXT = [".txt", ".md", ".csv"]
CLASS_IDS = {1: "form", 2: "email", 11: "invoice"}

#: Engines: bytes of a file -> text. None are bundled; a missing engine is an error, not an empty text.
ENGINES: dict[str, Callable[[bytes], str]] = {}


def register_engine(kind: str, engine: Callable[[bytes], str]) -> None:
    """``kind``: "image" or "pdf"."""
    ENGINES[kind] = engine


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def kind_of(path: Column) -> Column:
    """image, pdf or text; unknown endings are tried as text."""
    e = ending(path)
    return F.when(e.isin(IMAGE), "image").when(e.isin(PDF), "pdf").otherwise("text")


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content, kind, file_name) of the files in a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content", kind_of(F.col("path")).alias("kind"), F.regexp_extract("path", r"([^/\\]+)$", 1).alias("file_name"))


def _engine_udf(kind: str):
    engine = ENGINES.get(kind)
    if engine is None:
        raise LookupError(f"no engine for {kind} is registered")

    @F.pandas_udf(StringType())
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: engine(bytes(b)))

    return run


def extract_text(df: DataFrame, primary: dict[str, str] | None = None) -> DataFrame:
    """Adds ``raw_text`` to files: text decoded as UTF-8, images and PDFs through their engines.

    Each kind is its own branch, so that an engine only sees its files. A PDF without text goes to the image engine.
    A kind without an engine is an error if a file of it is read.
    """
    text = df.filter("kind = 'text'").withColumn("raw_text", F.col("content").cast("string"))
    parts = [text]
    for kind in ("image", "pdf"):
        if kind not in ENGINES:
            message = F.concat(F.lit(f"no engine for {kind} is registered: "), "path")
            parts.append(df.filter(F.col("kind") == kind).withColumn("raw_text", F.raise_error(message).cast("string")))
        else:
            t = _engine_udf(kind)(F.col("content"))
            branch = df.filter(F.col("kind") == kind).withColumn("raw_text", t)
            if kind == "pdf" and "image" in ENGINES:
                blank = F.trim(F.coalesce("raw_text", F.lit(""))) == ""
                rescued = branch.filter(blank).withColumn("raw_text", _engine_udf("image")(F.col("content")))
                branch = branch.filter(~blank).unionByName(rescued)
            parts.append(branch)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, raw_text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/\\]+)$", 1).alias("file_name"), F.col("value").alias("raw_text"))


def csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table with a header, whose fields may hold line breaks and doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.MANIFEST)


def manifest_class(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.filter(F.col("class_name").isin(list(names)))


def box_file_text(lines: DataFrame, key: str = "file_name", line: str = "line", order: str = "line_idx") -> DataFrame:
    """(key, raw_text) of box files: eight coordinates, then the text; other lines are dropped."""
    parts = F.split(F.col(line), ",", 9)
    ok = lines.withColumn("_p", parts).filter(F.size("_p") == 9)
    words = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.trim(F.col("_p")[8]).alias("t"))))
    return ok.groupBy(key).agg(F.array_join(F.transform(words, lambda w: w["t"]), " ").alias("raw_text"))


def label_metadata(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, label_id, class_name) of lines with a path and a wanted label; other lines are dropped."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    df = lines.filter(F.size(parts) == 2).select(F.concat(F.lit("images/"), parts[0]).alias("path"), parts[1].try_cast("int").alias("label_id"))
    df = df.filter(F.col("label_id").isin(list(CLASS_IDS)))
    return df.withColumn("class_name", F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_IDS.items() for x in kv]), F.col("label_id")))


def archive_members(members: DataFrame, wanted: DataFrame, path: str = "path", position: str = "position") -> DataFrame:
    """Members of an archive's listing whose path is wanted, with ``class_name`` and ``class_index``, their number in its class.

    ``members``: path and position in the archive; ``wanted``: path and class_name. Paths listed twice count once, at
    their first position.
    """
    first = members.groupBy(path).agg(F.min(position).alias(position))
    found = first.join(wanted.select(path, "class_name").distinct(), path)
    # Positions of like length sort as text does; the leading digits are the buckets.
    key = F.lpad(F.col(position).cast("string"), 19, "0")
    found = found.withColumn("_p", key)
    return running_index(found, ["class_name"], ["_p"], F.substring("_p", 1, 16), "class_index").drop("group_size", "_p")


def name_parts(name: Column) -> Column:
    """All runs of neighbouring parts of a file name without its ending (parts stand between -, _, . and spaces)."""
    parts = F.filter(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), r"[-_. ]+"), lambda x: x != "")
    runs = F.transform(parts, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(parts) - i), lambda n: F.array_join(F.slice(parts, i + 1, n), "_")))
    return F.when(F.size(parts) > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def with_text(results: DataFrame, raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results with ``raw_text`` of their document: by key, else of the first file whose name contains the key.

    Containing means whole parts of the name, so that the second lookup is an equi-join on the runs of parts of file
    names and no comparison of all with all. Several files that contain a key: the first by name. ``found_by`` is
    "key", "name" or null.
    """
    texts = raw.groupBy(key).agg(F.min(F.struct("file_name", "raw_text")).alias("_t"))
    df = results.join(texts.select(key, F.col("_t.raw_text").alias("_own"), F.lit("key").alias("_by")), key, "left")
    wanted = df.filter("_by IS NULL").select(key).distinct().withColumn("_k", F.regexp_replace(key, r"[-_. ]+", "_"))
    runs = raw.select("file_name", "raw_text").withColumn("_k", F.explode(name_parts(F.col("file_name"))))
    loose = wanted.join(runs, "_k").groupBy(key).agg(F.min(F.struct("file_name", "raw_text")).alias("_l"))
    df = df.join(loose, key, "left")
    by = F.coalesce("_by", F.when(F.col("_l").isNotNull(), "name"))
    return df.withColumns({"raw_text": F.when(F.col("_by").isNotNull(), F.col("_own")).otherwise(F.col("_l.raw_text")), "found_by": by}).drop("_own", "_by", "_l")


def ground_truth(df: DataFrame, column: str = "value") -> DataFrame:
    """(file_name, field, gold) of JSON objects {file: {field: value}}; null values are kept."""
    parsed = F.from_json(F.col(column), "map<string,map<string,string>>")
    return df.select(F.explode(parsed).alias("file_name", "f")).select("file_name", F.explode("f").alias("field", "gold"))


def truth_key(file_name: Column) -> Column:
    """File name without a running number before its ending."""
    return F.regexp_replace(file_name, r"_\d+(\.[^.]+)$", "$1")


def with_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results joined with ground truth by file name, else by the name without its running number."""
    exact = truth.withColumnRenamed("gold", "_exact")
    loose = truth.withColumnsRenamed({"file_name": "_key", "gold": "_loose"})
    df = results.join(exact, ["file_name", "field"], "left").withColumn("_key", truth_key(F.col("file_name")))
    df = df.join(loose, ["_key", "field"], "left")
    return df.withColumn("gold", F.coalesce("_exact", "_loose")).drop("_key", "_exact", "_loose")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row an annotation file: fields with text and box."""
    return spark.read.schema(schemas.ANNOTATION).option("multiLine", True).json(path).withColumn("file_name", F.regexp_extract(F.input_file_name(), r"([^/\\]+)$", 1))


def split_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of several splits as one with ``_split``; null texts become empty."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("_split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.fillna("", subset=[c for c in out.columns if c == "raw_text"])


def invoice_texts(parts: dict[str, DataFrame]) -> DataFrame:
    """Invoices of several splits as one table with ``_split``; null texts become empty."""
    return split_union(parts).filter("label = 'invoice'")


def engine_extractor(name: str) -> Callable[[DataFrame], DataFrame]:
    """A registered extractor by name: DataFrame -> DataFrame with the field columns."""
    from paperloom.operators import baseline, regex_fields, template

    known = {"baseline": baseline.extract_fields, "template": template.extract_fields}
    if name in known:
        return known[name]
    if name in regex_fields.VERSIONS:
        return lambda df: regex_fields.extract_fields(df, name)
    raise KeyError(f"unknown extractor: {name}")
