"""Corpus building: filters, deduplication, splits, samples, label tables and gold data.

Ranks within a class come from a hash in two steps (count per class and hash prefix, then number within it), so that a
class with a third of all rows isn't sorted in one task. First rows per key come from aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import clean_text, empty, token_count

FIELDS = ["recipient_name", "invoice_number", "total_amount"]


def with_clean_text(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds clean_text, text_length and word_count."""
    df = df.withColumn("clean_text", clean_text(F.col(text)))
    return df.withColumns({"text_length": F.length("clean_text"), "word_count": token_count(F.col("clean_text"))})


def non_empty(df: DataFrame, text: str = "clean_text") -> DataFrame:
    return df.filter(F.trim(empty(F.col(text))) != "")


def keep_first(df: DataFrame, key: Column | str, order: str) -> DataFrame:
    """The row with the least ``order`` for each key; null keys form one group."""
    return _pick(df, key, order, F.min_by)


def keep_last(df: DataFrame, key: Column | str, order: str) -> DataFrame:
    return _pick(df, key, order, F.max_by)


def _pick(df: DataFrame, key: Column | str, order: str, by) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    picked = df.groupBy(F.md5(F.coalesce(k.cast("string"), F.lit("\0"))).alias("_k")).agg(by(row, F.col(order)).alias("_row"))
    return picked.select("_row.*")


def hash_key(*parts: Column) -> Column:
    """MD5 of the parts; the same in other SQL engines, so that splits can be checked there."""
    return F.md5(F.concat_ws(":", *parts))


def ranked(df: DataFrame, group: list[str], seed: int, key: str = "doc_id", name: str = "rank") -> DataFrame:
    """Adds the rank, from 0, within ``group`` in the order of a seeded hash of ``key``, and the group's size."""
    h = hash_key(F.lit(str(seed)), F.col(key).cast("string"))
    df = df.withColumn("_h", h)
    return running_index(df, group, ["_h", key], F.substring("_h", 1, 4), name).drop("_h")


def running_index(df: DataFrame, group: list[str], order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """Adds the position, from 0, within ``group`` in the given order, and ``group_size``.

    ``bucket`` is a prefix of the order (equal order keys share it, and buckets sort as the order does): buckets are
    counted first, and only rows of one bucket are sorted together. Null groups are groups.
    """
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    renamed = {c: f"_g_{c}" for c in [*group, "_b"]}
    before = (
        counts.withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n"))
        .withColumn("group_size", F.sum("_n").over(w))
        .drop("_n")
        .withColumnsRenamed(renamed)
    )
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(g)) for c, g in renamed.items()])
    within = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1
    return df.join(before, on).withColumn(name, F.col("_before") + within).drop("_b", "_before", *renamed.values())


def stratified_split(df: DataFrame, label: str = "label", seed: int = 42, key: str = "doc_id", train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Adds ``_split``: the first 70 % of each label in hash order train, the next 15 % val, the rest test (rounded)."""
    r = ranked(df, [label], seed, key, "_rank")
    n = F.col("group_size")
    split = F.when(F.col("_rank") < F.round(n * train), "train").when(F.col("_rank") < F.round(n * train) + F.round(n * val), "val").otherwise("test")
    return r.withColumn("_split", split).drop("_rank", "group_size")


def group_split(df: DataFrame, key: str = "doc_id", seed: int = 42, percent: int = 75) -> DataFrame:
    """Adds ``_part``: all rows of a key are in train or in test, by a hash of the key."""
    bucket = F.conv(F.substring(hash_key(F.lit(str(seed)), F.col(key).cast("string")), 1, 6), 16, 10).cast("long") % 100
    return df.withColumn("_part", F.when(bucket < percent, "train").otherwise("test"))


def index_split(index: Column) -> Column:
    """By position modulo 100: under 70 train, under 85 val, else test."""
    m = F.pmod(index, F.lit(100))
    return F.when(m < 70, "train").when(m < 85, "val").otherwise("test")


def sample_per_class(df: DataFrame, n: int, label: str = "label", seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``n`` rows of each class by seeded hash."""
    return ranked(df, [label], seed, key, "_rank").filter(F.col("_rank") < n).drop("_rank", "group_size")


def chunk(index: Column, size: int) -> Column:
    """Number of the chunk of ``size`` rows, from 0."""
    return F.floor(index / size)


def class_distribution(df: DataFrame, split: str = "_split", label: str = "label") -> DataFrame:
    return df.groupBy(split, label).agg(F.count("*").alias("n"))


# Labelled candidates ----------------------------------------------------------------------------------------------

LABEL_LINE = r"doc_id=(.*?) \| field=(.*?) \| candidate_text=(.*?) \| label=([01])"


def parse_label_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(doc_id, field, candidate_text, label) of the lines in label form; other lines are dropped."""
    g = lambda i: F.trim(F.regexp_extract(F.col(column), LABEL_LINE, i))
    return lines.filter(F.col(column).rlike(LABEL_LINE)).select(
        g(1).alias("doc_id"), g(2).alias("field"), g(3).alias("candidate_text"), g(4).cast("int").alias("label")
    )


def format_label_line(field: Column) -> Column:
    return F.concat(F.lit("doc_id="), "doc_id", F.lit(" | field="), field, F.lit(" | candidate_text="), "candidate_text", F.lit(" | label="))


def overwrite_labels(candidates: DataFrame, labels: DataFrame, order: str | None = None) -> DataFrame:
    """``label`` replaced where there is a new one; the last label of a key wins."""
    keys = ["doc_id", "field", "candidate_text"]
    if order:
        labels = labels.groupBy(*keys).agg(F.max_by("label", order).alias("label"))
    new = labels.select(*keys, F.col("label").alias("_new"))
    return candidates.join(new, keys, "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def first_positive(candidates: DataFrame, order: str = "row_id") -> DataFrame:
    """(doc_id, field, candidate_text): the first candidate labelled 1 of each document and field."""
    ok = candidates.filter((F.col("label") == 1) & F.col("candidate_text").isNotNull())
    return ok.groupBy("doc_id", "field").agg(F.min_by("candidate_text", order).alias("candidate_text"))


def build_gold(candidates: DataFrame, order: str = "row_id", fields: list[str] = FIELDS) -> DataFrame:
    """One row a document of any candidate table: file_name, _split and the first positive of each field."""
    meta = candidates.groupBy("doc_id").agg(F.min_by("file_name", order).alias("file_name"), F.min_by("_split", order).alias("_split"))
    wide = first_positive(candidates, order).groupBy("doc_id").pivot("field", fields).agg(F.first("candidate_text"))
    return meta.join(wide, "doc_id", "left").select("doc_id", "file_name", "_split", *fields)


def last_of_user(df: DataFrame, n: int, user: str, order: list[str]) -> DataFrame:
    """The last ``n`` rows of each user: a bounded history."""
    w = Window.partitionBy(user).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def labelling_sample(candidates: DataFrame, docs: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """All candidates of ``docs`` documents, chosen by seeded hash: a sample for labelling by hand."""
    ids = candidates.select(key).distinct().withColumn("_h", hash_key(F.lit(str(seed)), F.col(key).cast("string")))
    chosen = ids.orderBy("_h", key).limit(docs).select(key)
    return candidates.join(F.broadcast(chosen), key, "left_semi")  # the size of the sample bounds it


def batch_lines(candidates: DataFrame, texts: DataFrame, size: int, context: int = 200, key: str = "doc_id") -> DataFrame:
    """(chunk, doc_id, line): lines to label with the beginning of the document beside them, ``size`` documents a chunk.

    Documents without text keep their lines with an empty context. Line breaks become spaces.
    """
    ids = candidates.select(key).distinct().withColumn("_all", F.lit(0))
    index = running_index(ids, ["_all"], [key], F.substring(key, 1, 10), "_r").select(key, chunk(F.col("_r"), size).alias("chunk"))
    start = texts.groupBy(key).agg(F.min(F.regexp_replace(F.substring(empty(F.col("raw_text")), 1, context), r"[\r\n\f]+", " ")).alias("_start"))
    wide = candidates.join(index, key).join(start, key, "left")
    line = F.concat(format_label_line(F.col("field")), F.lit("? | context="), empty(F.col("_start")))
    return wide.select("chunk", key, line.alias("line"))
