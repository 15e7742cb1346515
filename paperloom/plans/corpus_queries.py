"""Corpus building: deduplication, splits, samples, labels, gold data, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.match import match_amount
from paperloom.operators import candidates, corpus
from paperloom.plans import sql as S
from paperloom.plans.base import invoices, raw
from paperloom.plans.extract_queries import _CAND_TOTALS
from paperloom.plans.registry import query
from paperloom.sources import readers
from paperloom.session import table


@query(f"SELECT count(*) AS docs, count(DISTINCT t) AS texts FROM (SELECT coalesce(raw_text, '') AS t FROM {S.RAW}) WHERE trim(t) <> ''")
def text_uniqueness(spark, d):
    df = corpus.non_empty(raw(spark, d), "raw_text")
    return df.agg(F.count("*").alias("docs"), F.countDistinct("raw_text").alias("texts"))


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {S.RAW} GROUP BY coalesce(raw_text, chr(0))")
def dedup_keep_first(spark, d):
    df = raw(spark, d)
    kept = corpus.keep_first(df, "raw_text", "doc_id").select("doc_id", "raw_text")
    counts = df.groupBy(F.md5(F.coalesce("raw_text", F.lit("\0"))).alias("k")).agg(F.count("*").alias("copies"))
    return kept.withColumn("k", F.md5(F.coalesce("raw_text", F.lit("\0")))).join(counts, "k").select("doc_id", "copies")


def _hash(seed: int, key: str = "doc_id") -> str:
    return f"md5('{seed}:' || {key})"


_RANKED = f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash(42)}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM {S.RAW}"
_SPLIT = "CASE WHEN r < round(n * 0.7::DOUBLE) THEN 'train' WHEN r < round(n * 0.7::DOUBLE) + round(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END"


@query(f"SELECT doc_id, label, {_SPLIT} AS _split FROM ({_RANKED})")
def stratified_split(spark, d):
    return corpus.stratified_split(raw(spark, d)).select("doc_id", "label", "_split")


@query(f"SELECT label, _split, count(*) AS n FROM (SELECT label, {_SPLIT} AS _split FROM ({_RANKED})) GROUP BY ALL")
def label_distribution(spark, d):
    return corpus.class_distribution(corpus.stratified_split(raw(spark, d)))


@query(f"SELECT doc_id, label FROM ({_RANKED}) WHERE r < 20")
def seeded_sample(spark, d):
    return corpus.sample_per_class(raw(spark, d), 20).select("doc_id", "label")


@query(f"SELECT doc_id, CASE WHEN CAST('0x' || substring({_hash(42)}, 1, 6) AS BIGINT) % 100 < 75 THEN 'train' ELSE 'test' END AS _part FROM {S.RAW}")
def group_split(spark, d):
    return corpus.group_split(raw(spark, d)).select("doc_id", "_part")


@query("SELECT DISTINCT doc_id, CASE WHEN i % 100 < 70 THEN 'train' WHEN i % 100 < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, CAST(regexp_extract(doc_id, '[0-9]+') AS BIGINT) AS i FROM raw_documents)")
def index_split(spark, d):
    i = F.regexp_extract("doc_id", r"(\d+)", 1).cast("long")
    return raw(spark, d).select("doc_id", corpus.index_split(i).alias("split"))


@query("SELECT split, class_name, count(*) AS n FROM (SELECT DISTINCT * FROM manifest) WHERE class_name IN ('email', 'form', 'invoice') GROUP BY ALL")
def manifest_classes(spark, d):
    m = readers.manifest_class(table(spark, d, "manifest").distinct(), ["email", "form", "invoice"])
    return corpus.class_distribution(m, "split", "class_name")


@query(
    f"SELECT m.file_name, m.class_name, r.doc_id FROM (SELECT DISTINCT file_name, class_name FROM manifest) m LEFT JOIN {S.RAW} r ON r.file_name = m.file_name"
)
def manifest_lookup(spark, d):
    """Documents of the manifest's files; files without one stay."""
    m = table(spark, d, "manifest").select("file_name", "class_name").distinct()
    return m.join(raw(spark, d).select("file_name", "doc_id"), "file_name", "left").select("file_name", "class_name", "doc_id")


@query(
    "SELECT file_name, row_number() OVER (PARTITION BY class_name ORDER BY file_name) - 1 AS class_index, class_name FROM (SELECT DISTINCT file_name, class_name FROM manifest WHERE label_id IN (1, 2, 11))"
)
def class_running_index(spark, d):
    """Number of each manifest file within its class."""
    m = table(spark, d, "manifest").filter(F.col("label_id").isin(1, 2, 11)).select("file_name", "class_name").distinct()
    stem = F.regexp_replace("file_name", r"\d{3}\.[^.]*$", "")
    return corpus.running_index(m, ["class_name"], ["file_name"], stem, "class_index").drop("group_size")


# Labelled candidates: amounts of gold invoices, positive where they agree with gold -------------------------------


def labelled(spark, d):
    """(row_id, doc_id, file_name, _split, field, candidate_text, label)."""
    gold = table(spark, d, "gold_dataset").select("doc_id", "file_name", "_split", F.col("total_amount").alias("gold")).distinct()
    c = candidates.totals(invoices(spark, d)).join(gold, "doc_id")
    label = F.when(F.col("gold").isNotNull(), match_amount(F.col("gold"), F.col("candidate_text")).cast("int"))
    return c.select(
        F.format_string("%05d", "line_idx").alias("row_id"), "doc_id", "file_name", "_split", F.lit("total_amount").alias("field"), "candidate_text", label.alias("label")
    )


_GOLD_NUM = r"TRY_CAST(regexp_replace(gold, '[^0-9.]', '', 'g') AS DOUBLE)"
_LABELLED = (
    f"SELECT printf('%05d', line_idx) AS row_id, doc_id, file_name, _split, 'total_amount' AS field, candidate_text, CASE WHEN gold IS NOT NULL THEN "
    f"CAST(abs({_GOLD_NUM} - CAST(candidate_text AS DOUBLE)) <= greatest(0.01, 0.01 * abs({_GOLD_NUM})) AS INT) END AS label "
    f"FROM ({_CAND_TOTALS}) JOIN (SELECT DISTINCT doc_id, file_name, _split, total_amount AS gold FROM gold_dataset) USING (doc_id)"
)


@query(f"SELECT row_id, doc_id, candidate_text, label FROM ({_LABELLED})")
def label_candidates(spark, d):
    return labelled(spark, d).select("row_id", "doc_id", "candidate_text", "label")


@query(f"SELECT doc_id, min({{'r': row_id, 't': candidate_text}}).t AS candidate_text FROM ({_LABELLED}) WHERE label = 1 GROUP BY doc_id")
def gold_first_positive(spark, d):
    df = labelled(spark, d).withColumn("order_id", F.concat_ws("|", "row_id", "candidate_text"))
    return corpus.first_positive(df, "order_id").select("doc_id", "candidate_text")


@query(
    f"SELECT m.doc_id, m.file_name, m._split, CAST(NULL AS VARCHAR) AS recipient_name, CAST(NULL AS VARCHAR) AS invoice_number, p.t AS total_amount FROM "
    f"(SELECT DISTINCT doc_id, file_name, _split FROM ({_LABELLED})) m LEFT JOIN (SELECT doc_id, min({{'r': row_id, 't': candidate_text}}).t AS t FROM ({_LABELLED}) WHERE label = 1 GROUP BY doc_id) p USING (doc_id)"
)
def gold_merge(spark, d):
    df = labelled(spark, d).withColumn("order_id", F.concat_ws("|", "row_id", "candidate_text"))
    return corpus.build_gold(df, "order_id")


@query(f"SELECT doc_id, candidate_text, CASE WHEN CAST(regexp_extract(doc_id, '[0-9]+') AS BIGINT) % 10 = 0 THEN 0 ELSE label END AS label FROM ({_LABELLED})")
def label_overwrite(spark, d):
    """Every tenth document's labels come back as 0 and overwrite the old ones."""
    df = labelled(spark, d)
    tenth = F.regexp_extract("doc_id", r"(\d+)", 1).cast("long") % 10 == 0
    new = df.filter(tenth).select("doc_id", "field", "candidate_text", F.lit(0).alias("label"))
    return corpus.overwrite_labels(df, new).select("doc_id", "candidate_text", "label")


@query(f"SELECT doc_id, candidate_text, CAST(coalesce(label, 0) AS INT) AS label FROM ({_LABELLED})")
def parse_label_lines(spark, d):
    """Labels written in line form and read again."""
    df = labelled(spark, d)
    lines = df.select(F.concat(corpus.format_label_line(F.col("field")), F.coalesce("label", F.lit(0)).cast("string")).alias("value"))
    return corpus.parse_label_lines(lines).select("doc_id", "candidate_text", "label")


@query(f"SELECT CAST(floor((r - 1) / 25) AS BIGINT) AS chunk, count(*) AS docs, min(doc_id) AS first_doc FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM (SELECT DISTINCT doc_id FROM ({_LABELLED}))) GROUP BY 1")
def label_batch_chunks(spark, d):
    """Batches of 25 documents in order of id."""
    docs = labelled(spark, d).select("doc_id", F.lit(0).alias("all")).distinct()
    ranked = corpus.running_index(docs, ["all"], ["doc_id"], F.substring("doc_id", 1, 10), "r")
    return ranked.groupBy(corpus.chunk(F.col("r"), 25).alias("chunk")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query(
    "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20"
)
def history_last_n(spark, d):
    return corpus.last_of_user(table(spark, d, "events"), 20, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "ts")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_hourly_counts(spark, d):
    """The batch form of the streaming count in ``paperloom.streaming``."""
    from paperloom.streaming.events import hourly_counts

    return hourly_counts(table(spark, d, "events"))
