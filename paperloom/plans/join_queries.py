"""Sources, lookups, merges, samples and comparisons: what is written is read again, what is joined is joined in another engine too."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import baseline, candidates, corpus, evaluate, models, regex_fields
from paperloom.plans import sql as S
from paperloom.plans.base import invoices, raw, with_stem
from paperloom.plans.corpus_queries import _LABELLED, labelled
from paperloom.plans.evaluate_queries import _CORRECT, _PRED, FIELDS, gold, predictions
from paperloom.plans.extract_queries import _LIKE, _QUALITY, T
from paperloom.plans.registry import ORACLES, query
from paperloom.plans.sql import INVOICES, RAW
from paperloom.session import shared_dir, table
from paperloom.sources import readers, writers

_ID = "CAST(regexp_extract(doc_id, '[0-9]+') AS BIGINT)"


def _number(c: str = "doc_id"):
    return F.regexp_extract(c, r"(\d+)", 1).cast("long")


def _fresh(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# Written and read again -------------------------------------------------------------------------------------------


@query("SELECT DISTINCT split, label_id, class_name, file_name, local_path, original_path FROM manifest")
def csv_round_trip(spark, d):
    """The manifest written as CSV and read as a manifest."""
    cols = ["split", "label_id", "class_name", "file_name", "local_path", "original_path"]
    where = _fresh(spark)
    writers.csv(table(spark, d, "manifest").select(*cols).distinct(), where)
    return readers.csv(spark, where, ", ".join(f"{c} {'int' if c == 'label_id' else 'string'}" for c in cols))


@query("SELECT doc_id, raw_text FROM (SELECT DISTINCT doc_id, raw_text FROM raw_documents) WHERE raw_text <> ''")
def csv_texts(spark, d):
    """Texts with line breaks, quotes and form feeds through CSV."""
    where = _fresh(spark)
    writers.csv(raw(spark, d).filter("raw_text <> ''").select("doc_id", "raw_text").distinct(), where)
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n")
    return df.schema("doc_id string, raw_text string").csv(where)


@query("SELECT DISTINCT doc_id, _split, recipient_name, invoice_number, total_amount FROM gold_dataset")
def json_round_trip(spark, d):
    """Gold values written as JSON records with nested fields and read again; nulls stay."""
    where = _fresh(spark)
    writers.json_records(gold(spark, d).select("doc_id", "_split", *FIELDS).distinct(), where, FIELDS)
    nested = ", ".join(f"{f}: string" for f in FIELDS)
    return spark.read.schema(f"doc_id string, _split string, fields struct<{nested}>").json(where).select("doc_id", "_split", "fields.*")


@query(f"SELECT label, count(*) AS lines, CAST(sum(length(x)) AS BIGINT) AS characters FROM (SELECT label, unnest(string_split(replace(raw_text, chr(13), ''), chr(10))) AS x FROM {RAW} WHERE label IS NOT NULL AND raw_text <> '') WHERE trim(x) <> '' GROUP BY 1")
def text_mirror(spark, d):
    """Texts written to a folder a label and read again, line by line."""
    where = _fresh(spark)
    df = raw(spark, d).filter("label IS NOT NULL AND raw_text <> ''").withColumn("raw_text", F.regexp_replace("raw_text", "\r", ""))
    writers.text_by_label(df, where)
    back = spark.read.option("lineSep", "\n").text(where)
    return back.filter(F.trim("value") != "").groupBy("label").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("characters"))


@query(
    "SELECT file_stem, string_agg(trim(text), ' ' ORDER BY o) AS raw_text FROM (SELECT *, row_number() OVER (PARTITION BY file_stem ORDER BY block_num, par_num, line_num, word_num, left_px, top_px, text) AS o FROM "
    "(SELECT DISTINCT file_stem, block_num, par_num, line_num, word_num, left_px, top_px, text FROM ocr_word_boxes WHERE trim(text) <> '')) GROUP BY 1"
)
def box_file_texts(spark, d):
    """Words written as lines of box files, with eight coordinates each, and put together again."""
    order = ["block_num", "par_num", "line_num", "word_num", "left_px", "top_px", "text"]
    w = table(spark, d, "ocr_word_boxes").filter("trim(text) <> ''").select("file_stem", *order).distinct()
    lines = w.select("file_stem", F.struct(*order).alias("line_idx"), F.concat_ws(",", *["left_px", "top_px"] * 4, "text").alias("line"))
    return readers.box_file_text(lines, key="file_stem")


@query("SELECT DISTINCT 'images/' || replace(original_path, ' ', '') AS path, label_id, CASE label_id WHEN 1 THEN 'form' WHEN 2 THEN 'email' ELSE 'invoice' END AS class_name FROM manifest WHERE label_id IN (1, 2, 11) AND original_path IS NOT NULL")
def label_metadata_lines(spark, d):
    """Lines of paths and labels; lines without a path, and other labels, are dropped."""
    m = table(spark, d, "manifest").select(F.regexp_replace("original_path", " ", "").alias("p"), "label_id").distinct()
    each = F.explode(F.array(F.concat_ws(" ", F.coalesce("p", F.lit("")), F.col("label_id").cast("string")), F.concat_ws(" ", "p", F.lit("7")), F.lit("no label here"))).alias("value")
    return readers.label_metadata(m.select(each)).distinct()


@query(
    "SELECT path, CAST(position AS BIGINT) AS position, class_name, row_number() OVER (PARTITION BY class_name ORDER BY position) - 1 AS class_index FROM "
    "(SELECT DISTINCT local_path AS path, row_number() OVER (ORDER BY local_path, class_name) * 7 AS position, class_name FROM (SELECT DISTINCT local_path, class_name FROM manifest)) WHERE class_name <> 'form'"
)
def archive_index(spark, d):
    """Members of an archive whose class is wanted, numbered within their class in the order of the archive."""
    m = table(spark, d, "manifest").select("local_path", "class_name").distinct().withColumn("all", F.lit(0))
    placed = corpus.running_index(m, ["all"], ["local_path", "class_name"], F.substring("local_path", 1, 12), "r")
    members = placed.select(F.col("local_path").alias("path"), ((F.col("r") + 1) * 7).cast("long").alias("position"), "class_name")
    listing = members.select("path", "position").union(members.select("path", F.col("position") + 1))  # everything is listed twice
    return readers.archive_members(listing, members.filter("class_name <> 'form'")).select("path", "position", "class_name", "class_index")


_TRUTH = " UNION ALL ".join(f"SELECT file_name, '{f}' AS field, {f} AS gold FROM (SELECT DISTINCT file_name, {', '.join(FIELDS)} FROM gold_dataset)" for f in FIELDS)


def _truth(spark, d):
    fields = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))])
    objects = gold(spark, d).select("file_name", *FIELDS).distinct().select(F.to_json(F.create_map("file_name", fields)).alias("value"))
    return readers.ground_truth(objects)


@query(_TRUTH)
def ground_truth_json(spark, d):
    """Gold values as JSON objects by file and field, read back to rows."""
    return _truth(spark, d)


@query(
    f"SELECT CASE WHEN n % 2 = 0 THEN file_name ELSE regexp_replace(file_name, '(\\.[^.]+)$', '_3\\1') END AS file_name, field, gold FROM (SELECT *, length(file_name) + ascii(right(regexp_replace(file_name, '\\.[^.]*$', ''), 1)) AS n FROM ({_TRUTH}))"
)
def truth_by_either_key(spark, d):
    """Ground truth of results whose file names have a running number in half of the cases."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    odd = (F.length("file_name") + F.ascii(F.substring(stem, -1, 1))) % 2 == 1
    t = _truth(spark, d)
    results = t.select(F.when(odd, F.regexp_replace("file_name", r"(\.[^.]+)$", "_3$1")).otherwise(F.col("file_name")).alias("file_name"), "field")
    return readers.with_truth(results, t).select("file_name", "field", "gold")


@query(
    "SELECT kind, ending, count(*) AS files FROM (SELECT CASE WHEN e IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp') THEN 'image' WHEN e = '.pdf' THEN 'pdf' ELSE 'text' END AS kind, e AS ending FROM "
    "(SELECT lower(regexp_extract(f, '(\\.[^./\\\\]+)$', 1)) AS e FROM (SELECT DISTINCT file_name AS f FROM raw_documents UNION SELECT DISTINCT upper(regexp_replace(file_name, '\\.[^.]*$', '.pdf')) FROM raw_documents UNION SELECT DISTINCT local_path FROM manifest UNION SELECT 'folder.d/no_ending'))) GROUP BY ALL"
)
def kinds_by_ending(spark, d):
    """Files by kind and ending, in any letter case."""
    names = table(spark, d, "raw_documents").select(F.col("file_name").alias("f"))
    pdf = names.select(F.upper(F.regexp_replace("f", r"\.[^.]*$", ".pdf")))
    paths = table(spark, d, "manifest").select("local_path")
    df = names.union(pdf).union(paths).union(spark.createDataFrame([("folder.d/no_ending",)], "f string")).distinct()
    return df.groupBy(readers.kind_of(F.col("f")).alias("kind"), readers.ending(F.col("f")).alias("ending")).agg(F.count("*").alias("files"))


# Tables put together ----------------------------------------------------------------------------------------------


@query(f"SELECT s._split, r.doc_id, coalesce(r.raw_text, '') AS raw_text FROM {RAW} r JOIN (SELECT DISTINCT doc_id, _split FROM gold_dataset) s USING (doc_id) WHERE r.label = 'invoice'")
def invoices_of_splits(spark, d):
    """The invoices of three tables, one a split, as one table."""
    g = table(spark, d, "gold_dataset").select("doc_id", "_split").distinct()
    parts = {s: raw(spark, d).join(g.filter(F.col("_split") == s).select("doc_id"), "doc_id") for s in ("train", "val", "test")}
    return readers.invoice_texts(parts).select("_split", "doc_id", "raw_text")


_WIDE = "SELECT doc_id, arg_max({'a': issuer_name, 'b': recipient_name, 'c': total_amount, 't': run_ts}, {'t': run_ts, 'a': coalesce(issuer_name, ''), 'b': coalesce(recipient_name, ''), 'c': coalesce(total_amount, '')}) AS r FROM invoice_extractions_ml GROUP BY doc_id"


@query(f"SELECT doc_id, r.a AS issuer_name, r.b AS recipient_name, r.c AS total_amount, r.t AS run_ts FROM ({_WIDE})")
def last_run_of_document(spark, d):
    """The latest row of each document."""
    cols = ["issuer_name", "recipient_name", "total_amount"]
    df = table(spark, d, "invoice_extractions_ml").withColumn("o", F.struct("run_ts", *[F.coalesce(c, F.lit("")) for c in cols]))
    return corpus.keep_last(df, "doc_id", "o").select("doc_id", *cols, "run_ts")


@query("SELECT doc_id, count(*) AS tables FROM (SELECT DISTINCT doc_id, 1 AS t FROM gold_dataset UNION ALL SELECT DISTINCT doc_id, 2 FROM invoice_extractions_ml UNION ALL SELECT DISTINCT doc_id, 3 FROM raw_documents WHERE label = 'invoice') GROUP BY 1")
def document_ids(spark, d):
    """Every document of three tables once, with how many have it."""
    parts = [gold(spark, d).select("doc_id").distinct(), table(spark, d, "invoice_extractions_ml").select("doc_id").distinct(), invoices(spark, d).select("doc_id").distinct()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("doc_id").agg(F.count("*").alias("tables"))


def _three(spark, d):
    """Candidates of all three fields: every extracted value, labelled by whether it agrees with gold."""
    x = table(spark, d, "invoice_extractions_ml").select("doc_id", "run_ts", *FIELDS).distinct()
    long = evaluate.unpivot(x, FIELDS, "candidate_text").distinct()
    g = evaluate.unpivot(gold(spark, d), FIELDS, "gold").distinct()
    meta = gold(spark, d).select("doc_id", "file_name", "_split").distinct()
    joined = long.filter("candidate_text IS NOT NULL").join(g, ["doc_id", "field"]).join(meta, "doc_id")
    label = F.lit(False)
    for f in FIELDS:
        own = evaluate.MATCHERS[f](F.col("gold"), F.col("candidate_text"))
        if f == "recipient_name":
            from paperloom.functions.match import match_string

            own = match_string(F.col("gold"), F.col("candidate_text"), accents=False)
        label = F.when(F.col("field") == f, own).otherwise(label)
    return joined.withColumn("label", F.when(F.col("gold").isNotNull(), label.cast("int"))).withColumn("row_id", F.concat_ws("|", "candidate_text", "file_name"))


_LONG = " UNION ".join(f"SELECT doc_id, '{f}' AS field, {f} AS p FROM invoice_extractions_ml WHERE {f} IS NOT NULL" for f in FIELDS)
_LONG_GOLD = " UNION ".join(f"SELECT doc_id, '{f}' AS field, {f} AS g FROM gold_dataset" for f in FIELDS)
_THREE = (
    f"SELECT doc_id, file_name, _split, field, p AS candidate_text, CASE WHEN g IS NOT NULL THEN CAST({_CORRECT} AS INT) END AS label, concat_ws('|', p, file_name) AS row_id "
    f"FROM ({_LONG}) JOIN ({_LONG_GOLD}) USING (doc_id, field) JOIN (SELECT DISTINCT doc_id, file_name, _split FROM gold_dataset) USING (doc_id)"
)


@query(f"SELECT doc_id, field, candidate_text, label FROM ({_THREE})")
def labels_of_three_fields(spark, d):
    return _three(spark, d).select("doc_id", "field", "candidate_text", "label")


_FIRSTS = ", ".join(f"arg_min(candidate_text, row_id) FILTER (WHERE field = '{f}' AND label = 1) AS {f}" for f in FIELDS)


@query(f"SELECT doc_id, arg_min(file_name, row_id) AS file_name, arg_min(_split, row_id) AS _split, {_FIRSTS} FROM ({_THREE}) GROUP BY doc_id")
def gold_of_three_fields(spark, d):
    """Gold rows of labelled candidates: the first positive of each field, null where there is none."""
    return corpus.build_gold(_three(spark, d), "row_id")


@query(f"SELECT _split, field, count(DISTINCT doc_id) AS docs, count(*) AS rows, CAST(sum(coalesce(label, 0)) AS BIGINT) AS positives FROM (SELECT x._split, f.field, x.doc_id, CASE WHEN f.field = x.field THEN coalesce(label, 0) ELSE 0 END AS label FROM ({_THREE}) x, (VALUES ('recipient_name'), ('invoice_number'), ('total_amount')) f(field)) GROUP BY ALL")
def label_counts_by_split(spark, d):
    """Documents, rows and positives of each split and field."""
    rows = _three(spark, d)
    y = {f"y_{f}": F.when(F.col("field") == f, F.coalesce("label", F.lit(0))).otherwise(0) for f in FIELDS}
    return evaluate.label_counts(rows.withColumns(y), FIELDS)


# Rankings and merges with a score that another engine can compute: the amount's share of the document's greatest one.

_SCORED = f"SELECT doc_id, CAST(row_id AS INT) AS line_idx, candidate_text, label, CAST(candidate_text AS DOUBLE) / max(CAST(candidate_text AS DOUBLE)) OVER (PARTITION BY doc_id) * (CASE WHEN {_ID} % 4 = 0 THEN 0.29 ELSE 1 END) AS s FROM ({_LABELLED})"


def _scored(spark, d):
    df = labelled(spark, d).withColumns({"v": F.col("candidate_text").cast("double"), "line_idx": F.col("row_id").cast("int")})
    top = df.groupBy("doc_id").agg(F.max("v").alias("m"))
    s = F.col("v") / F.col("m") * F.when(_number() % 4 == 0, 0.29).otherwise(1)
    return df.join(top, "doc_id").select("doc_id", "line_idx", "candidate_text", "label", s.alias("probability_positive"))


_TOP1 = f"SELECT doc_id, CASE WHEN max(s) >= 0.3 THEN arg_min(candidate_text, {{'p': -s, 'l': line_idx, 't': candidate_text}}) END AS value, max(s) AS score FROM ({_SCORED}) GROUP BY doc_id"


@query(_TOP1)
def top1_by_score(spark, d):
    """The best candidate of each document, if it reaches the threshold."""
    return candidates.top1(_scored(spark, d))


@query(f"SELECT doc_id, coalesce(value, total_amount) AS total_amount, score AS total_amount_score FROM ({ORACLES['baseline_total']}) LEFT JOIN ({_TOP1}) USING (doc_id)")
def ranked_into_baseline(spark, d):
    """The baseline's totals, replaced by ranked ones where there are any."""
    from paperloom.functions import text as X

    base = invoices(spark, d).select("doc_id", baseline.total_amount(X.lines(F.col("raw_text"))).alias("total_amount"))
    return candidates.merge_top1(base, {"total_amount": candidates.top1(_scored(spark, d))})


_BEST = f"SELECT doc_id, arg_max(label, {{'s': s, 'o': -line_idx, 'g': label}}) AS g, max(label) AS any_ FROM ({_SCORED}) WHERE label IS NOT NULL GROUP BY doc_id"


@query(f"SELECT count(*) AS docs, CAST(sum(g) AS BIGINT) AS hits, round(avg(g), 4) AS accuracy FROM ({_BEST}) WHERE any_ > 0")
def top1_accuracy(spark, d):
    """Over the documents that have a positive candidate."""
    return evaluate.doc_top1(_scored(spark, d).filter("label IS NOT NULL"), "probability_positive", "label")


# Lookups ----------------------------------------------------------------------------------------------------------

_STEM = "regexp_replace(file_name, '\\.[^.]*$', '')"


@query(
    "SELECT k AS doc_id, found_by, md5(coalesce(t, 'none')) AS text_hash FROM (SELECT k, CASE WHEN own IS NOT NULL THEN 'key' WHEN l IS NOT NULL THEN 'name' END AS found_by, CASE WHEN own IS NOT NULL THEN own.raw_text ELSE l.raw_text END AS t FROM "
    f"(SELECT DISTINCT CASE WHEN {_ID} % 3 = 0 THEN {_STEM} WHEN {_ID} % 3 = 1 THEN doc_id ELSE 'nowhere ' || doc_id END AS k FROM raw_documents) LEFT JOIN "
    f"(SELECT doc_id, min({{'file_name': file_name, 'raw_text': raw_text}}) AS own FROM {RAW} GROUP BY 1) o ON o.doc_id = k LEFT JOIN "
    f"(SELECT {_STEM} AS stem, min({{'file_name': file_name, 'raw_text': raw_text}}) AS l FROM {RAW} GROUP BY 1) n ON n.stem = k)"
)
def text_by_key_or_name(spark, d):
    """Texts of results whose keys are document ids, names of files without their endings, or neither."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    k = F.when(_number() % 3 == 0, stem).when(_number() % 3 == 1, F.col("doc_id")).otherwise(F.concat(F.lit("nowhere "), "doc_id"))
    results = table(spark, d, "raw_documents").select(k.alias("doc_id")).distinct()
    df = readers.with_text(results, raw(spark, d).select("doc_id", "file_name", "raw_text"))
    return df.select("doc_id", "found_by", F.md5(F.coalesce("raw_text", F.lit("none"))).alias("text_hash"))


@query(f"SELECT r.doc_id, count(w.file_stem) AS words FROM (SELECT doc_id, {_STEM} AS file_stem FROM {RAW}) r LEFT JOIN (SELECT DISTINCT * FROM ocr_word_boxes) w USING (file_stem) GROUP BY 1")
def words_of_document(spark, d):
    """Word boxes found for each document by the stem of its file."""
    from paperloom.operators import layout

    counts = table(spark, d, "ocr_word_boxes").distinct().groupBy("file_stem").agg(F.count("*").alias("n"))
    df = with_stem(raw(spark, d)).join(counts, "file_stem", "left")
    return df.groupBy("doc_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"))


# Comparisons ------------------------------------------------------------------------------------------------------


def _first_run(spark, d):
    t = table(spark, d, "invoice_extractions_ml").distinct()
    order = F.struct("run_ts", *[F.coalesce(c, F.lit("")) for c in FIELDS])
    return t.groupBy("doc_id").agg(F.min_by(F.struct(*FIELDS), order).alias("r")).select("doc_id", "r.*")


_EARLY = _PRED.replace("arg_max", "arg_min")


def _details(pred: str) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, field, CAST({_CORRECT} AS INT) AS correct FROM (SELECT g.doc_id, '{f}' AS field, g.{f} AS g, p.{f} AS p FROM (SELECT DISTINCT * FROM gold_dataset) g LEFT JOIN ({pred}) p ON p.doc_id = g.doc_id WHERE g.{f} IS NOT NULL)" for f in FIELDS
    )


def _detail(spark, d, pred):
    from paperloom.functions.match import match_string

    df = evaluate.detail(gold(spark, d), pred, "x", FIELDS)
    plain = match_string(F.col("gold"), F.col("predicted"), accents=False).cast("int")
    return df.withColumn("correct", F.when(F.col("field") == "recipient_name", plain).otherwise(F.col("correct"))).select("doc_id", "field", "correct").distinct()


@query(
    f"SELECT doc_id, field, a.correct AS before, b.correct AS after, b.correct - a.correct AS change FROM (SELECT DISTINCT * FROM ({_details(_EARLY)})) a JOIN (SELECT DISTINCT * FROM ({_details('SELECT doc_id, CASE WHEN ' + _ID + ' % 2 = 0 THEN recipient_name END AS recipient_name, CASE WHEN ' + _ID + ' % 5 > 0 THEN invoice_number END AS invoice_number, total_amount FROM (' + _PRED + ')')})) b USING (doc_id, field) WHERE a.correct <> b.correct"
)
def run_deltas(spark, d):
    """Fields that the last run, with some values taken out, has right where the first had them wrong, and the other way round."""
    late = predictions(spark, d).withColumns({"recipient_name": F.when(_number() % 2 == 0, F.col("recipient_name")), "invoice_number": F.when(_number() % 5 > 0, F.col("invoice_number"))})
    return evaluate.deltas(_detail(spark, d, _first_run(spark, d)), _detail(spark, d, late))


_EFFECT = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) AS docs, count(a.{f}) AS filled_before, count(b.{f}) AS filled_after, count(*) FILTER (WHERE a.{f} IS NULL AND b.{f} IS NOT NULL) AS gained, "
    f"count(*) FILTER (WHERE a.{f} IS NOT NULL AND b.{f} IS NULL) AS lost, count(*) FILTER (WHERE a.{f} <> b.{f}) AS changed FROM ({_PRED.replace('arg_max', 'arg_min')}) a JOIN ({_PRED}) b USING (doc_id)"
    for f in FIELDS
)


@query(_EFFECT)
def override_effect(spark, d):
    """What a second run with other decisions fills, loses and changes."""
    return evaluate.override_effect(_first_run(spark, d), predictions(spark, d), FIELDS)


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, a.{f} AS parent, CASE WHEN {_ID} % 7 = 0 THEN NULL ELSE a.{f} END AS child FROM ({_PRED}) a WHERE a.{f} IS NOT NULL AND {_ID} % 7 = 0 AND {_ID} % 2 = 0" for f in FIELDS
    )
)
def inheritance_gaps(spark, d):
    """Values of the last run that a result built on it (half of the documents, every seventh emptied) doesn't have."""
    parent = predictions(spark, d)
    child = parent.filter(_number() % 2 == 0).select("doc_id", *[F.when(_number() % 7 > 0, F.col(f)).alias(f) for f in FIELDS])
    return evaluate.not_inherited(parent, child, FIELDS)


@query(
    f"SELECT CAST(floor(r / 25) AS BIGINT) AS chunk, doc_id, 'doc_id=' || doc_id || ' | field=total_amount | candidate_text=' || candidate_text || ' | label=? | context=' || coalesce(c, '') AS line FROM ({_LABELLED}) "
    f"JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM (SELECT DISTINCT doc_id FROM ({_LABELLED}))) USING (doc_id) "
    f"LEFT JOIN (SELECT doc_id, min(regexp_replace(substring({T}, 1, 200), '[\\r\\n\\f]+', ' ', 'g')) AS c FROM {RAW} GROUP BY 1) USING (doc_id)"
)
def labelling_lines(spark, d):
    """Batches of 25 documents to label, with the beginning of each text."""
    return corpus.batch_lines(labelled(spark, d), raw(spark, d), 25)


@query(f"SELECT row_id, doc_id, candidate_text FROM ({_LABELLED}) WHERE doc_id IN (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM ({_LABELLED})) ORDER BY md5('42:' || doc_id), doc_id LIMIT 40)")
def labelling_sample(spark, d):
    """All candidates of forty documents."""
    return corpus.labelling_sample(labelled(spark, d), 40).select("row_id", "doc_id", "candidate_text")


# The baseline's record, with all its rules but the names' --------------------------------------------------------

_NUMBERS = f"SELECT doc_id, invoice_number FROM ({ORACLES['baseline_invoice_number']})"
_Q = f"SELECT doc_id, ocr_quality_score FROM ({_QUALITY})"


@query(
    f"SELECT doc_id, CASE WHEN ocr_quality_score >= 0.35 THEN invoice_number END AS invoice_number, CASE WHEN ocr_quality_score >= 0.35 THEN total_amount END AS total_amount, CASE WHEN ocr_quality_score >= 0.35 THEN payment_terms END AS payment_terms, "
    f"ocr_quality_score, s AS invoice_like_score, CASE WHEN s >= 2 THEN 'high' WHEN s = 1 THEN 'medium' ELSE 'low' END AS document_confidence FROM ({_NUMBERS}) JOIN ({ORACLES['baseline_total']}) USING (doc_id) "
    f"JOIN ({ORACLES['baseline_payment_terms']}) USING (doc_id) JOIN ({_Q}) USING (doc_id) JOIN (SELECT doc_id, CAST({_LIKE} AS INT) AS s FROM {RAW}) USING (doc_id)"
)
def baseline_gated(spark, d):
    """Number, total and terms as the whole baseline gives them: unreadable texts abstain, impossible values are dropped."""
    df = baseline.extract_fields(invoices(spark, d))
    return df.select("doc_id", "invoice_number", "total_amount", "payment_terms", "ocr_quality_score", "invoice_like_score", "document_confidence")


@query(f"SELECT doc_id, invoice_number FROM ({ORACLES['baseline_invoice_number']}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_QUALITY}) WHERE ocr_quality_score < 0.35)")
def extractor_by_name(spark, d):
    """Numbers by the extractor registered as "baseline", of readable texts."""
    df = readers.engine_extractor("baseline")(invoices(spark, d))
    return df.filter("ocr_quality_score >= 0.35").select("doc_id", "invoice_number")


@query("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_index FROM (SELECT DISTINCT label FROM raw_documents WHERE label IS NOT NULL)")
def label_encoding(spark, d):
    """Numbers of the classes in the order of their names."""
    from pyspark.ml.feature import StringIndexer

    df = raw(spark, d).filter("label IS NOT NULL").select("label")
    return StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(df).transform(df).distinct()


_FOLD = "CAST('0x' || substring(md5('42' || doc_id), 1, 6) AS BIGINT) % 5"


@query(f"SELECT CAST(f AS INT) AS fold, round(CAST(sum(CAST(label = m AS INT)) AS DOUBLE) / count(*), 4) AS accuracy FROM (SELECT {_FOLD} AS f, label FROM {RAW} WHERE label IS NOT NULL), (SELECT arg_max(label, {{'n': n, 'l': label}}) AS m FROM (SELECT label, count(*) AS n FROM {RAW} WHERE label IS NOT NULL GROUP BY 1)) GROUP BY 1")
def cross_validation_of_majority(spark, d):
    """Accuracy of always the most frequent class in each of five folds."""

    class Majority:
        def __init__(self, index: float = 0.0):
            self.index = index

        def fit(self, df):
            # The most frequent class of all, so that the folds can be checked without fitting in another engine.
            return Majority(top)

        def transform(self, df):
            return df.withColumn("prediction", F.lit(self.index))

    df = raw(spark, d).filter("label IS NOT NULL").select("doc_id", F.col("label").alias("label_name"))
    names = [r[0] for r in df.select("label_name").distinct().orderBy("label_name").collect()]
    most = df.groupBy("label_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("label_name")).first()
    top = float(names.index(most.label_name)) if most else 0.0
    return models.cross_validate(df, Majority(), names)


@query(
    "SELECT doc_id, CASE WHEN n % 2 = 0 THEN l.total_amount ELSE NULL END IS NOT NULL AS from_line, coalesce(p.total_amount, CASE WHEN n % 2 = 0 THEN l.total_amount END) AS total_amount, coalesce(CASE WHEN n % 2 = 0 THEN l.d END, p.d) AS invoice_date FROM "
    f"(SELECT doc_id, {_ID} AS n, max(total_amount) AS total_amount, max(invoice_date) AS d FROM invoice_extractions_ml GROUP BY 1, 2) l JOIN (SELECT doc_id, min(total_amount) AS total_amount, min(invoice_date) AS d FROM invoice_extractions_ml GROUP BY 1) p USING (doc_id)"
)
def line_or_regex(spark, d):
    """Two results of a document put together: dates from the line first, other fields from the patterns first."""
    from paperloom.operators import lines

    t = table(spark, d, "invoice_extractions_ml").groupBy("doc_id")
    own = t.agg(F.max("total_amount").alias("total_amount"), F.max("invoice_date").alias("invoice_date"))
    own = own.select("doc_id", *[F.when(_number() % 2 == 0, F.col(c)).alias(c) for c in ("total_amount", "invoice_date")])
    empty = {c: F.lit(None).cast("string") for c in ("invoice_number", "due_date", "recipient_name")}
    own, other = own.withColumns(empty), t.agg(F.min("total_amount").alias("total_amount"), F.min("invoice_date").alias("invoice_date")).withColumns(empty)
    both = lines.hybrid(own, other, "doc_id").select("doc_id", "total_amount", "invoice_date")
    return both.join(own.select("doc_id", F.col("total_amount").isNotNull().alias("from_line")), "doc_id")
