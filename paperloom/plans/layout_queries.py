"""Lines, zones and extraction from recognised words."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import boxes
from paperloom.operators import layout
from paperloom.operators import patterns as P
from paperloom.plans import sql as S
from paperloom.plans.base import invoices, with_stem
from paperloom.plans.registry import query
from paperloom.session import table

_WORDS = (
    "(SELECT DISTINCT file_stem, trim(text) AS text, left_px AS l, top_px AS t, width AS w, height AS h, coalesce(conf, -1.0) AS conf, block_num, par_num, line_num, word_num "
    "FROM ocr_word_boxes WHERE trim(coalesce(text, '')) <> '')"
)
_LINES = (
    "SELECT file_stem, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY l, word_num, text) AS text, min(l) AS \"left\", min(t) AS top, max(l + w) AS \"right\", max(t + h) AS bottom, "
    f"CAST(sum(CAST(conf AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS conf FROM {_WORDS} GROUP BY ALL"
)


def lines(spark, d):
    return layout.to_lines(layout.words(table(spark, d, "ocr_word_boxes")))


@query(f"SELECT * FROM ({_LINES})")
def words_to_lines(spark, d):
    return lines(spark, d).drop("width", "height")


_ZONED = (
    f"SELECT l.*, l.\"left\" / p.pw AS x_rel, l.top / p.ph AS y_rel FROM ({_LINES}) l JOIN (SELECT file_stem, greatest(max(\"right\"), 1) AS pw, greatest(max(bottom), 1) AS ph FROM ({_LINES}) GROUP BY 1) p USING (file_stem)"
)


@query(
    f"SELECT file_stem, block_num, par_num, line_num, round(x_rel, 4) AS x_rel, round(y_rel, 4) AS y_rel, y_rel < 0.25 AS is_header, y_rel >= 0.25 AND y_rel < 0.7 AS is_middle, y_rel >= 0.7 AS is_bottom, x_rel < 0.5 AS is_left_half FROM ({_ZONED})"
)
def layout_zones(spark, d):
    z = layout.zones(lines(spark, d))
    return z.select("file_stem", *layout.LINE_KEY, F.round("x_rel", 4).alias("x_rel"), F.round("y_rel", 4).alias("y_rel"), "is_header", "is_middle", "is_bottom", "is_left_half")


_BAD = " OR ".join([S.has("text", p) for p in P.BAD_NAME] + ["length(text) NOT BETWEEN 4 AND 90", f"{S.digits('text')} > 6", S.has("text", r"\b\d{5,}\b")])
_SCORE = (
    f"CASE WHEN {_BAD} THEN -10 ELSE 0 END + CASE WHEN {S.has('text', P.LAYOUT_COMPANY)} THEN 5 ELSE 0 END + CASE WHEN y_rel < 0.12 THEN 3 ELSE 0 END + CASE WHEN x_rel < 0.5 THEN 2 ELSE 0 END "
    f"+ CAST({S.digits('text')} = 0 AS INT) + CASE WHEN len({S.tokens('text')}) BETWEEN 2 AND 8 THEN 2 ELSE 0 END"
)
_BEST = f"SELECT file_stem, {S.clean_name('text')} AS c FROM (SELECT *, row_number() OVER (PARTITION BY file_stem ORDER BY {_SCORE} DESC, top, \"left\", block_num, par_num, line_num) AS r FROM ({_ZONED}) WHERE y_rel < 0.25) WHERE r = 1"


@query(
    f"SELECT file_stem, CASE WHEN c <> '' AND NOT {S.has('c', r'\b(pay to|reference|explanation|client copy|check request)\b')} AND {S.digits('c')} <= 5 THEN c END AS issuer_name FROM ({_BEST})"
)
def layout_issuer(spark, d):
    return layout.issuer(layout.zones(lines(spark, d)))


_STRONG = S.has("text", P.STRONG_TOTAL)
_TOTAL = (
    f"SELECT file_stem, m AS total_amount FROM (SELECT *, row_number() OVER (PARTITION BY file_stem ORDER BY (y_rel >= 0.7 OR x_rel >= 0.5) DESC, "
    f"CASE WHEN {_STRONG} THEN 10 WHEN {S.has('text', r'\btotal\b')} THEN 5 ELSE -2 END + CASE WHEN y_rel >= 0.7 THEN 2 ELSE 0 END + CASE WHEN x_rel >= 0.5 THEN 2 ELSE 0 END "
    f"- CASE WHEN CAST(m AS DOUBLE) > 100000 AND NOT {_STRONG} THEN 6 ELSE 0 END + CASE WHEN {S.count('text', r'\.')} > 8 THEN 1 ELSE 0 END DESC, top, \"left\", block_num, par_num, line_num, n) AS r "
    f"FROM (SELECT *, {S.amount('a')} AS m FROM (SELECT *, unnest(am) AS a, unnest(range(len(am))) AS n FROM (SELECT *, regexp_extract_all(text, {S.lit(P.AMOUNT)}, 1) AS am FROM ({_ZONED})))) "
    "WHERE CAST(m AS DOUBLE) >= 10) WHERE r = 1"
)


@query(_TOTAL)
def layout_total(spark, d):
    return layout.total(layout.zones(lines(spark, d)))


_ISSUERS = f"SELECT file_stem, CASE WHEN c <> '' AND NOT {S.has('c', r'\b(pay to|reference|explanation|client copy|check request)\b')} AND {S.digits('c')} <= 5 THEN c END AS issuer_name FROM ({_BEST})"


def _pts(pattern: str, n: int) -> str:
    return f"CASE WHEN {S.has('text', pattern)} THEN {n} ELSE 0 END"


_R_SCORE = " + ".join(
    [
        "CASE WHEN coalesce(lower(issuer_name) = lower(text), false) THEN -10 ELSE 0 END",
        _pts(r"\b(bill to|sold to|ship to|to:)\b", 4), _pts(r"\b(attention|attn)\b", 2), _pts(P.LAYOUT_COMPANY, 7), _pts(r"\b(street|avenue|road|suite|floor|telephone|fax|telex)\b", -3),
        _pts(r"\b(remit to|reference|explanation|client copy)\b", -5), f"CASE WHEN {S.digits('text')} > 6 THEN -3 ELSE 0 END", f"CASE WHEN len({S.tokens('text')}) BETWEEN 2 AND 8 THEN 2 ELSE 0 END",
        _pts(r"\b(pay to|remit to|reference|explanation|client copy|check request)\b", -7), _pts(r"^(mr|mrs|ms|dr)\.?\b", 1),
    ]
)
_R_BEST = (
    f"SELECT file_stem, issuer_name, {S.clean_name(r"regexp_replace(text, '(?i)^(attention|attn)\s*:\s*', '')")} AS c FROM (SELECT *, row_number() OVER (PARTITION BY file_stem ORDER BY {_R_SCORE} DESC, top, \"left\", block_num, par_num, line_num) AS r "
    f"FROM ({_ZONED}) LEFT JOIN ({_ISSUERS}) USING (file_stem) WHERE y_rel < 0.7 AND x_rel < 0.5) WHERE r = 1"
)
_R_BAD = " OR ".join(S.has("c", p) for p in layout._BAD_RECIPIENT)


@query(f"SELECT file_stem, CASE WHEN c <> '' AND NOT coalesce(lower(c) = lower(issuer_name), false) AND NOT ({_R_BAD}) AND {S.digits('c')} <= 5 THEN c END AS recipient_name FROM ({_R_BEST})")
def layout_recipient(spark, d):
    z = layout.zones(lines(spark, d))
    return layout.recipient(z, layout.issuer(z))


@query()
def layout_record(spark, d):
    """Fields of the invoices that have words, with layout confidence."""
    docs = with_stem(invoices(spark, d))
    seen = table(spark, d, "ocr_word_boxes").select("file_stem").distinct()
    out = layout.extract_fields(docs.join(seen, "file_stem", "left_semi"), table(spark, d, "ocr_word_boxes"))
    return out.select("doc_id", "invoice_number", "invoice_date", "due_date", "issuer_name", "recipient_name", "total_amount", "payment_terms", "layout_confidence")


_SEG = (
    "SELECT *, sum(new) OVER (PARTITION BY file_stem, block_num, par_num, line_num ORDER BY l, word_num, text ROWS UNBOUNDED PRECEDING) AS piece FROM (SELECT *, CAST(coalesce(l - lag(l + w) OVER "
    "(PARTITION BY file_stem, block_num, par_num, line_num ORDER BY l, word_num, text) > greatest(140, floor(pw * 0.08)), false) AS INT) AS new "
    f"FROM {_WORDS} JOIN (SELECT file_stem, max(l + w) AS pw FROM {_WORDS} GROUP BY 1) USING (file_stem))"
)


@query(f"SELECT file_stem, count(*) AS pieces, CAST(sum(words) AS BIGINT) AS words FROM (SELECT file_stem, block_num, par_num, line_num, piece, count(*) AS words FROM ({_SEG}) GROUP BY ALL) GROUP BY 1")
def gap_split_counts(spark, d):
    w = layout.words(table(spark, d, "ocr_word_boxes"))
    pieces = layout.gap_split(w).groupBy("file_stem").agg(F.count("*").alias("pieces"))
    return pieces.join(w.groupBy("file_stem").agg(F.count("*").alias("words")), "file_stem")


@query()
def gap_split_lines(spark, d):
    return layout.gap_split(layout.words(table(spark, d, "ocr_word_boxes")))


@query()
def band_join_issuer(spark, d):
    return layout.band_issuer(layout.gap_split(layout.words(table(spark, d, "ocr_word_boxes"))))


@query()
def rows_total(spark, d):
    return layout.rows_total(layout.gap_split(layout.words(table(spark, d, "ocr_word_boxes"))))


_IOU = (
    "SELECT file_stem, round(avg(w * h / CAST((\"right\" - \"left\") * (bottom - top) AS DOUBLE)), 6) AS mean_iou, count(*) AS words FROM "
    f"{_WORDS} x JOIN ({_LINES}) y USING (file_stem, block_num, par_num, line_num) WHERE w > 0 AND h > 0 GROUP BY 1"
)


@query(_IOU)
def box_iou(spark, d):
    """Mean overlap of words with their lines."""
    w = layout.words(table(spark, d, "ocr_word_boxes"))
    ls = layout.to_lines(w).select("file_stem", *layout.LINE_KEY, F.col("left").alias("l"), F.col("top").alias("t"), "right", "bottom")
    c = F.col
    pair = w.filter("width > 0 AND height > 0").join(ls, ["file_stem", *layout.LINE_KEY])
    word = (c("left").cast("double"), c("top").cast("double"), (c("left") + c("width")).cast("double"), (c("top") + c("height")).cast("double"))
    line = tuple(c(x).cast("double") for x in ("l", "t", "right", "bottom"))
    return pair.groupBy("file_stem").agg(F.round(F.avg(boxes.iou(word, line)), 6).alias("mean_iou"), F.count("*").alias("words"))


@query("SELECT batch_id, count(*) AS words, CAST(sum(CAST(coalesce(conf, -1.0) AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_conf, CAST(sum(CAST(coalesce(conf, -1.0) < 50 AS INT)) AS BIGINT) AS doubtful FROM (SELECT DISTINCT * FROM ocr_word_boxes) WHERE trim(coalesce(text, '')) <> '' GROUP BY 1")
def batch_confidence(spark, d):
    """Recognition quality by scan batch; partial sums make a batch with a tenth of the rows harmless."""
    w = table(spark, d, "ocr_word_boxes").distinct().filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    conf = F.coalesce("conf", F.lit(-1.0))
    return w.groupBy("batch_id").agg(F.count("*").alias("words"), (F.sum(conf.cast("decimal(18,4)")).cast("double") / F.count("*")).alias("mean_conf"), F.sum((conf < 50).cast("int")).alias("doubtful"))


_BOX_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'), '[^a-z0-9:/.,#\- ]', '', 'g'), ' +', ' ', 'g'))"
_Y = ", ".join(
    f"CAST({f} IS NOT NULL AND {_BOX_TEXT.format(f)} <> '' AND {_BOX_TEXT.format('text')} <> '' AND (contains({_BOX_TEXT.format(f)}, {_BOX_TEXT.format('text')}) OR contains({_BOX_TEXT.format('text')}, {_BOX_TEXT.format(f)})) AS INT) AS y_{f}"
    for f in ("recipient_name", "invoice_number", "total_amount")
)


@query(
    f"SELECT file_stem, block_num, par_num, line_num, text, {S.round4('x_rel')} AS x_rel, {S.round4('y_rel')} AS y_rel, {_Y} FROM ({_ZONED}) JOIN "
    "(SELECT DISTINCT regexp_replace(file_name, '\\.[^.]*$', '') AS file_stem, recipient_name, invoice_number, total_amount FROM gold_dataset) USING (file_stem)"
)
def line_labels(spark, d):
    """Lines labelled by gold values that their text contains or that contain it."""
    from paperloom.operators.lines import label_lines

    gold = table(spark, d, "gold_dataset").select("file_name", "recipient_name", "invoice_number", "total_amount").distinct()
    return label_lines(layout.zones(lines(spark, d)), with_stem(gold).drop("file_name"), "file_stem")


def _rows(spark, d):
    return layout.gap_split(layout.words(table(spark, d, "ocr_word_boxes")))


@query()
def rows_number(spark, d):
    from paperloom.operators import rows

    return rows.number(_rows(spark, d))


@query()
def rows_dates(spark, d):
    from paperloom.operators import rows

    r = _rows(spark, d)
    return rows.invoice_date(r).join(rows.due_date(r), "file_stem", "full")


@query()
def rows_recipient(spark, d):
    from paperloom.operators import rows

    return rows.recipient(_rows(spark, d))


@query()
def rows_issuer(spark, d):
    from paperloom.operators import rows

    return rows.issuer(_rows(spark, d))


@query()
def v5_rescued_record(spark, d):
    """Version 5 of the invoices that have words, completed from their rows."""
    from paperloom.operators import regex_fields, rows
    from paperloom.session import materialize

    r = materialize(_rows(spark, d))
    docs = with_stem(invoices(spark, d)).join(r.select("file_stem").distinct(), "file_stem", "left_semi")
    out = rows.rescue(materialize(regex_fields.extract_fields(docs)), r)
    return out.select("doc_id", *regex_fields.FIELDS)
