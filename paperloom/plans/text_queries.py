"""Text normalisation, lexical features and corpus profiling."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import corpus
from paperloom.plans import sql as S
from paperloom.plans.base import invoices, raw
from paperloom.plans.registry import query
from paperloom.session import table

_STOP = ", ".join(S.lit(w) for w in X.STOPWORDS)


def _clean_sql() -> str:
    t = r"regexp_replace(lower(regexp_replace(coalesce(raw_text, ''), '[\x{a0}\x{200b}\x{2028}\x{2029}]', ' ', 'g')), '\n+', ' ', 'g')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    # The other engine has no back-references: one replacement for each character that can repeat.
    for c in string.ascii_lowercase + string.digits + "_.-=*#+~<>|/\\!?,:;'\"$%&@^()[]{}`":
        esc = c if c.isalnum() or c == "_" else "\\" + c
        rep = (c * 2).replace("\\", "\\\\")
        t = f"regexp_replace({t}, {S.lit(esc + '{5,}')}, {S.lit(rep)}, 'g')"
    return t


_CLEAN = (
    f"SELECT doc_id, array_to_string([y FOR y IN string_split_regex(t, '\\s+') IF y <> '' AND y NOT IN ({_STOP}) "
    f"AND regexp_matches(y, '[a-z0-9$€£¥]')], ' ') AS clean_text FROM (SELECT doc_id, {_clean_sql()} AS t FROM {S.RAW})"
)


@query(f"SELECT doc_id, clean_text, CAST(length(clean_text) AS INT) AS text_length, CAST(len({S.tokens('clean_text')}) AS INT) AS word_count FROM ({_CLEAN})")
def clean_text_tokens(spark, d):
    return corpus.with_clean_text(raw(spark, d)).select("doc_id", "clean_text", "text_length", "word_count")


@query(
    f"SELECT label, count(*) AS n, round(avg(length(coalesce(raw_text, ''))), 2) AS mean_chars, "
    f"round(avg(len({S.tokens('raw_text')})), 2) AS mean_words FROM {S.RAW} GROUP BY label"
)
def text_length_stats(spark, d):
    t = F.col("raw_text")
    return raw(spark, d).groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg(F.length(X.empty(t))), 2).alias("mean_chars"), F.round(F.avg(X.token_count(t)), 2).alias("mean_words")
    )


@query(
    f"SELECT doc_id, CAST(i - 1 AS INT) AS line_idx, ls[i] AS line, CASE WHEN len(ls) <= 1 THEN 0.0 ELSE round((i - 1) / (len(ls) - 1), 4) END AS line_rel_pos "
    f"FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {S.lines('raw_text')} AS ls FROM {S.RAW}))"
)
def line_split_explode(spark, d):
    df = raw(spark, d).select("doc_id", X.lines(F.col("raw_text")).alias("ls"))
    df = df.select("doc_id", F.size("ls").alias("n"), F.posexplode("ls").alias("line_idx", "line"))
    return df.select("doc_id", "line_idx", "line", X.rel_pos(F.col("line_idx"), F.col("n")).alias("line_rel_pos"))


@query(
    f"SELECT doc_id, CAST({S.digits('raw_text')} AS INT) AS digits, CAST({S.letters('raw_text')} AS INT) AS letters, "
    f"CASE WHEN {S.letters('raw_text')} = 0 THEN 0.0 ELSE {S.round4(f"{S.count('raw_text', r'\p{Lu}')} / {S.letters('raw_text')}")} END AS uppercase_ratio, "
    f"CASE WHEN length(coalesce(raw_text, '')) = 0 THEN 0.0 ELSE {S.round4(f"{S.digits('raw_text')} / length(raw_text)")} END AS digit_ratio FROM {S.RAW}"
)
def char_class_ratios(spark, d):
    t = F.col("raw_text")
    return raw(spark, d).select(
        "doc_id", X.digits(t).alias("digits"), X.letters(t).alias("letters"), X.uppercase_ratio(t).alias("uppercase_ratio"), X.digit_ratio(t).alias("digit_ratio")
    )


@query(
    r"SELECT DISTINCT invoice_number, substring(regexp_replace(regexp_replace(regexp_replace(invoice_number, '\p{Lu}', 'A', 'g'), '\p{Ll}', 'a', 'g'), '\p{Nd}', '0', 'g'), 1, 40) AS shape "
    "FROM invoice_extractions_ml WHERE invoice_number IS NOT NULL"
)
def word_shape(spark, d):
    df = table(spark, d, "invoice_extractions_ml").select("invoice_number").filter("invoice_number IS NOT NULL").distinct()
    return df.withColumn("shape", X.word_shape(F.col("invoice_number")))


@query(
    f"SELECT DISTINCT issuer_name, {S.flag('issuer_name', X.ORG_SUFFIX)} AS org_suffix, {S.flag('issuer_name', X.ADDRESS_WORD)} AS address_word, "
    f"{S.flag('issuer_name', X.LABEL_WORD)} AS label_word FROM invoice_extractions_ml WHERE regexp_full_match(issuer_name, '[\\x20-\\x7e]+')"
)
def lexicon_flags(spark, d):
    c = F.col("issuer_name")
    df = table(spark, d, "invoice_extractions_ml").select("issuer_name").filter(c.rlike(r"^[\x20-\x7e]+$")).distinct()
    return df.select("issuer_name", X.flag(c, X.ORG_SUFFIX).alias("org_suffix"), X.flag(c, X.ADDRESS_WORD).alias("address_word"), X.flag(c, X.LABEL_WORD).alias("label_word"))


@query()
def lexicon_flags_all(spark, d):
    """The lexicon flags of every issuer name. The other engine's word bounds are ASCII only, so its SQL can't express names outside ASCII."""
    c = F.col("issuer_name")
    df = table(spark, d, "invoice_extractions_ml").select("issuer_name").filter(c.isNotNull()).distinct()
    return df.select("issuer_name", X.flag(c, X.ORG_SUFFIX).alias("org_suffix"), X.flag(c, X.ADDRESS_WORD).alias("address_word"), X.flag(c, X.LABEL_WORD).alias("label_word"))


def _context_sql() -> str:
    joined = "lower(coalesce(ls[i - 1], '') || ' | ' || ls[i] || ' | ' || coalesce(ls[i + 1], ''))"
    sums = ", ".join(f"CAST(sum({S.flag('j', p)}) AS BIGINT) AS {n}" for n, p in X.CONTEXT_FLAGS.items())
    return (
        f"SELECT doc_id, {sums} FROM (SELECT doc_id, {joined} AS j FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i "
        f"FROM (SELECT doc_id, {S.lines('raw_text')} AS ls FROM {S.INVOICES}))) GROUP BY doc_id"
    )


@query(_context_sql())
def context_flags(spark, d):
    """How many lines of each invoice have each flag in themselves or a neighbour."""
    ls = F.col("ls")
    rows = F.explode(F.transform(ls, lambda x, i: F.struct(x.alias("line"), X.empty(F.get(ls, i - 1)).alias("prev"), X.empty(F.get(ls, i + 1)).alias("next"))))
    df = invoices(spark, d).select("doc_id", X.lines(F.col("raw_text")).alias("ls")).select("doc_id", rows.alias("r"))
    flags = X.context_flags(F.col("r.line"), F.col("r.prev"), F.col("r.next"))
    return df.withColumns(flags).groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in flags])


# What corpus exploration counts.
KEYWORDS = ["invoice", "total", "amount", "date", "due", "bill to", "subject", "from", "receipt", "subtotal", "form", "signature", "payment", "tax"]
PATTERNS = {
    "numeric_date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "iso_date": r"\b\d{4}-\d{2}-\d{2}\b",
    "written_date": r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}\b",
    "dollar_amount": r"\$\s*[\d,]+(?:\.\d{2})?",
    "bare_decimal": r"\b\d+\.\d{2}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}",
}


@query(
    " UNION ALL ".join(
        f"SELECT label, {S.lit(k)} AS keyword, CAST(sum(CAST(contains(lower(coalesce(raw_text, '')), {S.lit(k)}) AS INT)) AS BIGINT) AS docs, "
        f"round(sum(CAST(contains(lower(coalesce(raw_text, '')), {S.lit(k)}) AS INT)) * 100.0 / count(*), 1) AS pct FROM {S.RAW} GROUP BY label"
        for k in KEYWORDS
    )
)
def keyword_presence(spark, d):
    low = F.lower(X.empty(F.col("raw_text")))
    counts = raw(spark, d).groupBy("label").agg(F.count("*").alias("n"), *[F.sum(low.contains(k).cast("int")).alias(k) for k in KEYWORDS])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(k).alias("docs")) for k in KEYWORDS]))
    return counts.select("label", "n", each.alias("x")).select("label", "x.*", F.round(F.col("x.docs") * 100 / F.col("n"), 1).alias("pct"))


@query(
    " UNION ALL ".join(
        f"SELECT {S.lit(k)} AS pattern, CAST(sum({S.count(chr(34) + 't' + chr(34), p)}) AS BIGINT) AS occurrences, "
        f"CAST(sum(CAST(regexp_matches(t, {S.lit(p)}) AS INT)) AS BIGINT) AS docs FROM (SELECT coalesce(raw_text, '') AS t FROM {S.RAW})"
        for k, p in PATTERNS.items()
    )
)
def pattern_occurrences(spark, d):
    t = X.empty(F.col("raw_text"))
    aggs = [a for k, p in PATTERNS.items() for a in (F.sum(F.regexp_count(t, F.lit(p))).alias(f"{k}_n"), F.sum(t.rlike(p).cast("int")).alias(f"{k}_d"))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"{k}_n").alias("occurrences"), F.col(f"{k}_d").alias("docs")) for k in PATTERNS]))
    return raw(spark, d).agg(*aggs).select(each.alias("x")).select("x.*")


@query(
    rf"SELECT doc_id, CAST(len(regexp_extract_all(t, '[^\x00-\x7f]')) AS INT) AS non_ascii, CASE WHEN n = 0 THEN 0.0 ELSE {S.round4('short / n')} END AS short_word_ratio, "
    rf"CASE WHEN n = 0 THEN 0.0 ELSE {S.round4('chars / n')} END AS mean_word_length, n > 0 AND (short / n > 0.5 OR chars / n < 3) AS noisy "
    rf"FROM (SELECT doc_id, t, len(w) AS n, len([x FOR x IN w IF length(x) <= 2]) AS short, coalesce(list_sum([length(x) FOR x IN w]), 0) AS chars "
    rf"FROM (SELECT doc_id, coalesce(raw_text, '') AS t, {S.tokens('raw_text')} AS w FROM {S.RAW}))"
)
def noise_indicators(spark, d):
    w = F.col("w")
    df = raw(spark, d).select("doc_id", X.empty(F.col("raw_text")).alias("t"), X.words(F.col("raw_text")).alias("w"))
    df = df.withColumns({"n": F.size(w), "short": F.size(F.filter(w, lambda x: F.length(x) <= 2)), "chars": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))})
    ratio = lambda c: F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col(c) / F.col("n"), 4))
    return df.select(
        "doc_id",
        F.regexp_count("t", F.lit(r"[^\x00-\x7f]")).alias("non_ascii"),
        ratio("short").alias("short_word_ratio"),
        ratio("chars").alias("mean_word_length"),
        ((F.col("n") > 0) & ((F.col("short") / F.col("n") > 0.5) | (F.col("chars") / F.col("n") < 3))).alias("noisy"),
    )
