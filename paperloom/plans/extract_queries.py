"""Baseline, template and versioned extraction, quality scores, candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from paperloom.functions import amounts, dates
from paperloom.functions import text as X
from paperloom.operators import baseline, candidates, evaluate, regex_fields, template
from paperloom.operators import patterns as P
from paperloom.plans import sql as S
from paperloom.plans import version_sql as V
from paperloom.plans.base import invoices, raw
from paperloom.plans.registry import query

T = "coalesce(raw_text, '')"
_L = f"SELECT doc_id, raw_text, {S.lines('raw_text')} AS ls FROM {S.INVOICES}"

# Scores ------------------------------------------------------------------------------------------------------------

_QUALITY = (
    f"SELECT doc_id, CASE WHEN trim(regexp_replace({T}, '\\s+', ' ', 'g')) = '' THEN 0.0 ELSE greatest(0.0, round(1.0 "
    f"- CASE WHEN {S.count(T, r'\p{L}')} / n < 0.45 THEN 0.25 ELSE 0 END - CASE WHEN {S.count(T, r'\s')} / n < 0.08 THEN 0.15 ELSE 0 END "
    f"- CASE WHEN m < 12 THEN 0.15 ELSE 0 END - CASE WHEN {S.count(T, r'[^A-Za-z0-9\s.,:/\-&()$#]')} / n > 0.08 THEN 0.2 ELSE 0 END "
    f"- CASE WHEN {S.count(T, r'\p{Nd}')} / n > 0.35 THEN 0.1 ELSE 0 END, 2)) END AS ocr_quality_score "
    f"FROM (SELECT doc_id, raw_text, length({T}) AS n, list_sum([length(x) FOR x IN ls]) / len(ls) AS m FROM (SELECT doc_id, raw_text, {S.lines('raw_text')} AS ls FROM {S.RAW}))"
)


@query(_QUALITY)
def ocr_quality_score(spark, d):
    return raw(spark, d).select("doc_id", baseline.ocr_quality(F.col("raw_text")).alias("ocr_quality_score"))


_LIKE = f"({' + '.join(S.flag(f'lower({T})', p) for p in P.LIKE_POSITIVE)}) - ({' + '.join(S.flag(f'lower({T})', p) for p in P.LIKE_NEGATIVE)})"


@query(f"SELECT doc_id, CAST({_LIKE} AS INT) AS invoice_like_score FROM {S.RAW}")
def invoice_like_score(spark, d):
    return raw(spark, d).select("doc_id", baseline.invoice_like(F.col("raw_text")).alias("invoice_like_score"))


@query(f"SELECT CASE WHEN s >= 2 THEN 'high' WHEN s = 1 THEN 'medium' ELSE 'low' END AS document_confidence, count(*) AS n FROM (SELECT {_LIKE} AS s FROM {S.RAW}) GROUP BY 1")
def document_confidence(spark, d):
    df = raw(spark, d).select(baseline.confidence(baseline.invoice_like(F.col("raw_text"))).alias("document_confidence"))
    return df.groupBy("document_confidence").agg(F.count("*").alias("n"))


_TEMPLATE = (
    "SELECT doc_id, CASE WHEN top < 3 THEN 'generic_invoice' "
    + " ".join(f"WHEN s_{n} = top THEN '{n}'" for n in P.TEMPLATES)
    + " END AS template_name, CAST(top AS INT) AS template_score FROM (SELECT *, greatest("
    + ", ".join(f"s_{n}" for n in P.TEMPLATES)
    + ") AS top FROM (SELECT doc_id, "
    + ", ".join(f"{S.presence(f'lower({T})', [(p, w) for p in pats])} AS s_{n}" for n, (w, pats) in P.TEMPLATES.items())
    + f" FROM {S.INVOICES}))"
)


@query(_TEMPLATE)
def template_detect(spark, d):
    return template.detect(invoices(spark, d)).select("doc_id", "template_name", "template_score")


@query(f"SELECT template_name, count(*) AS n FROM ({_TEMPLATE}) GROUP BY 1")
def template_breakdown(spark, d):
    return template.breakdown(template.detect(invoices(spark, d)))


# Baseline ----------------------------------------------------------------------------------------------------------

_NUMBER = "coalesce(" + ", ".join(f"CASE WHEN {S.valid_number(S.extract('raw_text', p))} THEN {S.extract('raw_text', p)} END" for p in P.BASELINE_NUMBER) + ")"


@query(f"SELECT doc_id, {_NUMBER} AS invoice_number FROM {S.INVOICES}")
def baseline_invoice_number(spark, d):
    return invoices(spark, d).select("doc_id", baseline.invoice_number(F.col("raw_text")).alias("invoice_number"))


@query(f"SELECT doc_id, coalesce({', '.join(S.extract('raw_text', p) for p in P.PAYMENT_TERMS)}) AS payment_terms FROM {S.INVOICES}")
def baseline_payment_terms(spark, d):
    return invoices(spark, d).select("doc_id", baseline.payment_terms(F.col("raw_text")).alias("payment_terms"))


def _written(x: str) -> str:
    iso = f"coalesce(try_strptime({x}, '%B %d %Y'), try_strptime({x}, '%b %d %Y'))"
    return f"CASE WHEN year({iso}) BETWEEN 1960 AND 2005 THEN strftime({iso}, '%Y-%m-%d') END"


_FULL_DATE = P.BASELINE_DATE[5]


@query(f"SELECT doc_id, {_written(f'replace({S.squash(S.extract("raw_text", _FULL_DATE))}, {S.lit(",")}, {S.lit("")})')} AS written_date FROM {S.INVOICES}")
def baseline_written_date(spark, d):
    """The first fully written date, by the baseline's reading."""
    from paperloom.operators.rules import extract

    return invoices(spark, d).select("doc_id", dates.parse_baseline(extract(F.col("raw_text"), _FULL_DATE)).alias("written_date"))


_AMOUNTS = (
    f"SELECT doc_id, n, i - 1 AS i, x, unnest(regexp_extract_all(x, {S.lit(P.AMOUNT)}, 1)) AS a FROM (SELECT doc_id, len(ls) AS n, i, ls[i] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({_L})))"
)
_TOTALISH = S.has("x", r"\b(total|amount due|balance due|net amount)\b")
_BASE_TOTAL = (
    f"SELECT doc_id, max({{'s': s, 'v': CAST(m AS DOUBLE), 'm': m}}) AS b FROM (SELECT doc_id, {S.amount('a')} AS m, "
    f"CASE WHEN contains(lower(x), 'total amount due') THEN 6 WHEN contains(lower(x), 'amount due') OR contains(lower(x), 'balance due') THEN 5 WHEN {S.has('x', r'\btotal\b')} THEN 4 ELSE 0 END "
    f"+ CAST(i >= floor(n * 0.5) AS INT) - CASE WHEN {S.count('x', r'\.')} > 8 THEN 2 ELSE 0 END AS s FROM ({_AMOUNTS}) WHERE contains(a, '.') OR {_TOTALISH}) WHERE m IS NOT NULL GROUP BY doc_id"
)


@query(f"SELECT doc_id, CASE WHEN b.s >= 2 THEN b.m END AS total_amount FROM (SELECT doc_id FROM {S.INVOICES}) LEFT JOIN ({_BASE_TOTAL}) USING (doc_id)")
def baseline_total(spark, d):
    return invoices(spark, d).select("doc_id", baseline.total_amount(X.lines(F.col("raw_text"))).alias("total_amount"))


_BAD = " OR ".join([S.has("x", p) for p in P.BAD_NAME] + ["length(x) NOT BETWEEN 4 AND 90", f"{S.digits('x')} > 6", S.has("x", r"\b\d{5,}\b")])
_ISSUER = (
    f"SELECT doc_id, max({{'s': s, 'o': -i, 'x': x}}) AS b FROM (SELECT doc_id, i, x, CASE WHEN {S.has('x', P.COMPANY)} THEN 4 ELSE 0 END + CASE WHEN i <= 2 THEN 2 ELSE 0 END "
    f"+ CASE WHEN len({S.tokens('x')}) BETWEEN 2 AND 8 THEN 2 ELSE 0 END + CAST({S.digits('x')} = 0 AS INT) + CAST(regexp_matches(x, '[A-Za-z]') AS INT) "
    r"+ CAST(regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}') AS INT) AS s FROM (SELECT doc_id, i - 1 AS i, ls[i] AS x FROM "
    f"(SELECT doc_id, ls, unnest(range(1, least(10, len(ls)) + 1)) AS i FROM ({_L}))) WHERE NOT ({_BAD})) GROUP BY doc_id"
)


@query(f"SELECT doc_id, CASE WHEN b.s >= 4 THEN {S.clean_name('b.x')} END AS issuer_name FROM (SELECT doc_id FROM {S.INVOICES}) LEFT JOIN ({_ISSUER}) USING (doc_id)")
def baseline_issuer(spark, d):
    return invoices(spark, d).select("doc_id", baseline.issuer_name(X.lines(F.col("raw_text"))).alias("issuer_name"))


@query(f"SELECT doc_id, {S.clean_name(S.extract('raw_text', P.ATTENTION))} AS attention_name FROM {S.INVOICES}")
def baseline_attention(spark, d):
    from paperloom.operators.rules import extract

    return invoices(spark, d).select("doc_id", X.clean_name(extract(F.col("raw_text"), P.ATTENTION)).alias("attention_name"))


_ALL_LINES = f"[{S.strip('z')} FOR z IN string_split_regex({T}, '{S.EOL}')]"
_BLOCK_STOPS = f"list_min([j FOR j IN range(1, len(b) + 1) IF trim(b[j]) = '' OR {S.has('b[j]', P.BLOCK_STOP)}])"
_BLOCK = (
    f"SELECT doc_id, arg_min(block, i) AS block FROM (SELECT doc_id, i, b[1:coalesce({_BLOCK_STOPS}, len(b) + 1) - 1] AS block FROM (SELECT doc_id, i, ls[i + 1:i + 4] AS b FROM "
    f"(SELECT doc_id, ls, unnest([j FOR j IN range(1, len(ls) + 1) IF {S.has('ls[j]', P.RECIPIENT_LABEL)}]) AS i FROM (SELECT doc_id, {_ALL_LINES} AS ls FROM {S.INVOICES})))) WHERE len(block) > 0 GROUP BY doc_id"
)
_USABLE = f"[{S.strip(r"string_split_regex(x, '(?i)\b(?:p\.?o\.?\s*box|\d{5,})\b')[1]")} FOR x IN block IF len({S.tokens('x')}) >= 2 AND {S.digits('x')} <= 4]"
_RECIPIENT = (
    f"SELECT doc_id, coalesce({S.clean_name('u[1]')}, {S.clean_name(S.extract('raw_text', P.ATTENTION))}) AS recipient_name FROM "
    f"(SELECT doc_id, raw_text, [y FOR y IN {_USABLE} IF length(y) >= 3] AS u FROM {S.INVOICES} LEFT JOIN ({_BLOCK}) USING (doc_id))"
)


def _first_date(patterns: list[str], any_match: bool) -> str:
    """(doc_id, d): the date of the first pattern that gives one, or (``any_match``) of the first that matches at all."""
    found = ", ".join(S.extract("raw_text", p) for p in patterns)
    matched = ", ".join(S.has("raw_text", p) for p in patterns)
    part = lambda r, i: f"TRY_CAST(nullif(regexp_extract(s, {S.lit(r)}, {i}), '') AS INT)"
    numeric, named = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", r"(?i)^[a-z]+\s+(\d{1,2}),?\s+(\d{4})$"
    months = "|".join([*dates.MONTHS, *(m[:3] for m in dates.MONTHS if m != "may")])
    month = f"CASE lower(substring(regexp_extract(s, '(?i)^({months})', 1), 1, 3)) " + " ".join(f"WHEN '{m[:3]}' THEN {i}" for i, m in enumerate(dates.MONTHS, 1)) + " END"
    full = "CASE WHEN y >= 100 THEN y WHEN y < 70 THEN 2000 + y ELSE 1900 + y END"
    ymd = lambda y, m, d: f"CASE WHEN {y} IS NOT NULL AND {m} IS NOT NULL AND {d} IS NOT NULL THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) END"
    parsed = f"CASE WHEN a IS NOT NULL THEN CASE WHEN a <= 31 AND b <= 31 THEN CASE WHEN a <= 12 AND b >= 1 THEN {ymd(full, 'a', 'b')} WHEN b <= 12 AND a >= 1 THEN {ymd(full, 'b', 'a')} END END ELSE {ymd('ny', 'nm', 'nd')} END"
    return (
        f"SELECT doc_id, arg_min(coalesce(v, ''), k) AS d FROM (SELECT doc_id, k, hit, CASE WHEN try_strptime(p, '%Y-%m-%d') IS NOT NULL AND CAST(substring(p, 1, 4) AS INT) BETWEEN 1960 AND 2005 THEN p END AS v FROM "
        f"(SELECT doc_id, k, hit, {parsed} AS p FROM (SELECT doc_id, k, hit, {part(numeric, 1)} AS a, {part(numeric, 2)} AS b, {part(numeric, 3)} AS y, {month} AS nm, {part(named, 1)} AS nd, {part(named, 2)} AS ny FROM "
        r"(SELECT doc_id, k, hit, trim(regexp_replace(x, '\s+[a-zA-Z]\s+(\d{2,4})', ' \1', 'g')) AS s FROM "
        f"(SELECT doc_id, unnest([{found}]) AS x, unnest([{matched}]) AS hit, unnest(range({len(patterns)})) AS k FROM {S.INVOICES})))) ) WHERE {'hit' if any_match else 'v IS NOT NULL'} GROUP BY doc_id"
    )


@query(_RECIPIENT)
def baseline_recipient(spark, d):
    return invoices(spark, d).select("doc_id", baseline.recipient_name(F.col("raw_text")).alias("recipient_name"))


_RECORD = ["doc_id", *baseline.FIELDS, "payment_terms", "document_confidence", "invoice_like_score", "ocr_quality_score"]


def _party_ok(x: str) -> str:
    return f"CASE WHEN {S.digits(x)} <= 5 AND NOT {S.has(x, P.BAD_PARTY)} AND {x} <> '' THEN {x} END"


_TOTALS = f"SELECT doc_id, CASE WHEN b.s >= 2 THEN b.m END AS total_amount FROM ({_BASE_TOTAL})"
_ISSUER_NAMES = f"SELECT doc_id, CASE WHEN b.s >= 4 THEN {S.clean_name('b.x')} END AS issuer_name FROM ({_ISSUER})"
_RECORD_SQL = (
    "SELECT doc_id, CASE WHEN q >= 0.35 THEN invoice_number END AS invoice_number, CASE WHEN q >= 0.35 THEN nullif(a.d, '') END AS invoice_date, CASE WHEN q >= 0.35 THEN nullif(b.d, '') END AS due_date, "
    f"CASE WHEN q >= 0.35 THEN {_party_ok('issuer_name')} END AS issuer_name, CASE WHEN q >= 0.35 THEN {_party_ok('recipient_name')} END AS recipient_name, CASE WHEN q >= 0.35 THEN total_amount END AS total_amount, "
    "CASE WHEN q >= 0.35 THEN payment_terms END AS payment_terms, CASE WHEN s >= 2 THEN 'high' WHEN s = 1 THEN 'medium' ELSE 'low' END AS document_confidence, CAST(s AS INT) AS invoice_like_score, q AS ocr_quality_score "
    f"FROM (SELECT doc_id, {_NUMBER} AS invoice_number, coalesce({', '.join(S.extract('raw_text', p) for p in P.PAYMENT_TERMS)}) AS payment_terms, {_LIKE} AS s FROM {S.INVOICES}) "
    f"JOIN (SELECT doc_id, ocr_quality_score AS q FROM ({_QUALITY})) USING (doc_id) LEFT JOIN ({_TOTALS}) USING (doc_id) LEFT JOIN ({_ISSUER_NAMES}) USING (doc_id) JOIN ({_RECIPIENT}) USING (doc_id) "
    f"LEFT JOIN ({_first_date(P.BASELINE_DATE, False)}) a USING (doc_id) LEFT JOIN ({_first_date(P.BASELINE_DUE, True)}) b USING (doc_id)"
)


@query(_RECORD_SQL)
def baseline_record(spark, d):
    return baseline.extract_fields(invoices(spark, d)).select(*_RECORD)


@query(
    "SELECT field, count(v) AS found, count(*) AS total, round(count(v) * 100.0 / count(*), 1) AS pct FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS v FROM ({_RECORD_SQL})" for f in baseline.FIELDS) + ") GROUP BY field"
)
def baseline_coverage(spark, d):
    return evaluate.coverage(baseline.extract_fields(invoices(spark, d)), baseline.FIELDS)


@query()
def template_record(spark, d):
    return template.extract_fields(invoices(spark, d)).select(*_RECORD, "template_name", "template_score")


# Versions ----------------------------------------------------------------------------------------------------------

_V5_NUMBER_SAFE = P.V5_NUMBER[0]


@query(f"SELECT doc_id, upper({S.extract('raw_text', _V5_NUMBER_SAFE)}) AS labelled_code FROM {S.INVOICES}")
def v5_labelled_code(spark, d):
    """The first code after an invoice-number label, before it is checked."""
    from paperloom.operators.rules import extract

    return invoices(spark, d).select("doc_id", F.upper(extract(F.col("raw_text"), _V5_NUMBER_SAFE, 1, "i")).alias("labelled_code"))


@query(f"SELECT doc_id, {S.extract('raw_text', P.V5_TERMS)} AS terms FROM {S.INVOICES}")
def v5_payment_terms(spark, d):
    from paperloom.operators.rules import extract

    return invoices(spark, d).select("doc_id", extract(F.col("raw_text"), P.V5_TERMS, 1, "i").alias("terms"))


def _one_field(name: str) -> Callable:
    def one(spark, d):
        return regex_fields.extract_fields(invoices(spark, d)).select("doc_id", name)

    one.__name__ = f"v5_{name}"
    one.__doc__ = f"{name} of version 5."
    return one


v5_invoice_number = query(V.numbers())(_one_field("invoice_number"))
v5_invoice_date = query(f"SELECT doc_id, d AS invoice_date FROM ({V.SOURCE}) LEFT JOIN ({V.invoice_dates()}) USING (doc_id)")(_one_field("invoice_date"))
v5_due_date = query(V.due_dates())(_one_field("due_date"))
v5_total_amount = query(f"SELECT doc_id, total_amount FROM ({V.SOURCE}) LEFT JOIN ({V.totals()}) USING (doc_id)")(_one_field("total_amount"))
v5_issuer_name = query(V.issuers())(_one_field("issuer_name"))
v5_recipient_name = query(V.recipients())(_one_field("recipient_name"))


@query(V.record())
def v5_record(spark, d):
    return regex_fields.extract_fields(invoices(spark, d)).select("doc_id", *regex_fields.FIELDS)


@query()
def v5_full_record(spark, d):
    return regex_fields.extract_fields(invoices(spark, d), mode="full").select("doc_id", *regex_fields.FIELDS)


_MATRIX = " UNION ALL ".join(f"SELECT '{n}' AS version, doc_id, {', '.join(regex_fields.FIELDS)} FROM ({V.record(v)})" for n, v in regex_fields.VERSIONS.items())


@query(_MATRIX)
def version_matrix(spark, d):
    return regex_fields.version_matrix(invoices(spark, d))


@query(f"SELECT version, count(*) AS docs, {', '.join(f'round(count({f}) / count(*), 4) AS {f}' for f in regex_fields.FIELDS)} FROM ({_MATRIX}) GROUP BY 1")
def version_coverage(spark, d):
    """Share of documents with each field, by version."""
    m = regex_fields.version_matrix(invoices(spark, d))
    return m.groupBy("version").agg(F.count("*").alias("docs"), *[F.round(F.count(f) / F.count("*"), 4).alias(f) for f in regex_fields.FIELDS])


_GENERIC = ", ".join(S.lit(g) for g in P.GENERIC_DOMAINS)
_DOMAINS = (
    rf"[lower(regexp_extract(x, '[\p{{L}}\p{{N}}_.-]+@([\p{{L}}\p{{N}}_-]+)\.[\p{{L}}\p{{N}}_.-]+', 1)) FOR x IN string_split_regex({T}, '{S.EOL}')[1:25] IF NOT {S.has('x', P.RECIPIENT_ANCHOR)}]"
)


@query(f"SELECT doc_id, upper(([y FOR y IN {_DOMAINS} IF length(y) >= 3 AND y NOT IN ({_GENERIC})])[1]) AS issuer_name FROM {S.INVOICES}")
def email_domain_issuer(spark, d):
    return invoices(spark, d).select("doc_id", regex_fields.email_domain_issuer(F.col("raw_text")).alias("issuer_name"))


# Literal cases -----------------------------------------------------------------------------------------------------

AMOUNT_CASES = ["$1,350.00", "0.00", "abc", "1.871,86", "871,86", "1871,86", "2000.00", "2000.50", "1999", " 12 ", "-5", "€ 12.5", "1,234,567.8", ""]
_AMOUNT_EXPECTED = {
    # text: (baseline, v5, line)
    "$1,350.00": ("1350.00", "1350.00", "1350.00"), "0.00": (None, None, None), "abc": (None, None, None), "1.871,86": ("1.87", "1871.86", "1871.86"),
    "871,86": ("87186.00", "871.86", "871.86"), "1871,86": ("187186.00", "187186.00", "1871.86"), "2000.00": ("2000.00", None, "2000.00"),
    "2000.50": ("2000.50", "2000.50", "2000.50"), "1999": ("1999.00", None, "1999.00"), " 12 ": ("12.00", "12.00", "12.00"), "-5": (None, None, None),
    "€ 12.5": ("12.50", "12.50", "12.50"), "1,234,567.8": ("1234567.80", "1234567.80", "1234567.80"), "": (None, None, None),
}


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else S.lit(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


@query(_values([(k, *v) for k, v in _AMOUNT_EXPECTED.items()], "raw, baseline, v5, line"))
def normalize_amounts(spark, d):
    df = spark.createDataFrame([(x,) for x in AMOUNT_CASES], "raw string")
    c = F.col("raw")
    return df.select("raw", amounts.normalise(c).alias("baseline"), amounts.normalise_v5(c).alias("v5"), amounts.normalise_line(c).alias("line"))


_DATE_EXPECTED = {
    # text: (named, baseline, line)
    "March 21, 1984": ("1984-03-21", "1984-03-21", "1984-03-21"), "21 March 1984": ("1984-03-21", None, "1984-03-21"), "3/4/2001": ("2001-03-04", "2001-03-04", "2001-04-03"),
    "25/12/1999": ("1999-12-25", "1999-12-25", "1999-12-25"), "2024-01-15": (None, None, "2024-01-15"), "10-03-85": ("1985-10-03", "1985-10-03", None),
    "1/2/49": ("2049-01-02", None, "2049-02-01"), "45/1/2000": (None, None, None), "Net 30": (None, None, None),
}


@query(_values([(k, *v) for k, v in _DATE_EXPECTED.items()], "raw, named, baseline, line"))
def parse_dates(spark, d):
    df = spark.createDataFrame([(x,) for x in _DATE_EXPECTED], "raw string")
    c = F.col("raw")
    return df.select("raw", dates.parse_named(c).alias("named"), dates.parse_baseline(c).alias("baseline"), dates.parse_line(c).alias("line"))


# Candidates --------------------------------------------------------------------------------------------------------

_MONEY_LINE = r"\b(total|amount due|balance due|net amount|this bill total)\b"
_CAND_TOTALS = (
    f"SELECT doc_id, CASE WHEN {S.has('x', P.STRONG_TOTAL)} THEN 'money_total_line' WHEN {S.has('x', r'\btotal\b')} THEN 'money_totalish_line' ELSE 'money_anywhere' END AS candidate_source, "
    f"CAST(i AS INT) AS line_idx, m AS candidate_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, m ORDER BY i, p) AS r FROM (SELECT doc_id, i, x, a, p, {S.amount('a')} AS m FROM "
    f"(SELECT doc_id, i - 1 AS i, x, unnest(l) AS a, unnest(range(len(l))) AS p FROM (SELECT doc_id, i, x, regexp_extract_all(x, {S.lit(P.AMOUNT)}, 1) AS l FROM "
    f"(SELECT doc_id, i, ls[i] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({_L})))))) "
    f"WHERE m IS NOT NULL AND ({S.has('x', _MONEY_LINE)} OR (CAST(m AS DOUBLE) >= 10 AND contains(a, '.')))) WHERE r = 1"
)


@query(_CAND_TOTALS)
def candidates_total(spark, d):
    return candidates.totals(invoices(spark, d)).select("doc_id", "candidate_source", "line_idx", "candidate_text")


_WORDLESS = candidates._BAD_RECIPIENT[-1].replace(r"\W", r"[^\p{L}\p{N}_]")
_BAD_CAND = f"(length(t) < 4 OR len({S.tokens('t')}) > 10 OR {S.digits('t')} > 6 OR {' OR '.join(S.has('t', p) for p in [*candidates._BAD_RECIPIENT[:-1], _WORDLESS])})"
_NUMBERED = f"SELECT doc_id, ls, i, ls[i] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ({_L}))"
_STOP = r"\b(invoice|date|terms|amount|total|qty|quantity|description)\b"
_CAND_RECIPIENTS = (
    f"SELECT doc_id, candidate_source, CAST(line_idx AS INT) AS line_idx, t AS candidate_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY k, a, line_idx) AS r FROM ("
    f"SELECT doc_id, 'after_label' AS candidate_source, 0 AS k, i AS a, j - 1 AS line_idx, ls[j] AS t FROM (SELECT doc_id, ls, i, unnest(range(i + 1, least(i + 5, len(ls), coalesce(list_min([m FOR m IN range(i + 1, least(i + 5, len(ls)) + 1) IF {S.has('ls[m]', _STOP)}]), 1 << 30) - 1) + 1)) AS j FROM ({_NUMBERED}) WHERE {S.has('x', candidates._LABELS)}) "
    f"UNION ALL SELECT doc_id, 'early_org_line', 1, i, i - 1, x FROM ({_NUMBERED}) WHERE i <= 25 AND len({S.tokens('x')}) BETWEEN 2 AND 10 AND {S.digits('x')} <= 6 AND ({S.has('x', X.ORG_SUFFIX)} OR {S.has('x', r'\b(to|client|customer)\b')}) "
    f"UNION ALL SELECT doc_id, 'attention_line', 2, i, i - 1, x FROM ({_NUMBERED}) WHERE i <= 30 AND {S.has('x', r'\b(attn|attention)\b')}) WHERE NOT {_BAD_CAND}) WHERE r = 1"
)


@query(_CAND_RECIPIENTS)
def candidates_recipient(spark, d):
    return candidates.recipients(invoices(spark, d))


_BAD_NUMBERS = ", ".join(S.lit(x) for x in candidates._BAD_NUMBER)
_BAD_NUMBER = rf"(lower(t) IN ({_BAD_NUMBERS}) OR length(t) NOT BETWEEN 4 AND 24 OR NOT regexp_matches(t, '[0-9]') OR regexp_matches(t, '^[0-9]{{4}}$') OR regexp_matches(t, '^[A-Z]?[0-9]{{3,4}}$') OR regexp_matches(t, '[^\p{{L}}\p{{N}}_\-/]'))"
_LABELLED_CODES = "list_concat(" + ", ".join(f"regexp_extract_all(x, {S.lit('(?i)' + p)}, 1)" for p in P.BASELINE_NUMBER) + ")"
_LINE_TOKENS = rf"CASE WHEN {S.has('x', r'\b(invoice|reference|file|document|doc)\b')} THEN [y FOR y IN regexp_extract_all(x, '(?i)\b([A-Z0-9][A-Z0-9\-/]{{3,24}})\b', 1) IF {S.valid_number('y')}] ELSE [] END"
_CAND_NUMBERS = (
    f"SELECT doc_id, candidate_source, CAST(i - 1 AS INT) AS line_idx, t AS candidate_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY i, k, j) AS r FROM (SELECT doc_id, i, k, j, candidate_source, {S.strip('c')} AS t FROM ("
    f"SELECT doc_id, i, 0 AS k, 'labeled' AS candidate_source, unnest(l) AS c, unnest(range(len(l))) AS j FROM (SELECT doc_id, i, {_LABELLED_CODES} AS l FROM ({_NUMBERED}) WHERE i <= 40) "
    f"UNION ALL SELECT doc_id, i, 1, 'invoiceish_line_token', unnest(l), unnest(range(len(l))) FROM (SELECT doc_id, i, {_LINE_TOKENS} AS l FROM ({_NUMBERED}) WHERE i <= 40))) WHERE NOT {_BAD_NUMBER}) WHERE r = 1"
)


@query(_CAND_NUMBERS)
def candidates_number(spark, d):
    return candidates.numbers(invoices(spark, d))


@query(
    f"SELECT candidate_source, count(*) AS n, count(DISTINCT doc_id) AS docs, round(count(*) / count(DISTINCT doc_id), 4) AS per_doc FROM ({_CAND_TOTALS}) GROUP BY 1"
)
def candidate_sources(spark, d):
    c = candidates.totals(invoices(spark, d))
    return c.groupBy("candidate_source").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.round(F.count("*") / F.countDistinct("doc_id"), 4).alias("per_doc")
    )


_CTX = "lower(concat_ws(' | ', prev, x, nxt))"
_UPPER = r"regexp_matches({0}, '\p{{Lu}}') AND NOT regexp_matches({0}, '\p{{Ll}}')"
_SHAPE = r"substring(regexp_replace(regexp_replace(regexp_replace(c, '\p{Lu}', 'A', 'g'), '\p{Ll}', 'a', 'g'), '\p{Nd}', '0', 'g'), 1, 40)"


def _ratio(n: str, x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE {S.round4(f'CAST({n} AS DOUBLE) / length({x})')} END"


_FEATURES = {
    "line_rel_pos": f"CASE WHEN n <= 1 THEN 0.0 ELSE {S.round4('CAST(i AS DOUBLE) / (n - 1)')} END", "line_token_count": f"len({S.tokens('x')})", "candidate_len": "length(c)", "candidate_token_count": f"len({S.tokens('c')})",
    "candidate_digit_count": S.digits("c"), "candidate_alpha_count": S.letters("c"), "candidate_digit_ratio": _ratio(S.digits("c"), "c"),
    "candidate_uppercase_ratio": f"CASE WHEN {S.letters('c')} = 0 THEN 0.0 ELSE {S.round4(f"CAST({S.count('c', chr(92) + 'p{Lu}')} AS DOUBLE) / {S.letters('c')}")} END",
    "candidate_has_org_suffix": S.flag("c", X.ORG_SUFFIX), "candidate_has_address_word": S.flag("c", X.ADDRESS_WORD), "candidate_has_label_word": S.flag("c", X.LABEL_WORD), "candidate_shape": _SHAPE,
    "line_has_colon": "CAST(contains(x, ':') AS INT)", "line_is_upper": f"CAST({_UPPER.format('x')} AS INT)", "line_digit_ratio": _ratio(S.digits("x"), "x"), "line_has_dollar": "CAST(contains(x, '$') AS INT)",
    "line_has_org_suffix": S.flag("x", X.ORG_SUFFIX), "line_has_address_word": S.flag("x", X.ADDRESS_WORD), "line_has_label_word": S.flag("x", X.LABEL_WORD),
    "is_top_10_lines": "CAST(i < 10 AS INT)", "is_top_20_lines": "CAST(i < 20 AS INT)", "is_bottom_half": "CAST(i >= greatest(1, floor(n / 2)) AS INT)", "is_bottom_quarter": "CAST(i >= greatest(1, floor(0.75 * n)) AS INT)",
    **{k: S.flag(_CTX, p) for k, p in X.CONTEXT_FLAGS.items()}, "doc_num_lines": "n", "doc_num_chars": "chars",
    "amt_value": "CAST(c AS DOUBLE)", "amt_ge_100": "CAST(CAST(c AS DOUBLE) >= 100 AS INT)", "amt_ge_1000": "CAST(CAST(c AS DOUBLE) >= 1000 AS INT)", "amt_line_has_total": S.flag("x", r"\btotal\b"),
    "amt_line_has_amount_due": S.flag("x", P.STRONG_TOTAL), "amt_line_dot_leader_heavy": f"CAST({S.count('x', chr(92) + '.')} > 8 AS INT)",
}


@query(
    f"SELECT doc_id, candidate_source, line_idx, c AS candidate_text, {', '.join(f'{v} AS {k}' for k, v in _FEATURES.items())} FROM (SELECT doc_id, candidate_source, line_idx, candidate_text AS c, i, n, chars, ls[i + 1] AS x, coalesce(ls[i], '') AS prev, coalesce(ls[i + 2], '') AS nxt FROM "
    f"(SELECT *, line_idx AS i FROM ({_CAND_TOTALS})) JOIN (SELECT doc_id, ls, len(ls) AS n, length({T}) AS chars FROM ({_L})) USING (doc_id))"
)
def candidate_feature_values(spark, d):
    """The features of candidate totals that don't depend on the document's scores."""
    keep = ["doc_id", "candidate_source", "line_idx", "candidate_text", *_FEATURES]
    return candidate_features(spark, d).select(*keep)


@query()
def candidate_features(spark, d):
    docs = invoices(spark, d).select("doc_id", "raw_text")
    return candidates.features(candidates.totals(docs), candidates.exploded_lines(docs), "total_amount")
