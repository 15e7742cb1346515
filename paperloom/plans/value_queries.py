"""Values by themselves: amounts, dates, names, checks, labels and boxes over the values that the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import amounts, boxes, dates
from paperloom.functions import text as X
from paperloom.operators import baseline, candidates, lines, regex_fields, rules
from paperloom.operators import patterns as P
from paperloom.plans import sql as S
from paperloom.plans.base import invoices, raw
from paperloom.plans.registry import query
from paperloom.session import table

_SPACE = r"[\s\x0b\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


# Amounts as they stand in texts, and the same with European separators.

_WRITTEN = f"SELECT DISTINCT unnest(regexp_extract_all(raw_text, {S.lit(P.AMOUNT)}, 1)) AS a FROM raw_documents"
_BOTH = f"SELECT a AS raw FROM ({_WRITTEN}) UNION SELECT replace(replace(replace(a, ',', '_'), '.', ','), '_', '.') FROM ({_WRITTEN}) UNION SELECT DISTINCT total_amount FROM invoice_extractions_ml WHERE total_amount IS NOT NULL"
_V0 = r"TRY_CAST(regexp_replace(raw, '[£€$¥₹\s,]', '', 'g') AS DOUBLE)"


def _two(x: str) -> str:
    """Two places, half up on the decimal value."""
    return f"printf('%.2f', CAST(round(CAST({x} AS DECIMAL(24, 6)), 2) AS DOUBLE))"


_S5 = r"regexp_replace(raw, '[£$€¥₹\s]', '', 'g')"
_V5 = rf"TRY_CAST(CASE WHEN regexp_matches({_S5}, '^\d{{1,3}}(?:\.\d{{3}})*,\d{{1,2}}$') THEN replace(replace({_S5}, '.', ''), ',', '.') ELSE replace({_S5}, ',', '') END AS DOUBLE)"
_SL = r"regexp_replace(raw, '[^0-9,.\-]', '', 'g')"
_EU, _EN = f"replace(replace({_SL}, '.', ''), ',', '.')", f"replace({_SL}, ',', '')"
_LAST = "length({0}) - strpos(reverse({0}), '{1}')"
_LINE = (
    f"TRY_CAST(CASE WHEN contains({_SL}, ',') AND contains({_SL}, '.') THEN CASE WHEN {_LAST.format(_SL, ',')} > {_LAST.format(_SL, '.')} THEN {_EU} ELSE {_EN} END "
    rf"WHEN regexp_matches({_SL}, ',\d{{2}}$') THEN {_EU} ELSE {_EN} END AS DOUBLE)"
)


@query(
    f"SELECT raw, CASE WHEN {_V0} > 0 THEN {_two(_V0)} END AS baseline, CASE WHEN {_V5} > 0 AND NOT (floor({_V5}) BETWEEN 1900 AND 2099 AND {_V5} - floor({_V5}) < 0.01) THEN {_two(_V5)} END AS v5, "
    f"CASE WHEN {_LINE} > 0 THEN {_two(_LINE)} END AS line FROM ({_BOTH})"
)
def amount_values(spark, d):
    """Three readings of every amount written in the texts, also with European separators, and of the extracted totals."""
    found = raw(spark, d).select(F.explode(F.regexp_extract_all("raw_text", F.lit(P.AMOUNT), F.lit(1))).alias("raw")).distinct()
    european = found.select(F.translate(F.translate(F.translate("raw", ",", "_"), ".", ","), "_", ".").alias("raw"))
    totals = table(spark, d, "invoice_extractions_ml").select(F.col("total_amount").alias("raw")).filter("raw IS NOT NULL")
    df = found.union(european).union(totals).distinct()
    c = F.col("raw")
    return df.select("raw", amounts.normalise(c).alias("baseline"), amounts.normalise_v5(c).alias("v5"), amounts.normalise_line(c).alias("line"))


# Dates: every order date in seven written forms; what each reader must make of it follows from the date itself.

_FORMS = {
    # name: (Spark's pattern, DuckDB's pattern)
    "american": ("M/d/yyyy", "%-m/%-d/%Y"), "dotted": ("d.M.yyyy", "%-d.%-m.%Y"), "month_first": ("MMMM d, yyyy", "%B %-d, %Y"), "day_first": ("d MMMM yyyy", "%-d %B %Y"),
    "iso": ("yyyy-MM-dd", "%Y-%m-%d"), "short_year": ("M/d/yy", "%-m/%-d/%y"), "dashed": ("d-MMM-yyyy", "%-d-%b-%Y"),
}
_SWAPPED = "CASE WHEN day(o) <= 12 THEN strftime(o, '%Y-%d-%m') ELSE strftime(o, '%Y-%m-%d') END"
_TRUE = "strftime(o, '%Y-%m-%d')"
_READ = {
    # name: (named, baseline, line)
    "american": (_TRUE, _TRUE, _SWAPPED), "dotted": (_SWAPPED, _SWAPPED, "NULL"), "month_first": (_TRUE, _TRUE, _TRUE), "day_first": (_TRUE, "NULL", _TRUE),
    "iso": ("NULL", "NULL", _TRUE), "short_year": (_TRUE, _TRUE, "'20' || substring(" + _SWAPPED + ", 3)"), "dashed": (_TRUE, "NULL", _TRUE),
}
_ORDERS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS o FROM orders)"


def _order_dates(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("o")).distinct()


def _forms():
    return F.explode(F.array(*[F.struct(F.lit(n).alias("form"), F.date_format("o", f).alias("raw")) for n, (f, _) in _FORMS.items()]))


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS form, strftime(o, '{f}') AS raw, {_READ[n][0]} AS named, {_READ[n][1]} AS baseline, {_READ[n][2]} AS line, {'false' if n == 'dotted' else 'true'} AS looks FROM {_ORDERS}"
        for n, (_, f) in _FORMS.items()
    )
)
def date_values(spark, d):
    """What the readers of dates make of each order date in each written form."""
    df = _order_dates(spark, d).select(_forms().alias("x")).select("x.*")
    c = F.col("raw")
    return df.select("form", "raw", dates.parse_named(c).alias("named"), dates.parse_baseline(c).alias("baseline"), dates.parse_line(c).alias("line"), dates.looks_like_date(c).alias("looks"))


@query(f"SELECT strftime(o, '%Y-%m-%d') AS date, strftime(o, '%Y-%m-%d') AS year_first, {_SWAPPED} AS day_first, CAST(NULL AS VARCHAR) AS rejected FROM {_ORDERS}")
def numeric_dates(spark, d):
    """Three numbers as a date: year first by the oldest rules, day first, and year first by the newer ones, which reject it."""
    y, m, day = (f("o").cast("string") for f in (F.year, F.month, F.dayofmonth))
    return _order_dates(spark, d).select(
        F.date_format("o", "yyyy-MM-dd").alias("date"),
        dates.parse_numeric(y, m, day, reject_first=False).alias("year_first"),
        dates.parse_numeric(day, m, y).alias("day_first"),
        dates.parse_numeric(y, m, day).alias("rejected"),
    )


@query(
    f"SELECT strftime(o, '%Y-%m-%d') AS date, concat_ws(' ', {_TRUE}, strftime(o + 45, '%Y-%m-%d'), strftime(o + 90, '%Y-%m-%d')) AS found FROM {_ORDERS}"
)
def date_candidates(spark, d):
    """All dates in a sentence with three, form by form, each once (the second one is written twice)."""
    later = lambda n, f: F.date_format(F.date_add("o", n), f)
    text = F.concat(
        F.lit("Sent "), later(90, "d MMMM yyyy"), F.lit(", due "), later(45, "MMMM d, yyyy"), F.lit(" or "), later(45, "MMM d, yyyy"), F.lit("; ordered "), later(0, "M/d/yyyy"), F.lit(".")
    )
    return _order_dates(spark, d).select(F.date_format("o", "yyyy-MM-dd").alias("date"), F.array_join(dates.candidates(text), " ").alias("found"))


# Names ------------------------------------------------------------------------------------------------------------

_NAMES = "(SELECT issuer_name AS name FROM invoice_extractions_ml WHERE issuer_name IS NOT NULL UNION SELECT recipient_name FROM invoice_extractions_ml WHERE recipient_name IS NOT NULL)"


def _names(spark, d):
    t = table(spark, d, "invoice_extractions_ml")
    return t.select(F.col("issuer_name").alias("name")).union(t.select("recipient_name")).filter("name IS NOT NULL").distinct()


_SRC, _DST = "àáâãäåāăçćčèéêëēėęìíîïīıñńňòóôõöøōőśšşùúûüūůűýÿźżžł", "aaaaaaaaccceeeeeeeiiiiiinnnooooooooss" + "suuuuuuuyyzzzl"


@query(
    f"SELECT name, regexp_replace(translate(lower(name), '{_SRC}', '{_DST}'), '[^\\x00-\\x7f]', '', 'g') AS folded, "
    rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '{_SPACE}+', ' ', 'g'), '[^a-z0-9:/.,#\- ]', '', 'g'), ' +', ' ', 'g')) AS box_text, "
    f"coalesce(nullif({_strip(f"regexp_replace({_strip('name')}, '(?i)^(bill{_SPACE}*to|buyer|customer|client){_SPACE}*[:-]?{_SPACE}*', '')")}, ''), 'second line') AS buyer FROM {_NAMES}"
)
def name_forms(spark, d):
    """Names with accents folded, as the text of a box, and as the recipient of a buyer block."""
    c = F.col("name")
    return _names(spark, d).select("name", X.fold_accents(c).alias("folded"), X.box_text(c).alias("box_text"), X.buyer_name(F.concat(F.translate(c, "\n", " "), F.lit("\nsecond line"))).alias("buyer"))


_PREFIXED = f"SELECT name, p || name AS raw FROM {_NAMES} x, (VALUES (''), ('Invoice '), ('tax  invoice '), ('A '), ('''\"'), ('X Receipt ')) t(p)"
_P1 = _strip(f"regexp_replace(raw, '^[A-Za-z]{_SPACE}+([A-Z])', '\\1')")
_P2 = _strip(f"regexp_replace({_P1}, '^[''\"`]+', '')")
_P3 = _strip(f"regexp_replace({_P2}, '(?i)^(?:invoice|tax{_SPACE}+invoice|bill|receipt){_SPACE}+', '')")


@query(f"SELECT raw, CASE WHEN length({_P3}) >= 3 THEN {_P3} ELSE raw END AS issuer FROM (SELECT DISTINCT raw FROM ({_PREFIXED}))")
def issuer_prefixes(spark, d):
    """Names behind letters, quotes and document types, without them."""
    ps = F.explode(F.array(*[F.lit(p) for p in ("", "Invoice ", "tax  invoice ", "A ", "'\"", "X Receipt ")]))
    df = _names(spark, d).select("name", ps.alias("p")).select(F.concat("p", "name").alias("raw")).distinct()
    return df.select("raw", X.strip_issuer_prefix(F.col("raw")).alias("issuer"))


@query(
    f"SELECT name, marked, 'Acme Wabco Ltd' AS joined FROM (SELECT name, regexp_replace(name, '[™®©]+', '', 'g') AS marked FROM (SELECT DISTINCT regexp_replace(name, '[| ]', '', 'g') AS name FROM {_NAMES}))"
)
def post_ocr_names(spark, d):
    """Names with trade-mark signs dropped (spaces and bars taken out before), and the same fixed name put together again."""
    df = _names(spark, d).select(F.regexp_replace("name", "[| ]", "").alias("name")).distinct()
    return df.select("name", X.post_ocr_cleanup(F.col("name")).alias("marked"), X.post_ocr_cleanup(F.lit("Acme® Wa b co™ Ltd")).alias("joined"))


_ASCII = "trim(regexp_replace(regexp_replace(name, '[^ -~]', '', 'g'), ' +', ' ', 'g'))"
_TOKENS, _DIGITS, _ALPHA = "len([y FOR y IN string_split(n, ' ') IF y <> ''])", S.digits("n"), f"{S.letters('n')} / greatest(length(n), 1)"
_COUNTRY = [S.has("n", p) for p in (P.BAD_RECIPIENT_EXACT, P.BAD_RECIPIENT_WORD, P.BAD_RECIPIENT_COUNTRY)]
_BAD_ISSUER = (
    f"(length(n) < 2 OR {' OR '.join(S.has('n', p) for p in (P.BAD_ISSUER_EXACT, P.BAD_ISSUER_PLACE, P.BAD_ISSUER_TEXT, P.BAD_ISSUER_COUNTRY))} "
    rf"OR (regexp_matches(n, {S.lit(P.BAD_ISSUER_CAPS)}) AND NOT {S.has('n', P.V5_COMPANY)}) OR ({S.has('n', r'\b(neon\s+sign|tax\s+invoice|purchase\s+order)\b')} AND {_TOKENS} > 4))"
)


@query(
    f"SELECT n AS name, (length(n) < 4 OR {_TOKENS} > 10 OR {_DIGITS} > 6 OR {' OR '.join(S.has('n', p) for p in candidates._BAD_RECIPIENT)}) AS bad_candidate, "
    f"(length(n) < 2 OR {' OR '.join(_COUNTRY)}) AS bad_recipient, {_BAD_ISSUER} AS bad_issuer, "
    rf"(NOT {_BAD_ISSUER} AND ({S.has('n', P.V5_COMPANY)} OR ({_TOKENS} BETWEEN 1 AND 5 AND {_ALPHA} >= 0.60 AND NOT regexp_matches(n, '\d')))) AS strong_company "
    f"FROM (SELECT DISTINCT {_ASCII} AS n FROM {_NAMES})"
)
def party_checks(spark, d):
    """Checks of names as recipients and issuers, on their printable ASCII characters."""
    n = F.trim(F.regexp_replace(F.regexp_replace("name", "[^ -~]", ""), " +", " "))
    df = _names(spark, d).select(n.alias("name")).distinct()
    c = F.col("name")
    return df.select(
        "name", candidates.bad_recipient(c).alias("bad_candidate"), regex_fields.bad_recipient(c).alias("bad_recipient"), regex_fields.bad_issuer(c).alias("bad_issuer"), regex_fields.strong_company(c).alias("strong_company")
    )


_BAD_NUMBERS = ", ".join(S.lit(x) for x in candidates._BAD_NUMBER)


@query(
    f"SELECT n AS number, {S.valid_number('n')} AS valid, (lower(n) IN ({_BAD_NUMBERS}) OR length(n) NOT BETWEEN 4 AND 24 OR NOT regexp_matches(n, '[0-9]') OR regexp_matches(n, '^[0-9]{{4}}$') "
    rf"OR regexp_matches(n, '^[A-Z]?[0-9]{{3,4}}$') OR regexp_matches(n, '[^\p{{L}}\p{{N}}_\-/]')) AS bad_candidate FROM "
    "(SELECT invoice_number AS n FROM invoice_extractions_ml WHERE invoice_number IS NOT NULL UNION SELECT invoice_number FROM gold_dataset WHERE invoice_number IS NOT NULL "
    r"UNION SELECT unnest(regexp_extract_all(raw_text, '[A-Za-z0-9/#-]{3,26}')) FROM raw_documents)"
)
def number_checks(spark, d):
    """Checks of everything that could be a number: extracted and gold ones, and the codes of all texts."""
    one = table(spark, d, "invoice_extractions_ml").select(F.col("invoice_number").alias("number"))
    two = table(spark, d, "gold_dataset").select("invoice_number")
    three = raw(spark, d).select(F.explode(F.regexp_extract_all("raw_text", F.lit(r"([A-Za-z0-9/#-]{3,26})"), F.lit(1))))
    df = one.union(two).union(three).filter("number IS NOT NULL").distinct()
    return df.select("number", baseline.valid_number(F.col("number")).alias("valid"), candidates.bad_number(F.col("number")).alias("bad_candidate"))


_ROWS = "(SELECT DISTINCT doc_id, invoice_number, due_date, total_amount, issuer_name FROM invoice_extractions_ml)"
_A = "regexp_replace(issuer_name, '[^ -~]', '', 'g')"


@query(
    f"SELECT doc_id, CASE WHEN {S.valid_number('invoice_number')} THEN invoice_number END AS invoice_number, CASE WHEN regexp_matches(due_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN due_date END AS due_date, "
    f"CASE WHEN regexp_matches(total_amount, '^[0-9]+\\.[0-9]{{2}}$') THEN total_amount END AS total_amount, CASE WHEN {S.digits(_A)} <= 5 AND NOT {S.has(_A, P.BAD_PARTY)} AND {_A} <> '' THEN {_A} END AS issuer_name FROM {_ROWS}"
)
def validated_extractions(spark, d):
    """Extracted values after the checks that null out impossible ones."""
    df = table(spark, d, "invoice_extractions_ml").select("doc_id", "invoice_number", "due_date", "total_amount", "issuer_name").distinct()
    fields = {c: F.col(c) for c in ("invoice_number", "due_date", "total_amount")}
    fields |= {"issuer_name": F.regexp_replace("issuer_name", "[^ -~]", ""), "recipient_name": F.lit(None).cast("string"), "invoice_date": F.lit(None).cast("string")}
    ok = baseline.validate(fields)
    return df.select("doc_id", *[ok[c].alias(c) for c in ("invoice_number", "due_date", "total_amount", "issuer_name")])


# Lines ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, i AS line_idx, CASE WHEN n <= 1 THEN 0.0 ELSE {S.round4('CAST(i AS DOUBLE) / (n - 1)')} END AS rel_pos FROM (SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS i, len(ls) AS n FROM (SELECT doc_id, {S.lines('raw_text')} AS ls FROM {S.RAW}))")
def line_positions(spark, d):
    ls = X.lines(F.col("raw_text"))
    df = raw(spark, d).select("doc_id", F.size(ls).alias("n"), F.posexplode(ls).alias("line_idx", "line"))
    return df.select("doc_id", "line_idx", X.rel_pos(F.col("line_idx"), F.col("n")).alias("rel_pos"))


_ALL = f"[{S.strip('z')} FOR z IN string_split_regex(coalesce(raw_text, ''), '{S.EOL}')]"
_STOPS = f"list_min([j FOR j IN range(1, len(b) + 1) IF trim(b[j]) = '' OR {S.has('b[j]', P.BLOCK_STOP)}])"
_BLOCKS = (
    f"SELECT doc_id, i, b[1:coalesce({_STOPS}, len(b) + 1) - 1] AS block FROM (SELECT doc_id, i, ls[i + 1:i + 4] AS b FROM "
    f"(SELECT doc_id, ls, unnest([j FOR j IN range(1, len(ls) + 1) IF {S.has('ls[j]', P.RECIPIENT_LABEL)}]) AS i FROM (SELECT doc_id, {_ALL} AS ls FROM {S.INVOICES})))"
)
_FIRST_BLOCK = f"SELECT doc_id, arg_min(block, i) AS block FROM ({_BLOCKS}) WHERE len(block) > 0 GROUP BY doc_id"


@query(f"SELECT doc_id, array_to_string(block, ' | ') AS block FROM (SELECT doc_id FROM {S.INVOICES}) LEFT JOIN ({_FIRST_BLOCK}) USING (doc_id)")
def block_after_label(spark, d):
    """The lines under the first recipient label that has any."""
    all_lines = F.transform(F.split(X.empty(F.col("raw_text")), X.EOL), X.strip)
    return invoices(spark, d).select("doc_id", F.array_join(rules.block_after(all_lines, P.RECIPIENT_LABEL, 4, P.BLOCK_STOP), " | ").alias("block"))


@query(f"SELECT doc_id, ls[1] AS first_line, ls[-1] AS last_line, len(ls) AS lines FROM (SELECT doc_id, {S.lines('raw_text')} AS ls FROM {S.RAW})")
def first_and_last_line(spark, d):
    ls = X.lines(F.col("raw_text"))
    return raw(spark, d).select("doc_id", F.get(ls, F.lit(0)).alias("first_line"), F.when(F.size(ls) > 0, F.element_at(ls, -1)).alias("last_line"), F.size(ls).cast("long").alias("lines"))


_USED = "lower(file_name)"


@query(f"SELECT file_name, count(DISTINCT substring({_USED}, i, n)) AS grams FROM (SELECT DISTINCT file_name FROM manifest), (SELECT unnest(range(1, 200)) AS i), (VALUES (3), (4), (5)) t(n) WHERE i + n - 1 <= length(file_name) GROUP BY 1")
def character_grams(spark, d):
    """How many different substrings of three to five characters each manifest file name has."""
    from paperloom.operators.models import char_grams

    df = char_grams(table(spark, d, "manifest").select("file_name").distinct(), "file_name")
    return df.select("file_name", F.size(F.array_distinct("grams")).cast("long").alias("grams"))


# Boxes ------------------------------------------------------------------------------------------------------------

_W = "(SELECT DISTINCT file_stem, block_num, par_num, line_num, word_num, CAST(left_px AS DOUBLE) AS l, CAST(top_px AS DOUBLE) AS t, CAST(left_px + width AS DOUBLE) AS r, CAST(top_px + height AS DOUBLE) AS b FROM ocr_word_boxes)"


@query(f"SELECT *, 3300.0 - b AS flipped_top, 3300.0 - t AS flipped_bottom FROM {_W}")
def box_flip(spark, d):
    """Word boxes on a page of 3300 pixels, measured from its lower edge."""
    df = _word_boxes(spark, d)
    left, top, right, bottom = boxes.flip(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(3300.0))
    return df.withColumns({"flipped_top": top, "flipped_bottom": bottom})


def _word_boxes(spark, d):
    px = lambda *c: sum((F.col(x) for x in c[1:]), F.col(c[0])).cast("double")
    return table(spark, d, "ocr_word_boxes").select(
        "file_stem", "block_num", "par_num", "line_num", "word_num", px("left_px").alias("l"), px("top_px").alias("t"), px("left_px", "width").alias("r"), px("top_px", "height").alias("b")
    ).distinct()


_OVER = "CASE WHEN least(x.b - x.t, y.b - y.t) <= 0 THEN 0.0 ELSE greatest(0.0, least(x.b, y.b) - greatest(x.t, y.t)) / least(x.b - x.t, y.b - y.t) END"
_WORD_PAIRS = f"{_W} x JOIN {_W} y ON x.file_stem = y.file_stem AND x.block_num = y.block_num AND x.par_num = y.par_num AND x.line_num = y.line_num AND y.word_num = x.word_num + 1"


@query(f"SELECT x.file_stem, count(*) AS pairs, round(avg({_OVER}), 6) AS mean_overlap, CAST(sum(CAST({_OVER} >= 0.6 AS INT)) AS BIGINT) AS level FROM {_WORD_PAIRS} GROUP BY 1")
def box_vertical_overlap(spark, d):
    """Shared height of neighbouring words."""
    x = _word_boxes(spark, d)
    y = x.select("file_stem", "block_num", "par_num", "line_num", (F.col("word_num") - 1).alias("word_num"), *[F.col(c).alias(f"y{c}") for c in "ltrb"])
    pair = x.join(y, ["file_stem", "block_num", "par_num", "line_num", "word_num"])
    one, two = tuple(F.col(c) for c in "ltrb"), tuple(F.col(f"y{c}") for c in "ltrb")
    o = boxes.vertical_overlap(one, two)
    return pair.groupBy("file_stem").agg(F.count("*").alias("pairs"), F.round(F.avg(o), 6).alias("mean_overlap"), F.sum((o >= 0.6).cast("int")).alias("level"))


_IOU = "CASE WHEN {u} <= 0 THEN 0.0 ELSE {c} / {u} END"
_COMMON = "greatest(0.0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0.0, least(x.b, y.b) - greatest(x.t, y.t))"
_AREA = "greatest(0.0, {0}.r - {0}.l) * greatest(0.0, {0}.b - {0}.t)"
_UNION = f"({_AREA.format('x')} + {_AREA.format('y')} - {_COMMON})"


@query(f"SELECT x.file_stem, count(*) AS pairs, CAST(sum(CAST({_IOU.format(u=_UNION, c=_COMMON)} >= 0.15 OR {_OVER} >= 0.60 AS INT)) AS BIGINT) AS by_box FROM {_WORD_PAIRS} GROUP BY 1")
def positive_by_box(spark, d):
    """Neighbouring words that would be labelled positive for each other by their boxes alone."""
    x = _word_boxes(spark, d)
    y = x.select("file_stem", "block_num", "par_num", "line_num", (F.col("word_num") - 1).alias("word_num"), *[F.col(c).alias(f"y{c}") for c in "ltrb"])
    pair = x.join(y, ["file_stem", "block_num", "par_num", "line_num", "word_num"])
    hit = lines.positive(F.lit("one"), F.lit("two"), tuple(F.col(c) for c in "ltrb"), tuple(F.col(f"y{c}") for c in "ltrb"))
    return pair.groupBy("file_stem").agg(F.count("*").alias("pairs"), F.sum(hit.cast("int")).alias("by_box"))
