"""SQL of the versioned regex extraction, written from its rule tables for an engine without look-around.

Look-behinds become consumed characters or marks put into the text beforehand; one-element comprehensions bind values.
"""

from __future__ import annotations

from paperloom.functions import dates
from paperloom.operators import patterns as P
from paperloom.operators.regex_fields import VERSIONS, Version
from paperloom.plans import sql as S

V5 = VERSIONS["v5"]

MARKS = "' -:|,;'"
_MONTHS = "|".join([*dates.MONTHS, *(m[:3] for m in dates.MONTHS if m != "may")])
_NUMERIC = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})|(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})"


def extract(x: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({x}, {S.lit(f'(?{flags})' + pattern)}, {group}), '')"


def let(x: str, name: str, body: str) -> str:
    return f"([{body} FOR {name} IN [{x}]])[1]"


def _ymd(y: str, m: str, d: str) -> str:
    return f"printf('%04d-%02d-%02d', {y}, {m}, {d})"


def named_dates(source: str, texts: list[str]) -> str:
    """(doc_id, k, v): the date read from each of ``texts``, expressions over ``source``."""
    group = lambda i: f"TRY_CAST(nullif(regexp_extract(s, {S.lit(_NUMERIC)}, {i}), '') AS INT)"
    month = f"CASE lower(substring(regexp_extract(s, '(?i)({_MONTHS})', 1), 1, 3)) " + " ".join(f"WHEN '{m[:3]}' THEN {i}" for i, m in enumerate(dates.MONTHS, 1)) + " END"
    rest = f"regexp_replace(s, '(?i)^(.*?)({_MONTHS})', '\\1')"
    year = "CASE WHEN c >= 100 THEN c WHEN c < 50 THEN 2000 + c ELSE 1900 + c END"
    numeric = f"CASE WHEN a > 31 OR b > 31 THEN NULL WHEN a > 12 THEN {_ymd(year, 'b', 'a')} WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN {_ymd(year, 'a', 'b')} END"
    named = f"CASE WHEN m IS NOT NULL AND day BETWEEN 1 AND 31 AND year BETWEEN 1900 AND 2100 THEN {_ymd('year', 'm', 'day')} END"
    return (
        f"SELECT doc_id, k, coalesce({numeric}, {named}) AS v FROM (SELECT doc_id, k, coalesce({group(1)}, {group(4)}) AS a, coalesce({group(2)}, {group(5)}) AS b, coalesce({group(3)}, {group(6)}) AS c, "
        f"{month} AS m, TRY_CAST(nullif(regexp_extract({rest}, '(\\d{{1,2}})', 1), '') AS INT) AS day, TRY_CAST(nullif(regexp_extract(s, '(\\d{{4}})', 1), '') AS INT) AS year FROM "
        f"(SELECT doc_id, k, regexp_replace(substring(trim(x), 1, 50), '\\s+[a-zA-Z]\\s+(\\d{{4}})', ' \\1', 'g') AS s FROM (SELECT doc_id, unnest([{', '.join(texts)}]) AS x, unnest(range({len(texts)})) AS k FROM ({source}))))"
    )


SOURCE = f"SELECT doc_id, coalesce(raw_text, '') AS t FROM {S.INVOICES}"


def source(v: Version) -> str:
    return SOURCE.replace("coalesce(raw_text, '')", "lower(coalesce(raw_text, ''))") if v.lower else SOURCE


_DUE_MARKED = "regexp_replace(t, '(?i)(due )d(ate)', '\\1#\\2', 'g')"
_PAY_MARKED = "regexp_replace(t, '(?i)((?:due|pay)\\s)d(ate)', '\\1#\\2', 'g')"


def _date_text(pattern: str) -> str:
    if pattern == P.V5_DATE[3]:
        return extract(_DUE_MARKED, pattern.replace("(?<![Dd][Uu][Ee] )", ""), 1, "im")
    if pattern == P.V5_DATE[4]:
        return extract(_PAY_MARKED, r"(?:^|\s)date\s*:\s*" + P._DATE_TEXT, 1, "im")
    return extract("t", pattern, 1, "im")


def invoice_dates(v: Version = V5) -> str:
    texts = [_date_text(p) for p in v.dates]
    if v.early_date:
        texts.append(extract("string_split_regex(t, '(?i)due\\s*date')[1]", P.WRITTEN_DATE))
    return f"SELECT doc_id, arg_min(v, k) AS d FROM ({named_dates(source(v), texts)}) WHERE v IS NOT NULL GROUP BY doc_id"


def due_dates(v: Version = V5) -> str:
    found = f"SELECT doc_id, arg_min(v, k) AS u FROM ({named_dates(source(v), [extract('t', p, 1, 'im') for p in v.due])}) LEFT JOIN ({invoice_dates(v)}) USING (doc_id) WHERE v IS NOT NULL AND v IS DISTINCT FROM d GROUP BY doc_id"
    phrase = S.strip(extract("t", P.V5_TERMS))
    at_once = f"CASE WHEN {S.has('x', 'receipt|immediately')} THEN coalesce(d, x) ELSE x END" if v.immediate else "x"
    return f"SELECT doc_id, coalesce(u, {at_once}) AS due_date FROM (SELECT doc_id, {phrase} AS x FROM ({source(v)})) LEFT JOIN ({found}) USING (doc_id) LEFT JOIN ({invoice_dates(v)}) USING (doc_id)"


def _number(pattern: str, tail: bool) -> str:
    pattern = pattern.replace(r"(?<!\w)#", r"(?:^|[^\w])#")
    ok = f"regexp_matches(v, '[0-9]') AND length(v) >= 3 AND NOT {S.has('v', P.V5_NUMBER_STOP)}"
    cut = S.strip(r"regexp_replace(w, '\s+[A-Za-z]+$', '')")
    value = "v"
    if tail:
        more = f"nullif(regexp_extract(t, {S.lit('(?i)' + pattern + r'\s+(\d{3,6})(?:\s|$)')}, 2), '')"
        joined = "CASE WHEN z IS NOT NULL AND regexp_matches(v, '[A-Za-z]') AND NOT (length(z) = 4 AND CAST(z AS INT) BETWEEN 1900 AND 2099) THEN v || ' ' || z ELSE v END"
        value = let(more, "z", joined)
    checked = let(value, "w", let(cut, "y", f"CASE WHEN {ok} AND length(y) >= 3 THEN upper(y) END"))
    return let(S.strip(extract("t", pattern)), "v", checked)


def numbers(v: Version = V5) -> str:
    return f"SELECT doc_id, coalesce({', '.join(_number(p, v.tail) for p in v.number)}) AS invoice_number FROM ({source(v)})"


def _amount_v5(x: str) -> str:
    s = rf"regexp_replace({x}, '[£$€¥₹\s]', '', 'g')"
    number = rf"TRY_CAST(CASE WHEN regexp_matches(s, '^\d{{1,3}}(?:\.\d{{3}})*,\d{{1,2}}$') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END AS DOUBLE)"
    return let(s, "s", let(number, "f", "CASE WHEN f > 0 AND NOT (floor(f) BETWEEN 1900 AND 2099 AND f - floor(f) < 0.01) THEN printf('%.2f', f) END"))


def _amount_plain(x: str) -> str:
    return let(rf"TRY_CAST(regexp_replace({x}, '[£€$¥₹\s,]', '', 'g') AS DOUBLE)", "f", "CASE WHEN f > 0 THEN printf('%.2f', f) END")


def totals(v: Version = V5) -> str:
    """Last labelled amount by its place in the text, else the last other one."""
    parts = []
    normal = _amount_v5 if v.amount_v5 else _amount_plain
    for p, labelled in v.amounts:
        whole, value, gaps = (f"regexp_extract_all(t, {S.lit('(?i)' + p)}, {g})" if g < 2 else f"string_split_regex(t, {S.lit('(?i)' + p)})" for g in (0, 1, 2))
        parts.append(
            f"SELECT doc_id, {labelled} AS labelled, list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(g) FOR g IN whole[1:i - 1]]), 0) AS place, {normal('value[i]')} AS a FROM "
            f"(SELECT doc_id, whole, value, gaps, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, {whole} AS whole, {value} AS value, {gaps} AS gaps FROM ({source(v)})))"
        )
    rows = " UNION ALL ".join(parts)
    return f"SELECT doc_id, coalesce(arg_max(a, {{'p': place, 'a': a}}) FILTER (WHERE labelled), arg_max(a, {{'p': place, 'a': a}}) FILTER (WHERE NOT labelled)) AS total_amount FROM ({rows}) WHERE CAST(a AS DOUBLE) >= {v.floor} GROUP BY doc_id"


_ALPHA = f"{S.letters('x')} / greatest(length(x), 1)"
_READABLE = f"({_ALPHA} >= 0.35 AND length(x) BETWEEN 4 AND 120)"
_UPPER = r"regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}')"
_TITLE = r"regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{L}\p{Lu}|(?:^|[^\p{L}])\p{Ll}')"


def issuers(v: Version = V5) -> str:
    label = let(S.strip(S.squash(extract("t", P.V5_SELLER_LABEL, 1, "im"))), "x", "CASE WHEN length(x) > 4 AND length(x) < 100 THEN x END")
    above = f"CASE WHEN {S.has('t', P.V5_BILL_TO)} THEN {S.lines(f"string_split_regex(t, {S.lit('(?i)' + P.V5_BILL_TO)})[1]")} END"
    near = f"[x FOR x IN list_reverse(above)[1:6] IF {_READABLE} AND {S.has('x', P.V5_COMPANY)}]"
    top = f"([x FOR x IN above[1:4] IF {_ALPHA} >= 0.5 AND len({S.tokens('x')}) >= 2])[1]"
    kinds = ", ".join(S.lit(k) for k in P.V5_DOC_TYPES)
    like = rf"(len({S.tokens('x')}) BETWEEN 1 AND 3 AND {_ALPHA} >= 0.7 AND NOT regexp_matches(x, '\d') AND (({_UPPER}) OR ({_TITLE})))"
    header = f"[x FOR x IN ls[1:6] IF {_READABLE} AND lower(x) NOT IN ({kinds}) AND ({S.has('x', P.V5_COMPANY)} OR {like})]"
    first = "h[1]" if not v.shortest else "([x FOR x IN h IF length(x) = list_min([length(y) FOR y IN h])])[1]"
    return (
        f"SELECT doc_id, {S.strip(S.squash(f'coalesce(label, {'near, top, ' if v.seller_above else ''}{first})'))} AS issuer_name FROM (SELECT doc_id, label, ({near})[1] AS near, {top} AS top, {header} AS h FROM "
        f"(SELECT doc_id, {label} AS label, {above} AS above, {S.lines('t')} AS ls FROM ({source(v)})))"
    )


_MAIL = r"[\p{L}\p{N}_\.-]+@[\p{L}\p{N}_\.-]+\.[\p{L}\p{N}_]+"


def _party(x: str) -> str:
    bare = f"trim({S.squash(S.strip(f'regexp_replace(c, {S.lit("(?i)" + P.V5_PARTY_STRIP)}, {S.lit("")})'))}, {MARKS})"
    plain = rf"NOT {S.has('s', P.V5_PARTY_BAD)} AND NOT regexp_matches(s, '\d') AND length(s) BETWEEN 2 AND 80 AND NOT {S.has('s', P.V5_PARTY_EXACT)}"
    return let(x, "c", let(bare, "s", f"coalesce({extract('s', f'({_MAIL})')}, CASE WHEN {plain} THEN s END)"))


def recipients(v: Version = V5) -> str:
    same = [_party(extract("t", p, 1, "im")) for p in P.V5_PARTY_SAME_LINE[: v.same_line]]
    own = let(_party("sq[i]"), "o", "CASE WHEN lower(o) <> lower(sq[i]) THEN o END")
    after = f"([y FOR y IN [{_party('f')} FOR f IN sq[i + 1:i + 3]] IF y IS NOT NULL])[1]"
    anchored = f"([y FOR y IN [CASE WHEN {S.has('sq[i]', P.V5_PARTY_LABEL)} THEN coalesce({own}, {after}) END FOR i IN range(1, len(sq) + 1)] IF y IS NOT NULL])[1]"
    mail = extract(extract("t", P.V5_PARTY_EMAIL, 1, "im"), f"({_MAIL})")
    bare = S.strip(r"regexp_replace(x, '\s*\([A-Z ]+\)\s*$', '')")
    caps = f"([x FOR x IN [{bare} FOR x IN sq[1:60]] IF regexp_matches(x, {S.lit(P.ALL_CAPS_NAME)}) AND NOT {S.has('x', P.V5_PARTY_BAD)} AND NOT {S.has('x', P.ALL_CAPS_STOP)}])[1]"
    return f"SELECT doc_id, coalesce({', '.join(same)}, {anchored}, {mail}{', ' + caps if v.all_caps else ''}) AS recipient_name FROM (SELECT doc_id, t, [{S.squash('x')} FOR x IN {S.lines('t')}] AS sq FROM ({source(v)}))"


def record(v: Version = V5) -> str:
    fields = ["invoice_number", "d", "due_date", "issuer_name", "recipient_name", "total_amount"]
    names = ["invoice_number", "invoice_date", *fields[2:]]
    columns = ", ".join(f"{f'lower({f})' if v.lower else f} AS {n}" for f, n in zip(fields, names))
    return (
        f"SELECT doc_id, {columns} FROM ({numbers(v)}) JOIN ({due_dates(v)}) USING (doc_id) LEFT JOIN ({invoice_dates(v)}) USING (doc_id) "
        f"JOIN ({issuers(v)}) USING (doc_id) JOIN ({recipients(v)}) USING (doc_id) LEFT JOIN ({totals(v)}) USING (doc_id)"
    )
