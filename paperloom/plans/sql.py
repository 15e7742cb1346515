"""Pieces of the SQL that queries are compared with; written from the rule tables, run by another engine."""

from __future__ import annotations

RAW = "(SELECT DISTINCT doc_id, file_name, label, source_dataset, raw_text FROM raw_documents)"
INVOICES = f"(SELECT * FROM {RAW} WHERE label = 'invoice')"
EOL = r"\r\n|[\n\r\x0b\f]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {lit('(?i)' + pattern)}), false)"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def flag(x: str, pattern: str) -> str:
    return f"CAST({has(x, pattern)} AS INT)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squash(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def lines(x: str) -> str:
    return f"[y FOR y IN [{strip('z')} FOR z IN string_split_regex(coalesce({x}, ''), '{EOL}')] IF y <> '']"


def tokens(x: str) -> str:
    return rf"[y FOR y IN string_split_regex(coalesce({x}, ''), '\s+') IF y <> '']"


def digits(x: str) -> str:
    return count(f"coalesce({x}, '')", r"\p{Nd}")


def letters(x: str) -> str:
    return count(f"coalesce({x}, '')", r"\p{L}")


def weighted(x: str, rules: list[tuple[str, int]]) -> str:
    return " + ".join(f"{count(x, p)} * {w}" for p, w in rules)


def presence(x: str, rules: list[tuple[str, int]]) -> str:
    return " + ".join(f"{flag(x, p)} * {w}" for p, w in rules)


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {lit('(?i)' + pattern)}, {group}), '')"


def amount(x: str) -> str:
    """Currency signs, spaces and commas dropped; positive numbers with two places."""
    v = rf"TRY_CAST(regexp_replace({x}, '[£€$¥₹\s,]', '', 'g') AS DOUBLE)"
    return f"CASE WHEN {v} > 0 THEN printf('%.2f', {v}) END"


def valid_number(x: str) -> str:
    return (
        f"(length({x}) BETWEEN 4 AND 24 AND {has(x, '[0-9]')} AND NOT regexp_matches({x}, '^[A-Z][0-9]{{3}}$') "
        f"AND NOT {has(x, '^(amount|date|number|total|page|client|reference|explanation)$')} "
        rf"AND NOT regexp_matches({x}, '^[a-z]{{5,}}$') AND NOT regexp_matches({x}, '[^\p{{L}}\p{{N}}_\-/]'))"
    )


def clean_name(x: str) -> str:
    return f"substring({strip(squash(f'regexp_replace({x}, {lit(chr(94) + r"[^\p{L}\p{N}_]+")}, {lit("")})'))}, 1, 100)"


def round4(x: str) -> str:
    """Half up on the decimal value, as Spark rounds doubles."""
    return f"CAST(round(CAST({x} AS DECIMAL(18, 12)), 4) AS DOUBLE)"
