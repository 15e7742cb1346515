"""The few shapes behind rule-driven extraction, as expression builders over rule tables.

A rule table is data; engines differ in nothing but their rows. All combinators are built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from re import _constants as op
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import count_of, flag, has, let


def extract(text: Column, pattern: str, group: int = 1, flags: str = "iU") -> Column:
    """First match's group; null instead of the empty string Spark gives without a match."""
    return F.nullif(F.regexp_extract(text, f"(?{flags}){pattern}", group), F.lit(""))


def first_match(text: Column, patterns: Sequence[str], then: Callable[[Column], Column] = lambda x: x, flags: str = "iU") -> Column:
    """First pattern, in order, whose first match survives ``then`` (null rejects it)."""
    return F.coalesce(*[let(extract(text, p, 1, flags), then) for p in patterns])


def first_matching(text: Column, patterns: Sequence[str], then: Callable[[Column], Column]) -> Column:
    """``then`` of the first pattern that matches at all, even if that gives null."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(has(text, p), then(extract(text, p))).otherwise(out)
    return out


def _longest(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer, the smaller one on ties."""
    return max((x for x in (a, b) if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _required(items) -> set[str] | None:
    best, run = None, ""
    for what, x in [*items, (None, None)]:
        if what is op.LITERAL:
            run += chr(x)
            continue
        best, run = _longest(best, {run} if run else None), ""
        if what is op.SUBPATTERN and not x[1] & re.IGNORECASE:
            best = _longest(best, _required(x[3]))
        elif what is op.BRANCH:
            parts = [_required(y) for y in x[1]]
            best = _longest(best, set().union(*parts) if all(parts) else None)
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT) and x[0] > 0:
            one = len(x[2]) == 1 and x[2][0][0] is op.LITERAL
            best = _longest(best, {chr(x[2][0][1]) * x[0]} if one else _required(x[2]))
    return best


def required(pattern: str) -> list[str]:
    """Literals of which each match of the case-sensitive pattern holds at least one; none if that isn't known."""
    try:
        tree = _parser.parse(pattern)
    except re.error:
        return []
    return [] if tree.state.flags & re.IGNORECASE else sorted(_required(tree) or [])


def weighted_count(text: Column, rules: Sequence[tuple[str, int]]) -> Column:
    """Sum of matches times weights. A pattern is only searched in texts with one of the literals that it requires."""
    total = F.lit(0)
    for pattern, weight in rules:
        n = count_of(text, pattern)
        if literals := required(pattern):
            there = text.contains(literals[0])
            for x in literals[1:]:
                there = there | text.contains(x)
            n = F.when(there, n).otherwise(0)
        total = total + n * weight
    return total


def weighted_presence(text: Column, rules: Sequence[tuple[str, int]]) -> Column:
    """Sum of the weights of the patterns present."""
    total = F.lit(0)
    for pattern, weight in rules:
        total = total + flag(text, pattern) * weight
    return total


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | has(text, p)
    return out


def indexed(lines: Column) -> Column:
    """Array of (i, line)."""
    return F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))


def best_line(items: Column, score: Callable[[Column, Column], Column], least: int, value: Callable[[Column], Column] = lambda x: x) -> Column:
    """Line with the greatest score, the first on ties; null if none reaches ``least``.

    ``items``: array of (i, line); ``score`` gets i and line and returns null to pass a line over.
    """
    scored = F.transform(items, lambda x: F.struct(score(x["i"], x["line"]).alias("s"), (-x["i"]).alias("o"), x["line"].alias("line")))
    best = F.array_max(F.filter(scored, lambda x: x["s"].isNotNull()))
    return let(best, lambda b: F.when(b["s"] >= least, value(b["line"])))


def block_after(lines: Column, label: str, size: int, stop: str) -> Column:
    """Lines after the first label line that has any, up to ``size``, a blank line or a stop word.

    ``lines`` may hold blank lines, which end a block.
    """
    at = F.transform(
        lines,
        lambda x, i: F.when(
            has(x, label),
            _take_while(F.slice(lines, i + 2, size), lambda y: (F.trim(y) != "") & ~has(y, stop)),
        ),
    )
    found = F.filter(at, lambda b: b.isNotNull() & (F.size(b) > 0))
    return F.get(found, F.lit(0))


def _take_while(items: Column, keep: Callable[[Column], Column]) -> Column:
    stops = F.transform(items, lambda x, i: F.when(~keep(x), i))
    first = F.coalesce(F.array_min(F.filter(stops, lambda x: x.isNotNull())), F.lit(1 << 30))
    return F.slice(items, F.lit(1), first)
