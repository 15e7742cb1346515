"""Text normalisation and scalar text features as Column -> Column functions.

Everything here is built-in expressions, so nothing leaves the JVM. Those with lambdas (``let``, ``lines``, ``words`` and
whatever filters or transforms arrays) are evaluated by the engine's interpreter within the stage instead of generated
code. Nulls: functions that return text keep null; counts, ratios and flags treat null as the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.splitlines takes as line ends.
EOL = "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"

# The stop words of the fallback tokeniser.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can of in "
    "to for with on at from by and or but not no if as it its this that these those i you he she we they me him her us "
    "them my your"
).split()

# Word lists of the lexicon flags.
ORG_SUFFIX = r"\b(inc\.?|corp\.?|ltd\.?|llc\.?|company|companies|corporation|group|institute|research|center|centre|services?|laboratories?|labs?|associates?)\b"
ADDRESS_WORD = r"\b(street|st\.?|avenue|ave\.?|road|rd\.?|boulevard|blvd|lane|drive|dr\.?|suite|floor)\b"
LABEL_WORD = r"\b(invoice|date|terms|amount|total|reference|explanation|remit|payment|purchase order)\b"

# Flags of a line and its neighbours.
CONTEXT_FLAGS = {
    "ctx_has_invoice": r"\binvoice\b",
    "ctx_has_invoice_no": r"\binvoice\s*(?:no|number|#)\b",
    "ctx_has_bill_to": r"\bbill\s*to\b",
    "ctx_has_sold_to": r"\bsold\s*to\b",
    "ctx_has_ship_to": r"\bship(?:ped)?\s*to\b",
    "ctx_has_attention": r"\b(attn|attention)\b",
    "ctx_has_total": r"\btotal\b",
    "ctx_has_amount_due": r"\b(amount due|balance due|net amount|total amount due)\b",
    "ctx_has_reference": r"\breference\b",
    "ctx_has_due": r"\bdue\b",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    Common subexpressions within CASE branches aren't eliminated by the engine; a lambda variable is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def has(c: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode classes, as Python's re does it; false for null."""
    return F.coalesce(c.rlike(f"(?iU){pattern}"), F.lit(False))


def flag(c: Column, pattern: str) -> Column:
    return has(c, pattern).cast("int")


def count_of(c: Column, pattern: str) -> Column:
    """Number of non-overlapping matches; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(f"(?U){pattern}")), F.lit(0))


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(empty(text), EOL), strip), lambda x: x != "")


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(empty(text), r"(?U)\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(words(text))


def clean_text(raw: Column) -> Column:
    """Lower-case tokens without stop words, long repetitions shortened to two characters."""
    t = F.lower(F.regexp_replace(empty(raw), "[\u00a0\u200b\u2028\u2029]", " "))
    t = F.regexp_replace(F.regexp_replace(t, "\n+", " "), "[ \t]+", " ")
    t = F.regexp_replace(t, r"(.)\1{4,}", "$1$1")
    keep = lambda x: ~x.isin(STOPWORDS) & x.rlike("[a-z0-9$€£¥]")
    return F.array_join(F.filter(words(t), keep), " ")


def count_chars(c: Column, pattern: str) -> Column:
    """Number of characters of a class, from the length that is left without them; 0 for null."""
    t = empty(c)
    return F.length(t) - F.length(F.regexp_replace(t, f"(?:{pattern})+", ""))


def digits(c: Column) -> Column:
    return count_chars(c, r"\p{Nd}")


def letters(c: Column) -> Column:
    return count_chars(c, r"\p{L}")


def uppercase_ratio(c: Column) -> Column:
    n = letters(c)
    return F.when(n == 0, 0.0).otherwise(F.round(count_chars(c, r"\p{Lu}") / n, 4))


def digit_ratio(c: Column) -> Column:
    n = F.length(empty(c))
    return F.when(n == 0, 0.0).otherwise(F.round(digits(c) / n, 4))


def rel_pos(index: Column, n: Column) -> Column:
    return F.when(n <= 1, 0.0).otherwise(F.round(index / (n - 1), 4))


def word_shape(c: Column) -> Column:
    """Capitals as A, small letters as a, digits as 0; 40 characters at most."""
    s = F.regexp_replace(c, r"\p{Lu}", "A")
    s = F.regexp_replace(s, r"\p{Ll}", "a")
    return F.substring(F.regexp_replace(s, r"\p{Nd}", "0"), 1, 40)


def is_upper(c: Column) -> Column:
    """Python's str.isupper: a capital and no small letter."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def is_title(c: Column) -> Column:
    """Python's str.istitle for alphabetic words: capitals only and always at word starts."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{L}\p{Lu}|(?<!\p{L})\p{Ll}")


def context_flags(line: Column, before: Column, after: Column) -> dict[str, Column]:
    joined = F.lower(F.concat_ws(" | ", empty(before), empty(line), empty(after)))
    return {name: flag(joined, p) for name, p in CONTEXT_FLAGS.items()}


def clean_name(c: Column) -> Column:
    """Leading marks dropped, white space squashed, 100 characters at most."""
    return F.substring(strip(squash(F.regexp_replace(c, r"(?U)^[\s\W]+", ""))), 1, 100)


def post_ocr_cleanup(c: Column) -> Column:
    """Trade-mark signs dropped, stray single letters joined, bars between letters read as l."""
    s = F.regexp_replace(c, "[™®©]+", "")
    s = F.regexp_replace(s, r"(?U)(?<=\w) ([A-Za-z]) (?=\w)", "$1")
    return F.regexp_replace(s, r"(?<=[A-Za-z])\|(?=[A-Za-z])", "l")


def strip_issuer_prefix(c: Column) -> Column:
    """A leading single letter, quotes or document-type word dropped, unless under three characters are left."""
    s = strip(F.regexp_replace(c, r"(?U)^[A-Za-z]\s+(?=[A-Z])", ""))
    s = strip(F.regexp_replace(s, "^['\"`]+", ""))
    s = strip(F.regexp_replace(s, r"(?iU)^(?:invoice|tax\s+invoice|bill|receipt)\s+", ""))
    return F.when(F.length(s) >= 3, s).otherwise(c)


def fold_accents(c: Column) -> Column:
    """Accents of Latin letters dropped, other characters outside ASCII too."""
    pairs = {
        "a": "àáâãäåāă", "c": "çćč", "e": "èéêëēėę", "i": "ìíîïīı", "n": "ñńň", "o": "òóôõöøōő", "s": "śšş", "u": "ùúûüūůű", "y": "ýÿ", "z": "źżž", "l": "ł",
    }
    src = "".join(v for v in pairs.values())
    dst = "".join(k * len(v) for k, v in pairs.items())
    return F.regexp_replace(F.translate(F.lower(c), src, dst), r"[^\x00-\x7f]", "")


def box_text(c: Column) -> Column:
    """Lower case, white space squashed, only letters, digits and a few marks."""
    return strip(squash(F.regexp_replace(squash(F.lower(empty(c))), r"[^a-z0-9:/.,#\- ]", "")))


def contains_either_way(a: Column, b: Column) -> Column:
    """Either text contains the other; empty texts never match."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def buyer_name(c: Column) -> Column:
    """Recipient from a buyer block: the first line without its label, else the second line."""
    parts = F.transform(F.split(empty(c), "\n"), strip)
    first = strip(F.regexp_replace(F.get(parts, F.lit(0)), r"(?iU)^(bill\s*to|buyer|customer|client)\s*[:\-]?\s*", ""))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.get(parts, F.lit(1)), F.lit("")))
