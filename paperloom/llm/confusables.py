"""One consistent form for text that looks alike (problem 4).

A token's resolved scripts are the intersection of its letters' script sets; a mark, digit or sign
belongs to every script. An empty intersection is a mixed-script token. Intersecting instead the scripts
in which each letter has a look-alike gives the scripts that could spell the whole token: a mixed token is
respelled in the one of them that fits best, and a token of one script is a whole-script confusable where
it could be spelled in another script that all other words of the value use. The remaining forms (width,
joined accents, ligatures, spaces, invisible characters) are then normalised.

Defined results: null stays null; empty stays empty; ordinary spaces, digits, case and right accents stay;
a value fully in another script stays; a mixed token that no single script can spell stays.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like Latin ones.
CYRILLIC_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "ѕ": "s",
    "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "ӏ": "l", "Ӏ": "I", "Ї": "Ï", "ї": "ï", "Ё": "Ë", "ё": "ë", "к": "k", "ѵ": "v", "Ѵ": "V",
}
GREEK_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u",
    "κ": "k", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "ό": "ó", "Ϲ": "C", "ί": "í", "ά": "á",
}
ARMENIAN_LATIN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L"}

CHEROKEE_LATIN = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G",
    "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    "Ꮷ": "d", "Ᏼ": "B", "ꭰ": "d", "ꮓ": "z", "ꮩ": "v", "ꮪ": "s", "ꮯ": "c", "ꮃ": "w",
}
COPTIC_LATIN = {
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T",
    "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x", "ⲩ": "y", "ⲓ": "i", "ⲕ": "k", "ⲛ": "n",
}
LISU_LATIN = {
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Scripts that are written together; a letter of one belongs to each of the writing systems that use it.
_SYSTEMS = {"CJK": "JPAN KORE HANB", "HIRAGANA": "JPAN", "KATAKANA": "JPAN", "HANGUL": "KORE", "BOPOMOFO": "HANB"}
# First words of character names that aren't names of scripts, and of scripts with another or a longer name.
_COMMON = set("MODIFIER MICRO SCRIPT MATHEMATICAL DOUBLE-STRUCK BLACK-LETTER EULER PLANCK INFORMATION SUPERSCRIPT TURNED VERTICAL CARON KATAKANA-HIRAGANA MASU VEDIC".split())
_RENAMED = {"MASCULINE": "LATIN", "FEMININE": "LATIN", "ROMAN": "LATIN", "KELVIN": "LATIN", "ANGSTROM": "LATIN", "OHM": "GREEK", "IDEOGRAPHIC": "CJK", "HENTAIGANA": "HIRAGANA"}
_TWO_WORDS = {"OLD", "NEW", "TAI", "LINEAR"}
_WIDTHS = {"FULLWIDTH", "HALFWIDTH"}

_ANY = -1
_BITS: dict[str, int] = {}


def _bit(script: str) -> int:
    """A bit of its own for each script and writing system (integers have as many bits as there are scripts)."""
    return _BITS.setdefault(script, 1 << len(_BITS))


LATIN = _bit("LATIN")
_TO_LATIN = {
    _bit(script): table
    for script, table in (
        ("CYRILLIC", CYRILLIC_LATIN), ("GREEK", GREEK_LATIN), ("ARMENIAN", ARMENIAN_LATIN), ("CHEROKEE", CHEROKEE_LATIN), ("COPTIC", COPTIC_LATIN), ("LISU", LISU_LATIN),
    )
}
_FROM_LATIN = {bit: {v: k for k, v in reversed(table.items())} for bit, table in _TO_LATIN.items()}
_LOOKALIKES = {ch for table in _TO_LATIN.values() for ch in table}
_RESPELLED = [LATIN, *_TO_LATIN]


def script_of(ch: str) -> str | None:
    """Name of the script of a letter, None if it belongs to all."""
    words = unicodedata.name(ch, "").split(" ")
    if words[0] in _WIDTHS:
        words = words[1:]
    if not words[0] or words[0] in _COMMON:
        return None
    return " ".join(words[:2]) if words[0] in _TWO_WORDS else _RENAMED.get(words[0], words[0])


@lru_cache(1 << 14)
def _scripts(ch: str) -> int:
    """Bit set of the scripts and writing systems that ``ch`` belongs to."""
    script = script_of(ch) if ch.isalpha() else None
    if script is None:
        return _ANY
    return _bit(script) | sum(map(_bit, _SYSTEMS.get(script, "").split()))


@lru_cache(1 << 14)
def _as_latin(ch: str) -> str:
    own = _scripts(ch)
    return _TO_LATIN.get(own, {}).get(ch, ch if own == LATIN else "")


@lru_cache(1 << 14)
def _reach(ch: str) -> int:
    """Bit set of the scripts in which ``ch`` has a look-alike, its own included."""
    own = _scripts(ch)
    latin = _as_latin(ch)
    if own == _ANY or not latin:
        return own
    return own | LATIN | sum(bit for bit, back in _FROM_LATIN.items() if latin in back)


def _respell(token: str, bit: int) -> str:
    out = []
    for ch in token:
        own = _scripts(ch)
        if own == _ANY or own == bit:
            out.append(ch)
        else:
            latin = _as_latin(ch)
            out.append(latin if bit == LATIN else _FROM_LATIN[bit][latin])
    return "".join(out)


def _forms(value: str) -> str:
    """Ordinary width, single letters, joined accents, ordinary spaces, nothing invisible."""
    out = []
    for ch in value:
        cp = ord(ch)
        if cp < 0x7F and cp >= 0x20:
            out.append(ch)
            continue
        kind = unicodedata.category(ch)
        if ch in "\t\n\r\v\f\x85" or kind in ("Zs", "Zl", "Zp"):
            out.append(" ")
        elif kind in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180E:
            continue
        elif ch in _LOOKALIKES or ch == "µ":
            out.append(ch)  # its compatibility form would be a letter that it does not look like or, of the sign, a Greek one
        elif 0xFF00 <= cp <= 0xFFEF or kind[0] == "L" and unicodedata.decomposition(ch).startswith(("<compat>", "<font>", "<wide>", "<narrow>")):
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def _and(token: str, of) -> int:
    found = _ANY
    for ch in token:
        found &= of(ch)
    return found


def _best(choices: int, votes: dict[int, int]) -> int:
    bits = [b for b in _RESPELLED if choices & b]
    return max(bits, key=lambda b: (votes.get(b, 0), -b)) if bits else 0


@lru_cache(1 << 16)
def canonical(value: str) -> str:
    """The consistent form of one value."""
    if value.isascii() and value.isprintable():
        return value
    value = _forms(value)
    if value.isascii():
        return value
    tokens = value.split(" ")
    resolved = [_and(t, _scripts) for t in tokens]
    # Letters that only one script can spell speak for it throughout; others for their own script.
    votes: dict[int, int] = {}
    for t in tokens:
        for ch in t:
            own = _scripts(ch)
            if own != _ANY:
                votes[own] = votes.get(own, 0) + (1 if _reach(ch) != own else 1 << 10)
    out = []
    for i, (t, have) in enumerate(zip(tokens, resolved)):
        if have == _ANY:
            out.append(t)
            continue
        can = _and(t, _reach)
        if have == 0:
            own: dict[int, int] = {}
            for ch in t:
                if (s := _scripts(ch)) != _ANY:
                    own[s] = own.get(s, 0) + 1
            # In a short mixed token the rest of the value decides, in a long one its own letters.
            bit = _best(can, votes) if can else 0
            out.append(_respell(t, bit) if bit else _by_word(t))
        else:
            others = _ANY
            for k, s in enumerate(resolved):
                if k != i and s not in (0, _ANY):
                    others &= s
            foreign = others not in (0, _ANY) and not others & have and can & others
            out.append(_respell(t, _best(can & others, votes)) if foreign else t)
    return " ".join(out)


def _by_word(token: str) -> str:
    """Respell each run of letters of a token that no one script can spell as a whole."""
    out, run = [], ""
    for ch in token + "\0":
        if ch != "\0" and (ch.isalpha() or unicodedata.combining(ch)):
            run += ch
            continue
        if run:
            can = _and(run, _reach)
            if _and(run, _scripts) == 0 and can:
                votes: dict[int, int] = {}
                for c in run:
                    votes[_scripts(c)] = votes.get(_scripts(c), 0) + 1
                run = _respell(run, _best(can, votes))
            out.append(run)
            run = ""
        if ch != "\0":
            out.append(ch)
    return "".join(out)


@F.pandas_udf(StringType())
def _canonical_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else canonical(v))


def consistent(col: Column) -> Column:
    """``col`` in its consistent form. Plain ASCII values pass by in the JVM's comparison afterwards."""
    return _canonical_udf(col)


FIELDS = ("issuer_name", "recipient_name")


def values(extractions: DataFrame) -> DataFrame:
    """(doc_id, field_name, value): one row for each different value of a document's name fields."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])
    )
    return extractions.select("doc_id", pairs.alias("x")).select("doc_id", "x.*").filter("value IS NOT NULL AND value <> ''").distinct()


def normalized(extractions: DataFrame) -> DataFrame:
    """(doc_id, field_name, value, canonical). Only values with a character outside printable ASCII reach Python."""
    all_values = values(extractions)
    plain = F.col("value").rlike(r"^[\x20-\x7e]*\z")
    other = all_values.filter(~plain).withColumn("canonical", consistent(F.col("value")))
    return all_values.filter(plain).withColumn("canonical", F.col("value")).unionByName(other)


def found(extractions: DataFrame) -> DataFrame:
    """(doc_id, field_name) with a value that isn't in the consistent form."""
    odd = values(extractions).filter(~F.col("value").rlike(r"^[\x20-\x7e]*\z"))
    return odd.filter(consistent(F.col("value")) != F.col("value")).select("doc_id", "field_name").distinct()
