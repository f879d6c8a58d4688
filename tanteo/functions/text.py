"""Text columns: accent folding, comparison keys, initials, CSV cells."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters trimmed from the ends of a text, and the same as a pattern.
BLANKS = " \t\n\r\f\v\u00a0\ufeff"
_BLANK_RUN = r"[\s\u00a0\ufeff]+"

# Fixed value: text a spreadsheet would run as a formula.
FORMULA_START = r"^[\t\r\n ]*[=+\-@]"
# Fixed value: initials shown for an empty name.
DEFAULT_INITIALS = "7M"


#: Combining marks that are dropped, as the accents of Latin, Greek and Cyrillic letters.
_MARKS = range(0x0300, 0x0370)
# How Hangul syllables are numbered by their leading, vowel and trailing letters.
_HANGUL, _LEADS, _VOWELS, _TRAILS = 0xAC00, 19, 21, 28


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Letters and what canonical decomposition leaves of them without marks: those that leave one letter, then those that leave
    none (as the two texts of ``translate``), and those that leave several. Hangul syllables are not listed."""
    source, target, gone, several = [], [], [], {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or _HANGUL <= code < _HANGUL + _LEADS * _VOWELS * _TRAILS:
            continue
        left = "".join(c for c in unicodedata.normalize("NFD", char) if ord(c) not in _MARKS)
        if left == char:
            continue
        if not left:
            gone.append(char)
        elif len(left) == 1:
            source.append(char)
            target.append(left)
        else:
            several[char] = left
    return "".join(source + gone), "".join(target), several


def strip_edges(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def null_if_blank(text: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def null_if_empty(text: Column) -> Column:
    """The value itself, null when it is the empty string."""
    return F.when(text.cast("string") != "", text)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text.cast("string")), F.lit("")) == ""


def fold_accents(text: Column) -> Column:
    """Text without accents: every character canonically decomposed, marks dropped.

    The per-character lookup runs only on text that is not plain ASCII, that of characters that decompose into several only on
    text that has one. They are looked for only in text with a character from the first of them on, which Latin, Greek and
    Cyrillic text has not, and by a lookup per character: a pattern would try some 120 ranges on each. Marks that stay are not
    put into canonical order.
    """
    source, target, several = _folding()
    is_ascii = F.octet_length(text) == F.char_length(text)
    may_spread = text.rlike(f"[{min(several)}-{chr(sys.maxunicode)}]")
    has_several = F.char_length(F.translate(text, "".join(several), "")) < F.char_length(text)
    has_syllable = text.rlike(f"[{chr(_HANGUL)}-{chr(_HANGUL + _LEADS * _VOWELS * _TRAILS - 1)}]")
    spread = may_spread & (has_several | has_syllable)
    return F.when(is_ascii, text).when(spread, F.translate(_decomposed(text), source, target)).otherwise(F.translate(text, source, target))


def _decomposed(text: Column) -> Column:
    several = F.create_map(*[F.lit(x) for pair in _folding()[2].items() for x in pair])

    def letters(first: int, n: int, number: Column) -> Column:
        return F.substring(F.lit("".join(chr(first + i) for i in range(n))), number + 1, F.lit(1))

    def one(at: Column) -> Column:
        char = F.substring(text, at, F.lit(1))
        number = F.ascii(char) - _HANGUL
        lead, vowel, trail = (F.floor(number / (_VOWELS * _TRAILS)), F.floor(number / _TRAILS) % _VOWELS, number % _TRAILS)
        syllable = F.concat(
            letters(0x1100, _LEADS, lead.cast("int")), letters(0x1161, _VOWELS, vowel.cast("int")),
            F.when(trail > 0, letters(0x11A8, _TRAILS - 1, trail - 1)).otherwise(""),
        )
        is_syllable = number.between(0, _LEADS * _VOWELS * _TRAILS - 1)
        return F.when(is_syllable, syllable).otherwise(F.coalesce(F.element_at(several, char), char))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def normalize_text(text: Column) -> Column:
    """Accent-free, lower-case, trimmed; null reads as empty."""
    return strip_edges(F.lower(fold_accents(F.coalesce(text.cast("string"), F.lit("")))))


def normalize_key(text: Column) -> Column:
    """``normalize_text`` with every run of other characters turned into one space."""
    return F.trim(F.regexp_replace(normalize_text(text), "[^a-z0-9]+", " "))


def initials(name: Column) -> Column:
    """First letters of the first two words, upper case."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), _BLANK_RUN), lambda w: w != "")
    letters = F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1))
    return F.coalesce(F.nullif(F.upper(F.array_join(letters, "")), F.lit("")), F.lit(DEFAULT_INITIALS))


def spanish(text: Column) -> Column:
    """Sort key: Spanish order, blind to case and accents (ñ stays a letter of its own)."""
    return F.collate(F.coalesce(text, F.lit("")), "es_CI_AI")


def safe_cell(value: Column, is_text: bool) -> Column:
    """Cell content as text; formula-like text gets a leading apostrophe, numbers never do."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text) if is_text else text


def csv_cell(value: Column, is_text: bool) -> Column:
    """Quoted CSV cell."""
    return F.concat(F.lit('"'), F.replace(safe_cell(value, is_text), F.lit('"'), F.lit('""')), F.lit('"'))


def json_record(*columns: str) -> Column:
    """The columns as one JSON object in their order, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def fingerprint(*parts: Column) -> Column:
    """MD5 of the non-null parts joined by a bar."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
