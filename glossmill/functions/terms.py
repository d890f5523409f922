"""When a glossary term occurs in a text, as a regular expression built once for each term."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import squash

SPACELESS = r"[฀-๿ᄀ-ᇿ぀-ヿ㄰-㆏㐀-䶿一-鿿가-힯豈-﫿ｦ-ﾝ]"
#: What makes a word go on: Latin letters, digits, underscore; other scripts are borders.
WORD = r"[\p{IsLatin}\p{Nd}_]"


def quote(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")


def mode(term: Column) -> Column:
    """substring (scripts without spaces), acronym (case counts) or word."""
    needle = squash(term)
    letters = F.regexp_replace(needle, r"\P{L}", "")
    return F.when(needle.rlike(SPACELESS), "substring").when((F.length(letters) >= 2) & (letters == F.upper(letters)) & (letters != F.lower(letters)), "acronym").otherwise("word")


def pattern(term: Column) -> Column:
    """Regular expression for squashed text; null for a blank term."""
    needle, kind = squash(term), mode(term)
    start = F.when(needle.rlike(f"^{WORD}"), f"(?<!{WORD})").otherwise("")
    suffix = F.when(~needle.rlike(r"\p{L}$"), "").when(kind == "acronym", "s?").otherwise("(?:s|es|'s|’s)?")
    end = F.when(needle.rlike(f"{WORD}$"), F.concat(suffix, F.lit(f"(?!{WORD})"))).otherwise("")
    word = F.concat(F.when(kind == "acronym", "").otherwise("(?iu)"), start, quote(needle), end)
    return F.when(needle != "", F.when(kind == "substring", F.concat(F.lit("(?iu)"), quote(needle))).otherwise(word))


#: The compatibility forms of full-width signs, letters and digits, ligatures, and the wide space.
_WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {"\u3000": " ", "\u00a0": " "}
_LONG = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "...", "ß": "ss", "㎏": "kg", "㎜": "mm", "㎝": "cm", "㎞": "km", "℃": "°c", "№": "no"}


def report_fold(c: Column) -> Column:
    """Small letters, compatibility forms as what they stand for: the signs that texts of these languages have of them."""
    c = F.translate(c, "".join(_WIDE), "".join(_WIDE.values()))
    for one, several in _LONG.items():
        c = F.replace(c, F.lit(one), F.lit(several))
    return F.lower(c)


def report_pattern(term: Column) -> Column:
    """The quality report's looser rule, for folded texts: ASCII borders for ASCII terms, else a substring; case never counts."""
    needle = F.trim(report_fold(term))
    plain = needle.rlike(r"^[a-z0-9_\- ]+$")
    return F.when(needle == "", None).otherwise(F.when(plain, F.concat(F.lit("(?<![a-z0-9])"), quote(needle), F.lit("(?![a-z0-9])"))).otherwise(quote(needle)))


def occurs(text: Column, term_pattern: Column) -> Column:
    return F.coalesce(F.regexp_like(squash(text), term_pattern), F.lit(False))
