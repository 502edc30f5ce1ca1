"""Column functions on text.  All are JVM built-ins.

Word and space classes are spelled out instead of using ``\\w``, ``\\s`` and
``\\b``: their meaning differs between Java releases, and chat text is not
ASCII.  A word character is a letter, a number or ``_``; combining marks are not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as white space, as a set and as a class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD_CHARS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CHARS}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
START = f"(?<!{WORD})"
END = f"(?!{WORD})"
BOUNDARY = f"(?:(?<={WORD}){END}|{START}(?={WORD}))"

# The word that stands for anything harmless, and the bar of a censored text.
NEUTRAL = "friend"
BAR = "█"


def escape(text: str) -> str:
    """Quote a literal for a regular expression."""
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def alternation(parts: list[str]) -> str:
    return "(?:" + "|".join(parts) + ")"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def norm_key(c: Column) -> Column:
    """The key under which texts count as equal: outer space cut, lower case."""
    return F.lower(strip(c))


def digest(c: Column) -> Column:
    """32 bytes that stand for a text as a join or state key, so that whole texts need not travel as keys."""
    return F.unhex(F.sha2(c, 256))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE + "+"), "")


def join_tokens(c: Column) -> Column:
    return F.array_join(c, " ")


def collapse_runs(c: Column, shortest: int = 3, keep: int = 2) -> Column:
    """Cut runs of one character of at least ``shortest`` down to ``keep``."""
    return F.regexp_replace(c, r"([^\n])\1{%d,}" % (shortest - 1), "$1" * keep)


def distinct_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.split(c, "")))


def suppress_hallucination(c: Column, longest: int = 15, fewest: int = 8) -> Column:
    """Empty a long transcript made of very few characters (a looping recogniser)."""
    looping = (F.length(c) > longest) & (distinct_chars(c) < fewest)
    return F.when(looping, F.lit("")).otherwise(c)


def html_escape(c: Column) -> Column:
    # The five characters HTML needs escaped, ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def censor_bar(c: Column) -> Column:
    return F.repeat(F.lit(BAR), F.length(c))


def sound_code(c: Column) -> Column:
    """Soundex of a lower-case token; null unless it starts with a Latin letter (a to z)."""
    return F.when((c >= "a") & (c < "{"), F.soundex(c))


def char_grams(c: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """All character n-grams of a string, repeats kept."""
    def of_size(n: int) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, n))
        return F.when(F.length(c) >= n, windows).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(n) for n in sizes])


def hash_int(c: Column) -> Column:
    """A non-negative integer from a string that any engine with md5 can reproduce."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def pick(options: list[str], c: Column) -> Column:
    """One of ``options``, chosen by the hash of ``c``."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (hash_int(c) % len(options) + 1).cast("int"))
