"""Ordered rewrite rules on normalised text.

Rules are configuration: a table ``(stage, ord, pattern, replacement)`` that is
read once, folded into a chain of ``regexp_replace`` and applied in one narrow
pass.  Patterns are written with the usual ``\\b``, ``\\w``, ``\\s`` and ``\\1``;
they are translated to the explicit classes of :mod:`wardline.functions.text`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.session import take_config

MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    stage: int
    ord: int
    pattern: str
    replacement: str


def load_rules(df: DataFrame) -> list[Rule]:
    rows = take_config(df.select("stage", "ord", "pattern", "replacement"), MAX_RULES, "the rule table")
    return sorted((Rule(*row) for row in rows), key=lambda r: (r.stage, r.ord))


def translate_pattern(pattern: str) -> str:
    """Give ``\\b``, ``\\w``, ``\\s`` and ``\\d`` their Unicode meaning."""
    def sub(match: re.Match) -> str:
        code, after = match.group(1), match.string[match.end() : match.end() + 1]
        if code == "b" and (after.isalnum() or after == "_"):
            return tx.START
        classes = {"b": tx.BOUNDARY, "w": tx.WORD, "W": f"[^{tx.WORD_CHARS}]", "s": tx.SPACE, "S": tx.NOT_SPACE, "d": r"\p{Nd}"}
        return classes.get(code, match.group(0))

    return re.sub(r"\\(.)", sub, pattern, flags=re.DOTALL)


def translate_replacement(replacement: str) -> str:
    quoted = replacement.replace("$", r"\$")
    return re.sub(r"\\(\d)", r"$\1", quoted)


def _words_of(part: str) -> list[str]:
    """The words of a group that is nothing but words, else the part itself."""
    found = re.fullmatch(r"\(\?:(\w+(?:\|\w+)*)\)", part)
    return found.group(1).split("|") if found else [part]


def heads(parts: list[str]) -> str:
    """A look-ahead on the first characters of the alternatives, if each has just one.

    It says nothing new, but it is the cheapest test there is, and most
    positions of a text fail it.
    """
    firsts = set()
    parts = [word for part in parts for word in _words_of(part)]
    for part in parts:
        outside = part
        while "(" in outside and (inner := re.sub(r"\([^()]*\)", "", outside)) != outside:
            outside = inner
        if "|" in outside or not re.match(r"\w(?![?*{])", part):
            return ""
        firsts.add(part[0])
    return f"(?=[{''.join(sorted(firsts))}])" if firsts else ""


def _whole_word(rule: Rule) -> str | None:
    """The inside of ``\\b...\\b`` if the rule rewrites single words only."""
    found = re.fullmatch(r"\\b(\w.*|\(\?:\w+(?:\|\w+)*\))\\b", rule.pattern, flags=re.DOTALL)
    if not found or re.search(r"\\|[ .\[]", found.group(1)):
        return None
    return found.group(1)


def merged(rules: list[Rule]) -> list[tuple[str, str]]:
    """Translate rules, joining neighbours that send single words to one token.

    Joining is safe only if no rule of the group rewrites the common
    replacement into something else.
    """
    out = []
    for (_, replacement), group in groupby(rules, key=lambda r: (r.stage, r.replacement)):
        pending: list[str] = []

        def flush() -> None:
            if pending:
                pattern = heads(pending) + tx.START + tx.alternation(pending) + tx.END
                out.append((pattern, translate_replacement(replacement)))
                pending.clear()

        for rule in group:
            inside = _whole_word(rule)
            if inside is None:
                flush()
                out.append((translate_pattern(rule.pattern), translate_replacement(replacement)))
            else:
                pending.append(inside)
        flush()
    return out


def rewrite(c: Column, rules: list[Rule]) -> Column:
    for pattern, replacement in merged(rules):
        c = F.regexp_replace(c, pattern, replacement)
    return c


def apply_rules(df: DataFrame, col: str, rules: list[Rule]) -> DataFrame:
    return df.withColumn(col, rewrite(F.col(col), rules))


def context_rewrite(c: Column, forms: list[str], context: list[str], replacement: str) -> Column:
    """An ambiguous word next to a context word, on either side, becomes ``replacement``.

    Both words are used up.  The context word needs no boundary on its far side.
    """
    form, ctx = tx.alternation(forms), tx.alternation(context)
    c = F.regexp_replace(c, f"{heads(forms)}{tx.START}{form}{tx.SPACE}+{ctx}", replacement)
    return F.regexp_replace(c, f"{heads(context)}{ctx}{tx.SPACE}+{tx.START}{form}{tx.END}", replacement)


def context_rules(df: DataFrame, col: str, forms: list[str], context: list[str], replacement: str) -> DataFrame:
    return df.withColumn(col, context_rewrite(F.col(col), forms, context, replacement))


def prefix_rewrite(c: Column, articles: list[str], forms: list[str], replacement: str, strict: bool = False) -> Column:
    """Article and ambiguous word become ``replacement``.

    By default the article may be the tail of a longer word; ``strict`` asks
    for a boundary before it.
    """
    head = heads(articles) + (tx.START if strict else "") + tx.alternation(articles)
    return F.regexp_replace(c, f"{head}{tx.SPACE}+{tx.START}{tx.alternation(forms)}{tx.END}", replacement)


def prefix_context(
    df: DataFrame, col: str, articles: list[str], forms: list[str], replacement: str, strict: bool = False
) -> DataFrame:
    return df.withColumn(col, prefix_rewrite(F.col(col), articles, forms, replacement, strict))


def capture_rewrite(c: Column, link: str, verbs: list[str], tail: str) -> Column:
    """``<word> <link> <verb>`` becomes ``<word> <tail>``.

    The word is matched possessively from its first character (or from where
    the last match ended), so a very long token is scanned once only.
    """
    word = rf"(?:{tx.START}|\G)({tx.WORD}++)"
    pattern = f"{word}{tx.SPACE}+{tx.escape(link)}{tx.SPACE}+{tx.alternation(verbs)}"
    return F.regexp_replace(c, pattern, f"$1 {tail}")


def capture_rule(df: DataFrame, col: str, link: str, verbs: list[str], tail: str) -> DataFrame:
    return df.withColumn(col, capture_rewrite(F.col(col), link, verbs, tail))


def mask_words_in(c: Column, words: list[str], token: str = tx.NEUTRAL) -> Column:
    """Replace whole words by a neutral token before scoring.

    ``words`` is configuration; longer words are tried first.
    """
    if not words:
        return c
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    parts = [tx.escape(w) for w in longest_first]
    plain = all(re.fullmatch(r"\w|\w.*\w", w, flags=re.DOTALL) for w in words)
    before, after = (heads(parts) + tx.START, tx.END) if plain else (tx.BOUNDARY, tx.BOUNDARY)
    return F.regexp_replace(c, before + tx.alternation(parts) + after, translate_replacement(token))


def mask_words(df: DataFrame, col: str, words: list[str], token: str = tx.NEUTRAL) -> DataFrame:
    return df.withColumn(col, mask_words_in(F.col(col), words, token))
