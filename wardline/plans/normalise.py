"""The full normaliser: romanise, lower-case, ordered steps, fuzzy mapping.

The steps are configuration.  With a lexicon that fits in literals the whole
normaliser is one narrow projection; otherwise the token steps become joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.romanise import romanise
from wardline.operators import lexicon as lx
from wardline.operators import rules as rl
from wardline.session import materialise


@dataclass(frozen=True)
class Rewrite:
    rules: list[rl.Rule]


@dataclass(frozen=True)
class Context:
    forms: list[str]
    words: list[str]
    replacement: str


@dataclass(frozen=True)
class Article:
    articles: list[str]
    forms: list[str]
    replacement: str
    strict: bool = False


@dataclass(frozen=True)
class Compare:
    link: str
    verbs: list[str]
    tail: str


@dataclass(frozen=True)
class StripPrefixes:
    prefixes: list[str] = field(default_factory=lambda: list(lx.PREFIXES))


@dataclass(frozen=True)
class DropBeforeTerm:
    words: list[str] = field(default_factory=lambda: list(lx.DROPPED_BEFORE_TERM))


Step = Rewrite | Context | Article | Compare | StripPrefixes | DropBeforeTerm


@dataclass(frozen=True)
class Settings:
    """Everything the normaliser needs besides the text."""

    lexicon: DataFrame
    exceptions: DataFrame
    steps: list[Step]
    suffixes: list[str] = field(default_factory=lambda: list(lx.SUFFIXES))
    threshold: float = lx.COSINE
    phonetic: bool = True
    inline_limit: int = lx.MAX_INLINE_TERMS


def _rewritten(c: Column, step: Step) -> Column:
    match step:
        case Rewrite(rules):
            return rl.rewrite(c, rules)
        case Context(forms, words, replacement):
            return rl.context_rewrite(c, forms, words, replacement)
        case Article(articles, forms, replacement, strict):
            return rl.prefix_rewrite(c, articles, forms, replacement, strict)
        case Compare(link, verbs, tail):
            return rl.capture_rewrite(c, link, verbs, tail)
    raise TypeError(f"unknown step {step!r}")


def _token_step(c: Column, step: Step, lex: lx.Lexicon) -> Column:
    if isinstance(step, StripPrefixes):
        return lx.strip_prefixes_of(c, lex, step.prefixes)
    return lx.drop_before_term_of(c, step.words, list(lex.terms))


def normaliser(settings: Settings):
    """The normaliser's two halves as functions on columns, or None if the lexicon is too large for literals.

    The second half uses its input several times; it should be a column, not the first half's expression.
    """
    lex = lx.load_lexicon(settings.lexicon, settings.threshold, settings.inline_limit)
    words = settings.exceptions.select("word").take(settings.inline_limit + 1)
    if lex is None or len(words) > settings.inline_limit:
        return None
    codes = lx.sound_codes(settings.lexicon.sparkSession, lex) if settings.phonetic else None

    def rewritten(c: Column) -> Column:
        c = F.lower(romanise(c))
        for step in settings.steps:
            c = _token_step(c, step, lex) if isinstance(step, StripPrefixes | DropBeforeTerm) else _rewritten(c, step)
        return c

    return rewritten, lambda c: lx.map_tokens(c, lex, [w["word"] for w in words], codes, settings.suffixes)


def normalise(df: DataFrame, col: str, settings: Settings, id_col: str, out: str | None = None) -> DataFrame:
    """Normalise ``col`` into ``out``.  ``id_col`` must be unique; only the plan by joins uses it."""
    out = out or col
    halves = normaliser(settings)
    if halves is not None:
        rewritten, mapped = halves
        return df.withColumn(out, rewritten(F.col(col))).withColumn(out, mapped(F.col(out)))
    # every step by joins reads its input twice, so the text is written in between
    df = df.withColumn(out, F.lower(romanise(F.col(col))))
    for step in settings.steps:
        if isinstance(step, StripPrefixes):
            df = materialise(df, "normalised")
            found = lx.prefix_dictionary(
                lx.distinct_tokens(df, out), settings.lexicon, step.prefixes, settings.threshold
            )
            df = lx.apply_dictionary(df, id_col, out, found)
        elif isinstance(step, DropBeforeTerm):
            df = materialise(df, "normalised")
            df = lx.drop_before_table_term(df, id_col, out, step.words, settings.lexicon)
        else:
            df = df.withColumn(out, _rewritten(F.col(out), step))
    df = materialise(df, "normalised")
    found = lx.token_dictionary(
        lx.distinct_tokens(df, out),
        settings.lexicon,
        settings.exceptions,
        settings.suffixes,
        settings.threshold,
        settings.phonetic,
    )
    return lx.apply_dictionary(df, id_col, out, found)
