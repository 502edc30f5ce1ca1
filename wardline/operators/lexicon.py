"""Matching tokens against a lexicon: exact, by n-gram cosine, by stem, by sound.

Two plans give the same result.

* A lexicon of up to ``MAX_INLINE_TERMS`` terms (counted, not assumed) becomes
  literals.  Matching is then one narrow projection: no shuffle, whatever the
  number or skew of the tokens.
* A larger lexicon stays a table.  Distinct tokens are matched by joins on
  n-grams, stems and sound codes, and the resulting dictionary is joined back.
  Of the n-grams only the rare ones that a match cannot do without are joined.

The narrow plan first drops tokens that cannot reach the cosine threshold.  By
Cauchy-Schwarz the cosine of a token with a term is at most the root of the
squared weight of the grams they share, so a match shares ``threshold**2`` of the
term's squared weight or more, and has at least one gram of any set that carries
more than the rest, the *signature*.  The filter loses nothing.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.functions import text as tx
from wardline.operators import trie
from wardline.session import materialise, small_table

MAX_INLINE_TERMS = 512
# Terms of one gate pattern; beyond that texts are matched with a table of terms.
MAX_GATE_TERMS = 10_000
COSINE = 0.85

# The inflection endings and intensifying prefixes, in the order they are tried.
SUFFIXES = ["yod", "yode", "kku", "ude", "yude", "ne", "aye", "iye", "mar", "kal", "k"]
PREFIXES = ["para", "perum", "maha", "verum", "dan", "da", "eda", "poda"]
# Words dropped right before a lexicon term.
DROPPED_BEFORE_TERM = ["da", "poda", "ninte", "ne"]


# -- index ---------------------------------------------------------------------


def fit_ngram_index(lexicon: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """``(term, pos, gram, df, idf, w)``: L2-normalised TF-IDF of character n-grams.

    ``idf = ln((1 + N) / (1 + df)) + 1`` with N terms.
    """
    grams = (
        lexicon.select("term", "pos", F.explode(tx.char_grams(F.lower("term"), sizes)).alias("gram"))
        .groupBy("term", "pos", "gram")
        .agg(F.count("*").alias("tf"))
    )
    terms = lexicon.agg(F.count("*")).scalar()
    idf = (
        grams.groupBy("gram")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", F.log((1 + terms) / (1 + F.col("df"))) + 1)
    )
    weighted = grams.join(idf, "gram").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("term", "pos")))
    return weighted.select("term", "pos", "gram", "df", "idf", (F.col("raw") / norm).alias("w"))


@dataclass(frozen=True)
class Lexicon:
    """A lexicon small enough to travel as literals."""

    terms: tuple[str, ...]
    idf: dict[str, float]
    weights: tuple[dict[str, float], ...]
    threshold: float = COSINE

    @property
    def ascii_terms(self) -> list[str]:
        return [t for t in self.terms if t.isascii()]

    @property
    def collapsed(self) -> list[str]:
        return sorted({re.sub(r"(.)\1+", r"\1", t.lower()) for t in self.ascii_terms})

    def signature(self, pos: int) -> list[str]:
        """The longest, heaviest grams of a term that no matching token can do without all of."""
        weights, out, mass = self.weights[pos], [], 0.0
        for gram in sorted(weights, key=lambda g: (-len(g), -weights[g], g)):
            out.append(gram)
            mass += weights[gram] ** 2
            if mass > 1 - self.threshold**2 + 1e-6:
                break
        return out


_FITTED: dict[tuple[tuple[str, ...], float], Lexicon] = {}


def load_lexicon(lexicon: DataFrame, threshold: float = COSINE, limit: int = MAX_INLINE_TERMS) -> Lexicon | None:
    """The lexicon as literals, or None if it has more than ``limit`` terms."""
    rows = lexicon.select("term", "pos").take(limit + 1)
    if len(rows) > limit:
        return None
    ordered = [r["term"] for r in sorted(rows, key=lambda r: r["pos"])]
    known = _FITTED.get((tuple(ordered), threshold))
    if known is not None:
        return known
    # a literal copy: the source of the lexicon is read once, and one partition is enough
    schema = pa.schema([("term", pa.string()), ("pos", pa.int32())])
    fixed = small_table(lexicon.sparkSession, [{"term": t, "pos": i} for i, t in enumerate(ordered)], schema)
    idf: dict[str, float] = {}
    weights: dict[int, dict[str, float]] = defaultdict(dict)
    for r in fit_ngram_index(fixed.coalesce(1)).collect():
        idf[r["gram"]] = r["idf"]
        weights[r["pos"]][r["gram"]] = r["w"]
    lex = Lexicon(tuple(ordered), idf, tuple(weights[i] for i in range(len(ordered))), threshold)
    _FITTED[(lex.terms, threshold)] = lex
    return lex


# -- narrow matching -----------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def _terms_literal(lex: Lexicon) -> Column:
    rows = [
        {
            "pos": i,
            "term": t,
            "first": lex.signature(i),
            "mass": [{"gram": g, "square": w * w} for g, w in lex.weights[i].items()],
            "w": lex.weights[i],
        }
        for i, t in enumerate(lex.terms)
        if lex.weights[i]
    ]
    kind = (
        "array<struct<pos:int,term:string,first:array<string>,mass:array<struct<gram:string,square:double>>,"
        "w:map<string,double>>>"
    )
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)


# What sets words apart that are looked at, and the letters of each sound digit.
MARK = "\x01"
SOUNDS = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}


def _single_spaced(c: Column) -> Column:
    """The tokens of a text with one blank between them."""
    other = tx.SPACE.replace(r"\x20", r"\x1f")
    # Most characters are ruled out by the first test.
    return F.trim(F.regexp_replace(c, f"(?![!-~])(?:{other}{tx.SPACE}*+| {tx.SPACE}++)", " "))


def _changed_words(spaced: Column, which: list[str], change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to the words of a single-spaced text without ``MARK`` that one of the patterns ``which`` fits from their start.

    One pass over the text finds them; the other words are not looked at one by one.
    """
    marked = F.regexp_replace(spaced, f"(?<![^ ])(?={tx.alternation(which)})([^ ]++)", f"{MARK}$1{MARK}")
    parts = F.transform(F.split(marked, MARK), lambda part, i: F.when(i % 2 == 1, change(part)).otherwise(part))
    return F.array_join(parts, "")


def _sounds_like(code: str) -> str | None:
    """A pattern that fits every lower-case word with this sound code (and some others), without going back.

    A coded letter adds its digit unless that is the last digit again.
    """
    if not re.fullmatch("[A-Z][0-6]{3}", code):
        return None
    coded, digits = "".join(SOUNDS.values()), code[1:].rstrip("0")
    out, last = code[0].lower(), next((d for d, letters in SOUNDS.items() if code[0].lower() in letters), "")
    between = lambda last: "".join(c for c in coded if c not in SOUNDS.get(last, ""))
    for digit in digits:
        out += f"[^ {coded if digit == last else between(last)}]*+[{SOUNDS[digit]}]"
        last = digit
    return out if len(digits) == 3 else out + f"[^ {between(last)}]*+(?![^ ])"


def _near_term(lex: Lexicon) -> str | None:
    """A pattern that fits a word from its start if it, or a part of it, may reach the threshold with a term."""
    grams = sorted({g for i in range(len(lex.terms)) for g in lex.signature(i)})
    if not grams:
        return None
    firsts = "".join(sorted({tx.escape(g[0]) for g in grams}))
    return f"[^ ]*?(?=[{firsts}])" + tx.alternation([tx.escape(g) for g in grams])


def _may_change(lex: Lexicon, codes: dict[str, str]) -> list[str]:
    """Patterns that fit the start of every lower-case word that the cascade may change.

    Cutting long runs makes no gram of two or three characters that the word does not have.
    """
    return [x for x in (*map(_sounds_like, sorted(codes)), _near_term(lex)) if x]


def may_match(c: Column, lex: Lexicon) -> Column:
    """False only if no term can reach the cosine threshold."""
    grams = sorted({g for i in range(len(lex.terms)) for g in lex.signature(i)})
    return c.rlike(tx.alternation([tx.escape(g) for g in grams])) if grams else F.lit(False)


def nearest_in(token: Column, lex: Lexicon) -> Column:
    """The best term at or above the threshold (earliest on a tie), else null.

    Grams the lexicon does not have are dropped before normalising.  Grams are
    only cut for tokens that share enough of some term.
    """
    idf = F.from_json(F.lit(json.dumps(lex.idf, ensure_ascii=False)), "map<string,double>")

    def best(near: Column, grams: Column) -> Column:
        squares = F.aggregate(
            F.array_distinct(grams),
            F.lit(0.0),
            lambda acc, g: acc + F.pow(idf[g] * F.size(F.filter(grams, lambda x: x == g)), F.lit(2.0)),
        )
        ranked = F.transform(
            near,
            lambda t: F.struct(
                F.round(
                    F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + idf[g] * F.coalesce(t["w"][g], F.lit(0.0))), 9
                ).alias("dot"),
                (-t["pos"]).alias("rank"),
                t["term"].alias("term"),
            ),
        )
        top = F.array_max(ranked)
        return F.when(F.round(top["dot"] / F.sqrt(squares), 9) >= lex.threshold, top["term"])

    def among(near: Column) -> Column:
        known = F.filter(tx.char_grams(token), lambda g: F.map_contains_key(idf, g))
        return F.when(F.size(near) > 0, _let(known, lambda grams: best(near, grams)))

    def shares_enough(t: Column) -> Column:
        shared = F.aggregate(
            t["mass"], F.lit(0.0), lambda acc, m: acc + F.when(F.contains(token, m["gram"]), m["square"]).otherwise(0.0)
        )
        return F.exists(t["first"], lambda g: F.contains(token, g)) & (shared >= lex.threshold**2 - 1e-6)

    return F.when(may_match(token, lex), _let(F.filter(_terms_literal(lex), shares_enough), among))


def _cut_suffixes(token: Column, suffixes: list[str]) -> Column:
    return _cut(token, suffixes, lambda t, s: t.endswith(s), lambda t, s: F.substring(t, 1, F.length(t) - F.length(s)))


def _cut_prefixes(token: Column, prefixes: list[str]) -> Column:
    return _cut(token, prefixes, lambda t, p: t.startswith(p), lambda t, p: F.substring(t, F.length(p) + 1, F.length(t)))


def _cut(token: Column, affixes: list[str], has: Callable, rest: Callable) -> Column:
    roots = F.transform(
        F.lit(affixes), lambda a: F.when(has(token, a) & (F.length(token) > F.length(a) + 2), rest(token, a))
    )
    return F.filter(roots, lambda r: r.isNotNull())


def stem_in(token: Column, lex: Lexicon, suffixes: list[str] = SUFFIXES) -> Column:
    """Term found after cutting an ending: exact or by cosine, first ending that matches."""
    return _first(
        F.transform(
            _cut_suffixes(token, suffixes), lambda r: F.when(r.isin(list(lex.terms)), r).otherwise(nearest_in(r, lex))
        )
    )


def sound_in(token: Column, lex: Lexicon, codes: dict[str, str]) -> Column:
    """First term that sounds like the token, else null."""
    if not codes:
        return F.lit(None).cast("string")
    table = F.from_json(F.lit(json.dumps(codes)), "map<string,string>")
    code = tx.sound_code(token)
    return F.when(code.isin(list(codes)), table[code])


def sound_codes(spark: SparkSession, lex: Lexicon) -> dict[str, str]:
    """Sound code -> first ASCII term with it, worked out by Spark's own soundex."""
    terms = small_table(spark, [{"term": t} for t in lex.ascii_terms], pa.schema([("term", pa.string())]))
    out: dict[str, str] = {}
    for row in terms.select("term", F.soundex("term").alias("code")).collect():
        out.setdefault(row["code"], row["term"])
    return out


def map_tokens(
    text: Column,
    lex: Lexicon,
    exceptions: list[str],
    codes: dict[str, str] | None,
    suffixes: list[str] = SUFFIXES,
) -> Column:
    """The whole cascade on a text: exceptions, cosine, stem, sound, unchanged.

    Tokens are matched in lower case with long runs cut; what does not match
    stays as typed.  ``codes=None`` leaves the sound step out.
    """
    def mapped(token: Column, clean: Column) -> Column:
        by_form = F.when(may_match(clean, lex), F.coalesce(nearest_in(clean, lex), stem_in(clean, lex, suffixes)))
        found = F.coalesce(by_form, sound_in(clean, lex, codes or {}), token)
        return F.when(clean.isin(exceptions), token).otherwise(found) if exceptions else found

    def per_token(has_run: Column) -> Column:
        def clean(t: Column) -> Column:
            return F.when(has_run, tx.collapse_runs(F.lower(t))).otherwise(F.lower(t))

        return F.transform(tx.tokens(text), lambda t: _let(clean(t), lambda c: mapped(t, c)))

    # few texts have a long run at all; one look at the text saves one per token
    each = tx.join_tokens(_let(F.lower(text).rlike(r"([^\n])\1\1"), per_token))
    which = _may_change(lex, codes or {})
    if not which:
        return each
    few = _changed_words(_single_spaced(text), which, lambda t: _let(tx.collapse_runs(F.lower(t)), lambda c: mapped(t, c)))
    return F.when((F.lower(text) == text) & ~F.contains(text, F.lit(MARK)), few).otherwise(each)


def strip_prefixes_in(words: Column, lex: Lexicon, prefixes: list[str] = PREFIXES) -> Column:
    """Cut an intensifying prefix when a lexicon term remains (first prefix that works).

    A root that is a term, or collapses to one, stays as written; a root near
    a term becomes the term.
    """
    def root_of(r: Column) -> Column:
        same = r.isin(list(lex.terms)) | tx.collapse_runs(r, 2, 1).isin(lex.collapsed)
        return F.when(same, r).otherwise(nearest_in(r, lex))

    starts = "^" + tx.alternation([tx.escape(p) for p in prefixes])
    cut = lambda w: F.coalesce(_first(F.transform(_cut_prefixes(w, prefixes), root_of)), w)
    return F.transform(words, lambda w: F.when(w.rlike(starts), cut(w)).otherwise(w))


def strip_prefixes_of(text: Column, lex: Lexicon, prefixes: list[str] = PREFIXES) -> Column:
    """``strip_prefixes_in`` for a text: only words that begin with a prefix are looked at."""
    plain = [tx.escape(p) for p in prefixes if p and not re.search(r"\s", p)]
    same = [tx.escape(t) for t in lex.terms] + ["".join(f"{tx.escape(c)}+" for c in t) for t in lex.collapsed]
    roots = [f"{tx.alternation(same)}(?![^ ])"] * bool(same) + [x for x in [_near_term(lex)] if x]
    firsts = "".join(sorted({tx.escape(p[0]) for p in prefixes if p}))
    which = [f"(?=[{firsts}])" + tx.alternation(plain) + tx.alternation(roots)] if plain and roots else []

    def stripped(c: Column) -> Column:
        few = _changed_words(_single_spaced(c), which, lambda w: F.get(strip_prefixes_in(F.array(w), lex, prefixes), 0))
        return F.when(F.contains(c, F.lit(MARK)), tx.join_tokens(strip_prefixes_in(tx.tokens(c), lex, prefixes))).otherwise(few)

    if not all(prefixes):  # an empty prefix fits every word
        return tx.join_tokens(strip_prefixes_in(tx.tokens(text), lex, prefixes))
    return _let(text, stripped) if which else tx.join_tokens(tx.tokens(text))


def drop_before_term_of(text: Column, dropped: list[str], terms: list[str]) -> Column:
    """``drop_before_term_in`` for a text, in one pass of one pattern."""
    before, after = ([tx.escape(w) for w in words if w and not re.search(r"\s", w)] for words in (dropped, terms))
    spaced = _single_spaced(text)
    if not before or not after:
        return spaced
    firsts = "".join(sorted({tx.escape(w[0]) for w in dropped if w}))
    return F.regexp_replace(spaced, f"(?=[{firsts}])(?<![^ ]){tx.alternation(before)} (?={tx.alternation(after)}(?![^ ]))", "")


def drop_before_term_in(words: Column, dropped: list[str], terms: list[str]) -> Column:
    """Drop a word of ``dropped`` that stands right before a lexicon term."""
    def kept(all_words: Column) -> Column:
        return F.filter(
            all_words, lambda w, i: ~(w.isin(dropped) & F.coalesce(F.get(all_words, i + 1).isin(terms), F.lit(False)))
        )

    return _let(words, kept)


def strip_prefixes(df: DataFrame, col: str, lex: Lexicon, prefixes: list[str] = PREFIXES) -> DataFrame:
    return df.withColumn(col, strip_prefixes_of(F.col(col), lex, prefixes))


def drop_before_term(df: DataFrame, col: str, lex: Lexicon, dropped: list[str] = DROPPED_BEFORE_TERM) -> DataFrame:
    return df.withColumn(col, drop_before_term_of(F.col(col), dropped, list(lex.terms)))


# -- matching by joins ---------------------------------------------------------


def distinct_tokens(df: DataFrame, col: str) -> DataFrame:
    """``(token)``: the vocabulary of a text column.

    Repeats are dropped inside each row and again on the map side.  The
    vocabulary is written: Spark moves what is asked of a token (a condition, the
    size of what it is cut into) below a distinct, where each text answers for
    each of its tokens, and several steps read it.
    """
    return materialise(df.select(F.explode(F.array_distinct(tx.tokens(F.col(col)))).alias("token")).distinct(), "tokens")


def term_heads(index: DataFrame, threshold: float = COSINE) -> DataFrame:
    """``(gram, pos, term, parts)``: a term under each of the rare grams that a match cannot do without all of.

    A term's grams are taken, long ones first and then rare ones, until what is left has less
    than ``threshold**2`` of its squared weight.  By Cauchy-Schwarz the cosine
    with a token that has none of the taken ones stays below the threshold.
    ``parts`` says what each gram of a token adds to the dot product.
    """
    rare = (-F.length("gram")).alias("long"), F.col("df"), F.col("gram")
    listed = F.array_sort(F.collect_list(F.struct(*rare, "w", (F.col("w") * F.col("idf")).alias("part"))))
    terms = index.groupBy("pos", "term").agg(listed.alias("grams"))
    square = lambda g: g["w"] * g["w"]
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + square(g))
    size = F.aggregate(
        "grams",
        F.struct(total.alias("left"), F.lit(0).alias("size")),
        lambda acc, g: F.struct(
            (acc["left"] - square(g)).alias("left"),
            (acc["size"] + F.when(acc["left"] >= total * (threshold**2 - 1e-6), 1).otherwise(0)).alias("size"),
        ),
        lambda acc: acc["size"],
    )
    parts = F.map_from_entries(F.transform("grams", lambda g: F.struct(g["gram"], g["part"])))
    heads = F.transform(F.slice("grams", 1, size), lambda g: g["gram"])
    return terms.select(F.explode(heads).alias("gram"), "pos", "term", parts.alias("parts"))


def candidate_terms(tokens: DataFrame, index: DataFrame, threshold: float = COSINE) -> DataFrame:
    """``(token, pos, term, parts)``: pairs that share a rare gram of the term, once for each; no other pair reaches the threshold."""
    grams = tokens.select("token", F.explode(F.array_distinct(tx.char_grams(F.col("token")))).alias("gram"))
    return grams.join(term_heads(index, threshold), "gram").drop("gram")


def nearest_term(tokens: DataFrame, index: DataFrame, threshold: float = COSINE) -> DataFrame:
    """``(token, term, sim)`` for distinct tokens with a term at or above the threshold.

    Tokens meet only the terms of which they have a rare gram.  The best of
    these by dot product is the best by cosine; the tokens that have one get
    their norm over the grams that the lexicon knows.
    """
    pairs = candidate_terms(tokens, index, threshold)
    dot = F.aggregate(tx.char_grams(F.col("token")), F.lit(0.0), lambda acc, g: acc + F.coalesce(F.col("parts")[g], F.lit(0.0)))
    top = F.max(F.struct(F.round(dot, 9).alias("dot"), (-F.col("pos")).alias("rank"), F.col("term").alias("term")))
    best = pairs.groupBy("token").agg(top.alias("top"))
    counts = F.transform(
        F.array_distinct(F.col("grams")),
        lambda g: F.struct(g.alias("gram"), F.size(F.filter("grams", lambda x: x == g)).alias("tf")),
    )
    cut = best.withColumn("grams", tx.char_grams(F.col("token"))).select("token", "top", F.explode(counts).alias("g"))
    vocabulary = index.groupBy("gram").agg(F.min("idf").alias("idf"))
    known = cut.select("token", "top", "g.gram", "g.tf").join(vocabulary, "gram")
    square = F.pow(F.col("tf") * F.col("idf"), F.lit(2.0))
    normed = known.groupBy("token").agg(F.min("top").alias("top"), F.sum(square).alias("squares"))
    sim = F.round(F.col("top.dot") / F.sqrt("squares"), 9)
    return normed.select("token", F.col("top.term").alias("term"), sim.alias("sim")).filter(F.col("sim") >= threshold)


def nearest_term_stemmed(
    tokens: DataFrame, index: DataFrame, lexicon: DataFrame, suffixes: list[str] = SUFFIXES, threshold: float = COSINE
) -> DataFrame:
    """``(token, term)`` found after cutting an ending; the first ending that matches wins."""
    roots = F.transform(
        F.lit(suffixes),
        lambda s, i: F.when(
            F.col("token").endswith(s) & (F.length("token") > F.length(s) + 2),
            F.struct(i.alias("place"), F.substring(F.col("token"), F.lit(1), F.length("token") - F.length(s)).alias("root")),
        ),
    )
    cut = (
        tokens.select("token", F.explode(F.filter(roots, lambda r: r.isNotNull())).alias("r"))
        .select("token", "r.place", "r.root")
    )
    near = nearest_term(cut.select(F.col("root").alias("token")).distinct(), index, threshold)
    exact = lexicon.select(F.col("term").alias("root"), F.col("term").alias("exact"))
    found = (
        cut.join(exact, "root", "left")
        .join(near.select(F.col("token").alias("root"), F.col("term").alias("near")), "root", "left")
        .withColumn("term", F.coalesce("exact", "near"))
        .filter(F.col("term").isNotNull())
    )
    return found.groupBy("token").agg(F.min_by("term", "place").alias("term"))


def phonetic_match(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(token, term)``: the first ASCII lexicon term with the sound code of the token."""
    codes = (
        lexicon.filter(~F.col("term").rlike(r"[^\x00-\x7f]"))
        .groupBy(F.soundex("term").alias("code"))
        .agg(F.min_by("term", "pos").alias("term"))
    )
    return tokens.withColumn("code", tx.sound_code(F.col("token"))).join(codes, "code").select("token", "term")


def bypass(tokens: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Tokens that take part in fuzzy matching: exception words are left out."""
    return tokens.join(exceptions, F.col("token") == F.col("word"), "left_anti")


def in_lexicon(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens equal to a term, or collapsing to a collapsed ASCII term."""
    exact = lexicon.select(F.col("term").alias("key"))
    collapsed = lexicon.filter(~F.col("term").rlike(r"[^\x00-\x7f]")).select(
        tx.collapse_runs(F.lower("term"), 2, 1).alias("key")
    )
    probes = tokens.select(
        "token",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("leg"), F.col("token").alias("key")),
                F.struct(F.lit(1).alias("leg"), tx.collapse_runs(F.col("token"), 2, 1).alias("key")),
            )
        ).alias("p"),
    ).select("token", "p.leg", "p.key")
    keys = exact.withColumn("leg", F.lit(0)).unionByName(collapsed.withColumn("leg", F.lit(1)))
    return probes.join(keys, ["leg", "key"], "left_semi").select("token").distinct()


def token_dictionary(
    tokens: DataFrame,
    lexicon: DataFrame,
    exceptions: DataFrame,
    suffixes: list[str] = SUFFIXES,
    threshold: float = COSINE,
    phonetic: bool = True,
) -> DataFrame:
    """``(token, mapped)`` for the distinct tokens that the cascade changes."""
    cleaned = tokens.withColumn("clean", tx.collapse_runs(F.lower("token")))
    # Written: each kind of match reads them.
    probes = materialise(bypass(cleaned.select(F.col("clean").alias("token")).distinct(), exceptions), "probes")
    index = fit_ngram_index(lexicon)
    near = nearest_term(probes, index, threshold).select("token", F.col("term").alias("near"))
    stem = nearest_term_stemmed(probes, index, lexicon, suffixes, threshold).select("token", F.col("term").alias("stem"))
    found = probes.join(near, "token", "left").join(stem, "token", "left")
    mapped = F.coalesce("near", "stem")
    if phonetic:
        sound = phonetic_match(probes, lexicon).select("token", F.col("term").alias("sound"))
        found, mapped = found.join(sound, "token", "left"), F.coalesce("near", "stem", "sound")
    found = found.select(F.col("token").alias("clean"), mapped.alias("mapped")).filter(F.col("mapped").isNotNull())
    return cleaned.join(found, "clean").select("token", "mapped")


def apply_dictionary(df: DataFrame, id_col: str, col: str, dictionary: DataFrame) -> DataFrame:
    """Replace tokens by a dictionary too large for literals.

    The dictionary is written, so its size is known before the texts are cut:
    if it is small it travels to them and no pair (id, distinct token) moves
    that has no entry.  Else the join on token is left to adaptive execution,
    which splits hot tokens.  ``id_col`` must be unique, so the regrouping is never skewed.
    """
    dictionary = materialise(dictionary, "dictionary")
    pairs = df.select(id_col, F.explode(F.array_distinct(tx.tokens(F.col(col)))).alias("token"))
    found = (
        pairs.join(dictionary, "token")
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "mapped"))).alias("_found"))
    )
    words = tx.tokens(F.col(col))
    replaced = F.transform(words, lambda t: F.coalesce(F.col("_found")[t], t))
    joined = F.when(F.col("_found").isNull(), tx.join_tokens(words)).otherwise(tx.join_tokens(replaced))
    return df.join(found, id_col, "left").withColumn(col, joined).drop("_found")


def prefix_dictionary(
    tokens: DataFrame, lexicon: DataFrame, prefixes: list[str] = PREFIXES, threshold: float = COSINE
) -> DataFrame:
    """``(token, mapped)`` for tokens that lose an intensifying prefix."""
    roots = F.transform(
        F.lit(prefixes),
        lambda p, i: F.when(
            F.col("token").startswith(p) & (F.length("token") > F.length(p) + 2),
            F.struct(i.alias("place"), F.substring(F.col("token"), F.length(p) + 1, F.length("token")).alias("root")),
        ),
    )
    cut = (
        tokens.select("token", F.explode(F.filter(roots, lambda r: r.isNotNull())).alias("r"))
        .select("token", "r.place", "r.root")
    )
    distinct = cut.select(F.col("root").alias("token")).distinct()
    same = in_lexicon(distinct, lexicon).select(F.col("token").alias("root"), F.col("token").alias("same"))
    near = nearest_term(distinct, fit_ngram_index(lexicon), threshold).select(
        F.col("token").alias("root"), F.col("term").alias("near")
    )
    found = (
        cut.join(same, "root", "left")
        .join(near, "root", "left")
        .withColumn("mapped", F.coalesce("same", "near"))
        .filter(F.col("mapped").isNotNull())
    )
    return found.groupBy("token").agg(F.min_by("mapped", "place").alias("mapped"))


def drop_before_table_term(
    df: DataFrame, id_col: str, col: str, dropped: list[str], lexicon: DataFrame
) -> DataFrame:
    """:func:`drop_before_term` for a lexicon too large for literals."""
    words = tx.tokens(F.col(col))
    followers = _let(words, lambda ws: F.array_distinct(F.filter(ws, lambda w, i: (i > 0) & F.get(ws, i - 1).isin(dropped))))
    terms = (
        df.select(id_col, F.explode(followers).alias("term"))
        .join(lexicon.select("term"), "term", "left_semi")
        .groupBy(id_col)
        .agg(F.collect_set("term").alias("_terms"))
    )
    def dropped_in(ws: Column) -> Column:
        return F.filter(
            ws, lambda w, i: ~(w.isin(dropped) & F.coalesce(F.array_contains("_terms", F.get(ws, i + 1)), F.lit(False)))
        )

    kept = F.when(F.col("_terms").isNull(), words).otherwise(_let(words, dropped_in))
    return df.join(terms, id_col, "left").withColumn(col, tx.join_tokens(kept)).drop("_terms")


def fuzzy_map(
    df: DataFrame,
    col: str,
    lexicon: DataFrame,
    exceptions: DataFrame,
    id_col: str,
    suffixes: list[str] = SUFFIXES,
    threshold: float = COSINE,
    phonetic: bool = True,
    limit: int = MAX_INLINE_TERMS,
) -> DataFrame:
    """Map the tokens of a text column onto the lexicon; the plan follows the lexicon's size."""
    lex = load_lexicon(lexicon, threshold, limit)
    words = exceptions.select("word").take(limit + 1)
    if lex is None or len(words) > limit:
        spelled = token_dictionary(distinct_tokens(df, col), lexicon, exceptions, suffixes, threshold, phonetic)
        return apply_dictionary(df, id_col, col, spelled)
    codes = sound_codes(df.sparkSession, lex) if phonetic else None
    return df.withColumn(col, map_tokens(F.col(col), lex, [w["word"] for w in words], codes, suffixes))


# -- keyword gate --------------------------------------------------------------


def gate_pattern(terms: list[str]) -> str:
    """One pattern for terms whose letters come in order, each repeated at will, space between allowed.

    There is no word boundary.  A look-ahead on the first letters lets the
    matcher skip most positions.  Hits do not overlap, whatever terms they are of.
    """
    terms = [t for t in terms if t]
    heads = "".join(sorted({tx.escape(t[0]) for t in terms}))
    return f"(?=[{heads}])" + tx.alternation([f"{tx.SPACE}*".join(tx.escape(ch) + "+" for ch in t) for t in terms])


def gate_hit(c: Column, terms: list[str]) -> Column:
    return c.rlike(gate_pattern(terms)) if any(terms) else F.lit(False)


def gate_count(c: Column, terms: list[str]) -> Column:
    """Number of non-overlapping gate hits."""
    return F.regexp_count(c, F.lit(gate_pattern(terms))) if any(terms) else F.lit(0)


def load_terms(lexicon: DataFrame, limit: int = MAX_GATE_TERMS) -> list[str] | None:
    """Lexicon terms in order, for the gate; None if there are more than ``limit``, which ``gate_by_table`` takes."""
    rows = lexicon.select("term", "pos").take(limit + 1)
    return None if len(rows) > limit else [r["term"] for r in sorted(rows, key=lambda r: r["pos"])]


def _squeezed(c: Column) -> Column:
    """Without white space, and each run of one character as one: what a gate hit's text and term have in common."""
    return F.regexp_replace(F.regexp_replace(c, tx.SPACE, ""), r"(?s)(.)\1+", "$1")


def _gate_terms(lexicon: DataFrame) -> DataFrame:
    """``(pos, term, form)``: each term once, with its squeezed form."""
    terms = lexicon.filter("term <> ''").groupBy("term").agg(F.min("pos").alias("pos"))
    return terms.select("pos", "term", _squeezed(F.col("term")).alias("form")).filter("form <> ''")


def _count_hits(c: Column, terms: Column) -> Column:
    """Non-overlapping hits of a row's own terms, the first of them first."""
    spaced = lambda t: F.array_join(
        F.transform(F.regexp_extract_all(t, F.lit("(?s)."), 0), lambda ch: F.concat(F.lit(r"\Q"), ch, F.lit(r"\E+"))), f"{tx.SPACE}*"
    )
    pattern = F.concat(F.lit("(?:"), F.array_join(F.transform(terms, spaced), "|"), F.lit(")"))
    return F.when(F.size(F.coalesce(terms, F.array())) > 0, F.regexp_count(c, pattern)).when(c.isNotNull(), 0)


def gate_by_table(df: DataFrame, id_col: str, col: str, lexicon: DataFrame, limit: int = trie.MAX_CHARACTERS) -> DataFrame:
    """Add ``hits``, the gate count for a lexicon of any length: by a trie if that is small enough, else by joins.

    With the trie the plan is narrow: texts are read once, and neither they nor their pieces travel.
    """
    loaded = trie.load(_gate_terms(lexicon), limit)
    if loaded is None:
        return gate_by_joins(materialise(df, "gated"), id_col, col, lexicon)
    terms = trie.terms_in(_squeezed(F.col(col)), loaded)
    out = df.withColumn("_terms", terms)
    return out.withColumn("hits", _count_hits(F.col(col), F.col("_terms"))).drop("_terms")


def gate_by_joins(df: DataFrame, id_col: str, col: str, lexicon: DataFrame, gram: int = 4) -> DataFrame:
    """``gate_by_table`` without a trie.

    A text can only hit terms whose squeezed form it holds.  Candidates come
    from a join on the first ``gram`` characters of that form (all of a shorter
    one, if there are such); the pattern of a row is made of the terms that stand in it.
    """
    terms = _gate_terms(lexicon).withColumn("_head", F.substring("form", 1, gram))
    sizes = sorted(r[0] for r in terms.select(F.length("_head")).distinct().collect())  # at most ``gram`` numbers
    texts = df.select(id_col, col).withColumn("_text", _squeezed(F.col(col)))
    # What starts at each place, as long as some heads are.
    starts = F.flatten(F.array(F.array().cast("array<string>"), *(F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes)))
    found = texts.withColumn("_head", F.explode(F.array_distinct(starts))).select(id_col, "_head").join(terms, "_head")
    found = found.groupBy(id_col).agg(F.collect_set(F.struct("pos", "term", "form")).alias("_terms"))
    out = df.join(found, id_col, "left").withColumn("_text", _squeezed(F.col(col)))
    out = out.withColumn("_terms", F.array_sort(F.filter("_terms", lambda t: F.contains(F.col("_text"), t["form"]))))
    out = out.withColumn("_terms", F.transform("_terms", lambda t: t["term"]))
    return out.withColumn("hits", _count_hits(F.col(col), F.col("_terms"))).drop("_terms", "_text")
