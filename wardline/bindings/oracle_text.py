"""SQL for the text operators, built from the same configuration but by other means.

Whole words are handled by cutting a text into word and non-word pieces, and
fuzzy matching by joins on n-grams, since the SQL engine's regular expressions
have no look-around and no back-references.
"""

from __future__ import annotations

from wardline.bindings.base import SPACE, WORD, lit, sql_in, sql_join, sql_list, sql_tokens
from wardline.operators import rules as rl


def pieces(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(f'[{WORD}]+|[^{WORD}]+')})"


def word_rules(x: str, rules: list[rl.Rule]) -> str:
    """One pass over the pieces per rule, in order."""
    body = pieces(x)
    for rule in rules:
        inside = rule.pattern[2:-2]
        body = (
            f"list_transform({body}, lambda p: CASE WHEN regexp_full_match(p, {lit(inside)}) "
            f"THEN {lit(rule.replacement)} ELSE p END)"
        )
    return f"array_to_string({body}, '')"


def mask(x: str, words: list[str], token: str = "friend") -> str:
    return (
        f"array_to_string(list_transform({pieces(x)}, lambda p: CASE WHEN p IN {sql_in(words)} "
        f"THEN {lit(token)} ELSE p END), '')"
    )


def context(x: str, forms: list[str], words: list[str], replacement: str) -> str:
    form, ctx = "(?:" + "|".join(forms) + ")", "(?:" + "|".join(words) + ")"
    left = f"regexp_replace({x}, {lit(f'(^|[^{WORD}]){form}{SPACE}+{ctx}')}, {lit(chr(92) + '1' + replacement)}, 'g')"
    return f"regexp_replace({left}, {lit(f'{ctx}{SPACE}+{form}($|[^{WORD}])')}, {lit(replacement + chr(92) + '1')}, 'g')"


def article(x: str, articles: list[str], forms: list[str], replacement: str) -> str:
    pattern = f"(?:{'|'.join(articles)}){SPACE}+(?:{'|'.join(forms)})($|[^{WORD}])"
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement + chr(92) + '1')}, 'g')"


def phrase(x: str, rule: rl.Rule) -> str:
    inside = rule.pattern[2:-2].replace(r"\s", SPACE)
    pattern = f"(^|[^{WORD}]){inside}($|[^{WORD}])"
    return f"regexp_replace({x}, {lit(pattern)}, {lit(chr(92) + '1' + rule.replacement + chr(92) + '2')}, 'g')"


def compare(x: str, link: str, verbs: list[str], tail: str) -> str:
    pattern = f"([{WORD}]+){SPACE}+{link}{SPACE}+(?:{'|'.join(verbs)})"
    return f"regexp_replace({x}, {lit(pattern)}, {lit(chr(92) + '1 ' + tail)}, 'g')"


def drop_before(x: str, dropped: list[str], terms: list[str]) -> str:
    """On a token list."""
    return f"list_filter({x}, lambda t, i: NOT (t IN {sql_in(dropped)} AND coalesce(({x})[i + 1] IN {sql_in(terms)}, false)))"


def grams(x: str) -> str:
    return (
        f"list_concat(list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i::INTEGER, 2)), "
        f"list_transform(range(1, greatest(length({x}) - 1, 1)), lambda i: substr({x}, i::INTEGER, 3)))"
    )


def collapse_token(x: str, keep: int) -> str:
    same = " AND ".join(f"string_split({x}, '')[i - {k}] IS NOT DISTINCT FROM c" for k in range(1, keep + 1))
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, i: NOT ({same})), '')"


def index(lexicon: str, name: str = "idx") -> str:
    """CTEs for the TF-IDF index of a lexicon table ``(term, pos)``."""
    return f"""{name}_g AS (SELECT term, pos, gram, count(*) AS tf FROM (
    SELECT term, pos, unnest({grams('term')}) AS gram FROM {lexicon}) GROUP BY ALL),
{name}_d AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM {lexicon})) / (1 + count(*))) + 1 AS idf
  FROM {name}_g GROUP BY gram),
{name} AS (SELECT term, pos, gram, df, idf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY term, pos)) AS w
  FROM {name}_g JOIN {name}_d USING (gram))"""


def nearest(probes: str, out: str, idx: str = "idx", threshold: float = 0.85) -> str:
    """CTEs for ``out(token, term, sim)`` from a table of distinct tokens."""
    return f"""{out}_q AS (SELECT token, gram, count(*) * any_value(idf) AS q FROM (
    SELECT token, unnest({grams('token')}) AS gram FROM {probes}) JOIN {idx}_d USING (gram) GROUP BY token, gram),
{out}_n AS (SELECT token, sqrt(sum(q * q)) AS norm FROM {out}_q GROUP BY token),
{out}_s AS (SELECT token, term, pos, sum(q * w) AS dot FROM {out}_q JOIN {idx} USING (gram) GROUP BY token, term, pos),
{out}_b AS (SELECT token, term, round(dot / norm, 9) AS sim,
    row_number() OVER (PARTITION BY token ORDER BY round(dot, 9) DESC, pos) AS rn FROM {out}_s JOIN {out}_n USING (token)),
{out} AS (SELECT token, term, sim FROM {out}_b WHERE rn = 1 AND sim >= {threshold})"""


def affixes(values: list[str], name: str) -> str:
    rows = ", ".join(f"({lit(v)}, {i})" for i, v in enumerate(values))
    return f"{name}(affix, place) AS (VALUES {rows})"


def stems(probes: str, out: str, suffixes: list[str], idx: str = "idx") -> str:
    """CTEs for ``out(token, term)``: first ending whose removal leaves a match."""
    return f"""{affixes(suffixes, out + '_a')},
{out}_c AS (SELECT token, place, substr(token, 1, length(token) - length(affix)) AS root FROM {probes}, {out}_a
  WHERE ends_with(token, affix) AND length(token) > length(affix) + 2),
{out}_r AS (SELECT DISTINCT root AS token FROM {out}_c),
{nearest(out + '_r', out + '_m', idx)},
{out} AS (SELECT c.token AS token, arg_min(coalesce(l.term, m.term), place) AS term FROM {out}_c c
  LEFT JOIN lexicon l ON l.term = c.root LEFT JOIN {out}_m m ON m.token = c.root
  WHERE coalesce(l.term, m.term) IS NOT NULL GROUP BY c.token)"""


def prefixes(probes: str, out: str, values: list[str], idx: str = "idx") -> str:
    """CTEs for ``out(token, mapped)``: first prefix whose removal leaves a term."""
    return f"""{affixes(values, out + '_a')},
{out}_c AS (SELECT token, place, substr(token, length(affix) + 1) AS root FROM {probes}, {out}_a
  WHERE starts_with(token, affix) AND length(token) > length(affix) + 2),
{out}_r AS (SELECT DISTINCT root AS token FROM {out}_c),
{nearest(out + '_r', out + '_m', idx)},
{out}_e AS (SELECT token AS root FROM {out}_r WHERE token IN (SELECT term FROM lexicon)
  OR {collapse_token('token', 1)} IN (SELECT {collapse_token('term', 1)} FROM lexicon)),
{out} AS (SELECT c.token AS token, arg_min(coalesce(e.root, m.term), place) AS mapped FROM {out}_c c
  LEFT JOIN {out}_e e ON e.root = c.root LEFT JOIN {out}_m m ON m.token = c.root
  WHERE coalesce(e.root, m.term) IS NOT NULL GROUP BY c.token)"""


def soundex(x: str) -> str:
    """American Soundex spelled out: drop h and w after the first letter, code, squeeze, drop vowels."""
    rest = f"regexp_replace(substr({x}, 2), '[hw]', '', 'g')"
    plain = f"regexp_replace(substr({x}, 1, 1) || {rest}, '[^a-z]', '0', 'g')"
    coded = f"translate({plain}, 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202')"
    for digit in "0123456":
        coded = f"regexp_replace({coded}, '{digit}+', '{digit}', 'g')"
    return f"(upper(substr({x}, 1, 1)) || substr(replace(substr({coded}, 2), '0', '') || '000', 1, 3))"


def sounds(probes: str, out: str) -> str:
    return f"""{out}_k AS (SELECT {soundex('term')} AS code, arg_min(term, pos) AS term FROM lexicon GROUP BY 1),
{out} AS (SELECT token, term FROM {probes} JOIN {out}_k ON code = {soundex('token')} WHERE regexp_matches(token, '^[a-z]'))"""


def cascade(source: str, key: str, out: str, exceptions: list[str], suffixes: list[str], phonetic: bool = True) -> str:
    """CTEs for ``out(key, text)``: fuzzy mapping of ``source(key, text)``."""
    sound = f"{sounds(out + '_p', out + '_z')},\n" if phonetic else ""
    third = f"LEFT JOIN {out}_z z USING (token)" if phonetic else ""
    mapped = "coalesce(n.term, s.term, z.term)" if phonetic else "coalesce(n.term, s.term)"
    return f"""{tokens_of(source, key, out + '_t')},
{out}_v AS (SELECT token AS typed, {collapse_token('lower(token)', 2)} AS token FROM (SELECT DISTINCT token FROM {out}_t)),
{out}_p AS (SELECT DISTINCT token FROM {out}_v WHERE token NOT IN {sql_in(exceptions)}),
{nearest(out + '_p', out + '_n')},
{stems(out + '_p', out + '_s', suffixes)},
{sound}{out}_m AS (SELECT typed AS token, {mapped} AS mapped FROM {out}_v JOIN {out}_p USING (token)
  LEFT JOIN {out}_n n USING (token) LEFT JOIN {out}_s s USING (token) {third}),
{regroup(source, key, out + '_t', out + '_m', out)}"""


def tokens_of(source: str, key: str, out: str) -> str:
    return f"""{out} AS (SELECT {key}, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS place
  FROM (SELECT {key}, {sql_tokens('text')} AS toks FROM {source}))"""


def regroup(source: str, key: str, toks: str, dictionary: str, out: str) -> str:
    return f"""{out}_j AS (SELECT {key}, string_agg(coalesce(d.mapped, t.token), ' ' ORDER BY place) AS text
  FROM {toks} t LEFT JOIN {dictionary} d USING (token) GROUP BY {key}),
{out} AS (SELECT {key}, coalesce(j.text, '') AS text FROM {source} LEFT JOIN {out}_j j USING ({key}))"""


def full_normaliser(source: str, key: str, out: str, cfg) -> str:
    """CTEs for ``out(key, text)``: every step of the normaliser, in order (no script to romanise)."""
    first = article(context(word_rules("lower(text)", cfg.RULES), cfg.FORMS, cfg.CONTEXT, "dog"), cfg.ARTICLES, cfg.FORMS, "dog")
    middle = word_rules(compare(phrase("text", cfg.PHRASE), cfg.LINK, cfg.VERBS, cfg.TAIL), cfg.LATE_RULES[:4])
    late = word_rules("text", cfg.LATE_RULES[4:])
    return f"""{cfg.LEXICON},
{index('lexicon')},
{out}_1 AS (SELECT {key}, {first} AS text FROM {source}),
{tokens_of(out + '_1', key, out + '_2')},
{out}_3 AS (SELECT DISTINCT token FROM {out}_2),
{prefixes(out + '_3', out + '_4', cfg.PREFIXES)},
{regroup(out + '_1', key, out + '_2', out + '_4', out + '_5')},
{out}_6 AS (SELECT {key}, {middle} AS text FROM {out}_5),
{out}_7 AS (SELECT {key}, {sql_tokens('text')} AS toks FROM {out}_6),
{out}_8 AS (SELECT {key}, {sql_join(drop_before('toks', cfg.DROPPED, cfg.TERMS))} AS text FROM {out}_7),
{out}_9 AS (SELECT {key}, {late} AS text FROM {out}_8),
{cascade(out + '_9', key, out, cfg.EXCEPTIONS, cfg.SUFFIXES)}"""
