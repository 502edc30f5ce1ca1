import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardline.bindings import base
from wardline.functions import text as tx
from wardline.operators import lexicon as lx
from wardline.operators import trie

GOLDEN = {
    "idiott": ("idiot", 1.0), "idiots": ("idiot", 1.0), "xidiotx": ("idiot", 1.0), "morons": ("moron", 1.0),
    "megamoron": ("moron", 1.0), "stupidd": ("stupid", 1.0), "stupidly": ("stupid", 1.0), "loseer": ("loser", 0.922632),
    "worthles": ("worthless", 0.928195), "pathetik": ("pathetic", 0.916131), "clownish": ("clown", 0.877902),
}
BELOW = ["idiotic", "disgust", "mor", "the"]


def grams(word):
    return [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]


def brute_force(terms, tokens, threshold=0.85):
    """Cosine of every token with every term, in plain Python."""
    df = Counter(g for t in terms for g in set(grams(t)))
    idf = {g: math.log((1 + len(terms)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(word):
        counts = {g: n * idf[g] for g, n in Counter(grams(word)).items() if g in idf}
        norm = math.sqrt(sum(v * v for v in counts.values()))
        return {g: v / norm for g, v in counts.items()} if norm else {}

    vectors = [vector(t) for t in terms]
    out = {}
    for token in tokens:
        q = vector(token)
        sims = [round(sum(v * w.get(g, 0.0) for g, v in q.items()), 9) for w in vectors]
        best = max(range(len(terms)), key=lambda i: (sims[i], -i))
        if q and sims[best] >= threshold:
            out[token] = terms[best]
    return out


def token_frame(spark, tokens):
    return spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")


def test_golden_cosines(spark, lexicon):
    df = lx.nearest_term(token_frame(spark, list(GOLDEN) + BELOW), lx.fit_ngram_index(lexicon))
    assert {r["token"]: (r["term"], round(r["sim"], 6)) for r in df.collect()} == GOLDEN


def test_both_plans_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    terms = sorted({word() for _ in range(40)})
    tokens = sorted({word() + rng.choice(["", "a", "ed", word()]) for _ in range(1500)} | set(terms))
    table = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, pos int")
    want = brute_force(terms, tokens)
    frame = token_frame(spark, tokens)
    joined = {r["token"]: r["term"] for r in lx.nearest_term(frame, lx.fit_ngram_index(table)).collect()}
    lex = lx.load_lexicon(table)
    inline = frame.select("token", lx.nearest_in(F.col("token"), lex).alias("term")).filter("term is not null")
    assert joined == want
    assert {r["token"]: r["term"] for r in inline.collect()} == want
    assert len(want) > 40


def test_few_pairs_meet_with_a_large_lexicon(spark, tmp_path):
    """Tokens meet the terms of which they have a rare gram, and every match is among these."""
    rng = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 5)))
    terms = sorted({word() for _ in range(30_000)})[:20_000]
    tokens = sorted({word() for _ in range(150)} | {t[:-1] + rng.choice("aeiou") + "s" for t in rng.sample(terms, 100)})
    path = str(tmp_path / "index")
    table = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, pos int")
    lx.fit_ngram_index(table).write.parquet(path)
    index, frame = spark.read.parquet(path), token_frame(spark, tokens)
    every = frame.select("token", F.explode(F.array_distinct(tx.char_grams(F.col("token")))).alias("gram")).join(index, "gram")
    met = lx.candidate_terms(frame, index)
    assert met.count() < every.count() / 4
    got = {r["token"]: r["term"] for r in lx.nearest_term(frame, index).collect()}
    df = Counter(g for t in terms for g in set(grams(t)))
    idf = {g: math.log((1 + len(terms)) / (1 + n)) + 1 for g, n in df.items()}
    weigh = lambda w: {g: n * idf[g] for g, n in Counter(grams(w)).items() if g in idf}
    vectors = [(i, t, weigh(t)) for i, t in enumerate(terms)]
    norms = [math.sqrt(sum(x * x for x in v.values())) for *_, v in vectors]
    want = {}
    for token in tokens:
        q = weigh(token)
        size = math.sqrt(sum(x * x for x in q.values()))
        best = max((round(sum(x * v.get(g, 0) for g, x in q.items()) / norms[i], 9), -i, t) for i, t, v in vectors)
        if size and round(best[0] / size, 9) >= 0.85:
            want[token] = best[2]
    assert got == want and len(want) > 30


def cascade(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = lx.fuzzy_map(df, "text", base.lexicon(spark), base.exceptions(spark), "id", base.SUFFIXES, **options)
    return [r["text"] for r in out.orderBy("id").collect()]


def test_cascade_plans_agree_and_keep_unmatched_tokens(spark):
    texts = [
        "you idiottt  and LOSERS", "Clowning clownish MEGAmoron", "", "the the the", "plain Words stay As typed",
        "disgust trashing scumed pathetiking", "xx" * 5000 + " moron", "7up état 🙂",
    ]
    inline = cascade(spark, texts)
    assert inline == cascade(spark, texts, limit=0)
    assert inline[0] == "you idiot and LOSERS"
    assert inline[2:5] == ["", "the the the", "plain Words stay As typed"]
    assert cascade(spark, ["disgust"]) == ["disgusting"]
    assert cascade(spark, ["disgust"], phonetic=False) == ["disgust"]


def test_one_token_in_every_row(spark):
    """A token that holds most of the corpus goes through both plans."""
    texts = ["trashy"] * 3000 + ["zzz"] * 10
    assert Counter(cascade(spark, texts)) == Counter(cascade(spark, texts, limit=0)) == {"trash": 3000, "zzz": 10}


def test_prefix_and_pair_steps_agree_between_plans(spark, lexicon):
    lex = lx.load_lexicon(lexicon)
    texts = ["megaidiot superclownish da uberidiottt", "da idiot the scum you", "damoron da da moron"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    inline = lx.strip_prefixes(df, "text", lex, base.PREFIXES)
    table = lx.prefix_dictionary(lx.distinct_tokens(df, "text"), lexicon, base.PREFIXES)
    joined = lx.apply_dictionary(df, "id", "text", table)
    rows = lambda d: [r["text"] for r in d.orderBy("id").collect()]
    assert rows(inline) == rows(joined) == ["idiot clown da idiottt", "da idiot the scum you", "moron da da moron"]
    pairs = lx.drop_before_term(df, "text", lex, base.DROPPED)
    by_join = lx.drop_before_table_term(df, "id", "text", base.DROPPED, lexicon)
    assert rows(pairs) == rows(by_join) == ["megaidiot superclownish da uberidiottt", "idiot scum you", "damoron da moron"]


def test_gate_has_no_word_boundary(spark):
    df = spark.createDataFrame([("top era now",), ("finest",), ("o pp e\nra",), ("n e s t o",), ("nothing",)], "t string")
    got = [r[0] for r in df.select(lx.gate_hit(F.col("t"), ["opera", "nest"])).collect()]
    assert got == [True, True, True, True, False]


def test_gate_hits_of_many_terms_do_not_overlap(spark):
    terms = ["abc", *(f"qq{i}q" for i in range(501)), "bcd"]
    rows = [(1, "abcd"), (2, "abc bcd"), (3, "a  bb c, bcd"), (4, ""), (5, None), (6, "abcabc abd")]
    df = spark.createDataFrame(rows, "id long, t string")
    table = spark.createDataFrame([(t, i) for i, t in enumerate(terms)] + [("abc", 900), ("", 901)], "term string, pos int")
    want = {1: 1, 2: 2, 3: 2, 4: 0, 5: None, 6: 2}
    assert dict(tuple(r) for r in df.select("id", lx.gate_count(F.col("t"), terms)).collect()) == want
    found = lx.gate_by_joins(df, "id", "t", table)
    assert {r["id"]: r["hits"] for r in found.collect()} == want
    for limit in (10, 100_000):  # by joins, by a trie
        assert {r["id"]: r["hits"] for r in lx.gate_by_table(df, "id", "t", table, limit).collect()} == want
    assert lx.load_terms(table, 10) is None


def test_gate_by_trie_counts_what_the_pattern_counts(spark):
    """Random texts of few letters, terms that hold one another or squeeze to one form, characters beyond 16 bits."""
    pick = random.Random(5)
    word = lambda n: "".join(pick.choice("abcé\U0001f600") for _ in range(n))
    terms = sorted({word(pick.randint(1, 6)) for _ in range(300)})
    pick.shuffle(terms)
    texts = ["", " ", None, *("".join(pick.choice("abcé\U0001f600d  \n") for _ in range(pick.randint(1, 60))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    for some in (terms, terms[:7], []):
        table = spark.createDataFrame([(t, i) for i, t in enumerate(some)] + [("", 999)], "term string, pos int")
        want = dict(tuple(r) for r in df.select("id", F.when(F.col("t").isNotNull(), lx.gate_count(F.col("t"), some))).collect())
        found = lx.gate_by_table(df, "id", "t", table)
        assert {r["id"]: r["hits"] for r in found.collect()} == want
        joined = lx.gate_by_joins(df, "id", "t", table)
        assert {r["id"]: r["hits"] for r in joined.collect()} == want


def test_trie_finds_what_search_finds(monkeypatch):
    pick = random.Random(6)
    word = lambda n: "".join(pick.choice("abc") for _ in range(n))
    forms = sorted({word(pick.randint(1, 5)) for _ in range(60)})
    built = trie.build(forms, np.arange(len(forms)))
    texts = ["", *(word(pick.randint(0, 40)) for _ in range(100)), word(3000)]
    want = [(i, j) for i, t in enumerate(texts) for j, f in enumerate(forms) if f in t]
    for step in (7, 1 << 19):  # the places of a text in several steps
        monkeypatch.setattr(trie, "STEP", step)
        assert list(zip(*(x.tolist() for x in built.places(texts)))) == want


def test_lexicon_over_the_limit_stays_a_table(spark):
    table = spark.createDataFrame([(f"term{i}", i) for i in range(600)], "term string, pos int")
    assert lx.load_lexicon(table) is None


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_condition_on_a_token_is_not_asked_of_every_text(spark):
    df = spark.createDataFrame([(1, "some words and some more")], "id int, text string")
    words = lx.distinct_tokens(df, "text").filter(F.length("token") > 4)
    assert "Generate" not in executed(words) and sorted(r.token for r in words.collect()) == ["words"]


def test_a_small_dictionary_of_unknown_size_travels_to_the_texts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, None)], "id int, text string")
    many = spark.range(3000).withColumnRenamed("id", "x").crossJoin(spark.range(3000).withColumnRenamed("id", "y"))
    found = many.filter("x = 7 AND y = 9").select(F.lit("a").alias("token"), F.lit("z").alias("mapped"))
    out = lx.apply_dictionary(df, "id", "text", found)
    assert "BroadcastHashJoin [token" in executed(out) and sorted(str(r.text) for r in out.collect()) == ["None", "c d", "z b z"]
