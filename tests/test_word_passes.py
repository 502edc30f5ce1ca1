import random
import re

from pyspark.sql import functions as F

from conftest import one_column
from wardline.bindings import base
from wardline.functions import text as tx
from wardline.operators import lexicon as lx
from wardline.operators import rules as rl


def test_words_that_cannot_change_are_left_out_without_loss(spark, lexicon):
    lex = lx.load_lexicon(lexicon)
    codes = lx.sound_codes(spark, lex)
    draw = random.Random(5)
    odd = ["é", "ß", "1", "-", "ee", "ttt", "h", "ing", "ed", "mega", "da"]
    def word():
        term = list(draw.choice(base.TERMS + ["lorem", "dolor"]))
        for _ in range(draw.randrange(4)):
            term[draw.randrange(len(term))] = draw.choice([*"aeiouhwrtsdml", *odd, ""])
        return draw.choice(["", "", "mega", "da", "me"]) + "".join(term) + draw.choice(["", "", "ing", "y", "ness"])
    rows = [(i, draw.choice([" ", "  ", "\t "]).join(draw.choice([word(), word(), "da", "you", "the"]) for _ in range(12))) for i in range(300)]
    rows += [(300, ""), (301, None), (302, " 　idiot\x85da  idiot "), (303, "da da idiot idiot")]
    df = spark.createDataFrame(rows, "id int, text string")
    # A text with the mark goes the long way, word by word.
    marked, text = F.concat("text", F.lit(f" {lx.MARK}")), F.col("text")
    ways = {
        "map": (lambda c: lx.map_tokens(c, lex, base.EXCEPTIONS, codes, base.SUFFIXES)),
        "strip": (lambda c: lx.strip_prefixes_of(c, lex, base.PREFIXES)),
    }
    for name, way in ways.items():
        for row in df.select("id", way(text).alias("few"), way(marked).alias("each")).collect():
            assert row["few"] == (row["each"] and row["each"][:-1].rstrip(" ")), (name, row)
    dropped = tx.join_tokens(lx.drop_before_term_in(tx.tokens(text), base.DROPPED, base.TERMS))
    assert df.filter(~lx.drop_before_term_of(text, base.DROPPED, base.TERMS).eqNullSafe(dropped)).count() == 0
    # Few words of a harmless text are looked at.
    assert not re.search(f"(?:{'|'.join(lx._may_change(lex, codes)).replace('*+', '*')})", "und der baum")


def test_a_group_of_words_joins_its_neighbours(spark):
    assert len(rl.merged(base.LATE_RULES[4:])) == 2
    rules = [rl.Rule(1, 1, r"\b(?:they|them)\b", "x"), rl.Rule(1, 2, r"\bder\b", "x")]
    df = spark.createDataFrame([("they lather them, der theyx",)], "text string")
    assert one_column(rl.apply_rules(df, "text", rules)) == ["x lather x, x theyx"]


def test_an_empty_prefix_fits_every_word(spark, lexicon):
    lex = lx.load_lexicon(lexicon)
    df = spark.createDataFrame([("xidiotx talk",)], "text string")
    assert one_column(lx.strip_prefixes(df, "text", lex, [""])) == ["idiot talk"]
