"""Names of active users and their masking in message texts.

A message must not see users who come later.  Listing all earlier users for
each message would grow with messages times users; only names that stand in
the text matter, so the join is on pieces of the text instead: a name is found
by all its pieces in order, so that names which share a word do not meet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx

GUEST = "guest"

# Whole words, and symbols wedged between two words: every name that can match
# between word boundaries is built from such pieces.
_SYMBOL = tx.NOT_SPACE[:-1] + tx.WORD_CHARS + "]"
_PIECE = f"{tx.WORD}+|(?<={tx.WORD}){_SYMBOL}(?:[^{tx.WORD_CHARS}]*{_SYMBOL})?(?={tx.WORD})"


def first_seen(msgs: DataFrame, room: str | None = None, seq: str = "seq", name: str = "username") -> DataFrame:
    """``(room?, name, first_seen)``; guests and blank names are left out."""
    keys = ([F.col(room)] if room else []) + [tx.norm_key(F.col(name)).alias("name")]
    seen = msgs.groupBy(*keys).agg(F.min(seq).alias("first_seen"))
    return seen.filter((F.col("name") != "") & (F.col("name") != GUEST))


def _pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_PIECE), 0)


def names_in(texts: DataFrame, names: DataFrame, col: str, on: list[str]) -> DataFrame:
    """``texts`` joined with the ``names`` (name, ...) whose pieces stand in ``col`` in order, and with equal ``on``.

    The text does not travel.  Runs of pieces are made for the numbers of pieces that names have.
    """
    pieces = _pieces(F.col("name"))
    keyed = names.withColumn("_key", F.when(F.size(pieces) > 0, pieces).otherwise(F.array("name")))
    sizes = sorted(r[0] for r in keyed.select(F.size("_key")).distinct().collect())  # a few small numbers
    def run(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("_pieces") - n + 1)
        return F.when(F.size("_pieces") >= n, F.transform(starts, lambda i: F.slice("_pieces", i, n)))

    runs = [run(n) for n in sizes]
    if not runs:
        runs = [F.array().cast("array<array<string>>")]
    every = F.array_distinct(F.flatten(F.array_compact(F.array(*runs))))
    # One column for the pieces: they are cut once per text.
    cut = texts.withColumn("_pieces", _pieces(F.col(col))).drop(col)
    return cut.withColumn("_key", F.explode(every)).drop("_pieces").join(keyed, [*on, "_key"]).drop("_key")


def users_as_of(
    msgs: DataFrame, users: DataFrame, col: str, id_col: str = "id", room: str | None = None, seq: str = "seq"
) -> DataFrame:
    """``(id, names)``: users seen no later than the message whose name may stand in its text."""
    on = [room] if room else []
    return (
        names_in(msgs.select(id_col, *on, seq, col), users, col, on)
        .filter(F.col("first_seen") <= F.col(seq))
        .groupBy(id_col)
        .agg(F.collect_set("name").alias("names"))
    )


def mask_names(text: Column, names: Column, token: str = tx.NEUTRAL) -> Column:
    """Replace each name between word boundaries, longest name first."""
    by_length = F.transform(
        F.reverse(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n).alias("n"), n.alias("name"))))),
        lambda s: s["name"],
    )
    pattern = lambda n: F.concat(F.lit(tx.BOUNDARY + r"\Q"), n, F.lit(r"\E" + tx.BOUNDARY))
    one_by_one = F.aggregate(by_length, text, lambda acc, n: F.regexp_replace(acc, pattern(n), F.lit(token)))
    if not re.fullmatch(r"[A-Za-z0-9_]+", token):
        return one_by_one
    # A name of word characters is a whole word or nothing, and so is what it becomes: one pass finds all such names.
    listed = F.concat(F.lit(tx.BOUNDARY + "(?:"), F.array_join(names, "|"), F.lit(")" + tx.BOUNDARY))
    words = F.forall(names, lambda n: n.rlike(f"^{tx.WORD}+\\z"))
    return F.when(words & (F.size(names) > 0), F.regexp_replace(text, listed, F.lit(token))).otherwise(one_by_one)


def mask_active_users(
    msgs: DataFrame,
    users: DataFrame,
    col: str,
    id_col: str = "id",
    room: str | None = None,
    seq: str = "seq",
    token: str = tx.NEUTRAL,
) -> DataFrame:
    """Mask the names of users seen so far (in the same room, if ``room`` is given)."""
    found = users_as_of(msgs, users, col, id_col, room, seq)
    masked = F.when(F.col("names").isNull(), F.col(col)).otherwise(mask_names(F.col(col), F.col("names"), token))
    return msgs.join(found, id_col, "left").withColumn(col, masked).drop("names")


def mask_listed_words(df: DataFrame, words: DataFrame, col: str, id_col: str, token: str = tx.NEUTRAL) -> DataFrame:
    """``rules.mask_words`` for a list of any length, ``words`` (word): each text is matched with the words it may hold."""
    names = words.select(F.col("word").alias("name")).filter("name <> ''").distinct()
    found = names_in(df.select(id_col, col), names, col, []).groupBy(id_col).agg(F.collect_set("name").alias("_words"))
    longest_first = F.transform(F.col("_words"), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    parts = F.transform(F.array_sort(longest_first), lambda s: F.concat(F.lit(r"\Q"), s["w"], F.lit(r"\E")))
    pattern = F.concat(F.lit(tx.BOUNDARY + "(?:"), F.array_join(parts, "|"), F.lit(")" + tx.BOUNDARY))
    masked = F.when(F.col("_words").isNull(), F.col(col)).otherwise(F.regexp_replace(F.col(col), pattern, F.lit(token)))
    return df.join(found, id_col, "left").withColumn(col, masked).drop("_words")
