"""Message intake: validity, defaults, guard switch, source tags, transcripts, censoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators.labels import SAFE_LABEL

# Source tags of user names and the notices that replace a censored message.
TAG_TEXT = "[Telegram] "
TAG_AUDIO = "[Telegram Audio] "
DEFAULT_USER = "Guest"
DEFAULT_CLIENT = "unknown"
NOTICE_TEXT = "⚠️ <b>%s</b> sent an offensive message:\n%s"
NOTICE_AUDIO = "⚠️ <b>%s</b> sent an offensive voice note:\n%s"


def valid_messages(df: DataFrame, col: str = "text") -> DataFrame:
    """Messages with text left after cutting outer space; missing and blank ones go."""
    return df.filter(~tx.is_blank(F.col(col))).withColumn(col, tx.strip(F.col(col)))


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "client_id": F.coalesce("client_id", F.lit(DEFAULT_CLIENT)),
            "username": tx.strip(F.coalesce("username", F.lit(DEFAULT_USER))),
            "is_audio": F.coalesce("is_audio", F.lit(False)),
            "guard_on": F.coalesce("guard_on", F.lit(True)),
        }
    )


def tag_source(df: DataFrame, col: str = "username", audio: str = "is_audio") -> DataFrame:
    """Mark user names with where the message came from."""
    tag = F.when(F.coalesce(F.col(audio), F.lit(False)), TAG_AUDIO).otherwise(TAG_TEXT)
    return df.withColumn(col, F.concat(tag, F.coalesce(F.col(col), F.lit(DEFAULT_USER))))


def unguarded_result(text: Column) -> dict[str, Column]:
    """What a message gets when the guard is off: safe, with the fields that mode leaves out as null."""
    return {
        "label": F.lit(SAFE_LABEL),
        "label_display": F.lit(None).cast("string"),
        "offensive_score": F.lit(0.0),
        "safe_score": F.lit(None).cast("double"),
        "is_offensive": F.lit(False),
        "bucket": F.lit("safe"),
        "transliterated": text,
    }


def guarded(df: DataFrame, col: str = "text", guard: str = "guard_on") -> DataFrame:
    """Replace the result columns of rows whose guard is off."""
    off = ~F.coalesce(F.col(guard), F.lit(True))
    changes = {}
    for name, value in unguarded_result(F.col(col)).items():
        kept = F.col(name) if name in df.columns else F.lit(None).cast("string")
        changes[name] = F.when(off, value).otherwise(kept)
    if "all_scores" in df.columns:
        changes["all_scores"] = F.when(~off, F.col("all_scores"))
    return df.withColumns(changes)


def censor(
    df: DataFrame, text: str = "text", name: str = "username", flag: str = "is_offensive", audio: str = "is_audio"
) -> DataFrame:
    """Add ``shown``: the text, or for offensive rows a bar of its length; and the ``notice`` to post."""
    bad = F.coalesce(F.col(flag), F.lit(False))
    bar = tx.censor_bar(F.col(text))
    who = tx.html_escape(F.col(name))
    notice = F.when(
        F.coalesce(F.col(audio), F.lit(False)), F.format_string(NOTICE_AUDIO, who, bar)
    ).otherwise(F.format_string(NOTICE_TEXT, who, bar))
    return df.withColumns({"shown": F.when(bad, bar).otherwise(F.col(text)), "notice": F.when(bad, notice)})


def assemble_transcripts(segments: DataFrame) -> DataFrame:
    """``(clip_id, text)``: segments joined in order, outer space cut, loops emptied.

    Runs of neighbouring segments are joined first, each run in a group of its
    own, so that a very long clip is not gathered segment by segment.
    """
    run = F.floor(F.col("seg_no") / RUN_LENGTH)
    runs = _joined(segments.withColumn("_run", run), ["clip_id", "_run"], "seg_no")
    clips = _joined(runs, ["clip_id"], "_run")
    return clips.withColumn("text", tx.suppress_hallucination(tx.strip(F.col("text"))))


RUN_LENGTH = 1024


def _joined(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["text"]), "").alias("text"))
