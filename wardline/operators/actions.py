"""Feedback and moderation actions on messages.

Actions are an append-only log ``(seq, ts, message_id, kind, value)`` with kind
``report``, ``classify`` or ``reveal``.  Per-message state is an aggregate of
the log, so a message with very many actions combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators.asof import as_of
from wardline.operators.labels import DEFAULT_REPORT_LABEL, SAFE_LABEL

# Accepted classifications.
HATE = "hate_speech"
NOT_HATE = "not_hate_speech"


def classification(value: Column) -> Column:
    return F.lower(tx.strip(F.coalesce(value, F.lit(""))))


def _is_valid() -> Column:
    return (F.col("kind") != "classify") | classification(F.col("value")).isin(HATE, NOT_HATE)


def valid_feedback(actions: DataFrame, msgs: DataFrame) -> DataFrame:
    """Actions on known messages; classifications must be one of the two accepted values."""
    known = msgs.select(F.col("id").alias("message_id"))
    return actions.filter(_is_valid()).join(known, "message_id", "left_semi")


def rejected_feedback(actions: DataFrame, msgs: DataFrame) -> DataFrame:
    """The others, with the reason: an unknown message is found before a bad value."""
    known = msgs.select(F.col("id").alias("message_id"), F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "message not found").when(~_is_valid(), "bad classification")
    return (
        actions.join(known, "message_id", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .drop("_known")
    )


def feedback_label(kind: Column, value: Column) -> Column:
    """The training label an action stands for."""
    return F.when(kind == "report", F.coalesce(value, F.lit(DEFAULT_REPORT_LABEL))).when(
        kind == "classify", F.when(classification(value) == HATE, DEFAULT_REPORT_LABEL).otherwise(SAFE_LABEL)
    )


def _chosen(actions: DataFrame, *kinds: str) -> DataFrame:
    """Valid actions of some kinds, with the label they stand for."""
    return actions.filter(F.col("kind").isin(*kinds) & _is_valid()).withColumn("label", feedback_label(F.col("kind"), F.col("value")))


def _labelled(actions: DataFrame, msgs: DataFrame, *kinds: str) -> DataFrame:
    keep = [c for c in ("text", "offensive_score", "label") if c in msgs.columns]
    known = msgs.select(F.col("id").alias("message_id"), *keep).withColumnRenamed("label", "model_label")
    return _chosen(actions, *kinds).join(known, "message_id")


def _training_rows(labelled: DataFrame, extra: str) -> DataFrame:
    return labelled.select("text", "label", F.lit(extra).alias("extra"), "seq")


def report(actions: DataFrame, msgs: DataFrame) -> DataFrame:
    """Training rows from reports."""
    return _training_rows(_labelled(actions, msgs, "report"), "feedback")


def user_classify(actions: DataFrame, msgs: DataFrame) -> DataFrame:
    """Training rows from user classifications."""
    return _training_rows(_labelled(actions, msgs, "classify"), "user_classify")


def override_rows(training_rows: DataFrame) -> DataFrame:
    """``(key, label, seq)`` for the override table, from the rows of either kind."""
    return training_rows.select(tx.norm_key(F.col("text")).alias("key"), "label", "seq")


def audit_rows(actions: DataFrame, msgs: DataFrame) -> DataFrame:
    """Audit log rows: the human label next to the prediction at the time of feedback."""
    return _audit(_labelled(actions, msgs, "report", "classify"))


def audit_as_of(actions: DataFrame, msgs: DataFrame, log: DataFrame) -> DataFrame:
    """Audit log rows with the prediction that stood when the action came.

    ``log`` is the versioned classification log ``(id, ts, seq, label,
    offensive_score)``: a message classified again has another row.  Of several
    versions at one instant the last ``seq`` counts; a version at the instant of
    the action is seen by it.  An action before the first one has no prediction.
    """
    both = _chosen(actions, "report", "classify")
    versions = log.select(F.col("id").alias("message_id"), "ts", "seq", F.col("label").alias("model_label"), "offensive_score")
    held = as_of(both.select("message_id", "ts"), versions, "message_id", "ts", "seq", ["model_label", "offensive_score"])
    # Texts come last, so that a text travels once and not with each of its actions.
    texts = msgs.select(F.col("id").alias("message_id"), "text")
    return _audit(both.join(held, ["message_id", "ts"], "left").join(texts, "message_id"))


def _audit(both: DataFrame) -> DataFrame:
    note = F.when(F.col("kind") == "classify", F.concat(F.lit("user_classify:"), classification(F.col("value"))))
    return both.select(
        "ts", F.col("message_id").alias("id"), "text", "label", "offensive_score", "model_label", note.alias("action"), "seq"
    )


def reveal_state(actions: DataFrame) -> DataFrame:
    """``(message_id, revealed)``: each reveal flips the flag."""
    flips = actions.filter(F.col("kind") == "reveal").groupBy("message_id").agg(F.count("*").alias("n"))
    return flips.select("message_id", (F.col("n") % 2 == 1).alias("revealed"))


def action_deltas(actions: DataFrame) -> DataFrame:
    """Per message what a part of the log adds to its state; parts add up in any order (``merged_deltas``)."""
    accepted = F.when((F.col("kind") == "classify") & _is_valid(), F.col("seq"))
    return actions.groupBy("message_id").agg(
        F.count_if(F.col("kind") == "report").alias("reports"),
        F.count_if(F.col("kind") == "reveal").alias("reveals"),
        F.max_by(classification(F.col("value")), accepted).alias("user_classification"),
        F.max(accepted).alias("classified_at"),
    )


def merged_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("message_id").agg(
        F.sum("reports").alias("reports"),
        F.sum("reveals").alias("reveals"),
        F.max_by("user_classification", "classified_at").alias("user_classification"),
        F.max("classified_at").alias("classified_at"),
    )


def state_of(deltas: DataFrame) -> DataFrame:
    reported, revealed = (F.col("reports") > 0).alias("reported"), (F.col("reveals") % 2 == 1).alias("revealed")
    return deltas.select("message_id", reported, revealed, "user_classification")


def action_state(actions: DataFrame) -> DataFrame:
    """Per message: reported, revealed and the last accepted classification."""
    return state_of(action_deltas(actions))


def attach_actions(msgs: DataFrame, state: DataFrame) -> DataFrame:
    kept = msgs.drop("reported", "revealed", "user_classification")
    no = F.lit(False)
    return (
        kept.join(state.withColumnRenamed("message_id", "id"), "id", "left")
        .withColumn("reported", F.coalesce("reported", no))
        .withColumn("revealed", F.coalesce("revealed", no))
    )


def message_state(msgs: DataFrame, actions: DataFrame) -> DataFrame:
    """Messages with the state their actions leave them in."""
    return attach_actions(msgs, action_state(actions))
