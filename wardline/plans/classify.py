"""The classifier: override, intercept, mask, score, gate, threshold, severity.

Rows with a human override or an intercepted text skip the model: a scorer that
runs in Python gets their ``needs_score`` flag, a scorer made of built-ins is
cheaper to evaluate than to branch around.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import scores as sc
from wardline.functions import text as tx
from wardline.operators import labels as lb
from wardline.operators import lexicon as lx
from wardline.operators import rules as rl
from wardline.operators import users as us
from wardline.plans.normalise import Settings, normalise
from wardline.plans.scoring import Scorer
from wardline.session import materialise


@dataclass(frozen=True)
class ClassifierSettings:
    normaliser: Settings
    scorer: Scorer
    overrides: DataFrame | None = None
    users: DataFrame | None = None
    room: str | None = None
    gate: bool = True
    threshold: float = sc.THRESHOLD
    max_terms: int = 10_000


def neutral_intercept(c: Column) -> Column:
    """True where the processed text is nothing but the neutral token."""
    return tx.strip(c) == tx.NEUTRAL


def apply_gate(df: DataFrame, hit: Column, score: str = "offensive") -> DataFrame:
    """Force typed texts with a gate hit that the model scored under the threshold."""
    return df.withColumn("gated", F.coalesce(hit & (F.col(score) < sc.THRESHOLD), F.lit(False))).withColumns(
        {
            score: F.when(F.col("gated"), sc.GATE_SCORE).otherwise(F.col(score)),
            "safe": F.when(F.col("gated"), sc.GATE_REST).otherwise(F.col("safe")),
            "scores": F.when(
                F.col("gated"), sc.score_list(Profanity=F.lit(sc.GATE_SCORE), Not_offensive=F.lit(sc.GATE_REST))
            ).otherwise(F.col("scores")),
        }
    )


def override_result(df: DataFrame, dim: DataFrame, col: str = "forced_label") -> DataFrame:
    """Result columns of rows a human has decided: full score, severity as bucket."""
    offensive = F.col(col) != lb.SAFE_LABEL
    out = lb.label_meta(df.withColumn("label", F.col(col)), dim, path="override")
    return out.withColumns(
        {
            "offensive_score": F.when(offensive, 1.0).otherwise(0.0),
            "safe_score": F.when(offensive, 0.0).otherwise(1.0),
            "is_offensive": offensive,
            "bucket": F.col("severity"),
            "all_scores": F.create_map("label", F.lit(1.0)),
        }
    ).drop("severity")


def process(df: DataFrame, settings: ClassifierSettings) -> DataFrame:
    """Add ``processed`` (normalised if typed, only stripped if audio) and ``ai_input`` (masked)."""
    typed = normalise(df, "text", settings.normaliser, "id", out="processed")
    df = typed.withColumn(
        "processed", F.when(F.col("is_audio"), tx.strip(F.col("text"))).otherwise(F.col("processed"))
    )
    exceptions = settings.normaliser.exceptions.select("word")
    words = exceptions.take(settings.max_terms + 1)
    if len(words) > settings.max_terms:
        df = materialise(df, "processed").withColumn("ai_input", F.col("processed"))
        df = us.mask_listed_words(df, exceptions, "ai_input", "id")
    else:
        df = df.withColumn("ai_input", rl.mask_words_in(F.col("processed"), [r["word"] for r in words]))
    if settings.users is not None:
        # names are looked up in the processed text and then replaced in it: without
        # writing it once, the normaliser would run twice
        df = materialise(df, "processed")
        df = us.mask_active_users(df, settings.users, "ai_input", "id", settings.room)
    return df


def classify(msgs: DataFrame, settings: ClassifierSettings) -> DataFrame:
    """Add the result columns to messages ``(id, seq, text, is_audio, guard_on, ...)``."""
    spark = msgs.sparkSession
    kept = msgs.columns
    dim = lb.canonical_dim(lb.label_dim(spark)).select("canonical", "display", "severity")
    df = msgs.withColumn("is_audio", F.coalesce("is_audio", F.lit(False)))
    if settings.overrides is not None:
        df = lb.apply_overrides(df.withColumn("key", tx.norm_key(F.col("text"))), settings.overrides)
    else:
        df = df.withColumn("forced_label", F.lit(None).cast("string"))
    df = process(df, settings)

    guard_off = ~F.coalesce(F.col("guard_on"), F.lit(True)) if "guard_on" in kept else F.lit(False)
    path = (
        F.when(guard_off, "off")
        .when(F.col("forced_label").isNotNull(), "override")
        .when(neutral_intercept(F.col("processed")), "intercept")
        .otherwise("model")
    )
    df = df.withColumn("path", path).withColumn("needs_score", F.col("path") == "model")
    df = settings.scorer(df, "ai_input")

    df = df.withColumn("safe", sc.safe_score(F.col("scores"), lb.SAFE_LABELS))
    df = df.withColumn("offensive", F.lit(1.0) - F.col("safe"))
    if settings.gate:
        terms = lx.load_terms(settings.normaliser.lexicon, settings.max_terms)
        if terms is None:
            df = lx.gate_by_table(df, "id", "ai_input", settings.normaliser.lexicon)
            hit = F.col("hits") > 0
        else:
            hit = lx.gate_hit(F.col("ai_input"), terms)
        df = apply_gate(df, F.col("needs_score") & ~F.col("is_audio") & F.coalesce(hit, F.lit(False)))
    else:
        df = df.withColumn("gated", F.lit(False))
    model_label = F.when(F.col("gated"), "Profanity").otherwise(sc.top_label(F.col("scores")))

    by_path = lambda model, override, intercept: (
        F.when(F.col("path") == "model", model).when(F.col("path") == "override", override).otherwise(intercept)
    )
    forced_off = F.col("forced_label") != lb.SAFE_LABEL
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    df = df.withColumn("label", by_path(model_label, F.col("forced_label"), F.lit(lb.SAFE_LABEL)))
    df = df.withColumn(
        "is_offensive", by_path(sc.is_offensive(F.col("offensive"), settings.threshold), forced_off, F.lit(False))
    )
    df = df.join(dim.withColumnRenamed("canonical", "label"), "label", "left")
    severity = F.coalesce("severity", F.when(forced_off, "high").otherwise("safe"))
    off = F.col("path") == "off"
    df = df.withColumns(
        {
            "label_display": F.when(~off, F.coalesce("display", "label")),
            "offensive_score": by_path(sc.rounded(F.col("offensive")), one(forced_off), F.lit(0.0)),
            "safe_score": F.when(~off, by_path(sc.rounded(F.col("safe")), one(~forced_off), F.lit(1.0))),
            "bucket": by_path(sc.bucket(F.col("offensive"), settings.threshold), severity, F.lit("safe")),
            "all_scores": F.when(
                ~off,
                by_path(sc.scores_map(F.col("scores")), F.create_map("label", F.lit(1.0)), F.create_map("label", F.lit(1.0))),
            ),
            "transliterated": F.when(off, F.col("text")),
        }
    )
    result = [
        "label", "label_display", "offensive_score", "safe_score", "is_offensive", "bucket", "all_scores", "transliterated",
    ]
    return df.select(*[c for c in kept if c not in result], "processed", "ai_input", "path", "gated", *result)


def predict_binary(
    df: DataFrame, col: str, scorer: Scorer, threshold: float = sc.THRESHOLD, truth: str | None = None
) -> DataFrame:
    """Verdict for evaluation: score, fold, threshold; no gate, overrides or masking."""
    df = scorer(df, col)
    score = sc.fold_scores(F.col("scores"), lb.SAFE_LABELS)
    df = df.withColumn("offensive", score).withColumn("_bad", sc.is_offensive(F.col("offensive"), threshold))
    df = df.withColumns(
        {
            "predicted": F.when(F.col("_bad"), "Offensive").otherwise("Not_offensive"),
            "offensive_score": sc.rounded(F.col("offensive")),
        }
    )
    if truth:
        df = df.withColumn("correct", (F.col(truth) == "Offensive") == F.col("_bad"))
    return df.drop("_bad", "offensive", "scores")
