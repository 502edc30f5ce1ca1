"""Training: prepare rows, fit, save, and the whole retraining chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, RegexTokenizer, SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators import curation as cu
from wardline.operators import labels as lb
from wardline.operators import splits as sp
from wardline.operators.evaluation import binary_metrics
from wardline.plans.classify import predict_binary
from wardline.plans.scoring import pipeline_scorer
from wardline.plans.term_vectors import TermVectors
from wardline.session import materialise
from wardline.sources import sinks

# Split shares and seeds, longest input in tokens.
HOLDOUT_SHARE = 0.20
VALIDATION_SHARE = 0.05
SPLIT_SEED = 99
MAX_TOKENS = 64

# Which of several labels of a text counts: the source's rank, the place in the source, then the later source name.
ORDER = ["source_rank", "seq", "source"]


def training_prep(df: DataFrame, dim: DataFrame, order: list[str] = ["seq"]) -> DataFrame:
    """Labelled rows, the last per text, with canonical label and label id."""
    rows = cu.keep_last(cu.drop_unlabelled(df), ["text"], order)
    return lb.label_ids(lb.map_labels(rows, dim), dim)


def truncate_tokens(df: DataFrame, col: str = "text", n: int = MAX_TOKENS, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, F.slice(tx.tokens(F.col(col)), 1, n))


def fit_classifier(
    df: DataFrame, features: int = 1 << 18, max_iter: int = 30, reg: float = 1e-4, max_tokens: int | None = None
) -> PipelineModel:
    """Multinomial logistic regression on hashed words, word pairs and character trigrams.

    ``df`` has ``text`` and ``label_id``.  Hashing needs no vocabulary, so no
    stage holds more on the driver than the coefficients.  ``max_tokens`` cuts
    the texts it is fitted on; the model scores whole texts.
    """
    if max_tokens:
        cut = truncate_tokens(df, "text", max_tokens, "_tokens")
        df = cut.withColumn("text", tx.join_tokens(F.col("_tokens"))).drop("_tokens")
    low = SQLTransformer(statement="SELECT *, lower(trim(text)) AS _cut FROM __THIS__")
    words = RegexTokenizer(inputCol="_cut", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+")
    terms = TermVectors(inputCols=["_cut", "_words"], outputCol="_counts", numFeatures=features)
    counting = PipelineModel([low, words, terms])
    # Written, as the weights and the regression each read the counts: texts are cut and hashed once.
    counted = materialise(counting.transform(df).select("_counts", "label_id"), "counted")
    weighted = IDF(inputCol="_counts", outputCol="_features", minDocFreq=2)
    regression = LogisticRegression(
        featuresCol="_features",
        labelCol="label_id",
        probabilityCol="probability",
        family="multinomial",
        maxIter=max_iter,
        regParam=reg,
    )
    fitted = Pipeline(stages=[weighted, regression]).fit(counted)
    return PipelineModel([*counting.stages, *fitted.stages])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass(frozen=True)
class RetrainSettings:
    sources: dict[str, DataFrame | None]
    split_path: str
    model_path: str
    seed: int = SPLIT_SEED
    features: int = 1 << 18
    max_iter: int = 30


def curate(sources: dict[str, DataFrame | None], dim: DataFrame) -> DataFrame:
    """Union, labelled rows, last per text, canonical labels, no rare classes.

    Class counts and later the passes of a split read the result several times,
    so it is written here: the sources are read and deduplicated once.
    """
    rows = cu.drop_unlabelled(cu.union_sources(sources))
    rows = cu.keep_last(rows, ["text"], ORDER)
    return cu.drop_rare(materialise(lb.map_labels(rows, dim), "curated"))


@dataclass(frozen=True)
class Retrained:
    model: PipelineModel
    validation: DataFrame
    holdout: DataFrame


def evaluated(model: PipelineModel, rows: DataFrame, label: str) -> DataFrame:
    """One row of metrics of the offensive class on ``rows`` (text, label)."""
    truth = F.when(F.col(label).isin(lb.SAFE_LABELS), "Not_offensive").otherwise("Offensive")
    guessed = predict_binary(rows.select("text", truth.alias("truth")), "text", pipeline_scorer(model))
    return binary_metrics(guessed, "truth", "predicted", "Offensive")


def retrain(spark: SparkSession, settings: RetrainSettings) -> Retrained:
    """Split again, train, save, and evaluate on both parts left out; a failing step stops the chain."""
    dim = lb.label_dim(spark)
    rows = curate(settings.sources, dim)
    train, holdout = sp.stratified_split(rows, "text", "mapped_label", HOLDOUT_SHARE, settings.seed)
    sinks.write_splits(train, holdout, settings.split_path)
    prepared = materialise(training_prep(train.drop("mapped_label"), dim, ORDER).select("text", "label_id", "mapped_label"), "prepared")
    fit_on, validation = sp.split(prepared, "text", VALIDATION_SHARE, settings.seed)
    model = fit_classifier(fit_on.select("text", "label_id"), settings.features, settings.max_iter, max_tokens=MAX_TOKENS)
    save_model(model, settings.model_path)
    return Retrained(model, evaluated(model, validation, "mapped_label"), evaluated(model, holdout, "mapped_label"))
