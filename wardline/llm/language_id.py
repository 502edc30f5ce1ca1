"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte 3- and 4-grams, hashed to
``BUCKETS`` rows; a linear layer and a softmax turn it into probabilities.  Both
layers are trained together by stochastic gradient descent in numpy, on a bounded
sample: of every label the rows with the smallest hash of their key, at most
``PER_LANGUAGE`` each and ``SAMPLE`` together, but at least one.  Every fifth sampled row
of a label is kept out of training (rare labels are gone through up to ``MOST_TIMES``
as often as others), and sets the temperature of the softmax and the score
under which a prediction is rejected: at most ``LOST`` of the right ones of those
rows lie under it, and it is at most 0.5.

A prediction adds one row per n-gram of the whole text: of scores, as embedding and
layer of a trained model are multiplied once, or with more labels than
``DIMENSIONS`` of the embedding.  The label of a row, its key
and other columns are never inputs of a prediction.

Nulls and edge cases: a null text, and one without a letter, is ``und`` with score
0 and rejected.  Rows with a null label are not learned from.  A text too short
for an n-gram gets the prior.  Without any labelled row everything is ``und``.
Repeated rows are learned from once, with the smallest of the texts that share key and
label, and are predicted once each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.blocks import Block, blocks
from wardline.session import materialise

BUCKETS = 1 << 15
GRAMS = (3, 4)
DIMENSIONS = 16
PER_LANGUAGE = 600
SAMPLE = 120_000
EPOCHS = 6
MOST_TIMES = 4
RATE = 2.0
LOST = 0.001
UNKNOWN = "und"

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def _buckets(block: Block) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size: bucket at each position, and where each text's n-grams begin and end."""
    data, out = _LOWER[block.data] + np.uint32(1), []
    for n in GRAMS:
        count = max(0, len(data) - n + 1)
        mixed = np.full(count, n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ data[k : k + count] * _FACTORS[k]) * np.uint32(0x01000193)
        begin = np.minimum(block.offsets[:-1], count)
        out.append(((mixed >> np.uint32(8)) % np.uint32(BUCKETS), begin, np.maximum(begin, block.offsets[1:] - n + 1)))
    return out


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: embedding times layer; with a layer, the embedding
    layer: np.ndarray | None
    prior: np.ndarray
    temperature: float
    least: float

    def probabilities(self, block: Block) -> np.ndarray:
        grams = _buckets(block)
        total = sum(end - begin for _, begin, end in grams)
        sums_of = np.empty((block.last - block.first, self.scores.shape[1]))
        for k in range(self.scores.shape[1]):
            column = np.ascontiguousarray(self.scores[:, k])
            added = np.zeros(len(sums_of))
            for bucket, begin, end in grams:
                sums = np.concatenate(([0.0], np.cumsum(column[bucket], dtype=np.float64)))
                added += sums[end] - sums[begin]
            sums_of[:, k] = added / np.maximum(total, 1)
        logits = sums_of if self.layer is None else sums_of @ self.layer
        return softmax((logits + self.prior) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return odds / odds.sum(axis=-1, keepdims=True)


def _features(batches):
    for batch in batches:
        out = []
        for block in blocks(batch.column("text")):
            grams = _buckets(block)
            for i in range(block.last - block.first):
                found = np.concatenate([bucket[begin[i] : end[i]] for bucket, begin, end in grams])
                at, counts = np.unique(found, return_counts=True)
                out.append((at.astype("<u2").tobytes(), (counts / max(1, len(found))).astype("<f4").tobytes()))
        at, weights = zip(*out, strict=True) if out else ((), ())
        columns = [batch.column("key"), batch.column("label"), pa.array(at, pa.binary()), pa.array(weights, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "label", "at", "weights"])


def training_sample(rows: DataFrame) -> pa.Table:
    """Features of the sampled rows of ``rows`` (key, label, text); at most SAMPLE rows, or one a label, of at most BUCKETS entries."""
    rows = rows.filter(F.col("label").isNotNull() & F.col("key").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("key").alias("keys"))
    # Written, so that Spark knows how large they are: it broadcasts them if they are small.
    sizes = materialise(sizes, "labels")
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, sizes.count())))
    # About four times the rows wanted have a hash in the lowest such share: only they are ranked, however frequent the label.
    share = F.least(F.lit(1.0), (4 * each + 60) / F.col("keys"))
    low = F.xxhash64("key").cast("double") <= (2 * share - 1) * 2.0**63
    near = rows.select("key", "label").join(sizes, "label").filter(low).select("key", "label").distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key")
    chosen = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).drop("place")
    sampled = rows.join(materialise(chosen, "sample"), ["key", "label"])
    # Repeated rows of one key must not enlarge the sample.
    sampled = sampled.groupBy("key", "label").agg(F.min("text").alias("text"))
    return sampled.mapInArrow(_features, "key long, label string, at binary, weights binary").toArrow()


def train(sample: pa.Table) -> Model | None:
    languages = sorted(set(sample["label"].to_pylist()))
    if not languages:
        return None
    order = np.argsort(np.array(sample["key"].to_pylist()), kind="stable")
    number = {x: k for k, x in enumerate(languages)}
    truth = np.array([number[x] for x in sample["label"].to_pylist()])[order]
    at = [np.frombuffer(sample["at"][int(i)].as_py(), "<u2") for i in order]
    weights = [np.frombuffer(sample["weights"][int(i)].as_py(), "<f4") for i in order]
    # By label: a rare one keeps rows to learn from.
    by_label = np.argsort(truth, kind="stable")
    kept_out = np.zeros(len(order), bool)
    kept_out[by_label] = (np.arange(len(order)) - np.searchsorted(truth[by_label], truth[by_label])) % 5 == 4
    fit = np.flatnonzero(~kept_out)
    # Rows of a label with fewer than the average are taken up to MOST_TIMES as often.
    rows_of = np.bincount(truth[fit], minlength=len(languages))[truth[fit]]
    fit = np.repeat(fit, np.clip(len(fit) / len(languages) // rows_of, 1, MOST_TIMES).astype(int))
    rng = np.random.default_rng(7)
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, prior = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    done, steps = 0, EPOCHS * max(1, len(fit))
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = weights[i] @ embedding[at[i]]
            error = softmax(hidden @ layer + prior)
            error[truth[i]] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            prior -= 0.1 * rate * error
            # Weights are shares of a text, hence small; without the factor embeddings would hardly move.
            embedding[at[i]] -= rate * 20 * np.outer(weights[i], back)
    scores, factor = ((embedding @ layer).astype(np.float32), None) if len(languages) <= DIMENSIONS else (embedding, layer.astype(np.float64))
    checked = np.flatnonzero(kept_out) if kept_out.any() else np.arange(len(order))
    logits = np.stack([weights[i] @ scores[at[i]] for i in checked])
    logits = (logits if factor is None else logits @ factor) + prior
    right = truth[checked]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean()
    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    found = softmax(logits / temperature)
    sure = np.sort(found.max(axis=1)[found.argmax(axis=1) == right])
    least = min(0.5, float(sure[int(len(sure) * LOST)])) if len(sure) else 0.0
    return Model(languages, scores, factor, prior.astype(np.float64), float(temperature), least)


def _predict(model: Model) -> Callable:
    def work(batches):
        for batch in batches:
            labels, scores = [], []
            for block in blocks(batch.column("text")):
                found = model.probabilities(block)
                labels += [model.languages[k] for k in found.argmax(axis=1)]
                scores += found.max(axis=1).tolist()
            kept = [x for x in batch.schema.names if x != "text"]
            columns = [*(batch.column(x) for x in kept), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return work


def identify(docs: DataFrame, model: Model | None, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of every row with lang_pred, score and rejected."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = docs.select(*carried, letter, "text")
    if model is None:
        found = rows.drop("text").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
        return found.drop("letter")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*carried, "letter"]) + ", lang_pred string, score double"
    found = rows.mapInArrow(_predict(model), schema)
    return found.select(
        *carried,
        F.when(F.col("letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"),
        (~F.col("letter") | (F.col("score") < model.least)).alias("rejected"),
    )


def _held_out() -> Column:
    """Every third document by its id's checksum is never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def fit(docs: DataFrame) -> Model | None:
    """A model of the documents that are not held out."""
    known = docs.filter(~_held_out()).select(F.col("doc_id").alias("key"), F.col("lang").alias("label"), "text")
    return train(training_sample(known))


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs`` (doc_id, text, lang)."""
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def language_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return identify(whole, fit(docs), ["row"]).filter("NOT rejected").select("row.*")
