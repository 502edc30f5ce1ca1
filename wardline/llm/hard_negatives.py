"""Mining of hard negatives with angular triangle filtering.

Vectors hold integers: floor(256 * x) of every component x; a score is an inner
product.  An anchor's positives are the ``positives`` best other rows of its
label.  For each positive, the negatives are the best ``negatives`` rows of other
labels with ``low * positive_score <= 100 * score <= high * positive_score``.
Higher scores come first, ties by smaller vec_id.

Every vector is stored with its norm and its angles to ``DIRECTIONS`` reference
directions.  For an anchor a, a row x and a direction r, the angle between a and x
lies between ``|ar - xr|`` and ``min(ar + xr, 2 pi - ar - xr)``; the best of these
over all directions, widened by more than any rounding, gives an interval of the
cosine, and times both norms one of the score.  Only rows whose interval overlaps
what is asked for are scored: for positives, rows that can still be among the
best, in the order of the upper bound; for negatives, rows whose interval meets
one of the anchor's windows.

Anchors meet candidates in blocks of bounded size, cut by label, so that positives
are sought in blocks of the anchor's label and negatives in the others.  A meeting
yields at most ``positives`` rows an anchor, or ``negatives`` rows a positive, and
the best of these are the result.  The directions are the rows farthest from each
other (greedily) among the ``SAMPLE`` rows of a dimension with the smallest hash of
their id.

Nulls and edge cases: a row with a null id, a null label, a null or empty vector,
or a component that is null or not finite takes no part.  Components are held to
+-2**24 after the floor, so that scores fit 64 bits.  Rows are compared with those
of their own dimension only; rows that share an id are read once (the smallest
label and vector).  Fewer candidates give fewer rows, also none.  A window of a
negative positive score is empty.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.scratch import settled

DIRECTIONS = 16
SAMPLE = 256
LARGEST = 1 << 24
# Components held by a block of candidates and by a block of anchors.
CANDIDATES = 1 << 19
ANCHORS = 1 << 16
# Candidates scored at once on the way to the best positives.
STEP = 512
# Radians and parts of |a||x| by which bounds are widened; angles are kept as 32-bit floats.
WIDEN = 1e-5


def labelled_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(vec_id, label, dim, v): integer vectors that take part."""
    x = F.col(vector).cast("array<double>")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * 256, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    found = rows.filter(F.size(vector) > 0).filter(usable).select(
        F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v")
    )
    found = found.filter("vec_id IS NOT NULL AND label IS NOT NULL")
    found = found.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    return found.select("vec_id", "row.label", F.size("row.v").alias("dim"), "row.v")


def _apart(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` unit vectors of the sample, each as far as can be from those before it (or its opposite)."""
    lengths = np.linalg.norm(sample, axis=1)
    unit = sample[lengths > 0] / lengths[lengths > 0][:, None]
    chosen, near = [], np.zeros(len(unit))
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, np.abs(unit @ unit[chosen[-1]]))
    return unit[chosen]


def directions(vectors: DataFrame, count: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """Reference directions of each dimension, from at most ``SAMPLE`` of its rows."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = vectors.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE)
    found: dict[int, list] = {}
    for row in sample.select("dim", "v", "vec_id").orderBy("vec_id").collect():
        found.setdefault(row["dim"], []).append(row["v"])
    return {dim: _apart(np.array(v, np.float64), count) for dim, v in found.items()}


def _measured(chosen: dict[int, np.ndarray]) -> Callable:
    """Adds the norm and the angles to the directions of the row's dimension."""

    def work(batches):
        for batch in batches:
            dims, v = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            norms, angles = np.zeros(len(v)), [None] * len(v)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.array([v[i] for i in at], np.float64).reshape(len(at), dim)
                norms[at] = np.linalg.norm(x, axis=1)
                unit = x / np.where(norms[at] > 0, norms[at], 1)[:, None]
                found = np.arccos(np.clip(unit @ chosen[dim].T, -1, 1)).astype(np.float32)
                for i, row in zip(at, found, strict=True):
                    angles[i] = row
            columns = [*(batch.column(c) for c in batch.schema.names), pa.array(norms), pa.array(angles, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "norm", "angles"])

    return work


class _Block:
    """Candidates of one meeting, in the order of their ids."""

    def __init__(self, rows: pd.DataFrame, longest: float):
        rows = rows.sort_values("vec_id", ignore_index=True)
        self.ids, self.norms, self.angles = rows["vec_id"].to_numpy(), rows["norm"].to_numpy(), np.stack(rows["angles"])
        # Products of whole numbers, and their sums, are exact in doubles below 2**53.
        self.kind = np.float64 if longest * longest < 2**52 else np.int64
        self.x = np.stack(rows["v"]).astype(self.kind)

    def bounds(self, norm: float, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of an anchor with every candidate lie between these."""
        total = self.angles + angles
        nearest = np.abs(self.angles - angles).max(axis=1, initial=0).astype(np.float64) - WIDEN
        farthest = np.minimum(total, np.float32(2 * np.pi) - total).min(axis=1, initial=np.pi).astype(np.float64) + WIDEN
        scale = norm * self.norms
        room = WIDEN * scale + 1
        return scale * np.cos(np.minimum(farthest, np.pi)) - room, scale * np.cos(np.maximum(nearest, 0)) + room

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.x[at] @ anchor.astype(self.kind)).astype(np.int64)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


def best_positives(block: _Block, name: int, norm: float, angles: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of an anchor's k best candidates, and how many candidates were scored."""
    _, upper = block.bounds(norm, angles)
    order = np.argsort(-upper, kind="stable")
    ids, scores, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for begin in range(0, len(order), STEP):
        part = order[begin : begin + STEP]
        if len(scores) == k and upper[part[0]] < scores[-1]:
            break
        done += len(part)
        part = part[block.ids[part] != name]
        ids, scores = np.append(ids, block.ids[part]), np.append(scores, block.scores(v, part))
        top = _first(ids, scores, k)
        ids, scores = ids[top], scores[top]
    return ids, scores, done


def windowed_negatives(block: _Block, norm: float, angles: np.ndarray, v: np.ndarray, wanted: np.ndarray, k: int, low: int, high: int):
    """For each positive score: ids and scores of the k best candidates in its window; and how many candidates were scored."""
    lower, upper = block.bounds(norm, angles)
    meets = np.zeros(len(lower), bool)
    for p in wanted.tolist():
        meets |= (100 * lower <= high * p) & (100 * upper >= low * p)
    at = np.flatnonzero(meets)
    scores, out = block.scores(v, at), []
    for p in wanted.tolist():
        inside = np.flatnonzero((100 * scores >= low * p) & (100 * scores <= high * p))
        top = inside[_first(block.ids[at[inside]], scores[inside], k)]
        out.append((block.ids[at[top]], scores[top]))
    return out, len(at)


def _positives(k: int) -> Callable:
    def work(_, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            block = _Block(rows, max(anchors["norm"].max(), rows["norm"].max()))
            for a in anchors.itertuples():
                ids, scores, _ = best_positives(block, a.vec_id, a.norm, a.angles, a.v, k)
                out += [(a.vec_id, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"], dtype="int64")

    return work


_FOUND = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def _negatives(k: int, low: int, high: int) -> Callable:
    def work(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            block, label = _Block(rows, max(anchors["norm"].max(), rows["norm"].max())), rows["label"].iloc[0]
            for a in anchors.itertuples():
                if a.label == label:
                    continue
                wanted = np.array([p["positive_score"] for p in a.positives], np.int64)
                found, _ = windowed_negatives(block, a.norm, a.angles, a.v, wanted, k, low, high)
                for p, (ids, scores) in zip(a.positives, found, strict=True):
                    out += [(a.vec_id, p["positive_id"], p["positive_score"], int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=_FOUND, dtype="int64")

    return work


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, dim, v)."""
    vectors = settled(vectors.select("vec_id", "label", "dim", "v"), "vectors")
    shape = "vec_id long, label long, dim int, v array<int>, norm double, angles array<float>"
    measured = settled(vectors.mapInArrow(_measured(directions(vectors)), shape), "angles")
    per_block = lambda held: F.greatest(F.lit(1), F.floor(F.lit(held) / F.col("dim")))
    sizes = measured.groupBy("dim", "label").agg(F.count("*").alias("rows"), F.count(F.when(is_anchor, 1)).alias("asked"))
    sizes = sizes.select(
        "dim",
        "label",
        F.ceil(F.col("rows") / per_block(CANDIDATES)).alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("asked") / per_block(ANCHORS))).alias("parts"),
        "asked",
        F.sum("asked").over(Window.partitionBy("dim")).alias("all_asked"),
    )
    sizes = settled(sizes.withColumn("all_parts", F.greatest(F.lit(1), F.ceil(F.col("all_asked") / per_block(ANCHORS)))), "sizes")
    one = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    rows = measured.join(sizes, ["dim", "label"]).withColumn("block", one("blocks", 7))
    named = lambda df, *columns: df.select(*(F.col(c).alias(c) for c in columns))
    kept = ["vec_id", "label", "norm", "angles", "v"]

    place = ["dim", "label", "block", "part"]
    asked = named(rows.filter(is_anchor).withColumn("part", one("parts", 8)).drop("block").withColumn("block", every("blocks")), "dim", "block", "part", *kept)
    met = named(rows.filter("asked > 0").withColumn("part", every("parts")), "dim", "block", "part", *kept)
    found = asked.groupBy(place).cogroup(met.groupBy(place)).applyInPandas(
        _positives(positives), "anchor_id long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    pairs = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))

    asked = rows.filter(is_anchor).select("dim", *kept, one("all_parts", 9).alias("part")).join(pairs, "vec_id")
    blocks = sizes.select("dim", F.col("label").alias("of"), every("blocks").alias("block"))
    asked = named(asked.join(blocks, "dim").filter("of <> label"), "dim", "of", "block", "part", *kept, "positives")
    met = named(rows.withColumn("of", F.col("label")).withColumn("part", every("all_parts")), "dim", "of", "block", "part", *kept)
    place = ["dim", "of", "block", "part"]
    schema = ", ".join(f"{c} long" for c in _FOUND)
    found = asked.groupBy(place).cogroup(met.groupBy(place)).applyInPandas(_negatives(negatives, low, high), schema)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
