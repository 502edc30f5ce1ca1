"""Quality rules: counts per document, then robust multivariate outliers per language and source.

A document fails the base rule if it has fewer than ``LEAST_WORDS`` words or if
more than ``MOST_REPEATED`` percent of its words lie in 8-word windows that the text
holds twice.  The others become vectors of transformed statistics, and every group
of one language and source gets the minimum-covariance-determinant estimate of
its centre and scatter.  From the coordinate-wise median as a start, each
concentration step keeps the nearest ``SHARE`` of the group by Mahalanobis
distance, and computes mean and covariance anew; the determinant cannot grow.
A reweighting step over all but clear outliers follows.  Documents whose distance
exceeds the cut are rejected.  A source with fewer than ``LEAST_DOCS`` documents
of a language that pass the base rule is judged by the estimate of that whole
language, and if that has fewer too, of all documents, however few.

Every step is one aggregation over the whole table of statistics: distances are
rounded to ``1 / BINS`` of a power of two, moments are summed per group and bin,
and the bins that hold the nearest share are added up, so no group is
collected, however large.

A statistic that hardly varies in a group (most texts have no symbols) has
almost no robust variance.  Each one therefore has a ``floor``: a spread that is no
reason to reject, the least that the scatter has.  A group that varies more keeps its
own.  The floors are small enough that each statistic can reject alone.

Nulls and edge cases: a null text has no words and fails the base rule, as does an
empty one.  A null language or source is a group value of its own.  Repeated rows count and
are judged once each.  Other columns pass through ``quality_filter``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.blocks import IS_SPACE, Block, blocks, run_fingerprints
from wardline.session import materialise

LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
SHARE = 0.75
STEPS = 5
BINS = 32
LEAST_DOCS = 50
EVERYTHING = "all"
# Share of the squared distances of clean documents within the cut, were the vectors normal.
WITHIN = 0.999

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _doc_sums(block: Block, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[block.offsets[1:]] - total[block.offsets[:-1]]


def _repeated(owner: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of one owner each: seen more than once; seen earlier (items are in text order)."""
    order = np.lexsort((np.arange(len(items)), items, owner))
    same = (items[order[1:]] == items[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice, again = np.zeros(len(items), bool), np.zeros(len(items), bool)
    again[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def _block_counts(block: Block) -> list[np.ndarray]:
    starts, ends, first = block.words()
    docs = block.last - block.first
    space = IS_SPACE[block.data]
    chars = _doc_sums(block, ~space & (block.data & 0xC0 != 0x80))
    symbols = _doc_sums(block, _SYMBOL[block.data])
    # Words in repeated windows.
    words = np.diff(first)
    owner = np.repeat(np.arange(docs), words)
    runs = run_fingerprints(block.fingerprints(starts, ends), WINDOW)
    at = np.flatnonzero(owner[: len(runs)] == owner[WINDOW - 1 :]) if len(runs) else np.zeros(0, np.int64)
    twice = at[_repeated(owner[at], runs[at])[0]]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    repeated = covered[first[1:]] - covered[first[:-1]]
    # Lines with a word that equal an earlier line.
    breaks = np.flatnonzero(block.data == 10)
    begin = np.unique(np.concatenate((block.offsets[:-1], breaks + 1)))
    begin = begin[begin < len(block.data)]
    stop = np.minimum(np.append(begin[1:], len(block.data)), block.offsets[np.searchsorted(block.offsets, begin, side="right")])
    stop = stop - (block.data[stop - 1] == 10)
    solid = np.concatenate(([0], np.cumsum(~space)))
    keep = solid[stop] > solid[begin]
    begin, stop = begin[keep], stop[keep]
    line_owner = np.searchsorted(block.offsets, begin, side="right") - 1
    _, again = _repeated(line_owner, block.fingerprints(begin, stop))
    lines = np.bincount(line_owner, minlength=docs)
    return [words, chars, symbols, np.bincount(line_owner[again], minlength=docs), repeated, lines]


def _counts(batches):
    for batch in batches:
        parts = [_block_counts(b) for b in blocks(batch.column("text"))]
        if parts:
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
            kept = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *columns], names=[*kept, *_COUNTS])


def text_counts(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of every row with the counts of its text and base_failed."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), *(f"{c} long" for c in _COUNTS)])
    found = docs.select(*carried, "text").mapInArrow(_counts, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def _statistics() -> list[tuple[Column, float]]:
    """Transformed statistics and the floor of each."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return [
        (F.log1p(F.col("word_chars") / words), 0.06),
        (F.log1p(F.col("n_symbols") / words), 0.03),
        (F.asin(F.sqrt(F.col("n_dup_lines") / lines)), 0.1),
        (F.asin(F.sqrt(F.col("n_repeat_words") / words)), 0.1),
        (F.log(words), 0.5),
    ]


def _normal_share(bound: float, size: int) -> float:
    """Share of squared distances of ``size`` normal coordinates that are at most ``bound``."""
    r = np.linspace(0, np.sqrt(bound), 20_001)
    far = np.linspace(0, 30, 200_001)
    weight = lambda x: x ** (size - 1) * np.exp(-x * x / 2)
    return float(np.trapezoid(weight(r), r) / np.trapezoid(weight(far), far))


def _bound(share: float, size: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _normal_share(middle, size) < share else (low, middle)
    return low


def _estimates(size: int, scale: float, floors: list[float]) -> Callable:
    """Centre and inverse scatter of each group from its moments."""

    def work(batches):
        upper = np.triu_indices(size)
        for batch in batches:
            centres, inverses = [], []
            for n, first, second in zip(batch["n"], batch["first"], batch["second"], strict=True):
                mean = np.asarray(first, float) / n
                scatter = np.zeros((size, size))
                scatter[upper] = np.asarray(second, float) / n - np.outer(mean, mean)[upper]
                scatter = scatter + np.triu(scatter, 1).T
                scatter = scatter * scale
                scatter += np.diag(np.maximum(np.square(floors) - np.diag(scatter), 0.0))
                inverses.append(np.linalg.inv(scatter).ravel().tolist())
                centres.append(mean.tolist())
            yield pd.DataFrame({"group": batch["group"], "centre": centres, "inverse": inverses})

    return work


def _distance(size: int) -> Column:
    away = [F.col(f"x{i}") - F.col("centre")[i] for i in range(size)]
    terms = [away[i] * away[j] * F.col("inverse")[i * size + j] for i in range(size) for j in range(size)]
    return F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0))


def mcd_estimates(rows: DataFrame, size: int, floors: list[float]) -> DataFrame:
    """(group, centre, inverse): robust centre and inverse scatter of ``rows`` (group, x0 ...).

    ``rows`` is read once per step and should be a written table; groups should
    have several times more rows than there are statistics.
    """
    moments = [F.count("*").alias("n")]
    moments += [F.array(*(F.sum(f"x{i}") for i in range(size))).alias("first")]
    moments += [F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(size) for j in range(i, size))).alias("second")]
    schema = "group string, centre array<double>, inverse array<double>"
    pairs = size * (size + 1) // 2
    medians = rows.groupBy("group").agg(*(F.percentile(F.round(f"x{i}", 3), 0.5).alias(f"m{i}") for i in range(size)))
    flat = np.diag(1 / np.square(np.array(floors) * 3)).ravel().tolist()
    start = medians.select("group", F.array(*(f"m{i}" for i in range(size))).alias("centre"), F.lit(flat).cast("array<double>").alias("inverse"))
    now = materialise(start, "mcd")
    # The nearest share has less spread than the whole; so have all but the clear outliers.
    shrunk = lambda share: share / _normal_share(_bound(share, size), size + 2)
    add = lambda name, n: F.array(*(F.sum(F.col(name)[i]) for i in range(n))).alias(name)
    for step in range(STEPS + 1):
        far = rows.join(now, "group").withColumn("distance", _distance(size))
        if step < STEPS:
            bins = far.withColumn("bin", F.floor(F.log2(F.col("distance") + 1e-6) * BINS)).groupBy("group", "bin").agg(*moments)
            each = Window.partitionBy("group")
            below = F.coalesce(F.sum("n").over(each.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            near = bins.withColumn("below", below).withColumn("docs", F.sum("n").over(each)).filter(F.col("below") < F.col("docs") * SHARE)
            near = near.groupBy("group").agg(F.sum("n").alias("n"), add("first", size), add("second", pairs))
            scale = shrunk(SHARE)
        else:
            near = far.filter(F.col("distance") <= _bound(0.975, size)).groupBy("group").agg(*moments)
            scale = shrunk(0.975)
        now = materialise(near.mapInPandas(_estimates(size, scale, floors), schema), "mcd")
    return now


def _counted(docs: DataFrame, carried: list[str]) -> DataFrame:
    nulls = {"ignoreNullFields": "false"}
    names = {"own": F.to_json(F.struct("lang", "source"), nulls), "pool": F.to_json(F.struct("lang"), nulls)}
    found = text_counts(docs.withColumns(names), [*carried, *names])
    return found.withColumns({f"x{i}": x for i, (x, _) in enumerate(_statistics())})


def _fitted(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimates by group, and which group each language and source belongs to."""
    floors = [floor for _, floor in _statistics()]
    passed = counted.filter(~F.col("base_failed"))
    sizes = passed.groupBy("own", "pool").count()
    pools = sizes.groupBy("pool").agg(F.sum("count").alias("docs"))
    wider = F.when(F.col("docs") >= LEAST_DOCS, F.col("pool")).otherwise(EVERYTHING)
    group = F.when(F.col("count") >= LEAST_DOCS, F.col("own")).otherwise(wider).alias("group")
    groups = materialise(sizes.join(pools, "pool").select("own", group), "groups")
    # A row counts in its own group and in the wider ones that small groups of any source need.
    needed = groups.select("group").distinct()
    among = F.explode(F.array("own", "pool", F.lit(EVERYTHING))).alias("group")
    grouped = passed.select(among, *(f"x{i}" for i in range(len(floors)))).join(needed, "group", "left_semi")
    rows = materialise(grouped, "statistics")
    return mcd_estimates(rows, len(floors), floors), groups


def _judged(counted: DataFrame, estimates: DataFrame, groups: DataFrame) -> DataFrame:
    found = counted.join(groups, "own", "left").join(estimates, "group", "left")
    distance = F.when(~F.col("base_failed"), _distance(len(_statistics())))
    found = found.withColumn("distance", F.when(F.col("centre").isNotNull(), distance))
    return found.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= _bound(WITHIN, len(_statistics()))))


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row."""
    counted = materialise(_counted(docs.select("doc_id", "text", "lang", "source"), ["doc_id"]), "counts")
    return _judged(counted, *_fitted(counted)).select("doc_id", *_COUNTS[:5], "base_failed", "kept", "distance")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    The texts are counted once for the estimates and once more for the verdict, which saves shuffling or writing them.
    """
    estimates, groups = _fitted(materialise(_counted(docs.select("text", "lang", "source"), []), "counts"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", "lang", "source")
    return _judged(_counted(whole, ["row"]), estimates, groups).filter("kept").select("row.*")
