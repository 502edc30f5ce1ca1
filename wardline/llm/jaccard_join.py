"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents whose word-shingle sets have a Jaccard similarity of at least 0.8
(``100 * intersection >= 80 * union``) are linked; the result gives every
document its set size and the smallest doc_id reachable by links.

1. Equal sets form a class, named by a 64-bit fingerprint of the set; only
   classes are compared.
2. Similar sets A and B lack at most ``n - T`` of each other's shingles, with T
   the smallest intersection that a set of n elements needs.  So of the smallest
   ``n - T + h`` hashes of both, at least the smaller h are common.  A class
   that shares fewer with other classes can have no link.
3. For the classes left, all shingles that at least two of them hold are found;
   a class of which fewer than 80 % are held elsewhere can have no link either.
4. What is left is searched.  Classes that share one of their rarest shingles
   form a cluster, and clusters are dealt out as blocks of bounded size.  In a
   block every shingle has an inverted list.  A query needs T occurrences: its
   longest lists are set aside, the short ones are merged with a heap, and
   documents that occur often enough are looked up in the long ones by binary
   search (DivideSkip).  The count is the exact intersection.
5. The first search runs against the first class of each shared shingle only;
   it joins nearly all members of a large group of copies without comparing
   them with each other.  The second runs in clusters that are not yet one
   component: classes outside a cluster's largest component against all others,
   only between different components.

Nulls and edge cases: a null or empty text, or one of white space only, has an
empty set and is its own component; so is a row whose doc_id is null, with a
null component.  Texts with fewer words than a shingle are one shingle.
Repeated rows are one class.  Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.blocks import BASE, blocks, longs, mix, run_fingerprints
from wardline.llm.components import components
from wardline.llm.scratch import settled
from wardline.session import materialise

# Shingles held in the index of one search task, and queries sent to it at once.
INDEX_SHINGLES = 1_000_000
# One of so many of a set's shingles is added to its prefix, to demand more than one common shingle.
SPARE = 10
QUERY_SHINGLES = 4_000_000


def least_overlap(n, percent: int):
    """The smallest intersection that a set of n elements needs for a similarity of ``percent``."""
    return (n * percent + 99) // 100


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Position in the batch and sorted distinct shingle hashes of each text."""
    for block in blocks(batch.column("text"), lower=True):
        starts, ends, first = block.words()
        words = block.fingerprints(starts, ends)
        runs = run_fingerprints(words, size)
        for i in range(block.last - block.first):
            a, z = int(first[i]), int(first[i + 1])
            if z - a >= size:
                found = np.sort(runs[a : z - size + 1])
                yield block.first + i, found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif z > a:
                # Reads as a run of its own length, and no other length.
                yield block.first + i, mix(run_fingerprints(words[a:z], z - a) ^ np.uint64(z - a))
            else:
                yield block.first + i, words[:0]


def _name(found: np.ndarray) -> int:
    """Fingerprint of a set of hashes."""
    with np.errstate(over="ignore"):
        total = mix(found).sum(dtype=np.uint64) + np.uint64(len(found)) * BASE
        return int(mix(np.array([total ^ (found.max() if len(found) else np.uint64(0))], np.uint64)).view(np.int64)[0])


def _classes(size: int) -> Callable:
    def work(batches):
        for batch in batches:
            rows = [(i, len(found), _name(found)) for i, found in _sets(batch, size)]
            at, n, name = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at)), longs(n), longs(name)], names=["doc_id", "n", "class"]
            )

    return work


def _shingles(size: int, percent: int, all_of_them: bool) -> Callable:
    """(class, n, key) for the whole sets or for the smallest hashes of each; a class once per task."""

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, names, sizes = [], [], []
            for _, found in _sets(batch, size):
                name = _name(found)
                if not len(found) or name in seen:
                    continue
                seen.add(name)
                n = len(found)
                part = found if all_of_them else found[: n - least_overlap(n, percent) + 1 + n // SPARE]
                keys.append(part)
                names.append(np.full(len(part), name, np.int64))
                sizes.append(np.full(len(part), n, np.int64))
                if len(keys) == 512:
                    yield _batch(names, sizes, keys)
                    keys, names, sizes = [], [], []
            if keys:
                yield _batch(names, sizes, keys)

    def _batch(names, sizes, keys):
        columns = [np.concatenate(names), np.concatenate(sizes), np.concatenate(keys)]
        return pa.RecordBatch.from_arrays([longs(x) for x in columns], names=["class", "n", "key"])

    return work


class _Index:
    """Inverted lists of a block's classes: shingle to ascending document numbers."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]):
        self.names, self.sizes, self.labels = names, sizes, labels
        keys = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.lexsort((docs, keys))
        self.docs = docs[order]
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(keys))
        # All lists in one ascending array, for the binary probes.
        self.entries = np.repeat(np.arange(len(self.keys)), self.ends - self.starts) * len(sets) + self.docs

    def search(self, name: int, n: int, label: int, wanted: np.ndarray, percent: int) -> list[int]:
        """Numbers of the documents similar to a query set, at most one for each label other than its own."""
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == wanted]
        need = least_overlap(n, percent)
        if len(at) < need:
            return []
        lengths = self.ends[at] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        # DivideSkip's choice of how many long lists to set aside.
        aside = min(need - 1, int(need / (0.01 * np.log2(max(2, lengths.max())) + 1)))
        short, long = at[: len(at) - aside], np.sort(at[len(at) - aside :])
        found, last, count, done = [], -1, 0, {label}
        merged = heapq.merge(*(self.docs[self.starts[k] : self.ends[k]].tolist() for k in short))
        for doc in (*merged, -2):
            if doc == last:
                count += 1
                continue
            if last >= 0 and count >= need - aside and self.labels[last] not in done:
                probes = long * len(self.names) + last
                hit = np.searchsorted(self.entries, probes)
                hit[hit == len(self.entries)] = 0
                both = count + int((self.entries[hit] == probes).sum())
                if both * (100 + percent) >= percent * (n + int(self.sizes[last])):
                    found.append(last)
                    done.add(self.labels[last])
            last, count = doc, 1
        return found


def _search(percent: int) -> Callable:
    def work(_, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            lists = _Index(index["class"].to_numpy(), index["n"].to_numpy(), index["label"].to_numpy(), list(index["keys"]))
            for name, n, label, wanted in zip(queries["class"], queries["n"], queries["label"], queries["keys"], strict=True):
                out += [(name, int(lists.names[k])) for k in lists.search(name, n, label, wanted, percent) if lists.names[k] != name]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work


def t_occurrence_links(sets: DataFrame, index: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between ``queries`` and ``index``, both (class, cluster, label, size) of ``sets`` (class, n, keys).

    Clusters below ``INDEX_SHINGLES`` share blocks; a larger one is cut into
    blocks of that size, and its queries visit each.  Queries beyond
    ``QUERY_SHINGLES`` go to further copies of the block.  Blocks are planned
    on these narrow rows; the arrays join them when all is planned.
    """
    weight = lambda df, name: df.groupBy("cluster").agg(F.sum("size").alias(name))
    sizes = materialise(weight(index, "held").join(weight(queries, "asked"), "cluster"), "cluster-sizes")
    total = sizes.agg(F.sum("held"), F.sum("asked")).first()
    shared = int(max(1, (total[0] or 0) // INDEX_SHINGLES * 2, (total[1] or 0) // QUERY_SHINGLES * 2, 16))
    big = (F.col("held") > INDEX_SHINGLES) | (F.col("asked") > QUERY_SHINGLES)
    sizes = sizes.select(
        "cluster",
        F.when(big, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(shared))).alias("block"),
        big.alias("big"),
        F.when(big, F.ceil(F.col("held") / INDEX_SHINGLES)).otherwise(1).cast("int").alias("parts"),
        F.when(big, F.ceil(F.col("asked") / QUERY_SHINGLES)).otherwise(1).cast("int").alias("copies"),
    )
    one = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = ["block", "big", "part", "copy"]

    def placed(df: DataFrame, part: Column, copy: Column) -> DataFrame:
        """Rows with their arrays at each of their places."""
        spots = df.join(sizes, "cluster").select("class", "label", "block", "big", part.alias("parts"), copy.alias("copies"))
        found = sets.select(*(F.col(c).alias(c) for c in ("class", "n", "keys"))).join(spots, "class")
        found = found.withColumn("part", F.explode("parts")).withColumn("copy", F.explode("copies"))
        return found.select(*(F.col(c).alias(c) for c in (*place, "class", "label", "n", "keys")))

    index = placed(index, F.array(one("parts")), every("copies"))
    queries = placed(queries, every("parts"), F.array(one("copies")))
    return index.groupBy(place).cogroup(queries.groupBy(place)).applyInPandas(_search(percent), "a long, b long")


def _candidates(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(class, n, keys): classes that may have a link, their shared shingles from rare to frequent."""
    pairs = docs.select("text").mapInArrow(_shingles(size, percent, False), "class long, n long, key long")
    same = Window.partitionBy("key")
    common = pairs.withColumn("shared", F.min("class").over(same) != F.max("class").over(same)).filter("shared")
    # The smallest possible partner of a set has T elements, and spare ones for that size.
    least = F.floor((F.col("n") * percent + 99) / 100)
    live = common.groupBy("class", "n").count().filter(F.col("count") >= 1 + F.floor(least / SPARE)).select("class")
    live = classes.join(live, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    live = settled(live.select("doc_id").distinct(), "live")
    texts = docs.select("doc_id", "text").join(live, "doc_id", "left_semi").select("text")
    held = texts.mapInArrow(_shingles(size, percent, True), "class long, n long, key long")
    shared = held.withColumn("held", F.count("*").over(same)).filter("held > 1")
    lists = shared.groupBy("class", "n").agg(F.sort_array(F.collect_set(F.struct("held", "key"))).alias("keys"))
    enough = F.size("keys") * 100 >= F.col("n") * percent
    return lists.filter(enough).select("class", "n", F.col("keys.key").alias("keys"))


def link_classes(docs: DataFrame, classes: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Components of classes with a link: (node, root)."""
    sets = settled(_candidates(docs, classes, size, percent), "sets")
    # In the full order the shingles that no other class holds come first and take their share of the prefix.
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - (F.col("n") - F.size("keys"))
    prefixes = sets.select("class", F.explode(F.slice("keys", 1, prefix.cast("int"))).alias("key"))
    stars = prefixes.withColumn("first", F.min("class").over(Window.partitionBy("key"))).select("class", "first").distinct()
    stars = materialise(stars, "stars")
    clusters = components(stars.select(F.col("class").alias("a"), F.col("first").alias("b")))
    sized = sets.select("class", F.size("keys").alias("size"))
    placed = sized.join(clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")), "class")
    placed = materialise(placed, "placed")
    firsts = stars.filter("class <> first").select(F.col("first").alias("class")).distinct()
    own = placed.withColumn("label", F.col("class"))
    links = materialise(t_occurrence_links(sets, own.join(firsts, "class", "left_semi"), own, percent), "links-first")
    joined = materialise(components(links), "joined")
    labelled = placed.join(joined.select(F.col("node").alias("class"), "root"), "class", "left")
    labelled = materialise(labelled.withColumn("label", F.coalesce("root", "class")).drop("root"), "labelled")
    parts = labelled.groupBy("cluster", "label").count()
    open_ = parts.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.count("*").alias("labels"))
    rest = labelled.join(materialise(open_.filter("labels > 1").drop("labels"), "open"), "cluster")
    rest = materialise(rest, "rest")
    more = t_occurrence_links(sets, rest.drop("largest"), rest.filter("label <> largest").drop("largest"), percent)
    return components(links.unionByName(more))


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    members = materialise(docs.mapInArrow(_classes(size), "doc_id long, n long, class long"), "classes")
    classes = members.filter("n > 0 AND doc_id IS NOT NULL")
    roots = link_classes(docs.filter("doc_id IS NOT NULL"), classes, size, percent)
    firsts = classes.groupBy("class").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    firsts = materialise(firsts, "firsts")
    lowest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.join(lowest, "root").select("class", "component_id")
    found = members.join(named, "class", "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
