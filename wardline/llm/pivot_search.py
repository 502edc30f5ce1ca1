"""Exact top-k inner-product search with a pivot table.

Vectors are integers: floor(256 * x) of every component x.  A vector gets one
more coordinate, sqrt(M - |v|^2) with M the largest squared length, and a query
gets 0 there, so that a larger inner product is a smaller distance.  Distances
to the pivots are computed once; by the triangle inequality the largest of
|d(q, p) - d(x, p)| over the pivots bounds d(q, x) from below, hence the inner
product from above.  Candidates are evaluated in the order of that bound until the
bound falls under the k-th best score found; equal scores count as not under it.

Query blocks meet candidate blocks of bounded size; each meeting yields at most
k rows per query, and the best k of these are the result.  The pivots are the
vectors with the smallest hash of their id, a fixed number of them.

Nulls and edge cases: a vector that is null, empty or holds a null, a NaN or an
infinity takes no part, nor does a null id.  Vectors are compared with those of
their own dimension only.  Fewer than k candidates give fewer rows.  Ties go to
the smaller id.  A row is not its own candidate, nor is another row with its id;
rows that share an id are read once (the smallest vector).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialise

PIVOTS = 32
# Vectors in a candidate block and in a query block; candidates evaluated at once.
CANDIDATES = 4096
QUERIES = 512
STEP = 128


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): integer vectors that take part."""
    x = F.col(vector).cast("array<double>")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & usable)
    v = F.transform(x, lambda e: F.floor(e * 256).cast("long"))
    return rows.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(v).alias("v")).withColumn("dim", F.size("v"))


def _best(k: int, pivots: dict[int, np.ndarray], longest: dict[int, int]) -> Callable:
    def work(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            dim = int(rows["dim"].iloc[0])
            rows = rows.sort_values("vec_id", ignore_index=True)
            ids, x, q = rows["vec_id"].to_numpy(), np.stack(rows["v"]), np.stack(queries["v"])
            big, p = float(longest[dim]), pivots[dim]
            # Products of whole numbers are exact in doubles below 2**53, and then much faster.
            exact = np.float64 if big < 2**52 else np.int64
            x, q, p = x.astype(exact), q.astype(exact), p.astype(exact)
            square = lambda a: np.einsum("ij,ij->i", a, a).astype(np.float64)
            lift = lambda a: np.sqrt(np.maximum(big - square(a), 0))
            across = lambda a, added: square(a)[:, None] + square(p) - 2 * (a @ p.T) + (added[:, None] - lift(p)) ** 2
            apart = lambda a, added: np.sqrt(np.maximum(across(a, added), 0))
            table, asked = apart(x, lift(x)), apart(q, np.zeros(len(q)))
            for name, one, mine in zip(queries["vec_id"], q, asked, strict=True):
                gap = np.abs(table - mine).max(axis=1)
                bound = (float(one.astype(np.float64) @ one.astype(np.float64)) + big - gap**2) / 2
                # Rounding of roots and sums, far above what doubles lose here.
                bound += 1e-6 * (abs(bound) + big) + 1
                order = np.argsort(-bound, kind="stable")
                scores, at = np.zeros(0, exact), np.zeros(0, np.int64)
                for begin in range(0, len(order), STEP):
                    part = order[begin : begin + STEP]
                    if len(scores) == k and bound[part[0]] < scores[-1]:
                        break
                    part = part[ids[part] != name]
                    scores, at = np.append(scores, x[part] @ one), np.append(at, ids[part])
                    top = np.lexsort((at, -scores))[:k]
                    scores, at = scores[top], at[top]
                out += [(name, int(i), int(s)) for i, s in zip(at, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return work


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, v, dim) for the rows that are queries."""
    vectors = materialise(vectors, "vectors")
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)
    facts = vectors.groupBy("dim").agg(
        F.count("*").alias("rows"), F.count(F.when(is_query, 1)).alias("asked"), F.max(squares).alias("longest")
    )
    # One row per dimension, of which a table of embeddings has one or a few.
    facts = {r["dim"]: r for r in facts.collect()}
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    chosen = vectors.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
    pivots: dict[int, list] = {}
    for row in chosen.select("dim", "v").collect():  # PIVOTS rows per dimension
        pivots.setdefault(row["dim"], []).append(row["v"])
    blocks = [(d, -(-r["rows"] // CANDIDATES), max(1, -(-r["asked"] // QUERIES))) for d, r in facts.items()]
    if not blocks:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    sizes = vectors.sparkSession.createDataFrame(blocks, "dim int, blocks long, parts long")
    spread = vectors.join(F.broadcast(sizes), "dim")
    one = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = ["dim", "block", "part"]
    rows = spread.withColumn("block", one("blocks")).withColumn("part", every("parts")).select(*place, "vec_id", "v")
    queries = spread.filter(is_query).withColumn("part", one("parts")).withColumn("block", every("blocks"))
    queries = queries.select(*(F.col(c).alias(c) for c in (*place, "vec_id", "v")))
    work = _best(k, {d: np.array(p, np.int64) for d, p in pivots.items()}, {d: r["longest"] for d, r in facts.items()})
    found = queries.groupBy(place).cogroup(rows.groupBy(place)).applyInPandas(work, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
