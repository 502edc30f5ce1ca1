"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import materialise


def components(links: DataFrame) -> DataFrame:
    """Smallest node of each component: (node, root) for every node of ``links`` (a, b).

    Each round points every node at the smallest of itself and its neighbours,
    follows that pointer twice more and joins the links of the pointed-at nodes;
    the node count at least halves.  A loop or a repeated link changes nothing;
    rows with a null end are ignored.  Without links the result is empty.
    """
    links = links.select(F.col("a").alias("a"), F.col("b").alias("b")).filter("a <> b")
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mapping = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "near")
        step = near
        for _ in range(2):
            onward = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = step.join(onward, "root").select("node", F.col("next").alias("root"))
        step = materialise(step, "step")
        ends = [step.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a <> b")
        links = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if mapping is None:
            mapping = step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            mapping = mapping.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            mapping = materialise(mapping, "mapping")
    return links.selectExpr("a AS node", "b AS root").limit(0) if mapping is None else mapping
