"""The version of a thing that held at a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialise

# Moments of one key beyond which they are cut into runs, and the number of runs of such a key.
RUN_ROWS = 1_000_000
RUNS = 256


def as_of(points: DataFrame, versions: DataFrame, key: str, at: str, order: str, values: list[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """``(key, at, *values)``: for each distinct point, the last version of its key that is not after it.

    ``versions`` has ``key``, ``at``, ``order`` (which of several at one instant
    counts: the highest) and the values.  Points before the first version get
    nulls; rows with a null key or instant take no part.

    Points and versions become one row per key and instant, combined on the map
    side.  A window over each key then carries versions forward.  A key with
    very many instants is cut into sorted runs at its own quantiles, each run is
    a window group of its own, and what a run starts with comes from the last
    versions of the runs before it: a few hundred rows a key.
    """
    name, time = F.col(key).alias("_key"), F.col(at).alias("_at")
    kind = f"struct<{', '.join(f'{versions.schema[v].name}:{versions.schema[v].dataType.simpleString()}' for v in values)}>"
    asked = points.select(name, time, F.lit(None).cast(versions.schema[order].dataType).alias("_order"), F.lit(None).cast(kind).alias("_value"), F.lit(True).alias("_asked"))
    known = versions.select(name, time, F.col(order).alias("_order"), F.struct(*values).alias("_value"), F.lit(False).alias("_asked"))
    moments = asked.unionByName(known).filter("_key IS NOT NULL AND _at IS NOT NULL").groupBy("_key", "_at")
    moments = materialise(moments.agg(F.max_by("_value", "_order").alias("_value"), F.bool_or("_asked").alias("_asked")), "moments")

    instant = F.unix_micros(F.col("_at").cast("timestamp"))
    hot = moments.groupBy("_key").count().filter(F.col("count") > run_rows).select("_key")
    shares = F.array(*[F.lit(i / RUNS) for i in range(1, RUNS)])
    cuts = moments.join(hot, "_key", "left_semi").groupBy("_key").agg(F.percentile_approx(instant, shares).alias("_cuts"))
    # Written, as every reader must see the same cuts.
    cuts = materialise(cuts, "cuts")
    run = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= instant)), F.lit(0))
    placed = moments.join(cuts, "_key", "left").withColumn("_run", F.when(F.col("_cuts").isNull(), 0).otherwise(run))

    forward = Window.partitionBy("_key", "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumn("_value", F.last("_value", ignorenulls=True).over(forward)).filter("_asked")
    ends = placed.filter("_cuts IS NOT NULL AND _value IS NOT NULL").groupBy("_key", "_run").agg(F.max_by("_value", "_at").alias("_end"))
    # One row for each run of such a key, also for those without a version.
    runs = cuts.select("_key", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("_run")).join(ends, ["_key", "_run"], "left")
    before = Window.partitionBy("_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("_key", "_run", F.last("_end", ignorenulls=True).over(before).alias("_start")).filter("_start IS NOT NULL")
    found = found.join(starts, ["_key", "_run"], "left").withColumn("_value", F.coalesce("_value", "_start"))
    return found.select(F.col("_key").alias(key), F.col("_at").alias(at), *(F.col(f"_value.{v}").alias(v) for v in values))
