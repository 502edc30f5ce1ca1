"""Session settings, bounded configuration reads and shared scratch folders."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

# Settings that matter for the plans in this package.  Adaptive execution coalesces
# shuffle partitions to the advisory size; build_session says how many it starts from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # State on disk: it may outgrow an executor's heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
SHUFFLE_PARTITION_BYTES = 128 << 20


def build_session(app: str = "wardline", input_bytes: int | None = None, **extra: str) -> SparkSession:
    """A session; with ``input_bytes``, shuffles start from one partition for each 128 MB of the largest input, but at least 200."""
    builder = SparkSession.builder.appName(app)
    wide = {}
    if input_bytes is not None:
        wide["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(max(200, -(-input_bytes // SHUFFLE_PARTITION_BYTES)))
    for key, value in {**SETTINGS, **wide, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for stream state or intermediate tables.

    A cluster names the shared root in ``spark.checkpoint.dir``.  Only a local
    session, where the driver is the one machine there is, may do without it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="wardline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A literal table (label dimension and the like) with known size."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def take_config(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a configuration table; refuses one that is larger than ``limit``."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is not a configuration table")
    return rows


def pinned(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """A frame that should be small (one row per class, say) as a literal table.

    It is computed once, here, and its size is known to the planner, so the
    large side of a join on it is not shuffled.  If it has more than ``limit``
    rows after all, the frame itself comes back and the join shuffles.
    """
    rows = df.take(limit + 1)
    return df if len(rows) > limit else _literal(df, rows)


def _literal(df: DataFrame, rows: list) -> DataFrame:
    columns = {name: [row[name] for row in rows] for name in df.columns}
    table = pa.table({name: pa.array(values, to_arrow_type(df.schema[name].dataType)) for name, values in columns.items()})
    return df.sparkSession.createDataFrame(table)


def spread(df: DataFrame) -> DataFrame:
    """Give text-heavy narrow work all cores when the input is only a few splits.

    A small file is often one row group, hence one task.  A large table has
    more splits than the cluster has cores and is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


_scope = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what this thread has materialised inside; results must be written by then."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer
        context = spark.sparkContext
        for path in paths:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several plans read, and read it back: computed once, safe from lost executors."""
    path = scratch_dir(df.sparkSession, name)
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
