"""Continuous operation.

The fuzzy mapping and the dedupes are batch operators inside a micro-batch.
Each micro-batch writes a folder of its own and overwrites it when replayed, so
a restart after a failure leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardline import schemas
from wardline.functions import text as tx
from wardline.operators import actions as ac
from wardline.operators import curation, evaluation
from wardline.operators import labels as lb
from wardline.operators import messages as ms
from wardline.operators import users as us
from wardline.plans.classify import ClassifierSettings, classify
from wardline.session import scratch_dir, scratch_scope
from wardline.streaming import saved

# Micro-batches after which overrides and users are written as one table.
SNAPSHOT_EVERY = 100


def stream_messages(
    spark: SparkSession, path: str, schema: T.StructType = schemas.INCOMING, fmt: str = "parquet", **options
) -> DataFrame:
    """Messages as they land in a folder.  In deployment the same frame comes from a message bus."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def sink_messages(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = False
) -> StreamingQuery:
    """Hand every micro-batch to ``fn``."""
    checkpoint = checkpoint or scratch_dir(stream.sparkSession, "stream")
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Batches up to which a complete snapshot exists."""
    context = spark.sparkContext
    done = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_snapshots/upto=*/_SUCCESS")
    found = done.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(done) or []
    return [int(x.getPath().getParent().getName().split("=")[1]) for x in found]


def _read(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All batches, or those before the given one: the last snapshot of them, and the batches since."""
    upto = max((x for x in _snapshots(spark, path) if before is None or x < before), default=None)
    try:
        rows = spark.read.schema(schema + ", batch long").option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    if upto is None:
        return rows.drop("batch")
    rows = rows.filter(F.col("batch") > upto).drop("batch")
    return rows.unionByName(spark.read.schema(schema).parquet(f"{path}/_snapshots/upto={upto}"))


def _snapshot(spark: SparkSession, path: str, batch: int, every: int, table: Callable[[int], DataFrame]) -> None:
    """Every so many batches, write ``table(batch)``, the rows of all batches before this one, as one table.

    Those batches are complete and do not run again, so a replay finds the same
    snapshot; a reader never needs to open their files after that.
    """
    if batch and batch % every == 0 and batch - 1 not in _snapshots(spark, path):
        table(batch).write.mode("overwrite").parquet(f"{path}/_snapshots/upto={batch - 1}")


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_overrides(rows: DataFrame, path: str, batch: int, every: int = SNAPSHOT_EVERY) -> None:
    """``(key, label, seq)`` rows that take effect with the next micro-batch.  Batch numbers ascend."""
    spark = rows.sparkSession
    _snapshot(spark, path, batch, every, lambda before: refresh_overrides(spark, path, before))
    _write(rows.select("key", "label", "seq"), path, batch)


def refresh_overrides(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The override table as it is now, or was before a batch: the last label per key."""
    rows = _read(spark, path, "key string, label string, seq long", before)
    return rows.groupBy("key").agg(F.max_by("label", "seq").alias("label"), F.max("seq").alias("seq"))


def register_users(
    batch_df: DataFrame, path: str, batch: int, room: str | None = None, every: int = SNAPSHOT_EVERY
) -> DataFrame:
    """Add the users of a micro-batch that are new, and return all users so far.

    New means not in an earlier batch: a batch that runs again finds its own users new again.
    """
    keys = ([room] if room else []) + ["name"]
    seen = us.first_seen(batch_df, room)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema.fields)
    spark = batch_df.sparkSession
    users = lambda before: _read(spark, path, schema, before).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"))
    _snapshot(spark, path, batch, every, users)
    known = _read(spark, path, schema, batch)
    _write(seen.join(known.select(*keys), keys, "left_anti"), path, batch)
    return users(None)


def _deltas(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    schema = "message_id string, reports bigint, reveals bigint, user_classification string, classified_at bigint"
    return ac.merged_deltas(_read(spark, path, schema, before))


def append_actions(actions: DataFrame, path: str, batch: int, every: int = SNAPSHOT_EVERY) -> None:
    """Add what the actions of a micro-batch change; earlier actions are not read again, their sums are.

    A batch that runs again overwrites what it added.  Batch numbers ascend.
    """
    spark = actions.sparkSession
    _snapshot(spark, path, batch, every, lambda before: _deltas(spark, path, before))
    _write(ac.action_deltas(actions.withColumn("message_id", F.col("message_id").cast("string"))), path, batch)


def refresh_action_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``actions.action_state`` of all actions so far, or of those before a batch: from the last snapshot and the batches since."""
    return ac.state_of(_deltas(spark, path, before))


def save_user_chat(classified: DataFrame, path: str, batch: int, fan: int = saved.FAN) -> None:
    """The texts of a micro-batch that no earlier one has, each with the label of its first message.

    Earlier texts are not read again, digests of them are.  Null texts are not saved.
    """
    rows = curation.keep_first(classified.select("text", "label", "seq").filter("text IS NOT NULL"), ["text"], ["seq"])
    rows = rows.select("text", "label", F.lit("user_chat").alias("extra"), "seq")
    _write(saved.subtract_saved(rows, path, batch, fan), path, batch)


def stream_classify(
    stream: DataFrame,
    settings: ClassifierSettings,
    out: str,
    overrides: str | None = None,
    users: str | None = None,
    checkpoint: str | None = None,
    once: bool = False,
    chat: str | None = None,
) -> StreamingQuery:
    """Classify messages as they arrive and write them under ``out``.

    With ``chat``, new texts and their labels are saved there as user chat.
    With ``overrides`` the override table is read anew for each micro-batch;
    with ``users`` the senders are registered before their messages are
    classified.
    """
    def run(batch_df: DataFrame, batch: int) -> None:
        msgs = ms.with_defaults(ms.valid_messages(batch_df))
        now = settings
        if overrides:
            now = replace(now, overrides=refresh_overrides(batch_df.sparkSession, overrides))
        if users:
            now = replace(now, users=register_users(ms.with_defaults(batch_df), users, batch, settings.room))
        with scratch_scope(batch_df.sparkSession):
            _write(classify(msgs, now), out, batch)
        if chat:
            written = batch_df.sparkSession.read.parquet(f"{out}/batch={batch}")
            save_user_chat(written, chat, batch)

    return sink_messages(stream, run, checkpoint, once)


def stream_overrides(stream: DataFrame, path: str, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Keep the override table up to date from a stream of labelled rows ``(text, label, extra, seq)``."""
    def run(batch_df: DataFrame, batch: int) -> None:
        append_overrides(lb.build_overrides(batch_df), path, batch)

    return sink_messages(stream, run, checkpoint, once)


def stream_active_users(
    stream: DataFrame, path: str, room: str | None = None, checkpoint: str | None = None, once: bool = False
) -> StreamingQuery:
    """Keep the first-seen table up to date."""
    return sink_messages(stream, lambda df, batch: register_users(df, path, batch, room) and None, checkpoint, once)


def stream_action_state(stream: DataFrame, path: str, checkpoint: str | None = None, once: bool = False, every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Keep the state of messages up to date from a stream of actions ``(seq, message_id, kind, value)``."""
    return sink_messages(stream, lambda df, batch: append_actions(df, path, batch, every), checkpoint, once)


def stream_dedupe(stream: DataFrame, key: str = "text", watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Each distinct text once.

    Exact over all time keeps a digest of every text in state; with a watermark,
    state is bounded and texts count as new again after that time.
    """
    if watermark is None:
        return stream.withColumn("_key", tx.digest(F.col(key))).dropDuplicates(["_key"]).drop("_key")
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def stream_stats(stream: DataFrame, by: list[str] = []) -> DataFrame:
    """Live dashboard counters."""
    return evaluation.moderation_stats(stream, by)


def stream_stats_windowed(stream: DataFrame, ts: str = "ts", window: str = "1 hour", watermark: str = "1 hour", by: list[str] = []) -> DataFrame:
    """Dashboard counters per window of event time.

    Rows that come late count in their window as long as it ends less than
    ``watermark`` before the latest instant seen up to the batch before last;
    later ones are dropped, and state is kept no longer.
    """
    placed = stream.withWatermark(ts, watermark).withColumn("window", F.window(ts, window))
    counted = evaluation.moderation_stats(placed, ["window", *by])
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in counted.columns if c != "window"])


def latest_rows(spark: SparkSession, path: str, keys: list[str], before: int | None = None) -> DataFrame:
    """What a table written in update mode says now: each key's row of its last update."""
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def write_table(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Write a stateful stream: appended batches, or in complete and update mode one folder per update."""
    checkpoint = checkpoint or scratch_dir(stream.sparkSession, "stream")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, batch: _write(df, path, batch))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
