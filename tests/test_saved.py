import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.streaming import saved
from wardline.streaming import streams as st

SCHEMA = "text string, label string, seq long"


def batch_of(path, number, texts):
    """A folder as a batch leaves it."""
    folder = path / f"batch={number}"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"text": texts, "label": ["x"] * len(texts)}), str(folder / "part-0.parquet"))
    (folder / "_SUCCESS").touch()


def files_of(df):
    return [f for f in df.inputFiles() if f.endswith(".parquet")]


def test_files_read_after_300_batches(spark, tmp_path):
    chat = str(tmp_path)
    for number in range(300):
        batch_of(tmp_path, number, [f"text {number} {i}" for i in range(3)])
        saved.merge(spark, chat, number)
    saved.merge(spark, chat, 300)
    assert [p for p in sorted(os.listdir(tmp_path / "_digests")) if "-" in p] == ["0-99", "100-199", "200-299"]

    rows = spark.createDataFrame([("text 7 1", "y", 1), ("text 250 2", "y", 2), ("new", "y", 3)], SCHEMA)
    digests = rows.select(tx.digest(F.col("text")).alias("digest"))
    seen = saved.known(digests, chat, 300)
    prefixes = {bytes(r[0])[0] for r in digests.collect()}
    got = {bytes(r[0]) for r in seen.collect()}
    every = {bytes(r[0]) for r in saved._digests(spark, chat, 0, 300).select("digest").collect()}
    assert len(every) == 900 and got == {d for d in every if d[0] in prefixes}
    # Files of the partitions that the plan reads, not of all: one for a table and prefix.
    scans = seen._jdf.queryExecution().executedPlan().toString()
    assert scans.count("PartitionFilters: [prefix") == 3
    assert len([f for f in files_of(seen) if int(f.split("prefix=")[1].split("/")[0]) in prefixes]) <= 3 * len(prefixes)
    assert not [f for f in files_of(seen) if "batch=" in f]
    st.save_user_chat(rows, chat, 300)
    assert [r["text"] for r in spark.read.parquet(f"{chat}/batch=300").collect()] == ["new"]


def test_saved_once_over_merges_replays_and_empty_batches(spark, tmp_path):
    chat, seen, want = str(tmp_path / "chat"), set(), {}
    sent = [["a", "b"], [], ["b", "c", "c"], ["a"], ["d", None, ""], ["e", "a"], ["", "f"], ["g", "d"], ["h"], ["a", "i"]]
    for number, texts in enumerate(sent):
        rows = spark.createDataFrame([(t, f"l{number}", i) for i, t in enumerate(texts)], SCHEMA)
        for _ in range(2 if number in (2, 4, 9) else 1):  # some run twice, also one that merges
            st.save_user_chat(rows, chat, number, fan=2)
        want.update({t: f"l{number}" for t in texts if t is not None and t not in seen})
        seen |= set(texts)
    found = spark.read.schema("text string, label string").parquet(f"{chat}/batch=*").collect()
    assert sorted((r["text"], r["label"]) for r in found) == sorted(want.items())


def test_a_batch_without_success_is_not_merged(spark, tmp_path):
    batch_of(tmp_path, 0, ["a"])
    batch_of(tmp_path, 1, ["b"])
    os.remove(tmp_path / "batch=1" / "_SUCCESS")
    saved.merge(spark, str(tmp_path), 2, fan=2)
    assert saved._digests(spark, str(tmp_path), 0, 2).count() == 1
