import json
import os

from wardline.sources import history
from wardline.streaming import streams as st


def messages(*ids, **more):
    return [{"id": i, "text": f"text {i}", **more} for i in ids]


def test_rewritten_files_give_each_message_once(spark, tmp_path):
    folder, out, state = tmp_path / "rooms", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def write(name, entries):
        (folder / name).write_text(entries if isinstance(entries, str) else json.dumps(entries), encoding="utf-8")

    def run():
        st.write_table(history.stream_history(spark, str(folder)), out, checkpoint=state, once=True).awaitTermination()
        found = spark.read.parquet(out).collect()
        return sorted((os.path.basename(r["file"]), r["id"], r["text"], r["place"], r["reported"]) for r in found)

    write("a.json", messages("1", "2"))
    write("b.json", "[]")
    write("no.txt", messages("9"))
    assert run() == [("a.json", "1", "text 1", 0, None), ("a.json", "2", "text 2", 1, None)]
    # Rewritten: an older entry changed, new ones, one twice; half written; ids that are numbers or missing.
    write("a.json", messages("1", "2", reported=True) + messages("3", "3", "4"))
    write("b.json", json.dumps(messages("1", "5"))[:-3])
    write("c.json", [{"id": 7, "text": None}, {"text": "no id"}, 3, None, {"id": None}, {"id": "ü", "text": "€\U0001f600"}])
    second = run()
    assert [r[:2] + r[3:] for r in second] == [
        ("a.json", "1", 0, None), ("a.json", "2", 1, None), ("a.json", "3", 2, None), ("a.json", "4", 4, None),
        ("c.json", "7", 0, None), ("c.json", "ü", 5, None),
    ]
    assert second[-1][2] == "€\U0001f600"
    # Whole at last; an array that lost its oldest entries; a file that is gone.
    write("b.json", messages("1", "5"))
    write("a.json", messages("3", "4", "6"))
    os.remove(folder / "c.json")
    third = run()
    assert [r for r in third if r not in second] == [
        ("a.json", "6", "text 6", 2, None), ("b.json", "1", "text 1", 0, None), ("b.json", "5", "text 5", 1, None),
    ]
    assert run() == third


def test_only_changed_files_are_read(tmp_path):
    reader = history._Reader(str(tmp_path))
    assert reader.latestOffset() == {}
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text("[]", encoding="utf-8")
    start = reader.latestOffset()
    (tmp_path / "b.json").write_text('[{"id": 1}]', encoding="utf-8")
    changed = reader.partitions(start, reader.latestOffset())
    assert [os.path.basename(p.file) for p in changed] == ["b.json"]
    assert [b.num_rows for b in reader.read(changed[0])] == [1]
    os.remove(tmp_path / "b.json")
    assert list(reader.read(changed[0])) == []


def test_a_task_reads_many_small_files(spark, tmp_path):
    folder = tmp_path / "rooms"
    folder.mkdir()
    for i in range(300):
        (folder / f"{i}.json").write_text(json.dumps(messages(f"{i}-a", f"{i}-b")), encoding="utf-8")
    reader = history._Reader(str(folder), tasks=8)
    listed = reader.latestOffset()
    tasks = reader.partitions({}, listed)
    assert 8 <= len(tasks) <= 10 and sorted(f for t in tasks for f in t.files) == sorted(listed)
    assert sum(batch.num_rows for t in tasks for batch in reader.read(t)) == 600
    # A large file has a task of its own, and only changed files are read again.
    assert len(history._tasks({"a": 1, "b": history.TASK_BYTES, "c": 1}, 1)) == 3
    first = min(listed)
    assert [t.files for t in reader.partitions({**listed, first: "0/0"}, listed)] == [[first]]
    assert reader.partitions(listed, listed) == []


def test_histories_are_written_as_files_of_one_folder(spark, tmp_path):
    from wardline.bindings import action_queries as aq

    rows = [(None if i == 0 else f"r{i // 2}", i, f"m{i}", "x\ny", "u", False) for i in range(9)]
    sent = spark.createDataFrame(rows, "room string, seq bigint, id string, text string, username string, is_audio boolean")
    path = str(tmp_path / "history")
    aq._write_history(sent, path)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) == len({r[0] for r in rows})
    found = aq.rd.read_messages(spark, path).select("id", "text", "is_audio").collect()
    assert sorted(map(tuple, found)) == [(f"m{i}", "x\ny", False) for i in range(9)]
