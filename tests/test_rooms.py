from datetime import datetime, timedelta

from wardline.streaming import rooms
from wardline.streaming import streams as st

SCHEMA = "room string, seq long, ts timestamp, username string"
START = datetime(2024, 1, 1, 12)


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(spark, tmp_path, sent, **options):
    """Each list of rows as one batch, the query started anew for it."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in sent:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        users = rooms.stream_room_users(st.stream_messages(spark, source, spark.read.parquet(source).schema), **options)
        st.write_table(users, out, "update", checkpoint=state, once=True).awaitTermination()
        yield out


def test_users_of_rooms_over_restarts(spark, tmp_path):
    sent = [
        [("r", 5, at(0), "Ann"), ("r", 6, at(1), "ann "), ("s", 7, at(1), "ann"), ("r", 8, at(2), "guest"), ("r", 9, at(2), " "), (None, 1, at(0), "x"), ("r", None, at(0), "y")],
        [("r", 10, at(3), "bob"), ("r", 11, at(3), "ANN")],
        [("r", 2, at(0), "ann"), ("r", 12, at(4), "bob"), ("r", 13, at(4), None)],
    ]
    news = []
    for out in run(spark, tmp_path, sent):
        last = st.latest_rows(spark, out, ["room", "name"])
        news.append(spark.read.parquet(out).count())
    assert sorted((r["room"], r["name"], r["first_seen"], r["active"]) for r in last.collect()) == [
        ("r", "ann", 2, True), ("r", "bob", 10, True), ("s", "ann", 7, True),
    ]
    assert news == [2, 3, 4]  # known users give no rows; one turned out to be earlier


def test_idle_users_are_forgotten(spark, tmp_path):
    sent = [
        [("r", 1, at(0), "ann"), ("r", 2, at(0), "bob")],
        [("r", 3, at(25), "ann")],  # stays: 25 + 30
        [("r", 4, at(50), "cid")],  # the watermark reaches 40: bob is gone
        [("r", 5, at(51), "bob"), ("r", 6, at(52), "dan")],
        [("r", 7, at(89), "eve")],
    ]
    seen = []
    for out in run(spark, tmp_path, sent, idle="30 minutes", watermark="10 minutes"):
        rows = st.latest_rows(spark, out, ["room", "name"]).collect()
        seen.append({r["name"]: (r["first_seen"], r["active"]) for r in rows})
    assert seen[1] == {"ann": (1, True), "bob": (2, True)}
    assert seen[2] == {"ann": (1, True), "bob": (2, False), "cid": (4, True)}
    assert seen[3]["bob"] == (5, True) and seen[3]["ann"] == (1, True)
    assert seen[4]["ann"] == (1, False) and seen[4]["bob"] == (5, True) and seen[4]["cid"] == (4, True)
    gone = spark.read.parquet(out).filter("NOT active").select("name", "at").collect()
    assert sorted((r["name"], r["at"]) for r in gone) == [("ann", at(55)), ("bob", at(30))]
