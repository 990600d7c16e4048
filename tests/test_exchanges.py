from datetime import datetime, timedelta

from tessera.streaming import exchanges, messages

DAY = datetime(2024, 5, 1)


def at(minutes):
    return DAY + timedelta(minutes=minutes)


class Feed:
    """A folder to which files are added between runs of one query."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder))

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(str(self.folder))


def test_requests_are_answered_once_late_rows_are_dropped(spark, tmp_path):
    asked, answers = Feed(spark, tmp_path / "q", "id long, who string, asked timestamp"), Feed(spark, tmp_path / "a", "who string, answered timestamp, status int")

    def run():
        out = exchanges.answered_in_time(asked.stream(), answers.stream(), "who", "asked", "answered", "status", "10 MINUTES", "1 hour")
        messages.stored_once(out, f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted(((r.id, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)

    asked.add([(1, "a", at(0)), (2, "b", at(0)), (3, "a", at(100))])
    answers.add([("a", at(5), 0), ("a", at(10), 1), ("b", at(11), 7), ("c", at(100), 9)])
    # the watermark is at minute 40: what no answer can meet any more has timed out
    assert run() == [(1, 0), (1, 1), (2, 529)]
    # request 3 waits for the answers of the next batch; those of minute 2 come too late and are dropped, so nothing is answered twice
    asked.add([(4, "b", at(2)), (5, "d", at(300))])
    answers.add([("a", at(109), 4), ("b", at(3), 5), ("d", at(300), None), ("x", at(400), 0)])
    want = [(1, 0), (1, 1), (2, 529), (3, 4), (5, None)]
    assert sorted(map(str, run())) == sorted(map(str, want)) and sorted(map(str, run())) == sorted(map(str, want))


def test_the_same_rows_as_batches(spark):
    asked = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(0)), (3, None, at(1)), (4, "a", None)], "id long, who string, asked timestamp")
    answers = spark.createDataFrame([("a", at(10), None), ("b", at(11), 3), (None, at(1), 4), ("b", at(0) - timedelta(microseconds=1), 5)], "who string, answered timestamp, status int")
    out = exchanges.answered_in_time(asked, answers, "who", "asked", "answered", "status", "10 MINUTES")
    assert sorted((r.id, str(r.status)) for r in out.collect()) == [(1, "None"), (2, "529"), (3, "529"), (4, "529")]


def test_messages_end_by_their_last_part_or_on_time(spark, tmp_path):
    feed = Feed(spark, tmp_path / "p", "who string, seq long, piece string, last boolean, at timestamp")

    def run():
        out = exchanges.assembled_until_idle(feed.stream(), "who", "seq", "piece", "last", "at", 600)
        with exchanges.rocksdb_state(spark):
            messages.stored_once(out, f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted((r.association, r.message, r.parts, r.data, r.complete) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    feed.add([("a", 1, "A", False, at(0)), ("a", 2, None, False, at(1)), ("b", 1, "whole", True, at(1)), ("b", 3, "two", True, at(2)), ("b", 2, "one ", False, at(2))])
    first = [("b", 0, 1, "whole", True), ("b", 1, 2, "one two", True)]
    assert run() == first
    # a part at minute 9 moves the end of a from 11 to 19, so minute 15 does not end it
    feed.add([("a", 3, "B", False, at(9)), ("c", 1, "x", False, at(15))])
    assert run() == first
    feed.add([("a", 4, "C", True, at(16))])
    second = sorted([*first, ("a", 0, 4, "ABC", True)])
    assert run() == second
    # the watermark passes 25: c held a part and is given up, the states of a and b go without a row
    feed.add([("d", 1, "z", True, at(60))])
    third = sorted([*second, ("c", 0, 1, "x", False), ("d", 0, 1, "z", True)])
    assert run() == third
    # who comes back is numbered from 0
    feed.add([("a", 9, "again", True, at(61)), ("d", 2, "more", True, at(61))])
    assert run() == sorted([*third, ("a", 0, 1, "again", True), ("d", 1, 1, "more", True)])


def test_many_parts_over_many_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "p", "who long, seq long, piece string, last boolean, at timestamp")
    for k in range(4):
        feed.add([(w, 100 * k + j, f"{k}.{j};", k == 3 and j == 99, at(k)) for w in range(3) for j in range(100)])
    out = exchanges.assembled_until_idle(feed.stream(), "who", "seq", "piece", "last", "at", 3600)
    with exchanges.rocksdb_state(spark):
        stored = messages.run_available(out, str(tmp_path))
    whole = "".join(f"{k}.{j};" for k in range(4) for j in range(100))
    assert sorted((r.association, r.parts, r.data) for r in stored.collect()) == [(w, 400, whole) for w in range(3)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != exchanges.ROCKSDB
