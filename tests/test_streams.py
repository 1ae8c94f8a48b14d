"""Logs followed by bytes, keyed state and heartbeats."""


import duckdb
import pytest

from evalweave import queries, stream_queries
from evalweave.sources import growing_log
from evalweave.streaming.heartbeat import Heartbeat, observed
from evalweave.streaming.keyed_state import follow_newest, state_table

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted((r["file"], r["at"], r["value"]) for r in df.collect())


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_lines_are_read_once_in_blocks_of_any_size(spark, tmp_path, block):
    lines = [b"a", b"", b"  ", "é x".encode(), b"b" * 40, b"\r", b"last"]
    (tmp_path / "0.jsonl").write_bytes(b"\n".join(lines) + b"\nhalf a li")
    (tmp_path / "1.jsonl").write_bytes(b"")
    (tmp_path / "2.jsonl").write_bytes(b"one")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    want, at = [], 0
    for line in lines:
        if line.strip():
            want.append((0, at, line.decode()))
        at += len(line) + 1
    assert values(growing_log.read_log(spark, [str(tmp_path)], block=block)) == want
    kept = values(growing_log.read_log(spark, [str(tmp_path), str(tmp_path / "none")], block=block, torn="keep"))
    assert kept == [*want, (0, at, "half a li"), (2, 0, "one")]


def test_bytes_added_to_old_files_are_seen(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    log.mkdir()

    def arrive():
        growing_log.follow_lines(spark, str(log), block=5).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["value"] for r in spark.read.schema(growing_log.SCHEMA).parquet(out).collect())

    (log / "b").write_bytes(b"1\n2\n3")
    assert arrive() == ["1", "2"]
    assert arrive() == ["1", "2"]
    with open(log / "b", "ab") as f:
        f.write(b"3\n4")
    (log / "a").write_bytes(b"new file\n")
    assert arrive() == ["1", "2", "33", "new file"]
    with open(log / "b", "ab") as f:
        f.write(b"\n")
    assert arrive() == ["1", "2", "33", "4", "new file"]
    (log / "b").write_bytes(b"1\n")
    with pytest.raises(Exception, match="shrank"):
        arrive()


def test_an_append_that_runs_again_leaves_nothing_twice(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(0, 1, "a\n"), (0, 2, "b\n"), (1, 1, "c\n")], "writer int, seq long, text string")
    growing_log.append_text(rows, str(tmp_path))
    growing_log.append_text(rows.where("writer = 0"), str(tmp_path))
    assert (tmp_path / "0.jsonl").read_text() == "a\nb\na\nb\n" and (tmp_path / "1.jsonl").read_text() == "c\n"


def test_a_batch_updates_its_own_keys(spark, tmp_path):
    """States of other keys aren't touched, also after a restart; older records don't replace newer ones."""
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    changed = []

    def add(rows):
        spark.createDataFrame(rows, "qid string, ord long, status string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("qid string, ord long, status string").parquet(path)
        q = follow_newest(stream, lambda df, n: changed.append(sorted(r["qid"] for r in df.collect())), checkpoint)
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsUpdated"]

    assert add([(f"q{i}", i, "error") for i in range(50)]) == 50
    assert add([("q3", 100, "ok"), ("q4", 1, "late")]) == 2
    assert changed[-1] == ["q3", "q4"]
    got = {r["qid"]: (r["ord"], r["status"]) for r in state_table(spark, checkpoint).collect()}
    assert len(got) == 50 and got["q3"] == (100, "ok") and got["q4"] == (4, "error")


def test_heartbeat_of_every_batch(spark, tmp_path):
    kept = []
    listener = Heartbeat(kept.append)
    spark.streams.addListener(listener)
    try:
        for k in range(2):
            spark.createDataFrame([(f"q{k}", 10 * k + i, "ok" if i else "error") for i in range(3)], "qid string, ord long, status string").write.mode("append").parquet(str(tmp_path / "log"))
            stream = observed(spark.readStream.schema("qid string, ord long, status string").parquet(str(tmp_path / "log")))
            q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert listener.wait(str(q.runId))
    finally:
        spark.streams.removeListener(listener)
    assert [r[2:8] for r in kept] == [(3, 2, 1, 2, "q0", "ok"), (3, 2, 1, 12, "q1", "ok")]
    assert all(r[9] >= 0 for r in kept)


@pytest.mark.parametrize("name", [n for n, f in queries.QUERIES.items() if f.__module__ == stream_queries.__name__])
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(map(repr, map(tuple, got.select(*at).collect()))) == sorted(map(repr, found.fetchall()))


def test_tasks_of_a_long_log_are_bounded(spark, tmp_path):
    """A log of many small blocks is read by no more tasks than TASKS and one for each file, every line once."""
    for name in "ab":
        (tmp_path / name).write_bytes(b"".join(b"%d\n" % i for i in range(9000)))
    read = growing_log.read_log(spark, [str(tmp_path)], block=64)
    assert read.rdd.getNumPartitions() <= growing_log.TASKS + 2
    assert [r[0] for r in read.groupBy("value").count().where("count != 2").collect()] == [] and read.count() == 18000
    assert growing_log.dealt([("a", 0, 0, 1 << 40)], 64)[0].end == growing_log.BLOCK
