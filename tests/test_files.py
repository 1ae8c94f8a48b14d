"""Large files read in steps, files put together from parts, writers at once, shards by ranges."""

import hashlib
import io
import json
import random
import threading
import tracemalloc

import pytest
from pyspark.sql import functions as F

from evalweave.sources import large_files, logs, shards, sinks


def made(source, depth=0):
    kind = source.randrange(7 if depth < 3 else 5)
    if kind < 5:
        return [source.randint(-(10**12), 10**12), source.random() * 10 ** source.randint(-20, 20), "".join(source.choice('ab"\\/é\n{}[],:\U0001f600 ') for _ in range(source.randint(0, 30))), None, source.random() < 0.5][kind]
    return [made(source, depth + 1) for _ in range(source.randint(0, 4))] if kind == 5 else {str(i): made(source, depth + 1) for i in range(source.randint(0, 4))}


@pytest.mark.parametrize("step", [1, 3, 64, 1 << 20])
def test_entries_of_any_object_at_any_step(step):
    source = random.Random(step)
    for _ in range(60):
        want = {f"k{i}\"é": made(source) for i in range(source.randint(0, 6))}
        text = json.dumps(want, ensure_ascii=source.random() < 0.5, indent=source.choice([None, 2]))
        got = list(large_files.Entries(io.BytesIO(text.encode()), step))
        assert [k for k, _ in got] == list(want) and {k: json.loads(v) for k, v in got} == want
    for bad in ("", "[1]", "{", '{"a"}', '{"a":1,}', '{"a":1} x', '{"a":1', '{1:2}', '{"a":tru}'):
        with pytest.raises(ValueError):
            list(large_files.Entries(io.BytesIO(bad.encode()), step))


class Repeated(io.RawIOBase):
    """A long JSON object that is made while it is read."""

    def __init__(self, entries, size):
        self.parts = ((b"{" if i == 0 else b",") + f'"k{i}":"{"x" * size}"'.encode() for i in range(entries))
        self.held, self.ended = b"", False

    def read(self, n=-1):
        while len(self.held) < n and not self.ended:
            part = next(self.parts, None)
            self.ended = part is None
            self.held += part or b"}"
        out, self.held = self.held[:n], self.held[n:]
        return out


def test_memory_does_not_grow_with_the_file():
    peaks = []
    for entries in (2_000, 40_000):
        tracemalloc.start()
        assert sum(1 for _ in large_files.Entries(Repeated(entries, 2_000))) == entries
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + (1 << 20) < 32 << 20


def test_files_of_any_size(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"v": 1}, "y": None}))
    got = {r["qid"]: r["value"] for r in logs.read_keyed(spark, str(tmp_path / "a.json"), "struct<v:int>").collect()}
    assert got["x"]["v"] == 1 and got["y"] is None
    (tmp_path / "b.bin").write_bytes(bytes(range(256)) * 20_000)
    want = {str(tmp_path / n): hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.json", "b.bin")}
    found = logs.digests(spark, str(tmp_path)).collect()
    assert {"/" + r["path"].split(":", 1)[-1].lstrip("/"): r["digest"] for r in found} == want
    assert large_files.digest_of(str(tmp_path / "b.bin"), 1000) == want[str(tmp_path / "b.bin")]


def test_two_writers_at_once(spark, tmp_path):
    """One gives its table the name, the others find the same rows there; nothing is left over. Other rows are refused."""
    df = spark.range(2000).withColumn("s", F.concat(F.lit("v"), "id"))
    wrote, failed = [], []

    def write(rows):
        try:
            wrote.append(sinks.write_once(rows, str(tmp_path / "t")))
        except ValueError as e:
            failed.append(str(e))

    threads = [threading.Thread(target=write, args=(df,)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(wrote) == [False, False, False, True] and not failed
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"] and spark.read.parquet(str(tmp_path / "t")).count() == 2000
    write(df.where("id < 1999"))
    assert failed and "something else" in failed[0]


def test_arrays_from_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"é\n{i}") for i in range(500)], "i int, s string").repartition(7)
    sinks.write_json_array(rows, str(tmp_path / "a.json"), ["i"])
    assert json.loads((tmp_path / "a.json").read_text()) == [{"i": i, "s": None if i % 7 == 0 else f"é\n{i}"} for i in range(500)]
    sinks.write_json_array(rows.where("i < 0"), str(tmp_path / "a.json"), ["i"])
    assert json.loads((tmp_path / "a.json").read_text()) == []
    assert {p.name.strip(".").removesuffix(".crc") for p in tmp_path.iterdir()} == {"a.json"}


def array_read(path, block):
    """All objects of an array, block after block, as the tasks read them."""
    size, start, quotes, depth, found = path.stat().st_size, large_files.array_start(str(path)), 0, 0, []
    if start is None:
        raise ValueError("no array")
    for begin in range(start, size, block):
        part = (str(path), begin, min(size, begin + block))
        found += large_files.array_rows(*part, begin == start, quotes % 2 == 1, depth)
        totals = large_files.block_totals(*part)
        quotes, depth = quotes + totals[0], depth + totals[1 + quotes % 2]
    return found


@pytest.mark.parametrize("block", [7, 50, 1 << 20])
def test_arrays_of_any_objects_in_any_blocks(tmp_path, monkeypatch, block):
    """Whole or broken, in whatever blocks and steps: the objects that json finds, or an error where it finds none."""
    source, path, seen = random.Random(block), tmp_path / "a.json", [0, 0]
    for i in range(60):
        rows = [{str(k): made(source) for k in range(source.randint(0, 3))} for _ in range(source.randint(0, 5))]
        text = source.choice(["", " \n", "\ufeff"]) + json.dumps(rows, ensure_ascii=i % 2 == 0, indent=source.choice([None, 1])) + source.choice(["", "\n"])
        if i % 3 == 0:
            at = source.randrange(len(text))
            text = source.choice([text[:at] + text[at + 1 :], text[:at] + source.choice('"{}[],x') + text[at:], text[:at]])
        path.write_text(text, encoding="utf-8")
        try:
            want = json.loads(path.read_text(encoding="utf-8-sig"))
            want = want if isinstance(want, list) and all(isinstance(x, dict) for x in want) else None
        except ValueError:
            want = None
        monkeypatch.setattr(large_files, "STEP", source.choice([13, 1000]))
        try:
            found = array_read(path, block)
            got = [json.loads(x) for _, x in found]
            data = path.read_bytes()
            assert all(data[at : at + len(x)] == x for at, x in found)
        except ValueError:
            got = None
        assert got == want, text
        seen[want is None] += 1
    assert min(seen) > 5


def test_an_array_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text("[\n" + ",\n".join(json.dumps({"i": i, "s": "\\]}\"[{" * 8}) for i in range(300_000)) + "\n]\n")
    read = logs.read_document(spark, str(path), "i long, s string")
    assert read.rdd.getNumPartitions() == -(-path.stat().st_size // (8 << 20)) > 3
    assert read.agg(F.count("*"), F.sum("i"), F.min("s"), F.max("s")).first()[:] == (300_000, 299_999 * 150_000, "\\]}\"[{" * 8, "\\]}\"[{" * 8)
    for text, want in (('[{"i": 1}, {"s": "x"}]', [(1, None), (None, "x")]), ('{"i": 1}', [(1, None)]), (" [ ] ", []), ("", [])):
        path.write_text(text)
        assert [tuple(r) for r in logs.read_document(spark, str(path), "i long, s string").collect()] == want
    for text in ('[{"i": 1}', '[{"i": 1},]', '[{"i": 1}] x', '[{"i": 1} {"i": 2}]', '[{"i": "a"}]', "[1]"):
        path.write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            logs.read_document(spark, str(path), "i long, s string").collect()


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(f"tower.{i}" if i % 2 else f"other.{i}", [float(i)] * (i % 5)) for i in range(100)] + [("none", None)], "key string, values array<double>")
    shards.write_shards(rows, str(tmp_path / "s"), 4)
    index = shards.shard_index(spark, str(tmp_path / "s"))
    assert index.count() == 100 and 1 < index.select("file").distinct().count() <= 4
    wanted = index.where("key like 'tower.%'").select("key")
    got = {r["key"]: (list(r["values"]), r["bytes"]) for r in shards.look_up(wanted.unionByName(wanted), index).collect()}
    assert got == {f"tower.{i}": ([float(i)] * (i % 5), 4 * (i % 5)) for i in range(1, 100, 2)}
    with pytest.raises(Exception, match="no shard holds lost"):
        shards.look_up(spark.createDataFrame([("lost",)], "key string"), index).collect()


def test_paths_that_must_be_there(spark, tmp_path):
    from evalweave.operators import checks

    (tmp_path / "a b").mkdir()
    (tmp_path / "a b/x+y.mp4").write_text("1")
    files = logs.file_names(spark, str(tmp_path))
    assert [r["file"] for r in files.collect()] == ["a b/x+y.mp4"]
    rows = lambda p: spark.createDataFrame([(1, p)], "i int, clip_path string")
    assert checks.existing(rows("./a b/./x+y.mp4"), "clip_path", files).first()["clip_path"] == "./a b/./x+y.mp4"
    with pytest.raises(Exception, match="not there"):
        checks.existing(rows("a b/none.mp4"), "clip_path", files).collect()
    with pytest.raises(Exception, match="leaves its root"):
        checks.existing(rows("a b/../../x"), "clip_path", files).collect()
