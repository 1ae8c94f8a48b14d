"""Logs that grow by bytes: a data source whose offsets are bytes up to the last line feed.

``spark.read.format("growing_log")`` reads what is whole now, ``spark.readStream`` follows: an offset is, for each file,
the place behind its last line feed, so bytes added to a file that was read before are seen, half a line waits for its
end, and nothing is read twice. Finding that place reads a file backwards from its end to the newest line feed; a batch
reads its own bytes in blocks, each line by the task in whose block it begins.

Rows: value, file (its place in the order of names), at (byte at which the line begins). Blank lines are left out. Paths
are what pyarrow's file systems open (local and shared folders, hdfs, s3, gs); files that don't exist are empty; a file
that shrinks is an error. Options: path (a file or a folder), paths (a JSON list of them), suffix, block (bytes of a task;
where that would be more than TASKS tasks, a task has several blocks in a row).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file int, at bigint"
BLOCK, STEP, ROWS = 64 << 20, 1 << 20, 4096
#: So many tasks have blocks of their own; beyond, tasks grow with the bytes up to BLOCK each.
TASKS = 256


def opened(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    local = local_path(path)
    return fs.FileSystem.from_uri(path) if local is None else (fs.LocalFileSystem(), local)


def local_path(path: str) -> str | None:
    """The path in a folder that this machine sees (alone or shared), if it is one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def log_files(options: dict) -> list[str]:
    """All files in order of names; a folder's files without those that begin with a dot or an underscore."""
    from pyarrow import fs

    tops = json.loads(options["paths"]) if "paths" in options else [options["path"]]
    found: list[str] = []
    for top in tops:
        system, at = opened(top)
        info = system.get_file_info(at)
        if info.type == fs.FileType.File:
            found.append(top)
        elif info.type == fs.FileType.Directory:
            prefix = top[: len(top) - len(at)] if top.endswith(at) else ""
            below = system.get_file_info(fs.FileSelector(at))
            found += sorted(prefix + f.path for f in below if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.path.endswith(options.get("suffix", "")))
    return found


def size_of(path: str) -> int:
    system, at = opened(path)
    return max(0, system.get_file_info(at).size or 0)


def whole_until(path: str, since: int = 0) -> int:
    """The place behind the last line feed, which is not before `since`."""
    system, at = opened(path)
    end = size_of(path)
    if end < since:
        raise ValueError(f"{path} shrank to {end} bytes")
    with system.open_input_file(at) as f:
        while end > since:
            begin = max(since, end - STEP)
            f.seek(begin)
            place = f.read(end - begin).rfind(b"\n")
            if place >= 0:
                return begin + place + 1
            end = begin
    return since


class Range(InputPartition):
    """The lines that begin from byte `begin` up to `end` of a file of which `whole` bytes are to be read."""

    def __init__(self, path: str, file: int, begin: int, end: int, first: int, whole: int) -> None:
        self.path, self.file, self.begin, self.end, self.first, self.whole = path, file, begin, end, first, whole


def ranges(path: str, file: int, begin: int, end: int, block: int) -> list[Range]:
    return [Range(path, file, at, min(at + block, end), begin, end) for at in range(begin, end, block)]


def dealt(files: list[tuple[str, int, int, int]], block: int) -> list[Range]:
    """The ranges of all bytes to be read, by path, place of the file, first byte and end."""
    blocks = sum(-(-(end - begin) // block) for _, _, begin, end in files)
    wide = block * max(1, min(-(-blocks // TASKS), BLOCK // block))
    return [r for path, k, begin, end in files for r in ranges(path, k, begin, end, wide)] or [Range("", 0, 0, 0, 0, 0)]


def lines(part: Range) -> Iterator[tuple[bytes, int]]:
    system, at = opened(part.path)
    with system.open_input_file(at) as f:
        # A line begins here if the byte before ends one; else the line is that of an earlier task.
        place = part.begin if part.begin == part.first else part.begin - 1
        f.seek(place)
        held = b""
        skip = place < part.begin
        while place < part.end or held:
            got = f.read(min(STEP, part.whole - place - len(held))) if place + len(held) < part.whole else b""
            held += got
            start = 0
            while (stop := held.find(b"\n", start)) >= 0:
                if skip:
                    skip = False
                elif place + start < part.end:
                    yield held[start:stop], place + start
                else:
                    return
                start = stop + 1
            place, held = place + start, held[start:]
            if not got:
                if held and not skip and place < part.end:
                    yield held, place  # only where a line without an end is to be read
                return
            if place >= part.end and not skip:
                return


def batches(part: Range) -> Iterator:
    import pyarrow as pa

    values: list[str] = []
    places: list[int] = []

    def out() -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([part.file] * n, pa.int32()), pa.array(places, pa.int64())], names=["value", "file", "at"])

    for line, at in lines(part):
        if line.strip():
            values.append(line.decode("utf-8"))
            places.append(at)
        if len(values) >= ROWS:
            yield out()
            values, places = [], []
    if values:
        yield out()


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        block = int(self.options.get("block", BLOCK))
        torn = self.options.get("torn", "ignore") == "ignore"
        return dealt([(path, k, 0, whole_until(path) if torn else size_of(path)) for k, path in enumerate(log_files(self.options))], block)

    def read(self, part: Range) -> Iterator:
        return batches(part) if part.path else iter(())


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for path in log_files(self.options):
            self.known[path] = whole_until(path, self.known.get(path, 0))
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        block = int(self.options.get("block", BLOCK))
        if shrunk := [path for path in before if now.get(path, 0) < before[path]]:
            raise ValueError(f"{shrunk[0]} shrank")
        return dealt([(path, k, before.get(path, 0), now[path]) for k, path in enumerate(sorted(now))], block)

    def read(self, part: Range) -> Iterator:
        return batches(part) if part.path else iter(())

    def commit(self, end: dict) -> None:
        self.known |= json.loads(end["files"])


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema: object) -> LogStream:  # noqa: N802
        return LogStream(self.options)


def read_log(spark: SparkSession, paths: list[str], **options: object) -> DataFrame:
    """value, file, at of all whole lines (torn="keep": also of a last line without end)."""
    spark.dataSource.register(GrowingLog)
    return spark.read.format("growing_log").option("paths", json.dumps(paths)).options(**options).load()


def follow_lines(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The same as a stream of what is added from now on and what is there."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("path", path).options(**options).load()


def append_text(rows: DataFrame, folder: str, suffix: str = ".jsonl") -> None:
    """Adds texts to the ends of files of a folder: rows of writer, seq, text; a file for each writer, in order of seq.

    Written and synced before this returns. A task that runs again first cuts its file back to where it began, so a lost
    executor leaves nothing twice. The folder is one that all executors see as a path.
    """
    import os

    folder = local_path(folder) or folder
    os.makedirs(folder, exist_ok=True)
    began = {name: os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder)}

    def write(parts: Iterator) -> Iterator:
        import pyarrow as pa

        current, f, n = None, None, 0
        for batch in parts:
            for writer, text in zip(batch.column("writer").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if writer != current:
                    if f:
                        f.flush()
                        os.fsync(f.fileno())
                        f.close()
                    name, current = f"{writer}{suffix}", writer
                    f = open(f"{folder}/{name}", "r+b" if os.path.exists(f"{folder}/{name}") else "w+b")
                    f.truncate(began.get(name, 0))
                    f.seek(0, 2)
                n += f.write(text.encode("utf-8"))
        if f:
            f.flush()
            os.fsync(f.fileno())
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["bytes"])

    dealt = rows.repartition("writer").sortWithinPartitions("writer", "seq").select("writer", "text")
    dealt.mapInArrow(write, "bytes long").agg({"bytes": "sum"}).collect()
