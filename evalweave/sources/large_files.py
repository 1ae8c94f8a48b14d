"""Files larger than a task's memory: one JSON object read entry by entry, a JSON array in blocks by many tasks, digests in blocks.

Objects and digests are read once from a file's start with a few megabytes of memory, in one task for a file; many files
are read by many tasks. An array is read twice: first each block of bytes tells how many quotes and brackets it has, which
gives the state in which every block begins, then each task reads the rows that begin in its block.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .growing_log import opened, size_of

STEP = 1 << 20
SPACE = " \t\n\r"
BEHIND = frozenset(SPACE + ",}]:")
#: Bytes of a JSON array that a task reads.
BLOCK = 8 << 20
#: Which bytes are signs, which no white space; what may stand behind each sign of an array of objects.
SIGNS = bytes(x in b'"{}[],' for x in range(256))
FILLED = bytes(chr(x) not in SPACE for x in range(256))
BEHIND_SIGN = {"[": "{]", "{": "}", "}": ",]", ",": "{", "]": ""}


class Entries:
    """The entries (key, value as JSON text) of a file that is one JSON object, with memory for the largest entry."""

    def __init__(self, stream, step: int = STEP) -> None:
        self.stream, self.step = stream, step
        self.text, self.at, self.ended = "", 0, False
        self.decode = codecs.getincrementaldecoder("utf-8-sig")().decode
        self.json = json.JSONDecoder()

    def more(self) -> None:
        """Drops what was read and reads on; more at a time the longer an entry is, so that long ones aren't scanned often."""
        self.text, self.at = self.text[self.at :], 0
        data = self.stream.read(max(self.step, len(self.text)))
        self.ended = not data
        self.text += self.decode(bytes(data), self.ended)

    def peek(self) -> str:
        """The next character that isn't white space; none at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in SPACE:
                self.at += 1
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self.more()

    def take(self, expected: str) -> str:
        found = self.peek()
        if not found or found not in expected:
            raise ValueError(f"{found or 'the end'} where one of {expected} was expected")
        self.at += 1
        return found

    def value(self) -> tuple[object, str]:
        """The next value and its text. One that reaches the end of what was read may go on (a number, a string)."""
        self.peek()
        while True:
            try:
                found, end = self.json.raw_decode(self.text, self.at)
                # A number that is cut behind its point or its exponent's sign is a value as well, but not this one.
                if self.ended or self.text[end : end + 1] in BEHIND or len(self.text) > end + 8:
                    text, self.at = self.text[self.at : end], end
                    return found, text
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more()

    def __iter__(self) -> Iterator[tuple[str, str]]:
        self.take("{")
        if self.peek() == "}":
            self.at += 1
        else:
            while True:
                key, _ = self.value()
                if not isinstance(key, str):
                    raise ValueError("a key is no string")
                self.take(":")
                yield key, self.value()[1]
                if self.take(",}") == "}":
                    break
        if self.peek():
            raise ValueError("more than one value in the file")


def keyed_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, key, json: a row for each entry of files that are one JSON object each; a key twice in a file is two rows."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(path: str, rows: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["path", "key", "json"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = opened(path)
                with system.open_input_file(at) as stream:
                    rows, size = [], 0
                    for entry in Entries(stream):
                        rows.append(entry)
                        size += len(entry[1])
                        if len(rows) >= 4096 or size > STEP:
                            yield out(path, rows)
                            rows, size = [], 0
                    if rows:
                        yield out(path, rows)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(read, "path string, key string, json string")


def escaped_at(stream, begin: int) -> bool:
    """Whether the byte at a place stands behind an odd number of backslashes."""
    n, step = 0, 64
    while n < begin:
        size = min(step, begin - n)
        stream.seek(begin - n - size)
        data = bytes(stream.read(size))
        found = size - len(data.rstrip(b"\\"))
        n += found
        if found < size:
            break
        step = min(2 * step, STEP)
    return n % 2 == 1


def escaped_behind(data: bytes, escaped: bool) -> bool:
    """The same for the byte behind some bytes, of which the first is escaped or not."""
    run = len(data) - len(data.rstrip(b"\\"))
    return (run + (escaped and run == len(data))) % 2 == 1


def signs(data: bytes, escaped: bool):
    """Places of quotes, brackets and commas that no backslash stands before, and which of them each is."""
    import numpy as np

    a = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.frombuffer(SIGNS, bool)[a])
    if escaped or b"\\" in data:
        # Backslashes stand in strings only, so it doesn't matter that signs behind them go as well.
        plain = np.maximum.accumulate(np.where(a == 92, -1, np.arange(len(a), dtype=np.int32)))  # the last place up to here without one
        before = np.where(at > 0, plain[at - 1], -1)
        at = at[((at - 1 - before + (escaped & (before < 0))) & 1) == 0]
    return at, a[at]


def depths(kinds, inside: bool):
    """How each sign changes the depth, if the first stands inside a string or not; signs within strings don't."""
    import numpy as np

    free = (np.cumsum(kinds == 34, dtype=np.uint8) + np.uint8(inside)) & 1 == 0  # however often the sum runs over
    change = ((kinds == 123) | (kinds == 91)).astype(np.int8) - ((kinds == 125) | (kinds == 93))
    return change * free, free


def block_totals(path: str, begin: int, end: int) -> tuple[int, int, int]:
    """Quotes of a block, and by how much it changes the depth if it begins outside and inside a string."""
    system, at = opened(path)
    quotes, outside, inside = 0, 0, 0
    with system.open_input_file(at) as stream:
        escaped = escaped_at(stream, begin)
        stream.seek(begin)
        while begin < end and (data := bytes(stream.read(min(STEP, end - begin)))):
            _, kinds = signs(data, escaped)
            changes = [int(depths(kinds, flag)[0].sum()) for flag in (quotes % 2 == 1, quotes % 2 == 0)]
            outside, inside, quotes = outside + changes[0], inside + changes[1], quotes + int((kinds == 34).sum())
            escaped = escaped_behind(data, escaped)
            begin += len(data)
    return quotes, outside, inside


def array_start(path: str) -> int | None:
    """Where the array of a file that is one JSON array in UTF-8 begins; none if it is something else."""
    system, at = opened(path)
    with system.open_input_file(at) as stream:
        place = 0
        while data := bytes(stream.read(max(64, min(STEP, place)))):
            begin = 3 if not place and data[:3] == b"\xef\xbb\xbf" else 0
            if rest := data[begin:].lstrip(SPACE.encode()):
                # Two bytes for a sign are another encoding.
                return place + len(data) - len(rest) if rest[:1] == b"[" and rest[1:2] != b"\0" else None
            place += len(data)
    return None


def array_rows(path: str, begin: int, end: int, first: bool, inside: bool, depth: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each object of an array that begins in a block, whose first byte has this state; whatever isn't an array of objects is an error."""
    import numpy as np

    started, wrong = depth, f"{path} is no JSON array of objects"
    size, length, filled, own = end - begin, 0, 0, 0
    parts, found = [], []
    system, at = opened(path)
    with system.open_input_file(at) as stream:
        escaped = escaped_at(stream, begin)
        stream.seek(begin)
        # On to the end of the block, and to what follows the last sign that is its own.
        while length < size or own and own == sum(len(f[0]) for f in found):
            data = bytes(stream.read(min(STEP, size - length) if length < size else STEP))
            if not data:
                break
            places, kinds = signs(data, escaped)
            change, free = depths(kinds, inside)
            after = depth + np.cumsum(change, dtype=np.int32)
            if (after < 0).any():
                raise ValueError(wrong)
            # Brackets around the array and its objects, and commas between those.
            top = free & (kinds != 34) & np.where(change > 0, after <= 2, after <= 1)
            before = filled + np.cumsum(np.frombuffer(FILLED, bool)[np.frombuffer(data, np.uint8)], dtype=np.int32)
            found.append((places[top] + length, kinds[top], before[places[top]]))
            if len(kinds):
                inside, depth = bool(((kinds == 34).sum() + inside) % 2), int(after[-1])
            escaped, filled, length = escaped_behind(data, escaped), int(before[-1]), length + len(data)
            parts.append(data)
            if length <= size:
                own = sum(len(f[0]) for f in found)
    data = b"".join(parts)
    if started == 0 and (data[:1] != b"[" if first else data[:size].strip(SPACE.encode())):
        raise ValueError(wrong)
    if not own:
        return
    # The last one in the block is followed by one behind it, which belongs to another task, or by the end of the file.
    places, kinds, before = (np.concatenate(x)[: own + 1] for x in zip(*found, strict=True))
    following = np.zeros((256, 256), bool)
    for sign, behind in BEHIND_SIGN.items():
        following[ord(sign), list(behind.encode())] = True
    gaps = (kinds[:-1] != 123) & (before[1:] > before[:-1] + 1)
    if not following[kinds[:-1], kinds[1:]].all() or gaps.any():
        raise ValueError(wrong)
    if own == len(places) and (kinds[-1] != 93 or data[places[-1] + 1 :].strip(SPACE.encode())):
        raise ValueError(wrong)
    opens = np.flatnonzero(kinds[:own] == 123)
    for a, b in zip(places[opens].tolist(), places[opens + 1].tolist(), strict=True):
        yield begin + a, data[a : b + 1]


def array_entries(spark: SparkSession, path: str, start: int = 0, block: int = BLOCK) -> DataFrame:
    """at, json: the objects of a file that from `start` is one JSON array of them, with the byte at which each begins; a task for each block."""
    size = size_of(path)
    n = max(1, -(-(size - start) // block))
    part = lambda k: (path, start + k * block, min(size, start + (k + 1) * block))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("id").to_pylist()
            found = [block_totals(*part(k)) for k in ids]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, *zip(*found, strict=True))], names=["id", "quotes", "outside", "inside"]) if ids else pa.RecordBatch.from_pylist([], pa.schema([(c, pa.int64()) for c in ("id", "quotes", "outside", "inside")]))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())], names=["at", "json"])

        for batch in batches:
            for k, odd, depth in zip(*[batch.column(c).to_pylist() for c in ("id", "odd", "depth")], strict=True):
                rows, held = [], 0
                for row in array_rows(*part(k), k == 0, odd, depth):
                    rows.append(row)
                    held += len(row[1])
                    if len(rows) >= 4096 or held > STEP:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    blocks = spark.range(0, n, 1, n)
    # A row for each block.
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.mapInArrow(count, "id long, quotes long, outside long, inside long")
    quoted = totals.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    states = quoted.select("id", "odd", F.coalesce(F.sum(F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)).alias("depth"))
    return blocks.join(F.broadcast(states), "id").mapInArrow(read, "at long, json string")


def digest_of(path: str, step: int = STEP) -> str:
    found = hashlib.sha256()
    system, at = opened(path)
    with system.open_input_file(at) as stream:
        while data := stream.read(step):
            found.update(data)
    return found.hexdigest()


def with_digests(files: DataFrame, path: str = "path") -> DataFrame:
    """path, digest (SHA-256) of files of any size."""

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([digest_of(p) for p in paths], pa.string())], names=["path", "digest"])

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select(F.col(path).alias("path")).repartition(n, "path").mapInArrow(digest, "path string, digest string")
