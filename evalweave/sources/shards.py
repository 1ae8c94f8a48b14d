"""Tensors in shards: files that begin with a header of byte ranges, looked up by key without reading the rest.

A shard is eight bytes that say how long its header is (little-endian), the header (a JSON object from key to dtype, shape
and the two ends of its bytes behind the header), and the bytes. The index is a table made of the headers alone; a
look-up joins the wanted keys with it and reads their ranges, a file's in order of place.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .growing_log import local_path, log_files, opened

INDEX = "key string, file string, first bigint, last bigint, dtype string, shape array<bigint>"
SUFFIX = ".tensors"


def write_shards(rows: DataFrame, folder: str, shards: int) -> None:
    """rows: key, values (array<float>). About equal shards; a task that runs again writes its file anew under the same name.

    A shard's rows are held by its task, so there should be enough shards for that. The folder is one that all executors see.
    """
    import os

    folder = local_path(folder) or folder
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        header, parts, end = {}, [], 0
        for batch in batches:
            column = batch.column("values")
            for key, begin, stop in zip(batch.column("key").to_pylist(), column.offsets.to_pylist(), column.offsets.to_pylist()[1:], strict=False):
                data = np.ascontiguousarray(column.values.slice(begin, stop - begin).to_numpy(zero_copy_only=False), "<f4").tobytes()
                if key in header:
                    raise ValueError(f"{key} repeats")
                header[key] = {"dtype": "F32", "shape": [stop - begin], "data_offsets": [end, end + len(data)]}
                parts.append(data)
                end += len(data)
        if parts:
            name = f"{folder}/shard-{TaskContext.get().partitionId():05d}{SUFFIX}"
            top = json.dumps(header).encode()
            with open(f"{name}.part", "wb") as f:
                f.write(struct.pack("<Q", len(top)) + top + b"".join(parts))
            os.replace(f"{name}.part", name)
        yield pa.RecordBatch.from_arrays([pa.array([end], pa.int64())], names=["bytes"])

    dealt = rows.select(F.col("key").cast("string").alias("key"), F.col("values").cast("array<float>").alias("values")).where("key is not null and values is not null").repartition(shards, "key")
    dealt.mapInArrow(write, "bytes long").agg(F.sum("bytes")).collect()


def shard_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every key with its file and range of bytes in it; reads nothing but headers."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("file").to_pylist():
                system, at = opened(path)
                with system.open_input_file(at) as f:
                    (size,) = struct.unpack("<Q", f.read(8))
                    header = {k: v for k, v in json.loads(f.read(size)).items() if k != "__metadata__"}
                start = 8 + size
                yield pa.RecordBatch.from_pylist([
                    {"key": k, "file": path, "first": start + v["data_offsets"][0], "last": start + v["data_offsets"][1], "dtype": v["dtype"], "shape": v["shape"]} for k, v in header.items()
                ], pa.schema([("key", pa.string()), ("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64()))]))

    files = log_files({"path": folder, "suffix": SUFFIX})
    listed = spark.createDataFrame([(p,) for p in files], "file string").repartition(max(1, len(files)))
    return listed.mapInArrow(read, INDEX)


def look_up(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """key, values, bytes (read for it) of the wanted keys; one that no shard holds is an error."""

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        current, f = None, None
        for batch in batches:
            values, sizes = [], []
            for path, first, last in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "last")), strict=True):
                if path != current:
                    if f:
                        f.close()
                    system, at = opened(path)
                    current, f = path, system.open_input_file(at)
                f.seek(first)
                data = f.read(last - first)
                if len(data) != last - first:
                    raise ValueError(f"{path} ends early")
                values.append(np.frombuffer(data, "<f4"))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values, pa.list_(pa.float32())), pa.array(sizes, pa.int64())], names=["key", "values", "bytes"])
        if f:
            f.close()

    found = wanted.select(F.col("key").cast("string").alias("key")).distinct().join(index, "key", "left")
    held = found.withColumn("file", F.when(F.col("file").isNotNull() & (F.col("dtype") == "F32"), F.col("file")).otherwise(F.raise_error(F.concat(F.lit("no shard holds "), "key")).cast("string")))
    n = max(1, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # By ranges of files and places, so a file that holds most of the wanted keys is read by several tasks.
    dealt = held.repartitionByRange(n, "file", "first").sortWithinPartitions("file", "first")
    return dealt.select("key", "file", "first", "last").mapInArrow(read, "key string, values array<float>, bytes long")
