"""Writing results: tables, single documents, logs that grow, reports, bundles."""

from __future__ import annotations

import json
import os
import tarfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import same_rows


def write_document(path: str, value: object, atomic: bool = True) -> None:
    """One JSON document on the driver; atomic: under another name first, so that a reader never sees half of it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(value, ensure_ascii=False, indent=2) + "\n"
    if not atomic:
        target.write_text(text, encoding="utf-8")
        return
    part = target.with_name(target.name + ".tmp")
    part.write_text(text, encoding="utf-8")
    os.replace(part, target)


def write_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines; Spark's committer shows it whole or not at all."""
    df.write.mode("overwrite").json(path)


def append_records(df: DataFrame, path: str) -> None:
    """More records to a log: a new file each time, durable before this returns."""
    df.write.mode("append").json(path)


def published(spark: SparkSession, attempt: str, path: str) -> bool:
    """Gives a finished file or folder its name, unless something has it. Whether it has it now."""
    from py4j.protocol import Py4JJavaError

    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in (attempt, path)]
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at[1].toUri() if "://" in path else jvm.java.net.URI("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(*at, never_over)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception) or "not empty" in str(e.java_exception):
            return False
        raise
    return True


def write_once(df: DataFrame, path: str) -> bool:
    """Writes a table, or checks that what is there is the same. Whether it wrote.

    A writer works under a name of its own and renames at its end, which only one can; any other checks its rows against
    that one's.
    """
    from .logs import _file, exists

    spark = df.sparkSession
    if not exists(spark, path):
        attempt = f"{path}.attempt-{uuid.uuid4().hex}"
        df.write.parquet(attempt)
        if published(spark, attempt, path):
            return True
        fs, at = _file(spark, attempt)
        fs.delete(at, True)
    if not same_rows(df, spark.read.parquet(path).select(*df.columns)):
        raise ValueError(f"{path} holds something else")
    return False


def joined_parts(spark: SparkSession, parts: str, path: str, head: str = "", tail: str = "", drop: int = 0) -> None:
    """One file of the part files of a folder in order of their names, between head and tail; it appears whole, over any before.

    The bytes go through in blocks. drop: bytes to leave out at the end of the last part (what separates parts).
    """
    from .logs import _file

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, folder = _file(spark, parts)
    attempt = f"{path}.attempt-{uuid.uuid4().hex}"
    out_fs, out_at = _file(spark, attempt)
    found = sorted((str(f.getPath()), f.getLen()) for f in fs.listStatus(folder) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._")
    out = out_fs.create(out_at, False)
    try:
        out.write(bytearray(head.encode()))
        for k, (name, size) in enumerate(found):
            source = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - drop * (k == len(found) - 1))
            finally:
                source.close()
        out.write(bytearray(tail.encode()))
        out.hsync()
    finally:
        out.close()
    _, target = _file(spark, path)
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if "://" in path else jvm.java.net.URI("file:///"), conf).rename(out_at, target, over)


def write_lines(df: DataFrame, path: str, order: list[str], line: str = "value", end: str = "\n", head: str = "", tail: str = "", between: bool = False) -> None:
    """One text file of the lines of a table in order. between: the end stands between lines only."""
    from .logs import _file

    parts = f"{path}.parts-{uuid.uuid4().hex}"
    df.orderBy(*order).select(F.col(line).alias("value")).write.option("lineSep", end).text(parts)
    joined_parts(df.sparkSession, parts, path, head, tail, len(end.encode()) if between else 0)
    fs, at = _file(df.sparkSession, parts)
    fs.delete(at, True)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One file that is a JSON array of a table's rows in order, written by many tasks and put together from their parts."""
    rows = df.select(*order, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_json"))
    write_lines(rows, path, order, "_json", ",\n", "[\n", "\n]\n", between=True)


def report_lines(table: DataFrame) -> DataFrame:
    """A line of fixed width for each dataset, model and method."""
    value = F.coalesce(F.col("accuracy_observed_pct").cast("string"), F.lit("pending"))
    line = F.concat(
        F.rpad("dataset", 10, " "), F.lit(" "), F.rpad("model", 10, " "), F.lit(" "), F.rpad("method", 8, " "), F.lit(" "),
        F.lpad(F.col("observed_n").cast("string"), 4, " "), F.lit("/"), F.col("planned_n").cast("string"), F.lit(" correct="), F.lpad(F.col("correct").cast("string"), 4, " "),
        F.lit(" accuracy="), value, F.lit(" complete="), F.initcap(F.col("complete").cast("string")),
    )
    return table.select("dataset", "model", "method", line.alias("line"))


def write_report(table: DataFrame, pairs: dict[str, dict], path: str, head: list[str] = []) -> None:  # noqa: B006
    """The report as text; paired lines only once every row is complete. The table has a row for each method."""
    lines = [*head, *[r["line"] for r in report_lines(table).orderBy("dataset", "model", "method").collect()]]
    if table.where("not complete").isEmpty():
        lines += [f"{key}: {json.dumps(value, ensure_ascii=False)}" for key, value in pairs.items()]
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text("\n".join(lines) + "\n", encoding="utf-8")


def bundle(folder: str, target: str) -> list[str]:
    """A compressed archive of a run's files without archives and locks."""
    top = Path(folder)
    files = [p for p in sorted(top.rglob("*")) if p.is_file() and p.suffix not in (".gz", ".lock")]
    with tarfile.open(target, "w:gz") as archive:
        for p in files:
            archive.add(p, arcname=str(p.relative_to(top)))
    return [str(p.relative_to(top)) for p in files]


def launch_record(path: str, commit: str) -> dict:
    record = {"pid": os.getpid(), "time": time.time(), "commit": commit}
    write_document(path, record)
    return record
