"""Reading evaluation files: append-only logs, keyed JSON documents, manifests, directories.

Every row of a log gets ``ord``, its place: (file in the order given, block of the file, line in it). Lines end at line
feeds only. While a writer is active the last line may be torn; ``torn="ignore"`` leaves out text behind a file's last
line feed, ``torn="fail"`` reads it like any other line. A complete line that is no JSON always fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.checks import QUESTION_COUNTS, required, stays_inside, unique, valid_options
from .growing_log import read_log
from .large_files import array_entries, array_start, keyed_entries, with_digests

ORD = "struct<file:int,block:bigint,line:bigint>"


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def first_path(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, else the last."""
    return next((p for p in paths if exists(spark, p)), paths[-1])


def ends_torn(spark: SparkSession, path: str) -> bool:
    """Whether a file's last byte is no line feed. In a folder of appends every file is whole."""
    fs, at = _file(spark, path)
    status = fs.getFileStatus(at)
    size = status.getLen()
    if status.isDirectory() or not size:
        return False
    stream = fs.open(at)
    try:
        stream.seek(size - 1)
        return stream.read() != 10
    finally:
        stream.close()


def read_lines(spark: SparkSession, paths: list[str], torn: str = "ignore") -> DataFrame:
    """value, ord of all lines that aren't blank; files that don't exist are empty."""
    if torn not in ("ignore", "fail"):
        raise ValueError(torn)
    parts = []
    for k, path in enumerate(paths):
        if not exists(spark, path):
            continue
        if torn == "ignore" and ends_torn(spark, path):
            # Read by bytes up to the last line feed, in one pass.
            lines, block, line = read_log(spark, [path]), F.col("at"), F.lit(0).cast("long")
        else:
            lines, block, line = spark.read.text(path, lineSep="\n"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        parts.append(lines.select("value", F.struct(F.lit(k).alias("file"), block.alias("block"), line.alias("line")).alias("ord")))
    if not parts:
        return spark.createDataFrame([], f"value string, ord {ORD}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.rlike("value", F.lit(r"(?U)\S")))


def read_records(spark: SparkSession, paths: str | list[str], schema: str = schemas.PREDICTIONS, torn: str = "ignore") -> DataFrame:
    lines = read_lines(spark, [paths] if isinstance(paths, str) else paths, torn)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "ord").select("r.*", "ord")


def read_history(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Good records of all shards; a key in two of them, or twice in one, is an error."""
    return unique(read_records(spark, paths, schemas.HISTORY).where("status = 'ok'"), "qid")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON value: an array of rows, read in blocks by many tasks, or one row."""
    fs, at = _file(spark, path)
    if fs.exists(at) and fs.getFileStatus(at).isFile():
        full = fs.makeQualified(at).toString()
        try:
            start = array_start(full)
        except (OSError, ValueError):  # a store that only Spark reads
            start = None
        if start is not None:
            return array_entries(spark, full, start).select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_keyed(spark: SparkSession, path: str, value: str, key: str = "qid", name: str = "value") -> DataFrame:
    """A file that is one JSON object, of any size: a row for each key."""
    entries = keyed_entries(spark, [path])
    # Values of other types than objects and arrays are read as those of an object of one.
    read = F.from_json(F.concat(F.lit('{"v":'), "json", F.lit("}")), f"v {value}", {"mode": "FAILFAST"})
    return entries.select(F.col("key").alias(key), read["v"].alias(name))


def read_labels(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """qid, label: the two datasets nest their letters differently."""
    if dataset == "joint":
        return read_keyed(spark, path, "struct<correct_prefix:string>").select("qid", F.col("value.correct_prefix").alias("label"))
    return read_keyed(spark, path, "string", name="label")


def read_questions(spark: SparkSession, path: str, dataset: str, digest: str | None = None, count: int | None = None) -> DataFrame:
    """Questions with their checks: digest of the file, number and uniqueness of ids, no label columns, options, paths."""
    from ..operators.checks import reject_label_keys

    if digest is not None:
        found = digests(spark, path).first()["digest"]
        if found != digest:
            raise ValueError(f"digest of {path} is {found}")
    lines = reject_label_keys(read_lines(spark, [path], "fail"), dataset if dataset in ("joint", "avspeaker") else "split")
    rows = lines.select(F.from_json("value", schemas.QUESTIONS, {"mode": "FAILFAST"}).alias("r"), "ord").select("r.*", "ord")
    rows = unique(rows, "qid", QUESTION_COUNTS.get(dataset) if count is None else count)
    good = F.coalesce(stays_inside(F.col("clip_path")), F.lit(True))
    if dataset == "joint":
        good = good & F.coalesce(valid_options(F.col("prefix2text")), F.lit(False))
    return rows.withColumn("qid", required(F.col("qid"), good, "a question's options or path are not valid"))


def digests(spark: SparkSession, path: str, suffix: str = "", without: tuple[str, ...] = ()) -> DataFrame:
    """path, digest (SHA-256) of all files below a path, less those below folders of the names given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    files = reader.load(path).select("path")  # names alone; the content is read in blocks
    kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, without)))) if without else files
    return with_digests(kept)


def file_names(spark: SparkSession, root: str) -> DataFrame:
    """file: names of all files below a root, relative to it."""
    fs, at = _file(spark, root)
    top = fs.makeQualified(at).toUri().getPath()
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(path.alias("path"))
    return files.select(F.split_part("path", F.lit(f"{top}/"), F.lit(2)).alias("file"))


def digest_map(files: DataFrame) -> DataFrame:
    """One row: map from path to digest, sorted by path (a manifest of source files)."""
    return files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "digest")))).alias("digests"))


def read_states(spark: SparkSession, glob: str) -> DataFrame:
    """Status documents that a pattern finds, with the file each comes from."""
    return spark.read.schema(schemas.STATE).json(glob, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
