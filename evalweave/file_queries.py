"""Queries of readers and writers: each writes stand-in rows to the shared folder and reads them back, with the SQL of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import checks
from .operators.ordering import running_sums
from .operators.staging import settle, shared_dir
from .queries import query, table
from .sources import logs, shards, sinks


def place(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder. What is under it goes when the application ends, as results are read lazily."""
    base = f"{shared_dir(spark).rstrip('/')}/queries-{spark.sparkContext.applicationId}"
    fs, at = logs._file(spark, base)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def one_file(df: DataFrame, path: str, end: str = "\n") -> str:
    """Writes a table of one text column as one file, lines ended by `end`, and says which."""
    sinks.write_lines(df, path, df.columns, df.columns[0], end)
    return path


NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
NATION = "n_nationkey bigint, n_name string, n_regionkey bigint"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log, read as one."""
    path, rows = place(spark, "log"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    sinks.append_records(rows.where("event_id % 2 = 0"), path)
    sinks.append_records(rows.where("event_id % 2 = 1"), path)
    return logs.read_records(spark, path, "event_id bigint, user_id bigint, event_type string, value double").drop("ord")


def whole_log(spark: SparkSession, sf_dir: str, tail: str, end: str) -> str:
    lines = nations(spark, sf_dir).select(F.to_json(F.struct("*")).alias("l"))
    return one_file(lines.agg(F.concat(F.array_join(F.collect_list("l"), "\n\n"), F.lit(tail)).alias("value")), place(spark, "lines"), end)


@query(NATIONS)
def torn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose last line is half written: the line is left out."""
    return logs.read_records(spark, whole_log(spark, sf_dir, '\n{"n_nationkey": 9', "9"), NATION).drop("ord")


@query(NATIONS)
def complete_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log without a last line feed, read by the strict rule."""
    return logs.read_records(spark, [whole_log(spark, sf_dir, "", " "), f"{place(spark, 'none')}/x.jsonl"], NATION, "fail").drop("ord")


@query("SELECT n_name AS qid, n_regionkey AS value FROM nation")
def keyed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nations(spark, sf_dir)
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "n_regionkey")))).alias("value"))
    return logs.read_keyed(spark, one_file(whole, place(spark, "keyed")), "bigint")


@query("SELECT n_name AS qid, CASE WHEN n_regionkey % 2 = 0 THEN 'A' ELSE 'B' END AS label, n_regionkey::VARCHAR AS flat FROM nation")
def label_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of both datasets."""
    rows = nations(spark, sf_dir)
    letter = F.struct(F.when(F.col("n_regionkey") % 2 == 0, "A").otherwise("B").alias("correct_prefix"))
    nested = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", letter)))).alias("value"))
    flat = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("string"))))).alias("value"))
    first = logs.read_labels(spark, one_file(nested, place(spark, "labels")), "joint")
    second = logs.read_labels(spark, one_file(flat, place(spark, "labels")), "avspeaker")
    return first.join(second.select("qid", F.col("label").alias("flat")), "qid")


@query(NATIONS)
def array_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is one JSON array of rows."""
    whole = nations(spark, sf_dir).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    return logs.read_document(spark, one_file(whole, place(spark, "array")), NATION)


@query("""SELECT c_custkey::VARCHAR AS qid, c_name AS model_output FROM customer WHERE c_custkey % 5 <> 4""")
def history_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of good and bad records; only good ones count, and none twice."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("qid"), F.when(F.col("c_custkey") % 5 == 4, "error").otherwise("ok").alias("status"), F.col("c_name").alias("model_output"), "c_custkey")
    paths = [place(spark, "shard") for _ in range(2)]
    for k, path in enumerate(paths):
        sinks.write_json(rows.where(F.col("c_custkey") % 2 == k).drop("c_custkey"), path)
    return logs.read_history(spark, paths).select("qid", "model_output")


@query("SELECT c_custkey::VARCHAR AS qid, c_mktsegment AS task, 'clips/' || c_custkey AS clip_path FROM customer")
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their checks of number, digest, labels, options and paths, by the path that exists."""
    key = F.col("c_custkey").cast("string")
    options = F.create_map(*[x for k in "ABCD" for x in (F.lit(k), F.concat(F.lit(k), key))])
    rows = table(spark, sf_dir, "customer").select(key.alias("qid"), F.col("c_mktsegment").alias("task"), F.concat(F.lit("clips/"), key).alias("clip_path"), options.alias("prefix2text"))
    path = one_file(rows.select(F.to_json(F.struct("*")).alias("value")), place(spark, "questions"))
    digest = logs.digests(spark, path).first()["digest"]
    read = logs.read_questions(spark, logs.first_path(spark, f"{place(spark, 'none')}/q.jsonl", path), "joint", digest, rows.count())
    return read.select("qid", "task", "clip_path")


@query("SELECT n_nationkey::VARCHAR AS name, sha256(n_name || chr(10)) AS digest FROM nation")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the files below a folder, as one map."""
    path = place(spark, "files")
    nations(spark, sf_dir).select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    files = logs.digests(spark, path, ".txt", without=("skipped",))
    found = logs.digest_map(files).select(F.explode("digests").alias("path", "digest"))
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).alias("name"), "digest")


@query("SELECT n_name AS model, n_regionkey::INT AS attempt, 'ok' AS status FROM nation")
def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "states")
    rows = nations(spark, sf_dir).select(F.col("n_name").alias("model"), F.col("n_regionkey").alias("attempt"), F.lit("ok").alias("status"), "n_nationkey")
    rows.select("n_nationkey", F.to_json(F.struct("model", "attempt", "status")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return logs.read_states(spark, f"{path}/*/*.txt").select("model", "attempt", "status")


@query("SELECT o_orderkey, o_custkey, o_totalprice, false AS again FROM orders")
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written, checked against itself, and read."""
    path, rows = place(spark, "once"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    if not sinks.write_once(rows, path):
        raise ValueError("nothing was written")
    return spark.read.parquet(path).withColumn("again", F.lit(sinks.write_once(rows, path)))


@query("""SELECT n_name AS dataset, 'm' AS model, 'agent' AS method, rpad(left(n_name, 10), 10, ' ') || ' ' || rpad('m', 10, ' ') || ' ' || rpad('agent', 8, ' ') || ' ' || lpad(n_nationkey::VARCHAR, 4, ' ') || '/25 correct='
|| lpad(n_regionkey::VARCHAR, 4, ' ') || ' accuracy=' || CASE WHEN n_nationkey = 0 THEN 'pending' ELSE (n_regionkey / 2::DOUBLE)::VARCHAR END || ' complete=' || CASE WHEN n_nationkey = 24 THEN 'True' ELSE 'False' END AS line FROM nation""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracy = F.when(F.col("n_nationkey") != 0, F.col("n_regionkey") / F.lit(2.0))
    rows = nations(spark, sf_dir).select(
        F.col("n_name").alias("dataset"), F.lit("m").alias("model"), F.lit("agent").alias("method"), F.col("n_nationkey").alias("observed_n"), F.lit(25).alias("planned_n"),
        F.col("n_regionkey").alias("correct"), accuracy.alias("accuracy_observed_pct"), (F.col("n_nationkey") == 24).alias("complete"),
    )
    return sinks.report_lines(rows)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is one JSON array of rows in order, put together from the parts of many tasks, read as text and as a document."""
    path = place(spark, "array")
    sinks.write_json_array(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, ["o_orderkey"])
    lines = logs.read_log(spark, [path], block=1 << 20).where("value not in ('[', ']')")
    rows = lines.select("at", F.from_json(F.rtrim(F.col("value"), F.lit(",")), "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string", {"mode": "FAILFAST"}).alias("r"))
    if logs.read_document(spark, path, "o_orderkey bigint").count() != rows.count():
        raise ValueError("the array has other rows")
    ranked = running_sums(rows.select("r.*", "at"), ["at"], {"place": F.lit(1).cast("long")})
    return ranked.drop("at").withColumn("place", F.col("place") - 1)


@query("SELECT vec_id::VARCHAR AS key, len(embedding)::INT AS size, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, 4 * len(embedding)::BIGINT AS bytes FROM embeddings WHERE label = 3")
def shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted vectors out of shards of all, by the ranges that the shards' headers tell: only their bytes are read."""
    path, rows = place(spark, "shards"), table(spark, sf_dir, "embeddings")
    shards.write_shards(rows.select(F.col("vec_id").alias("key"), F.col("embedding").alias("values")), path, 8)
    found = shards.look_up(rows.where("label = 3").select(F.col("vec_id").alias("key")), shards.shard_index(spark, path))
    return found.select("key", F.size("values").alias("size"), F.get("values", F.lit(0)).cast("double").alias("first"), F.element_at("values", -1).cast("double").alias("last"), "bytes")


@query("SELECT c_custkey::VARCHAR AS qid, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def large_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object with an entry for every row, read entry by entry."""
    path = place(spark, "object")
    entry = F.concat(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("k"))), F.lit(""), F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("v"))))
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(F.regexp_replace(entry, r'^\{"k":', ""), r'\}\{"v":(.*)\}$', ": $1").alias("value"))
    sinks.write_lines(lines, path, ["c_custkey"], "value", ",\n", "{", "}", between=True)
    return logs.read_keyed(spark, path, "struct<name:string,balance:double,segment:string>").select("qid", "value.*")


@query("SELECT n_nationkey, 'n_nationkey=' || n_nationkey || '/clip.txt' AS clip_path FROM nation")
def existing_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that stay inside a root and name files there."""
    root, rows = place(spark, "clips"), nations(spark, sf_dir)
    made = rows.select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey")
    made.write.partitionBy("n_nationkey").text(root)
    name = F.regexp_extract(F.input_file_name(), r"[^/]*$", 0)
    names = spark.read.text(root).select("n_nationkey", name.alias("file"))
    asked = names.select("n_nationkey", F.concat(F.lit("n_nationkey="), "n_nationkey", F.lit("/./"), "file").alias("clip_path"))
    found = checks.existing(asked, "clip_path", logs.file_names(spark, root))
    return found.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.regexp_replace(F.regexp_replace("clip_path", r"/\./", "/"), r"[^/]+$", "clip.txt").alias("clip_path"))


@query("SELECT p_partkey, p_name FROM part")
def settled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intermediate table in the shared folder."""
    return settle(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
