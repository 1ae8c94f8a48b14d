"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A network, an attention model and repeated documents
are beyond SQL, so ORACLE_SQL is None; tests/llm compares run() with a brute-force version on a small corpus.

For all stages: null and empty texts are as the stage says; very long texts are read whole; rows that repeat, and null
ids, are rows like any others but in near_dedup; an empty table gives an empty one; columns besides those of documents
are dropped, whatever their names. No order of the input matters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.attention_quality import fit_quality, with_quality
from evalweave.llm.common import ensure_checkpoint_dir, settle, table
from evalweave.llm.curriculum import curriculum
from evalweave.llm.gru_language import fit_language, with_language
from evalweave.llm.near_dedup import near_components
from evalweave.llm.packing import pack
from evalweave.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No language that holds half of a text: rejected. Quality as in the operator's query.
LEAST_LANGUAGE, LEAST_QUALITY = 0.5, 0.3
#: Ids of dropped documents are broadcast up to this number (8 MB), and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (so null and empty texts) and those of no clear language; names the language where it is null.

    Ties between languages go to the first name.
    """
    found = with_language(docs.select(*COLUMNS), fit_language(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, learnt from the labels of documents that got here, scores low.

    Null and empty texts have a score too; a score equal to the least one stays. Without labels all stay.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs.select(*COLUMNS), model).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row for each id, which near_components takes for one document, and for each text without an id: the least by columns."""
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    keyed = docs.select(*COLUMNS).withColumn("key", key)
    repeated = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"))
    of = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS // 10 else repeated
    least = keyed.join(of, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return keyed.join(of, "key", "left_anti").select(*COLUMNS).unionByName(least)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates, as one row.

    Of rows that repeat an id, with equal or different texts, one stays (the least by columns); of equal texts without
    an id, one. Null and empty texts resemble nothing.
    """
    dropped = settle(near_components(docs, width=5, percent=80).where(~F.col("kept")).select("doc_id").distinct())
    few = dropped.count() <= BROADCAST_IDS
    kept = docs.select(*COLUMNS).join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")
    return one_of_each(kept).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to their sources' targets, a row that is taken twice twice, in training order.

    The curriculum knows a row by the digest of its columns: equal rows are copies with positions of their own, and
    rows that share only an id are rows of their own. Rows without words are not taken. Ties of position go by id.
    """
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in COLUMNS]))
    rows = docs.select(*COLUMNS).withColumn("row", digest)
    taken = curriculum(rows.select(F.col("row").alias("doc_id"), "text", "source")).where(F.col("taken") > 0).select(F.col("doc_id").alias("row"), F.explode("positions").alias("position"))
    placed = rows.dropDuplicates(["row"]).join(taken, "row")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(n, "position", "doc_id").sortWithinPartitions("position", "doc_id").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place; null and empty texts are an end id. Ties go by id and piece."""
    return pack(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is kept as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
