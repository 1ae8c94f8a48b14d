"""The queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention_quality import fit_quality, with_quality
from .common import crc_of_id, table
from .curriculum import curriculum
from .filter_audit import audit
from .fragment_join import ngram_components
from .gru_language import fit_language, with_language
from .iblt_versions import compare_versions
from .main_text import main_text
from .motion_jpeg import read_media, store_media
from .near_dedup import near_components
from .oracles import ORACLES
from .packing import pack
from .ring_shards import ring_shards
from .text_scores import text_scores
from .vector_codes import compress


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(table(spark, sf_dir, "documents"), crc_of_id(F.col("doc_id")) % 7 == 2)


def op3_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary lies; every machine has it under the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    return with_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    network = fit_language(docs.where(~held_out))
    return with_language(docs.select("doc_id", "text"), network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_iblt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents"))


def op11_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = (
    op1_main_text, op2_context_tree, op3_curriculum, op4_ring_shards, op5_attention_quality, op6_motion_jpeg, op7_packing, op8_near_dedup,
    op9_gru_language, op10_iblt_versions, op11_fragment_join, op12_vector_codes, op13_filter_audit,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
