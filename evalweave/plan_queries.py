"""Queries of the chained stages: a stand-in model answers every document's question, a run is broken off and goes on, the pilot's gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .file_queries import place
from .plans.evaluation import MEDIA_KEYS, pilot_gate
from .plans.inference import run_questions
from .plans.ledger import Ledger
from .plans.prompts import audio_policy
from .queries import query, questions

BROKEN_AT = "agent_inspect_2"


def model(fails: bool):
    """Answers from the question's number: where to look, and a letter. fails: breaks down in the agent's second look."""

    def answer(qid: int, stage: str) -> str:
        if stage.endswith("final") or stage == "direct_baseline_check":
            return "ABCD"[(qid + (stage == "fixed_final")) % 4]
        return f"SEEK={qid % 40}.5\nSomething is seen." if qid % 3 else "Nothing to look for."

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            stages, ids = rows["stage"].tolist(), [int(q) for q in rows["qid"]]
            if fails and BROKEN_AT in stages:
                raise RuntimeError("broken off")
            yield pd.DataFrame({
                "qid": rows["qid"], "model_output": list(map(answer, ids, stages)), "generated_tokens": 5, "reached_token_limit": False, "input_tokens": [i % 97 for i in ids], "audio_tokens": 2, "video_tokens": 3,
                "seconds": 0.25, "audio_sha256": "a", "video_tensor_sha256": "v", "raw_frames_sha256": "r",
            })

    return infer


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(F.lit("Options.\nQuestion: what is "), "task", F.lit("?"))
    return questions(spark, sf_dir).select(F.col("qid").cast("string").alias("qid"), "task", F.concat(F.lit("c/"), "qid", F.lit("_1_2.mp4")).alias("clip_path"), prompt.alias("question_prompt"), F.lit(30.0).alias("duration"))


def policy() -> Column:
    return audio_policy(F.lit("joint"), F.lit("omni"))


def resumed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Ledger]:
    """A run that breaks off after the agent's first look and goes on with the same ledger."""
    rows, ledger = asked(spark, sf_dir), Ledger(spark, place(spark, "ledger"))
    try:
        run_questions(rows, policy(), model(True), ledger=ledger)
    except ValueError as e:
        if "broken off" not in str(e):
            raise
    else:
        if not rows.isEmpty():
            raise ValueError("the run didn't break off")
    return run_questions(rows, policy(), model(False), ledger=ledger), ledger


CENTER = "CASE WHEN doc_id % 3 > 0 AND doc_id % 40 + 0.5 <= 30 THEN doc_id % 40 + 0.5 ELSE {} END::DOUBLE"


@query(f"""SELECT doc_id::VARCHAR AS qid, lang AS task, chr(65 + (doc_id % 4)::INT) AS agent, chr(65 + ((doc_id + 1) % 4)::INT) AS fixed, {CENTER.format(10)} AS first_center, {CENTER.format(20)} AS second_center,
CASE WHEN doc_id % 3 > 0 AND doc_id % 40 + 0.5 <= 30 THEN 0 ELSE 2 END::INT AS fallbacks, 8::BIGINT AS logical, 1.0::DOUBLE AS seconds FROM documents""")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms' answers and looks of every question, after a run that broke off and went on."""
    out, _ = resumed(spark, sf_dir)
    agent, fixed = F.col("arms")["agent"], F.col("arms")["fixed"]
    return out.select(
        "qid", "task", agent["model_output"].alias("agent"), fixed["model_output"].alias("fixed"), agent["decisions"][0]["center"].alias("first_center"), agent["decisions"][1]["center"].alias("second_center"),
        F.size(F.filter(agent["decisions"], lambda d: d["fallback"])).alias("fallbacks"), (F.size(agent["calls"]) + F.size(fixed["calls"])).cast("long").alias("logical"),
        F.aggregate(agent["calls"], F.lit(0.0), lambda s, c: s + c["seconds"]).alias("seconds"),
    )


@query("""SELECT stage, count(*) AS calls, count(DISTINCT doc_id) AS questions, 0::BIGINT AS failed FROM documents, (SELECT unnest(['global_plan', 'agent_inspect_1', 'agent_inspect_2', 'agent_final', 'fixed_inspect_1', 'fixed_inspect_2', 'fixed_final']) AS stage) GROUP BY stage""")
def ledger_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each stage was asked in all: once for a question, whatever was broken off."""
    _, ledger = resumed(spark, sf_dir)
    rows = spark.read.schema("qid string, error string, stage string").parquet(ledger.path)
    good = rows.where("error is null")
    return good.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("qid").alias("questions"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query("""SELECT doc_id::VARCHAR AS qid, CASE WHEN doc_id % 3 > 0 AND doc_id % 40 + 0.5 <= 30 THEN 2 ELSE 0 END::INT AS used, true AS direct_text_identical, 6::BIGINT AS repeats, true AS parity, false AS cut FROM documents""")
def pilot_gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pilot: direct and repeated calls beside the arms, against a history of the same calls, through the gate."""
    out = run_questions(asked(spark, sf_dir), policy(), model(False), repeat_check=True)
    call = F.col("direct_baseline_check")
    # The stand-in model's calls have no number of frames.
    framed = out.withColumn("direct_baseline_check", F.struct(F.lit(8).alias("frames"), *[call[k].alias(k) for k in [*MEDIA_KEYS[1:], "model_output"]]))
    checks = pilot_gate(framed, framed.select("qid", "direct_baseline_check.*"))
    return checks.select(
        "qid", F.col("agent_valid_tool_requests").alias("used"), "direct_text_identical", F.size("repeat_matches").cast("long").alias("repeats"),
        F.forall(F.map_values("media_parity"), lambda v: v).alias("parity"), F.exists(F.map_values("final_token_limit"), lambda v: v).alias("cut"),
    )
