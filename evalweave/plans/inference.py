"""Evidence gathering as chained stages over a table of questions, with the model passed in.

A model is ``infer(rows)``: an iterator of pandas frames with qid, clip_path, prompt, stage, start, end, seed to frames
with qid and the fields of a call; it seeds itself with that number before every call. It runs in mapInPandas, so it is loaded once for each task. Each stage's output is kept,
so that no plan asks the model twice: the global call is shared by both arms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.numeric import fixed_center, window_interval
from ..functions.text import note, seek
from ..operators.checks import parity
from ..operators.staging import settle
from .ledger import FIELDS, Infer, Ledger, answered
from .prompts import final_prompt, global_prompt, local_prompt

SEED = 42
#: What must agree between a call and its repeat.
REPEAT_KEYS = ["model_output", "generated_tokens", "audio_sha256", "video_tensor_sha256", "raw_frames_sha256", "input_tokens"]

_MODELS: dict[tuple[str, str], Callable[[], Infer]] = {}


def register_model(dataset: str, model: str, make: Callable[[], Infer]) -> None:
    """Names the maker of an adapter for a dataset and a model."""
    _MODELS[dataset, model] = make


def model_for(dataset: str, model: str) -> Infer:
    return _MODELS[dataset, model]()


def call_model(rows: DataFrame, prompt: Column, stage: str, infer: Infer, start: Column | None = None, end: Column | None = None, ledger: Ledger | None = None) -> DataFrame:
    """qid and call, one struct; an answer without text or without media tokens is an error. With a ledger nothing is asked twice."""
    none = F.lit(None).cast("double")
    asked = rows.select("qid", "clip_path", prompt.alias("prompt"), F.lit(stage).alias("stage"), (none if start is None else start).alias("start"), (none if end is None else end).alias("end"), F.lit(SEED).alias("seed"))
    got = answered(asked, stage, infer, ledger)
    call = F.struct(*FIELDS[1:4], F.lit(stage).alias("stage"), *FIELDS[4:])
    return got.select("qid", call.alias("call"))


def shown(start: Column, end: Column) -> Column:
    """An interval as a list of two numbers in text."""
    return F.concat(F.lit("["), start.cast("string"), F.lit(", "), end.cast("string"), F.lit("]"))


def run_arm(rows: DataFrame, mode: str, infer: Infer, ledger: Ledger | None = None) -> DataFrame:
    """rows: qid, clip_path, question_prompt, duration, global_call. qid, arm (model_output, decisions, calls, ...)."""
    if mode not in ("agent", "fixed"):
        raise ValueError(mode)
    state = rows.select("*", F.array(F.concat(F.lit("Global: "), note(F.col("global_call.model_output")))).alias("seen"), F.array("global_call").alias("calls"), F.array().cast(f"array<{schemas.DECISION}>").alias("decisions"), F.col("global_call.model_output").alias("latest"))
    for i in range(2):
        uniform = fixed_center(F.col("duration"), i)
        chosen = seek(F.col("latest"), F.col("duration"), uniform) if mode == "agent" else F.struct(uniform.alias("center"), F.lit(False).alias("fallback"), F.lit("fixed_uniform_center").alias("reason"))
        state = settle(state.withColumn("_d", chosen).withColumn("_w", window_interval(F.col("_d.center"), F.col("duration"))))
        start, end = F.col("_w.start"), F.col("_w.end")
        prompt = local_prompt(F.col("question_prompt"), F.col("duration"), start, end, F.array_join("seen", "\n"), i == 0)
        answers = call_model(state, prompt, f"{mode}_inspect_{i + 1}", infer, start, end, ledger)
        decision = F.struct("_d.center", "_d.fallback", "_d.reason", F.array(start, end).alias("window"))
        state = state.join(answers, "qid").withColumns({
            "latest": F.col("call.model_output"),
            "seen": F.concat("seen", F.array(F.concat(F.lit("Excerpt "), shown(start, end), F.lit(": "), note(F.col("call.model_output"))))),
            "calls": F.concat("calls", F.array("call")),
            "decisions": F.concat("decisions", F.array(decision)),
        }).drop("call", "_d", "_w")
    answers = call_model(state, final_prompt(F.col("question_prompt"), F.array_join("seen", "\n")), f"{mode}_final", infer, ledger=ledger)
    arm = F.struct(F.col("call.model_output").alias("model_output"), "decisions", F.concat("calls", F.array("call")).alias("calls"), F.lit(4).alias("logical_calls"), F.lit(True).alias("global_call_shared_between_arms"))
    return state.join(answers, "qid").select("qid", arm.alias("arm"))


def run_questions(rows: DataFrame, policy: Column, infer: Infer, repeat_check: bool = False, ledger: Ledger | None = None) -> DataFrame:
    """rows: qid, task, clip_path, question_prompt, duration. Records with both arms, 7 calls for each question.

    repeat_check: also asks the question directly and the global call again, and fails unless the repeat is the same.
    ledger: finished calls of this run, which aren't asked again; a call that fails ends the run.
    """
    opening = global_prompt(F.col("question_prompt"), F.col("duration"), policy)
    first = call_model(rows, opening, "global_plan", infer, ledger=ledger)
    extra = []
    if repeat_check:
        direct = call_model(rows, F.col("question_prompt"), "direct_baseline_check", infer, ledger=ledger).withColumnRenamed("call", "direct_baseline_check")
        again = call_model(rows, opening, "global_repeat", infer, ledger=ledger).withColumnRenamed("call", "again")
        same = parity(REPEAT_KEYS, "call", "again")
        kept = F.when(F.forall(F.map_values("same"), lambda v: v), F.col("same")).otherwise(F.raise_error(F.lit("a repeated call differs")).cast("map<string,boolean>"))
        extra = [direct, first.join(again, "qid").select("qid", same.alias("same")).select("qid", kept.alias("repeat_matches"))]
    begun = rows.join(first.withColumnRenamed("call", "global_call"), "qid")
    arms = [run_arm(begun, mode, infer, ledger).withColumnRenamed("arm", mode) for mode in ("agent", "fixed")]
    out = rows.join(arms[0], "qid").join(arms[1], "qid")
    for e in extra:
        out = out.join(e, "qid")
    more = [c for e in extra for c in e.columns if c != "qid"]
    return out.select("qid", "task", F.lit("ok").alias("status"), F.col("duration").alias("duration_seconds"), F.lit(7).alias("actual_new_calls"), F.create_map(F.lit("agent"), "agent", F.lit("fixed"), "fixed").alias("arms"), *more)
