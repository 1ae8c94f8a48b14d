"""Scoring a run: from question, label, history and prediction tables to the summary, task, paired and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cluster_key, read_answer
from ..operators import scoring
from ..operators.bootstrap import bootstrap_interval
from ..operators.checks import parity
from ..operators.records import latest
from ..operators.staging import settle

#: What must agree between a direct call and its historical record.
MEDIA_KEYS = ["frames", "audio_sha256", "video_tensor_sha256", "raw_frames_sha256", "input_tokens", "audio_tokens", "video_tokens"]
#: The contrasts that a complete run reports.
CONTRASTS = (("agent", "baseline"), ("agent", "fixed"), ("fixed", "baseline"))


def scored_rows(questions: DataFrame, labels: DataFrame, history: DataFrame, predictions: DataFrame, dataset: str) -> DataFrame:
    """Every planned question with its label, cluster, the methods' answers (and strict answers) and what is correct."""
    rows = questions.select("qid", "task", "ord", "prefix2text", cluster_key(F.col("video_name"), F.col("clip_path")).alias("cluster"))
    options, name = F.col("prefix2text"), F.lit(dataset)

    def answers(df: DataFrame, texts: dict[str, str]) -> DataFrame:
        out = df.join(rows.select("qid", "prefix2text"), "qid")
        for method, text in texts.items():
            out = out.withColumn("_read", read_answer(name, F.col(text), options)).withColumns({method: F.col("_read.answer"), f"{method}_strict": F.col("_read.strict")}).drop("_read")
        return out.drop("prefix2text")

    had = answers(history.select("qid", F.col("model_output").alias("_b")), {"baseline": "_b"}).select("qid", "baseline")
    newest = latest(predictions).where(F.col("qid").isNotNull()).select("qid", "status", F.col("arms")["agent"]["model_output"].alias("_a"), F.col("arms")["fixed"]["model_output"].alias("_f"))
    found = answers(newest, {"agent": "_a", "fixed": "_f"})
    scored = scoring.score_rows(rows.drop("prefix2text"), labels, had, found)
    strict = found.select("qid", F.when(F.col("status") == "ok", F.col("agent_strict")).alias("agent_strict"), F.when(F.col("status") == "ok", F.col("fixed_strict")).alias("fixed_strict"))
    return scored.join(strict, "qid", "left")


def method_table(scored: DataFrame, history: DataFrame, predictions: DataFrame, dataset: str, model: str) -> DataFrame:
    """The summary with costs: a row for each method."""
    arms = scored.where("complete").select("qid").join(latest(predictions).select("qid", F.explode("arms").alias("method", "arm")), "qid")
    costs = scoring.call_costs(arms.select("method", "arm.calls", "arm.decisions"), ["method"])
    seconds = scored.select("qid").join(history.select("qid", F.coalesce("elapsed_seconds", "seconds", F.lit(0.0)).alias("s")), "qid").agg(F.avg("s").alias("baseline_seconds"))  # one row
    errors = predictions.agg(F.count_if(F.col("status") == "error").alias("historical_error_attempts"))  # one row
    logical = F.create_map(*[x for m, n in scoring.LOGICAL_CALLS.items() for x in (F.lit(m), F.lit(n))])
    table = scoring.summary(scored).join(costs.drop("questions"), "method", "left").crossJoin(F.broadcast(seconds)).crossJoin(F.broadcast(errors))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("intermediate_token_limits", "final_token_limits", "tool_fallbacks")}
    mean = F.when(F.col("method") == "baseline", F.col("baseline_seconds")).otherwise(F.col("mean_end_to_end_call_seconds"))
    return table.withColumns({**zero, "mean_end_to_end_call_seconds": mean, "mean_logical_calls": logical[F.col("method")], "dataset": F.lit(dataset), "model": F.lit(model)}).drop("baseline_seconds")


def paired_summary(scored: DataFrame) -> dict:
    """Observed and planned counts; the contrasts, with intervals, only if every question is complete."""
    state = scored.agg(F.count(F.lit(1)).alias("planned"), F.count_if("complete").alias("observed")).first()
    done = state["planned"] == state["observed"]
    out: dict = {"complete": done, "observed": state["observed"], "planned": state["planned"]}
    for a, b in CONTRASTS:
        out[f"{a}_vs_{b}"] = contrast(scored, a, b) if done else None
    return out


def contrast(scored: DataFrame, a: str, b: str) -> dict:
    counts = scoring.paired(scored, a, b).first().asDict()
    if counts["n"]:
        drawn = bootstrap_interval(scoring.cluster_partials(scored, a, b)).first()
        counts |= {"cluster_bootstrap_95pct_pp": [drawn["low"], drawn["high"]], "clusters": drawn["clusters"], "bootstrap_repeats": drawn["bootstrap_repeats"]}
    return counts


def evaluate(questions: DataFrame, labels: DataFrame, history: DataFrame, predictions: DataFrame, dataset: str, model: str) -> dict:
    """All tables of one dataset and model; the scored rows are kept once and serve them all."""
    scored = settle(scored_rows(questions, labels, history, predictions, dataset))
    return {"rows": scored, "methods": method_table(scored, history, predictions, dataset, model), "tasks": scoring.task_breakdown(scored), "pairs": paired_summary(scored)}


def pilot_checks(predictions: DataFrame, history: DataFrame) -> DataFrame:
    """A row for each pilot record: media parity with its historical record, usable requests, final token limits."""
    old = history.select("qid", F.struct(*MEDIA_KEYS, "model_output").alias("old"))
    joined = predictions.join(old, "qid", "left")
    last = lambda m: F.element_at(F.col("arms")[m]["calls"], -1)["reached_token_limit"]
    return joined.select(
        "qid", "status", F.col("old").isNotNull().alias("known"), parity(MEDIA_KEYS, "direct_baseline_check", "old").alias("media_parity"),
        F.col("direct_baseline_check.model_output").eqNullSafe(F.col("old.model_output")).alias("direct_text_identical"), "repeat_matches",
        F.size(F.filter(F.col("arms")["agent"]["decisions"], lambda d: ~d["fallback"])).alias("agent_valid_tool_requests"),
        F.create_map(F.lit("agent"), last("agent"), F.lit("fixed"), last("fixed")).alias("final_token_limit"),
    )


def pilot_gate(predictions: DataFrame, history: DataFrame) -> DataFrame:
    """The checks; fails unless all records are good, alike, with at least one usable request and no cut-off answer."""
    checks = settle(pilot_checks(predictions, history))
    fine = (F.col("status") == "ok") & F.col("known") & F.forall(F.map_values("media_parity"), lambda v: v)
    seen = checks.agg(F.count(F.lit(1)).alias("n"), F.bool_and(fine).alias("fine"), F.sum("agent_valid_tool_requests").alias("used"), F.bool_or(F.exists(F.map_values("final_token_limit"), lambda v: v)).alias("cut")).first()
    if not seen["fine"]:
        raise ValueError("a pilot record failed or its media or tokens differ")
    if seen["n"] < 2 or not seen["used"]:
        raise ValueError("no usable time request in the pilot")
    if seen["cut"]:
        raise ValueError("a final answer was cut off")
    return checks


def evaluate_files(spark: SparkSession, questions: str, labels: str, history: list[str], predictions: str, dataset: str, model: str, digest: str | None = None, count: int | None = None) -> dict:
    """The same from files. The questions must be as many as the dataset has, or `count`, and their file have the digest, if one is given."""
    from ..sources.logs import read_history, read_labels, read_questions, read_records

    rows = read_questions(spark, questions, dataset, digest, count)
    return evaluate(rows, read_labels(spark, labels, dataset), read_history(spark, history), read_records(spark, predictions), dataset, model)
