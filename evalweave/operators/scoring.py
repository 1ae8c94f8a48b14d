"""Scores: joining answers to labels, accuracies, costs, paired differences and roll-ups.

A scored row has qid, task, cluster, label, complete, and for each method an answer and whether it is correct. The
baseline is scored on all planned rows, the other methods on complete ones only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent, percent_required, round_decimals

METHODS = ("baseline", "fixed", "agent")
#: Logical calls of a method for a question.
LOGICAL_CALLS = {"baseline": 1, "fixed": 4, "agent": 4}
#: Task codes, and the numbers under which another file lists them.
TASKS = ("STL", "SPL", "SOOG", "SOER", "SPER", "MPTI", "VSSR", "CSA", "MPO", "PTG", "AFA", "PDP", "AVDM", "MESI", "CRI")
TASK_NUMBERS = (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17)


def task_code(task: Column) -> Column:
    """A task's code; a name that is no alias stays."""
    aliases = F.create_map(*[F.lit(x) for n, code in zip(TASK_NUMBERS, TASKS, strict=True) for x in (f"task{n}", code)])
    return F.coalesce(F.try_element_at(aliases, task), task)


def agrees(answer: Column, label: Column) -> Column:
    """Equality in which no answer is a wrong one."""
    return F.coalesce(answer == label, F.lit(False))


def must_join(rows: DataFrame, other: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """Left join in which every row must find its value."""
    joined = rows.join(other, key, "left")
    kind = other.schema[value].dataType
    return joined.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.raise_error(F.lit(f"{what} missing")).cast(kind)))


def truth_labels(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, label: the letter of the correct option; every row must have a truth that fits its task and options."""
    t = truth.select("qid", task_code(F.col("task")).alias("true_task"), "options", "correct_answer", "answer_label")
    letters = F.map_keys(F.map_filter("prefix2text", lambda k, v: v == F.col("correct_answer")))
    named = F.get(F.col("options"), F.ascii(F.upper(F.trim("answer_label"))) - 65)
    fits = (
        (F.col("true_task") == F.col("task"))
        & (F.size("options") == 4)
        & (F.array_sort("options") == F.array_sort(F.map_values("prefix2text")))
        & F.array_contains("options", F.col("correct_answer"))
        & (F.col("answer_label").isNull() | (F.trim("answer_label") == "") | (named == F.col("correct_answer")))
    )
    label = F.when(F.coalesce(fits, F.lit(False)), F.get(letters, F.lit(0))).otherwise(F.raise_error(F.lit("truth missing or not fitting")).cast("string"))
    return rows.join(t, "qid", "left").select("qid", label.alias("label"))


def score_rows(rows: DataFrame, labels: DataFrame, history: DataFrame, newest: DataFrame) -> DataFrame:
    """rows: qid, task, cluster. labels: qid, label. history: qid, baseline. newest: qid, status, agent, fixed.

    Labels and historical answers must be there; newest records may be missing.
    """
    found = must_join(rows, labels.select("qid", "label"), "qid", "label", "label")
    had = history.select("qid", F.struct("baseline").alias("_old"))
    found = must_join(found, had, "qid", "_old", "historical record").withColumn("baseline", F.col("_old.baseline")).drop("_old")
    found = found.join(newest.select("qid", "status", *[F.col(m).alias(f"_{m}") for m in ("agent", "fixed")]), "qid", "left")
    complete = F.coalesce(F.col("status") == "ok", F.lit(False))
    found = found.withColumn("complete", complete).withColumns({m: F.when(complete, F.col(f"_{m}")) for m in ("agent", "fixed")})
    return found.withColumns({f"{m}_correct": agrees(F.col(m), F.col("label")) for m in METHODS}).drop("status", "_agent", "_fixed")


def by_method(scored: DataFrame) -> DataFrame:
    """A row for each scored row and method: method, answer, correct, counted (in the method's population)."""
    one = [F.struct(F.lit(m).alias("method"), F.col(m).alias("answer"), F.col(f"{m}_correct").alias("correct"), (F.lit(True) if m == "baseline" else F.col("complete")).alias("counted")) for m in METHODS]
    return scored.withColumn("_m", F.explode(F.array(*one))).select("*", "_m.*").drop("_m")


def summary(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and accuracies of each method (and key)."""
    counted = F.col("counted")
    out = by_method(scored).groupBy(*(keys or []), "method").agg(
        F.count(F.lit(1)).alias("planned_n"), F.count_if(counted).alias("observed_n"), F.count_if(counted & F.col("correct")).alias("correct"),
        F.count_if(counted & F.col("answer").isNotNull()).alias("parsed"), F.bool_and(counted).alias("complete"),
    )
    return out.withColumns({
        "accuracy_observed_pct": percent(F.col("correct"), F.col("observed_n")),
        "accuracy_full_denominator_pct": percent_required(F.col("correct"), F.col("planned_n")),
        "unparsed_observed": F.col("observed_n") - F.col("parsed"),
        "parsed_only_pct": percent(F.col("correct"), F.col("parsed")),
    })


def task_breakdown(scored: DataFrame) -> DataFrame:
    """The same counts by task; a task without observed rows is there with none and no accuracy."""
    return summary(scored, ["task"]).select("method", "task", "planned_n", "observed_n", "correct", "accuracy_observed_pct")


def paired(scored: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how often a is right where b is wrong and the other way, over complete rows."""
    done = scored.where("complete")
    x, y = F.col(f"{a}_correct"), F.col(f"{b}_correct")
    counts = done.agg(F.count(F.lit(1)).alias("n"), F.count_if(x & ~y).alias("wrong_to_right"), F.count_if(y & ~x).alias("right_to_wrong"))
    net = F.col("wrong_to_right") - F.col("right_to_wrong")
    return counts.select("*", net.alias("net_correct"), percent(net, F.col("n")).alias("delta_pp"))


def cluster_partials(scored: DataFrame, a: str, b: str, order: str = "ord") -> DataFrame:
    """cluster, sum of differences, rows, first appearance."""
    step = F.col(f"{a}_correct").cast("int") - F.col(f"{b}_correct").cast("int")
    return scored.where("complete").groupBy("cluster").agg(F.sum(step).alias("difference"), F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord"))


def encoded_audio_seconds(call: Column) -> Column:
    """What the call says, else the summed lengths of its clips."""
    clips = F.coalesce(call["native_audio_clip_timepoints"], F.array().cast("array<array<double>>"))
    return F.coalesce(call["audio_seconds_encoded"], F.aggregate(clips, F.lit(0.0), lambda s, c: s + F.greatest(F.lit(0.0), c[1] - c[0])))


def total(calls: Column, value) -> Column:
    return F.aggregate(calls, F.lit(0.0), lambda s, c: s + F.coalesce(value(c).cast("double"), F.lit(0.0)))


def call_costs(arms: DataFrame, keys: list[str]) -> DataFrame:
    """arms: keys, calls, decisions. Means of the calls' costs for each arm (not each call), and counts."""
    calls = F.col("calls")
    final = lambda c: F.endswith(c["stage"], F.lit("_final"))
    limit = lambda c: F.coalesce(c["reached_token_limit"], F.lit(False))
    means = {
        "mean_end_to_end_call_seconds": lambda c: c["seconds"], "mean_input_tokens": lambda c: c["input_tokens"], "mean_frames": lambda c: c["frames"],
        "mean_supplied_audio_seconds": lambda c: c["audio_seconds_supplied"], "mean_encoded_audio_seconds": encoded_audio_seconds, "mean_generated_tokens": lambda c: c["generated_tokens"],
    }
    return arms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("questions"),
        *[F.try_divide(F.sum(total(calls, f)), F.count(F.lit(1))).alias(k) for k, f in means.items()],
        F.sum(F.size(F.filter(calls, lambda c: limit(c) & ~final(c)))).alias("intermediate_token_limits"),
        F.sum(F.size(F.filter(calls, lambda c: limit(c) & final(c)))).alias("final_token_limits"),
        F.sum(F.size(F.filter("decisions", lambda d: d["fallback"]))).alias("tool_fallbacks"),
    )


def level_rollup(rows: DataFrame, levels: list[str], correct: Column) -> DataFrame:
    """level, name, matched, total, accuracy (percent, two decimals): each level on its own, not nested."""
    each = rows.withColumn("_ok", correct.cast("int")).select("_ok", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("level"), F.col(c).cast("string").alias("name")) for i, c in enumerate(levels)])).alias("l"))
    counted = each.groupBy("l.level", "l.name").agg(F.sum("_ok").alias("matched"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("accuracy", round_decimals(F.col("matched") / F.col("total") * 100, 2))
