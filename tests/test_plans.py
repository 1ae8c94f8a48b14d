import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalweave.plans import campaign, inference, prompts
from evalweave.plans.evaluation import evaluate, evaluate_files, pilot_gate
from evalweave.plans.ledger import Ledger
from evalweave.sources import logs, media, sinks
from evalweave.streaming.rescore import follow_log, partial_counts


def stub(batches):
    """Asks for second 26 in the first look of the agent, answers A at the end."""
    for rows in batches:
        text = [{"global_plan": "SEEK=5\nInitial evidence", "global_repeat": "SEEK=5\nInitial evidence", "agent_inspect_1": "SEEK=26\nmore", "agent_final": "A", "fixed_final": "B"}.get(s, "seen") for s in rows["stage"]]
        yield pd.DataFrame({"qid": rows["qid"], "model_output": text, "generated_tokens": 3, "reached_token_limit": False, "input_tokens": [len(p) for p in rows["prompt"]], "audio_tokens": 1, "video_tokens": 1, "seconds": 0.5})


QUESTION = {"question_prompt": "Question? A. One B. Two C. Three D. Four", "clip_path": "c/v_1_2.mp4", "task": "STL"}


@pytest.fixture(scope="module")
def run(spark):
    rows = spark.createDataFrame([(f"q{i}", *QUESTION.values(), 30.0) for i in range(3)], "qid string, question_prompt string, clip_path string, task string, duration double")
    return inference.run_questions(rows, prompts.audio_policy(F.lit("joint"), F.lit("omni")), stub, repeat_check=True)


def test_second_look_follows_the_first(run):
    r = run.orderBy("qid").first()
    agent, fixed = r["arms"]["agent"], r["arms"]["fixed"]
    assert [d["center"] for d in agent["decisions"]] == [5.0, 26.0] and [d["center"] for d in fixed["decisions"]] == [10.0, 20.0]
    assert agent["decisions"][0]["window"] == [0.0, 12.0] and agent["decisions"][1]["window"] == [18.0, 30.0]
    assert [c["stage"] for c in agent["calls"]] == ["global_plan", "agent_inspect_1", "agent_inspect_2", "agent_final"]
    assert (agent["model_output"], fixed["model_output"], r["actual_new_calls"]) == ("A", "B", 7)
    assert all(r["repeat_matches"].values())


def test_prompts_are_filled(spark):
    df = spark.createDataFrame([("Q <<duration>>", 30.0005)], "p string, d double")
    got = df.select(prompts.global_prompt(F.col("p"), F.col("d"), F.lit("policy")).alias("g"), prompts.local_prompt(F.col("p"), F.col("d"), F.lit(1.0), F.lit(13.0), F.lit("before"), True).alias("l"), prompts.final_prompt(F.col("p"), F.lit("seen")).alias("f")).first()
    assert f"is {30.0005:.3f} seconds" in got["g"] and "Q <<duration>>" in got["g"] and "SEEK=<seconds between 0 and 30.000>" in got["g"].replace(f"{30.0005:.3f}", "30.000")
    assert "[1.000, 13.000]" in got["l"] and "before" in got["l"] and got["f"].endswith("Q <<duration>>")


def test_a_run_that_goes_on_asks_nothing_twice(spark, tmp_path):
    """A model that fails in the second look; what it had answered by then is kept, also in the task that failed."""
    asked = str(tmp_path / "asked")

    def counting(fails):
        def infer(batches):
            import os
            import uuid

            os.makedirs(asked, exist_ok=True)
            for rows in batches:
                for i in range(len(rows)):
                    one = rows.iloc[i : i + 1]
                    if fails and one["stage"].iloc[0] == "agent_inspect_2" and one["qid"].iloc[0] == "q3":
                        raise RuntimeError("gone")
                    with open(f"{asked}/{one['qid'].iloc[0]}.{one['stage'].iloc[0]}.{uuid.uuid4().hex}", "w"):
                        pass
                    yield from stub([one])

        return infer

    rows = spark.createDataFrame([(f"q{i}", *QUESTION.values(), 30.0) for i in range(6)], "qid string, question_prompt string, clip_path string, task string, duration double").coalesce(2)
    policy, ledger = prompts.audio_policy(F.lit("joint"), F.lit("omni")), Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(ValueError, match="agent_inspect_2: RuntimeError: gone"):
        inference.run_questions(rows, policy, counting(True), ledger=ledger)
    before = len(list((tmp_path / "asked").iterdir()))
    assert 6 + 6 <= before < 6 + 6 + 6
    out = inference.run_questions(rows, policy, counting(False), ledger=ledger)
    assert out.count() == 6
    names = [f.name.rsplit(".", 1)[0] for f in (tmp_path / "asked").iterdir()]
    assert len(names) == len(set(names)) == 6 * 7
    again = inference.run_questions(rows, policy, counting(True), ledger=ledger)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect())) and len(list((tmp_path / "asked").iterdir())) == 42
    inference.run_questions(rows.withColumn("question_prompt", F.lit("Another? A. 1 B. 2 C. 3 D. 4")), policy, counting(False), ledger=ledger)
    assert len(list((tmp_path / "asked").iterdir())) == 84


def test_bad_model_output_fails(spark):
    def silent(batches):
        for rows in batches:
            yield pd.DataFrame({"qid": rows["qid"], "model_output": " ", "generated_tokens": 0, "reached_token_limit": False, "input_tokens": 1, "audio_tokens": 1, "video_tokens": 1, "seconds": 0.1})

    rows = spark.createDataFrame([("q", "c")], "qid string, clip_path string")
    with pytest.raises(Exception, match="no output"):
        inference.call_model(rows, F.lit("p"), "s", silent)


@pytest.fixture
def files(tmp_path):
    options = {"A": "One", "B": "Two", "C": "Three", "D": "Four"}
    rows = [{"qid": f"q{i}", "task": "STL" if i < 3 else "CSA", "question_prompt": "?", "clip_path": f"c/vid{i // 2}_1_2.mp4", "prefix2text": options} for i in range(4)]
    (tmp_path / "questions.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "labels.json").write_text(json.dumps({f"q{i}": {"correct_prefix": "AABB"[i]} for i in range(4)}))
    old = [{"qid": f"q{i}", "status": "ok", "model_output": "A", "seconds": 2.0} for i in range(4)]
    for k in (0, 3):
        (tmp_path / f"old{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in old[k // 3 * 2 : k // 3 * 2 + 2]))
    arm = lambda text, stage: {"model_output": text, "decisions": [{"center": 1.0, "fallback": True, "reason": "r", "window": [0.0, 2.0]}], "calls": [{"stage": "global_plan", "seconds": 1.0, "generated_tokens": 2, "reached_token_limit": False}, {"stage": stage, "seconds": 2.0, "generated_tokens": 1, "reached_token_limit": False}]}
    new = [{"qid": "q0", "status": "error", "error": "CUDA out of memory"}] + [{"qid": f"q{i}", "status": "ok", "arms": {"agent": arm("ABBB"[i], "agent_final"), "fixed": arm("The answer is A.", "fixed_final")}} for i in range(4)]
    (tmp_path / "new.jsonl").write_text("".join(json.dumps(r) + "\n" for r in new))
    return tmp_path


def test_evaluation_from_files(spark, files):
    f = str(files)
    out = evaluate_files(spark, f"{f}/questions.jsonl", f"{f}/labels.json", [f"{f}/old0.jsonl", f"{f}/old3.jsonl"], f"{f}/new.jsonl", "joint", "omni", count=4)
    methods = {r["method"]: r for r in out["methods"].collect()}
    assert {m: (r["planned_n"], r["observed_n"], r["correct"]) for m, r in methods.items()} == {"baseline": (4, 4, 2), "agent": (4, 4, 3), "fixed": (4, 4, 2)}
    assert methods["agent"]["mean_end_to_end_call_seconds"] == 3.0 and methods["baseline"]["mean_end_to_end_call_seconds"] == 2.0
    assert methods["agent"]["tool_fallbacks"] == 4 and methods["agent"]["historical_error_attempts"] == 1
    pair = out["pairs"]["agent_vs_baseline"]
    assert (pair["wrong_to_right"], pair["right_to_wrong"], pair["clusters"]) == (2, 1, 2)
    assert {(r["method"], r["task"], r["planned_n"]) for r in out["tasks"].collect()} == {(m, t, n) for m in ("baseline", "agent", "fixed") for t, n in (("STL", 3), ("CSA", 1))}
    sinks.write_report(out["methods"], out["pairs"], f"{f}/report.txt", ["head"])
    text = (files / "report.txt").read_text()
    assert text.startswith("head\n") and "agent    " in text and "agent_vs_baseline" in text


def test_partial_run_has_no_contrasts(spark, files):
    lines = (files / "new.jsonl").read_text().splitlines(keepends=True)
    (files / "new.jsonl").write_text("".join(lines[:3]) + lines[3][:20])  # a writer is in the middle of a line
    f = str(files)
    out = evaluate_files(spark, f"{f}/questions.jsonl", f"{f}/labels.json", [f"{f}/old0.jsonl", f"{f}/old3.jsonl"], f"{f}/new.jsonl", "joint", "omni", count=4)
    assert out["pairs"]["observed"] == 2 and out["pairs"]["agent_vs_fixed"] is None
    with pytest.raises(Exception):
        logs.read_records(spark, f"{f}/new.jsonl", torn="fail").collect()


def test_logs(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"qid": "1", "status": "ok"}\n\n{"qid": "2 x", "status": "ok"}\n', encoding="utf-8")
    assert [r["qid"] for r in logs.read_records(spark, str(p)).orderBy("ord").collect()] == ["1", "2 x"]
    assert logs.read_records(spark, str(tmp_path / "none.jsonl")).count() == 0
    p.write_text('{"qid": "1"}\nnot json\n{"qid": "3"}\n')
    with pytest.raises(Exception):
        logs.read_records(spark, str(p)).collect()
    with pytest.raises(ValueError, match="repeats"):
        q = tmp_path / "b.jsonl"
        q.write_text('{"qid": "1", "status": "ok"}\n')
        logs.read_history(spark, [str(q), str(q)])
    assert logs.first_path(spark, str(tmp_path / "none"), str(p)) == str(p)
    assert logs.digests(spark, str(tmp_path), ".jsonl").count() == 2
    assert len(logs.digest_map(logs.digests(spark, str(tmp_path), ".jsonl")).first()["digests"]) == 2


def test_question_checks(spark, files):
    f = files / "questions.jsonl"
    rows = [json.loads(x) for x in f.read_text().splitlines()]
    with pytest.raises(ValueError, match="digest"):
        logs.read_questions(spark, str(f), "joint", digest="0", count=4)
    f.write_text("".join(json.dumps(r | {"clip_path": "../x"}) + "\n" for r in rows))
    with pytest.raises(Exception, match="not valid"):
        logs.read_questions(spark, str(f), "joint", count=4).collect()
    f.write_text("".join(json.dumps(r | {"correct_answer": "x"}) + "\n" for r in rows))
    with pytest.raises(Exception, match="label columns"):
        logs.read_questions(spark, str(f), "joint", count=4).collect()


def test_sinks(spark, tmp_path):
    sinks.write_document(str(tmp_path / "d/x.json"), {"a": "é"})
    assert json.loads((tmp_path / "d/x.json").read_text()) == {"a": "é"} and not list(tmp_path.glob("d/*.tmp"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert sinks.write_once(df, str(tmp_path / "t")) and not sinks.write_once(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        sinks.write_once(df.limit(1), str(tmp_path / "t"))
    for _ in range(2):
        sinks.append_records(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    (tmp_path / "d/y.lock").write_text("")
    assert sinks.bundle(str(tmp_path / "d"), str(tmp_path / "all.tar.gz")) == ["x.json"]


def test_media_without_decoders(spark, tmp_path):
    probe = {"streams": [{"codec_type": "video", "duration": "5.5"}, {"codec_type": "audio"}], "format": {"duration": "6"}}
    clips = spark.createDataFrame([("q", "c.mp4")], "qid string, clip_path string")
    text = json.dumps(probe).encode()
    assert media.probes(clips, "/r", lambda command: text).first()["duration"] == 5.5
    silent = json.dumps({"streams": probe["streams"][:1], "format": {}}).encode()
    with pytest.raises(Exception, match="no audio"):
        media.probes(clips, "/r", lambda command: silent).collect()
    import numpy as np

    samples, facts = media.read_audio("x", lambda command: np.ones(32000, np.float32).tobytes())
    assert facts["audio_seconds_supplied"] == 2.0
    padded, more = media.audio_snippets(samples)
    assert len(padded) == 480000 and more["audio_snippet_starts_seconds"] == [0.0] * 8
    with pytest.raises(ValueError):
        media.read_audio("x", lambda command: b"")
    got = media.sampled_frames(spark.createDataFrame([("q", "p")], "qid string, path string"), lambda path: (100, 25.0, lambda at: np.array(at))).first()
    assert got["frames"] == 8 and got["frame_indices"] == np.rint(np.linspace(0, 99, 8)).astype(int).tolist()


def test_pilot_gate(spark, run):
    base = run.withColumn("direct_baseline_check", F.struct(*[F.lit(1).alias(k) for k in ("frames",)], *[F.lit("x").alias(k) for k in ("audio_sha256", "video_tensor_sha256", "raw_frames_sha256")], *[F.lit(2).alias(k) for k in ("input_tokens", "audio_tokens", "video_tokens")], F.lit("A").alias("model_output")))
    history = base.select("qid", "direct_baseline_check.*")
    checks = pilot_gate(base, history)
    assert checks.count() == 3 and checks.agg(F.min("agent_valid_tool_requests")).first()[0] == 2
    with pytest.raises(ValueError, match="differ"):
        pilot_gate(base, history.withColumn("frames", F.lit(9)))


def test_lane_retries_only_when_memory_ran_out():
    calls, gates = [], []
    codes = iter([42, 0, 0, 0, 0])
    ran = campaign.lane(lambda p, d: calls.append((p, d)) or next(codes), gates.append, lambda p, d: False)
    assert calls[:2] == [("pilot", "avspeaker")] * 2 and ran[0] == ("pilot", "avspeaker", 2) and gates == ["avspeaker", "joint"]
    with pytest.raises(RuntimeError):
        campaign.lane(lambda p, d: 1, gates.append, lambda p, d: False)
    with pytest.raises(RuntimeError):
        campaign.lane(lambda p, d: 42, gates.append, lambda p, d: False)
    assert campaign.lane(lambda p, d: 1, gates.append, lambda p, d: True) == []


def test_follow_log(spark, tmp_path):
    planned = spark.createDataFrame([("a",), ("b",)], "qid string")
    write = lambda rows: spark.createDataFrame(rows, "qid string, ord int, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = []

    def once():
        stream = spark.readStream.schema("qid string, ord int, status string").parquet(str(tmp_path / "log"))
        follow_log(stream, str(tmp_path / "state"), lambda df, n: seen.append(partial_counts(df, planned).first().asDict()), str(tmp_path / "cp")).awaitTermination()

    write([("a", 1, "error")])
    once()
    write([("a", 2, "ok")])
    write([("b", 3, "ok")])
    once()
    assert seen[0] == {"planned": 2, "observed": 0, "errors": 1, "complete": False}
    assert seen[-1] == {"planned": 2, "observed": 2, "errors": 0, "complete": True}


def test_a_new_stage_makes_its_prompts_once(spark, tmp_path):
    """What a call is asked with is made for the model and its digest together; on a look at finished calls, for their names alone."""
    from evalweave.plans.ledger import answered

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def prompt(qid):
        made.add(1)
        return f"Question {qid}?"

    none = F.lit(None).cast("double")
    asked = spark.range(20).select(F.col("id").cast("string").alias("qid"), F.lit("c").alias("clip_path"), prompt("id").alias("prompt"), F.lit("fixed_final").alias("stage"), none.alias("start"), none.alias("end"), F.lit(42).alias("seed"))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for times in (1, 2):
        assert answered(asked, "fixed_final", stub, ledger).select("qid", "model_output").distinct().count() == 20
        assert made.value == 20 * times
    assert spark.read.parquet(ledger.path).count() == 20
