import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evalweave.operators import checks, records, sampling, scoring
from evalweave.operators.bootstrap import bootstrap_interval


def split_by_hand(rows, dataset):
    """Largest remainder, then the smallest salted hashes, in rounds."""
    by = defaultdict(list)
    for q, t in rows:
        by[t].append(q)
    n = {t: len(v) * 0.2 for t, v in by.items()}
    quota = {t: int(x) for t, x in n.items()}
    for t in sorted(by, key=lambda t: (-(n[t] - int(n[t])), t))[: int(len(rows) * 0.2 + 0.5) - sum(quota.values())]:
        quota[t] += 1
    ranked = {t: sorted(by[t], key=lambda q: hashlib.sha256(f"av-agent-dev-v1|42|{dataset}|{q}".encode()).hexdigest())[: quota[t]] for t in by}
    return [ranked[t][i] for i in range(max(quota.values())) for t in sorted(ranked) if i < len(ranked[t])]


@pytest.mark.parametrize("turned", [False, True])
def test_split_ignores_order(spark, turned):
    rows = [(f"q{i}", f"t{i % 3}") for i in range(103)]
    given = rows[::-1] if turned else rows
    got = [r["qid"] for r in sampling.stratified_split(spark.createDataFrame(given, "qid string, task string"), "joint").collect()]
    assert got == split_by_hand(rows, "joint") and len(got) == 21


def test_split_uneven_and_remaining(spark):
    rows = [(f"q{i}", f"t{int(i ** 0.5) % 5}") for i in range(211)]
    df = spark.createDataFrame(rows, "qid string, task string")
    chosen = sampling.stratified_split(df, "x")
    assert [r["qid"] for r in chosen.collect()] == split_by_hand(rows, "x")
    left = {r["qid"] for r in sampling.remaining(df, chosen).collect()}
    assert left | set(split_by_hand(rows, "x")) == {q for q, _ in rows} and not left & set(split_by_hand(rows, "x"))
    assert sampling.stratified_split(df.where("false"), "x").count() == 0


def test_label_columns_are_refused(spark):
    with pytest.raises(ValueError, match="label"):
        checks.reject_labels(spark.createDataFrame([("q", "A")], "qid string, label string"), "split")
    lines = spark.createDataFrame([('{"qid": "1"}',), ('{"qid": "2", "answer": "A"}',)], "value string")
    with pytest.raises(Exception, match="label columns"):
        checks.reject_label_keys(lines, "worker").collect()


def test_checks(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "qid string")
    with pytest.raises(ValueError):
        checks.unique(df, "qid")
    with pytest.raises(ValueError):
        checks.unique(df.distinct(), "qid", 3)
    paths = {"a/b": True, "../x": False, "a/../b": True, "a/../../b": False, "/etc": False, "./a": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", checks.stays_inside(F.col("p")).alias("v")).collect()
    assert {r["p"]: r["v"] for r in got} == paths
    options = spark.createDataFrame([({"A": "1", "B": "2", "C": "3", "D": "4"},), ({"A": "1", "B": "1", "C": "3", "D": "4"},), ({"A": "1"},)], "o map<string,string>")
    assert [r["v"] for r in options.select(checks.valid_options(F.col("o")).alias("v")).collect()] == [True, False, False]
    both = spark.createDataFrame([((1, None), (1, None)), ((1, 2), (2, None))], "l struct<x:int,y:int>, r struct<x:int,y:int>")
    assert [r["v"] for r in both.select(checks.parity(["x", "y"], "l", "r").alias("v")).collect()] == [{"x": True, "y": True}, {"x": False, "y": False}]
    a = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, digest string")
    b = spark.createDataFrame([("p", "1"), ("r", "3")], "path string, digest string")
    assert {r["path"] for r in checks.manifest_difference(a, b).collect()} == {"q", "r"}
    assert {r["path"] for r in checks.manifest_difference(a, b, one_way=True).collect()} == {"q"}


def test_latest_and_strict(spark):
    rows = [("a", 1, "error"), ("a", 5, "ok"), ("b", 2, "ok"), ("b", 3, "error"), ("c", 4, "error")]
    df = spark.createDataFrame(rows, "qid string, ord int, status string")
    assert {(r["qid"], r["ord"]) for r in records.latest(df).collect()} == {("a", 5), ("b", 3), ("c", 4)}
    assert {r["qid"] for r in records.latest_strict(df.where("qid <> 'b'")).collect()} == {"a", "c"}
    with pytest.raises(Exception, match="follows a good one"):
        records.latest_strict(df).collect()
    assert records.progress(spark.range(7), df).first().asDict() == {"completed": 2, "total": 7, "last_qid": "a", "last_status": "ok"}


def test_running_errors_across_ranges(spark):
    rows = [(i, random.Random(i).random() < 0.3) for i in range(1000)]
    got = records.running_errors(spark.createDataFrame(rows, "i int, w boolean").repartition(7), F.col("w"), ["i"]).orderBy("i").collect()
    total = 0
    for r, (i, w) in zip(got, rows):
        total += w
        assert (r["i"], r["wrong_so_far"], r["seen_so_far"]) == (i, total, i + 1)


def test_unfinished_and_orders(spark):
    rows = spark.createDataFrame([(f"q{i}", f"t{i % 2}", i) for i in range(6)], "qid string, task string, ord int")
    log = spark.createDataFrame([("q1", "ok"), ("q2", "error")], "qid string, status string")
    assert {r["qid"] for r in sampling.unfinished(rows, log).collect()} == {"q0", "q2", "q3", "q4", "q5"}
    with pytest.raises(Exception, match="two good records"):
        sampling.unfinished(rows, log.union(log)).collect()
    assert [r["qid"] for r in sampling.in_given_order(rows, ["q4", "q0"]).collect()] == ["q4", "q0"]
    assert [r["qid"] for r in sampling.selected_pilot(rows, "ord", ["q5"]).collect()] == ["q0", "q1", "q5"]
    sized = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 9.0), ("d", 9.0), ("e", None)], "qid string, s double")
    assert sampling.extremes(sized, "s").first().asDict() == {"shortest": "a", "shortest_size": 1.0, "longest": "d", "longest_size": 9.0}


def test_scores_need_labels_but_not_records(spark):
    rows = spark.createDataFrame([("1", "t", "c", 0), ("2", "t", "c", 1)], "qid string, task string, cluster string, ord int")
    labels = spark.createDataFrame([("1", "A"), ("2", "B")], "qid string, label string")
    old = spark.createDataFrame([("1", "A"), ("2", None)], "qid string, baseline string")
    new = spark.createDataFrame([("1", "ok", "A", None)], "qid string, status string, agent string, fixed string")
    got = {r["method"]: r for r in scoring.summary(scoring.score_rows(rows, labels, old, new)).collect()}
    assert (got["baseline"]["observed_n"], got["baseline"]["correct"], got["baseline"]["parsed_only_pct"]) == (2, 1, 100.0)
    assert (got["agent"]["observed_n"], got["agent"]["correct"], got["agent"]["complete"]) == (1, 1, False)
    assert (got["fixed"]["correct"], got["fixed"]["parsed_only_pct"]) == (0, None)
    with pytest.raises(Exception, match="label missing"):
        scoring.score_rows(rows, labels.where("qid = '1'"), old, new).collect()
    with pytest.raises(Exception, match="historical record missing"):
        scoring.score_rows(rows, labels, old.where("qid = '1'"), new).collect()


def test_truth_labels(spark):
    options = {"A": "w", "B": "x", "C": "y", "D": "z"}
    rows = spark.createDataFrame([("1", "STL", options)], "qid string, task string, prefix2text map<string,string>")
    truth = lambda task, answer, letter: spark.createDataFrame([("1", task, ["x", "w", "z", "y"], answer, letter)], "qid string, task string, options array<string>, correct_answer string, answer_label string")
    assert scoring.truth_labels(rows, truth("task1", "z", "c")).first()["label"] == "D"
    for bad in (truth("task2", "z", None), truth("STL", "q", None), truth("STL", "z", "A")):
        with pytest.raises(Exception, match="truth missing"):
            scoring.truth_labels(rows, bad).collect()


def test_bootstrap_follows_first_appearance(spark):
    source = random.Random(5)
    rows = [(f"c{source.randrange(40)}", i, source.random() < 0.6, source.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame([(c, i, a, b, True) for c, i, a, b in rows], "cluster string, ord int, agent_correct boolean, baseline_correct boolean, complete boolean")
    groups = {}
    for c, _, a, b in rows:
        groups.setdefault(c, []).append(int(a) - int(b))
    pairs, rng, draws = [(sum(v), len(v)) for v in groups.values()], random.Random(42), []
    for _ in range(2000):
        s = rng.choices(pairs, k=len(pairs))
        draws.append(100 * sum(x for x, _ in s) / sum(n for _, n in s))
    draws.sort()
    got = bootstrap_interval(scoring.cluster_partials(df, "agent", "baseline")).first()
    assert (got["low"], got["high"], got["clusters"]) == (draws[49], draws[1949], len(groups))


def test_call_costs(spark):
    from evalweave import schemas

    call = lambda **k: k
    arms = [{"m": "agent", "calls": [call(stage="global_plan", seconds=1.5, generated_tokens=256, reached_token_limit=True, native_audio_clip_timepoints=[[0.0, 2.0], [5.0, 4.0]]), call(stage="agent_final", seconds=0.5, generated_tokens=1, reached_token_limit=True, audio_seconds_encoded=3.0, input_tokens=7)], "decisions": [{"fallback": True}]}, {"m": "agent", "calls": [], "decisions": []}]
    df = spark.read.schema(f"m string, calls array<{schemas.CALL}>, decisions array<{schemas.DECISION}>").json(spark.sparkContext.parallelize([json.dumps(a) for a in arms]))
    r = scoring.call_costs(df, ["m"]).first()
    assert (r["questions"], r["mean_end_to_end_call_seconds"], r["mean_encoded_audio_seconds"], r["mean_input_tokens"]) == (2, 1.0, 2.5, 3.5)
    assert (r["intermediate_token_limits"], r["final_token_limits"], r["tool_fallbacks"]) == (1, 1, 1)


def test_rollup_counts(spark):
    rows = [("a", "x", True), ("a", "y", False), ("b", "x", True)]
    got = scoring.level_rollup(spark.createDataFrame(rows, "c string, s string, ok boolean"), ["c", "s"], F.col("ok")).collect()
    assert Counter((r["level"], r["name"], r["matched"], r["total"]) for r in got) == Counter([(1, "a", 1, 2), (1, "b", 1, 1), (2, "x", 2, 2), (2, "y", 0, 1)])
