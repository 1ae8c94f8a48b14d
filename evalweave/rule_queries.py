"""Queries of the rules for numbers, texts and checks over stand-in tables, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric, text
from .operators import checks, records, sampling, scoring
from .plans import prompts
from .queries import log, query, questions, table


@query("""SELECT doc_id AS qid, n_chars::DOUBLE * 1 / 3 AS first_center, n_chars::DOUBLE * 2 / 3 AS second_center, true AS finite FROM documents""")
def fixed_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars").cast("double")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), numeric.fixed_center(size, 0).alias("first_center"), numeric.fixed_center(size, 1).alias("second_center"), numeric.is_finite(size).alias("finite"))


@query("""WITH b AS (SELECT doc_id AS qid, (n_chars + 1)::DOUBLE AS d, n_chars / 7::DOUBLE AS c FROM documents),
w AS (SELECT *, least(12::DOUBLE, d) AS width FROM b), s AS (SELECT *, least(greatest(c - width / 2, 0::DOUBLE), d - width) AS s FROM w)
SELECT qid, round(s * 1000) / 1000::DOUBLE AS "start", round((s + width) * 1000) / 1000::DOUBLE AS "end" FROM s""")
def window_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    interval = numeric.window_interval(F.col("n_chars") / F.lit(7.0), (F.col("n_chars") + 1).cast("double"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), interval.alias("w")).select("qid", "w.start", "w.end")


@query("""SELECT o_orderkey, round(o_totalprice / 7::DOUBLE * 100) / 100::DOUBLE AS cents, abs(o_totalprice - o_orderkey) < 1000::DOUBLE AS near FROM orders""")
def rounding_and_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.round_decimals(price / F.lit(7.0), 2).alias("cents"), numeric.within(price, F.col("o_orderkey").cast("double"), 1000.0).alias("near"))


@query("""SELECT p_partkey, p_size::DOUBLE / ((p_partkey + 1) / 4::DOUBLE) AS fps FROM part""")
def effective_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.array(F.lit(0.0), (F.col("p_partkey") + 1) / F.lit(4.0))
    return table(spark, sf_dir, "part").select("p_partkey", numeric.effective_fps(F.col("p_size") + 1, times).alias("fps"))


@query("""SELECT doc_id, CASE WHEN source IS NULL THEN NULL WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 = 1 THEN source WHEN doc_id % 4 = 2 THEN 'x' END AS option FROM documents""")
def option_of_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.when(F.col("source").isNotNull(), F.get(F.array(*map(F.lit, (" a", "B ", "c", "d"))), (F.col("doc_id") % 4).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", numeric.option_of_letter(F.array("lang", "source", F.lit("x")), letter).alias("option"))


@query("""SELECT c_custkey, sha256('v|' || c_custkey || '|' || c_mktsegment) AS digest,
CASE WHEN (strpos('0123456789abcdef', right(sha256(c_custkey::VARCHAR), 1)) - 1) % 2 = 1 THEN 'agent,fixed' ELSE 'fixed,agent' END AS arms FROM customer""")
def salted_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.salted_hash("v", key, F.col("c_mktsegment")).alias("digest"), F.array_join(numeric.arm_order(key), ",").alias("arms"))


@query("""SELECT doc_id AS qid, lang AS task, doc_id % 5 NOT IN (1, 2) AS inside FROM documents""")
def contained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks.reject_labels(questions(spark, sf_dir).select("qid", "task"), "worker")
    name = F.col("qid").cast("string")
    path = F.when(F.col("qid") % 5 == 0, F.concat(F.lit("a/"), name)).when(F.col("qid") % 5 == 1, F.concat(F.lit("/"), name)).when(F.col("qid") % 5 == 2, F.concat(F.lit("a/../../"), name)).when(F.col("qid") % 5 == 3, F.concat(F.lit("a/./b/../"), name)).otherwise(name)
    return rows.select("qid", "task", checks.stays_inside(path).alias("inside"))


@query("""SELECT p_partkey, p_brand <> p_type AND p_size > 10 AS valid, p_size % 2 = 0 AS same FROM part""")
def option_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fourth = F.when(F.col("p_size") > 10, F.lit("other")).otherwise(F.col("p_brand"))
    options = F.create_map(F.lit("D"), fourth, F.lit("A"), F.col("p_brand"), F.lit("C"), F.lit("third"), F.lit("B"), F.col("p_type"))
    pair = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("y"), F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", checks.valid_options(options).alias("valid"), checks.same_set(pair, F.array(F.lit("x"), F.lit("y"))).alias("same"))


@query("""SELECT l.doc_id, l.quality IS NOT DISTINCT FROM l.toxic AS flags, d.lang IS NOT DISTINCT FROM d.source AS names FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def parity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    sides = joined.select("doc_id", F.struct(F.col("quality").alias("flags"), F.col("lang").alias("names")).alias("l"), F.struct(F.col("toxic").alias("flags"), F.col("source").alias("names")).alias("r"))
    return sides.select("doc_id", checks.parity(["flags", "names"], "l", "r").alias("m")).select("doc_id", F.col("m")["flags"].alias("flags"), F.col("m")["names"].alias("names"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'STL' WHEN 1 THEN 'CRI' WHEN 2 THEN 'PTG' ELSE lang END AS task FROM documents""")
def task_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 4 == 3, F.col("lang")).otherwise(F.get(F.array(*map(F.lit, ("task1", "task17", "PTG"))), (F.col("doc_id") % 4).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", scoring.task_code(name).alias("task"))


@query("""SELECT doc_id AS qid, CASE WHEN doc_id % 2 = 0 THEN 'B' ELSE 'D' END AS label FROM documents""")
def truth_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"))
    rows = ids.select("qid", F.lit("CSA").alias("task"), F.create_map(*[F.lit(x) for x in ("A", "one", "B", "two", "C", "three", "D", "four")]).alias("prefix2text"))
    truth = ids.select(
        "qid", F.lit("task9").alias("task"), F.array(*map(F.lit, ("four", "three", "two", "one"))).alias("options"),
        F.when(F.col("qid") % 2 == 0, "two").otherwise("four").alias("correct_answer"), F.when(F.col("qid") % 2 == 0, " c").when(F.col("qid") % 3 == 0, "").otherwise("a").alias("answer_label"),
    )
    return scoring.truth_labels(rows, truth)


@query("""WITH f AS (SELECT user_id, min(event_id) AS good FROM events WHERE event_type <> 'error' GROUP BY user_id),
k AS (SELECT e.* FROM events e LEFT JOIN f USING (user_id) WHERE good IS NULL OR event_id <= good)
SELECT user_id AS qid, max(event_id) AS ord, CASE WHEN bool_or(event_type <> 'error') THEN 'ok' ELSE 'error' END AS status FROM k GROUP BY user_id""")
def strict_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select("qid", "ord", "status")
    good = rows.where("status = 'ok'").groupBy("qid").agg(F.min("ord").alias("good"))
    return records.latest_strict(rows.join(good, "qid", "left").where("good IS NULL OR ord <= good").drop("good"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 42 ELSE 1 END ELSE 0 END AS code, event_type = 'error' AND event_id % 2 = 0 AS memory FROM events""")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "CUDA Out of Memory: tried").otherwise("other"))
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", text.exit_code(status, error).alias("code"), F.coalesce(text.out_of_memory(error), F.lit(False)).alias("memory"))


def sql_text(template: str, **values: str) -> str:
    """A SQL expression of a prompt's text with values in place of its names."""
    parts = []
    while "<<" in template:
        before, _, rest = template.partition("<<")
        name, _, template = rest.partition(">>")
        parts += ["'" + before.replace("'", "''") + "'", values[name]]
    return "(" + " || ".join([*parts, "'" + template.replace("'", "''") + "'"]) + ")"


SECONDS, START, END = "format('{:.3f}', n_chars / 7::DOUBLE)", "format('{:.3f}', n_chars / 21::DOUBLE)", "format('{:.3f}', n_chars / 21::DOUBLE + 0.0625)"
POLICY = f"""CASE WHEN doc_id % 2 = 0 THEN '{prompts.SPARSE_VIDEO}' ELSE '{prompts.NATIVE_VIDEO}' END || CASE WHEN doc_id % 3 > 0 THEN '{prompts.SPARSE_AUDIO}' WHEN doc_id % 2 = 0 THEN '{prompts.FIRST_AUDIO}' ELSE '{prompts.FULL_AUDIO}' END"""
LOOK = f"CASE WHEN doc_id % 2 = 0 THEN {sql_text(prompts.NEXT_LOOK, duration=SECONDS)} ELSE '{prompts.NO_LOOK}' END"


@query(f"""SELECT doc_id, sha256({sql_text(prompts.GLOBAL, duration=SECONDS, policy=POLICY, question="text")}) AS global_digest,
sha256({sql_text(prompts.LOCAL, start=START, end=END, look=LOOK, previous="coalesce(source, 'none')", question="text", output=f"CASE WHEN doc_id % 2 = 0 THEN '{prompts.NEXT_OUTPUT}' ELSE '{prompts.NO_OUTPUT}' END")}) AS local_digest,
sha256({sql_text(prompts.FINAL, evidence="coalesce(lang, 'none')", question="text")}) AS final_digest FROM documents""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three prompts of every document, with times to three decimals and the policy of its dataset and model."""
    size = F.col("n_chars")
    seconds, start, end = size / F.lit(7.0), size / F.lit(21.0), size / F.lit(21.0) + F.lit(0.0625)
    policy = prompts.audio_policy(F.when(F.col("doc_id") % 2 == 0, "joint").otherwise("avspeaker"), F.when(F.col("doc_id") % 3 == 0, "omni").otherwise("other"))
    asked = F.concat(F.lit("Options.\nQuestion: "), "text")
    local = [prompts.local_prompt(asked, seconds, start, end, F.coalesce("source", F.lit("none")), again) for again in (True, False)]
    digest = lambda c: F.sha2(c, 256)
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(prompts.global_prompt(asked, seconds, policy)).alias("global_digest"), digest(F.when(F.col("doc_id") % 2 == 0, local[0]).otherwise(local[1])).alias("local_digest"),
        digest(prompts.final_prompt(asked, F.coalesce("lang", F.lit("none")))).alias("final_digest"),
    )


@query("""WITH c AS (SELECT conv_id, turn, turn // 4 AS arm, role, CASE WHEN turn % 3 = 0 THEN length(text) / 4.0::DOUBLE WHEN turn % 3 = 1 THEN greatest(0, length(text) % 7 - 3) / 2.0::DOUBLE ELSE 0 END AS s, length(text) >= 200 AS long FROM conversations)
SELECT conv_id, arm, sum(s) AS encoded, bool_and(long) AS every, bool_or(long) AS some, arg_max(role, turn) AS last_role, count_if(role = 'user')::INT AS users FROM c GROUP BY conv_id, arm""")
def arm_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked of an arm's calls: encoded audio (said, else summed over clips), all and any, the last one, those of a kind."""
    size = F.length("text")
    clips = F.when(F.col("turn") % 3 == 1, F.array(F.array(F.lit(1.5), F.lit(1.5) + (size % 7 - 3) / F.lit(2.0))))
    call = F.struct("turn", F.col("role").alias("role"), F.when(F.col("turn") % 3 == 0, size / F.lit(4.0)).alias("audio_seconds_encoded"), clips.alias("native_audio_clip_timepoints"), (size >= 200).alias("long"))
    arms = table(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn div 4").alias("arm")).agg(F.array_sort(F.collect_list(call)).alias("calls"))
    held = arms.select("conv_id", F.create_map(F.col("arm").cast("string"), "calls").alias("arms"), "arm").select("conv_id", "arm", F.col("arms")[F.col("arm").cast("string")].alias("calls"))
    return held.select(
        "conv_id", "arm", scoring.total(F.col("calls"), scoring.encoded_audio_seconds).alias("encoded"), F.forall("calls", lambda c: c["long"]).alias("every"), F.exists("calls", lambda c: c["long"]).alias("some"),
        F.element_at("calls", -1)["role"].alias("last_role"), F.size(F.filter("calls", lambda c: c["role"] == "user")).alias("users"),
    )


@query("""WITH f AS (SELECT lang, max(doc_id) AS i FROM documents GROUP BY lang) SELECT row_number() OVER (ORDER BY i DESC) - 1 AS pos, doc_id AS qid, d.lang AS task FROM documents d JOIN f ON doc_id = i""")
def pilot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a short list of ids, one for each task, in the order of the list."""
    rows = questions(spark, sf_dir).select("qid", "task")
    listed = [r["i"] for r in rows.groupBy("task").agg(F.max("qid").alias("i")).orderBy(F.desc("i")).collect()]
    return sampling.in_given_order(rows, listed).select(F.col("pos").cast("long").alias("pos"), "qid", "task")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice / 2 END, 0) AS seconds, o_orderkey % 2 = 0 AS joint, CASE WHEN o_orderkey % 2 = 0 THEN 'clip-' || o_custkey END AS clip FROM orders""")
def default_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two fields that a record has, else nothing; and columns overridden in some rows."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    seconds = F.coalesce(F.when(key % 3 == 0, price), F.when(key % 3 == 1, price / 2), F.lit(0.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("seconds"), F.lit(False).alias("joint"), F.concat(F.lit("clip-"), F.col("o_custkey").cast("string")).alias("clip"))
    return rows.withColumns({"joint": key % 2 == 0, "clip": F.when(key % 2 == 0, F.col("clip"))})


@query("""SELECT user_id AS qid, min(event_id) FILTER (event_type <> 'error') AS first_good, max(event_id) AS last, coalesce(min(event_id) FILTER (event_type <> 'error') <> max(event_id), false) AS broken FROM events GROUP BY user_id""")
def followed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions have records behind a good one, over the whole log."""
    return records.followed(log(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id, n_chars + 2 AS total, least(greatest(n_chars / 25.0::DOUBLE * 2, 4), 32, n_chars + 2)::DOUBLE AS w, greatest(0.0::DOUBLE, n_chars / 100.0::DOUBLE - 2.0) AS last FROM documents),
k AS (SELECT *, (floor(floor(w) / 2) * 2)::INT AS frames FROM c)
SELECT doc_id, array_to_string(list_transform(range(frames), lambda i: round_even(0.0::DOUBLE + i * ((total::DOUBLE - 1 - 0.0) / (frames - 1)), 0)::BIGINT), ',') AS frames,
list_transform(range(8), lambda i: 0.0::DOUBLE + i * ((last - 0.0) / 7)) AS starts FROM k""")
def sample_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frame numbers and all starts of snippets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") + 2).alias("total"), (F.col("n_chars") / F.lit(25.0)).alias("duration"), numeric.snippet_starts(F.col("n_chars") / F.lit(100.0)).alias("starts"))
    frames = numeric.frame_indices(numeric.frame_count(F.col("duration"), F.col("total")), F.col("total"))
    return docs.select("doc_id", F.array_join(frames.cast("array<string>"), ",").alias("frames"), "starts")
