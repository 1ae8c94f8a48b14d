"""Queries of the evaluation operators over stand-in tables, each over whole tables, with the SQL that must agree.

documents are questions (lang the task, source the cluster, n_chars the size), labels are labels, events are the
prediction log (event_id its order, user_id the question), conversations are calls, four to an arm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric, text
from .operators import checks, records, sampling, scoring
from .functions.twister import seeded
from .operators.bootstrap import HIGH, LOW, REPEATS, SEED, bootstrap_interval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("task"), F.col("source").alias("cluster"), "n_chars")


SPLIT_SQL = """
WITH g AS (SELECT lang AS task, count(*) AS n FROM documents GROUP BY lang),
q AS (SELECT task, floor(n * 0.2::DOUBLE) AS base, n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE) AS rest,
      floor(sum(n) OVER () * 0.2::DOUBLE + 0.5) - sum(floor(n * 0.2::DOUBLE)) OVER () AS missing FROM g),
k AS (SELECT task, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, task) <= missing THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT doc_id AS qid, lang AS task, row_number() OVER (PARTITION BY lang ORDER BY sha256('av-agent-dev-v1|42|documents|' || doc_id), doc_id) AS rank FROM documents),
s AS (SELECT r.qid, r.task, r.rank FROM r JOIN k ON r.task = k.task WHERE r.rank <= k.quota)
"""


@query(SPLIT_SQL + "SELECT qid, task, rank FROM s")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(questions(spark, sf_dir).select("qid", "task"), "documents")


@query(SPLIT_SQL + "SELECT doc_id AS qid, lang AS task FROM documents WHERE doc_id NOT IN (SELECT qid FROM s)")
def remaining_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).select("qid", "task")
    return sampling.remaining(rows, sampling.stratified_split(rows, "documents"))


@query("""SELECT task, quota, n FROM (WITH g AS (SELECT lang AS task, count(*) AS n FROM documents GROUP BY lang)
SELECT task, n, (floor(n * 0.2::DOUBLE) + CASE WHEN row_number() OVER (ORDER BY n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE) DESC, task)
<= floor(sum(n) OVER () * 0.2::DOUBLE + 0.5) - sum(floor(n * 0.2::DOUBLE)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM g)""")
def split_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quotas(questions(spark, sf_dir)).select("task", F.col("quota").cast("long").alias("quota"), "n")


@query("""WITH r AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS a,
row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) AS b FROM documents)
SELECT x.lang AS task, x.doc_id AS shortest, x.n_chars AS shortest_size, y.doc_id AS longest, y.n_chars AS longest_size
FROM r x JOIN r y ON x.lang = y.lang WHERE x.a = 1 AND y.b = 1""")
def pilot_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.extremes(questions(spark, sf_dir), "n_chars", by="task")


@query("SELECT lang AS task, min(doc_id) AS qid FROM documents GROUP BY lang")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_of_each(questions(spark, sf_dir), "task", "qid")


@query("""WITH f AS (SELECT min(doc_id) AS i FROM documents GROUP BY lang UNION SELECT max(doc_id) FROM documents)
SELECT doc_id AS qid, lang AS task FROM documents WHERE doc_id IN (SELECT i FROM f)""")
def pilot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).select("qid", "task")
    last = rows.agg(F.max("qid")).first()[0]
    return sampling.selected_pilot(rows, "qid", [last] if last is not None else [])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("ord"), status.alias("status"), "event_type", "value")


LATEST_SQL = """WITH e AS (SELECT user_id AS qid, event_id AS ord, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_type, value,
row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events), latest AS (SELECT qid, ord, status, event_type, value FROM e WHERE k = 1)
"""


@query(LATEST_SQL + "SELECT qid, ord, status, event_type, value FROM latest")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest(log(spark, sf_dir))


@query("""SELECT user_id AS qid, event_id AS ord, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_event_type FROM events""")
def previous_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_previous(log(spark, sf_dir).select("qid", "ord", "event_type"), "event_type")


@query("""SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type <> 'error') AS completed, (SELECT count(*) FROM documents) AS total,
(SELECT user_id FROM events ORDER BY event_id DESC LIMIT 1) AS last_qid,
(SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END FROM events ORDER BY event_id DESC LIMIT 1) AS last_status""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.progress(questions(spark, sf_dir), log(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with rules on sizes as the baseline and newest events as the other methods' answers."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("label"))
    rows = questions(spark, sf_dir).join(marks.select("qid"), "qid", "left_semi").withColumn("ord", F.col("qid"))
    base = F.when(F.col("n_chars") >= 900, "A").when(F.col("n_chars") >= 300, "B")
    history = rows.select("qid", base.alias("baseline"))
    agent = F.when(F.col("value") >= 8, "A").when(F.col("value") >= 2, "B")
    fixed = F.when(F.col("event_type").isin("view", "purchase"), "A").when(F.col("event_type") == "click", "B")
    newest = records.latest(log(spark, sf_dir)).select("qid", "status", agent.alias("agent"), fixed.alias("fixed"))
    return scoring.score_rows(rows, marks, history, newest)


SCORED_SQL = LATEST_SQL + """, s AS (SELECT d.doc_id AS qid, d.lang AS task, d.source AS cluster, CASE WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS label,
coalesce(e.status = 'ok', false) AS complete, CASE WHEN n_chars >= 900 THEN 'A' WHEN n_chars >= 300 THEN 'B' END AS baseline,
CASE WHEN e.status = 'ok' THEN CASE WHEN value >= 8 THEN 'A' WHEN value >= 2 THEN 'B' END END AS agent,
CASE WHEN e.status = 'ok' THEN CASE WHEN event_type IN ('view', 'purchase') THEN 'A' WHEN event_type = 'click' THEN 'B' END END AS fixed
FROM documents d JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN latest e ON e.qid = d.doc_id),
m AS (SELECT task, 'baseline' AS method, baseline AS answer, label, true AS counted FROM s UNION ALL SELECT task, 'agent', agent, label, complete FROM s
UNION ALL SELECT task, 'fixed', fixed, label, complete FROM s)
"""


@query(SCORED_SQL + """, c AS (SELECT method, count(*) AS planned_n, count_if(counted) AS observed_n, count_if(counted AND coalesce(answer = label, false)) AS correct,
count_if(counted AND answer IS NOT NULL) AS parsed, bool_and(counted) AS complete FROM m GROUP BY method)
SELECT method, planned_n, observed_n::BIGINT AS observed_n, correct::BIGINT AS correct, parsed::BIGINT AS parsed, complete,
CASE WHEN observed_n > 0 THEN 100.0::DOUBLE * correct / observed_n END AS accuracy_observed_pct, 100.0::DOUBLE * correct / planned_n AS accuracy_full_denominator_pct,
(observed_n - parsed)::BIGINT AS unparsed_observed, CASE WHEN parsed > 0 THEN 100.0::DOUBLE * correct / parsed END AS parsed_only_pct FROM c""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(scored(spark, sf_dir))


@query(SCORED_SQL + """SELECT method, task, count(*) AS planned_n, count_if(counted)::BIGINT AS observed_n, count_if(counted AND coalesce(answer = label, false))::BIGINT AS correct,
CASE WHEN count_if(counted) > 0 THEN 100.0::DOUBLE * count_if(counted AND coalesce(answer = label, false)) / count_if(counted) END AS accuracy_observed_pct FROM m GROUP BY method, task""")
def task_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.task_breakdown(scored(spark, sf_dir))


PAIR_SQL = SCORED_SQL + """, p AS (SELECT cluster, qid, coalesce(agent = label, false) AS a, coalesce(baseline = label, false) AS b FROM s WHERE complete)
"""


@query(PAIR_SQL + """SELECT count(*) AS n, count_if(a AND NOT b)::BIGINT AS wrong_to_right, count_if(b AND NOT a)::BIGINT AS right_to_wrong, (count_if(a AND NOT b) - count_if(b AND NOT a))::BIGINT AS net_correct,
CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * (count_if(a AND NOT b) - count_if(b AND NOT a)) / count(*) END AS delta_pp FROM p""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.paired(scored(spark, sf_dir), "agent", "baseline")


@query(PAIR_SQL + "SELECT cluster, sum(a::INT - b::INT)::BIGINT AS difference, count(*) AS n, min(qid) AS first_ord FROM p GROUP BY cluster")
def cluster_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cluster_partials(scored(spark, sf_dir), "agent", "baseline")


def twister_sql(state: list[int], words: str, shares: str) -> str:
    """Tables t (pos, w: tempered words of the Mersenne twister in order) and what is made of them, from the seeded state."""
    twisted = "xor(((({0}) & 2147483648) | (({1}) & 2147483647)) >> 1, ({1} & 1) * 2567483615)"
    return f""",
s0(k, s) AS (SELECT 0, {state}::BIGINT[] UNION ALL SELECT k + 1, list_concat(list_concat(a, b), list_transform(range(454, 624), lambda i: xor(b[i - 453], {twisted.format("s[i + 1]", "(CASE WHEN i = 623 THEN a[1] ELSE s[i + 2] END)")})))
  FROM (SELECT *, list_transform(range(227, 454), lambda i: xor(a[i - 226], {twisted.format("s[i + 1]", "s[i + 2]")})) AS b
    FROM (SELECT *, list_transform(range(227), lambda i: xor(s[i + 398], {twisted.format("s[i + 1]", "s[i + 2]")})) AS a FROM s0 WHERE k * 624 < ({words}))))
, t1 AS (SELECT (k - 1) * 624 + i AS pos, xor(s[i + 1], s[i + 1] >> 11) AS w FROM s0, range(624) r(i) WHERE k > 0),
t2 AS (SELECT pos, xor(w, (w << 7) & 2636928640) AS w FROM t1), t3 AS (SELECT pos, xor(w, (w << 15) & 4022730752) AS w FROM t2), t AS (SELECT pos, xor(w, w >> 18) AS w FROM t3),
{shares}"""


BOOTSTRAP_SQL = PAIR_SQL.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """, c AS (SELECT sum(a::INT - b::INT)::BIGINT AS difference, count(*) AS n, min(qid) AS first_ord FROM p GROUP BY cluster),
o AS (SELECT list(difference ORDER BY first_ord) AS ds, list(n ORDER BY first_ord) AS ns, count(*) AS size FROM c)""" + twister_sql(
    seeded(SEED).get_state()[1].tolist(), f"SELECT {2 * REPEATS} * size FROM o",
    f"""u AS (SELECT x.pos // 2 AS pos, ((x.w >> 5) * 67108864.0::DOUBLE + (y.w >> 6)) / 9007199254740992.0::DOUBLE AS u FROM t x JOIN t y ON x.pos % 2 = 0 AND y.pos = x.pos + 1),
i AS (SELECT pos // size AS r, 1 + floor(u * size)::BIGINT AS i FROM u, o WHERE pos < {REPEATS} * size),
h AS (SELECT r, 100.0::DOUBLE * sum(ds[i]) / sum(ns[i]) AS share FROM i, o GROUP BY r), l AS (SELECT list(share ORDER BY share) AS l FROM h)
SELECT l[{LOW + 1}] AS low, l[{HIGH + 1}] AS high, size AS clusters, {REPEATS}::INT AS bootstrap_repeats FROM l, o WHERE size > 0""",
)


@query(BOOTSTRAP_SQL)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap_interval(cluster_partials(spark, sf_dir))


TOOL_TEXT = """CASE event_type WHEN 'view' THEN 'SEEK=' || value || chr(10) || 'A person appears.' WHEN 'click' THEN 'Look.' || chr(10) || '  seek = ' || value || '. Then more'
WHEN 'purchase' THEN 'SEEK=' || value || 's' WHEN 'signup' THEN 'SEEK=1' || chr(10) || 'SEEK=' || value ELSE 'no request' END"""


def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(TOOL_TEXT).alias("output"))


@query(f"""WITH o AS (SELECT event_id, regexp_extract_all({TOOL_TEXT}, '(?im)^\\s*SEEK\\s*=\\s*(-?\\d+(?:\\.\\d+)?)(?:[\\s.;,]|$)', 1) AS v FROM events),
c AS (SELECT event_id, CASE WHEN len(v) = 1 THEN v[1]::DOUBLE END AS x FROM o)
SELECT event_id, CASE WHEN x >= 0 AND x <= 30 THEN x ELSE 10.0::DOUBLE END AS center, NOT coalesce(x >= 0 AND x <= 30, false) AS fallback FROM c""")
def seek_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = text.seek(F.col("output"), F.lit(30.0), F.lit(10.0))
    return tool_outputs(spark, sf_dir).select("event_id", asked.alias("s")).select("event_id", "s.center", "s.fallback")


@query(f"""WITH o AS (SELECT event_id, regexp_extract_all({TOOL_TEXT}, '(?im)^\\s*SEEK\\s*=\\s*(-?\\d+(?:\\.\\d+)?)\\s*(?:s(?:ec(?:onds)?)?)?\\s*$', 1) AS v FROM events),
c AS (SELECT event_id, CASE WHEN len(v) = 1 THEN v[1]::DOUBLE END AS x FROM o)
SELECT event_id, CASE WHEN x >= 0 AND x <= 30 THEN x ELSE 10.0::DOUBLE END AS center, NOT coalesce(x >= 0 AND x <= 30, false) AS fallback FROM c""")
def seek_parse_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = text.seek(F.col("output"), F.lit(30.0), F.lit(10.0), text.SEEK_FIRST)
    return tool_outputs(spark, sf_dir).select("event_id", asked.alias("s")).select("event_id", "s.center", "s.fallback")


@query(f"""SELECT event_id, substr(regexp_replace(regexp_replace({TOOL_TEXT}, '(?im)^\\s*SEEK\\s*=.*$', '', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 1600) AS note FROM events""")
def note_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_outputs(spark, sf_dir).select("event_id", text.note(F.col("output")).alias("note"))


SAID = "CASE role WHEN 'user' THEN 'The best answer is (' || chr(65 + turn::INT) || '). ' ELSE 'Option: ' || chr(65 + turn::INT) || ' or so; ' END || text"
SAID_SPARK = SAID.replace("::INT", "")


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(SAID_SPARK).alias("said"))


def _replaced(expression: str) -> str:
    for prefix in text.ANSWER_PREFIXES:
        expression = f"replace({expression}, '{prefix}', '')"
    return expression


@query(f"""WITH w AS (SELECT conv_id, turn, string_split_regex(regexp_replace({_replaced(f"regexp_replace({SAID}, '^\\s+|\\s+$', '', 'g')")}, '[.,:!''";/\\?`~@#\\$%\\^&\\*\\(\\)\\[\\]\\{{\\}}\\\\|<>\\n]', ' ', 'g'), '\\s+') AS words FROM conversations),
f AS (SELECT conv_id, turn, list_filter(words, lambda w: w IN ('A', 'B', 'C', 'D', 'E'))[1] AS letter FROM w)
SELECT conv_id, turn, CASE WHEN letter <> 'E' THEN letter END AS answer FROM f""")
def upstream_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", text.upstream_answer(F.col("said")).alias("answer"))


@query(f"""WITH i AS (SELECT conv_id, turn, trim(regexp_replace({SAID}, '^\\s+|\\s+$', '', 'g'), '`') AS s FROM conversations),
d AS (SELECT conv_id, turn, s, list_distinct(list_transform(regexp_extract_all(s, '(?i)\\b(?:the\\s+)?(?:correct\\s+|best\\s+|final\\s+)?(?:answer|option|choice)\\s*(?:is\\s*|[:：]\\s*)[\\(\\[]?([A-D])[\\)\\]]?(?:[\\s.,:;!]|$)', 1), lambda x: upper(x))) AS l FROM i)
SELECT conv_id, turn, CASE WHEN len(l) = 1 AND NOT regexp_matches(s, '\\b[A-D]\\s*(?:or|and|/)\\s*[A-D]\\b') THEN l[1] END AS answer FROM d""")
def strict_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", text.strict_answer(F.col("said")).alias("answer"))


PROMPT = """CASE WHEN turn % 3 = 0 THEN 'Options below.' || chr(10) || 'Question: ' || text WHEN turn % 3 = 1
THEN 'Select the best answer to this.' || chr(10) || text || chr(10) || 'The best answer is:' ELSE text END"""


@query("SELECT conv_id, turn, text AS question FROM conversations")
def question_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.question(F.expr(PROMPT)).alias("question"))


CLIP = "p_type || '/' || replace(p_name, ' ', '_') || '_' || p_brand || '_' || p_size"


@query(f"""SELECT p_partkey, regexp_replace(split_part({CLIP}, '/', -1), '(?:_[^_]*){{1,2}}$', '') AS cluster FROM part""")
def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.cluster_key(F.lit(None).cast("string"), F.expr(CLIP)).alias("cluster"))


@query("""WITH c AS (SELECT doc_id, n_chars + 2 AS total, ((least(greatest(n_chars / 25.0::DOUBLE * 2, 4), 32, n_chars + 2))::DOUBLE) AS w FROM documents),
k AS (SELECT doc_id, total, (floor(floor(w) / 2) * 2)::INT AS frames FROM c),
l AS (SELECT doc_id, frames, list_transform(range(frames), lambda i: round_even(0.0::DOUBLE + i * ((total::DOUBLE - 1 - 0.0) / (frames - 1)), 0)::BIGINT) AS ix FROM k)
SELECT doc_id, frames, ix[2] AS second, ix[-1] AS last, list_sum(ix)::BIGINT AS total_index FROM l""")
def frame_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") + 2).alias("total"), (F.col("n_chars") / F.lit(25.0)).alias("duration"))
    counted = docs.withColumn("frames", numeric.frame_count(F.col("duration"), F.col("total")))
    at = counted.withColumn("at", numeric.frame_indices(F.col("frames"), F.col("total")))
    return at.select("doc_id", "frames", F.get("at", F.lit(1)).alias("second"), F.element_at("at", -1).alias("last"), F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x).alias("total_index"))


@query("""WITH s AS (SELECT doc_id, greatest(0.0::DOUBLE, n_chars / 100.0::DOUBLE - 2.0) AS last FROM documents)
SELECT doc_id, 0.0::DOUBLE + 1 * ((last - 0.0) / 7) AS second, 0.0::DOUBLE + 7 * ((last - 0.0) / 7) AS eighth FROM s""")
def snippet_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = numeric.snippet_starts(F.col("n_chars") / F.lit(100.0))
    return table(spark, sf_dir, "documents").select("doc_id", starts.alias("s")).select("doc_id", F.get("s", F.lit(1)).alias("second"), F.get("s", F.lit(7)).alias("eighth"))


@query("""WITH d AS (SELECT doc_id, n_chars / 3.0::DOUBLE AS center, n_chars / 2.0::DOUBLE AS duration FROM documents),
w AS (SELECT doc_id, least(12.0::DOUBLE, duration) AS width, center, duration FROM d),
s AS (SELECT doc_id, width, least(greatest(center - width / 2, 0.0), duration - width) AS start FROM w) SELECT doc_id, start, start + width AS stop FROM s""")
def window_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = numeric.window_bounds(F.col("n_chars") / F.lit(3.0), F.col("n_chars") / F.lit(2.0))
    return table(spark, sf_dir, "documents").select("doc_id", start.alias("start"), end.alias("stop"))


@query("""WITH p AS (SELECT p_partkey, (100 + p_size * 20)::DOUBLE AS h, floor(p_retailprice)::DOUBLE AS w FROM part),
n AS (SELECT *, greatest(28.0, round_even(h / 28, 0) * 28) AS nh, greatest(28.0, round_even(w / 28, 0) * 28) AS nw, sqrt(h * w / 602112) AS lo, sqrt(100352 / (h * w)) AS hi FROM p)
SELECT p_partkey, (CASE WHEN nh * nw > 602112 THEN greatest(28.0, floor(h / lo / 28) * 28) WHEN nh * nw < 100352 THEN ceil(h * hi / 28) * 28 ELSE nh END)::INT AS height,
(CASE WHEN nh * nw > 602112 THEN greatest(28.0, floor(w / lo / 28) * 28) WHEN nh * nw < 100352 THEN ceil(w * hi / 28) * 28 ELSE nw END)::INT AS width FROM n""")
def resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = numeric.resize_plan(F.lit(100) + F.col("p_size") * 20, F.floor("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", plan.alias("p")).select("p_partkey", "p.height", "p.width")


@query("""WITH a AS (SELECT conv_id, turn // 4 AS arm, count(*) AS calls, sum(length(text) / 8.0::DOUBLE) AS s, sum(length(text)) AS t,
sum(CASE WHEN length(text) >= 256 AND role <> 'assistant' THEN 1 ELSE 0 END) AS i, sum(CASE WHEN length(text) >= 256 AND role = 'assistant' THEN 1 ELSE 0 END) AS f,
sum(CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END) AS b FROM conversations GROUP BY ALL)
SELECT calls, count(*) AS questions, sum(s) / count(*) AS mean_end_to_end_call_seconds, sum(t)::DOUBLE / count(*) AS mean_generated_tokens, sum(i)::BIGINT AS intermediate_token_limits,
sum(f)::BIGINT AS final_token_limits, sum(b)::BIGINT AS tool_fallbacks FROM a GROUP BY calls""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    size = F.length("text")
    call = F.struct(
        F.when(F.col("role") == "assistant", "agent_final").otherwise("agent_inspect_1").alias("stage"), (size / F.lit(8.0)).alias("seconds"), size.alias("generated_tokens"), numeric.hit_token_limit(size).alias("reached_token_limit"),
        none.cast("int").alias("input_tokens"), none.cast("int").alias("frames"), none.cast("double").alias("audio_seconds_supplied"), none.cast("double").alias("audio_seconds_encoded"), none.cast("array<array<double>>").alias("native_audio_clip_timepoints"),
    )
    decision = F.struct((F.col("turn") % 4 == 0).alias("fallback"))
    arms = table(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn div 4").alias("arm")).agg(F.collect_list(call).alias("calls"), F.collect_list(decision).alias("decisions"))
    costs = scoring.call_costs(arms.withColumn("n", F.size("calls").cast("long")), ["n"])
    return costs.select(F.col("n").alias("calls"), "questions", "mean_end_to_end_call_seconds", "mean_generated_tokens", "intermediate_token_limits", "final_token_limits", "tool_fallbacks")


@query("""SELECT level, name, matched, total, round_even(matched::DOUBLE / total * 100, 2) AS accuracy FROM (SELECT CASE WHEN grouping(p_brand) = 0 THEN 1 WHEN grouping(p_type) = 0 THEN 2 ELSE 3 END AS level, coalesce(p_brand, p_type, p_size::VARCHAR) AS name,
sum(CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END)::BIGINT AS matched, count(*) AS total FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size)))""")
def level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.level_rollup(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], F.col("p_retailprice") > 1000)


@query("""SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS wrong_so_far, count(*) OVER w AS seen_so_far,
sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w / (count(*) OVER w)::DOUBLE AS error_rate FROM events
WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return records.running_errors(rows, F.col("event_type") == "error", ["event_id"]).select("event_id", "wrong_so_far", "seen_so_far", "error_rate")


@query("""WITH h AS (SELECT c_custkey, strpos('0123456789abcdef', right(sha256(c_custkey::VARCHAR), 1)) - 1 AS x FROM customer)
SELECT c_custkey, (x % 2)::INT AS parity, CASE WHEN x % 2 = 1 THEN 'agent' ELSE 'fixed' END AS first_arm FROM h""")
def parity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.hash_parity(key).alias("parity"), F.get(numeric.arm_order(key), F.lit(0)).alias("first_arm"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS path, CASE WHEN d.doc_id IS NOT NULL THEN sha256(d.text) END AS "left", CASE WHEN l.doc_id IS NOT NULL THEN sha256(l.quality::VARCHAR) END AS "right"
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    right = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.sha2(F.col("quality").cast("string"), 256).alias("digest"))
    return checks.manifest_difference(left, right)


@query("SELECT doc_id AS qid, lang AS task FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), F.lit("ok").alias("status"))
    return sampling.unfinished(questions(spark, sf_dir).select("qid", "task"), done)


@query("""SELECT conv_id, (turn // 4)::BIGINT AS arm, string_agg(text, chr(10) ORDER BY turn) AS observations FROM conversations GROUP BY ALL""")
def joined_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of each arm, as call_costs divides a conversation."""
    held = table(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn div 4").alias("arm")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return held.select("conv_id", "arm", F.array_join("l.text", "\n").alias("observations"))


@query(LATEST_SQL + "SELECT qid, ord, status, event_type, value FROM latest")
def incremental_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest records after the log's files went through a stream."""
    from .file_queries import place
    from .streaming.rescore import follow_log, newest_state, stream_files

    base = place(spark, "rescore")
    path = f"{sf_dir}/events.parquet"
    stream = stream_files(spark, path, spark.read.parquet(path).schema)
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    rows = stream.select(F.col("user_id").alias("qid"), F.col("event_id").alias("ord"), status.alias("status"), "event_type", "value")
    seen: list[int] = []
    follow_log(rows, f"{base}/state", lambda df, n: seen.append(n), f"{base}/checkpoint").awaitTermination()
    if not seen:
        return spark.createDataFrame([], "qid long, ord long, status string, event_type string, value double")
    return newest_state(spark, f"{base}/state", seen[-1])


from . import answer_queries, file_queries, plan_queries, rule_queries, stream_queries  # noqa: E402, F401  they register theirs above
