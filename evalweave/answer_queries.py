"""Queries of the answer rules, with SQL that folds the same marks of a text from lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .queries import ORACLES, SAID, query, said, table

# What leads a letter in each kind of declaration, hedges, and alternatives, in the dialect of the SQL.
LEADS = {
    "declaration": r"\b(?:the\s+)?(?:(?:correct|final|best|most\s+likely)\s+)?(?:answer|option|choice|order)\s*(?:is\s+|would\s+be\s+|[:：]\s*)",
    "pronoun_declaration": r"\b(?:it[''’]s|it\s+is)\s+",
    "first_person_selection": r"\bI(?:[''’]d|\s+would)?\s+(?:choose|select|pick|go\s+with|say)\s+",
}
HEDGES = r"\b(?:if|suppose|example|not|never|don[''’]t|isn[''’]t)\b"
OTHER = r"(?:\s+(?:/|or\b|and\b|,|->|→)|,)\s*\(?[A-D]\)?(?:\W|$)"


def answers_sql(texts: str) -> str:
    """SQL of answer and rule for a table of conv_id, turn, said.

    Matches, hedges and ends of clauses of each kind become numbers (0 an end, 1 a hedge, 2 a match, 3 one with an
    alternative, 6 one whose clause ends with it); a fold over them is 2 if an alternative came first, 3 if a hedge did.
    """
    marks, folds, doubts = [], [], []
    for kind, lead in LEADS.items():
        marks.append(rf"regexp_extract_all(s, '(?i:{HEDGES})|(?i:{lead})\(?[A-D]\)?(?:{OTHER}|[\s.,:;!)]|$)|[.!?;\n]') AS {kind}")
        code = (
            rf"CASE WHEN regexp_full_match(w, '[.!?;\n]') THEN 0 WHEN regexp_full_match(w, '(?i:{HEDGES})') THEN 1 "
            rf"WHEN regexp_full_match(w, '(?i:{lead})\(?[A-D]\)?{OTHER}') THEN 3 WHEN regexp_matches(w, '[.!?;\n]') THEN 6 ELSE 2 END"
        )
        folds.append(f"list_reduce(list_transform({kind}, lambda w: {code}), lambda state, e: CASE WHEN state >= 2 THEN state WHEN e = 0 THEN 0 WHEN e = 1 THEN 1 WHEN e = 3 THEN 2 WHEN state = 1 THEN 3 WHEN e = 6 THEN 0 ELSE state END, 0) AS {kind}_doubt")
        folds.append(rf"list_transform(list_filter({kind}, lambda w: regexp_matches(w, '^(?i:{lead})')), lambda w: regexp_extract(w, '^(?i:{lead})\(?([A-D])', 1)) AS {kind}")
        doubts.append(f"WHEN {kind}_doubt = 2 THEN 'ambiguous_alternatives' WHEN {kind}_doubt = 3 THEN 'qualified_or_negated_declaration'")
    kinds = ", ".join(f"CASE WHEN len({kind}) > 0 THEN '{name}' END" for name, kind in sorted({"leading_letter": "lead", **{k: k for k in LEADS}}.items()))
    return rf"""WITH t AS ({texts}),
n AS (SELECT conv_id, turn, replace(regexp_replace(said, '^\s+|\s+$', '', 'g'), '**', '') AS s FROM t),
e AS (SELECT conv_id, turn, lower(regexp_replace(trim(trim(s), '"'), '\.+$', '')) AS bare, {", ".join(marks)}, regexp_extract_all(s, '^\(?([A-D])(?:\)|\s*(?:[.,:;!]|$))', 1) AS lead,
  regexp_matches(s, '^\(?[A-D](?:\)\s*(?:/|or\b|and\b|,|->|→)|\s*,)\s*\(?[A-D]\)?(?:\W|$)') AS leading_other FROM n),
f AS (SELECT conv_id, turn, bare, lead, leading_other, {", ".join(folds)} FROM e),
g AS (SELECT *, list_distinct(list_concat(list_concat(lead, declaration), list_concat(pronoun_declaration, first_person_selection))) AS named, regexp_matches(bare, '^choice [0-3]$') AS option,
  CASE WHEN leading_other THEN 'ambiguous_alternatives' {" ".join(doubts)} END AS why FROM f),
h AS (SELECT *, coalesce(why, CASE WHEN len(named) > 1 THEN 'conflicting_declarations' WHEN len(named) = 0 THEN 'no_unambiguous_answer' END) AS reason FROM g)
SELECT conv_id, turn, CASE WHEN option THEN chr(65 + right(bare, 1)::INT) WHEN reason IS NULL THEN named[1] END AS answer,
  CASE WHEN option THEN 'exact_option_text' WHEN reason IS NOT NULL THEN reason ELSE array_to_string(list_filter([{kinds}], lambda k: k IS NOT NULL), '+') END AS rule FROM h"""


def parsed(texts: DataFrame) -> DataFrame:
    options = F.create_map(*[x for i, k in enumerate("ABCD") for x in (F.lit(k), F.lit(f"choice {i}"))])
    return texts.select("conv_id", "turn", text.parse_answer(F.col("said"), options).alias("a")).select("conv_id", "turn", "a.answer", "a.rule")


@query(answers_sql(f"SELECT conv_id, turn, {SAID} AS said FROM conversations"))
def parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(said(spark, sf_dir))


#: Answers of every form around the texts of the table: x is a letter from A to D, y the next one, k counts the forms.
FORMS = r"""CASE k WHEN 0 THEN 'The answer is (' || x || '). ' || text WHEN 1 THEN text || '. If so, the final answer is ' || x || '.' WHEN 2 THEN text || '. The best option: ' || x || ' or ' || y || '; maybe'
WHEN 3 THEN 'It is ' || x || '! ' || text WHEN 4 THEN 'I would go with ' || x || chr(10) || text || '. It’s ' || x WHEN 5 THEN x || '. ' || text WHEN 6 THEN x || ', ' || y || ' ' || text WHEN 7 THEN '  Choice ' || (conv_id % 4) || '.'
WHEN 8 THEN text WHEN 9 THEN 'The answer is not ' || x || '. ' || text WHEN 10 THEN 'The answer is ' || x || '. The final answer is ' || y || '. ' || text WHEN 11 THEN x || ') ' || text || '. I’d say ' || x || ', the order is ' || x || '.'
WHEN 12 THEN 'Not so.' || chr(10) || 'The correct choice would be ' || x WHEN 13 THEN '**' || x || '** ' || text WHEN 14 THEN 'I don’t think it’s ' || x || '. ' || text ELSE 'the answer is ' || x || chr(10) || 'for example the answer is ' || x || ' ' || text END"""
LETTERS = "(conv_id + turn) % 16 AS k, chr((65 + conv_id % 4)::INT) AS x, chr((65 + (conv_id + 1) % 4)::INT) AS y"


@query(answers_sql(f"SELECT conv_id, turn, {FORMS} AS said FROM (SELECT *, {LETTERS} FROM conversations)"))
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer rules over declarations, alternatives, hedges, conflicts and repeated options."""
    rows = table(spark, sf_dir, "conversations").selectExpr("*", "(conv_id + turn) % 16 AS k", "chr(65 + conv_id % 4) AS x", "chr(65 + (conv_id + 1) % 4) AS y")
    return parsed(rows.select("conv_id", "turn", F.expr(FORMS).alias("said")))


LINE_LEAD = r"^\s*(?:the\s+)?(?:correct\s+|final\s+)?(?:answer|option|choice)\s*(?:is\s*|[:：]\s*)"
LOOSE_END = r"(?:[\s.,:;!)]|$)"


@query(rf"""WITH t AS (SELECT conv_id, turn, {FORMS} AS said FROM (SELECT *, {LETTERS} FROM conversations)), n AS (SELECT conv_id, turn, replace(regexp_replace(said, '^\s+|\s+$', '', 'g'), '**', '') AS s FROM t),
e AS (SELECT conv_id, turn, s, lower(regexp_replace(s, '\.+$', '')) AS bare, list_distinct(list_concat(list_transform(regexp_extract_all(s, '(?im){LINE_LEAD}\(?([A-D])\)?{LOOSE_END}', 1), lambda x: x), regexp_extract_all(s, '^\(?([A-D])\)?{LOOSE_END}', 1))) AS l,
  regexp_matches(s, '^\(?[A-D]\)?\s*(?:/|or\b|and\b|,)\s*\(?[A-D]\)?(?:\W|$)') AS other FROM n)
SELECT conv_id, turn, CASE WHEN len(l) > 1 OR other THEN NULL WHEN len(l) = 1 THEN l[1] WHEN regexp_matches(bare, '^choice [0-3]$') THEN chr(65 + right(bare, 1)::INT) END AS answer FROM e""")
def declared_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rules over answers of every form."""
    rows = table(spark, sf_dir, "conversations").selectExpr("*", "(conv_id + turn) % 16 AS k", "chr(65 + conv_id % 4) AS x", "chr(65 + (conv_id + 1) % 4) AS y")
    options = F.create_map(*[x for i, k in enumerate("ABCD") for x in (F.lit(k), F.lit(f"choice {i}"))])
    return rows.select("conv_id", "turn", text.parse_declared(F.expr(FORMS), options).alias("answer"))


@query(f"""WITH j AS ({answers_sql(f"SELECT conv_id, turn, {SAID} AS said FROM conversations")}), u AS ({ORACLES["upstream_answer"]}), s AS ({ORACLES["strict_answer"]})
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN j.answer ELSE u.answer END AS answer, CASE WHEN conv_id % 2 = 0 THEN j.answer ELSE s.answer END AS strict FROM j JOIN u USING (conv_id, turn) JOIN s USING (conv_id, turn)""")
def dispatched_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset's rules, chosen row by row."""
    options = F.create_map(*[x for i, k in enumerate("ABCD") for x in (F.lit(k), F.lit(f"choice {i}"))])
    dataset = F.when(F.col("conv_id") % 2 == 0, "joint").otherwise("avspeaker")
    return said(spark, sf_dir).select("conv_id", "turn", text.read_answer(dataset, F.col("said"), options).alias("read")).select("conv_id", "turn", "read.answer", "read.strict")


@query(r"""SELECT c_custkey, [c_name, 'it''s "' || c_mktsegment || '"', 'é' || chr(10) || c_nationkey, c_nationkey::VARCHAR, 'None'] AS choices FROM customer""")
def choice_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as source text, with both quotes, escapes and bare numbers; broken ones are null and left out here."""
    rows = table(spark, sf_dir, "customer")
    source = F.concat(F.lit("['"), "c_name", F.lit("', 'it\\'s \"' '"), "c_mktsegment", F.lit("\"', \"\\u00e9\\n"), F.col("c_nationkey").cast("string"), F.lit("\", "), F.col("c_nationkey").cast("string"), F.lit(", None,]"))
    both = F.array(source, F.concat(source, F.lit("]")))
    # A small file is one row group, so rows are dealt before they are read; lists are filtered where they are made, as a filter behind would make them again.
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "c_custkey").select("c_custkey", both.alias("sources"))
    return dealt.select("c_custkey", F.explode(F.filter(F.transform("sources", text.choices_list), lambda c: c.isNotNull())).alias("choices"))
