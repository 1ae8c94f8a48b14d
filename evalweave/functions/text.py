"""Text rules: time requests, notes, questions, and answers read from free text.

Patterns run on the JVM with the flags U (Unicode classes) and d (only a line feed ends a line). Case folding alone is
an Arrow UDF (casefold).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of time requests, in the current and the first version, and of the lines that notes leave out.
SEEK = r"(?imdU)^\s*SEEK\s*=\s*(-?\d+(?:\.\d+)?)(?=\s|[.;,]|$)"
SEEK_FIRST = r"(?imdU)^\s*SEEK\s*=\s*(-?\d+(?:\.\d+)?)\s*(?:s(?:ec(?:onds)?)?)?\s*$"
SEEK_LINE = r"(?imdU)^\s*SEEK\s*=.*$"
NOTE_CHARS = 1600
# The wrapper of a question.
QUESTION_MARK, WRAPPER_START, WRAPPER_END = "\nQuestion: ", "Select the best answer", "\nThe best answer is:"
# Patterns of answer declarations; the letter keeps its case in the first group of rules.
LETTER = r"\(?([A-D])\)?(?=\s|[.,:;!)]|$)"
LETTER_ONLY = r"\(?([A-D])"
DECLARATION = r"(?i:\b(?:the\s+)?(?:(?:correct|final|best|most\s+likely)\s+)?(?:answer|option|choice|order)\s*(?:is\s+|would\s+be\s+|[:：]\s*))" + LETTER
PRONOUN = r"(?i:\b(?:it['’]s|it\s+is)\s+)" + LETTER
SELECTION = r"(?i:\bI(?:['’]d|\s+would)?\s+(?:choose|select|pick|go\s+with|say)\s+)" + LETTER
LEADING = r"^\s*\(?([A-D])(?:\)|(?=\s*(?:[.,:;!]|$)))"
OTHER_LETTER = r"\s*(?:/|or\b|and\b|,|->|→)\s*\(?[A-D]\)?(?:\W|$)"
HEDGE = r"(?i)\b(?:if|suppose|example|not|never|don['’]t|isn['’]t)\b"
CODE_FENCE = r"^```(?:text)?\s*|\s*```$"
DECLARED_AT_LINE = r"(?im)^\s*(?:the\s+)?(?:correct\s+|final\s+)?(?:answer|option|choice)\s*(?:is\s*|[:：]\s*)\(?([A-D])\)?(?=\s|[.,:;!)]|$)"
LEADING_LOOSE = r"^\s*\(?([A-D])\)?(?=\s|[.,:;!)]|$)"
OTHER_LETTER_LOOSE = r"\s*(?:/|or\b|and\b|,)\s*\(?[A-D]\)?(?:\W|$)"
BARE = r"(?dU)\A[\(\[]?([A-D])[\)\]]?[.!]?\z"
STRICT_DECLARATION = r"(?idU)\b(?:the\s+)?(?:correct\s+|best\s+|final\s+)?(?:answer|option|choice)\s*(?:is\s*|[:：]\s*)[\(\[]?([A-D])[\)\]]?(?=[\s.,:;!]|$)"
STRICT_LEADING = r"(?dU)\A([A-D])(?:[.)：:]\s|[.)]$)"
STRICT_CONFLICT = r"(?dU)\b[A-D]\s*(?:or|and|/)\s*[A-D]\b"
# Prefixes that are taken out, in this order (two are long, as the list they come from joins them), and
# punctuation that counts as space.
ANSWER_PREFIXES = (
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
    "Answer:",
    "Option:",
    "The correct answer",
    "The correct option",
    "Based",
    "Correct answer",
    "\u261e",
    "<|im_end|>",
)
ANSWER_PUNCTUATION = r"[.,:!'\";/\?`~@#\$%\^&\*\(\)\[\]\{\}\\|<>\n]"

#: What Python calls white space beyond the Unicode property.
BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """A text without white space at its ends; a run of white space inside it is looked at once, whatever its length."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|(?<!{BLANK}){BLANK}+\z", "")


def seek(output: Column, duration: Column, fallback: Column, pattern: str = SEEK) -> Column:
    """struct<center,fallback,reason>: the one time that a text asks for, if it is in the clip; else the fallback."""
    asked = F.regexp_extract_all(F.coalesce(output, F.lit("")), F.lit(pattern), F.lit(1))
    value = F.get(asked, F.lit(0)).try_cast("double")
    good = F.coalesce((F.size(asked) == 1) & (value >= 0) & (value <= duration), F.lit(False))
    return F.struct(
        F.when(good, value).otherwise(fallback.cast("double")).alias("center"),
        (~good).alias("fallback"),
        F.when(good, F.lit("valid_model_request")).otherwise(F.lit("missing_ambiguous_or_out_of_range_request")).alias("reason"),
    )


def note(output: Column) -> Column:
    """A text without its time requests, at most 1600 characters."""
    return F.substring(strip(F.regexp_replace(output, SEEK_LINE, "")), 1, NOTE_CHARS)


def question(prompt: Column) -> Column:
    """The question inside a prompt: behind its mark, else without the wrapper's first line and end."""
    at = F.instr(prompt, QUESTION_MARK)
    behind = prompt.substr(at + len(QUESTION_MARK), F.length(prompt))
    rest = F.regexp_replace(F.when(F.instr(prompt, "\n") > 0, F.regexp_replace(prompt, r"(?d)\A[^\n]*\n", "")).otherwise(F.lit("")), r"(?d)\n\z", "")
    unwrapped = F.when(F.endswith(rest, F.lit(WRAPPER_END)), rest.substr(F.lit(1), F.length(rest) - len(WRAPPER_END))).otherwise(rest)
    return F.when(at > 0, behind).when(F.startswith(prompt, F.lit(WRAPPER_START)), unwrapped).otherwise(prompt)


def upstream_answer(text: Column) -> Column:
    """The first single letter among the words of a text without its prefixes; only A to D count."""
    bare = strip(text)
    for prefix in ANSWER_PREFIXES:
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    words = F.split(F.regexp_replace(bare, ANSWER_PUNCTUATION, " "), rf"(?U){BLANK}+")
    letter = F.get(F.filter(words, lambda w: w.isin("A", "B", "C", "D", "E")), F.lit(0))
    return F.when(letter != "E", letter)


def strict_answer(text: Column) -> Column:
    """A bare letter, or the only letter that a text declares or starts with, if it names no alternative."""
    inner = F.regexp_replace(F.replace(strip(text), F.lit("**"), F.lit("")), r"\A`+|`+\z", "")
    inner = strip(inner)
    bare = F.regexp_extract(inner, BARE, 1)
    declared = F.transform(F.regexp_extract_all(inner, F.lit(STRICT_DECLARATION), F.lit(1)), F.upper)
    leading = F.regexp_extract(inner, STRICT_LEADING, 1)
    letters = F.array_distinct(F.concat(declared, F.when(leading != "", F.array(leading)).otherwise(F.array().cast("array<string>"))))
    return F.when(bare != "", bare).when((F.size(letters) == 1) & ~F.rlike(inner, F.lit(STRICT_CONFLICT)), F.get(letters, F.lit(0)))


#: A character of a word as the answer rules see it: marks that combine and connectors other than _ don't count.
WORD_CHAR = r"[\p{L}\p{N}_]"


def java(pattern: str) -> str:
    """A part of a Java pattern; what it has matched isn't tried again in another way for what follows."""
    behind = WORD_CHAR + "{1,2}"  # what stands before is looked for in UTF-16 units, and a character may take two
    classes = {r"\s": BLANK, r"\W": r"[^\p{L}\p{N}_]", r"\b": rf"(?:(?<={behind})(?!{WORD_CHAR})|(?<!{behind})(?={WORD_CHAR}))"}
    return re.sub(r"\\[sWb]", lambda m: classes[m[0]], f"(?>{pattern})")


def on_jvm(*parts: str) -> str:
    return "(?dU)" + "".join(map(java, parts))


def named(text: Column, pattern: str) -> Column:
    """The letters that the matches of a pattern name, in order."""
    return F.regexp_extract_all(text, F.lit(on_jvm(pattern)), F.lit(1))


def unwrapped(text: Column) -> Column:
    """A text without code fence and bold marks; a null text is the word None, as the rules take whatever they get as text."""
    inner = F.regexp_replace(strip(F.coalesce(text, F.lit("None"))), on_jvm(rf"(?:\G|(?<!{BLANK}))(?:{CODE_FENCE})"), "")
    return F.replace(strip(inner), F.lit("**"), F.lit(""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def casefold(lists: pd.Series) -> pd.Series:
    """Full case folding (German sharp s becomes ss), which the JVM doesn't offer."""
    return lists.map(lambda texts: texts if texts is None else [t if t is None else t.casefold() for t in texts])


def option_said(text: Column, options: Column) -> Column:
    """The letter of the only option whose text this is but for case, spaces, outer quotes and dots at the end."""

    def bare(c: Column) -> Column:
        unquoted = F.regexp_replace(strip(c), "\\A[\"']+|(?<![\"'])[\"']+\\z", "")
        return F.regexp_replace(F.regexp_replace(unquoted, r"(?<!\.)\.+\z", ""), rf"(?U){BLANK}+", " ")

    options = F.coalesce(options, F.create_map().cast("map<string,string>"))
    # Folding makes one to three characters of one, so a text of more than three times an option's length isn't folded.
    longest = F.aggregate(F.map_values(options), F.lit(0), lambda n, v: F.greatest(n, F.length(v)))
    said = held(bare(text), lambda t: F.when(F.length(t) <= 3 * longest, t))
    folded = casefold(F.when(said.isNotNull(), F.concat(F.array(said), F.transform(F.map_values(options), bare))))
    rows = F.arrays_zip(F.map_keys(options).alias("letter"), F.slice(folded, 2, F.size(options)).alias("option"), F.array_repeat(F.get(folded, F.lit(0)), F.size(options)).alias("said"))
    same = F.filter(rows, lambda r: r["option"] == r["said"])
    return F.when(F.size(same) == 1, F.get(same, F.lit(0))["letter"])


def marks(text: Column, pattern: str) -> Column:
    """What decides about the matches of a pattern, in order of the text: matches (with an alternative behind them), hedges, ends of clauses.

    One scan finds them all: no match begins inside a hedge or an end, and both begin where a word does. An alternative is
    taken in with its match, for behind the first one nothing counts any more.
    """
    start = rf"(?<![A-Za-z0-9])(?<!{WORD_CHAR}{{1,2}})"  # the first condition only spares the second at most places
    match, hedge = (java(p.replace(r"\b", "", 1)) for p in (pattern, f"(?:{HEDGE})"))
    return F.regexp_extract_all(text, F.lit(f"(?dU)(?:{start}(?:{match}(?:{java(OTHER_LETTER)})?|{hedge})|[.!?;\n])"), F.lit(0))


def is_match(mark: Column) -> Column:
    """Whether a mark is a match: those end with a letter from A to D or a sign, which hedges don't, and aren't one character long."""
    return (F.length(mark) > 1) & ~F.rlike(mark, F.lit(r"[fertFERT]\z"))


def doubt(found: Column, pattern: str) -> Column:
    """Why the first doubtful match among marks is doubtful: an alternative behind it, or else a hedge before it in its clause."""

    def step(state: Column, mark: Column) -> Column:
        match = is_match(mark)
        why = F.when(match & F.rlike(mark, F.lit(on_jvm(rf"\A(?:{pattern})", OTHER_LETTER))), F.lit("ambiguous_alternatives")).when(match & state["hedged"], F.lit("qualified_or_negated_declaration"))
        # A match may run over the end of a line.
        hedged = F.when(match, state["hedged"] & ~F.contains(mark, F.lit("\n"))).otherwise(F.length(mark) > 1)
        return F.struct(hedged.alias("hedged"), F.coalesce(state["why"], why).alias("why"))

    start = F.struct(F.lit(False).alias("hedged"), F.lit(None).cast("string").alias("why"))
    return F.aggregate(found, start, step, lambda state: state["why"])


#: Kinds of declarations; doubts count in this order.
DECLARATIONS = {"declaration": DECLARATION, "pronoun_declaration": PRONOUN, "first_person_selection": SELECTION}


def parse_answer(text: Column, options: Column) -> Column:
    """struct<answer,rule>: the option that a text repeats; else the one letter that it declares without doubt.

    options: map<string,string> from letter to text. Without an answer, the rule says why.
    """
    option = option_said(unwrapped(text), options)
    read = held(unwrapped(text), lambda said: held(F.struct(said.alias("said"), *[marks(said, pattern).alias(kind) for kind, pattern in DECLARATIONS.items()]), judged))
    return held(F.struct(option.alias("option"), read.alias("read")), lambda v: F.struct(F.coalesce(v["option"], v["read"]["answer"]).alias("answer"), F.when(v["option"].isNotNull(), F.lit("exact_option_text")).otherwise(v["read"]["rule"]).alias("rule")))


def held(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def letters_of(found: Column, pattern: str) -> Column:
    """The letters that the matches among marks name."""
    return F.transform(F.filter(found, is_match), lambda m: F.regexp_extract(m, on_jvm(rf"\A(?:{pattern.replace(LETTER, LETTER_ONLY)})"), 1))


def judged(read: Column) -> Column:
    """struct<answer,rule> of a text (said) and its marks by kind."""
    letters = {"leading_letter": named(read["said"], LEADING)} | {kind: letters_of(read[kind], pattern) for kind, pattern in DECLARATIONS.items()}
    alternative = F.when(F.rlike(read["said"], F.lit(on_jvm(LEADING, OTHER_LETTER))), F.lit("ambiguous_alternatives"))
    reason = F.coalesce(alternative, *[doubt(read[kind], pattern) for kind, pattern in DECLARATIONS.items()])

    def of(v: Column) -> Column:
        kinds = F.filter(F.array(*[F.when(F.size(v[kind]) > 0, F.lit(kind)) for kind in sorted(letters)]), lambda k: k.isNotNull())
        different = F.array_distinct(F.concat(*[v[kind] for kind in letters]))
        why = F.coalesce(v["reason"], F.when(F.size(different) > 1, F.lit("conflicting_declarations")).when(F.size(different) == 0, F.lit("no_unambiguous_answer")))
        return F.struct(F.when(why.isNull(), F.get(different, F.lit(0))).alias("answer"), F.coalesce(why, F.array_join(kinds, "+")).alias("rule"))

    return held(F.struct(reason.alias("reason"), *[found.alias(kind) for kind, found in letters.items()]), of)


def parse_declared(text: Column, options: Column) -> Column:
    """The older rules: one letter, declared at the start of a line or leading the text; else the option that it repeats."""
    said = unwrapped(text)
    letters = F.array_distinct(F.concat(named(said, DECLARED_AT_LINE), named(said, LEADING_LOOSE)))
    doubtful = (F.size(letters) > 1) | F.rlike(said, F.lit(on_jvm(LEADING_LOOSE, OTHER_LETTER_LOOSE)))
    return F.when(~doubtful, F.coalesce(F.get(letters, F.lit(0)), option_said(said, options)))


def read_answer(dataset: Column, text: Column, options: Column) -> Column:
    """struct<answer,strict> by the rules of the question's dataset: joint, or else avspeaker. Keep it in a column and take its fields from there."""
    joint = parse_answer(F.when(dataset == "joint", text), options)["answer"]
    other = F.when(dataset == "joint", None).otherwise(text)
    rules = F.struct(joint.alias("joint"), upstream_answer(other).alias("first"), strict_answer(other).alias("strict"))
    known = text.isNotNull()
    pick = lambda r, field: F.when(known, F.when(dataset == "joint", r["joint"]).otherwise(r[field]))
    return held(rules, lambda r: F.struct(pick(r, "first").alias("answer"), pick(r, "strict").alias("strict")))


def cluster_key(video_name: Column, clip_path: Column) -> Column:
    """The video's name, else the clip's file name without its last two parts."""
    return F.coalesce(video_name, F.regexp_replace(F.substring_index(clip_path, "/", -1), r"(?:_[^_]*){1,2}$", ""))


# Literals of lists of strings, whole numbers and names of constants, as source text.
SINGLE = r"""'(?:'(?!')|(?:[^'\\\n]|\\.)++')"""
QUOTED = f"(?:{SINGLE}|{SINGLE.replace(chr(39), chr(34))})"
GAP = r"(?:[ \t\n\r\f]|\\\n)*+"
ITEM = f"(?:(?:{QUOTED}{GAP})++|-?[0-9]++|None|True|False)"
LIST = rf"(?s)\A[ \t]*+\[{GAP}(?:{ITEM}{GAP}(?:,{GAP}{ITEM}{GAP})*+(?:,{GAP})?+)?+\]{GAP}\z"
PIECE = r"(?s)\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)|[^\\]++"
#: What a backslash and one character stand for; any other stays as it is, and x, u, U and N need more behind them.
ESCAPES = {"\n": "", "\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def unescaped(body: Column) -> Column:
    """What the inside of a quoted string stands for; null if an escape isn't whole."""
    known = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])
    of_code = lambda digits: F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")

    def meant(p: Column) -> Column:
        kind, rest = F.substring(p, 2, 1), F.substring(p, 3, 8)
        coded = F.when(kind.isin("x", "u", "U"), F.when(F.length(p) > 2, of_code(rest))).when(F.rlike(kind, F.lit("[0-7]")), of_code(F.conv(F.substring(p, 2, 3), 8, 16)))
        plain = F.coalesce(F.try_element_at(known, kind), p)
        return F.when(~F.startswith(p, F.lit("\\")), p).when(kind.isin("x", "u", "U", "0", "1", "2", "3", "4", "5", "6", "7"), coded).when(kind != "N", plain)

    pieces = F.transform(F.regexp_extract_all(body, F.lit(PIECE), F.lit(0)), meant)
    return F.when(~F.contains(body, F.lit("\\")), body).otherwise(joined(pieces))


def joined(parts: Column) -> Column:
    """The parts as one text, null if one of them is."""
    return held(parts, lambda ps: F.when(F.forall(ps, lambda p: p.isNotNull()), F.array_join(ps, "")))


def choices_list(text: Column) -> Column:
    """Options from a list written as source text: strings of either quotes (several in a row are one), whole numbers, None, True, False.

    Null for anything else, names of characters (\\N) and prefixes of strings included.
    """
    items = F.when(F.rlike(text, F.lit(LIST)), F.regexp_extract_all(text, F.lit(f"(?s){ITEM}"), F.lit(0)))

    def read(item: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(item, F.lit(f"(?s){QUOTED}"), F.lit(0)), lambda q: unescaped(q.substr(F.lit(2), F.length(q) - 2)))
        number = F.regexp_replace(item, r"\A(-?)0+(?=0)", "$1")
        return F.when(F.rlike(item, F.lit("\\A['\"]")), joined(parts)).when(item == "-0", "0").when(~F.rlike(number, F.lit(r"\A-?0[0-9]")), number)

    # Each step's result is held, or what asks whether all of it is there would compute it again, and that at every level.
    return held(F.transform(items, read), lambda found: F.when(F.forall(found, lambda x: x.isNotNull()), found))


def out_of_memory(error: Column) -> Column:
    return F.contains(F.lower(error), F.lit("out of memory"))


def exit_code(status: Column, error: Column) -> Column:
    """0 for a good record, 42 if memory ran out, else 1."""
    return F.when(status == "ok", 0).when(F.coalesce(out_of_memory(error), F.lit(False)), 42).otherwise(1)
