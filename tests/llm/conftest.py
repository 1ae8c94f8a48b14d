import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, k string, score double, shard int, copies int, length long, id long, value long, part int"


def words(source, n, letters="abcdefgh"):
    return " ".join("".join(source.choice(letters) for _ in range(source.randint(2, 7))) for _ in range(n))


def odd_rows():
    source = random.Random(3)
    long = ". ".join(words(source, 30) for _ in range(1500))
    rows = [(1, "One two three. Four five six seven.", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n ", "de", "b"), (5, long, "en", "a"), (6, "!!! 123 ???", "en", None)]
    rows += [(7, "The same words are here again and again.", "fr", "c")] * 3 + [(8, "The same words are here again and again.", None, "c"), (None, "no id at all", "en", "a"), (None, "no id at all", "en", "a"), (9, "é ü ñ 漢字 \U0001f600 ß", "de", "c"), (10, "\u0000 nul �", "en", "é")]
    return [(i, t, lang, s, None, 1, 2, "k", 0.5, 3, 4, 5, 6, 7, 8) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns of names that operators use."""
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    return "/root/testdata/sf0.001"
