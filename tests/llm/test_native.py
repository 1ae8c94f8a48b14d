"""Operators that are DataFrame operations only: curriculum, shards, version sketches."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from evalweave.llm.curriculum import curriculum
from evalweave.llm.iblt_versions import compare_versions, digests
from evalweave.llm.ring_shards import ring_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:8], 16)


def plans(df):
    return df._jdf.queryExecution().toString()


def targets_by_rounds(sizes, budget=1.5):
    """Shares by weight; what is above twice a source's words is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, budget * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in open_}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def taken_by_hand(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target, out = targets_by_rounds(sizes), Counter()
    for s in sizes:
        at = 0
        for _, i, n in sorted((digest(i), (i is None, i or 0), len(WORD.findall(t or ""))) for i, t, x in rows if x == s):
            out[None if i[0] else i[1], n, sizes[s], round(target[s], 6), n * sum(at + n / 2 + k * sizes[s] < target[s] for k in range(2))] += 1
            at += n
    return out


def check_mix(df):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    got = curriculum(df).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == taken_by_hand(rows)
    return got


def test_mix(spark, odd, empty, corpus):
    check_mix(odd)
    assert curriculum(empty).count() == 0
    got = check_mix(spark.read.parquet(f"{corpus}/documents.parquet"))
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert all(r["taken"] <= 2 * r["size"] and len(r["positions"]) * r["size"] == r["taken"] for r in got)
    assert "Python" not in plans(curriculum(odd))


def test_mix_of_one_source_and_hot_rows(spark):
    rows = [(1, "a b c", "s")] * 40 + [(i, "w " * (i % 9), ["s", "t", None][i % 3]) for i in range(2, 60)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    check_mix(spark.createDataFrame([(i, "a b", "only") for i in range(9)], "doc_id long, text string, source string"))


def check_shards(df, shards=40):
    got = ring_shards(df, shards).collect()
    rows = df.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["slot"])
    counts = [len(held[s]) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    return {r["doc_id"]: r["shard"] for r in got}, got


def test_shards(spark, odd, empty):
    check_shards(odd, 3)
    check_shards(odd)
    assert ring_shards(empty).count() == 0
    with pytest.raises(ValueError):
        ring_shards(odd, 0)
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    before, got = check_shards(df)
    after, _ = check_shards(df, 41)
    assert sum(r["moved"] for r in got) / 4000 < 0.15
    assert sum(before[i] != after[i] for i in before) / 4000 < 0.2
    assert sorted(ring_shards(df.repartition(3)).collect()) == sorted(got)
    assert "Python" not in plans(ring_shards(odd))


def test_shards_hot_row(spark):
    rows = [(1, "copy")] * 500 + [(i, "t") for i in range(2, 700)]
    check_shards(spark.createDataFrame(rows, "doc_id long, text string"))


PARAGRAPH = re.compile(r"\n+|(?:(?<=[.!?…|])|(?<=[.!?…|][\"'”’»)\]]))[ \t\n\x0b\f\r]+")


CHECK, KEY = (1 << 24) - 1, (1 << 63) - (1 << 24)


def checked(key):
    return key | xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42) & CHECK


def places(digest):
    return [4 * j + (digest >> (24 + 2 * j) & 3) for j in range(3)]


def drawn(text):
    """The fingerprint by hand."""
    members = {checked(xxhash.xxh64_intdigest(p.encode(), 42) & KEY) for p in paragraphs(text)}
    level = 0
    while 8 << level < len(members):
        level += 1
    cells = [0] * (12 << level)
    for d in members:
        for at in places(d):
            cells[12 * (d >> (63 - level)) + at] ^= d
    return "".join(f"{x:016X}" for x in cells)


def shown(written):
    """The digests that a fingerprint shows when it is peeled; None if that gets stuck."""
    cells, found = [int(written[i : i + 16], 16) for i in range(0, len(written), 16)], set()
    for start in range(0, len(cells), 12):
        block = cells[start : start + 12]
        while pure := next((x for x in block if x and x == checked(x & KEY)), None):
            found.add(pure)
            for at in places(pure):
                block[at] ^= pure
        if any(block):
            return None
    return found


def paragraphs(text):
    return {p for p in PARAGRAPH.split(text) if p}


def alike(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check_versions(df):
    docs = {(r["doc_id"], r["text"] or "") for r in df.collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), hashlib.md5(f"{'' if d[0] is None else d[0]}:{d[1]}".encode()).hexdigest()))
    want, prints = {}, {}
    for i, (k, text) in enumerate(order):
        after, third = order[(i + 1) % len(order)][1], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        prints[k, len(text)] = (drawn(text), drawn(edited))
        want[k, len(text), hashlib.sha256(edited.encode()).hexdigest()] = (alike(paragraphs(text), paragraphs(edited)), alike(paragraphs(text), paragraphs(after)))
    got = compare_versions(df).collect()
    assert len(got) == df.count()
    for r in got:
        near = want[r["doc_id"], r["n_chars"], r["edited_sha256"]]
        assert near == pytest.approx((r["near_edited"], r["near_next"]), abs=1e-12)
        assert r["edited_tries"] >= 1 and r["next_tries"] >= 1
        if sum(k == (r["doc_id"], r["n_chars"]) for k in ((i, len(t)) for i, t in docs)) == 1:
            assert prints[r["doc_id"], r["n_chars"]] == (r["fingerprint"], r["edited_fingerprint"])
        a, b = shown(r["fingerprint"]), shown(r["edited_fingerprint"])
        if a is not None and b is not None:
            assert r["near_edited"] == pytest.approx(alike(a, b), abs=1e-12)
    return got


def test_versions(spark, odd, empty):
    got = check_versions(odd)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (7, 8)}
    assert len(same) == 1
    assert compare_versions(empty).count() == 0
    assert "Python" not in plans(compare_versions(odd))


def test_versions_retry_larger(spark):
    source = random.Random(1)
    text = lambda n: "".join(f"{source.getrandbits(40):x}a.\n" for _ in range(n))
    base = text(60)
    rows = [(1, base), (2, base + text(3)), (3, text(400)), (4, base + text(20)), (5, text(1)), (6, "")]
    check_versions(spark.createDataFrame(rows, "doc_id long, text string"))
    check_versions(spark.createDataFrame([(1, text(5))], "doc_id long, text string"))


@pytest.mark.parametrize("sentences", [["It was so.", "We saw two!", "In 1999.", "By the USA.", "(So they say.)", "“Why not?”", "Wow!!!", "End z."], ["Это первое.", "Вот второе?", "А это третье!"], ["Αυτό είναι.", "Και τώρα."], ["هل هذا؟", "نعم."], ["यह है।", "वह था।"], ["a x |", "b 7 |", "c é |"]])
def test_every_sentence_is_a_paragraph(spark, sentences):
    df = spark.createDataFrame([(" ".join(sentences),)], "text string")
    assert df.select(F.size(digests(F.col("text")))).first()[0] == len(sentences)


def test_wide_marks_and_edits_of_a_third(spark):
    df = spark.createDataFrame([("这是一。那是二！「为什么？」三。",)], "text string")
    assert df.select(F.size(digests(F.col("text")))).first()[0] == 4
    rows = [(2, " ".join(f"Это номер {i}." for i in range(100, 130))), (1, "x" * 900)]
    got = {r["doc_id"]: r for r in compare_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["near_edited"] > 0.4
