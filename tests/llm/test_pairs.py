"""Near-duplicates, components and packing, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import words
from evalweave.llm.components import components
from evalweave.llm.near_dedup import near_components, size_class
from evalweave.llm.packing import WordIds, pack, place, plan_bins
from evalweave.llm.queries import tokenizer_path
from evalweave.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def joined(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def by_brute_force(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return joined(links, {i for i, _ in sets})


def check_near(spark, rows, width=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_brute_force(rows, width, percent)
    got = near_components(df, width, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingles(t, width))) for i, t in rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def family(source, ids, n, most):
    base = words(source, n).split()
    out = []
    for i in ids:
        w = list(base)
        for _ in range(source.randint(0, most)):
            w[source.randrange(len(w))] = words(source, 1)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_families(spark, width, percent):
    """Families around the threshold, shorter and longer than a sketch, with a common passage in many others."""
    source = random.Random(width)
    common = words(source, 25)
    rows = family(source, range(0, 40), 60, 6) + family(source, range(40, 70), 400, 30) + family(source, range(70, 80), 12, 1)
    rows += [(100 + i, f"{words(source, 20)} {common} {words(source, 20)}") for i in range(40)]
    rows += [(200 + i, common) for i in range(15)] + [(300 + i, " ".join(common.split()[: 3 + i])) for i in range(15)]
    source.shuffle(rows)
    check_near(spark, rows, width, percent)


@pytest.mark.parametrize(("width", "percent", "sizes"), [(3, 85, [(186, 218), (188, 221)]), (5, 80, [(164, 205), (168, 210), (171, 213)])])
def test_near_subset_beside_hot_copies(spark, width, percent, sizes):
    """A text of 8 copies, so that its values are hot, and one document that adds its own words to it."""
    source, rows = random.Random(percent), []
    for small, large in sizes:
        base = [f"w{source.getrandbits(60)}" for _ in range(small + width - 1)]
        own = [f"o{source.getrandbits(60)}" for _ in range(large - small)]
        rows += [(100 * small + i, " ".join(base)) for i in range(8)] + [(100 * small + 50, " ".join(base + own))]
    check_near(spark, rows, width, percent)


@pytest.mark.parametrize(("width", "percent", "common"), [(3, 85, 0.855), (5, 80, 0.81)])
def test_near_long_texts_that_contain_each_other(spark, width, percent, common):
    """Base texts of 800 shingles with 9 variants that add their own words: the base's values are hot, the others not."""
    source, rows = random.Random(percent), []
    for f in range(12):
        base = [f"w{source.getrandbits(60)}" for _ in range(800 + width - 1)]
        own = math.floor(800 / common) - 800
        rows += [(100 * f, " ".join(base))] + [(100 * f + i, " ".join(base + [f"o{source.getrandbits(60)}" for _ in range(own)])) for i in range(1, 10)]
    check_near(spark, rows, width, percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80), (3, 100)])
def test_near_texts_of_common_passages(spark, width, percent):
    """Texts that are all passages which others hold too, some many times over: lists of hot values, sets of many sizes."""
    source = random.Random(7 * percent + width)
    passages = [words(source, source.randint(6, 14)) for _ in range(30)]
    often = [1 / (1 + i) for i in range(len(passages))]
    rows = [(i, " ".join(source.choices(passages, often, k=source.randint(2, 30)))) for i in range(240)]
    rows += [(1000 + i, f"{t} {words(source, source.randint(0, 6))}") for i, t in rows[:60]]
    check_near(spark, rows, width, percent)


def test_size_classes_of_sets_that_may_link(spark):
    """Largest and smallest sizes that the threshold lets link are at most one class apart."""
    for percent in (50, 80, 85, 99, 100):
        n = [x for small in range(1, 3000) for x in (small, small * 100 // percent)]
        found = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(n)], "i long, n int").orderBy("i").select(size_class(percent)).collect()]
        assert all(0 <= found[i + 1] - found[i] <= 1 for i in range(0, len(n), 2))


def test_near_odd_and_empty(spark, odd, empty):
    check_near(spark, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert near_components(odd, 3, 85).count() == odd.count()
    assert near_components(empty).count() == 0
    check_near(spark, [(1, "a"), (2, "A"), (3, "a b"), (4, "b a"), (5, "a b"), (6, "a  b"), (7, None)])


def test_shingle_hashes_stand_for_shingles():
    texts = [words(random.Random(i), i, "aBc") for i in range(0, 60)] + [None, "", "x", "X  y"]
    known = {}
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        assert len(s) == len(shingles(t, 3)) and (np.diff(s.astype(float)) >= 0).all()
        known.setdefault(frozenset(shingles(t, 3)), set()).add(s.tobytes())
    assert all(len(v) == 1 for v in known.values()) and len({next(iter(v)) for v in known.values()}) == len(known)


def test_components(spark):
    source = random.Random(2)
    pairs = [(source.randrange(300), source.randrange(300)) for _ in range(220)] + [(400, k) for k in range(401, 460)] + [(k, k + 1) for k in range(500, 540)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = joined(pairs, {i for p in pairs for i in p})
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert all(want[i] == c for i, c in got.items()) and {i for p in pairs if p[0] != p[1] for i in p} == set(got)
    assert components(df.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=12))))
def test_plan_fills_without_overlap(case):
    capacity, counts = case
    filled, used, large = defaultdict(set), Counter(), Counter()
    for length, first_rank, n, first, each, offset in plan_bins(counts, capacity):
        assert first_rank == used[length]
        used[length] += n
        for i in range(n):
            cells = set(range(offset + i % each * length, offset + i % each * length + length))
            assert not filled[first + i // each] & cells and max(cells) < capacity
            filled[first + i // each] |= cells
            large[first + i // each] += 3 * length > capacity
    assert used == Counter(counts)
    assert all(v == set(range(len(v))) for v in filled.values()) and max(large.values(), default=0) <= 2
    assert sum(len(v) + 0 for v in filled.values()) == sum(k * v for k, v in counts.items())


def test_word_ids_are_the_tokenizers():
    w = WordIds(tokenizer_path())
    texts = ["", "  ", "Hello, World. don't It's 3,14 x.y ...", "ΣΑΣ Σ É é ﬁ İ", "a\u0085b c\td\x1ce", "<|endoftext|> <|startoftext|>x", "漢字 \U0001f600😀 ***a.*** b,,", "µ ª ß ÿ Ÿ", words(random.Random(1), 500)]
    got = list(w.stream(texts)) + list(w.stream(texts))
    want = [np.array(w.encode([t], w.whole)[0].ids, "<u4").tobytes() for t in texts]
    assert got == want + want


def check_packed(df, capacity):
    w = WordIds(tokenizer_path())
    got = pack(df, tokenizer_path(), capacity).collect()
    want, bins = Counter(), defaultdict(list)
    for r in df.collect():
        ids = w.ids([r["text"] or ""])[0] + (1).to_bytes(4, "little")
        for k in range(0, len(ids), 4 * capacity):
            part = ids[k : k + 4 * capacity]
            want[r["doc_id"], k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in got) / capacity


def test_packing(spark, odd, empty, corpus):
    check_packed(odd, 4096)
    check_packed(odd, 7)
    assert pack(empty, tokenizer_path()).count() == 0
    used, least = check_packed(spark.read.parquet(f"{corpus}/documents.parquet"), 4096)
    assert used <= least * 1.02 + 1


def test_one_length_holds_most_rows(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 40, id % 60 + 1) as length", "id as ids_crc32")
    got = place(pieces, 64).collect()
    spots = Counter((r["sequence_id"], p) for r in got for p in range(r["offset"], r["offset"] + r["length"]))
    assert len(got) == 5000 and max(spots.values()) == 1
