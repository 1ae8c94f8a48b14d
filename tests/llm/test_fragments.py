"""The n-gram join, vector codes and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from conftest import words

from evalweave.llm import filter_audit, fragment_join, oracles, vector_codes
from evalweave.llm import queries as llm_queries


def gram_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def plain_components(rows, width, percent):
    sets = [(i, gram_set(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return sorted((i, len(s), root(i)) for i, s in sets)


def family(source, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(source.randint(0, edits)):
            at = source.randrange(len(w))
            w[at : at + source.randint(0, 2)] = [words(source, 1)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 60), (1, 100)])
def test_components_of_all_pairs(spark, width, percent):
    """Families of every size from a few words on, edited lightly and heavily, texts that hold others, and copies."""
    source = random.Random(width * 1000 + percent)
    texts = []
    for size in (1, 2, 3, 6, 9, 11, 12, 14, 19, 25, 40, 60, 120, 400):
        texts += family(source, words(source, size), 9, max(1, size // 20))
    base = words(source, 70)
    texts += [f"{base} {words(source, n)}" for n in range(1, 16, 2)] + [base] * 4 + [base.upper(), "", None, "  ", "a", "a"]
    # Few different words: n-grams that most texts hold, and segments without any.
    texts += [" ".join(source.choice("ab") for _ in range(source.randint(3, 14))) for _ in range(60)]
    source.shuffle(texts)
    rows = list(enumerate(texts, 100))
    got = fragment_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, width, percent)


def test_empty_segments_lose_nothing():
    """Any two sets that are alike are listed under a common value, also if only empty segments agree."""
    source = np.random.default_rng(5)
    cuts = fragment_join.Cuts(90)
    met_by_prefix = 0
    for _ in range(3000):
        n = int(source.integers(10, 40))
        differing = int(source.integers(0, max(1, n // 10)))
        union = np.unique(source.integers(0, 2**64, n + differing, dtype=np.uint64))
        # Some sets live in a part of the range only, which leaves fragments empty.
        union = union >> np.uint64(source.integers(0, 3))
        a, b = union[: len(union) - differing], union
        if 100 * len(a) < 90 * len(b):
            continue
        values = []
        for s in (a, b):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(fragment_join.mix(s))))
            k = cuts.of(len(s))
            own, up = (set(fragment_join.listed(s, sums, c, cuts).tolist()) if cuts.fragments(c) > 1 else set() for c in (k, k + 1))
            values.append((k, own, up))
        (k, own, up), (m, other, other_up) = values
        if np.array_equal(a, b):
            continue
        common = own & other if k == m else up & other if m == k + 1 else other_up & own
        assert common
        met_by_prefix += len(common) > 0 and bool((np.diff(np.concatenate(([0], np.searchsorted(b, cuts.edges(cuts.fragments(m))), [len(b)]))) == 0).any())
    assert met_by_prefix > 100


def test_parities_are_a_bound():
    source = np.random.default_rng(6)
    for _ in range(200):
        x = np.unique(source.integers(0, 2**64, 300, dtype=np.uint64))
        y = np.unique(np.concatenate((x[source.integers(0, 40):], source.integers(0, 2**64, source.integers(0, 40), dtype=np.uint64))))
        for count in (1, 4, 16):
            p, q = (fragment_join.parities(s, count).view(np.uint64) for s in (x, y))
            assert sum(int(v).bit_count() for v in p ^ q) <= len(np.setxor1d(x, y))


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(fragment_join, "AT_ONCE", 3)
    source = random.Random(8)
    base = words(source, 60)
    rows = list(enumerate(family(source, base, 80, 8)))
    got = fragment_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 3, 90)


def test_join_of_odd_rows(spark, odd, empty):
    got = fragment_join.ngram_components(odd, 3, 90)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] in (7, 8)} == {(7, 7), (8, 7)}
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert fragment_join.ngram_components(empty, 3, 90).collect() == []


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: vec_id, vector of Python floats or None. code, error by vec_id, and all entries."""
    import math

    kept = {i: [math.floor(4096 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = len(next(iter(kept.values()))) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(kept[i], p) for i in sorted(kept)[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            members = {}
            for v in kept.values():
                members.setdefault(assign(v, p)[1], []).append(cut(v, p))
            fresh.append([[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else c for e, c in enumerate(books[p])])
        books = fresh
    out = {i: [assign(v, p) for p in range(parts)] for i, v in kept.items()}
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    return {i: ("".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a)) for i, a in out.items()}, hashlib.sha256(numbers.encode()).hexdigest()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, numbers int, code string, error long")


@pytest.mark.parametrize("n", [3, 40, 200])
def test_codes_against_a_plain_version(spark, n, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    source = np.random.default_rng(n)
    data = [(int(i), [float(x) for x in source.normal(0, 1, 24).astype(np.float32)], int(i) % 3 if i % 5 else None) for i in source.permutation(n)]
    data += [(1000, None, 1), (1001, [float("nan")] * 24, 1), (1002, [None] * 24, 1), (1003, [float("inf")] + [0.0] * 23, None), (1004, [], 1), (1005, [0.5] * 16, 1)]
    df = vectors(spark, [(i, v, k, 0, "x", 9) for i, v, k in data]).repartition(4)
    got = vector_codes.compress(df).collect()
    want, books = plain_codes([(i, v) for i, v, _ in data if i < 1000])
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} == {books}
    labels = {i: k for i, _, k in data}
    totals = {}
    for i, (_, error) in want.items():
        totals[labels[i]] = totals.get(labels[i], 0) + error
    assert all(r["label_error"] == totals[labels[r["vec_id"]]] for r in got)


def test_codes_of_odd_rows(spark):
    none = vectors(spark, [])
    assert vector_codes.compress(none).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, [1.0] * 9, 1, 0, "", 0)])).collect() == []
    rows = [(None, [0.25] * 8, 1), (1, [1.0] * 8, 1), (1, [2.0] * 8, None), (2, [1e30] * 8, None)]
    got = vector_codes.compress(vectors(spark, [(i, v, k, 0, "", 0) for i, v, k in rows])).collect()
    assert len(got) == 4
    # Rows 1 (label null) and 2 share their label; rows null and 1 (label 1) share theirs.
    by_id = {i: [r for r in got if r["vec_id"] == i] for i in (None, 1, 2)}
    assert by_id[2][0]["label_error"] - by_id[2][0]["error"] in {r["error"] for r in by_id[1]}
    assert by_id[None][0]["label_error"] - by_id[None][0]["error"] in {r["error"] for r in by_id[1]}


def audit_sql(spark, docs, labels):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    con.register("labels", labels.toArrow())
    return sorted(map(tuple, con.execute(oracles.OP13).fetchall()))


def test_audit_of_copies_over_tasks(spark):
    """A text that most rows hold, with ids in any order, over more tasks than texts; and the boundaries of every task."""
    source = random.Random(4)
    texts = ["same text", "Same Text", "", None, "a # b", "UPPER CASE ONLY", "w " * 300, " ".join(map(str, range(250)))]
    rows = [(i, source.choice(texts[:3] + texts), source.choice(["a", "b", None])) for i in range(400)]
    rows += [(i, "same text", "a") for i in range(1000, 1600)]
    source.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 1600, 2)], "doc_id long, quality int, toxic int")
    masks = {r["doc_id"]: r["mask"] for r in filter_audit.failure_masks(docs).collect()}
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", i), i)
    assert all((masks[i] & 16 > 0) == (i > least[t or ""]) for i, t, _ in rows)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(docs, labels).select(*columns)
    assert sorted(map(tuple, got.collect())) == audit_sql(spark, docs, labels)


def test_audit_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = filter_audit.failure_masks(odd).collect()
    assert len(rows) == odd.count()
    duplicates = [r["doc_id"] for r in rows if r["mask"] & 16]
    assert sorted(duplicates) == [3, 8]
    got = filter_audit.audit(odd, labels).collect()
    assert len(got) == 600 * len({r["part"] for r in rows})
    assert "" in {r["part"] for r in got}
    assert filter_audit.audit(empty, labels).collect() == []


def test_new_queries_are_registered():
    assert {"op11_fragment_join", "op12_vector_codes", "op13_filter_audit"} <= set(llm_queries.queries()) & set(llm_queries.oracle_sql())
