"""Operators that learn, extract or store: main text, text scores, quality, media, language, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import words
from evalweave.llm import context_tree as tree
from evalweave.llm.attention_quality import Attention, features, fit_quality, with_quality
from evalweave.llm.common import crc_of_id
from evalweave.llm.gru_language import SEGMENT, WARM, Gru, Network, fit_language, with_language
from evalweave.llm.main_text import Page, main_text
from evalweave.llm.motion_jpeg import clip_rows, padded, read_back, read_media, shot_starts, store, store_media
from evalweave.llm.queries import op5_attention_quality, op9_gru_language
from evalweave.llm import text_scores as text_scores_module
from evalweave.llm.text_scores import text_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

PAGE = """<html><head><title>no</title><style>p{x}</style></head><body><div class="site-header">Home <a href="/">x</a></div><nav><li>menu</nav>
<div class="post-%d"><h1>Head &amp; more</h1><p>First  <b>bold</b> text,<br>a line.<p>Second &lt;p&gt;</p><div class="ad">Buy</div><aside>side</aside>
<form><input>send</form><script>var t="</p>";</script><!-- note --><section id="comments"><p>reader</p></section><ul><li>one<li>two</ul></div>
<div class="cookie-notice">We use</div><footer>foot</footer></body></html>"""
ARTICLE = "Head & more\nFirst bold text, a line.\nSecond <p>\none\ntwo"


def test_page_blocks():
    page = Page(PAGE % 17)
    assert page.votes()[0][0] == ">html>body>div.post-#"
    assert page.text(None) == page.text(">html>body>div.post-#") == ARTICLE
    for broken in ("", "plain", "<", "<p", "<div><p>open <b>never", "</div></p>", "<!-- open", "<script>open", "a < b & c &#x41; &nope;", "<p>" * 5000 + "x"):
        assert "\n\n" not in Page(broken).text(None)
    assert Page("a < b & c &#x41;").text(None) == "a < b & c A"


@pytest.mark.parametrize("wrap", [
    '<div class="content has-sidebar">%s</div><p>foot of page</p>', '<div class="layout no-sidebar">%s</div><p>foot</p>', '<div id="post-comments-off">%s</div><p>foot</p>', '<main><div class="no-comments post">%s</div></main>',
    '<div class="pageWithSidebar">%s</div>', '<div class="widget"><h1>Head</h1>%s</div>', '<div class="menu-open"><div class="post">%s</div></div>',
])
def test_states_of_a_layout_are_no_furniture(wrap):
    article = "<p>" + "The article goes on for a while. " * 8 + "</p><p>It ends here.</p>"
    text = Page(wrap % article).text(None)
    assert "The article goes on" in text and "It ends here." in text


def test_names_of_parts_and_subjects():
    prose = "Long words about a subject that people study, and nothing else at all. " * 4
    around = "<article><h1>Head</h1><p>" + "Running text of the article. " * 30 + "</p>%s<p>The end.</p></article>"
    for kept in ("social science", "share-of-income", "related-rates", "search-theory", "reply"):
        assert prose.strip() in Page(around % f'<div class="{kept}"><p>{prose}</p></div>').text(None)
    for gone in ("comments", "comment-list", "post-comments", "siteFooter", "cookie-notice", "notice", "side-bar", "newsletter-signup", "ad", "ad-slot main-ad", "sidebar-left", "advertisement"):
        assert prose.strip() not in Page(around % f'<div class="{gone}"><p>{prose}</p></div>').text(None)
    for gone in ('<div class="share"><a href="x">Send this to all of your friends</a></div>', '<div class="related-posts"><a href="x">' + prose + "</a></div>", '<ul class="social"><li>Follow us</ul>'):
        assert Page(around % gone).text(None) == Page(around % "").text(None)


def test_hosts_vote(spark):
    odd = '<html><body><div class="main">Short but right.</div><div class="other">%s</div></body></html>' % ("long words here " * 40)
    rows = [(i, f"http://a.example/{i}", (PAGE % i), "x") for i in range(4)] + [(9, "https://A.example:80/y", '<html><body><div class="post-1"><p>Little.</p></div><div><p>%s</p></div></body></html>' % ("much more text " * 9), "x")]
    rows += [(10, None, None, "x"), (11, "", "", "x"), (12, "http://b.example/", odd, "x"), (13, "not a url", "<p>alone</p>", "x"), (13, "not a url", "<p>alone</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in main_text(df).collect()}
    assert main_text(df).count() == len(rows)
    assert all(got[i]["text"] == ARTICLE for i in range(4))
    assert got[9]["text"] == "Little."
    assert got[10]["text"] == got[11]["text"] == "" and got[13]["text"] == "alone"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert main_text(df.where("false")).count() == 0


def base_by_hand(rows, held):
    token = lambda t: WORD.findall((t or "").translate(LOWER)) + ["\n"]
    counts = Counter(w for i, t in rows if not held(i) for w in token(t))
    n, v = sum(counts.values()), len(counts)
    return {(i, t): (len(token(t)), sum(w in counts for w in token(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token(t))) for i, t in rows}


@pytest.mark.parametrize("nothing", [False, True])
def test_text_scores(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rule = F.lit(True) if nothing else crc_of_id(F.col("doc_id")) % 7 == 2
    held = (lambda i: True) if nothing else (lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2)
    want = base_by_hand([(i, t or "") for i, t in rows], held)
    got = text_scores(odd, rule).collect()
    by = Counter()
    for r in got:
        found = [v for (i, _), v in want.items() if i == r["doc_id"] and v[0] == r["n_tokens"] and abs(v[3] - r["base_score"]) < 1e-6]
        assert found and (r["n_known"], r["train_tokens"]) == found[0][1:3] and r["held_out"] == held(r["doc_id"])
        assert r["score"] < 0 and math.isfinite(r["score"])
        by[r["doc_id"]] += 1
    assert by == Counter(i for i, _ in rows)
    assert text_scores(odd.where("false"), rule).count() == 0


def brute_tree(texts):
    """Counts of every node and, from the longest contexts up, the mixed probability and weight of each."""
    counts, kids = {}, {}
    for t in texts:
        data = bytes(tree.DEPTH) + t + b"\xff"
        for at in range(tree.DEPTH, len(data)):
            node = 1
            for j in range(7, -1, -1):
                bit = data[at] >> j & 1
                for d in range(tree.DEPTH + 1):
                    counts.setdefault((data[at - d : at], node), [0, 0])[bit] += 1
                node = node * 2 + bit
    own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for k, (a, b) in counts.items()}
    for c, n in counts:
        if c:
            kids.setdefault((c[1:], n), []).append((c, n))
    mixed, weight = {}, {}
    for k in sorted(counts, key=lambda k: -len(k[0])):
        if len(k[0]) == tree.DEPTH:
            mixed[k], weight[k] = own[k], 1.0
        else:
            below = sum(mixed[x] for x in kids[k])
            mixed[k] = np.logaddexp(own[k], below) - math.log(2)
            weight[k] = math.exp(own[k] - math.log(2) - mixed[k])
    return counts, weight


def brute_log2(counts, weight, text):
    data, total = bytes(tree.DEPTH) + text + b"\xff", 0.0
    for at in range(tree.DEPTH, len(data)):
        node = 1
        for j in range(7, -1, -1):
            bit, p, rest, last = data[at] >> j & 1, 0.0, 1.0, 0.5
            for d in range(tree.DEPTH + 1):
                if (k := (data[at - d : at], node)) not in counts:
                    break
                last = (counts[k][1] + 0.5) / (sum(counts[k]) + 1)
                p, rest = p + rest * weight[k] * last, rest * (1 - weight[k])
            p += rest * last
            total += math.log2(p if bit else 1 - p)
            node = node * 2 + bit
    return total


def test_scores_are_those_of_the_tree(spark):
    source = random.Random(4)
    texts = [words(source, 12, "abc") for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in text_scores(df, F.col("doc_id") >= 9).collect()}
    counts, weight = brute_tree([t.encode() for t in texts[:9]])
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_log2(counts, weight, t.encode()) * math.log10(2), rel=1e-6)


def test_no_node_of_the_tree_is_lost(spark, monkeypatch):
    """Many nodes, in several chunks and buckets."""
    monkeypatch.setattr(text_scores_module, "CHUNK", 9000)
    monkeypatch.setattr(text_scores_module, "BUCKET", 5000)
    source = random.Random(5)
    texts = [words(source, 150, "abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in text_scores(df, F.col("doc_id") >= 36).collect()}
    counts, weight = brute_tree([t.encode() for t in texts[:36]])
    for i in (0, 1, 2, 36, 37, 38, 39):
        assert got[i] == pytest.approx(brute_log2(counts, weight, texts[i].encode()) * math.log10(2), rel=1e-6)


def test_tree_probabilities_sum_to_one():
    keys, starts = tree.grams_of([b"abracadabra", b"", b"\x00x"])
    assert list(starts) == [0, 12, 13] and len(keys) == 16
    keys, n = np.unique(keys, return_counts=True)
    short = tree.Short(*tree.Grams(keys, n).partial())
    contexts = np.unique(np.append(keys >> np.uint64(8), np.arange(5, dtype=np.uint64) * np.uint64(99991)))
    asked = np.unique(np.concatenate([contexts << np.uint64(8) | np.uint64(b) for b in range(256)]))
    counts = np.zeros(len(asked), np.int64)
    counts[np.searchsorted(asked, keys)] = n
    logs = tree.Grams(asked, counts).log2(short)
    assert np.allclose(np.bincount(np.unique(asked >> np.uint64(8), return_inverse=True)[1], weights=2**logs), 1)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    g = Gru(rng, 3)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    x = rng.integers(0, 256, (5, 4))
    target = rng.normal(size=(5, 4, 3)).astype(np.float32)

    def loss():
        return float((g.run(x).astype(np.float64) * target).sum())

    kept = []
    g.run(x, keep=kept)
    grads = g.back(x, kept, target.astype(np.float64))
    for name in g.p:
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), grads[name].shape)
        g.p[name][at] += (e := 1e-2)
        up = loss()
        g.p[name][at] -= 2 * e
        down = loss()
        g.p[name][at] += e
        assert (up - down) / (2 * e) == pytest.approx(grads[name][at], rel=0.05, abs=1e-3)


def test_segments_and_padding_do_not_show():
    net = Network(["a", "b", "c"])
    texts = [b"x" * 5, b"hello world " * 40, b"q", b"z" * 128, b"y" * 129]
    together = net.documents(texts)
    assert np.allclose(together, np.concatenate([net.documents([t]) for t in texts]), atol=1e-5)
    assert np.allclose(together.sum(1), 1, atol=1e-5)


def test_language(spark, odd, empty, corpus):
    net = fit_language(odd)
    got = {r["doc_id"]: r for r in with_language(odd, net).collect()}
    assert set(got[5].asDict()) == {*odd.columns, "lang_pred"}  # score is replaced
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {2, 3, 4, 6} and all(0 <= r["score"] <= 1 for r in got.values())
    assert with_language(empty, net).count() == 0
    assert fit_language(empty) is None and {r["lang_pred"] for r in with_language(odd, None).collect()} == {"und"}
    one = fit_language(odd.where("lang = 'en'"))
    assert one.names == ["en"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "lang")
    found = op9_gru_language(spark, corpus)
    assert found.count() == docs.count()
    assert found.join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    assert sorted(found.collect()) == sorted(op9_gru_language(spark, corpus).collect())


def test_letters_and_shared_ids(spark):
    source = random.Random(7)
    rows = [(None, words(source, 20, "abc" if i % 2 else "xyz"), "ab" if i % 2 else "xy") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = fit_language(docs)  # all rows share the hash of their id
    assert net.names == ["ab", "xy"]
    odd = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ 12"), (3, "abc cab"), (4, "漢")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in with_language(odd, net).collect()}
    assert got[1] == got[2] == "und" and got[3] == "ab" and got[4] != "und"


def plain_gru(p, data):
    """States after each byte, one by one."""
    h, out = np.zeros(p["uz"].shape[0]), []
    for b in data:
        z, r = (1 / (1 + np.exp(-(p["e" + g][b] + h @ p["u" + g]))) for g in "zr")
        h = h + z * (np.tanh(p["ec"][b] + (r * h) @ p["uc"]) - h)
        out.append(h)
    return np.array(out)


def test_documents_against_a_plain_network():
    net = Network(["a", "b", "c"])
    source = np.random.default_rng(2)
    for n in (1, 5, SEGMENT + WARM, SEGMENT, 3 * SEGMENT + 7):
        data = source.integers(1, 255, n, dtype=np.uint8).tobytes()
        sums = np.zeros(3)
        for at in range(0, n, SEGMENT):
            low, high = max(0, at - WARM), min(n, at + SEGMENT + WARM)
            states = np.hstack([plain_gru(net.ahead.p, data[low:high]), plain_gru(net.behind.p, data[low:high][::-1])[::-1]])
            logits = states @ net.w + net.b
            prob = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
            sums += prob[at - low : min(at + SEGMENT, n) - low].sum(0)
        assert np.allclose(net.documents([data])[0], sums / n, atol=1e-4)


def test_attention_gradients():
    rng = np.random.default_rng(1)
    x, number, y = rng.normal(size=(7, 258)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    model = Attention()
    before = {k: v.copy() for k, v in model.p.items()}
    for name in ("w", "v", "u", "a", "o"):  # a step of gradient descent against finite differences
        probe, p = Attention(), None
        loss = lambda m: -float((y * np.log(s := m.score(x, number)) + (1 - y) * np.log(1 - s)).mean())
        at = (0,) * probe.p[name].ndim
        probe.p["c"][:] = np.log(2)
        probe.mean, probe.scale = x.mean(0), 1 / (x.std(0) + 0.02)
        kept = {k: v.copy() for k, v in probe.p.items()}
        probe.p[name][at] += 1e-5
        up = loss(probe)
        probe.p[name][at] -= 2e-5
        slope = (up - loss(probe)) / 2e-5
        probe.p = kept
        probe.fit(x, number, y, rounds=1, rows=3, rate=1e-3, decay=0)  # Adam's first step goes against the gradient's sign
        assert abs(slope) < 1e-6 or np.sign(Attention().p[name][at] - probe.p[name][at]) == np.sign(slope)
    model.fit(x, number, y, rounds=200, rows=3, decay=0)
    assert np.abs(model.score(x, number) - y).max() < 0.1 and any((before[k] != model.p[k]).any() for k in before)
    f = features([b"abc, def!", b"", b"a" * 512])
    assert np.allclose(f, np.concatenate([features([p]) for p in (b"abc, def!", b"", b"a" * 512)]))


def test_quality(spark, odd, empty, corpus):
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 0), (6, 0), (3, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = fit_quality(odd, labels)
    got = with_quality(odd, model).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == set(odd.columns) and all(0 <= r["score"] <= 1 for r in got)
    assert with_quality(empty, model).count() == 0
    assert fit_quality(empty, labels) is None and {r["score"] for r in with_quality(odd, None).collect()} == {0.5}
    found = op5_attention_quality(spark, "/root/testdata/sf0.01")
    real = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert found.join(real, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_media_round_trip(spark, odd, empty):
    read = read_media(store_media(odd))
    got = read.collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        data = texts[r["doc_id"]]
        want = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (7, 8)}) == 1
    assert read_media(store_media(empty)).count() == 0
    rows = clip_rows(read).where("doc_id = 5").orderBy("clip").collect()
    assert rows[0]["start_s"] == 0 and all(a["end_s"] == b["start_s"] for a, b in zip(rows, rows[1:]))


def test_media_bytes_and_shots():
    source = np.random.default_rng(0)
    payloads = [padded(b""), bytes(range(256)), b"\xff" * 64 * 70, *[source.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 64, 65, 500)]]
    assert [r[0] for r in read_back(store(payloads))] == payloads
    scenes = [padded(words(random.Random(i), 4000, letters).encode()[: 4096 * 5]) for i, letters in enumerate(("abc", "\x01\x02\x03", "xyz"))]
    film = b"".join(s.ljust(4096 * 5, b" ") for s in scenes)
    assert [c[0] for c in read_back(store([film]))[0][2]] == [0, 5, 10]
    assert shot_starts(np.ones((20, 16))) == [0]
    assert shot_starts(np.repeat(np.eye(16)[[1, 9]] * 64, [1, 19], axis=0)) == [0, 1]


def test_pipeline_against_brute_force(spark, corpus):
    import corpus_pipeline as p
    from evalweave.llm.curriculum import curriculum
    from evalweave.llm.packing import WordIds
    from test_native import taken_by_hand
    from test_pairs import by_brute_force

    names = [n for n, _ in p.STAGES]
    assert names == ["language", "quality", "near_dedup", "mix", "packing"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    letters = [i for i, r in rows.items() if re.search(r"[^\W\d_]", r["text"] or "")]
    net = fit_language(docs)
    kept = [i for i, q in zip(letters, net.documents([rows[i]["text"].encode() for i in letters])) if q.max() >= 0.5]
    left = docs.where(F.col("doc_id").isin(kept))
    model = fit_quality(left, spark.read.parquet(f"{corpus}/labels.parquet"))
    kept = [i for i, s in zip(kept, model.documents([(rows[i]["text"] or "").encode() for i in kept])) if s >= 0.3]
    root = by_brute_force([(i, rows[i]["text"]) for i in kept], 5, 80)
    kept = [i for i in kept if root[i] == i]
    times = Counter()
    for (i, n, _, _, taken), k in taken_by_hand([(i, rows[i]["text"], rows[i]["source"]) for i in kept]).items():
        times[i] += k * (taken // n if n else 0)
    assert times
    times = mixed_by_hand([tuple(rows[i][c] for c in p.COLUMNS) for i in kept])
    words_of, want = WordIds(p.tokenizer_path()), Counter()
    for i, k in times.items():
        ids = words_of.ids([rows[i]["text"]])[0] + (1).to_bytes(4, "little")
        for at in range(0, len(ids), 4 * 4096):
            want[i, at // (4 * 4096), len(ids[at : at + 4 * 4096]) // 4, zlib.crc32(ids[at : at + 4 * 4096])] += k
    got = Counter(tuple(r[c] for c in ("doc_id", "piece", "length", "ids_crc32")) for r in p.run(spark, corpus).collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    assert curriculum(docs).count() == len(rows)


def mixed_by_hand(rows):
    """How often each id is taken, rows known by the digest of their columns."""
    from test_native import taken_by_hand

    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    key = lambda r: hashlib.md5("|".join(map(mark, r)).encode()).hexdigest()
    of = {key(r): r[0] for r in rows}
    times = Counter()
    for (k, n, _, _, taken), copies in taken_by_hand([(key(r), r[1], r[3]) for r in rows]).items():
        times[of[k]] += copies * (taken // n if n else 0)
    return times


def test_pipeline_stages_take_odd_rows(spark, odd, empty, corpus):
    import corpus_pipeline as p

    rows = [tuple(r[c] for c in p.COLUMNS) for r in odd.collect()]
    want = {
        "language": Counter(i for i, t, *_ in rows if t and any(map(str.isalpha, t))),
        "near_dedup": Counter([1, 2, 3, 4, 5, 6, 7, 9, 10, None]),
        "mix": mixed_by_hand(rows),
        "packing": Counter(i for i, *_ in rows),
    }
    for docs in (odd, empty):
        for name, stage in p.STAGES:
            out = stage(spark, docs.withColumn("length", F.lit(9)), corpus)
            assert out.columns == list(p.COLUMNS) or name == "packing"
            got = Counter(r["doc_id"] for r in out.collect() if name != "packing" or r["piece"] == 0)
            if docs is empty:
                assert not got
            elif name == "language":
                assert got <= want[name] and got[5] == 1  # some are of no clear language
            elif name == "quality":
                assert got <= Counter(i for i, *_ in rows)
            else:
                assert got == +want[name]


def test_mix_takes_rows_and_not_ids(spark, corpus):
    import corpus_pipeline as p

    rows = [(1, words(random.Random(i), 5 + i % 9), "en", "ab"[i % 2], i % 7) for i in range(90)] + [(2, "one more row", "en", "a", 0)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.mix(spark, docs, corpus).collect()
    assert Counter(r["doc_id"] for r in got) == +mixed_by_hand(rows)
    assert max(Counter(map(tuple, got)).values()) <= 40 and set(map(tuple, got)) <= set(rows)


def test_one_row_of_each_group_stays(spark, corpus):
    import corpus_pipeline as p

    texts = [words(random.Random(i), 40) for i in range(5)]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[4]), (4, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in p.near_dedup(spark, docs, corpus).collect())
    assert got == Counter([(1, texts[0]), (3, min(texts[1:3])), (None, texts[3]), (None, texts[4]), (4, None), (5, None)])
