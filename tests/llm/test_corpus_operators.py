"""Corpus operators against brute force and planted cases."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quillmark.llm import decontam, license_scan, packing, pq_neardup, probminhash, quality_rank, queries, suffix_dedup, toxicity, unit_dedup, warc_index
from quillmark.llm.components import components

WORD = re.compile(r"[^\W_]+")


@contextmanager
def conf(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before)


# 1: capture index


@settings(deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", max_size=2), st.integers(0, 3))).map(sorted), max_size=6))
def test_loser_tree_merges(runs):
    order = list(warc_index.LoserTree(runs))
    assert [runs[r][i] for r, i in order] == sorted(x for run in runs for x in run)
    assert len(set(order)) == len(order)


def test_capture_index_over_many_ranges(spark):
    hot = [(i, "http://WWW.hot.org/", f"v{i // 40}") for i in range(300)]
    rows = hot + [(300 + i, f"https://m.s{i % 50}.com:80/P{i % 7}?q={i % 3}#x", f"h{i}") for i in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    one = warc_index.capture_index(pages).orderBy("pos").collect()
    many = warc_index.capture_index(pages, run_rows=60, range_rows=90).orderBy("pos").collect()
    assert many == one and [r.pos for r in one] == list(range(1, 1001))
    keys = [(r.urlkey, r.ts, r.page_id) for r in one]
    assert keys == sorted(keys)
    mine = [r for r in many if r.urlkey == "org,hot)/"]
    assert [r.seq for r in mine] == list(range(1, 301)) and [r.revisit for r in mine] == [i % 40 != 0 for i in range(300)]


# 2: product quantisation


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_all_near_pairs_are_found(spark):
    r = np.random.default_rng(5)
    base = unit(r.normal(size=(400, 20)))
    near = unit(np.repeat(base[:40], 5, axis=0) + r.normal(scale=0.05, size=(200, 20)))
    x = np.concatenate([base, near, base[:3] * 4.0])
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    x = unit(x.astype(np.float32).astype(float))
    i, j = np.nonzero(np.triu(x @ x.T, 1) >= 0.95)
    want = set(zip(i.tolist(), j.tolist()))
    got = {(r.vec_a, r.vec_b): r.cosine for r in pq_neardup.near_pairs(df, words=32, block_vectors=100, task_queries=50).collect()}
    assert set(got) == want and len(want) > 200
    assert all(abs(c - x[a] @ x[b]) < 1e-9 for (a, b), c in got.items())


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_probes(spark, clustered):
    """Pairs at the threshold, the hardest to find, with production settings;
    and with infinite margin none is missed."""
    r = np.random.default_rng(9)
    base = unit(r.normal(size=(1500, 64)))
    if clustered:
        base = unit(base[r.integers(0, 30, 1500)] + 0.7 * base)
    side = r.normal(size=(600, 64))
    side = unit(side - (side * base[:600]).sum(axis=1, keepdims=True) * base[:600])
    near = base[:600] * 0.951 + side * math.sqrt(1 - 0.951**2)
    x = unit(np.concatenate([base, near]).astype(np.float32).astype(float))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    i, j = np.nonzero(np.triu(x @ x.T, 1) >= 0.95)
    want = set(zip(i.tolist(), j.tolist()))
    got = {(p.vec_a, p.vec_b) for p in pq_neardup.near_pairs(df).collect()}
    assert len(want) >= 600 and got <= want and len(got) >= 0.99 * len(want)
    assert {(p.vec_a, p.vec_b) for p in pq_neardup.near_pairs(df, deviations=math.inf).collect()} == want


@pytest.mark.parametrize("threshold", [0.35, -1.0])
def test_tiles_have_every_pair(spark, threshold, monkeypatch):
    """Without probes nothing is learned: all pairs by tiles, several in a
    partition, blocks of chance sizes, ids of several rows among them."""
    monkeypatch.setattr(pq_neardup, "TILE_PARTITIONS", 5)
    monkeypatch.setattr(pq_neardup, "_search", None)
    r = np.random.default_rng(17)
    x = r.normal(size=(230, 16)).astype(np.float32)
    ids = [i // 2 if i < 20 else i for i in range(230)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>").repartition(4)
    x = unit(x.astype(float))
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    rows = Counter((ids[a], ids[b]) for a, b in zip(i, j) if ids[a] != ids[b])
    want = {p: max(x[a] @ x[b] for a in np.flatnonzero(np.array(ids) == p[0]) for b in np.flatnonzero(np.array(ids) == p[1])) for p in rows}
    for tile_vectors in (3, 40, 1000):
        found = pq_neardup._all_pairs(df, 16, 230, threshold, tile_vectors)
        assert found.rdd.getNumPartitions() <= 5
        assert Counter((p.vec_a, p.vec_b) for p in found.collect()) == rows
    got = {(p.vec_a, p.vec_b): p.cosine for p in pq_neardup.near_pairs(df, threshold, math.inf).collect()}
    assert got.keys() == want.keys() and all(abs(c - want[p]) < 1e-9 for p, c in got.items())


def test_every_dimension_is_searched(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 2.0, 2.0], [2.0, 4.0, 4.001], [-3.0, 0.0, 1.0], [1.0, 2.0], [2.0, 4.001], [2.0, -1.0], [3.0], [0.5], [1.0] * 5])]
    df = spark.createDataFrame([*rows, (1, [2.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_a, r.vec_b) for r in pq_neardup.near_pairs(df).collect()) == [(0, 1), (1, 3), (1, 4), (3, 4), (6, 7)]


def classes_by_hand(df, threshold):
    import duckdb

    embeddings = df.select("vec_id", "embedding").toArrow()  # noqa: F841
    return sorted(duckdb.sql(pq_neardup.classes_oracle(threshold)).fetchall(), key=str)


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_classes_have_every_link(spark, threshold):
    """Clusters, copies, ids of several vectors and rows without a cosine,
    against SQL over all pairs."""
    r = np.random.default_rng(11)
    base = unit(r.normal(size=(150, 12)))
    near = unit(np.repeat(base[:8], 30, axis=0) + r.normal(scale=0.09, size=(240, 12)))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.concatenate([base, near, near[:40], near[:9] * 3.0]))]
    rows += [(500, rows[151][1])] * 3 + [(501, rows[0][1]), (501, rows[1][1]), (501, rows[150][1]), (502, rows[1][1]), (502, rows[200][1]), (7, rows[160][1])]
    rows += [(510, [1.0, 2.0]), (511, [2.0, 4.0]), (501, [1.0, 2.0]), (512, [3.0]), (513, [3.0]), (520, None), (521, [0.0] * 12), (522, [float("nan")] * 12), (523, []), (None, rows[0][1]), (1, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = pq_neardup.near_classes(df, threshold, math.inf, words=32, block_vectors=100, task_queries=50)
    assert got.columns == ["vec_id", "class_id", "links"]
    want = classes_by_hand(df, threshold)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == len(rows) and max(w[2] for w in want) > 20


def test_links_agree_with_pairs(spark):
    """Links folded in tasks, probed from both sides, are those of the pairs."""
    r = np.random.default_rng(12)
    x = unit(np.repeat(unit(r.normal(size=(20, 16))), 40, axis=0) + r.normal(scale=0.06, size=(800, 16)))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    for deviations in (pq_neardup.DEVIATIONS, 1.0):
        small = {"deviations": deviations, "words": 32, "block_vectors": 60, "task_queries": 40}
        pairs = [(p.vec_a, p.vec_b) for p in pq_neardup.near_pairs(df, **small).collect()]
        got = {v.vec_id: v.links for v in pq_neardup.near_classes(df, **small).collect()}
        want = Counter(v for p in pairs for v in p)
        assert got == {i: want[i] for i in range(800)} and len(pairs) > 4 * 800


def test_rows_of_embeddings_follow_the_input(spark, tmp_path):
    """Clusters three times as large: nine times the pairs, three times the rows."""
    r = np.random.default_rng(13)
    base = unit(r.normal(size=(5, 16)))
    for n in (20, 60):
        x = np.repeat(base, n, axis=0) + r.normal(scale=0.01, size=(5 * n, 16))
        spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = queries.QUERIES["op2_embedding_pairs"](spark, f"{tmp_path}/{n}").collect()
        assert sorted(map(tuple, got)) == [(i, i // n * n, n - 1) for i in range(5 * n)]


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60), st.integers(0, 60))
def test_merged_sets_have_the_least_lead(pairs, at):
    lead, want = np.arange(31), list(range(31))
    for part in (pairs[:at], pairs[at:]):
        pq_neardup.merge(lead, np.array([a for a, _ in part], np.int64), np.array([b for _, b in part], np.int64))
    for a, b in pairs:
        x, y = want[a], want[b]
        want = [min(x, y) if w in (x, y) else w for w in want]
    assert lead.tolist() == want


def test_probes_are_sufficient():
    r = np.random.default_rng(1)
    x, centres = unit(r.normal(size=(200, 6))), unit(r.normal(size=(12, 6)))
    y = unit(x + r.normal(scale=0.1, size=x.shape))
    home_x, home_y, far = pq_neardup.nearest(x, centres), pq_neardup.nearest(y, centres), np.linalg.norm(x - y, axis=1)
    for radius in (0.2, 0.5):
        asked = set(zip(*(v.tolist() for v in pq_neardup.sufficient_lists(x, centres, radius))))
        assert all((k, home_y[k]) in asked for k in range(200) if far[k] <= radius and home_y[k] >= home_x[k])


# 3: licences


def test_licences_are_found(spark, writer, docs_of):
    mit = license_scan.TEMPLATES["mit-permission"]
    worn = mit.replace("copy, modify, merge,", "copy, change, merge,").replace("free of charge", "at no charge")
    texts = [writer.text(120) + "\nLicensed under CC BY-NC 4.0.\n" + writer.text(30), writer.text(60) + " " + worn + " " + writer.text(60), writer.text(200), "Released under the MIT License. " + writer.text(20) + " Released under the MIT license!"]
    got = license_scan.license_scan(docs_of(texts)).collect()
    found = sorted((r.doc_id, r.license, texts[r.doc_id][r.start_char : r.end_char]) for r in got)
    assert [f[:2] for f in found] == [(0, "cc-by-nc-4.0-line"), (1, "mit-permission"), (3, "mit-line"), (3, "mit-line")]
    assert found[0][2] == "Licensed under CC BY-NC 4.0" and found[1][2].startswith("Permission is hereby") and found[1][2].endswith("of the Software")


def licences_by_hand(texts: dict, templates: dict) -> set[tuple]:
    """Votes counted in dictionaries, runs of diagonals in a loop, and every
    candidate span aligned by the textbook recursion."""
    words_of = lambda t: [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(t)]
    out = set()
    for d, text in texts.items():
        have, hits = words_of(text), []
        for name, template in templates.items():
            want = [w for w, _, _ in words_of(template)]
            place: dict = {}
            for p in range(len(want) - 2):
                place.setdefault(tuple(want[p : p + 3]), []).append(p)
            votes: dict = {}
            for p in range(len(have) - 2):
                for o in place.get(tuple(w for w, _, _ in have[p : p + 3]), ()):
                    votes.setdefault(p - o, []).append((o, p))
            runs: list[list] = []
            for diag in sorted(votes):
                if not runs or diag - runs[-1][-1] > license_scan.SLACK:
                    runs.append([])
                runs[-1].append(diag)
            for run in runs:
                n = sum(len({o for o, _ in votes[g]}) for g in run)
                if n < max(1, math.ceil((len(want) - 2) * license_scan.MIN_VOTES)):
                    continue
                at = [p for g in run for _, p in votes[g]]
                margin = len(want) // 4 + license_scan.SLACK
                a, b = max(0, min(at) - margin), min(len(have), max(at) + 3 + margin)
                got = common_by_hand(want, [w for w, _, _ in have[a:b]])
                sim = got[0] / max(len(want), got[2] - got[1] + 1)
                if got[0] and sim >= license_scan.MIN_SIMILARITY:
                    hits.append((-got[0], -sim, have[a + got[1]][1], have[a + got[2]][2], name, n))
        taken: list = []
        for h in sorted(hits):
            if all(h[3] <= x[2] or x[3] <= h[2] for x in taken):
                taken.append(h)
        out |= {(d, name, x, y, v, round(-s, 9)) for _, s, x, y, name, v in taken}
    return out


def common_by_hand(a: list, b: list) -> tuple[int, int, int]:
    """Longest common subsequence, traced back from its earliest end, template
    words before text words."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + (x == y))
    if not (best := t[-1][-1]):
        return 0, 0, 0
    i, j = len(a), t[-1].index(best)
    last = begin = j - 1
    while i and j and t[i][j]:
        if t[i - 1][j] == t[i][j]:
            i -= 1
        elif t[i][j - 1] == t[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            begin = j
    return best, begin, last


def test_licence_query_against_brute_force(spark, writer, tmp_path):
    short = {n: t for n, t in license_scan.TEMPLATES.items() if len(t) < 700}
    texts = {}
    for i, name in enumerate(sorted(short) * 3):
        worn = writer.edited(short[name], (0.0, 0.08, 0.25)[i % 3])
        texts[i] = writer.text(30) + "\n" + worn + ("\n" + worn if i % 4 == 0 else "") + "\n" + writer.text(20)
    texts |= {1000: writer.text(200), 1001: " ".join(sorted(short.values()))[:3000]}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.license, r.start_char, r.end_char, r.votes, round(r.similarity, 9)) for r in queries.op3_license_scan(spark, str(tmp_path)).collect()}
    want = licences_by_hand(texts, license_scan.TEMPLATES)
    assert got == want and len(want) > len(short)


def test_texts_of_one_number_are_told_apart(spark, writer, docs_of):
    notice = "Released under the MIT License."
    texts = [(1, writer.text(50) + " " + notice), (1, notice + " " + writer.text(50)), (1, writer.text(9)), (2, notice), (2, notice)]
    got = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_char) for r in got) == sorted([(1, texts[0][1].index(notice)), (1, 0), (2, 0)])


def test_both_ways_to_join_templates(spark, writer, docs_of, monkeypatch):
    texts = [writer.text(40) + " Released under the MIT License. " + writer.text(9) for _ in range(5)] + [writer.text(60)]
    one = sorted(license_scan.license_scan(docs_of(texts)).collect())
    monkeypatch.setattr(license_scan, "BROADCAST_POSITIONS", 0)
    assert sorted(license_scan.license_scan(docs_of(texts)).collect()) == one and len(one) == 5


def test_alignment_is_the_longest_common_subsequence():
    r = np.random.default_rng(2)
    for _ in range(30):
        a, b = r.integers(0, 4, 8), r.integers(0, 4, 12)
        t = [[0] * 13 for _ in range(9)]
        for i in range(8):
            for j in range(12):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        n, x, y = license_scan.aligned_words(a, b)
        assert n == t[8][12]
        if n:
            assert b[x] in a and b[y] in a and license_scan.aligned_words(a, b[x : y + 1])[0] == n


# 4: quality


def test_quality_on_held_out_labels(spark, writer, docs_of):
    def bad(i):
        w = writer.words(80)
        return [" ".join(x.upper() + "!!" for x in w), " ".join(x + "###" for x in w), " ".join(w[0] for _ in w), " | ".join(w)][i % 4]

    texts = [bad(i) if i % 5 == 0 else writer.text(80) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(150)], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in quality_rank.quality_rank(docs_of(texts), labels).collect()}
    assert sum(got[i] == (i % 5 != 0) for i in range(150, 300)) >= 147
    share = quality_rank.quality_rank(docs_of(texts), labels, quantile=0.5).where("keep").count()
    assert abs(share - 150) <= 2


def features_by_hand(text: str) -> list[float]:
    words = [m.group().lower() for m in WORD.finditer(text)]
    lines = (text + "\n").split("\n")[:-1]
    n, some, nl = len(text), max(len(words), 1), max(len(lines), 1)
    prose = set(".,;:'\"-()?’“”«»¿¡")
    mark = sum(c in prose for c in text)
    symbol = sum(not c.isspace() and not c.isdigit() and not c.isalpha() and c not in prose for c in text)
    pairs = list(zip(words, words[1:]))
    return [
        math.log1p(len(words)), sum(c.isalpha() and c.isupper() for c in text) / max(n, 1), sum(c.isdigit() for c in text) / max(n, 1), mark / max(n, 1), symbol / max(n, 1),
        sum(c.isspace() for c in text) / max(n, 1), sum(map(len, words)) / some, math.log1p(len(words) / nl), len(set(words)) / some, sum(a == b for a, b in pairs) / some,
        len(set(pairs)) / max(len(pairs), 1), (mark + symbol) / some, sum(x[-1:] in list(".!?") for x in lines) / nl,
    ]


def ranked_by_hand(texts: list[str], quality: dict[int, int]) -> tuple[np.ndarray, float]:
    """Scores and threshold: plain gradient descent on every preference pair
    the operator draws, quantiles of sorted lists."""
    x = np.array([features_by_hand(t) for t in texts])
    known = [i for i in quality if i < len(texts)]
    centre, scale = x[known].mean(axis=0), x[known].std(axis=0)
    z = (x - centre) / np.where(scale > 1e-9, scale, 1.0)
    order = sorted(known, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    good, bad = [i for i in order if quality[i]], [i for i in order if not quality[i]]
    large, small = (good, bad) if len(good) >= len(bad) else (bad, good)
    n = max(len(large), len(small) * quality_rank.PAIRS_EACH)
    pairs = [(large[k % len(large)], small[k * len(small) // n]) for k in range(n)]
    d = np.array([z[a] - z[b] if large is good else z[b] - z[a] for a, b in pairs])
    w = np.zeros(z.shape[1])
    step = 1 / (0.25 * np.linalg.eigvalsh(d.T @ d / n)[-1] + quality_rank.RIDGE)
    v, before = w.copy(), w.copy()
    for i in range(60_000):  # with momentum, as some features hardly differ
        w = v + step * ((d / (1 + np.exp(d @ v))[:, None]).mean(axis=0) - quality_rank.RIDGE * v)
        v, before = w + i / (i + 3) * (w - before), w
    scores = z @ w
    at = lambda side, q: sorted(scores[side])[max(0, math.ceil(q * len(side)) - 1)]
    return scores, (at(good, quality_rank.TAIL) + at(bad, 1 - quality_rank.TAIL)) / 2


def test_quality_query_against_brute_force(spark, writer, tmp_path):
    texts = [writer.text(writer.r.randint(5, 90)) if i % 3 else " ".join(x.upper() + "!" * (i % 4) for x in writer.words(40)) + " | 12" for i in range(90)] + ["", "x"]
    quality = {i: int(i % 3 != 0 or i % 7 == 0) for i in range(60)}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scores, limit = ranked_by_hand(texts, quality)
    got = {r.doc_id: r for r in queries.op4_quality_rank(spark, str(tmp_path)).collect()}
    assert max(abs(got[i].score - scores[i]) for i in range(len(texts))) < 2e-3 * scores.std()
    assert all(got[i].keep == (scores[i] >= limit) for i in range(len(texts)) if abs(scores[i] - limit) > 0.1)


def test_every_labelled_document_is_in_a_pair():
    for a, b in ((3, 100), (100, 3), (7, 7), (1, 1), (0, 5)):
        i, j = quality_rank.preference_pairs(np.zeros((a, 1)), np.zeros((b, 1)), 8)
        assert set(i) == set(range(a if b else 0)) and set(j) == set(range(b if a else 0))


def test_fit_is_the_optimum():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, len(quality_rank.NAMES))), r.integers(0, 2, 60)
    centre, scale, w = quality_rank.fit(x, y, each=3, ridge=0.1)
    z = (x - centre) / scale
    i, j = quality_rank.preference_pairs(z[y > 0], z[y == 0], 3)
    d = z[y > 0][i] - z[y == 0][j]
    gradient = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 0.1 * w
    assert np.abs(gradient).max() < 1e-5


# 5: near duplicates


def jaccard_by_hand(x: Counter, y: Counter) -> float:
    both = x.keys() & y.keys()
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in both)


@settings(deadline=None, max_examples=40)
@given(*[st.dictionaries(st.integers(0, 12), st.integers(1, 5), min_size=1, max_size=10)] * 2)
def test_probability_jaccard(a, b):
    f = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float))
    assert probminhash.jaccard_p(*f(a), *f(b)) == pytest.approx(jaccard_by_hand(Counter(a), Counter(b)))


def test_signatures_estimate_it(writer):
    texts = [writer.text(150) for _ in range(6)]
    texts += [writer.edited(t, p) for t in texts for p in (0.05, 0.2)]
    h, w, owner, _ = probminhash.shingles(texts)
    sig = probminhash.signatures(h, w, owner, len(texts), 3000)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    part = lambda i: (h[at[i] : at[i + 1]], w[at[i] : at[i + 1]])
    for i in range(6):
        for j in range(6, 18):
            assert abs((sig[i] == sig[j]).mean() - probminhash.jaccard_p(*part(i), *part(j))) < 0.05


def test_groups_against_brute_force(spark, writer, docs_of):
    base = [writer.text(160) for _ in range(40)]
    texts = base + [writer.edited(t, p) for t in base[:15] for p in (0.05, 0.15)] + base[20:23] + [b.upper() for b in base[23:25]] + [base[30][: len(base[30]) * 6 // 10] + " " + writer.text(60)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    same = [[probminhash.similarities([texts[i]], [texts[j]], k)[0] for k in (3, 1)] for i, j in pairs]
    near = [p for p, (a, b) in zip(pairs, same) if a >= probminhash.THRESHOLD and b >= probminhash.WORD_THRESHOLD]
    got = {r.doc_id: r.group_id for r in probminhash.near_duplicates(docs_of(texts)).collect()}
    assert sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near) and len(near) >= 35
    alone = set(range(len(texts))) - {x for p in near for x in p}
    assert all(got[i] == i for i in alone)
    kept = {r.doc_id for r in probminhash.keep_first(docs_of(texts)).collect()}
    assert kept == {i for i in got if got[i] == i}


def test_all_pairs_of_a_bucket_meet(spark, writer, docs_of):
    """Near copies that share a bucket only behind others that aren't like them."""
    phrase = " kado mele toru" * 60
    key = lambda t: probminhash.band_keys(probminhash.signatures(*probminhash.shingles([t])[:3], 1, 1), 1, 1)[0, 0]
    made = lambda t: [t + phrase, *(writer.edited(t, p) + phrase for p in (0.1, 0.1))]
    one = key(phrase.strip())
    families = [f for f in (made(writer.text(120)) for _ in range(40)) if {key(t) for t in f} == {one}][:4]
    a, b, c, d = families
    chain = c[0].split(" ")
    links = [" ".join(chain[:j] + writer.words(40) + chain[j + 40 :]) for j in (0, 70)]
    texts = [a[0], b[0], c[0], d[0], *(t for t in links if key(t) == one), *c[1:], *d[1:], b[1]]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if probminhash.alike([texts[i]], [texts[j]], 3, 0.3, 0.65)[0]]
    want = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    got = {r.doc_id: r.group_id for r in probminhash.near_duplicates(docs_of(texts), bands=1, rows=1).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert want[2] == 2 and want[3] == 3 and want[-2] == 3


def test_bands_find_pairs_at_the_threshold():
    assert 1 - (1 - probminhash.THRESHOLD**probminhash.ROWS) ** probminhash.BANDS >= 0.9


def test_profiles_lose_no_pair(spark, writer, docs_of):
    base = [writer.text(n) for n in (1, 5, 60, 150)]
    texts = base + [writer.edited(t, p) for t in base for p in (0.0, 0.1, 0.4)] + [writer.text(90)]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    for threshold in (0.3, 0.65, 1.0):
        got = {tuple(r) for r in probminhash._possible(docs_of(texts), spark.createDataFrame(pairs, "a long, b long"), threshold).collect()}
        assert {(i, j) for i, j in pairs if probminhash.similarities([texts[i]], [texts[j]], 1)[0] >= threshold} <= got


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 105: 100}


# 6: lines


def units_by_hand(texts: list[str]) -> list[str]:
    """Text with each repeated line, then sentence, left out, one by one."""
    norm = lambda s: (" ".join(s.lower().split()), len(s.split()))
    lines, sentences = {}, {}
    for d, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            n, k = norm(line)
            parts = re.findall(r"[^.!?]+[.!?]*\s*|[.!?]+\s*", line, re.A) if k >= 5 else []
            if k >= 4:
                lines.setdefault(n, []).append((d, at, 0))
            if len(parts) > 1:
                p = at
                for s in parts:
                    m, q = norm(s)
                    if q >= 5:
                        sentences.setdefault(m, []).append((d, p, 1))
                    p += len(s)
            at += len(line) + 1
    first = {}
    for table in (lines, sentences):
        for n, places in table.items():
            first[n] = min([*places, first.get(n, places[0])])
    out = []
    for d, t in enumerate(texts):
        at, kept = 0, []
        all_lines = t.split("\n")
        for i, line in enumerate(all_lines):
            end = "\n" if i < len(all_lines) - 1 else ""
            n, k = norm(line)
            if not (k >= 4 and first[n] != (d, at, 0)):
                parts = re.findall(r"[^.!?]+[.!?]*\s*|[.!?]+\s*", line, re.A) if k >= 5 else []
                if len(parts) > 1:
                    p = at
                    for s in parts:
                        m, q = norm(s)
                        if not (q >= 5 and first[m] != (d, p, 1)):
                            kept.append(s)
                        p += len(s)
                    kept.append(end)
                else:
                    kept.append(line + end)
            at += len(line) + 1
        out.append("".join(kept))
    return out


def test_lines_and_sentences(spark, writer, docs_of):
    shared = [writer.text(30) for _ in range(4)]
    texts = [writer.text(40) + "\n" + shared[i % 4] + "\n" + writer.text(20) + " " + shared[(i + 1) % 4] for i in range(12)] + [shared[0] + "\n" + shared[0], "", "ok\nok\nok"]
    rows = {r.doc_id: r for r in unit_dedup.unit_dedup(docs_of(texts)).collect()}
    assert [rows[i].text for i in range(len(texts))] == units_by_hand(texts)
    for i, t in enumerate(texts):
        spans = [tuple(map(int, s.split("-"))) for s in rows[i].removed_spans.split(";") if s]
        assert unit_dedup.cut_out(t, spans) == rows[i].text and sum(b - a for a, b in spans) == rows[i].removed_chars


# 7: packing


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 4), min_size=1, max_size=6))
def test_each_window_is_as_full_as_can_be(counts):
    capacity, left = 15, dict(counts)
    for fill, times in packing.plan(counts, capacity):
        for _ in range(times):
            top = max(x for x, c in left.items() if c)
            sums = {top}
            have = dict(left)
            have[top] -= 1
            for x, c in have.items():
                sums = {s + k * x for s in sums for k in range(c + 1) if s + k * x <= capacity}
            assert top in fill and sum(x * k for x, k in fill.items()) == max(sums)
            for x, k in fill.items():
                left[x] -= k
                assert left[x] >= 0
    assert not any(left.values())


def test_every_token_is_packed_once(spark, writer):
    sizes = [writer.r.randint(0, 90) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    results = set()
    for parts, shuffled in ((1, "1"), (8, "4"), (3, "7")):
        with conf(spark, "spark.sql.shuffle.partitions", shuffled), conf(spark, "spark.sql.adaptive.enabled", str(parts == 1)):
            rows = packing.pack_lengths(df.repartition(parts), 32).collect()
        results.add(tuple(sorted(map(tuple, rows))))
        held, used = {}, {}
        for r in rows:
            held.setdefault(r.doc_id, []).append((r.start_token, r.length))
            used.setdefault(r.window_id, []).append((r.offset, r.length))
        assert {d: n for d, n in enumerate(sizes) if n} == {d: sum(n for _, n in p) for d, p in held.items()}
        for pieces in [*held.values(), *used.values()]:
            at = 0
            for a, n in sorted(pieces):
                assert a == at
                at += n
        assert all(sum(n for _, n in p) <= 32 for p in used.values()) and sorted(used) == list(range(len(used)))
        assert len(used) <= math.ceil(sum(sizes) / 32) * 1.05 + 1
    assert len(results) == 1  # nothing hangs on partitions


def packed_by_hand(counts: list[tuple], capacity: int) -> set[tuple]:
    """Windows one by one: the largest piece, then by exhaustive search the
    fullest set of the others, pieces of one length in order of doc_id."""
    pieces: dict[int, list] = {}
    for d, n in sorted(counts):
        if n % capacity:
            pieces.setdefault(n % capacity, []).append((d, n - n % capacity))
    out, window = set(), 0
    have = {x: len(p) for x, p in pieces.items()}
    for fill, times in packing.plan(have, capacity):
        for _ in range(times):
            top = max(x for x, n in have.items() if n)
            rest = [x for x, n in have.items() for _ in range(n - (x == top)) if x]
            reach = {0}
            for x in rest:
                reach |= {r + x for r in reach if r + x <= capacity - top}
            assert top in fill and sum(x * k for x, k in fill.items()) == top + max(reach)
            at = 0
            for x in sorted(fill, reverse=True):
                for _ in range(fill[x]):
                    d, start = pieces[x].pop(0)
                    out.add((window, at, d, start, x))
                    at += x
                have[x] -= fill[x]
            window += 1
    for _, d, n in sorted((n % capacity, d, n) for d, n in counts):
        for k in range(n // capacity):
            out.add((window, 0, d, k * capacity, capacity))
            window += 1
    return out


def test_packing_against_brute_force(spark, writer):
    counts = [(i, writer.r.choice([0, 3, 5, 8, 13, 21, 40, 64, 100])) for i in range(60)]
    df = spark.createDataFrame(counts, "doc_id long, n_tokens long").repartition(4)
    assert {tuple(r) for r in packing.pack_lengths(df, 32).collect()} == packed_by_hand(counts, 32)


def test_packing_query_against_brute_force(spark, writer, tmp_path):
    texts = [writer.text(writer.r.choice([3, 40, 200, 900, 3000])) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    e = packing.encoding(packing.VOCABULARY)
    want = packed_by_hand([(i, len(e.encode_ordinary(t))) for i, t in enumerate(texts)], packing.CAPACITY)
    assert {tuple(r) for r in queries.op7_packing(spark, str(tmp_path)).collect()} == want


def test_tokens_are_those_of_the_vocabulary(spark, docs_of):
    texts = ["", "Hello  world's 12 €", "日本 " * 50]
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(docs_of(texts)).collect()}
    e = packing.encoding(packing.VOCABULARY)
    assert got == {i: len(e.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts)


# 8: decontamination


def edits_by_hand(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(t: str) -> str:
    return " ".join(w.lower() for w in WORD.findall(t))


def test_contamination_against_edit_distance(spark, writer, docs_of, tmp_path):
    items = [writer.text(n) for n in (14, 20, 30, 40)]

    def worn(t, n):
        t = list(t)
        for _ in range(n):
            i = writer.r.randrange(len(t))
            t[i : i + 1] = writer.r.choice(["", "x", "ab"])
        return "".join(t)

    texts = [writer.text(50) + " " + worn(items[i % 4], i // 2) + " " + writer.text(50) for i in range(32)] + [writer.text(200) for _ in range(8)] + [items[0].upper().replace(" ", " \n ")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.decontaminate(docs_of(texts), bench).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            m = len(plain(item))
            allowed = min(math.floor(decontam.EDIT_RATE * m), (m - decontam.Q) // decontam.Q)
            n = edits_by_hand(plain(item), plain(t))
            assert ((d, i) in found) == (n <= allowed), (d, i, n, allowed)
            if n <= allowed:
                assert found[d, i].edits == n
    exact = found[0, 0]
    assert plain(texts[0][exact.start_char : exact.end_char]) == plain(items[0])
    sliced = decontam.decontaminate(docs_of(texts), bench, slice_chars=150).collect()
    assert sorted(sliced) == sorted(got)
    assert {r.doc_id for r in decontam.drop_contaminated(docs_of(texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in found}
    docs_of(texts).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(queries.op8_decontamination(spark, str(tmp_path)).collect()) == sorted(got)


def test_shared_grams_below_the_bound_are_no_match(writer):
    item = writer.text(30)
    index = decontam.Index([(0, item)], decontam.Q, decontam.EDIT_RATE)
    assert decontam.matches([item[: len(item) // 3] + writer.text(60)], index) == [] and decontam.matches([writer.text(60)], index) == [] and decontam.matches(["", item], index)[0][:2] == (1, 0)


# 9: toxicity


ALIKE = "aаαɑ4@ bвβ8 cс dԁ eеε3€ gɡ9 hнһ iіιıl1| jј kкκ mм nηո oоοօ0 pрρ qԛ sѕ5$ tтτ7 uυս wωԝ xхχ yуγ zζ".split()


def plain_words(text: str) -> list[str]:
    """A fold of its own, sign by sign from a list of look-alikes."""
    to = {sign: group[0] for group in ALIKE for sign in group}
    signs = [c for c in unicodedata.normalize("NFKD", text).lower() if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf"]
    out = ""
    for i, c in enumerate(signs):
        inside = c == "!" and 0 < i < len(signs) - 1 and (signs[i - 1].isalnum() and signs[i + 1].isalnum())
        out += "i" if inside else to.get(c, c if c.isalnum() else " ")
    return out.split()


def score_by_hand(text: str, lexicon: dict, exceptions: tuple) -> float:
    words = plain_words(text)
    phrases = [plain_words(e) for e in exceptions]
    spared = {i + k for p in phrases for i in range(len(words)) if words[i : i + len(p)] == p for k in range(len(p))}
    weights = {plain_words(w)[0]: x for w, x in lexicon.items()}
    return sum(weights.get(w, 0.0) for i, w in enumerate(words) if i not in spared) / max(len(words), 1)


def test_scores_against_brute_force(spark, writer, docs_of):
    lexicon = {"idiot": 0.8, "scum": 0.9, "trash": 0.4, "löser": 0.5, "moron": 0.7, "stupid": 0.3, "filth": 0.2, "ugly": 0.1}
    say = ["1D10T", "idiot,", "ѕсum", "TRASH can", "trash", "lóser", "id!ot!", "sc​um", "idiotic", "trash-can", "straße", "mοrοn", "stυpid", "filtһ", "uglу"]
    texts = [" ".join(writer.r.choice(say + writer.words(6)) for _ in range(40)) for _ in range(60)]
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(texts), lexicon, ("trash can",), 0.05).collect()}
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(score_by_hand(t, lexicon, ("trash can",))) and got[i].toxic == (got[i].score >= 0.05)


def test_every_lookalike_of_every_seed_word():
    for sign, letter in toxicity._LOOKALIKE.items():
        assert len(sign) == 1 and toxicity.fold_word(sign) == toxicity.fold_word(letter), (sign, letter)
    for word in toxicity.SEED_LEXICON:
        for i, c in enumerate(word):
            for sign in toxicity._ALIKE.get(c, ""):
                assert toxicity.fold_word(word[:i] + sign + word[i + 1 :]) == toxicity.fold_word(word), (word, sign)
    assert [toxicity.fold_word(w) for w in ("mοrοn", "idiοt", "stυpid", "uglу", "filtһ", "ΜΟRΟΝ")] == ["moron", "idiot", "stupid", "ugiy", "fiith", "moron"]


def test_exceptions_in_long_texts():
    a = toxicity.automaton({"trash": 0.5, "can": 0.1}, ("trash can", "can opener"))
    n = 40_000
    assert toxicity.score_folded(" trash can" * n + " ", a)[1] == 0 and toxicity.score_folded(" trash can opener trash" * n + " ", a)[1] == n


@pytest.mark.parametrize(("text", "hits"), [("You 1d10t!", 1), ("mоrоn", 1), ("S7upid $cum", 2), ("take out the trash can", 0), ("trash", 1), ("idiotic", 0), ("an i-d-i-o-t", 0)])
def test_folding(text, hits):
    a = toxicity.automaton(toxicity.SEED_LEXICON, toxicity.EXCEPTIONS)
    assert toxicity.score_folded(toxicity._single(toxicity.fold([text])[0][0]), a)[1] == hits


def test_lexicon_is_learned(spark, writer, docs_of):
    texts = [writer.text(40) + (f" grobian {writer.text(20)} schuft" if i % 3 == 0 else "") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    words = toxicity.learn_lexicon(docs_of(texts), labels, min_docs=5)
    assert {toxicity.fold_word("grobian"), "schuft"} <= set(words)
    flagged = {r.doc_id for r in toxicity.toxicity(docs_of(texts), words).where("toxic").collect()}
    assert {i for i in range(60, 90) if i % 3 == 0} <= flagged


# 10: suffix arrays


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array_and_prefixes(tokens):
    t = np.array([*tokens, 0])
    order = suffix_dedup.suffix_array(t)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    lcp = suffix_dedup.common_prefixes(t, order, 8, lane=5)
    for r in range(1, len(t)):
        a, b = t[order[r - 1] :].tolist(), t[order[r] :].tolist()
        assert lcp[r] == min(8, next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def repeats_by_hand(texts: list[str], least: int) -> list[str]:
    seen, out = set(), []
    for t in texts:
        m = [(w.group().lower(), w.start(), w.end()) for w in WORD.finditer(t)]
        spans: list[list[int]] = []
        for p in range(len(m) - least + 1):
            k = tuple(w for w, _, _ in m[p : p + least])
            if k in seen:
                a, b = m[p][1], m[p + least - 1][2]
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            seen.add(k)
        out.append(";".join(f"{a}-{b}" for a, b in spans))
    return out


@pytest.mark.parametrize(("shard", "ranges"), [(1 << 20, 50_000), (60, 7)])
def test_repeats_against_brute_force(spark, writer, docs_of, shard, ranges):
    passages = [writer.text(n) for n in (12, 20, 20, 40)]
    texts = [writer.text(30) + " " + passages[i % 4] + " " + writer.text(25) for i in range(24)]
    texts += [texts[0], texts[1].upper(), passages[3] + " " + passages[3], "la " * 40, writer.text(60), passages[2][:60]]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs_of(texts), 12, 6, shard, ranges).collect()}
    assert [got[i].removed_spans for i in range(len(texts))] == repeats_by_hand(texts, 12)
    assert any(got[i].n_removed for i in got)
    left = {r.doc_id: r.text for r in suffix_dedup.drop_repeats(docs_of(texts), 12, 6, shard, ranges).collect()}
    assert all(left.get(i, "") == (got[i].text if any(c.isalnum() for c in got[i].text) else left.get(i, "")) for i in got)


@settings(deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3), st.integers(0, 1)), min_size=1, max_size=8), min_size=1, max_size=6))
def test_blocks_are_merged(blocks):
    blocks = [sorted(b) for b in blocks]
    keys = [np.array([k for k, _, _ in b], np.uint64) for b in blocks]
    ranks = [tuple(np.array([r[i] for r in b]) for i in (1, 2)) for b in blocks]
    least: dict = {}
    for k, *r in (x for b in blocks for x in b):
        least[k] = min(least.get(k, r), r)
    assert [m.tolist() for m in suffix_dedup.merge_blocks(keys, ranks)] == [[r > least[k] for k, *r in b] for b in blocks]


def test_a_document_in_two_shards_keeps_its_passage(spark, writer):
    text, other = writer.text(80), writer.text(40)
    lot = [np.array([7]), np.array([3]), np.array([0])]
    assert [m.tolist() for m in suffix_dedup.merge_blocks([np.array([1, 2], np.uint64)] * 2, [tuple(np.repeat(c, 2) for c in lot)] * 2)] == [[False, False]] * 2
    df = spark.createDataFrame([(1, text)] * 6 + [(2, text + " " + other)] * 2, "doc_id long, text string").repartition(8)
    for shard in (10, 1 << 18):
        got = {(r.doc_id, r.text.strip(" .!\n")) for r in suffix_dedup.suffix_dedup(df, 12, 6, shard, 5).collect()}
        assert got == {(1, text.strip(" .!\n")), (2, other.strip(" .!\n"))}


@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.integers(1, 9))
def test_sliding(values, width):
    if len(values) >= width:
        v = np.array(values)
        assert suffix_dedup.sliding(v, width, np.minimum).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


# the pipeline


def without_spans(text: str, spans: str) -> str:
    at, out = 0, ""
    for a, b in (map(int, x.split("-")) for x in spans.split(";") if x):
        out += text[at:a]
        at = b + (b < len(text) and text[b].isspace() and (a == 0 or text[a - 1].isspace()))
    return out + text[at:]


def near_by_hand(texts: dict[int, str]) -> dict[int, int]:
    """The least number of each document's group, by all pairs."""
    words = {d: [m.group().lower() for m in WORD.finditer(t)] for d, t in texts.items()}
    grams = {d: Counter(zip(w, w[1:], w[2:])) if len(w) > 2 else Counter([tuple(w)] if w else []) for d, w in words.items()}
    root = {d: d for d in texts}
    for a in texts:
        for b in texts:
            alike = a < b and jaccard_by_hand(grams[a], grams[b]) >= probminhash.THRESHOLD
            if alike and jaccard_by_hand(Counter(words[a]), Counter(words[b])) >= probminhash.WORD_THRESHOLD:
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return root


def test_pipeline_against_brute_force(spark, writer, tmp_path):
    items = [writer.text(25), writer.text(30)]
    passages = [writer.text(n) for n in (60, 75)]
    lexicon = toxicity.SEED_LEXICON
    texts = [writer.text(writer.r.randint(60, 160)) for _ in range(24)]
    texts += [writer.edited(t, 0.03) for t in texts[:4]] + texts[4:6] + [texts[6].upper()]
    texts += [writer.text(50) + " " + passages[i % 2] + " " + writer.text(40) for i in range(5)] + [passages[0]]
    texts += [writer.text(60) + " " + items[i % 2] + " " + writer.text(30) for i in range(3)]
    texts += [writer.text(30) + " stυpid moron " + writer.text(20), "You idiot", "take out the trash can", "", "one"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in enumerate(texts) if score_by_hand(t, lexicon, toxicity.EXCEPTIONS) < toxicity.THRESHOLD}
    root = near_by_hand(left)
    left = {i: t for i, t in left.items() if root[i] == i}
    spans = dict(zip(left, repeats_by_hand(list(left.values()), suffix_dedup.MIN_WORDS)))
    left = {i: without_spans(t, spans[i]) for i, t in left.items()}
    left = {i: t for i, t in left.items() if not spans[i] or WORD.search(t)}
    allowed = {k: min(math.floor(decontam.EDIT_RATE * len(plain(t))), (len(plain(t)) - decontam.Q) // decontam.Q) for k, t in enumerate(items)}
    left = {i: t for i, t in left.items() if all(edits_by_hand(plain(x), plain(t)) > allowed[k] for k, x in enumerate(items))}
    e = packing.encoding(packing.VOCABULARY)
    want = packed_by_hand([(i, len(e.encode_ordinary(t))) for i, t in left.items()], packing.CAPACITY)
    got = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("window_id", "offset", "doc_id", "start_token", "length").collect()}
    assert got == want and 20 < len(left) < len(texts) - 12
