"""Nulls, empty and very long texts, repeated rows, ties, empty tables, and
columns whose names clash, for each operator and pipeline stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import decontam, license_scan, packing, pq_neardup, probminhash, quality_rank, suffix_dedup, toxicity, unit_dedup, warc_index
from quillmark.llm import queries as Q

CLASH = (
    "_h _n _gone _spans _lead _hot _first _last _b _local _before _toxic _quality _good _limit a b n w t x y hi lo at key rep lead root id bands anchor g toxic score keep hits n_words text_hash "
    "group_id n_units removed_spans window_id offset length start_token n_tokens votes tid diag dpos tpos edits shared item_id block list share codes error own lists range_id run seq pos"
).split()
LONG = 400_000


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def corpus(spark):
    base = "The quick brown fox jumps over the lazy dog while nine more sleepy animals watch from a distance and wonder. "
    rows = [
        (0, "", "en", "s", 0), (1, None, None, None, None), (None, base, "en", "s", 5), (None, None, None, None, None), (2, base * 8, "en", "s", 1), (3, base * 8, "en", "s", 1), (2, base * 8, "en", "s", 1),
        (4, "a" * LONG, "en", "s", 1), (5, "la " * (LONG // 4), "en", "s", 1), (6, " \n\t\n ", "en", "s", 1), (7, "one", "en", "s", 1), (8, "You idiot moron scum", "en", "s", 1), (9, "日本語 \U0001d41a\U0001d41b é ​…", "ja", "s", 1),
        (10, "Licensed under CC BY 4.0.", "en", "s", 1), (2, "another text of the same number", "en", "s", 1), (11, "\x00 � ... !!! ???", "en", "s", 1), (12, "\n".join(["A line of just four words here."] * 50), "en", "s", 1),
    ]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 1, 0), (2, 1, 0), (3, 1, None), (5, 0, 0), (8, None, 1), (None, 1, 1), (8, 0, 1), (99, 1, 1)]
    return clashing(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(0, "nine more sleepy animals watch from a distance"), (1, None), (None, "jumps over the lazy dog while"), (2, ""), (3, "x"), (0, "nine more sleepy animals watch from a distance"), (4, "la " * 40)]
    return clashing(spark.createDataFrame(rows, "item_id long, text string"))


def empty(df):
    return df.where("false")


def per_doc(df, *cols):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols))
    return out


def test_toxicity(corpus, labels):
    got = per_doc(toxicity.toxicity(corpus, toxicity.lexicon_for(corpus, labels)), "toxic", "score", "n_words")
    assert sum(map(len, got.values())) == 17 and got[8][0][0] and got[1] == [(False, 0.0, 0)] and got[6] == [(False, 0.0, 0)] and len(got[2]) == 3 and len(got[None]) == 2
    assert toxicity.toxicity(empty(corpus)).count() == 0 and toxicity.learn_lexicon(empty(corpus), empty(labels)) == {}
    kept = toxicity.keep_clean(corpus, toxicity.SEED_LEXICON)
    assert kept.count() == 16 and kept.columns == corpus.columns and toxicity.keep_clean(empty(corpus), {}).count() == 0


def test_near_duplicates(corpus):
    got = per_doc(probminhash.near_duplicates(corpus), "group_id", "keep")
    assert got[2] == [(2, True)] * 3 and got[3] == [(2, False)] and got[0] == [(0, True)] and got[None] == [(None, True)] * 2 and got[6] == [(6, True)]
    kept = probminhash.keep_first(corpus)
    assert kept.columns == corpus.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12] and kept.where("doc_id IS NULL").count() == 2
    assert probminhash.near_duplicates(empty(corpus)).count() == 0 and probminhash.keep_first(empty(corpus)).count() == 0


def test_suffix_dedup(corpus):
    got = per_doc(suffix_dedup.suffix_dedup(corpus), "text", "n_removed")
    assert sum(map(len, got.values())) == 17 and got[1] == [(None, 0)] and got[0] == [("", 0)] and got[4] == [("a" * LONG, 0)]
    assert {n for _, n in got[2]} == {0, 1} and all(n == 1 for _, n in got[3]) and got[5][0][0] == "la " and ("another text of the same number", 0) in got[2]
    left = suffix_dedup.drop_repeats(corpus)
    assert left.columns == corpus.columns and left.count() == 16 and left.where("doc_id = 3").count() == 0
    assert suffix_dedup.suffix_dedup(empty(corpus)).count() == 0 and suffix_dedup.drop_repeats(empty(corpus)).count() == 0


def test_decontamination(corpus, benchmark):
    got = per_doc(decontam.decontaminate(corpus, benchmark), "item_id", "edits")
    assert set(got) == {None, 2, 3, 5} and (0, 0) in got[None] and len([x for x in got[3] if x[0] == 0]) == 8
    kept = decontam.drop_contaminated(corpus, benchmark)
    assert kept.columns == corpus.columns and {2, 3, 5}.isdisjoint({r.doc_id for r in kept.where("length(text) > 40").collect()}) and kept.where("doc_id = 2").count() == 1
    assert decontam.decontaminate(corpus, empty(benchmark)).count() == 0 and decontam.decontaminate(empty(corpus), benchmark).count() == 0
    assert decontam.drop_contaminated(corpus, empty(benchmark)).count() == 17


def test_packing(corpus):
    rows = packing.pack(corpus).collect()
    assert {r.doc_id for r in rows} == {None, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12} and max(r.offset + r.length for r in rows) <= packing.CAPACITY
    assert packing.pack(empty(corpus)).count() == 0


def test_lines(corpus):
    got = per_doc(unit_dedup.unit_dedup(corpus), "text", "n_removed")
    assert sum(map(len, got.values())) == 17 and got[1] == [(None, 0)] and got[3][0][0].strip() == "" and got[12][0][0].strip() == "A line of just four words here."
    assert unit_dedup.unit_dedup(empty(corpus)).count() == 0


def test_licences(corpus):
    got = license_scan.license_scan(corpus).collect()
    assert [(r.doc_id, r.license, r.start_char, r.end_char) for r in got] == [(10, "cc-by-4.0-line", 0, 24)]
    assert license_scan.license_scan(empty(corpus)).count() == 0 and license_scan.license_scan(corpus, {"tiny": "one two"}).count() == 0


def test_quality(corpus, labels):
    got = per_doc(quality_rank.quality_rank(corpus, labels), "score", "keep")
    assert sum(map(len, got.values())) == 17 and len(got[2]) == 3
    none = quality_rank.quality_rank(corpus, empty(labels)).collect()
    assert all(r.score == 0 and r.keep for r in none) and len(none) == 17
    assert quality_rank.quality_rank(empty(corpus), labels).count() == 0


def test_embeddings(spark):
    v = [1.0, 2.0, 2.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, None, 0), (None, v, 0), (4, [0.0, 0.0, 0.0], None), (5, [1.0], 0), (6, [1.0, None, 2.0], 0), (7, [float("nan"), 1.0, 1.0], 0), (8, [-3.0, 0.0, 1.0], 0), (9, [2.0, 4.0, 4.001], 0), (10, [], 0)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted((r.vec_a, r.vec_b) for r in pq_neardup.near_pairs(df).collect()) == [(1, 2), (1, 9), (2, 9)]
    assert pq_neardup.near_pairs(empty(df)).count() == 0 and pq_neardup.near_pairs(df.where("vec_id = 1")).count() == 0


def test_captures(spark):
    rows = [(1, "http://A.com/x", "h"), (1, "http://a.com/x", "h"), (2, "https://www.a.com/x#f", None), (3, None, "h"), (None, "http://a.com/x", "h"), (4, "", ""), (5, "http://a.com/" + "y" * 100_000, None), (6, "http://a.com/x", None), (7, "http://a.com/x", None)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc_index.capture_index(df).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 8)) and [r.page_id for r in got if r.urlkey == "com,a)/x"] == [1, 1, 2, 6, 7] and [r.revisit for r in got if r.urlkey == "com,a)/x"] == [False, True, False, True, True]
    assert warc_index.capture_index(df, range_rows=2, run_rows=2).orderBy("pos").collect() == got
    timed = warc_index.capture_index(df.withColumn("at", F.when(F.col("page_id") == 7, F.lit("2020-01-01").cast("timestamp"))), time="at").orderBy("pos").collect()
    assert [r.page_id for r in timed if r.urlkey == "com,a)/x"] == [1, 1, 2, 6, 7] and timed[-2].ts in ("", "20200101000000")
    assert warc_index.capture_index(empty(df)).count() == 0


@pytest.fixture(scope="module")
def folder(tmp_path_factory, corpus, labels, benchmark):
    at = tmp_path_factory.mktemp("tables")
    for name, df in (("documents", corpus), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns(spark, folder, tmp_path, k):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    _, stage = corpus_pipeline.STAGES[k]
    for df in (docs, empty(docs)):
        out = stage(spark, df, folder)
        out.write.mode("overwrite").parquet(str(tmp_path / "out"))
        assert k == 4 or out.columns == docs.columns


def test_pipeline(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert 8 not in ids and 3 not in ids and {4, 7, 9, 10, 12} <= ids


def test_pipeline_against_its_stages(spark, tmp_path, writer):
    """Planted copies, passages, leaks and insults go; the rest stays as it was."""
    item, passage = writer.text(40), writer.text(70)
    clean = [writer.text(150) for _ in range(12)]
    texts = clean + [writer.edited(clean[0], 0.04), clean[1], writer.text(90) + " " + item + " " + writer.text(90), writer.text(90) + " you idiot moron scum idiot"]
    texts += [writer.text(120) + " " + passage + " " + writer.text(120) for _ in range(2)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r.doc_id: r for r in docs.collect()}
    assert sorted(left) == [*range(12), 16, 17]
    assert all(left[i].text == clean[i] for i in range(12)) and left[16].text == texts[16] and left[17].n_chars == len(left[17].text) < len(texts[17]) - 300
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == set(left)


def test_every_operator_has_a_query():
    assert sorted({int(k[2:].split("_")[0]) for k in Q.QUERIES if k.startswith("op")}) == list(range(1, 11)) and set(Q.ORACLES) <= set(Q.QUERIES)
