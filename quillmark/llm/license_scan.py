"""Licence scan by diagonal voting over rolling word k-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_map, gram_first, grams, lists, steps, texts_of, words_of
from quillmark.llm.license_texts import TEMPLATES

#: Words of a gram.  The shortest notices have five words, so three of them.
K = 3
#: Diagonals so close are one alignment with insertions or deletions.
SLACK = 4
#: Share of a template's grams that must vote, and of its words that must align.
MIN_VOTES = 0.3
MIN_SIMILARITY = 0.8
#: Template positions up to this number are broadcast; more are joined by a shuffle.
BROADCAST_POSITIONS = 200_000


def template_words(templates: dict[str, str]) -> dict[str, np.ndarray]:
    names = sorted(templates)
    h, _, _, first = words_of([templates[n] for n in names])
    return {n: h[a:b] for n, a, b in zip(names, first, first[1:])}


def aligned_words(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence of ``a`` (the template) and
    ``b``, and the first and last index in ``b`` of one such alignment that is
    as short as the row-wise recursion finds."""
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        row = np.maximum(score[i - 1, 1:], score[i - 1, :-1] + (b == a[i - 1]))
        score[i, 1:] = np.maximum.accumulate(row)
    best = int(score[n, m])
    if not best:
        return 0, 0, 0
    j = int(np.argmax(score[n] == best))
    last, i = j - 1, n
    begin = last
    while i and j and score[i, j]:
        if score[i - 1, j] == score[i, j]:
            i -= 1
        elif score[i, j - 1] == score[i, j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            begin = j
    return best, begin, last


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, slack: int = SLACK, min_votes: float = MIN_VOTES, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Find licence notices in all documents.

    All word ``k``-gram hashes of all documents are joined in Spark to the
    positions that the templates have them at.  Each match votes for the
    diagonal (document position minus template position); neighbouring
    diagonals over nearby words are merged; what has enough votes is verified
    by aligning the words of the span with the template.

    Result, one row for each verified span: ``doc_id, license, start_char,
    end_char, votes, similarity`` (common words over the longer of template and
    span); offsets are into the original text.  Where spans of a document
    overlap, that with the most words in common stays, then the most similar,
    then the earliest, then that of the first template by name.  Texts that are
    null or of fewer than ``k`` words and rows of null ``doc_id`` give nothing.
    Repeated rows give their spans once; rows that share only ``doc_id`` are told
    apart by their text, and each gives its own.  Texts of any length are
    scanned whole; only the words about a span are aligned.
    Templates of fewer than ``k`` words can't match.  Further columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = template_words(TEMPLATES if templates is None else templates)
    names = sorted(words)
    rows, sizes = [], []
    for t, name in enumerate(names):
        g, at = grams(words[name], np.array([0, len(words[name])]), k)
        rows += [(int(h), t, int(p)) for h, p in zip(g.view(np.int64), at)]
        sizes.append((t, max(1, int(np.ceil(len(g) * min_votes))), len(words[name])))
    positions = spark.createDataFrame(rows, "h long, tid int, tpos int")
    need = spark.createDataFrame(sizes, "tid int, need int, size int")
    base = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")

    def hash_all(batch: pa.RecordBatch):
        texts = texts_of(batch.column(2))
        for b, e in steps(texts):
            h, _, _, first = words_of(texts[b:e])
            g, at = grams(h, first, k)
            yield pa.record_batch([batch.column(0).slice(b, e - b), batch.column(1).slice(b, e - b), lists(g.view(np.int64), gram_first(at, first), pa.int64())], names=["doc_id", "_h", "grams"])

    rolled = arrow_map(base, hash_all, "doc_id long, _h long, grams array<long>").select("doc_id", "_h", F.posexplode("grams").alias("dpos", "h"))
    small = len(rows) <= BROADCAST_POSITIONS
    votes = (
        rolled.join(F.broadcast(positions) if small else positions, "h")
        .groupBy("doc_id", "_h", "tid", (F.col("dpos") - F.col("tpos")).alias("diag"))
        .agg(F.countDistinct("tpos").alias("votes"), F.min("dpos").alias("lo"), F.max("dpos").alias("hi"))
    )
    # Neighbouring diagonals in order of document position: a new alignment
    # begins where the diagonal jumps by more than the slack.
    order = Window.partitionBy("doc_id", "_h", "tid").orderBy("diag", "lo", "hi")
    merged = (
        votes.withColumn("_new", F.when(F.col("diag") - F.lag("diag").over(order) <= slack, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(order))
        .groupBy("doc_id", "_h", "tid", "_run").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .join(F.broadcast(need), "tid").where("votes >= need")
        .groupBy("doc_id", "_h").agg(F.collect_list(F.struct("tid", "votes", "lo", "hi")).alias("_spans"))
    )
    # Only texts that hold enough grams of some template are shuffled to their
    # spans: a test of each text by itself, which no text with such a span fails.
    known, begin, size = np.unique(np.array([r[0] for r in sorted(rows)], np.int64), return_index=True, return_counts=True)
    tid = np.array([r[1] for r in sorted(rows)], np.int64)
    enough = np.array([n for _, n, _ in sizes], np.int64)

    def likely(batch: pa.RecordBatch):
        texts, keep = texts_of(batch.column(2)), np.zeros(batch.num_rows, bool)
        for b, e in steps(texts):
            h, _, _, first = words_of(texts[b:e])
            g, at = grams(h, first, k)
            i = np.minimum(np.searchsorted(known, g.view(np.int64)), len(known) - 1)
            held = np.flatnonzero(known[i] == g.view(np.int64))
            i, doc = i[held], np.searchsorted(first, at[held], "right") - 1
            n = size[i]
            which = tid[np.repeat(begin[i] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pair, votes = np.unique(np.repeat(doc, n) * len(enough) + which, return_counts=True)
            keep[b + pair[votes >= enough[pair % len(enough)]] // len(enough)] = True
        yield batch.filter(pa.array(keep))

    if small and len(known):
        base = arrow_map(base, likely, base.schema)

    def verify(batch: pa.RecordBatch):
        out: list[tuple] = []
        texts = texts_of(batch.column(1))
        spans = batch.column(2).to_pylist()
        for doc, text, found in zip(batch.column(0).to_pylist(), texts, spans):
            h, start, end, _ = words_of([text])
            hits = []
            for s in found:
                want = words[names[s["tid"]]]
                a, b = max(0, s["lo"] - len(want) // 4 - slack), min(len(h), s["hi"] + k + len(want) // 4 + slack)
                common, i, j = aligned_words(want, h[a:b])
                sim = common / max(len(want), j - i + 1)
                if sim >= min_similarity:
                    hits.append((-common, -sim, int(start[a + i]), int(end[a + j]), names[s["tid"]], s["votes"]))
            taken: list[tuple] = []
            for hit in sorted(hits):
                if all(hit[3] <= x[2] or x[3] <= hit[2] for x in taken):
                    taken.append(hit)
            out += [(doc, name, x, y, v, -s) for _, s, x, y, name, v in sorted(taken, key=lambda r: r[2:])]
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.record_batch([pa.array(list(c), kind) for c, kind in zip(cols, kinds)], names=["doc_id", "license", "start_char", "end_char", "votes", "similarity"])

    return arrow_map(base.join(merged, ["doc_id", "_h"]).select("doc_id", "text", "_spans"), verify, "doc_id long, license string, start_char long, end_char long, votes long, similarity double").distinct()
