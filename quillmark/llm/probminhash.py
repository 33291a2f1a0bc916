"""MinHash near-dedup with ProbMinHash signatures of weighted shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import U64, arrow_map, cut, gram_first, grams, lists, mix, steps, texts_of, words_of
from quillmark.llm.components import components

#: Words of a shingle; its weight is how often it occurs in the document.
K = 3
#: Bands of so many registers.  At probability Jaccard 0.3 a pair shares a band
#: with probability 0.90, at 0.35 with 0.976, at 0.5 with 0.99999.
BANDS, ROWS = 85, 3
#: Least probability Jaccard of near duplicates, over shingles and over single
#: words.  Scattered edits break many shingles but few words; a long passage in
#: texts that differ otherwise keeps its shingles but not most words.
THRESHOLD, WORD_THRESHOLD = 0.3, 0.65
#: Bins of the word profiles that rule out pairs before their texts are fetched.
BINS = 256


def shingles(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted shingles of each text: 48-bit hashes in order, their counts,
    the text of each, and a 128-bit fingerprint of each text's words.

    A text of fewer than ``k`` words is one shingle, one without words none.
    """
    h, _, _, first = words_of(texts)
    n = np.diff(first)
    order = np.arange(len(h)) - np.repeat(first[:-1], n)
    prints = np.zeros((len(texts), 2), U64)
    some = np.flatnonzero(n > 0)
    if len(some):
        for c, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
            v = mix(h ^ mix(order.astype(U64) + U64(salt)))
            prints[some, c] = np.add.reduceat(v, first[some], dtype=U64)
    g, at = grams(h, first, k)
    text_of = np.repeat(np.arange(len(texts)), np.diff(gram_first(at, first)))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        g = np.concatenate([g, prints[short, 0]])
        text_of = np.concatenate([text_of, short])
    key = (text_of.astype(U64) << U64(48)) | (g >> U64(16))
    key, count = np.unique(key, return_counts=True)
    return key & U64((1 << 48) - 1), count.astype(float), (key >> U64(48)).astype(np.int64), prints


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` weighted sets.

    The points of an element arrive as a Poisson process whose rate is its
    weight, each at a random register; a register keeps the element that came
    first.  Elements are taken in turns, one arrival each, and an element stops
    as soon as its time is beyond the latest register of its set (early
    termination), so a set costs about ``size + m log m`` arrivals.
    """
    time = np.full(n * m, np.inf)
    held = np.zeros(n * m, U64)
    e, w, o, t = elements, weights, owner, np.zeros(len(elements))
    turn = 0
    while len(e):
        noise = mix(e + U64(0x9E3779B97F4A7C15 * (2 * turn + 1) % (1 << 64)))
        t = t - np.log1p(-(noise >> U64(11)).astype(float) * 2.0**-53) / w
        cell = o * m + (mix(noise + U64(0x632BE59BD9B4E019)) % U64(m)).astype(np.int64)
        np.minimum.at(time, cell, t)
        won = time[cell] == t
        held[cell[won]] = e[won]
        go = t < time.reshape(n, m).max(axis=1)[o]
        e, w, o, t = e[go], w[go], o[go], t[go]
        turn += 1
    return held.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=U64) + U64(0x51ED27), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * U64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key


def jaccard_p(hx: np.ndarray, wx: np.ndarray, hy: np.ndarray, wy: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets with sorted elements:
    the sum over common d of 1 / sum_e max(x_e / x_d, y_e / y_d)."""
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = wx[i], wy[j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = wx.sum() - x.sum() + np.cumsum(x[::-1])[::-1]
    below = wy.sum() - y.sum() + np.concatenate([[0.0], np.cumsum(y)[:-1]])
    return float((1 / (above / x + below / y)).sum())


def _sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def step(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        for b, e in steps(texts):
            h, w, owner, prints = shingles(texts[b:e], k)
            full = np.flatnonzero(np.bincount(owner, minlength=e - b))
            place = np.zeros(e - b, np.int64)
            place[full] = np.arange(len(full))
            keys = band_keys(signatures(h, w, place[owner], len(full), bands * rows), bands, rows)
            yield pa.record_batch(
                [
                    batch.column(0).slice(b, e - b).take(pa.array(full)), pa.array(prints[full, 0].view(np.int64)), pa.array(prints[full, 1].view(np.int64)),
                    lists(keys.reshape(-1).view(np.int64), np.arange(len(full) + 1) * bands, pa.int64()),
                ],
                names=["doc_id", "hi", "lo", "bands"],
            )

    return arrow_map(docs, step, "doc_id long, hi long, lo long, bands array<long>")


def similarities(x: list[str], y: list[str], k: int) -> np.ndarray:
    """Probability Jaccard of each text of ``x`` with that of ``y``."""
    n = len(x)
    h, w, owner, _ = shingles(x + y, k)
    at = np.searchsorted(owner, np.arange(2 * n + 1))
    part = lambda i: (h[at[i] : at[i + 1]], w[at[i] : at[i + 1]])
    return np.array([jaccard_p(*part(i), *part(n + i)) for i in range(n)])


def alike(x: list[str], y: list[str], k: int, threshold: float, word_threshold: float) -> np.ndarray:
    """Which pairs of texts are near duplicates."""
    out = similarities(x, y, k) >= threshold
    if k > 1 and out.any():
        some = np.flatnonzero(out)
        out[some] = similarities([x[i] for i in some], [y[i] for i in some], 1) >= word_threshold
    return out


def _verified(docs: DataFrame, pairs: DataFrame, k: int, threshold: float, word_threshold: float) -> DataFrame:
    """The pairs (``a, b``) whose documents are near duplicates."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("_x"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("_y"))

    def step(batch: pa.RecordBatch):
        x, y = texts_of(batch.column(2)), texts_of(batch.column(3))
        keep = [alike(x[b:e], y[b:e], k, threshold, word_threshold) for b, e in steps([s + t for s, t in zip(x, y)])]
        yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))

    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y"), step, "a long, b long")


def _profiles(docs: DataFrame) -> DataFrame:
    """For each document the share of its words in each of ``BINS`` bins, as
    16-bit fractions rounded up."""

    def step(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        for b, e in steps(texts):
            words, _, _, first = words_of(texts[b:e])
            n = np.diff(first)
            cell = np.repeat(np.arange(e - b), n) * BINS + (words % U64(BINS)).astype(np.int64)
            share = np.bincount(cell, minlength=(e - b) * BINS).reshape(-1, BINS) / np.maximum(n, 1)[:, None]
            rows = np.ceil(share * 65535).astype("<u2")
            yield pa.record_batch([batch.column(0).slice(b, e - b), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "profile"])

    return arrow_map(docs, step, "doc_id long, profile binary")


def _possible(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` without those whose words can't reach ``threshold``.

    A term of the probability Jaccard is at most the lesser of the element's
    shares in the two sets, so the sum over bins of the lesser share is an upper
    bound: no pair is lost.
    """
    profiles = _profiles(docs)
    left = profiles.select(F.col("doc_id").alias("a"), F.col("profile").alias("_x"))
    right = profiles.select(F.col("doc_id").alias("b"), F.col("profile").alias("_y"))

    def step(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in (2, 3))
        keep = np.minimum(x, y).sum(axis=1, dtype=np.int64) >= threshold * 65535 - 1
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y"), step, "a long, b long").distinct()


def _across(members: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs (``a, b``) of members of a bucket that ``roots`` doesn't have
    in one group."""
    bucket = Window.partitionBy("key")
    placed = members.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = cut(placed.withColumn("_one", F.min("root").over(bucket)).withColumn("_last", F.max("root").over(bucket)).where("_one < _last").select("key", "doc_id", "root"))
    x, y = (mixed.select("key", F.col("doc_id").alias(v), F.col("root").alias(f"_{v}")) for v in "ab")
    return x.join(y, "key").where("a < b AND _a <> _b").select("a", "b").distinct()


def groups(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, word_threshold: float = WORD_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``doc_id, group_id`` of the documents that have words, one row for each
    row; and the verified pairs (``a, b``) of distinct texts."""
    base = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    sketch = cut(_sketches(base, k, bands, rows))
    # Texts with the same words are one text from here on.
    same = sketch.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    tagged = cut(sketch.select("doc_id", "hi", "lo").join(same, ["hi", "lo"]).select("doc_id", "rep"))
    reps = sketch.join(tagged.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    bucket = Window.partitionBy("key")
    members = cut(
        reps.select("doc_id", F.explode("bands").alias("key"))
        .withColumn("_one", F.min("doc_id").over(bucket)).withColumn("_last", F.max("doc_id").over(bucket))
        .where("_one < _last").select("key", "doc_id").distinct()
    )
    # In each bucket all are held against the first two.  Most then are known to
    # be of one group; all other pairs of the bucket are looked at after that.
    ranked = bucket.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = cut(
        members.select(F.col("doc_id").alias("b"), F.array(F.first("doc_id").over(ranked), F.nth_value("doc_id", 2).over(ranked)).alias("hubs"))
        .select("b", F.explode("hubs").alias("a")).where("a < b").distinct()
    )
    edges = cut(_verified(base, pairs, k, threshold, word_threshold).distinct())
    # A row of a repeated doc_id may be a copy of two texts: those meet too.
    roots = components(edges.unionByName(tagged.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")))
    rest = cut(_possible(base, _across(members, roots).join(pairs, ["a", "b"], "left_anti"), word_threshold if k > 1 else threshold))
    more = cut(_verified(base, rest, k, threshold, word_threshold).distinct())
    if more.head(1):
        edges = edges.unionByName(more)
        roots = components(more.unionByName(roots.select(F.col("root").alias("a"), F.col("id").alias("b"))))
    out = tagged.select("doc_id").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))
    return out, edges


def near_duplicates(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, word_threshold: float = WORD_THRESHOLD) -> DataFrame:
    """Groups of near duplicates over all documents.

    Word shingles weighted by their counts get ProbMinHash signatures; texts
    that share a band are verified on the exact probability Jaccard of their
    whole texts, over shingles and over words: first against the two first
    documents of the bucket, then every pair of the bucket that this hasn't
    joined already.  Groups are the connected components.

    Result, one row for each row of ``docs``: ``doc_id, group_id`` (least
    ``doc_id`` of the group), ``keep`` (whether it is that one).  Texts with the
    same words are duplicates without further look.  Null or wordless texts are
    groups of their own, and so are rows of null ``doc_id``, which keep a null
    group and are kept.  Rows of one ``doc_id`` count as one document and get
    the same result.  A similarity equal to its threshold counts; of a group's
    documents that of least ``doc_id`` is kept, so there are no ties.  Texts of
    any length are sketched and verified whole, in time that grows with their
    length.  Further columns are ignored; an empty table gives an empty result.
    """
    found, _ = groups(docs, k, bands, rows, threshold, word_threshold)
    other = found.where("doc_id <> group_id").distinct()
    return docs.select("doc_id").join(other, "doc_id", "left").select(
        "doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.col("group_id").isNull().alias("keep")
    )


def keep_first(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, word_threshold: float = WORD_THRESHOLD) -> DataFrame:
    """Rows of ``docs`` without all but the first document of each group, all
    columns as they were.  Of repeated rows of a kept ``doc_id`` one stays, that
    of least text; rows of null ``doc_id`` all stay."""
    found, _ = groups(docs, k, bands, rows, threshold, word_threshold)
    gone = found.where("doc_id <> group_id").select("doc_id").distinct()
    twice = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if not twice.head(1):
        return docs.join(gone, "doc_id", "left_anti")
    once = docs.join(gone.unionByName(twice), "doc_id", "left_anti")
    one = Window.partitionBy("doc_id").orderBy("text")
    several = docs.join(twice.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi").withColumn("_quillmark_row", F.row_number().over(one)).where("_quillmark_row = 1").drop("_quillmark_row")
    return once.unionByName(several)


def _sql_similarity(name: str, parts: str, k_of: str, pairs: str) -> str:
    """CTEs ``{name}``: the exact probability Jaccard of ``pairs`` over weighted
    ``parts`` (``doc_id, e``).  With the common elements in order of x / y, the
    larger of two ratios is that of x above an element and of y below it."""
    return f"""
{name}_c AS (SELECT doc_id, e, count(*)::DOUBLE AS x FROM {parts} GROUP BY 1, 2),
{name}_t AS (SELECT doc_id, sum(x) AS total FROM {name}_c GROUP BY 1),
{name}_b AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.x, b.x AS y, s.total AS sx, t.total AS sy FROM {name}_c a JOIN {name}_c b ON a.e = b.e AND a.doc_id < b.doc_id
    JOIN {name}_t s ON s.doc_id = a.doc_id JOIN {name}_t t ON t.doc_id = b.doc_id {pairs}),
{name}_p AS (SELECT a, b FROM {name}_b GROUP BY 1, 2 HAVING sum(least(x / sx, y / sy)) >= {k_of} - 1e-9),
{name}_w AS (
  SELECT a, b, x, y, sum(x) OVER hi AS above, sum(y) OVER hi AS y_above, sum(x) OVER al AS cx, sum(y) OVER al AS cy, sx, sy FROM {name}_b JOIN {name}_p USING (a, b)
  WINDOW al AS (PARTITION BY a, b), hi AS (PARTITION BY a, b ORDER BY x / y DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (SELECT a, b FROM {name}_w GROUP BY 1, 2 HAVING sum(1 / ((above + sx - cx) / x + (cy - y_above + sy - cy) / y)) >= {k_of})"""


#: All pairs by their exact similarity, and the components of what is alike.
#: Banding may miss a pair at the threshold; one whose documents are joined
#: through others makes no difference.
ORACLE = f"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
word AS (SELECT doc_id, unnest(w) AS e FROM ws),
gram AS (
  SELECT doc_id, array_to_string(list_slice(w, i, i + {K - 1}), ' ') AS e FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS i FROM ws WHERE len(w) >= {K})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM ws WHERE len(w) BETWEEN 1 AND {K - 1}),
{_sql_similarity("by_gram", "gram", str(THRESHOLD), "")},
{_sql_similarity("by_word", "word", str(WORD_THRESHOLD), "JOIN by_gram g ON g.a = a.doc_id AND g.b = b.doc_id")},
edge AS (SELECT a, b FROM by_word UNION SELECT b, a FROM by_word),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
root AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(root.least, doc_id)) AS group_id, doc_id <= coalesce(root.least, doc_id) AS keep FROM documents LEFT JOIN root USING (doc_id)
"""
