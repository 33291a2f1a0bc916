"""Quality scores by Bradley-Terry ranking of document features."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import _CACHE, arrow_map, codes_of, cut, grams, gram_first, steps, texts_of, words_of

#: Bound on the labelled documents that the weights are fitted on.
LEARN_DOCS = 20_000
#: Preference pairs drawn for each document of the smaller side.
PAIRS_EACH = 8
#: L2 penalty of the weights, for each pair.
RIDGE = 1e-4
#: Share of each labelled side that may lie beyond the threshold.
TAIL = 0.005
NAMES = (
    "log_words", "upper", "digit", "mark", "symbol", "space", "letters_a_word", "words_a_line", "distinct_words",
    "repeat_next", "distinct_pairs", "marks_a_word", "end_mark_lines",
)


def sign_table() -> np.ndarray:
    """For each code point: 0 other letter, 1 upper case letter, 2 digit,
    3 punctuation of prose, 4 other sign, 5 white space."""
    if "signs" not in _CACHE:
        t = np.full(0x110000, 4, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isspace():
                t[c] = 5
            elif s.isdigit():
                t[c] = 2
            elif s.isalpha():
                t[c] = 1 if s.isupper() else 0
        for s in ".,;:'\"-()?’“”«»¿¡":
            t[ord(s)] = 3
        _CACHE["signs"] = t
    return _CACHE["signs"]


def _distinct(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each text."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, at))
    v, a = values[order], at[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (a[1:] != a[:-1])
    return np.bincount(a[new], minlength=n).astype(float)


def features(texts: list[str]) -> np.ndarray:
    """One row of ``NAMES`` for each text; all are shares or means, so they
    don't grow with the length but for the first."""
    n = len(texts)
    codes, begins = codes_of(texts)
    sign = sign_table()[codes]
    per = lambda mask: np.add.reduceat(mask, begins[:-1], dtype=np.int64).astype(float)
    chars = np.maximum(np.diff(begins) - 1, 1).astype(float)
    counts = [per(sign == k) for k in range(6)]
    h, start, end, first = words_of(texts)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    at = np.repeat(np.arange(n), np.diff(first))
    pair, where = grams(h, first, 2)
    pair_at = at[where]
    next_same = np.zeros(len(h), bool)
    if len(h) > 1:
        next_same[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    breaks = codes == 10
    lines = per(breaks)  # each text ends with one
    closed = np.zeros(len(codes), bool)
    closed[1:] = breaks[1:] & np.isin(codes[:-1], [46, 33, 63])
    return np.column_stack([
        np.log1p(words), counts[1] / chars, counts[2] / chars, counts[3] / chars, counts[4] / chars, (counts[5] - 1) / chars,
        np.bincount(at, weights=(end - start), minlength=n) / some, np.log1p(words / np.maximum(lines, 1)), _distinct(h, at, n) / some,
        np.bincount(at[next_same], minlength=n) / some, _distinct(pair, pair_at, n) / np.maximum(np.bincount(pair_at, minlength=n), 1),
        (counts[3] + counts[4]) / some, per(closed) / np.maximum(lines, 1),
    ])


def preference_pairs(better: np.ndarray, worse: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (better, worse): each document of the smaller side meets at
    least ``each`` of the other side, and each of the larger side at least one;
    both sides are gone through evenly from first to last."""
    a, b = len(better), len(worse)
    if not a or not b:
        return np.zeros(0, int), np.zeros(0, int)
    n = max(a, b, min(a, b) * each)
    k = np.arange(n)
    large, small = k % max(a, b), k * min(a, b) // n
    return (large, small) if a >= b else (small, large)


def fit(x: np.ndarray, y: np.ndarray, each: int = PAIRS_EACH, ridge: float = RIDGE, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights.

    A pair (i, j) has P(i better) = 1 / (1 + exp(-w (x_i - x_j))).  Newton steps
    on the mean logistic loss of feature differences with an L2 penalty; with
    no pair the weights are 0.
    """
    centre = x.mean(axis=0) if len(x) else np.zeros(len(NAMES))
    scale = x.std(axis=0) if len(x) else np.ones(len(NAMES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    better, worse = z[y > 0], z[y == 0]
    i, j = preference_pairs(better, worse, each)
    w = np.zeros(len(NAMES))
    if not len(i):
        return centre, scale, w
    d = better[i] - worse[j]
    loss = lambda v: np.logaddexp(0, -d @ v).mean() + ridge / 2 * v @ v
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        g = -(d * p[:, None]).mean(axis=0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        move, size, now = np.linalg.solve(hess, g), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return centre, scale, w


def _features_of(df: DataFrame, extra: str) -> DataFrame:
    """``doc_id``, features as a list, and the column ``extra``."""

    def step(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        x = np.concatenate([features(texts[b:e]) for b, e in steps(texts)])
        yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", extra])

    return arrow_map(df.select("doc_id", "text", extra), step, f"doc_id long, x array<double>, {extra} int")


def learn(docs: DataFrame, labels: DataFrame, bound: int = LEARN_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit on at most ``bound`` labelled documents, those of least MD5 of the
    id, in that order, so that pairs don't follow the order of ids."""
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(bound)
    )
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    rows = sorted(_features_of(sample, "_quality").collect(), key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(NAMES))
    return fit(x, np.array([r["_quality"] for r in rows], int))


def quality_rank(docs: DataFrame, labels: DataFrame, quantile: float | None = None, tail: float = TAIL, bound: int = LEARN_DOCS) -> DataFrame:
    """Score every document and keep those above a score quantile.

    Weights are learned from preference pairs (quality 1 over quality 0) of at
    most ``bound`` labelled documents.  With ``quantile`` given, the threshold
    is that quantile of the scores of all documents.  By default it lies midway
    between the upper ``tail`` quantile of all documents labelled low and the
    lower ``tail`` quantile of all labelled high, so that it doesn't hang on how
    exactly the share of bad documents is known.  Rank errors are 1e-5.

    Result, one row for each row of ``docs``: ``doc_id, score, keep``.  Ties at
    the threshold are kept.  Null text counts as empty and is scored as such;
    null ``doc_id`` stays null; repeated rows are scored each.  Without labels
    of both kinds all scores are 0 and all rows are kept.  Texts of any length
    are read whole, in time that grows with their length.  Further columns are
    ignored; an empty table gives an empty result.
    """
    centre, scale, w = learn(docs, labels, bound)

    def step(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        s = np.concatenate([((features(texts[b:e]) - centre) / scale) @ w for b, e in steps(texts)])
        yield pa.record_batch([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = cut(arrow_map(docs.select("doc_id", "text"), step, "doc_id long, score double"))
    if quantile is not None:
        limit = scored.agg(F.percentile_approx("score", quantile, 100_000).alias("_limit"))
    else:
        known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).alias("_good"))
        side = scored.join(known, "doc_id").agg(
            F.percentile_approx(F.when(F.col("_good"), F.col("score")), tail, 100_000).alias("_high"),
            F.percentile_approx(F.when(~F.col("_good"), F.col("score")), 1 - tail, 100_000).alias("_low"),
        )
        limit = side.select(((F.col("_high") + F.col("_low")) / 2).alias("_limit"))
    return scored.crossJoin(F.broadcast(limit)).select("doc_id", "score", F.coalesce(F.col("score") >= F.col("_limit"), F.lit(True)).alias("keep"))
