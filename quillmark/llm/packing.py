"""Packing into fixed windows by minimum bin slack."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_map, cut, texts_of

#: Tokens of a window.
CAPACITY = 2048
#: Ranks of the public byte-level vocabulary; the pattern is that of its README.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(4)
def encoding_of(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str) -> tiktoken.Encoding:
    return encoding_of(Path(path).read_bytes())


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset of lengths that holds the largest and leaves least slack.

    Bitset subset-sum: bit ``s`` of the set after the first ``i`` lengths says
    that ``s`` can be made of them within their counts (binary splitting).  The
    chosen sum is traced back from the largest length to the smallest, as many
    of each as the smaller ones can complete.
    """
    top = max(counts)
    room = capacity - top
    have = dict(counts)
    have[top] -= 1
    lengths = sorted(x for x, c in have.items() if c > 0 and x <= room)
    mask, bits, before = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        before.append(bits)
        n, part = min(have[x], room // x), 1
        while n > 0:
            part = min(part, n)
            bits |= (bits << (x * part)) & mask
            n -= part
            part *= 2
    left, chosen = bits.bit_length() - 1, {top: 1}
    for i in range(len(lengths) - 1, -1, -1):
        x = lengths[i]
        k = min(have[x], left // x)
        while not before[i] >> (left - k * x) & 1:
            k -= 1
        if k:
            chosen[x] = chosen.get(x, 0) + k
            left -= k * x
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fills and how many windows in a row use each.

    A fill is used again for as long as the counts allow, which is what the
    search would choose anyway but for ties, and uses up a length or leaves too
    few of it; so there are about as many fills as lengths, whatever the number
    of documents.
    """
    counts = {x: c for x, c in counts.items() if c > 0}
    out = []
    while counts:
        fill = best_fill(counts, capacity)
        times = min(counts[x] // k for x, k in fill.items())
        out.append((fill, times))
        for x, k in fill.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return out


def slots(fills: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each fill that uses it, how many a window
    takes, the first window of the fill, and where in a window they begin."""
    out: dict[int, list] = {}
    window, used = 0, {}
    for fill, times in fills:
        at = 0
        for x in sorted(fill, reverse=True):
            out.setdefault(x, []).append((used.get(x, 0), fill[x], window, at))
            used[x] = used.get(x, 0) + fill[x] * times
            at += x * fill[x]
        window += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in out.items()}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and the number of tokens of the whole text.

    The driver reads the vocabulary and sends it to the executors, so only the
    driver needs to have the file; its size doesn't depend on the documents.
    """
    held = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def step(batch: pa.RecordBatch):
        encode = encoding_of(held.value).encode_ordinary
        yield pa.record_batch([batch.column(0), pa.array([len(encode(t)) for t in texts_of(batch.column(1))], pa.int64())], names=["doc_id", "n_tokens"])

    return arrow_map(docs.select("doc_id", "text"), step, "doc_id long, n_tokens long")


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``doc_id, n_tokens``; see :func:`pack`.

    One range shuffle puts the rows in the order of (remaining length, doc_id,
    tokens), whatever the number of partitions; it is written to the checkpoint
    folder, so a row's place stays what it was.  The place within a length, and
    with it the window, follows from the numbers of rows in the partitions
    before.
    """
    size = (F.col("n_tokens") % capacity).cast("int").alias("length")
    order = ("length", "doc_id", "n_tokens")
    laid = cut(
        lengths.select("doc_id", "n_tokens", size).where("n_tokens > 0").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    )
    hist = {r.length: r.n for r in laid.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    smaller = dict(zip(sorted(hist), np.cumsum([0, *(hist[x] for x in sorted(hist))])))
    fills = plan({x: n for x, n in hist.items() if x}, capacity)
    table = slots(fills)
    parts = laid.groupBy(F.shiftright("_row", 33).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / capacity)).alias("w")).orderBy("p").collect()
    rows_before = dict(zip([r.p for r in parts], np.cumsum([0, *(r.n for r in parts)])))
    windows = sum(t for _, t in fills)  # those of whole documents come after
    full_before = dict(zip([r.p for r in parts], windows + np.cumsum([0, *(r.w for r in parts)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tokens, length, row = batch.column(0), *(batch.column(i).to_numpy() for i in (1, 2, 3))
            p = int(row[0]) >> 33
            rank = rows_before[p] + (row & ((1 << 33) - 1))
            window, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            cuts = np.flatnonzero(np.diff(length, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(row))):
                if x := int(length[a]):
                    first, each, base, at = table[x]
                    k = rank[a:b] - smaller[x]
                    f = np.searchsorted(first, k, "right") - 1
                    k = k - first[f]
                    window[a:b] = base[f] + k // each[f]
                    offset[a:b] = at[f] + k % each[f] * x
            some = np.flatnonzero(length)
            yield _pieces(window[some], offset[some], ids.take(pa.array(some)), (tokens - length)[some], length[some])
            whole = tokens // capacity
            for a, b in _ranges(whole):
                at = np.repeat(np.arange(a, b), whole[a:b])
                start = begun.get(p, full_before[p])
                k = np.arange(len(at)) - np.repeat(np.cumsum(whole[a:b]) - whole[a:b], whole[a:b])
                yield _pieces(start + np.arange(len(at)), np.zeros(len(at), np.int64), ids.take(pa.array(at)), k * capacity, np.full(len(at), capacity))
                begun[p] = start + len(at)

    return laid.mapInArrow(run, "window_id long, offset long, doc_id long, start_token long, length long")


def _pieces(window: np.ndarray, offset: np.ndarray, ids: pa.Array, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(window), pa.array(offset), ids, pa.array(start), pa.array(length.astype(np.int64))], names=["window_id", "offset", "doc_id", "start_token", "length"])


def _ranges(whole: np.ndarray, limit: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs of documents with some whole window, of about ``limit`` windows."""
    a, held = 0, 0
    for i, n in enumerate(whole.tolist()):
        held += n
        if held >= limit:
            yield a, i + 1
            a, held = i + 1, 0
    if held:
        yield a, len(whole)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack the tokens of all documents into windows of ``capacity`` tokens.

    A document of at least ``capacity`` tokens fills whole windows; what
    remains of each document is a piece of its own.  Window by window, the
    largest remaining piece is taken and bitset subset-sum dynamic programming
    over the remaining lengths completes it to the fullest window there is.
    Only the number of pieces of each length matters for that, so the search
    runs on a table of at most ``capacity`` counts, over all documents.

    Result, one row for each piece: ``window_id, offset, doc_id, start_token,
    length``; a piece is the tokens of the document from ``start_token`` and
    stands at ``offset`` in its window.  The result is a function of the rows
    alone: pieces of one length take their places in the order of (doc_id,
    tokens of the document), null first, and whole windows are numbered after
    all others in the order of (remaining length, doc_id, tokens).  Rows equal
    in these are alike in every column of the result.  Of fills that are
    equally full, that with more of the longer pieces is taken.

    Null or empty text has no tokens and no row.  Null ``doc_id`` stays null.
    Repeated rows are packed each.  Texts of any length are encoded whole.
    Further columns are ignored; an empty table gives an empty result.
    """
    # Written once: the range shuffle samples its input before it reads it.
    return pack_lengths(cut(token_counts(docs, vocabulary)), capacity)
