"""Repeated passages by suffix arrays of shards and a merge across shards."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import U64, arrow_map, cut, lists, mix, powers, steps, texts_of, words_of

#: Words of the shortest passage that counts as a repeat.
MIN_WORDS = 50
#: Words of an anchor.  Every passage of MIN_WORDS words holds one.
ANCHOR_WORDS = 25
#: Words of a shard.
SHARD_WORDS = 1 << 18
#: Anchors for each range of the merge across shards.
RANGE_ANCHORS = 50_000


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position, however long ``k`` is."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    n, have, out = len(values) - width + 1, 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[:n], out[width - have : width - have + n])


def anchors(hashes: np.ndarray, first: np.ndarray, least: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of each window of ``least`` words (0 where it would leave its
    text), hash of ``size`` words from each position, and whether that is
    chosen as the anchor of some window.

    The anchor of a window is the least hash of ``size`` words in it, so it
    depends on the words of the window alone.
    """
    n = len(hashes)
    if n < least:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
    grams = rolling(hashes, size) | U64(1)
    width = least - size + 1
    window = sliding(grams, width, np.minimum)
    left = np.repeat(first[1:], np.diff(first))[: len(window)] - np.arange(len(window))
    window = np.where(left >= least, window, U64(0))
    wide = np.concatenate([np.zeros(width - 1, U64), window, np.zeros(width - 1, U64)])
    return window, grams, sliding(wide, width, np.maximum)[: len(grams)] == grams


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffix array of ``tokens``, whose last is found nowhere else, by
    Larsson-Sadakane refinement.

    Suffixes are grouped by their first ``h`` tokens and numbered by the place
    where their group begins; only groups of more than one are sorted again, by
    the number of the suffix ``h`` further on, and ``h`` doubles.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    head = np.ones(n, bool)
    head[1:] = tokens[order[1:]] != tokens[order[:-1]]
    group = np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h, todo = 1, _unsorted(head)
    while len(todo):
        at = order[todo]
        key = group[at] * n + group[at + h]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[todo] = at
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group[at] = np.maximum.accumulate(np.where(new, todo, 0))
        alone = new & np.append(new[1:], True)
        todo = todo[~alone]
        h *= 2
    return order


def _unsorted(head: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~(head & np.append(head[1:], True)))


def common_prefixes(tokens: np.ndarray, order: np.ndarray, cap: int, lane: int = 256) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by Kasai:
    the prefix at a text position is at least that of the position before, less
    one.  Lanes of consecutive positions advance together; prefixes are counted
    up to ``cap``, which is all that a threshold needs."""
    n = len(tokens)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.append(-1, order[:-1])[rank]  # text position of the neighbour
    lcp = np.zeros(n, np.int64)
    i = np.arange(0, n, lane)
    end = np.minimum(i + lane, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        # the last token is unique, so no match runs over the end
        more = (h < cap) & (j >= 0)
        more[more] = tokens[i[more] + h[more]] == tokens[j[more] + h[more]]
        h += more
        done = ~more
        lcp[rank[i[done]]] = h[done]
        i = i + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        if (on := i < end).all():
            continue
        i, end, h = i[on], end[on], h[on]
    return lcp


def settled(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, once each, and the least rank of each."""
    by = np.lexsort((ranks, keys))
    keys, ranks = keys[by], ranks[by]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return keys[new], ranks[new]


def merge_two(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted blocks as one: each key of the smaller finds its place in the
    larger by binary search; where both have a key, the lower rank stays."""
    if len(x[0]) < len(y[0]):
        x, y = y, x
    if not len(y[0]):
        return x
    at = np.searchsorted(x[0], y[0])
    met = x[0][np.minimum(at, len(x[0]) - 1)] == y[0]
    least = x[1].copy()
    least[at[met]] = np.minimum(least[at[met]], y[1][met])
    return np.insert(x[0], at[~met], y[0][~met]), np.insert(least, at[~met], y[1][~met])


def merge_blocks(keys: list[np.ndarray], ranks: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """For each sorted block, which of its keys have an occurrence of lower
    rank in any block.  Occurrences of equal rank are one place.

    Blocks are merged two by two, the smallest first, until one is left; each
    then looks up its own keys there, again by binary search.
    """
    columns = [np.concatenate(c) for c in zip(*ranks)]
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), bool)
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    own = np.split(rank, np.cumsum([len(k) for k in keys])[:-1])
    heap = [(len(k), i, settled(k, r)) for i, (k, r) in enumerate(zip(keys, own))]
    heapify(heap)
    while len(heap) > 1:
        (_, i, x), (_, _, y) = heappop(heap), heappop(heap)
        z = merge_two(x, y)
        heappush(heap, (len(z[0]), i, z))
    every, least = heap[0][2]
    return [r > least[np.searchsorted(every, k)] for k, r in zip(keys, own)]


def _anchor_lists(docs: DataFrame, least: int, size: int) -> DataFrame:
    """Distinct anchors of each document and how often each is chosen."""

    def step(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        for b, e in steps(texts):
            h, _, _, first = words_of(texts[b:e])
            _, grams, chosen = anchors(h, first, least, size)
            at = np.flatnonzero(chosen)
            doc = np.searchsorted(first, at, "right") - 1
            by = np.lexsort((grams[at], doc))
            g, doc = grams[at][by], doc[by]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
            starts = np.flatnonzero(new)
            some, n = np.unique(doc[starts], return_counts=True)
            ends, rows = np.append(0, np.cumsum(n)), pa.array(b + some)
            yield pa.record_batch(
                [batch.column(0).take(rows), lists(g[starts].view(np.int64), ends, pa.int64()), lists(np.diff(np.append(starts, len(g))), ends, pa.int32())],
                names=["_key", "anchor", "n"],
            )

    return arrow_map(docs, step, "_key long, anchor array<long>, n array<int>")


_SHARD = "range_id int, doc_id long, _h long, keys array<long>, docs array<long>, hs array<long>, start array<int>, end array<int>"


def shard_rows(ids: np.ndarray, marks: np.ndarray, texts: list[str], hot: list[dict[int, int]], least: int, size: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Work on one shard.

    Gives one row for each document with the spans that repeat an earlier
    passage of the shard (``range_id`` null), and for each range of the merge
    one sorted block of first occurrences that other shards may share.
    """
    parts, first = [], [0]
    for b, e in steps(texts):
        h, s, t, f = words_of(texts[b:e])
        parts.append((h, s, t))
        first += (f[1:] + first[-1]).tolist()
    h, s, t = (np.concatenate(c) for c in zip(*parts))
    first = np.array(first)
    window, grams, chosen = anchors(h, first, least, size)
    if not len(window):
        return
    known = np.array(sorted({a for d in hot for a in d}), np.int64).view(U64)
    known.sort()
    total = {a: g for d in hot for a, g in d.items()}
    want = np.array([total[int(a)] for a in known.view(np.int64)])
    # chosen occurrences of hot anchors, here and over all
    at = np.flatnonzero(chosen)
    k = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
    is_hot = known[k] == grams[at]
    here = np.bincount(k[is_hot], minlength=len(known))
    # only words near a hot anchor can be part of a repeat
    cover = np.zeros(len(h) + 1, np.int64)
    doc = np.searchsorted(first, at[is_hot], "right") - 1
    np.add.at(cover, np.maximum(at[is_hot] - (least - size), first[doc]), 1)
    np.add.at(cover, np.minimum(at[is_hot] + least, first[doc + 1]), -1)
    inside = np.cumsum(cover[:-1]) > 0
    word = np.flatnonzero(inside)
    if not len(word):
        return
    owner = np.searchsorted(first, word, "right") - 1
    cut_after = np.append((np.diff(word) > 1) | (np.diff(owner) > 0), True)
    place = np.arange(len(word)) + np.concatenate([[0], np.cumsum(cut_after)[:-1]])
    # regions end with a token of their own, below all words
    kinds = np.unique(h[word], return_inverse=True)[1]
    breaks = int(cut_after.sum())
    tokens = np.empty(len(word) + breaks, np.int64)
    back = np.full(len(tokens), -1)
    tokens[place] = kinds + breaks
    back[place] = word
    tokens[back < 0] = np.arange(breaks)
    order = suffix_array(tokens)
    lcp = common_prefixes(tokens, order, least)
    # words left in the region: what has too few begins no passage
    stop = np.flatnonzero(back < 0)
    left = stop[np.searchsorted(stop, np.arange(len(tokens)))] - np.arange(len(tokens))
    full = left[order] >= least
    suffix = order[full]
    new = np.append(True, lcp[full][1:] < least) if len(suffix) else np.zeros(0, bool)
    if not len(suffix):
        return
    group = np.cumsum(new) - 1
    least_at = np.minimum.reduceat(suffix, np.flatnonzero(new))
    again = suffix != least_at[group]
    repeat = np.sort(back[suffix[again]])
    if len(repeat):
        d = np.searchsorted(first, repeat, "right") - 1
        fresh = np.append(True, (np.diff(repeat) >= least) | (np.diff(d) > 0))
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:] - 1, len(repeat) - 1)
        x, y, d = s[repeat[heads]], t[repeat[tails] + least - 1], d[heads]
        docs_, n = np.unique(d, return_counts=True)
        off = np.concatenate([[0], np.cumsum(n)])
        none = np.zeros(len(docs_) + 1, np.int64)
        yield pa.record_batch(
            [pa.nulls(len(docs_), pa.int32()), pa.array(ids[docs_]), pa.array(marks[docs_]), *(lists(np.zeros(0, np.int64), none, pa.int64()) for _ in range(3)),
             lists(x.astype(np.int32), off, pa.int32()), lists(y.astype(np.int32), off, pa.int32())],
            names=["range_id", "doc_id", "_h", "keys", "docs", "hs", "start", "end"],
        )
    once = back[np.sort(suffix[~again])]
    # the anchor of a passage that other shards have occurs there too
    k = np.minimum(np.searchsorted(known, window[once]), len(known) - 1)
    once = once[(known[k] == window[once]) & (here[k] < want[k])]
    if not len(once):
        return
    key = rolling(h, least)[once]
    by = np.argsort(key, kind="stable")
    once, key = once[by], key[by]
    d = np.searchsorted(first, once, "right") - 1
    lot = ((key >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    lots, n = np.unique(lot, return_counts=True)
    off = np.concatenate([[0], np.cumsum(n)])
    none = pa.nulls(len(lots), pa.int64())
    yield pa.record_batch(
        [pa.array(lots.astype(np.int32)), none, none, lists(key.view(np.int64), off, pa.int64()), lists(ids[d], off, pa.int64()), lists(marks[d], off, pa.int64()),
         lists(s[once].astype(np.int32), off, pa.int32()), lists(t[once + least - 1].astype(np.int32), off, pa.int32())],
        names=["range_id", "doc_id", "_h", "keys", "docs", "hs", "start", "end"],
    )


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS, size: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, range_anchors: int = RANGE_ANCHORS) -> DataFrame:
    """``doc_id, _h`` (hash of the text) and ``_spans``: the parts of the text
    that repeat ``least`` words of an earlier place, not yet merged."""
    base = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    # Anchors are shuffled under one number for each document and text; should
    # two share it, they share their anchors, which changes nothing.
    base = base.withColumn("_key", F.xxhash64("doc_id", "_h"))
    rows = cut(_anchor_lists(base.select("_key", "text"), least, size)).select("_key", F.inline(F.arrays_zip("anchor", "n")))
    hot = cut(rows.groupBy("anchor").agg(F.sum("n").alias("g")).where("g > 1"))
    ranges = max(1, -(-hot.count() // range_anchors))
    # Documents that share anchors come together, so most repeats are settled
    # within a shard; those of a very common anchor fill several shards.
    holds = (
        rows.select("_key", "anchor").join(hot, "anchor").groupBy("_key")
        .agg(F.collect_set(F.struct("anchor", "g")).alias("_hot"), F.min("anchor").alias("_lead"))
    )
    near = base.join(holds, "_key").hint("rebalance", "_lead").sortWithinPartitions("_lead", "doc_id", "_h")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[str, dict[int, int]]] = {}
        words = 0
        for batch in batches:
            for doc, mark, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_h", "text", "_hot"))):
                if words >= shard_words and (doc, mark) not in held:
                    yield from flush(held)
                    held, words = {}, 0
                held[doc, mark] = text, {r["anchor"]: r["g"] for r in found}
                words += len(text) // 6
        if held:
            yield from flush(held)

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        names = sorted(held)
        ids, marks = (np.array(c, np.int64) for c in zip(*names))
        yield from shard_rows(ids, marks, [held[x][0] for x in names], [held[x][1] for x in names], least, size, ranges)

    done = cut(near.select("doc_id", "_h", "text", "_hot").mapInArrow(shards, _SHARD))

    def merge(table: pa.Table) -> pa.Table:
        get = lambda name, kind: [np.array(v, kind) for v in table[name].to_pylist()]
        keys = [k.view(U64) for k in get("keys", np.int64)]
        ds, hs, x, y = get("docs", np.int64), get("hs", np.int64), get("start", np.int32), get("end", np.int32)
        later = merge_blocks(keys, list(zip(ds, hs, x)))
        return pa.table([pa.array(np.concatenate([v[m] for v, m in zip(col, later)])) for col in (ds, hs, x, y)], names=["doc_id", "_h", "start", "end"])

    across = done.where("range_id IS NOT NULL").groupBy("range_id").applyInArrow(merge, "doc_id long, _h long, start int, end int")
    local = done.where("range_id IS NULL").select("doc_id", "_h", F.explode(F.arrays_zip("start", "end")).alias("_s")).select("doc_id", "_h", "_s.start", "_s.end")
    return local.unionByName(across).groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; where white space meets, one side stays."""
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
        if at < len(text) and text[at].isspace() and (not a or text[a - 1].isspace()):
            at += 1
    kept.append(text[at:])
    return "".join(kept)


def suffix_dedup(docs: DataFrame, least: int = MIN_WORDS, size: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, range_anchors: int = RANGE_ANCHORS) -> DataFrame:
    """Remove passages of at least ``least`` words that occur before.

    Words are compared without case and punctuation.  A place is removed if the
    ``least`` words from it are found at a lower (doc_id, offset), in the same
    or any other document; the union of these places goes, the first occurrence
    stays.

    Each passage of ``least`` words is named by an anchor of ``size`` words in
    it; passages whose anchor occurs once can't repeat and go no further.  The
    rest is put in shards, each with its suffix array and common prefixes, and
    first occurrences whose anchor other shards have too are merged across
    shards: by ranges of the digest of their ``least`` words, each shard's sorted
    block into the others' by binary search.  None of this changes the result.

    Result, one row for each row of ``docs``: ``doc_id, text`` (without what
    repeats)``, n_removed`` (spans)``, removed_chars, removed_spans``
    (``start-end`` offsets into the original, joined by ``;``).  Null text
    stays null.  Rows of null ``doc_id`` are neither compared nor changed.
    Repeated rows (same ``doc_id`` and text) are one document and get the same
    result, wherever their shards are; rows that share only ``doc_id`` are told
    apart by their text, and of equal places in them that of the lower hash of
    the text comes first.  A text longer than a shard is a shard by itself.
    Further columns are ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, least, size, shard_words, range_anchors)
    joined = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).join(spans, ["doc_id", "_h"], "left")

    def finish(batch: pa.RecordBatch):
        cols: list[list] = [[], [], [], []]
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            u = union_spans([(r["start"], r["end"]) for r in found or ()])
            for c, v in zip(cols, (cut_out(text, u) if u else text, len(u), sum(b - a for a, b in u), ";".join(f"{a}-{b}" for a, b in u))):
                c.append(v)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "text", "n_removed", "removed_chars", "removed_spans"])

    return arrow_map(joined.select("doc_id", "text", "_spans"), finish, "doc_id long, text string, n_removed long, removed_chars long, removed_spans string")


def drop_repeats(docs: DataFrame, least: int = MIN_WORDS, size: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, range_anchors: int = RANGE_ANCHORS) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``, ``n_chars`` (if
    there) set anew for changed rows, and all else as it was.  A changed row
    that has no word left goes."""
    spans = repeated_spans(docs, least, size, shard_words, range_anchors).select(F.col("doc_id").alias("_quillmark_id"), F.col("_h").alias("_quillmark_h"), F.col("_spans").alias("_quillmark_spans"))
    joined = docs.join(spans, (docs["doc_id"] == F.col("_quillmark_id")) & (F.xxhash64(docs["text"]) == F.col("_quillmark_h")), "left").drop("_quillmark_id", "_quillmark_h")

    def finish(batch: pa.RecordBatch):
        where = batch.schema.get_field_index("text")
        texts, found = batch.column(where).to_pylist(), batch.column(batch.schema.get_field_index("_quillmark_spans")).to_pylist()
        keep = []
        for i, f in enumerate(found):
            if f:
                texts[i] = cut_out(texts[i], union_spans([(r["start"], r["end"]) for r in f]))
            keep.append(not f or any(c.isalnum() for c in texts[i]))
        out = batch.drop_columns(["_quillmark_spans"]).set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))
        if (n := out.schema.get_field_index("n_chars")) >= 0:
            old = out.column(n).to_pylist()
            out = out.set_column(n, out.schema.field(n), pa.array([len(t) if f else o for t, f, o in zip(texts, found, old)], out.schema.field(n).type))
        yield out.filter(pa.array(keep))

    return arrow_map(joined, finish, docs.schema)


#: Every window of ``MIN_WORDS`` words against all others.
ORACLE = f"""
WITH pieces AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS ps FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
each AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pieces),
placed AS (SELECT *, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p))::BIGINT AS a FROM each),
word AS (SELECT doc_id, lower(p) AS w, a, a + length(p) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM placed WHERE regexp_matches(p, '^[\\p{{L}}\\p{{N}}]')),
doc AS (SELECT doc_id, list(w ORDER BY n) AS ws, list(a ORDER BY n) AS aa, list(b ORDER BY n) AS bb FROM word GROUP BY 1 HAVING count(*) >= {MIN_WORDS}),
win AS (
  SELECT doc_id, aa[n] AS a, bb[n + {MIN_WORDS - 1}] AS b, md5(array_to_string(list_slice(ws, n, n + {MIN_WORDS - 1}), ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(ws) - {MIN_WORDS - 2})) AS n FROM doc)),
again AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, a) AS k FROM win) WHERE k > 1),
run AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM again),
span AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b) AS g FROM run) GROUP BY doc_id, g),
cut AS (
  SELECT s.*, text, b + CASE WHEN regexp_matches(substring(text, b + 1, 1), '^\\s$') AND (a = 0 OR regexp_matches(substring(text, a, 1), '^\\s$')) THEN 1 ELSE 0 END AS go_on,
    row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM span s JOIN documents USING (doc_id)),
per AS (
  SELECT doc_id, any_value(text) AS text, count(*) AS n, sum(b - a)::BIGINT AS chars, string_agg(a || '-' || b, ';' ORDER BY a) AS txt, list(a ORDER BY a) AS aa, list(go_on ORDER BY a) AS oo FROM cut GROUP BY 1),
kept AS (
  SELECT doc_id, string_agg(substring(text, (CASE WHEN i = 1 THEN 0 ELSE oo[i - 1] END + 1)::BIGINT,
    greatest(0, CASE WHEN i > n THEN length(text) ELSE aa[i] END - CASE WHEN i = 1 THEN 0 ELSE oo[i - 1] END)::BIGINT), '' ORDER BY i) AS text
  FROM per, generate_series(1, n + 1) AS t(i) GROUP BY 1)
SELECT d.doc_id, CASE WHEN p.n IS NULL THEN d.text ELSE k.text END AS text, coalesce(p.n, 0) AS n_removed, coalesce(p.chars, 0) AS removed_chars, coalesce(p.txt, '') AS removed_spans
FROM documents d LEFT JOIN per p USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
