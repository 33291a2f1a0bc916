"""Benchmark decontamination: q-gram lemma filter in overlapping diagonal
bands, then banded alignment."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import _CACHE, U64, arrow_map, codes_of, steps, texts_of

#: Characters of a gram; six bits each, so at most ten fit.
Q = 10
#: Edits allowed for each character of an item.
EDIT_RATE = 0.08
#: Benchmark characters held by a task at a time; more are taken in slices.
SLICE_CHARS = 8_000_000
_BITS = 22


def class_table() -> np.ndarray:
    """For each code point its class in the normal form: 0 for what isn't part
    of a word, else 1 to 62; case is ignored, and further letters share classes
    by their code (alignment compares the letters themselves)."""
    if "classes" not in _CACHE:
        low = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalnum():
                t = s.lower()
                low[c] = ord(t[0])
        kind = np.where(low == 0, 0, 37 + low % 26).astype(np.uint8)
        for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
            kind[low == ord(c)] = i + 1
        _CACHE["classes"] = low, kind
    return _CACHE["classes"]


def normal_form(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts (lower case, one space for what is between words),
    their classes, their offsets in the joined original, and where each text
    begins in the original.  Class 63 ends each text."""
    codes, begins = codes_of(texts)
    low, kind = class_table()
    letters, classes = low[codes], kind[codes]
    classes[begins[1:] - 1] = 63
    keep = classes != 0
    keep[1:] |= (classes[:-1] != 0) & (classes[:-1] != 63)
    letters[classes == 0] = 32
    at = np.flatnonzero(keep)
    return letters[at], classes[at], at, begins


def packed_grams(classes: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each position as one integer of 6 q bits."""
    if len(classes) < q:
        return np.zeros(0, U64)
    n = len(classes) - q + 1
    out, have, part, width, shift = np.zeros(n, U64), 0, classes.astype(U64), 1, q
    # q in binary: parts of width 1, 2, 4, ... are made by doubling
    while shift:
        if shift & 1:
            out = (out << U64(6 * width)) | part[have : have + n]
            have += width
        shift >>= 1
        if shift:
            part = (part[: len(part) - width] << U64(6 * width)) | part[width:]
            width *= 2
    return out


def strip_form(text: str) -> tuple[np.ndarray, np.ndarray]:
    letters, classes, _, _ = normal_form([text])
    n = len(letters) - 1  # the end mark
    b = 0
    while n > b and letters[n - 1] == 32:
        n -= 1
    return letters[b:n], classes[b:n]


class Index:
    """Grams of a slice of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.ids, self.letters, self.edits, self.need = [], [], [], []
        keys, item, pos = [], [], []
        for i, text in items:
            letters, classes = strip_form(text or "")
            m = len(letters)
            if m < q:
                continue
            e = min(math.floor(rate * m), (m - q) // q)
            g = packed_grams(classes, q)
            keys.append(g)
            item.append(np.full(len(g), len(self.ids)))
            pos.append(np.arange(len(g)))
            self.ids.append(i)
            self.letters.append(letters)
            self.edits.append(e)
            self.need.append(m + 1 - q * (e + 1))
        self.q = q
        key = np.concatenate(keys) if keys else np.zeros(0, U64)
        order = np.argsort(key, kind="stable")
        self.key, self.start = np.unique(key[order], return_index=True)
        self.end = np.append(self.start[1:], len(key))
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.pos = (np.concatenate(pos) if pos else np.zeros(0, np.int64))[order]
        #: Bands are 2^z wide and overlap by the edits, with 2^z > edits.
        self.z = np.array([max(1, int(e).bit_length()) for e in self.edits] or [1])
        #: Added to diagonals, so that none is negative however long an item is.
        self.shift = (max(map(len, self.letters), default=0) // (1 << 20) + 1) << 20
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.key)] = True
        self.edits_a, self.need_a = np.array(self.edits or [0]), np.array(self.need or [0])

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * U64(0x9E3779B97F4A7C15)) >> U64(64 - _BITS)).astype(np.int64)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item and item position of every shared q-gram."""
        near = np.flatnonzero(self.seen[self._slot(grams)])
        k = np.searchsorted(self.key, grams[near])
        k[k == len(self.key)] = 0
        same = self.key[k] == grams[near]
        at, k = near[same], k[same]
        n = self.end[k] - self.start[k]
        flat = np.repeat(self.start[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(k) else np.zeros(0, np.int64)
        return np.repeat(at, n), self.item[flat], self.pos[flat]

    def candidates(self, grams: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Item, first and last diagonal of each run of bands that meet the
        lemma's bound, and the most grams that one of them shares."""
        if not len(self.key):
            return []
        p, item, o = self.hits(grams)
        if not len(p):
            return []
        diag = p - o + self.shift
        z = self.z[item]
        band = diag >> z
        spill = (diag & ((1 << z) - 1)) < self.edits_a[item]  # also in the band before
        width = int(band.max()) + 2
        code = np.concatenate([item * width + band, item[spill] * width + band[spill] - 1])
        code, count = np.unique(code, return_counts=True)
        item, band = code // width, code % width
        ok = count >= self.need_a[item]
        if not ok.any():
            return []
        item, count = item[ok], count[ok]
        first = (band[ok] << self.z[item]) - self.shift
        last = first + (1 << self.z[item]) + self.edits_a[item] - 1
        # bands of an item that touch are aligned as one
        new = np.append(True, (item[1:] != item[:-1]) | (first[1:] > last[:-1] + 1))
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(item)) - 1
        most = np.maximum.reduceat(count, heads)
        return list(zip(item[heads].tolist(), first[heads].tolist(), last[tails].tolist(), most.tolist()))


def banded_alignment(item: np.ndarray, text: np.ndarray, first: int, last: int) -> np.ndarray:
    """Least edits of ``item`` against any part of ``text`` that begins within
    diagonals ``first`` to ``last`` and stays there, for each end: entry ``k``
    is for the end ``first + k + len(item)``."""
    far = 1 << 28
    width = last - first + 1
    cells = np.arange(width)
    row = np.where((cells + first >= 0) & (cells + first <= len(text)), 0, far)
    padded = np.full(width + len(item) + 2, 0xFFFFFFFF, np.uint32)
    a, b = max(0, first), min(len(text), last + len(item) + 1)
    if b > a:
        padded[a - first : b - first] = text[a:b]
    for i in range(len(item)):
        # cell k is text offset first + k + i + 1; a substitution or match keeps k
        new = row + (padded[i : i + width] != item[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        low, high = -(first + i + 1), len(text) - (first + i + 1)
        if low > 0:
            new[:low] = far
        if high < width - 1:
            new[max(0, high + 1) :] = far
        row = np.minimum.accumulate(new - cells) + cells
    return row


def occurrences(item: np.ndarray, text: np.ndarray, first: int, last: int, edits: int) -> list[tuple[int, int, int]]:
    """Start, end and edits of the parts of ``text`` that are the item within
    ``edits``, the best first; an end nearer than the shortest occurrence to a
    better one is the same occurrence."""
    row = banded_alignment(item, text, first, last)
    ends = np.flatnonzero(row <= edits)
    ends = ends[np.lexsort((ends, row[ends]))]
    taken = np.zeros(len(row), bool)
    out = []
    for k in ends.tolist():
        if taken[k]:
            continue
        near = len(item) - edits
        taken[max(0, k - near + 1) : k + near] = True
        end = first + k + len(item)
        back = banded_alignment(item[::-1], text[:end][::-1], -edits, edits)
        j = int(np.argmin(back))
        size = j - edits + len(item) if back[j] <= row[k] else len(item)
        out.append((max(0, end - size), end, int(row[k])))
    return out


def matches(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """Text number, item number, start and end in the text, edits, shared grams."""
    letters, classes, at, begins = normal_form(texts)
    ends = np.flatnonzero(classes == 63)
    heads = np.concatenate([[0], ends[:-1] + 1])
    grams = packed_grams(classes, index.q)
    found = []
    for item, first, last, shared in index.candidates(grams):
        want, e = index.letters[item], index.edits[item]
        # the bands may touch more than one text
        lo = np.searchsorted(ends, max(0, first - e), "left")
        hi = np.searchsorted(ends, min(len(letters) - 1, last + len(want) + e), "left")
        for t in range(lo, min(hi, len(ends) - 1) + 1):
            part = letters[heads[t] : ends[t]]
            f, l = max(int(first - e - heads[t]), -len(want)), min(int(last + e - heads[t]), len(part))
            if f > l:
                continue
            for start, end, cost in occurrences(want, part, f, l, e):
                x = int(at[heads[t] + start] - begins[t])
                y = int(at[heads[t] + end - 1] - begins[t]) + 1
                found.append((t, item, x, y, cost, shared))
    # overlapping finds of one item: the one of fewest edits
    out: list[tuple] = []
    taken: dict[tuple[int, int], tuple[list, list]] = {}
    for r in sorted(found, key=lambda r: (r[0], r[1], r[4], r[2])):
        ends_, starts_ = taken.setdefault((r[0], r[1]), ([], []))
        k = bisect_right(ends_, r[2])  # spans taken don't overlap, so both lists are in order
        if k == len(ends_) or starts_[k] >= r[3]:
            ends_.insert(k, r[3])
            starts_.insert(k, r[2])
            out.append(r)
    return out


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark slice by slice, one of them in the driver at a time."""
    base = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / limit))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for s in range(n):
        yield [(r.item_id, r.text) for r in base.where(part == s).orderBy("item_id", "text").collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Benchmark passages in all documents.

    Texts are compared as words in lower case with one space between.  An item
    of ``m`` characters may have ``e = rate * m`` edits; by the q-gram lemma an
    occurrence shares ``m + 1 - q (e + 1)`` q-grams within ``e + 1`` adjacent
    diagonals, and each such run of diagonals lies in one of the overlapping
    bands that are counted.  ``e`` is lowered where that bound would fall below
    1.  Bands that meet the bound are verified by banded alignment.

    Result, one row for each occurrence: ``doc_id, item_id, start_char,
    end_char, edits, shared``; offsets are into the original text.  Items of
    fewer than ``q`` characters are no evidence and match nothing.  Null texts
    match nothing; null ``doc_id`` is kept as null; repeated documents are
    reported each, repeated items once.  Texts and items of any length are
    compared whole.  Where finds of one item overlap, that of fewest edits stays,
    then the earliest; different items are reported whether they overlap or not.
    Further columns are ignored; an empty table on either side gives an empty
    result.

    The documents aren't shuffled.  The benchmark is read in slices of
    ``slice_chars``, each of which is held by a task at a time.
    """
    out = [_scan(docs, items, q, rate) for items in _slices(benchmark, slice_chars)]
    return reduce(DataFrame.unionByName, out)


def _scan(docs: DataFrame, items: list[tuple[int, str]], q: int, rate: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    built: list = []

    def step(batch: pa.RecordBatch):
        if not built:
            built.append(Index(held.value, q, rate))
        index, texts, rows = built[0], texts_of(batch.column(1)), []
        ids = batch.column(0).to_pylist()
        for b, e in steps(texts):
            rows += [(ids[b + t], index.ids[i], x, y, c, s) for t, i, x, y, c, s in matches(texts[b:e], index)]
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "item_id", "start_char", "end_char", "edits", "shared"])

    return arrow_map(docs.select("doc_id", "text"), step, "doc_id long, item_id long, start_char long, end_char long, edits long, shared long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Rows of ``docs`` without any benchmark passage, all columns as they
    were.  Rows are judged one by one, so no join is needed.  Null and short texts
    stay; repeated rows share their fate; without benchmark items all rows stay."""
    for items in _slices(benchmark, slice_chars):
        held = docs.sparkSession.sparkContext.broadcast(items)
        docs = arrow_map(docs, _dropper(held, q, rate), docs.schema)
    return docs


def _dropper(held, q: int, rate: float):
    built: list = []

    def step(batch: pa.RecordBatch):
        if not built:
            built.append(Index(held.value, q, rate))
        texts = texts_of(batch.column(batch.schema.get_field_index("text")))
        keep = np.ones(len(texts), bool)
        for b, e in steps(texts):
            for r in matches(texts[b:e], built[0]):
                keep[b + r[0]] = False
        yield batch.filter(pa.array(keep))

    return step
