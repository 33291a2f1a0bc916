"""Shared pieces of the corpus operators: checkpoints, Arrow maps and
vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillmark.session import shared_folder

#: Characters and texts handled by one vectorised step.  A longer text is a
#: step by itself.
STEP_CHARS = 1 << 20
STEP_TEXTS = 1 << 15
U64 = np.uint64


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``step`` over each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def steps(texts: list[str], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of ``texts`` of about ``limit`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > limit or i - begin >= STEP_TEXTS):
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CACHE: dict = {}
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it belongs to a word, and a random number
    that is the same for upper and lower case."""
    if "chars" not in _CACHE:
        n = 0x110000
        word = np.zeros(n, bool)
        low = np.arange(n, dtype=np.uint32)
        for c in range(n):
            s = chr(c)
            if s.isalnum():
                word[c] = True
                if s != (t := s.lower()) and len(t) == 1:
                    low[c] = ord(t)
        _CACHE["chars"] = word, mix(low.astype(U64) + U64(0x1234567))
    return _CACHE["chars"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0..B^(n-1) and their inverses modulo 2^64."""
    have = _CACHE.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, STEP_CHARS + 1024)
        up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
        up[0] = down[0] = 1
        have = _CACHE["powers"] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if n > 4 * STEP_CHARS:  # a single very long text: not kept
            del _CACHE["powers"]
    return have


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one line break after each, and where each
    text begins (with the end as last entry)."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return codes, begins


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words (runs of letters and digits, case ignored) of the texts.

    Returns the hash of each word, its start and end as an offset in its text,
    and for each text the index of its first word (with the end as last entry).
    """
    codes, begins = codes_of(texts)
    word, noise = char_tables()
    inside = word[codes].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(noise[codes] * up[: len(codes)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    first = np.searchsorted(start, begins)
    base = np.repeat(begins[:-1], np.diff(first))
    return hashes, start - base, end - base, first


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words that stays within its text, and the
    index of its first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = hashes[: n - k + 1].copy()
    for j in range(1, k):
        h = h * U64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j]
    left = np.repeat(first[1:], np.diff(first))[: n - k + 1] - np.arange(n - k + 1)
    keep = np.flatnonzero(left >= k)
    return mix(h[keep]), keep


def gram_first(keep: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the index of its first gram (with the end as last entry)."""
    return np.searchsorted(keep, first)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
