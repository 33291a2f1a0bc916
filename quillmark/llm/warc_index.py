"""Capture index: sorted runs merged by a loser tree."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut

#: Index lines of a sorted run, and about as many of a range of the result.
RUN_ROWS = 200_000
RANGE_ROWS = 200_000
#: Sampled keys for each range boundary.
SAMPLES = 16
#: Capture time of page 0, where the table has no time of its own.
EPOCH = 1_704_067_200


def url_key(url: Column) -> Column:
    """Sort-friendly form: host parts reversed, then path and query in lower
    case; scheme, port, ``www`` and fragment are left out."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?:]*)", 1), r"^www[0-9]*\.", "")
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", "/").otherwise(tail))


class LoserTree:
    """k-way merge of sorted lists; each step replays one path of log2 k
    losers.  Ties go to the run of the lower number."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.at = [0] * len(runs)
        self.tree = [-1] * self.k
        self.winner = self._build() if runs else -1

    def _head(self, r: int):
        run = self.runs[r]
        i = self.at[r]
        return run[i] if i < len(run) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _build(self) -> int:
        # a complete tree whose leaves are k .. 2k-1
        win = [-1] * (2 * self.k)
        for r in range(self.k):
            win[self.k + r] = r
        for n in range(self.k - 1, 0, -1):
            a, b = win[2 * n], win[2 * n + 1]
            win[n], self.tree[n] = (a, b) if self._beats(a, b) else (b, a)
        return win[1] if self.k > 1 else 0

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Run and position of each element in merged order."""
        if self.winner < 0:
            return
        while self._head(w := self.winner) is not None:
            yield w, self.at[w]
            self.at[w] += 1
            n = (self.k + w) // 2
            while n:
                if self._beats(self.tree[n], w):
                    w, self.tree[n] = self.tree[n], w
                n //= 2
            self.winner = w


_FIELDS = ("urlkey", "ts", "page_id", "url", "digest", "length")


def _entries(pages: DataFrame, time: str | None) -> DataFrame:
    seconds = F.col(time).cast("timestamp") if time else F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id"))
    return pages.where("url IS NOT NULL AND page_id IS NOT NULL").select(
        url_key(F.col("url")).alias("urlkey"), F.coalesce(F.date_format(seconds, "yyyyMMddHHmmss"), F.lit("")).alias("ts"), F.col("page_id").cast("long"),
        "url", F.md5("html").alias("digest"), F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("length"),
    )


def capture_index(pages: DataFrame, time: str | None = None, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Globally ordered capture histories of all pages.

    Each task sorts its captures into runs of ``run_rows`` index lines.  Runs
    are cut at boundaries sampled from all keys, the slices of a range of keys
    meet in one task, and a loser tree merges them by URL key, time and page.
    Boundaries are whole (key, time, page) triples, so a URL with very many
    captures is spread over ranges like any other.

    Result, one row for each capture: ``pos`` (place in the order, from 1),
    ``urlkey, ts, page_id, url, digest`` (of the content)``, length``
    (characters), ``seq`` (number of the capture within its URL key, from 1)
    and ``revisit`` (same digest as the capture before it).  ``time`` names a
    column of capture times; without it ``page_id`` counts seconds, as captures
    are numbered as they come; a null time sorts first.  Rows without ``url``
    or ``page_id`` are no captures and are left out.  Null content has a null
    digest, which equals another null.  Repeated rows are captures of their
    own; captures equal in key, time and page follow in the order of their
    contents (URL, digest, length).  Content of any length is only hashed and
    counted; URLs of any length are keys as they are.  Further columns are
    ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    entries = _entries(pages, time)
    total = pages.count()
    ranges = max(1, -(-total // range_rows))
    bounds: list[tuple] = []
    if ranges > 1:
        every = max(1, total // (ranges * SAMPLES))
        keys = entries.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0).select("urlkey", "ts", "page_id").collect()
        keys = sorted(map(tuple, keys))
        bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            held.sort(key=_order)
            run, keys = uuid4().hex, [r[:3] for r in held]
            cuts = [0, *_search(keys, bounds), len(held)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    cols = list(zip(*held[a:b]))
                    yield pa.record_batch(
                        [pa.array([i], pa.int32()), pa.array([run]), *(pa.array([list(c)], pa.list_(t)) for c, t in zip(cols, _KINDS))], names=["range_id", "run", *_FIELDS]
                    )
            held.clear()

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= run_rows:
                yield from flush()
        if held:
            yield from flush()

    schema = "range_id int, run string, urlkey array<string>, ts array<string>, page_id array<long>, url array<string>, digest array<string>, length array<long>"
    runs = entries.mapInArrow(slices, schema)

    def merge(table: pa.Table) -> pa.Table:
        blocks = [list(zip(*(r[f] for f in _FIELDS))) for r in table.to_pylist()]
        keyed = [[_order(x) for x in b] for b in blocks]
        rows = [blocks[r][i] for r, i in LoserTree(keyed)]
        seq, revisit, last = [], [], None
        for row in rows:
            same = last is not None and last[0] == row[0]
            seq.append(seq[-1] + 1 if same else 1)
            revisit.append(same and last[4] == row[4])
            last = row
        cols = list(zip(*rows))
        return pa.table(
            [pa.array([table["range_id"][0].as_py()] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), *(pa.array(list(c), t) for c, t in zip(cols, _KINDS)), pa.array(seq, pa.int64()), pa.array(revisit)],
            names=["range_id", "idx", *_FIELDS, "seq", "revisit"],
        )

    merged = cut(runs.groupBy("range_id").applyInArrow(merge, "range_id int, idx long, urlkey string, ts string, page_id long, url string, digest string, length long, seq long, revisit boolean"))
    # One line for each range; there are total / range_rows of them.
    ends = (
        merged.groupBy("range_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min_by("urlkey", "idx").alias("head"), F.min_by(F.struct("digest"), "idx").alias("head_digest"),
            F.max_by("urlkey", "idx").alias("tail"), F.max_by(F.struct("digest"), "idx").alias("tail_digest"), F.max_by("seq", "idx").alias("tail_seq"),
        ).orderBy("range_id").collect()
    )
    carry, offset, before = [], 0, None
    for r in ends:
        more, again = 0, False
        if before is not None and before[0] == r["head"]:
            more, again = before[1], before[2] == r["head_digest"]["digest"]
        carry.append((r["range_id"], offset, r["head"], more, again))
        offset += r["n"]
        before = r["tail"], r["tail_seq"] + (more if r["tail"] == r["head"] else 0), r["tail_digest"]["digest"]
    known = spark.createDataFrame(carry, "range_id int, _offset long, _head string, _more long, _again boolean")
    return merged.join(F.broadcast(known), "range_id").select(
        (F.col("_offset") + F.col("idx") + 1).alias("pos"), *_FIELDS,
        (F.col("seq") + F.when(F.col("urlkey") == F.col("_head"), F.col("_more")).otherwise(0)).alias("seq"),
        (F.col("revisit") | ((F.col("idx") == 0) & F.col("_again"))).alias("revisit"),
    )


_KINDS = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())


def _order(row: tuple) -> tuple:
    """Sort key of an index line; a null digest sorts first."""
    return (*row[:4], row[4] or "", row[5])


def _search(keys: list[tuple], bounds: list[tuple]) -> list[int]:
    return [bisect_left(keys, b) for b in bounds]


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS rest, md5(html) AS digest,
    coalesce(length(html), 0) AS length FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL),
k AS (
  SELECT *, array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(rest, '^([^/?:]*)', 1), '^www[0-9]*\.', ''), '.')), ',') || ')' ||
    CASE WHEN regexp_replace(rest, '^[^/?]*', '') = '' THEN '/' ELSE regexp_replace(rest, '^[^/?]*', '') END AS urlkey,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y%m%d%H%M%S') AS ts FROM p)
SELECT row_number() OVER (ORDER BY urlkey, ts, page_id) AS pos, urlkey, ts, page_id, url, digest, length,
  row_number() OVER (PARTITION BY urlkey ORDER BY ts, page_id) AS seq,
  coalesce(lag(digest) OVER (PARTITION BY urlkey ORDER BY ts, page_id) = digest, false) AS revisit
FROM k
"""
