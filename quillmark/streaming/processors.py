"""Stateful operators of the alert streams.

All times that decide something come with the rows (``now``, unix seconds of
the poll), so a replay gives the same result as the live run, and a batch of
the same rows the same result as the stream.

Each is one function of a key, its rows and its state, run by
``applyInPandasWithState``: rows and states of many keys travel together in
Arrow batches, and planning a batch needs no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Ids of a company that are remembered.
SEEN_LIMIT = 400
#: Items that start the judge, and seconds after which fewer do.
QUEUE_SIZE, QUEUE_SECONDS = 12, 15 * 60
#: Seconds for which a pushed event isn't pushed again.
SUPPRESS_SECONDS = 4 * 86_400
#: Buckets of events.
BUCKETS = 1024

Step = Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]


def _rows(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    return [r for f in frames for r in zip(*(f[c].tolist() for c in columns))]


def seen_watermark(limit: int) -> Step:
    """Filings that are new to a company: not seen, and dated on or after its
    high-water mark.

    All filings of a poll count towards the mark, which only rises.  Filings are
    given out oldest first.  Every new one is remembered, whatever becomes of it
    later; of the ids the last ``limit`` stay.  Rows with ``seed`` only fill the
    state, which is how a first run starts silently.  A filing without a date is
    new only to a company that has no mark yet.
    """

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, ids = state.get if state.exists else ("", [])
        ids, found = list(ids), []
        rows = sorted(_rows(frames, "now", "accession", "date", "pos", "seed"), key=lambda r: r[0])
        for now, poll in groupby(rows, key=lambda r: r[0]):
            polled, known, fresh = list(poll), set(ids), {}
            for r in polled:
                if r[1] not in known and r[1] not in fresh and (mark == "" or (r[2] is not None and r[2] >= mark)):
                    fresh[r[1]] = r
            new = sorted(fresh.values(), key=lambda r: (r[2] is None, r[2] or "", -r[3]))
            ids = (ids + [r[1] for r in new])[-limit:]
            mark = max([mark, *(r[2] for r in polled if r[2] is not None)])
            found += [(key[0], r[1], r[2], now) for r in new if not r[4]]
        state.update((mark, ids))
        if found:
            yield pd.DataFrame(found, columns=["cik", "accession", "date", "now"])

    return step


def count_or_time(size: int, seconds: int, timer: bool) -> Step:
    """A queue that is given out when it holds ``size`` items, or anything
    ``seconds`` after it last was.

    With ``timer`` what waits is also given out when the session's clock says
    so, though no row comes.
    """

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else ([], 0)
        held, out = list(held), []
        if state.hasTimedOut:
            last = state.getCurrentProcessingTimeMs() // 1000
            out, held = [(u, last) for u in held], []
        rows = sorted(_rows(frames, "now", "uid"), key=lambda r: (r[0], r[1] is None, r[1]))
        for now, poll in groupby(rows, key=lambda r: r[0]):
            held += [u for _, u in poll if u is not None]
            if len(held) >= size or (held and now - last >= seconds):
                out += [(u, int(now)) for u in held]
                held, last = [], int(now)
        state.update((held, last))
        if timer and held:
            state.setTimeoutDuration(max(1, seconds - (rows[-1][0] - last)) * 1000)
        if out:
            yield pd.DataFrame({"queue": [key[0]] * len(out), "uid": [u for u, _ in out], "fired": [t for _, t in out]})

    return step


def suppress(seconds: int) -> Step:
    """Events that weren't pushed within ``seconds`` before, for a bucket of
    events.

    An event counts as pushed when it passes, whether or not the push then
    succeeds.  Exactly at the limit it is still suppressed.  What was pushed
    more than twice ``seconds`` before the watermark is forgotten.
    """

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pushed = dict(zip(*state.get)) if state.exists else {}
        out = []
        for now, uid, event in sorted(_rows(frames, "now", "uid", "event_key"), key=lambda r: (r[0], r[1] is None, r[1])):
            if (last := pushed.get(event)) is None or now - last > seconds:
                out.append((event, uid, int(now)))
                pushed[event] = int(now)
        least = state.getCurrentWatermarkMs() // 1000 - 2 * seconds
        pushed = {k: t for k, t in pushed.items() if t >= least}
        if pushed:
            state.update((list(pushed), list(pushed.values())))
            state.setTimeoutTimestamp((min(pushed.values()) + 2 * seconds + 1) * 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["event_key", "uid", "now"])

    return step


def new_filings(polls: DataFrame, limit: int = SEEN_LIMIT) -> DataFrame:
    """New filings of a stream of polls (``cik, accession, date, pos, seed, now``)."""
    return polls.groupBy("cik").applyInPandasWithState(
        seen_watermark(limit), "cik long, accession string, date string, now long", "mark string, ids array<string>", "append", GroupStateTimeout.NoTimeout
    )


def due_items(items: DataFrame, size: int = QUEUE_SIZE, seconds: int = QUEUE_SECONDS, timer: bool = False) -> DataFrame:
    """Items that the judge gets, of a stream (``queue, uid, now``).  A row of
    null ``uid`` only tells the time.  A stream that runs on sets ``timer``, so
    that the last items are given out without a further row; a replay, whose
    times are those of the rows, doesn't."""
    return items.groupBy("queue").applyInPandasWithState(
        count_or_time(size, seconds, timer), "queue string, uid string, fired long", "held array<string>, last long", "append",
        GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout,
    )


def unsuppressed(events: DataFrame, seconds: int = SUPPRESS_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Events (``event_key, uid, now``) that may be pushed.

    Keys share a state by ``buckets``, a number that belongs to a checkpoint:
    a bucket is rewritten when one of its keys comes, so it should hold tens of
    keys.  The watermark follows ``now`` at a distance of ``seconds``: rows that
    come later than that are left out, and a key is forgotten once no row that
    may still come can be suppressed by it.
    """
    at = F.timestamp_seconds(F.col("now") + 1)  # watermarks begin at 0, which must not be late
    bucket = F.pmod(F.xxhash64("event_key"), F.lit(buckets))
    timed = events.select("event_key", "uid", "now", at.alias("_at"), bucket.alias("_bucket")).withWatermark("_at", f"{seconds} seconds")
    return timed.groupBy("_bucket").applyInPandasWithState(
        suppress(seconds), "event_key string, uid string, now long", "events array<string>, at array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def first_seen(items: DataFrame, delay: str = "7 days") -> DataFrame:
    """Items whose ``uid`` wasn't seen within the delay; state is bounded by
    the watermark instead of a number of ids."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["uid"])
