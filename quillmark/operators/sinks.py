"""Where results go: tables, reports, logs and notifications."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """The whole result, replacing what was there."""
    w = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    w.option("header", "true").format(kind).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small ordered CSV as one file; nulls are empty cells."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


class Notifier(Protocol):
    def send(self, message: str) -> bool: ...


class ConsoleNotifier:
    """Prints messages."""

    def send(self, message: str) -> bool:
        print(message, flush=True)
        return True


class MemoryNotifier:
    """Keeps messages, for tests and dry runs."""

    def __init__(self) -> None:
        self.messages: list[str] = []

    def send(self, message: str) -> bool:
        self.messages.append(message)
        return True


_NOTIFIERS: dict[str, Callable[[], Notifier]] = {"console": ConsoleNotifier, "memory": MemoryNotifier}


def register_notifier(name: str, make: Callable[[], Notifier]) -> None:
    _NOTIFIERS[name] = make


def build_notifier(name: str) -> Notifier:
    """A notifier by name; an unknown name is an error."""
    if name not in _NOTIFIERS:
        raise ValueError(f"unknown notifier: {name}")
    return _NOTIFIERS[name]()


def push_sink(notifier: Notifier, log: str | None = None, mark_failed: bool = True) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends the ``message`` of each row and
    appends to a log.  Batches are small: they are what passed every filter.
    ``mark_failed`` logs a failed push too, so that it isn't tried again."""

    def run(batch: DataFrame, epoch: int) -> None:
        sent = [(r["key"], r["message"], notifier.send(r["message"])) for r in batch.select("key", "message").toLocalIterator()]
        kept = [(k, f"[push:{'ok' if ok else 'FAIL'}] {m}".replace("\n", " ")) for k, m, ok in sent if ok or mark_failed]
        if log and kept:
            lines = batch.sparkSession.createDataFrame(kept, "key string, line string")
            lines.select(F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.lit("  "), "line").alias("value")).write.mode("append").text(log)

    return run
