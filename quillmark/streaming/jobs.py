"""Running the alert streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import news
from quillmark.operators.sinks import Notifier, push_sink
from quillmark.session import move, remove, shared_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, in order of their time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off what there is and stop.  With the checkpoint, the next run goes
    on where this one ended; a batch that failed comes again, so ``each`` has to
    be keyed (at least once)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def replay(df: DataFrame, apply: Callable[[DataFrame], DataFrame], by: str, parts: int = 4, work: str | None = None) -> DataFrame:
    """A table put through a streaming operator in micro-batches that follow
    the order of ``by``, and what came out.

    One job writes all parts; rows that are equal in ``by`` are in one part, and
    rows without it in the first.  ``work`` is where files, checkpoint and
    result go: by default the session's shared checkpoint folder, or a temporary
    one of a local session.  Only the result stays there.
    """
    spark = df.sparkSession
    root = f"{work or shared_folder(spark)}/replay-{uuid4().hex}"
    cuts = [r for r in df.approxQuantile(by, [i / parts for i in range(1, parts)], 0.001)] if parts > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    batch = reduce(add, (F.coalesce(F.col(by) > e, F.lit(False)).cast("int") for e in edges[1:-1]), F.lit(0))
    df.withColumn("_batch", batch).write.partitionBy("_batch").parquet(f"{root}/parts")
    source = spark.readStream.schema(df.schema)
    # A part is moved in whole, then worked off as one batch; the checkpoint
    # carries the state on to the next.
    for i in range(len(edges) - 1):
        move(spark, f"{root}/parts/_batch={i}", f"{root}/in/{i}")
        result = apply(source.parquet(f"{root}/in/*"))
        run_available(result, lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/{n:06d}"), f"{root}/checkpoint")
    for done in ("parts", "in", "checkpoint"):
        remove(spark, f"{root}/{done}")
    return spark.read.schema(result.schema).parquet(f"{root}/out/*")


def push_events(events: DataFrame, notifier: Notifier, checkpoint: str, log: str | None = None) -> None:
    """Push a stream of rows with ``key`` and ``message``."""
    run_available(events, push_sink(notifier, log), checkpoint)


def review(items: DataFrame, judge: str, least: int = news.PUSH_FROM) -> DataFrame:
    """The news path without state and pushes: duplicates, judge, events and
    threshold over a table (``pos`` gives the order)."""
    return news.worth_pushing(news.by_event(news.judged(news.by_title(items), judge)), least)
