"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quillmark.session import remove, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` gives the same rows
    in DuckDB, where SQL can."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder for the files of one query, where all executors can write."""
    return f"{shared_folder(spark)}/query-{uuid4().hex}"


def taken(df: DataFrame, folder: str) -> DataFrame:
    """``df``, read from files in ``folder``, without them: it is checkpointed
    and the folder removed."""
    out = df.checkpoint()
    remove(df.sparkSession, folder)
    return out
