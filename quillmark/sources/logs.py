"""Alert logs, small CSV inputs and configuration."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def pushes(lines: DataFrame, kind: str) -> DataFrame:
    """Pushed alerts in log lines (``value``): those with ``[push:ok]`` and a
    time stamp in front."""
    rest = F.trim(F.regexp_extract("value", r"\[push:ok\](.*)$", 1))
    detail = F.regexp_extract("_rest", r"^\S+\s+(.*)$", 1)
    scored = F.regexp_extract("_detail", r"\bm=(\d+)", 1)
    return (
        lines.where(F.contains("value", F.lit("[push:ok]")) & F.regexp_like("value", F.lit(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}")))
        .withColumn("_rest", rest).where(F.col("_rest") != "").withColumn("_detail", detail)
        .select(
            F.substring("value", 1, 10).alias("date"), F.lit(kind).alias("kind"),
            F.filter(F.transform(F.split(F.regexp_extract("_rest", r"^(\S+)", 1), ","), lambda t: F.upper(F.trim(t))), lambda t: t != "").alias("tickers"),
            F.when(scored != "", scored.cast("int")).alias("score"),
            F.trim(F.regexp_replace(F.when(scored != "", F.trim(F.regexp_extract("_detail", r"\bm=\d+(.*)$", 1))).otherwise(F.col("_detail")), r"^\(\d+x\)\s*", "")).alias("detail"),
        )
    )


def read_pushes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Pushes of a log file; a missing file has none."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    return pushes(lines, kind)


def read_csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with header, all text; None where there is none."""
    try:
        return spark.read.csv(path, header=True)
    except AnalysisException:
        return None


def config(path: str | Path, defaults: dict[str, Any]) -> dict[str, Any]:
    """A JSON configuration over its defaults, nested keys one by one."""

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    p = Path(path)
    return over(defaults, json.loads(p.read_text(encoding="utf-8"))) if p.exists() else dict(defaults)
