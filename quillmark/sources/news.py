"""News items from raw feeds, in one shape."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.session import shared_folder

_COLUMNS = ["source", "uid", "tickers", "title", "summary", "url", "published"]


def tagged_feed(raw: DataFrame, watch: list[str]) -> DataFrame:
    """A general feed (``id, title, teaser, url, created, stocks``): items that
    carry a watched tag, with those tags in order."""
    tags = F.array_distinct(F.transform("stocks", lambda s: F.upper(F.coalesce(s["name"], F.lit("")))))
    return (
        raw.withColumn("tickers", F.array_sort(F.array_intersect(tags, F.array(*map(F.lit, watch)).cast("array<string>")))).where(F.size("tickers") > 0)
        .select(
            F.lit("benzinga").alias("source"), F.concat(F.lit("bz:"), F.col("id").cast("string")).alias("uid"), "tickers", F.trim(F.coalesce("title", F.lit(""))).alias("title"),
            F.substring(F.trim(F.coalesce("teaser", F.lit(""))), 1, 500).alias("summary"), F.coalesce("url", F.lit("")).alias("url"), X.unix_from_mail_date(F.col("created")).alias("published"),
        )
    )


def company_feed(raw: DataFrame, companies: DataFrame) -> DataFrame:
    """Company news (``ticker, id, headline, summary, url, datetime``): items
    whose text names the company."""
    known = companies.select("ticker", X.name_keywords(F.col("name")).alias("_keys"))
    said = F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit("")))
    return raw.join(known, "ticker").where(X.mentions(said, F.col("ticker"), F.col("_keys"))).select(
        F.lit("finnhub").alias("source"), F.concat(F.lit("fh:"), F.col("id").cast("string")).alias("uid"), F.array("ticker").alias("tickers"),
        F.trim(F.coalesce("headline", F.lit(""))).alias("title"), F.substring(F.trim(F.coalesce("summary", F.lit(""))), 1, 500).alias("summary"),
        F.coalesce("url", F.lit("")).alias("url"), F.col("datetime").cast("long").alias("published"),
    )


def event_filings(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """8-K filings (of :func:`quillmark.sources.filings.tracked_filings`) as news."""
    return filings.join(companies.select("cik", "ticker"), "cik").select(
        F.lit("sec_8k").alias("source"), F.concat(F.lit("8k:"), "accession").alias("uid"), F.array("ticker").alias("tickers"),
        F.concat("ticker", F.lit(" filed "), "form", F.lit(" (material event)")).alias("title"), F.lit("Current report: official disclosure of a material event.").alias("summary"),
        F.col("view_url").alias("url"), X.unix_from_date(F.col("date")).alias("published"),
    )


def all_sources(sources: Mapping[str, Callable[[], DataFrame]], eager: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the sources that work, and why others don't: one source that
    fails doesn't take the rest along.

    Without ``eager`` a source has to be planned to count as working.  With it
    each is read by itself and kept in the checkpoint folder, so that one which
    fails while it is read is left out too; feeds of a poll are small.
    """
    good, bad = [], {}
    for name, make in sources.items():
        try:
            df = make().select(*_COLUMNS)
            if eager:
                shared_folder(df.sparkSession)
                df = df.checkpoint()
            good.append(df)
        except Exception as e:  # noqa: BLE001 - whatever a source throws is its own
            bad[name] = repr(e)
    return (reduce(DataFrame.unionByName, good) if good else None), bad
