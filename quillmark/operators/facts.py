"""From raw fact points to the canonical long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import fiscal

#: Fiscal years kept for each company, counted back from its last annual one.
YEARS_BACK = 3
FORMS = ("10-K", "10-Q")


def candidate_tags(fields: DataFrame) -> DataFrame:
    """One row for each field and candidate tag, with the tag's rank; fields
    that need dimensional facts have none."""
    return fields.where(~F.coalesce("dimensional", F.lit(False))).select(
        F.col("key").alias("field_key"), "label", "statement", F.col("unit").alias("want_unit"), "period_type", F.posexplode("us_gaap_tags").alias("rank", "tag")
    )


def with_tags(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """Fact points of candidate tags.  Of several taxonomies that have a tag
    the first of us-gaap and dei counts."""
    order = F.when(F.col("taxonomy") == "us-gaap", 0).when(F.col("taxonomy") == "dei", 1)
    mine = facts.withColumn("_tax", order).where(F.col("_tax").isNotNull())
    w = Window.partitionBy("cik", "tag")
    return mine.withColumn("_first", F.min("_tax").over(w)).where("_tax = _first").drop("_tax", "_first").join(candidate_tags(fields), "tag")


def best_unit(points: DataFrame) -> DataFrame:
    """Points of the unit that fits the field best, for each company and tag:
    the declared one, else the only one, else the first in dollars, else the
    first.  With one unit left every rule agrees, so a rank says it all."""
    rank = F.when(F.col("unit") == F.col("want_unit"), 0).when(F.startswith("unit", F.lit("USD")), 1).otherwise(2)
    w = Window.partitionBy("cik", "field_key", "tag")
    best = F.min(F.struct(rank, F.col("unit_pos"), F.col("unit"))).over(w)
    return points.withColumn("_best", best).where(F.col("unit") == F.col("_best.unit")).drop("_best")


def chosen_points(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """Fact points of candidate tags in the taxonomy and unit that count.

    Both are chosen on a row for each unit of a tag, so no task has to hold the
    points of a company's tag.
    """
    keys = ["cik", "taxonomy", "tag", "unit"]
    chosen = best_unit(with_tags(facts.groupBy(*keys).agg(F.min("unit_pos").alias("unit_pos")), fields))
    return facts.drop("unit_pos").join(chosen, keys)


def with_periods(points: DataFrame, companies: DataFrame) -> DataFrame:
    """Fiscal year and period of each annual or quarterly report point."""
    month, day = F.split("fiscal_year_end", "-")[0].cast("int"), F.split("fiscal_year_end", "-")[1].cast("int")
    known = companies.where(F.coalesce("xbrl_taxonomy", F.lit("us-gaap")) == "us-gaap").select("cik", "ticker", month.alias("_m"), day.alias("_d"))
    m, d = F.col("_m"), F.col("_d")
    period = F.when(F.col("period_type") == "duration", fiscal.duration_period(F.col("start"), F.col("end"), m, d)).otherwise(fiscal.instant_period(F.col("end"), m, d))
    return (
        points.where(F.col("form").isin(*FORMS) & F.col("end").isNotNull()).join(known, "cik")
        .withColumn("fiscal_period", period).where(F.col("fiscal_period").isNotNull()).withColumn("fiscal_year", fiscal.fiscal_year(F.col("end"), m, d)).drop("_m", "_d")
    )


def as_reported(points: DataFrame, keys: list[str], period: str = "fiscal_period", form: str = "form", accession: str = "accn", pos: str = "pos") -> DataFrame:
    """One point for each key: the matching form first (10-K for a year, 10-Q
    for a quarter), then the least accession, then the first in the document.

    A partial aggregate keeps one struct for each key, so nothing is sorted.
    """
    miss = F.when(F.col(form) == F.when(F.col(period) == "FY", "10-K").otherwise("10-Q"), 0).otherwise(1)
    rest = [c for c in points.columns if c not in keys]
    order = F.struct(miss, F.coalesce(accession, F.lit("")), F.col(pos))
    return points.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_p")).select(*keys, "_p.*")


def spliced(points: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Of several tags for one period that of the lowest rank."""
    rest = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_p")).select(*keys, "_p.*")


def provenance(points: DataFrame, keys: list[str], tag: str = "tag", rank: str = "rank") -> DataFrame:
    """Tags in use for each key, in order of rank, joined by ``+``."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(rank).alias("r"), F.col(tag).alias("t"))))
    return points.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), "+").alias("tags"))


def trailing_years(rows: DataFrame, key: str = "ticker", year: str = "fiscal_year", annual: Column | None = None, years: int = YEARS_BACK) -> DataFrame:
    """Rows of the last fiscal years of each key and anything newer; all rows
    of a key without annual ones."""
    is_annual = F.col("period") == "annual" if annual is None else annual
    last = F.max(F.when(is_annual, F.col(year))).over(Window.partitionBy(key))
    return rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(year) >= F.col("_last") - (years - 1))).drop("_last")


def facts_long(facts: DataFrame, fields: DataFrame, companies: DataFrame, years: int = YEARS_BACK) -> DataFrame:
    """The canonical long table."""
    points = with_periods(chosen_points(facts, fields), companies)
    per_tag = as_reported(points, ["cik", "ticker", "field_key", "rank", "fiscal_year", "fiscal_period"])
    chosen = spliced(per_tag, ["cik", "ticker", "field_key", "fiscal_year", "fiscal_period"])
    out = chosen.withColumn("period", F.when(F.col("fiscal_period") == "FY", "annual").otherwise("quarterly"))
    return trailing_years(out, years=years).select(
        "ticker", "cik", "fiscal_year", "fiscal_period", "period", "field_key", "label", "statement", "value", "unit", F.col("start").alias("period_start"),
        F.col("end").alias("period_end"), "form", F.col("accn").alias("accession"), F.col("tag").alias("xbrl_tag"),
    )


def tag_provenance(facts: DataFrame, fields: DataFrame, companies: DataFrame) -> DataFrame:
    """Which tags each company's fields were spliced from."""
    return provenance(with_periods(chosen_points(facts, fields), companies), ["ticker", "field_key"])


def counts(rows: DataFrame) -> DataFrame:
    """Distinct periods and fields of each company."""
    return rows.groupBy("ticker").agg(F.countDistinct("fiscal_year", "fiscal_period").alias("periods"), F.countDistinct("field_key").alias("fields"))


def coverage_matrix(pairs: DataFrame, rows: DataFrame, columns: list[str], row: str = "field_key", column: str = "ticker") -> DataFrame:
    """``Y`` where a row and column occur together, else ``-``.

    ``rows`` are all row keys, ``columns`` all column keys; giving them spares
    the pivot a pass for the distinct values.
    """
    there = pairs.select(row, column).distinct().groupBy(row).pivot(column, columns).agg(F.max(F.lit("Y")))
    return rows.select(row).distinct().join(there, row, "left").select(row, *(F.coalesce(F.col(f"`{c}`"), F.lit("-")).alias(c) for c in columns))
