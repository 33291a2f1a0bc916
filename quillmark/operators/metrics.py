"""Derived metrics of the long table, and wide views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.formula import names, parse, with_metrics

KEYS = ["ticker", "fiscal_year", "fiscal_period"]
#: Balance sheet items that are 0 where a company doesn't report them.
ZERO_IF_ABSENT = (
    "commercial_paper", "deferred_revenue_current", "deferred_revenue_noncurrent", "goodwill", "intangible_assets_net",
    "long_term_investments", "short_term_debt", "short_term_investments",
)
PRIOR = "_prior_year"


def wide(rows: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEYS, field: str = "field_key", value: str = "value") -> DataFrame:
    """One column for each field.  The list of fields makes it one aggregate
    with no pass for the distinct ones."""
    return rows.groupBy(*keys).pivot(field, list(fields)).agg(F.first(value, ignorenulls=True))


def with_prior_year(cube: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEYS, year: str = "fiscal_year") -> DataFrame:
    """Values of the same period a year before as ``<field>_prior_year``.

    A join on the year before, since years may be missing and a lag would then
    take an older one.
    """
    other = [k for k in keys if k != year]
    before = cube.select(*other, (F.col(year) + 1).alias(year), *(F.col(f"`{f}`").alias(f + PRIOR) for f in fields))
    return cube.join(before, [*other, year], "left")


def backfilled(cube: DataFrame) -> DataFrame:
    """Gross profit from revenue and cost, where it isn't reported."""
    if not {"revenue", "cost_of_revenue"} <= set(cube.columns):
        return cube
    own = F.col("gross_profit") if "gross_profit" in cube.columns else F.lit(None).cast("double")
    return cube.withColumn("gross_profit", F.coalesce(own, F.col("revenue") - F.col("cost_of_revenue")))


def zero_seeded(cube: DataFrame, fields: Sequence[str] = ZERO_IF_ABSENT) -> DataFrame:
    """Additive items as 0 where absent; in the derived layer only."""
    return cube.withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) if f in cube.columns else F.lit(0.0) for f in fields})


def long(cube: DataFrame, metrics: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each key and metric, missing values included."""
    return cube.unpivot(list(keys), list(metrics), "field_key", "value")


def derive(facts: DataFrame, formulas: Mapping[str, str], fields: Sequence[str], seeds: Sequence[str] = ZERO_IF_ABSENT) -> DataFrame:
    """Metrics of every company and period in long form, nulls included.

    Prior-year names are the reported values: neither the backfill nor the
    zeros reach them.
    """
    raw = wide(facts, fields)
    used = {n for f in formulas.values() for n in names(parse(f))}
    prior = [f for f in fields if f + PRIOR in used]
    cube = with_prior_year(raw, prior) if prior else raw
    cube = zero_seeded(backfilled(cube), seeds)
    out = with_metrics(cube, formulas)
    return long(out, list(formulas)).withColumn("period", F.when(F.col("fiscal_period") == "FY", "annual").otherwise("quarterly"))


def merged(facts: DataFrame, metrics: DataFrame, keys: Sequence[str] = (*KEYS, "period", "field_key")) -> DataFrame:
    """Facts and metrics as one; a metric replaces a fact of its name, even by
    a missing value."""
    both = facts.select(*keys, "value", F.lit(0).alias("_prio")).unionByName(metrics.select(*keys, "value", F.lit(1).alias("_prio")))
    return both.groupBy(*keys).agg(F.max_by("value", "_prio").alias("value"))


def place(order: Sequence[str], key: str = "ticker") -> Column:
    """Position of a key in a given order, 99 where it isn't there."""
    if not order:
        return F.lit(99)
    known = F.create_map(*(x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))))
    return F.coalesce(F.try_element_at(known, F.col(key)), F.lit(99))


def ordered(df: DataFrame, order: Sequence[str], then: Sequence[str], key: str = "ticker") -> DataFrame:
    """Rows in a given order of keys, unknown ones last."""
    return df.orderBy(place(order, key), *then)


def snapshot(cube: DataFrame, amounts: Sequence[str], ratios: Sequence[str], key: str = "ticker", year: str = "fiscal_year", rounding: str = "half_even") -> DataFrame:
    """Scorecard of the last fiscal year of each company: amounts in millions
    rounded to whole, ratios in per cent rounded to one decimal."""
    fields = [year, *amounts, *ratios]
    last = cube.groupBy(key).agg(F.max_by(F.struct(*fields), year).alias("_r")).select(key, "_r.*")
    near = F.bround if rounding == "half_even" else F.round
    return last.select(
        key, year, *(near(F.col(a) / 1e6, 0).alias(f"{a}_m") for a in amounts), *(near(F.col(r) * 100, 1).alias(f"{r}_pct") for r in ratios)
    )


def quarters_with_fourth(rows: DataFrame, keys: Sequence[str], year: str = "fiscal_year", period: str = "fiscal_period", end: str = "period_end", value: str = "value") -> DataFrame:
    """Standalone quarters, and the fourth as year less the first three where
    all are there, dated at the year end.  One aggregate for each year."""
    by = F.col(period)
    pick = lambda p, c: F.max(F.when(by == p, F.col(c)))
    per = rows.where(F.col(value).isNotNull() & by.isin("FY", "Q1", "Q2", "Q3")).groupBy(*keys, year).agg(
        *(pick(p, c).alias(f"_{p}_{c}") for p in ("FY", "Q1", "Q2", "Q3") for c in (end, value))
    )
    point = lambda p, e, v: F.struct(F.lit(p).alias(period), e.alias(end), v.alias(value))
    q = [point(p, F.col(f"_{p}_{end}"), F.col(f"_{p}_{value}")) for p in ("Q1", "Q2", "Q3")]
    fourth = point("Q4", F.col(f"_FY_{end}"), F.col(f"_FY_{value}") - (F.col(f"_Q1_{value}") + F.col(f"_Q2_{value}") + F.col(f"_Q3_{value}")))
    return per.select(*keys, year, F.explode(F.array(*q, fourth)).alias("_p")).select(*keys, year, "_p.*").where(F.col(value).isNotNull())


def trailing_sum(quarters: DataFrame, annual: DataFrame, keys: Sequence[str], end: str = "period_end", value: str = "value") -> DataFrame:
    """Sum of the last four quarters there are, else the last annual value, and
    which of the two (``ttm_4q``, ``latest_fy``)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(end), F.desc(value))
    four = (
        quarters.withColumn("_n", F.row_number().over(w)).where("_n <= 4").groupBy(*keys)
        .agg(F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias("_sum"), F.count(F.lit(1)).alias("_c")).where("_c = 4").select(*keys, "_sum")
    )
    last = annual.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(end, value)).alias("_last"))
    return last.join(four, list(keys), "full").select(
        *keys, F.coalesce("_sum", "_last").alias("ttm"), F.when(F.col("_sum").isNotNull(), "ttm_4q").when(F.col("_last").isNotNull(), "latest_fy").alias("basis")
    )


def latest_value(rows: DataFrame, keys: Sequence[str], end: str = "period_end", value: str = "value", tie: Sequence[str] = ()) -> DataFrame:
    """Value of the latest date, whatever the period; ties go to the first row
    by ``tie``."""
    order = F.struct(F.datediff(F.lit("9999-12-31").cast("date"), F.col(end).cast("date")), *(F.col(t) for t in tie))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def growth(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before)
