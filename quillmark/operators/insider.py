"""Insider transactions: aggregates and rule-based tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sale values from which a sale is of the highest tier.
DISCRETIONARY_SALE, PLAN_SALE = 5e6, 50e6


def sides(lots: DataFrame, key: str, code: str = "code", shares: str = "shares", price: str = "price", after: str = "after", date: str = "date") -> DataFrame:
    """Purchases (code P) and sales (S) of each filing in one aggregate:
    shares, value, weighted price, least shares left and last date.  Lots
    without shares don't count; a missing price counts as 0."""
    out = []
    for name, want in (("buy", "P"), ("sell", "S")):
        mine = (F.col(code) == want) & (F.coalesce(F.col(shares), F.lit(0.0)) != 0)
        exact = lambda c, mine=mine: F.sum(F.when(mine, c.cast("decimal(28,6)"))).cast("double")
        n, v = exact(F.col(shares)), exact(F.col(shares) * F.coalesce(F.col(price), F.lit(0.0)))
        out += [
            n.alias(f"{name}_shares"), v.alias(f"{name}_value"), F.try_divide(v, n).alias(f"{name}_price"),
            F.min(F.when(mine, F.col(after))).alias(f"{name}_after"), F.max(F.when(mine, F.col(date))).alias(f"{name}_date"),
        ]
    return lots.groupBy(key).agg(*out)


def tier(buy_shares: Column, sell_shares: Column, sell_value: Column, has_plan: Column, sale: float = DISCRETIONARY_SALE, plan: float = PLAN_SALE) -> tuple[Column, Column]:
    """Tier and reason.  A purchase outranks any sale; a planned sale needs a
    far larger value than one that isn't."""
    large = sell_value >= F.when(has_plan, plan).otherwise(sale)
    why = F.when(has_plan, "large_plan_sale").otherwise("discretionary_sale")
    level = F.when(buy_shares > 0, "HIGH").when((sell_shares > 0) & large, "HIGH").when(sell_shares > 0, "MEDIUM").otherwise("LOW")
    reason = F.when(buy_shares > 0, "open_market_buy").when((sell_shares > 0) & large, why).when(sell_shares > 0, "ordinary_sale").otherwise("routine")
    return level, reason


def classify(filings: DataFrame, sale: float = DISCRETIONARY_SALE, plan: float = PLAN_SALE) -> DataFrame:
    """Filings (of :func:`quillmark.sources.filings.ownership`, with a column
    ``accession``) with their sides, tier and reason."""
    lots = filings.select("accession", F.explode("lots").alias("_t")).select("accession", "_t.*")
    both = filings.drop("lots").join(sides(lots, "accession"), "accession", "left")
    level, reason = tier(F.col("buy_shares"), F.col("sell_shares"), F.col("sell_value"), F.col("has_plan"), sale, plan)
    return both.withColumns({"tier": level, "reason": reason})


def latest_sales(filings: DataFrame, scan: int = 12, others: int = 6) -> DataFrame:
    """For each company, among its ``scan`` newest filings (``pos`` counts from
    the newest): the sale of the latest date, then of most value; and the next
    ones.  A sale is a lot of code S, disposed of, with a price."""
    first = Window.partitionBy("ticker").orderBy("pos")
    near = filings.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= scan)
    sold = F.filter("lots", lambda t: (t["code"] == "S") & (t["acq_disp"] == "D") & t["price"].isNotNull())
    total = lambda f: F.aggregate("_s", F.lit(0.0), lambda a, t: a + f(t))
    held = F.coalesce(F.array_min(F.transform("_s", lambda t: t["after"])), F.lit(0.0))
    sums = (
        near.withColumn("_s", sold).where(F.size("_s") > 0)
        .withColumns({"shares": total(lambda t: F.coalesce(t["shares"], F.lit(0.0))), "value": total(lambda t: F.coalesce(t["shares"], F.lit(0.0)) * t["price"])})
        .withColumns({"txn_date": F.coalesce(F.array_max(F.transform("_s", lambda t: t["date"])), F.col("date")), "price": F.try_divide("value", "shares"), "after": held})
        .withColumn("pct", F.try_divide(F.col("shares"), F.col("shares") + F.col("after")) * 100)
    )
    order = Window.partitionBy("ticker").orderBy(F.desc("txn_date"), F.desc("value"), "pos")
    ranked = sums.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= others)
    cells = F.struct("_r", "txn_date", "owner", "shares", "value", "price", "after", "pct", "has_plan")
    per = ranked.groupBy("ticker").agg(F.array_sort(F.collect_list(cells)).alias("_all"))
    return per.select("ticker", F.col("_all")[0].alias("found"), F.col("_all").alias("recent"))
