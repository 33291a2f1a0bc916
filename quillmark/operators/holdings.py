"""Institutional holdings: positions, holders, and flows between quarters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as X

#: Least aggregate value of a security in the flow ranking, and rows of it.
FLOOR, TOP = 2e9, 30
TOP_HOLDERS = 25
#: Changes in per cent beyond which a corporate action is likelier than trading.
SPLIT_ABOVE, SPLIT_BELOW = 150, -60


def common_stock(info: DataFrame) -> DataFrame:
    """Positions in shares: no options, no principal amounts."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return info.where((blank("PUTCALL") == "") & F.upper(blank("SSHPRNAMTTYPE")).isin("SH", ""))


def numeric_positions(info: DataFrame) -> DataFrame:
    """Shares and value as numbers; blank is 0, rows that aren't numbers go."""
    return info.withColumns({"shares": X.to_number(F.col("SSHPRNAMT")), "value": X.to_number(F.col("VALUE"))}).where("shares IS NOT NULL AND value IS NOT NULL")


def _last_line(rows: DataFrame, key: str, columns: Sequence[str], pos: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(pos)).alias("_l")).select(key, "_l.*")


def cover_flags(cover: DataFrame, pos: str | None = None) -> DataFrame:
    """Manager and amendment flag of each filing; the last line of one counts:
    by ``pos``, or as they are read."""
    placed = cover if pos else cover.withColumn("_pos", F.monotonically_increasing_id())
    last = _last_line(placed, "ACCESSION_NUMBER", ["FILINGMANAGER_NAME", "ISAMENDMENT"], pos or "_pos")
    return last.select("ACCESSION_NUMBER", F.trim("FILINGMANAGER_NAME").alias("manager"), F.upper(F.trim("ISAMENDMENT")).isin("Y", "TRUE", "1").alias("amended"))


def filers(submission: DataFrame, pos: str) -> DataFrame:
    """Filer of each filing; the last line of one by ``pos`` counts."""
    return _last_line(submission, "ACCESSION_NUMBER", ["CIK"], pos).select("ACCESSION_NUMBER", F.trim("CIK").alias("cik"))


def first_issuer(rows: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """For each security the name in its first line that has one."""
    name = F.trim("NAMEOFISSUER")
    return rows.where(name != "").groupBy(*keys).agg(F.min_by(name, F.col(pos)).alias("issuer"))


def original_only(info: DataFrame, flags: DataFrame, keep_unknown: bool, key: str = "ACCESSION_NUMBER") -> DataFrame:
    """Positions of filings that aren't amendments.  A filing without a cover
    is left out for holders and kept for flows."""
    joined = info.join(flags, key, "left" if keep_unknown else "inner")
    return joined.where(~F.coalesce("amended", F.lit(False)))


def restricted(info: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Only rows whose key is wanted."""
    return info.join(keys.select(on).distinct(), on, "left_semi")


def resolve_classes(info: DataFrame, patterns: Sequence[tuple[str, str]], hints: dict[str, str] | None = None) -> DataFrame:
    """The main security of each ticker: by issuer name (first pattern that
    fits), the class of the hint first, then the largest value.

    Options, debt and amendments count here, as only the ranking matters.
    """
    named = info.withColumn("ticker", X.first_match(F.upper("NAMEOFISSUER"), [(p, t) for t, p in patterns], F.lit(None).cast("string"))).where("ticker IS NOT NULL")
    per = named.groupBy("ticker", F.upper(F.trim("CUSIP")).alias("cusip"), F.upper(F.trim("TITLEOFCLASS")).alias("title")).agg(
        F.sum(F.coalesce(X.to_number(F.col("VALUE")), F.lit(0.0)).cast("decimal(38,2)")).cast("double").alias("value"), F.count(F.lit(1)).alias("filers")
    )
    return best_class(per, hints)


def best_class(classes: DataFrame, hints: dict[str, str] | None = None, key: str = "ticker", title: str = "title", value: str = "value", tie: Sequence[str] = ("cusip", "title")) -> DataFrame:
    """One class for each key: with the hinted token, then of most value."""
    miss: Column = F.lit(1)
    for k, hint in (hints or {}).items():
        miss = F.when((F.col(key) == k) & X.has_class_token(F.col(title), hint), 0).otherwise(miss)
    w = Window.partitionBy(key).orderBy(miss, F.desc(value), *tie)
    return classes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def roll_up(positions: DataFrame, keys: Sequence[str], entity: str, shares: str = "shares", value: str = "value") -> DataFrame:
    """Shares, value and distinct entities.  Sums are exact decimals, so they
    don't hang on the order in which partitions come."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,4)")).cast("double").alias(c)
    return positions.groupBy(*keys).agg(exact(shares), exact(value), F.countDistinct(entity).alias("entities"))


def compared(now: DataFrame, before: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of now with the columns of before as ``prev_*``, 0 where new; what
    was sold off entirely isn't a row."""
    old = before.select(*keys, *(F.col(c).alias(f"prev_{c}") for c in columns))
    joined = now.join(old, list(keys), "left")
    return joined.withColumns({f"prev_{c}": F.coalesce(f"prev_{c}", F.lit(0)) for c in columns})


def status(now: Column, before: Column) -> Column:
    return F.when(before == 0, "NEW").when(now > before, "increased").when(now < before, "decreased").otherwise("unchanged")


def flag(change_pct: Column) -> Column:
    """Marks of what isn't trading: no prior position, or a likely split."""
    return F.when(change_pct.isNull(), "NEW/IPO?").when((change_pct > SPLIT_ABOVE) | (change_pct < SPLIT_BELOW), "split/IPO?").otherwise("")


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, F.when(whole != 0, whole)) * 100


def top_holders(now: DataFrame, before: DataFrame, security: str = "cusip", holder: str = "family", limit: int = TOP_HOLDERS) -> DataFrame:
    """The largest holders of each security and how they changed.  Both inputs
    are roll-ups by security and holder."""
    both = compared(now, before, [security, holder], ["shares"])
    total = Window.partitionBy(security)
    ranked = both.withColumn("_total", F.sum(F.col("value").cast("decimal(38,4)")).over(total).cast("double")).withColumn("rank", F.row_number().over(total.orderBy(F.desc("value"), holder)))
    delta = F.col("shares") - F.col("prev_shares")
    return ranked.where(F.col("rank") <= limit).select(
        security, "rank", holder, "entities", "shares", "value", percent(F.col("value"), F.col("_total")).alias("pct_of_value"), "prev_shares", delta.alias("delta_shares"),
        percent(delta, F.col("prev_shares")).alias("delta_pct"), status(F.col("shares"), F.col("prev_shares")).alias("status"),
    )


def holder_summary(now: DataFrame, before: DataFrame, security: str = "cusip") -> DataFrame:
    """Holders, shares and value of each security in both quarters."""
    def per(df: DataFrame, p: str) -> DataFrame:
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,4)")).cast("double")
        return df.groupBy(security).agg(F.count(F.lit(1)).alias(f"{p}num_holders"), exact("shares").alias(f"{p}total_shares"), exact("value").alias(f"{p}total_value"))

    both = per(now, "").join(per(before, "prev_"), security, "left").fillna(0, ["prev_num_holders", "prev_total_shares", "prev_total_value"])
    change = F.col("total_shares") - F.col("prev_total_shares")
    return both.select(
        security, "num_holders", "total_shares", "total_value", "prev_num_holders", change.alias("qoq_shares_chg"), percent(change, F.col("prev_total_shares")).alias("qoq_shares_chg_pct")
    )


def market_flows(now: DataFrame, before: DataFrame, keys: Sequence[str], floor: float = FLOOR) -> DataFrame:
    """Net flow of each security: change in shares at the implied price.  Both
    inputs are roll-ups by security with ``entities`` as holders."""
    both = compared(now.where(F.col("value") >= floor), before, keys, ["shares", "entities"])
    price = F.coalesce(F.try_divide(F.col("value"), F.col("shares")), F.lit(0.0))
    delta = F.col("shares") - F.col("prev_shares")
    change = percent(delta, F.col("prev_shares"))
    return both.select(
        *keys, F.col("entities").alias("holders"), (F.col("entities") - F.col("prev_entities")).alias("holders_chg"), "shares", "value", price.alias("implied_price"),
        delta.alias("delta_shares"), (delta * price).alias("net_flow"), change.alias("shares_chg_pct"), flag(change).alias("flag"),
    )


def two_sided(flows: DataFrame, keys: Sequence[str], limit: int = TOP, by: str = "net_flow") -> DataFrame:
    """Largest and smallest flows as one table with ``side``.  Each side is a
    bounded heap in every task, with no full sort."""
    top = lambda side, *order: flows.orderBy(*order, *keys).limit(limit).withColumn("side", F.lit(side))
    return top("BOUGHT", F.desc(by)).unionByName(top("SOLD", F.asc(by)))


def shares_of_total(positions: DataFrame, value: str = "value") -> DataFrame:
    """Each position's part of the whole portfolio in per cent."""
    total = positions.agg(F.sum(F.col(value).cast("decimal(38,4)")).cast("double").alias("total"))
    return positions.crossJoin(F.broadcast(total)).withColumn("pct", percent(F.col(value), F.col("total")))
