"""Market snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.sources.filings import read_json


def snapshots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cached quotes and estimates, one document for each ticker."""
    return read_json(spark, path, schemas.MARKET)


def quotes(market: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Typed figures of each ticker.  A price of 0 counts as missing, and so
    does a mean target of 0; ``fallback`` (``ticker, close``) stands in for the
    price.  Of several estimates for one period the last counts, of the
    recommendations the first."""
    info = lambda k: F.try_element_at("info", F.lit(k)).try_cast("double")
    some = lambda c: F.when(c != 0, c)
    of = lambda p: F.try_element_at(F.filter("earnings_estimate", lambda e: e["period"] == p), F.lit(-1))
    rec = F.try_element_at("recommendations", F.lit(1))
    out = market.select(
        "ticker", "as_of", F.coalesce(some(info("currentPrice")), some(info("regularMarketPrice"))).alias("price"), info("marketCap").alias("market_cap"),
        F.coalesce(some(F.col("price_targets.mean")), some(info("targetMeanPrice"))).alias("target_mean"), F.col("price_targets.high").alias("target_high"),
        F.col("price_targets.low").alias("target_low"), of("0y")["avg"].alias("fwd_eps_cy"), of("0y")["growth"].alias("_growth_cy"), of("+1y")["avg"].alias("fwd_eps_ny"),
        of("+1y")["growth"].alias("_growth_ny"), info("numberOfAnalystOpinions").cast("long").alias("analyst_count"), F.try_element_at("info", F.lit("recommendationKey")).alias("recommendation"),
        info("recommendationMean").alias("rec_mean"), rec["strongBuy"].alias("rec_strong_buy"), rec["buy"].alias("rec_buy"), rec["hold"].alias("rec_hold"),
        rec["sell"].alias("rec_sell"), rec["strongSell"].alias("rec_strong_sell"), info("trailingPE").alias("yf_trailing_pe"), info("forwardPE").alias("yf_forward_pe"),
        info("priceToBook").alias("yf_price_to_book"), info("enterpriseToEbitda").alias("yf_ev_ebitda"), info("dividendYield").alias("yf_dividend_yield_pct"),
    )
    if fallback is None:
        return out
    return out.join(fallback.select("ticker", F.col("close").alias("_close")), "ticker", "left").withColumn("price", F.coalesce("price", "_close")).drop("_close")
