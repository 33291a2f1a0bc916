"""Trailing figures and market quotes to valuation multiples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.rounding import py_round
from quillmark.operators import metrics

_FLOWS = (
    "net_income", "revenue", "operating_income", "depreciation_and_amortization", "net_cash_from_operating_activities", "capital_expenditures", "dividends_per_share",
)
_STOCKS = ("total_stockholders_equity", "cash_and_cash_equivalents", "short_term_investments", "short_term_debt", "long_term_debt")


def trailing_figures(facts: DataFrame) -> DataFrame:
    """Trailing sums and latest balances of each company, one row each.

    All fields are worked on at once and then pivoted, rather than one pass for
    each field and company.
    """
    keys = ["ticker", "field_key"]
    flows = facts.where(F.col("field_key").isin(*_FLOWS))
    ttm = metrics.trailing_sum(metrics.quarters_with_fourth(flows, keys), flows.where(F.col("period") == "annual"), keys)
    wide = ttm.groupBy("ticker").pivot("field_key", list(_FLOWS)).agg(F.first("ttm").alias("ttm"), F.first("basis").alias("basis"))
    latest = metrics.latest_value(facts.where(F.col("field_key").isin(*_STOCKS)), keys, tie=["fiscal_year", "fiscal_period"])
    return wide.join(latest.groupBy("ticker").pivot("field_key", list(_STOCKS)).agg(F.first("value")), "ticker", "full")


def multiples(frame: DataFrame, exact: bool = True) -> DataFrame:
    """Valuation columns from trailing figures and quotes.

    Cash and debt count as 0 where missing; everything else that is missing, or
    a divisor of 0, leaves its multiple null.  ``exact`` rounds as Python does,
    otherwise the JVM rounds half to even.
    """
    near: object = py_round if exact else F.bround
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    percent = lambda x, d: near(x * 100, d)
    cap, ni, rev = F.col("market_cap"), F.col("net_income_ttm"), F.col("revenue_ttm")
    debt = c("short_term_debt") + c("long_term_debt")
    cash = c("cash_and_cash_equivalents") + c("short_term_investments")
    ebitda = F.col("operating_income_ttm") + F.col("depreciation_and_amortization_ttm")
    fcf = F.col("net_cash_from_operating_activities_ttm") - F.col("capital_expenditures_ttm")
    ev: Column = cap + debt - cash
    upside = F.when((F.col("target_mean") != 0) & (F.col("price") != 0), near((F.col("target_mean") / F.col("price") - 1) * 100, 1))
    return frame.select(
        "ticker", "as_of", "price", "market_cap", ev.alias("enterprise_value"), F.try_divide(cap, ni).alias("pe_ttm"), F.try_divide(cap, rev).alias("ps_ttm"),
        F.try_divide(cap, F.col("total_stockholders_equity")).alias("pb"), F.try_divide(ev, ebitda).alias("ev_ebitda"), F.try_divide(ev, rev).alias("ev_sales"),
        percent(F.try_divide(fcf, cap), 2).alias("fcf_yield_pct"), percent(F.try_divide(ni, cap), 2).alias("earnings_yield_pct"),
        percent(F.try_divide(F.col("dividends_per_share_ttm"), F.col("price")), 2).alias("dividend_yield_pct"), ni.alias("ttm_net_income"),
        F.col("net_income_basis").alias("ttm_net_income_basis"), rev.alias("ttm_revenue"), ebitda.alias("ttm_ebitda"), fcf.alias("ttm_fcf"), debt.alias("total_debt"),
        (cash - debt).alias("net_cash"), "analyst_count", "recommendation", "rec_mean", "rec_strong_buy", "rec_buy", "rec_hold", "rec_sell", "rec_strong_sell",
        "target_mean", "target_high", "target_low", upside.alias("target_upside_pct"), "fwd_eps_cy", near(F.col("_growth_cy") * 100, 1).alias("fwd_eps_cy_growth_pct"),
        "fwd_eps_ny", near(F.col("_growth_ny") * 100, 1).alias("fwd_eps_ny_growth_pct"), F.try_divide(F.col("price"), F.col("fwd_eps_cy")).alias("fwd_pe_consensus"),
        "yf_trailing_pe", "yf_forward_pe", "yf_price_to_book", "yf_ev_ebitda", "yf_dividend_yield_pct",
    )


def valuation(companies: DataFrame, facts: DataFrame, quotes: DataFrame, exact: bool = True) -> DataFrame:
    """Valuation of every watched company, with or without figures."""
    return multiples(companies.select("ticker").join(quotes, "ticker", "left").join(trailing_figures(facts), "ticker", "left"), exact)
