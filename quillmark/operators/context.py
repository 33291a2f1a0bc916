"""What is known about a ticker: alerts, flows and valuation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as X

STALE_AFTER_DAYS = 45


def same_issuer(a: Column, b: Column) -> Column:
    """Whether two token lists name one issuer: the first tokens are equal, and
    the second ones unless a name has only one."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (a[0] == b[0]) & ((F.size(a) == 1) | (F.size(b) == 1) | (F.get(a, F.lit(1)) == F.get(b, F.lit(1))))


def issuer_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Rows whose names mean the same issuer.  The first token is an equi-join
    key; the rest is a condition on the pairs it leaves."""
    a = left.withColumn("_ta", X.issuer_tokens(F.col(left_name))).withColumn("_k", F.get("_ta", F.lit(0)))
    b = right.withColumn("_tb", X.issuer_tokens(F.col(right_name))).withColumn("_k", F.get("_tb", F.lit(0)))
    return a.join(b, "_k").where(same_issuer(F.col("_ta"), F.col("_tb"))).drop("_k", "_ta", "_tb")


def institutional_flow(flows: DataFrame | None, companies: DataFrame, name: str = "name", issuer: str = "issuer", flow: str = "net_flow") -> DataFrame:
    """Net flow of each company over the rows of its issuer, and a status:
    ``found``, ``absent`` from the table, or ``missing`` without one."""
    if flows is None:
        return companies.select("ticker", F.lit(None).cast("double").alias("net_flow"), F.lit(0).cast("long").alias("rows"), F.lit("missing").alias("status"))
    hits = issuer_join(companies.select("ticker", name), flows.select(issuer, F.coalesce(F.col(flow).try_cast("double"), F.lit(0.0)).alias("_flow")), name, issuer)
    per = hits.groupBy("ticker").agg(F.sum(F.col("_flow").cast("decimal(38,6)")).cast("double").alias("net_flow"), F.count(F.lit(1)).alias("rows"))
    return companies.select("ticker").join(per, "ticker", "left").select("ticker", "net_flow", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.when(F.col("rows").isNull(), "absent").otherwise("found").alias("status"))


def staleness(as_of: Column, now: Column) -> tuple[Column, Column]:
    """Whole days since, and whether they are too many."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(as_of)) / 86400)
    return days, days > STALE_AFTER_DAYS


def scout(pushes: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Watched tickers by their alerts: insider alerts count twice, then the
    best score.  The headline is that of the latest date, first in order."""
    each = pushes.select(F.explode("tickers").alias("ticker"), "kind", "score", "date", "detail", *(c for c in ("pos",) if c in pushes.columns))
    order = F.struct(F.col("date").alias("d"), *([-F.col("pos")] if "pos" in pushes.columns else []), F.col("detail"))
    per = each.join(known.select("ticker").distinct(), "ticker", "left_semi").groupBy("ticker").agg(
        F.count_if(F.col("kind") == "news").alias("news"), F.count_if(F.col("kind") == "insider").alias("insider"), F.coalesce(F.max("score"), F.lit(0)).alias("best"),
        F.max("date").alias("latest"), F.substring(F.max_by("detail", order), 1, 80).alias("headline"),
    )
    return per.orderBy(F.desc(F.col("insider") * 2 + F.col("news")), F.desc("best"), "ticker").limit(limit)


def context(ticker: str, companies: DataFrame, pushes: DataFrame, flow: DataFrame, valuation: DataFrame | None, top: int = 12) -> dict[str, Any]:
    """Everything about one ticker; each part is filtered and bounded before it
    is brought to the driver."""
    t = ticker.upper()
    company = companies.where(F.upper("ticker") == t).limit(1).collect()
    alerts = pushes.where(F.array_contains("tickers", t)).orderBy(F.desc("date"), "kind", F.desc("score"), "detail").limit(top).collect()
    money = flow.where(F.upper("ticker") == t).limit(1).collect()
    worth = None if valuation is None else valuation.where(F.upper("ticker") == t).limit(1).collect()
    return {
        "ticker": t, "on_watchlist": bool(company), "company": company[0].asDict(True) if company else None, "alerts": [r.asDict(True) for r in alerts],
        "institutional_flow": money[0].asDict(True) if money else {"status": "absent"},
        "valuation": {"status": "missing"} if worth is None else {"status": "found", **worth[0].asDict(True)} if worth else {"status": "absent"},
    }


def render(known: dict[str, Any]) -> str:
    """The context as text."""
    out = [f"# {known['ticker']}", "", f"Watchlist: {'yes' if known['on_watchlist'] else 'no'}", "", "## Alerts"]
    out += [f"  {a['date']}  [{a['kind']}]" + (f" m={a['score']}" if a["score"] is not None else "") + f"  {a['detail'][:110]}" for a in known["alerts"]] or ["  (none)"]
    flow = known["institutional_flow"]
    out += ["", "## Institutional flow", f"  net {flow['net_flow']:+,.0f} over {flow['rows']} rows" if flow.get("status") == "found" else f"  {flow['status']}"]
    worth = known["valuation"]
    out += ["", "## Valuation", *([f"  {k}: {v}" for k, v in worth.items() if k not in ("status", "ticker") and v is not None] if worth["status"] == "found" else [f"  {worth['status']}"])]
    return "\n".join(out)
