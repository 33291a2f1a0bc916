"""Whole jobs: from landed files to written tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.functions import text as X
from quillmark.operators import facts as A
from quillmark.operators import holdings as H
from quillmark.operators import insider as I
from quillmark.operators import metrics as M
from quillmark.operators import news as N
from quillmark.operators import sinks as K
from quillmark.operators import valuation as V
from quillmark.sources import filings as S
from quillmark.sources import market as Q


def build_dataset(
    spark: SparkSession, facts_path: str | list[str], companies: DataFrame, fields: DataFrame, formulas: Mapping[str, str], out: str, market_path: str | list[str] | None = None,
    amounts: Sequence[str] = (), ratios: Sequence[str] = (),
) -> None:
    """The standard dataset: long facts and metrics, wide annual and quarterly
    tables, coverage, scorecard and valuation.

    The long table is written once and read again, as all else is made of it.
    """
    K.write_table(A.facts_long(S.company_facts(spark, facts_path), fields, companies), f"{out}/facts_long")
    facts = spark.read.parquet(f"{out}/facts_long")
    keys = [r.key for r in fields.where(~F.coalesce("dimensional", F.lit(False))).select("key").collect()]
    K.write_table(M.derive(facts, formulas, keys), f"{out}/metrics_long")
    metrics = spark.read.parquet(f"{out}/metrics_long")
    both = M.merged(facts, metrics)
    order = [r.ticker for r in companies.select("ticker").collect()]
    columns = [*keys, *(k for k in formulas if k not in keys)]
    for period in ("annual", "quarterly"):
        wide = M.wide(both.where(F.col("period") == period), columns)
        K.write_report(M.ordered(wide, order, ["fiscal_year", "fiscal_period"]), f"{out}/wide_{period}")
        if period == "annual" and (amounts or ratios):
            K.write_report(M.ordered(M.snapshot(wide, amounts, ratios), order, ["ticker"]), f"{out}/snapshot_latest")
    K.write_report(A.coverage_matrix(facts.select("field_key", "ticker"), fields.select(F.col("key").alias("field_key")), order).orderBy("field_key"), f"{out}/coverage")
    if market_path is not None:
        K.write_report(M.ordered(V.valuation(companies, facts, Q.quotes(Q.snapshots(spark, market_path))), order, ["ticker"]), f"{out}/valuation_latest")


def _bulk(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(S.read_tsv(spark, f"{folder}/{n}.tsv", pos="_pos") for n in ("INFOTABLE", "COVERPAGE", "SUBMISSION"))


def _priced(info: DataFrame) -> DataFrame:
    return H.numeric_positions(H.common_stock(info)).withColumn("cusip", F.upper(F.trim("CUSIP")))


def build_holders(spark: SparkSession, now: str, before: str, patterns: Sequence[tuple[str, str]], out: str, hints: dict[str, str] | None = None) -> None:
    """Holders of watched securities in two quarters (folders of bulk TSV)."""
    targets = H.resolve_classes(_bulk(spark, now)[0], patterns, hints).select("ticker", "cusip")

    def families(folder: str) -> DataFrame:
        info, cover, submission = _bulk(spark, folder)
        mine = H.restricted(_priced(info), targets, "cusip")
        known = H.original_only(mine, H.cover_flags(cover, "_pos"), keep_unknown=False).join(H.filers(submission, "_pos"), "ACCESSION_NUMBER", "left")
        rows = known.withColumns({"family": X.manager_family(F.col("manager")), "filer": F.coalesce("cik", "ACCESSION_NUMBER")})
        return H.roll_up(rows, ["cusip", "family"], "filer")

    a, b = families(now), families(before)
    K.write_report(H.top_holders(a, b).join(targets, "cusip").orderBy("ticker", "rank"), f"{out}/institutional_holders")
    K.write_report(H.holder_summary(a, b).join(targets, "cusip").orderBy("ticker"), f"{out}/institutional_holders_summary")


def build_flows(spark: SparkSession, now: str, before: str, out: str, floor: float = H.FLOOR, limit: int = H.TOP) -> None:
    """Largest net flows of operating companies between two quarters."""

    def securities(folder: str) -> DataFrame:
        info, cover, _ = _bulk(spark, folder)
        rows = H.original_only(_priced(info), H.cover_flags(cover, "_pos"), keep_unknown=True)
        return H.roll_up(rows, ["cusip"], "ACCESSION_NUMBER").join(H.first_issuer(rows, ["cusip"], "_pos"), "cusip", "left")

    a, b = securities(now), securities(before)
    flows = H.market_flows(a, b, ["cusip"], floor).join(a.select("cusip", "issuer"), "cusip")
    clean = flows.where((F.col("flag") == "") & ~X.is_fund(F.coalesce("issuer", F.lit("")))).withColumn("net_flow_m", F.bround(F.col("net_flow") / 1e6))
    K.write_report(H.two_sided(clean, ["cusip"], limit, "net_flow_m"), f"{out}/market_flows")


def insider_alerts(forms: DataFrame, tiers: Sequence[str] = ("HIGH",), sale: float = I.DISCRETIONARY_SALE, plan: float = I.PLAN_SALE) -> DataFrame:
    """Messages of the filings (``accession, ticker, date, view_url, xml``) whose
    tier is pushed.  Those that can't be read give none."""
    c = I.classify(S.ownership(forms), sale, plan).where(F.col("tier").isin(*tiers) & (F.col("reason") != "routine"))
    buy = F.col("reason") == "open_market_buy"
    of = lambda name: F.when(buy, F.col(f"buy_{name}")).otherwise(F.col(f"sell_{name}"))
    who = F.concat(X.html_escape(F.col("owner")), F.lit(" · "), F.when(F.size("roles") > 0, X.html_escape(F.array_join("roles", "/"))).otherwise("—"))
    what = F.concat(F.when(buy, "bought ").otherwise("sold "), F.format_number(of("shares"), 0), F.lit(" shares"), F.when(of("price") != 0, F.concat(F.lit(" @ $"), F.format_number(of("price"), 2))).otherwise(""), F.lit(" = "), X.usd(of("value")))
    left = F.when(~buy & (F.col("sell_after") != 0), F.concat(F.format_number("sell_after", 0), F.lit(" left after this filing"))).otherwise("")
    when = F.concat(F.lit("traded "), F.coalesce(of("date"), F.col("date")), F.lit(" · filed "), F.col("date"), F.lit(" · 10b5-1: "), F.when(F.col("has_plan"), "yes").otherwise("no"))
    lines = F.filter(F.array(F.concat(F.lit("<b>"), "ticker", F.lit("</b> "), "reason"), who, what, left, when, F.col("view_url")), lambda x: x != "")
    return c.select(F.col("accession").alias("key"), "ticker", "tier", "reason", F.array_join(lines, "\n").alias("message"))


def news_alerts(items: DataFrame, judge: str, now: int, max_age: int = 4 * 3600, least: int = N.PUSH_FROM, groups: DataFrame | None = None) -> DataFrame:
    """Messages of the items (with ``pos``) that are fresh, judged and material.
    ``groups`` (``n, group``) are the second look at which events are one."""
    fresh = items.where(N.recent(F.col("published"), F.lit(now), max_age))
    events = N.worth_pushing(N.by_event(N.judged(N.by_title(fresh), judge)), least)
    if groups is not None:
        events = N.merged_groups(events.withColumn("n", F.col("pos")), groups).withColumn("event_key", X.event_key(F.col("verdict.event"), F.col("title"), F.col("uid")))
    return N.message(events, F.lit(now)).select(F.col("event_key").alias("key"), "tickers", "dup_count", "message")


def submissions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed filing lists."""
    return S.read_json(spark, path, schemas.SUBMISSIONS)
