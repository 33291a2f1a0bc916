"""Filing queries: orders and line items stand for reported facts.

A company is a market segment, its revenue the order totals of a fiscal period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import fiscal
from quillmark.operators import facts as A
from quillmark.operators import metrics as M
from quillmark.operators import valuation as V
from quillmark.plans.base import query
from quillmark.sources.tables import table

_MONEY = "sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE"


def _money(c: str = "o_totalprice"):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN days BETWEEN 300 AND 400 THEN 'FY' WHEN days BETWEEN 80 AND 100 THEN 'quarter' ELSE 'drop' END AS kind, count(*) AS points, min(days) AS least, max(days) AS most FROM s GROUP BY 1
""")
def duration_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Line items by the days from order to shipment."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = fiscal.span_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    kind = F.when(F.col("days").between(*fiscal.YEAR_SPAN), "FY").when(F.col("days").between(*fiscal.QUARTER_SPAN), "quarter").otherwise("drop")
    return (
        table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(orders, "l_orderkey").select(days.cast("long").alias("days"))
        .groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("points"), F.min("days").alias("least"), F.max("days").alias("most"))
    )


_FYE = "CASE o_custkey % 4 WHEN 0 THEN '06-30' WHEN 1 THEN '01-31' WHEN 2 THEN '12-31' ELSE '02-29' END"
_LABEL = f"""
x AS (SELECT *, {_FYE} AS fye, o_orderdate::DATE AS e FROM orders),
y AS (SELECT *, year(e) AS y0, split_part(fye, '-', 1)::INT AS m, split_part(fye, '-', 2)::INT AS dd FROM x),
z AS (SELECT *, make_date(y0, m, least(dd, CASE WHEN m = 2 AND dd = 29 AND NOT (y0 % 4 = 0) THEN 28 ELSE dd END)) AS end0 FROM y),
f AS (SELECT *, CASE WHEN e <= end0 + 21 THEN y0 ELSE y0 + 1 END AS fy FROM z),
g AS (SELECT *, make_date(fy - 1, m, CASE WHEN m = 2 AND dd = 29 AND NOT ((fy - 1) % 4 = 0) THEN 28 ELSE dd END) AS before FROM f),
lab AS (SELECT *, greatest(1, least(4, round_even(date_diff('day', before, e) / 91.25, 0)::INT)) AS q FROM g)
"""


@query(f"WITH {_LABEL} SELECT o_orderkey, fye, fy::INT AS fiscal_year, q AS quarter, CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END AS period FROM lab")
def fiscal_label(spark: SparkSession, d: str) -> DataFrame:
    """Fiscal year and quarter of each order date, year ends differing."""
    k = F.col("o_custkey") % 4
    fye = F.when(k == 0, "06-30").when(k == 1, "01-31").when(k == 2, "12-31").otherwise("02-29")
    e, m, day = F.col("o_orderdate").cast("date"), F.split("fye", "-")[0].cast("int"), F.split("fye", "-")[1].cast("int")
    return table(spark, d, "orders").withColumn("fye", fye).select(
        "o_orderkey", "fye", fiscal.fiscal_year(e, m, day).alias("fiscal_year"), fiscal.fiscal_quarter(e, m, day).alias("quarter"), fiscal.instant_period(e, m, day).alias("period")
    )


@query("""
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM r WHERE n = 1
""")
def as_reported_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One line of each order: the matching flag first, then the least part."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit("FY").alias("fiscal_period"), F.when(F.col("l_returnflag") == "N", "10-K").otherwise("10-Q").alias("form"),
        F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("accn"), F.struct("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate").alias("pos"), "l_partkey",
    )
    return A.as_reported(lines, ["l_orderkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


_TAGS = ("ECONOMY", "STANDARD", "PROMO", "LARGE")
_RANK = "CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'LARGE' THEN 3 END"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    tags = spark.createDataFrame([(t, i) for i, t in enumerate(_TAGS)], "tag string, rank int")
    parts = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", F.col("p_type").alias("tag"), "p_retailprice")
    return parts.join(F.broadcast(tags), "tag")


@query(f"""
WITH r AS (SELECT *, {_RANK} AS rank FROM part), m AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY rank, p_partkey) AS n FROM r WHERE rank IS NOT NULL)
SELECT p_brand, p_size, p_partkey, p_type AS tag, p_retailprice FROM m WHERE n = 1
""")
def tag_splice(spark: SparkSession, d: str) -> DataFrame:
    """For each brand and size the part of the preferred type."""
    first = A.as_reported(_tagged(spark, d).withColumns({"fiscal_period": F.lit("FY"), "form": F.lit("10-K"), "accn": F.lit("")}), ["p_brand", "p_size", "rank"], pos="p_partkey")
    return A.spliced(first, ["p_brand", "p_size"]).select("p_brand", "p_size", "p_partkey", "tag", "p_retailprice")


@query(f"WITH r AS (SELECT DISTINCT p_brand, p_size, p_type, {_RANK} AS rank FROM part) SELECT p_brand, p_size, string_agg(p_type, '+' ORDER BY rank) AS tags FROM r WHERE rank IS NOT NULL GROUP BY 1, 2")
def tag_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Types that each brand and size was spliced from."""
    return A.provenance(_tagged(spark, d), ["p_brand", "p_size"])


@query("""
WITH u AS (SELECT p_brand, p_type, p_size, p_partkey, CASE WHEN p_type = 'PROMO' THEN 0 WHEN p_type LIKE 'S%' THEN 1 ELSE 2 END AS r FROM part),
b AS (SELECT p_brand, first(p_type ORDER BY r, p_size, p_type) AS unit FROM u GROUP BY 1)
SELECT b.p_brand, unit, count(*) AS points FROM b JOIN part p ON p.p_brand = b.p_brand AND p.p_type = unit GROUP BY 1, 2
""")
def best_unit_choice(spark: SparkSession, d: str) -> DataFrame:
    """The unit of each field: the declared one, else one with the prefix, else
    the first."""
    unit = F.when(F.startswith("p_type", F.lit("S")), F.concat(F.lit("USD/"), "p_type")).otherwise(F.col("p_type"))
    points = table(spark, d, "part").select(
        F.lit(0).alias("cik"), F.col("p_brand").alias("field_key"), F.lit("t").alias("tag"), F.lit("PROMO").alias("want_unit"), unit.alias("unit"), F.col("p_size").alias("unit_pos")
    )
    best = A.best_unit(points).groupBy(F.col("field_key").alias("p_brand"), F.replace("unit", F.lit("USD/"), F.lit("")).alias("unit"))
    return best.agg(F.count(F.lit(1)).alias("points"))


_YEARLY = f"SELECT c_mktsegment AS ticker, year(o_orderdate) AS fiscal_year, {_MONEY} AS value FROM orders JOIN customer ON o_custkey = c_custkey"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"))
    return table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderkey").join(who, "o_custkey")


@query(f"""
WITH y AS ({_YEARLY} WHERE NOT (c_mktsegment = 'BUILDING' AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1, 2), w AS (SELECT *, max(fiscal_year) OVER (PARTITION BY ticker) AS last FROM y)
SELECT ticker, fiscal_year::INT AS fiscal_year, value FROM w WHERE fiscal_year >= last - 2
""")
def trailing_fiscal_years(spark: SparkSession, d: str) -> DataFrame:
    """The last three years of each segment, which end differently."""
    o = _orders(spark, d).where(~((F.col("ticker") == "BUILDING") & (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))))
    per = o.groupBy("ticker", F.year("o_orderdate").alias("fiscal_year")).agg(_money().alias("value")).withColumn("period", F.lit("annual"))
    return A.trailing_years(per).select("ticker", "fiscal_year", "value")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("""
SELECT day, """ + ", ".join(f"CASE WHEN sum(CASE WHEN event_type = '{t}' AND user_id = 7 THEN 1 ELSE 0 END) > 0 THEN 'Y' ELSE '-' END AS {t}" for t in _TYPES) + """
FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, user_id FROM events) GROUP BY day
""")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """On which days a user had which events."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id")
    return A.coverage_matrix(e.where("user_id = 7"), e, _TYPES, "day", "event_type")


@query(f"""
SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END)::DOUBLE AS "F",
  sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END)::DOUBLE AS "O", sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END)::DOUBLE AS "P"
FROM orders GROUP BY 1
""")
def wide_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each priority, one column for each status."""
    sums = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(_money().alias("value"))
    return M.wide(sums, ["F", "O", "P"], ["o_orderpriority"], "o_orderstatus")


def _quarterly(spark: SparkSession, d: str) -> DataFrame:
    per = _orders(spark, d).groupBy("ticker", F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_period"))
    return per.agg(_money().alias("revenue"), F.count(F.lit(1)).cast("double").alias("n_orders"), F.max("o_totalprice").alias("largest"))


_QUARTERLY = f"""
q AS (
  SELECT c_mktsegment AS ticker, year(o_orderdate)::INT AS fiscal_year, 'Q' || quarter(o_orderdate) AS fiscal_period, {_MONEY} AS revenue, count(*)::DOUBLE AS n_orders, max(o_totalprice) AS largest
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
"""


@query(f"""
WITH {_QUARTERLY}
SELECT a.ticker, a.fiscal_year, a.fiscal_period, a.revenue, b.revenue AS revenue_prior_year, (a.revenue - b.revenue) / nullif(b.revenue, 0) AS growth
FROM q a LEFT JOIN q b ON a.ticker = b.ticker AND a.fiscal_period = b.fiscal_period AND a.fiscal_year = b.fiscal_year + 1
""")
def yoy_growth(spark: SparkSession, d: str) -> DataFrame:
    """Growth on the same quarter a year before."""
    both = M.with_prior_year(_quarterly(spark, d), ["revenue"])
    return both.select(*M.KEYS, "revenue", "revenue_prior_year", M.growth(F.col("revenue"), F.col("revenue_prior_year")).alias("growth"))


_FORMULAS = {
    "double_mean": "mean_order * 2",
    "mean_order": "revenue / n_orders",
    "peak_ratio": "largest / (mean_order - mean_order)",
    "net_growth": "(revenue - revenue_prior_year) / revenue_prior_year",
    "debt_share": "short_term_debt / revenue",
    "unknown_item": "revenue - not_reported",
    "loop_a": "loop_b + 1",
    "loop_b": "loop_a + 1",
}


@query(f"""
WITH {_QUARTERLY},
j AS (SELECT a.*, b.revenue AS rp FROM q a LEFT JOIN q b ON a.ticker = b.ticker AND a.fiscal_period = b.fiscal_period AND a.fiscal_year = b.fiscal_year + 1),
m AS (
  SELECT ticker, fiscal_year, fiscal_period, unnest(['double_mean', 'mean_order', 'peak_ratio', 'net_growth', 'debt_share', 'unknown_item', 'loop_a', 'loop_b']) AS field_key,
    unnest([revenue / n_orders * 2, revenue / n_orders, NULL, (revenue - rp) / nullif(rp, 0), 0.0 / revenue, NULL, NULL, NULL]) AS value FROM j)
SELECT *, 'quarterly' AS period FROM m
""")
def derived_metrics_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas that use each other, last year, and what isn't there."""
    long = _quarterly(spark, d).unpivot(M.KEYS, ["revenue", "n_orders", "largest"], "field_key", "value")
    return M.derive(long, _FORMULAS, ["revenue", "n_orders", "largest"])


def _periods(spark: SparkSession, d: str) -> DataFrame:
    """Years and first three quarters of each segment; one quarter is missing."""
    o = _orders(spark, d)
    q, y = F.quarter("o_orderdate"), F.year("o_orderdate")
    ends = F.max(F.col("o_orderdate").cast("date")).alias("period_end")
    annual = o.groupBy("ticker", y.alias("fiscal_year")).agg(_money().alias("value"), ends).withColumns({"fiscal_period": F.lit("FY"), "period": F.lit("annual")})
    quarters = o.where(q < 4).groupBy("ticker", y.alias("fiscal_year"), F.concat(F.lit("Q"), q.cast("string")).alias("fiscal_period")).agg(_money().alias("value"), ends).withColumn("period", F.lit("quarterly"))
    gap = (F.col("ticker") == "FURNITURE") & (F.col("fiscal_year") > 1996) & (F.col("fiscal_period") != "FY")
    return annual.unionByName(quarters).where(~gap)


_PERIODS = f"""
p AS (
  SELECT c_mktsegment AS ticker, year(o_orderdate)::INT AS fiscal_year, 'FY' AS fiscal_period, {_MONEY} AS value, max(o_orderdate::DATE) AS period_end
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
  UNION ALL
  SELECT c_mktsegment, year(o_orderdate)::INT, 'Q' || quarter(o_orderdate), {_MONEY}, max(o_orderdate::DATE)
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE quarter(o_orderdate) < 4 AND NOT (c_mktsegment = 'FURNITURE' AND year(o_orderdate) > 1996) GROUP BY 1, 2, 3),
w AS (
  SELECT ticker, fiscal_year, max(CASE WHEN fiscal_period = 'FY' THEN value END) AS fy, max(CASE WHEN fiscal_period = 'FY' THEN period_end END) AS fe,
    max(CASE WHEN fiscal_period = 'Q1' THEN value END) AS q1, max(CASE WHEN fiscal_period = 'Q2' THEN value END) AS q2, max(CASE WHEN fiscal_period = 'Q3' THEN value END) AS q3 FROM p GROUP BY 1, 2),
qs AS (
  SELECT ticker, fiscal_year, fiscal_period, period_end, value FROM p WHERE fiscal_period <> 'FY'
  UNION ALL SELECT ticker, fiscal_year, 'Q4', fe, fy - (q1 + q2 + q3) FROM w WHERE fy - (q1 + q2 + q3) IS NOT NULL),
l4 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC, value DESC) AS n FROM qs),
s4 AS (SELECT ticker, sum(CAST(value AS DECIMAL(38,6)))::DOUBLE AS s FROM l4 WHERE n <= 4 GROUP BY 1 HAVING count(*) = 4),
la AS (SELECT ticker, arg_max(value, period_end) AS v FROM p WHERE fiscal_period = 'FY' GROUP BY 1),
ttm AS (SELECT la.ticker, coalesce(s, v) AS ttm, CASE WHEN s IS NULL THEN 'latest_fy' ELSE 'ttm_4q' END AS basis FROM la LEFT JOIN s4 USING (ticker))
"""


@query(f"WITH {_PERIODS} SELECT * FROM qs")
def q4_derivation(spark: SparkSession, d: str) -> DataFrame:
    """Quarters, the fourth as the year less the others."""
    return M.quarters_with_fourth(_periods(spark, d), ["ticker"]).select("ticker", "fiscal_year", "fiscal_period", "period_end", "value")


@query(f"WITH {_PERIODS} SELECT * FROM ttm")
def ttm_with_q4_derivation(spark: SparkSession, d: str) -> DataFrame:
    """Trailing four quarters of each segment, else its last year."""
    p = _periods(spark, d)
    return M.trailing_sum(M.quarters_with_fourth(p, ["ticker"]), p.where("period = 'annual'"), ["ticker"])


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
SELECT o_custkey, o_totalprice FROM r WHERE n = 1
""")
def latest_instant(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's last order value."""
    return M.latest_value(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey"), ["o_custkey"], "o_orderdate", "o_totalprice", ["o_orderkey"])


_MULT = f"""
{_PERIODS},
mk AS (SELECT c_mktsegment AS ticker, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE * 1000 AS cap, count(*)::DOUBLE AS n FROM customer GROUP BY 1 UNION ALL SELECT 'UNLISTED', NULL, NULL)
"""


@query(f"""
WITH {_MULT}
SELECT mk.ticker, cap AS market_cap, ttm AS ttm_revenue, basis AS ttm_basis, CASE WHEN mk.ticker = 'BUILDING' THEN 0 ELSE n * 500 END AS total_debt,
  cap + CASE WHEN mk.ticker = 'BUILDING' THEN 0 ELSE n * 500 END AS enterprise_value, cap / nullif(ttm, 0) AS ps_ttm,
  (cap + CASE WHEN mk.ticker = 'BUILDING' THEN 0 ELSE n * 500 END) / nullif(ttm, 0) AS ev_sales, round_even(ttm / nullif(cap, 0) * 100, 2) AS sales_yield_pct
FROM mk LEFT JOIN ttm ON mk.ticker = ttm.ticker WHERE mk.ticker <> 'UNLISTED'
""")
def valuation_multiples(spark: SparkSession, d: str) -> DataFrame:
    """Multiples of each segment: balances stand for the market value."""
    p = _periods(spark, d)
    ttm = M.trailing_sum(M.quarters_with_fourth(p, ["ticker"]), p.where("period = 'annual'"), ["ticker"])
    market = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("ticker")).agg((_money("c_acctbal") * 1000).alias("market_cap"), F.count(F.lit(1)).cast("double").alias("_n"))
    none = F.lit(None).cast("double")
    frame = market.join(ttm, "ticker", "left").select(
        "ticker", F.lit(None).cast("string").alias("as_of"), none.alias("price"), "market_cap", F.col("ttm").alias("revenue_ttm"), F.col("ttm").alias("net_income_ttm"), F.col("basis").alias("net_income_basis"),
        F.when(F.col("ticker") != "BUILDING", F.col("_n") * 500).alias("long_term_debt"),
        *(none.alias(c) for c in (
            "short_term_debt", "cash_and_cash_equivalents", "short_term_investments", "operating_income_ttm", "depreciation_and_amortization_ttm", "net_cash_from_operating_activities_ttm",
            "capital_expenditures_ttm", "dividends_per_share_ttm", "total_stockholders_equity", "target_mean", "target_high", "target_low", "fwd_eps_cy", "fwd_eps_ny", "_growth_cy", "_growth_ny",
            "analyst_count", "recommendation", "rec_mean", "rec_strong_buy", "rec_buy", "rec_hold", "rec_sell", "rec_strong_sell", "yf_trailing_pe", "yf_forward_pe", "yf_price_to_book",
            "yf_ev_ebitda", "yf_dividend_yield_pct",
        )),
    )
    out = V.multiples(frame, exact=False)
    return out.select(
        "ticker", "market_cap", "ttm_revenue", F.col("ttm_net_income_basis").alias("ttm_basis"), "total_debt", "enterprise_value", "ps_ttm", "ev_sales", F.col("earnings_yield_pct").alias("sales_yield_pct")
    )


@query(f"""
WITH y AS (SELECT c_mktsegment AS ticker, year(o_orderdate)::INT AS fiscal_year, {_MONEY} AS revenue, max(o_totalprice) AS largest, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS filled
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS n FROM y)
SELECT ticker, fiscal_year, round_even(revenue / 1e6, 0) AS revenue_m, round_even(largest / 1e6, 0) AS largest_m, round_even(filled * 100, 1) AS filled_pct FROM r WHERE n = 1
""")
def snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    """Scorecard of each segment's last year."""
    y = _orders(spark, d).groupBy("ticker", F.year("o_orderdate").alias("fiscal_year")).agg(
        _money().alias("revenue"), F.max("o_totalprice").alias("largest"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("filled")
    )
    return M.snapshot(y, ["revenue", "largest"], ["filled"])


@query(f"""
WITH {_QUARTERLY},
f AS (SELECT ticker, fiscal_year, fiscal_period, 'revenue' AS field_key, revenue AS value FROM q UNION ALL SELECT ticker, fiscal_year, fiscal_period, 'largest', largest FROM q)
SELECT ticker, fiscal_year, fiscal_period, field_key, CASE WHEN field_key = 'largest' THEN CASE WHEN fiscal_year > 1998 THEN NULL ELSE value * 2 END ELSE value END AS value FROM f
""")
def metric_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Metrics replace facts of the same name, even by nothing."""
    q = _quarterly(spark, d)
    facts = q.unpivot(M.KEYS, ["revenue", "largest"], "field_key", "value").withColumn("period", F.lit("quarterly"))
    metrics = q.select(*M.KEYS, F.lit("largest").alias("field_key"), F.when(F.col("fiscal_year") <= 1998, F.col("largest") * 2).alias("value"), F.lit("quarterly").alias("period"))
    return M.merged(facts, metrics).drop("period")


@query("""
SELECT row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 99 END, c_mktsegment, c_nationkey) AS line, c_mktsegment AS ticker, c_nationkey, customers
FROM (SELECT c_mktsegment, c_nationkey, count(*) AS customers FROM customer GROUP BY 1, 2)
""")
def ordered_wide(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a report in a given order of companies."""
    per = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("ticker"), "c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    rank = M.place(["MACHINERY", "BUILDING"])
    return per.withColumn("line", F.row_number().over(Window.orderBy(rank, "ticker", "c_nationkey")).cast("long"))


@query("SELECT c_mktsegment AS ticker, count(DISTINCT (year(o_orderdate), quarter(o_orderdate))) AS periods, count(DISTINCT o_orderpriority) AS fields FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def period_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct periods and fields of each segment."""
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"))
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("fiscal_period"), F.col("o_orderpriority").alias("field_key"))
    return A.counts(o.join(who, "o_custkey"))
