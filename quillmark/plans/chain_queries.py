"""Whole chains: company facts to the long table, and quotes to valuations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import fiscal
from quillmark.functions.rounding import py_round
from quillmark.operators import facts as A
from quillmark.operators import metrics as M
from quillmark.operators import sinks as K
from quillmark.operators import valuation as V
from quillmark.plans import filing_queries as Q
from quillmark.plans.base import query, scratch, taken
from quillmark.sources import filings as S
from quillmark.sources import market
from quillmark.sources.tables import table

_COMPANIES = [
    (1, "AUTOMOBILE", "12-31", None), (2, "BUILDING", "06-30", "us-gaap"), (3, "FURNITURE", "01-31", None), (4, "HOUSEHOLD", "02-29", None), (5, "MACHINERY", "12-31", "ifrs-full"),
]
_FIELDS = [
    ("revenue", "Revenue", "income", "USD", "duration", ["T0", "T1"], False), ("assets", "Assets", "balance", "USD/shares", "instant", ["T2", "T3"], False),
    ("per_share", "Per share", "income", "EUR", "instant", ["T3", "T4"], None), ("by_region", "By region", "income", "USD", "duration", ["T4"], True),
]


def _text(v: object) -> str:
    return "NULL" if v is None else f"'{v}'"


_POINTS = f"""
company(cik, ticker, m, dd, tax) AS (VALUES {", ".join(f"({c}, '{t}', {int(e[:2])}, {int(e[3:])}, {_text(x)})" for c, t, e, x in _COMPANIES)}),
field(field_key, label, statement, want, kind, tag, rank) AS (
  VALUES {", ".join(f"('{k}', '{label}', '{s}', '{u}', '{p}', '{t}', {i})" for k, label, s, u, p, tags, dim in _FIELDS if not dim for i, t in enumerate(tags))}),
p AS (
  SELECT cik, ticker, m, dd, coalesce(tax, 'us-gaap') AS known, o_orderkey AS pos, CASE o_orderkey % 7 WHEN 0 THEN 'dei' WHEN 1 THEN 'other' ELSE 'us-gaap' END AS taxonomy,
    'T' || (o_orderkey % 5) AS tag, CASE (o_orderkey // 5) % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD/shares' ELSE 'pure' END AS unit, o_orderdate::DATE AS e,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE - 364 WHEN 1 THEN o_orderdate::DATE - 90 WHEN 2 THEN o_orderdate::DATE - 180 END AS b,
    o_totalprice AS value, CASE WHEN o_orderkey % 11 = 0 THEN '10-K/A' WHEN o_orderkey % 11 < 5 THEN '10-K' ELSE '10-Q' END AS form, lpad((o_orderkey * 37 % 1000)::VARCHAR, 4, '0') AS accn
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN company ON c_mktsegment = ticker),
t AS (SELECT *, CASE taxonomy WHEN 'us-gaap' THEN 0 WHEN 'dei' THEN 1 END AS tx, dense_rank() OVER (PARTITION BY cik, taxonomy, tag ORDER BY unit) AS unit_pos FROM p),
t2 AS (SELECT *, min(tx) OVER (PARTITION BY cik, tag) AS first_tx FROM t WHERE tx IS NOT NULL),
j AS (SELECT * FROM t2 JOIN field USING (tag) WHERE tx = first_tx),
u AS (SELECT *, first_value(unit) OVER (PARTITION BY cik, field_key, tag ORDER BY CASE WHEN unit = want THEN 0 WHEN unit LIKE 'USD%' THEN 1 ELSE 2 END, unit_pos, unit) AS best FROM j),
y AS (SELECT *, year(e) AS y0 FROM u WHERE unit = best AND form IN ('10-K', '10-Q') AND known = 'us-gaap'),
z AS (SELECT *, make_date(y0, m, CASE WHEN m = 2 AND NOT y0 % 4 = 0 THEN least(dd, 28) ELSE dd END) AS end0 FROM y),
fy AS (SELECT *, CASE WHEN e <= end0 + 21 THEN y0 ELSE y0 + 1 END::INT AS fiscal_year FROM z),
g AS (SELECT *, make_date(fiscal_year - 1, m, CASE WHEN m = 2 AND NOT (fiscal_year - 1) % 4 = 0 THEN least(dd, 28) ELSE dd END) AS before FROM fy),
lab AS (SELECT *, greatest(1, least(4, round_even(date_diff('day', before, e) / 91.25, 0)::INT)) AS q, date_diff('day', b, e) AS days FROM g),
per AS (
  SELECT *, CASE WHEN kind = 'instant' THEN CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END WHEN days BETWEEN 300 AND 400 THEN 'FY' WHEN days BETWEEN 80 AND 100 AND q < 4 THEN 'Q' || q END AS fiscal_period FROM lab),
pt AS (SELECT *, CASE WHEN fiscal_period = 'FY' THEN 'annual' ELSE 'quarterly' END AS period FROM per WHERE fiscal_period IS NOT NULL)
"""
_LONG = f"""
{_POINTS},
a1 AS (
  SELECT *, row_number() OVER (PARTITION BY cik, field_key, rank, fiscal_year, fiscal_period
    ORDER BY CASE WHEN form = CASE WHEN fiscal_period = 'FY' THEN '10-K' ELSE '10-Q' END THEN 0 ELSE 1 END, accn, pos) AS n FROM pt),
a2 AS (SELECT *, row_number() OVER (PARTITION BY cik, field_key, fiscal_year, fiscal_period ORDER BY rank) AS r FROM a1 WHERE n = 1),
a3 AS (SELECT *, max(CASE WHEN period = 'annual' THEN fiscal_year END) OVER (PARTITION BY ticker) AS last FROM a2 WHERE r = 1)
"""


def _companies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_COMPANIES, "cik long, ticker string, fiscal_year_end string, xbrl_taxonomy string")


def _fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FIELDS, "key string, label string, statement string, unit string, period_type string, us_gaap_tags array<string>, dimensional boolean")


def _entries(df: DataFrame, keys: list[str], name: str, value: str):
    """Rows of ``keys`` with a map of the column ``name`` to ``value``."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("_v"))


#: Keys whose points are a page of the documents.
_PAGE = 1 << 18


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as company facts: written as one JSON document for each company
    and page of keys, and read back as facts are."""
    key = F.col("o_orderkey")
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"))
    day = F.col("o_orderdate").cast("date")
    start = F.when(key % 4 == 0, F.date_sub(day, 364)).when(key % 4 == 1, F.date_sub(day, 90)).when(key % 4 == 2, F.date_sub(day, 180))
    form = F.when(key % 11 == 0, "10-K/A").when(key % 11 < 5, "10-K").otherwise("10-Q")
    point = F.struct(
        start.cast("string").alias("start"), day.cast("string").alias("end"), F.col("o_totalprice").alias("val"), form.alias("form"), F.lpad((key * 37 % 1000).cast("string"), 4, "0").alias("accn")
    )
    each = table(spark, d, "orders").join(who, "o_custkey").join(_companies(spark), "ticker").select(
        "cik", F.when(key % 7 == 0, "dei").when(key % 7 == 1, "other").otherwise("us-gaap").alias("taxonomy"), F.concat(F.lit("T"), (key % 5).cast("string")).alias("tag"),
        F.when(F.floor(key / 5) % 3 == 0, "USD").when(F.floor(key / 5) % 3 == 1, "USD/shares").otherwise("pure").alias("unit"), key.alias("k"), point.alias("p"),
    )
    each = each.withColumn("page", F.floor(F.coalesce("k", F.lit(0)) / _PAGE))
    points = each.groupBy("cik", "page", "taxonomy", "tag", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("points"))
    units = _entries(points, ["cik", "page", "taxonomy", "tag"], "unit", "points")
    # Every page has all units of a tag, so that they have the same places.
    names = each.groupBy("cik", "taxonomy", "tag").agg(F.array_sort(F.collect_set("unit")).alias("_units"))
    full = F.map_from_arrays("_units", F.transform("_units", lambda u: F.coalesce(F.col("_v")[u], F.array().cast(points.schema["points"].dataType))))
    nodes = units.join(names, ["cik", "taxonomy", "tag"]).withColumn("node", F.struct(F.col("tag").alias("label"), full.alias("units")))
    tags = nodes.groupBy("cik", "page", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("tag", "node"))).alias("tags"))
    docs = tags.groupBy("cik", "page").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    folder = scratch(spark)
    docs.select(F.to_json(F.struct("cik", "page", "facts")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return taken(S.company_facts(spark, folder), folder)


@query(f"""
WITH {_LONG}
SELECT ticker, cik::BIGINT AS cik, fiscal_year, fiscal_period, period, field_key, label, statement, value, unit, b AS period_start, e AS period_end, form, accn AS accession, tag AS xbrl_tag
FROM a3 WHERE last IS NULL OR fiscal_year >= last - 2
""")
def facts_long(spark: SparkSession, d: str) -> DataFrame:
    """The canonical long table, from JSON documents on."""
    return A.facts_long(_facts(spark, d), _fields(spark), _companies(spark))


@query(f"WITH {_POINTS} SELECT ticker, field_key, string_agg(DISTINCT tag, '+' ORDER BY tag) AS tags FROM pt GROUP BY 1, 2")
def facts_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags that the fields of each company are spliced from."""
    return A.tag_provenance(_facts(spark, d), _fields(spark), _companies(spark))


@query(f"""
WITH {Q._LABEL},
s AS (SELECT fye, m, dd, e, l_shipdate::DATE AS le FROM lineitem JOIN lab ON l_orderkey = o_orderkey),
y2 AS (SELECT fye, m, dd, le, date_diff('day', e, le) AS days, year(le) AS ly FROM s),
z2 AS (SELECT *, make_date(ly, m, CASE WHEN m = 2 AND NOT ly % 4 = 0 THEN least(dd, 28) ELSE dd END) AS le0 FROM y2),
f2 AS (SELECT *, CASE WHEN le <= le0 + 21 THEN ly ELSE ly + 1 END AS lfy FROM z2),
g2 AS (SELECT *, make_date(lfy - 1, m, CASE WHEN m = 2 AND NOT (lfy - 1) % 4 = 0 THEN least(dd, 28) ELSE dd END) AS lbefore FROM f2),
l2 AS (SELECT *, greatest(1, least(4, round_even(date_diff('day', lbefore, le) / 91.25, 0)::INT)) AS lq FROM g2)
SELECT fye, CASE WHEN days BETWEEN 300 AND 400 THEN 'FY' WHEN days BETWEEN 80 AND 100 AND lq < 4 THEN 'Q' || lq ELSE 'drop' END AS period, count(*) AS points FROM l2 GROUP BY 1, 2
""")
def duration_period(spark: SparkSession, d: str) -> DataFrame:
    """Periods of the spans from order to shipment, year ends differing; a
    fourth quarter of its own is dropped."""
    k = F.col("o_custkey") % 4
    fye = F.when(k == 0, "06-30").when(k == 1, "01-31").when(k == 2, "12-31").otherwise("02-29")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("_b"), fye.alias("fye"))
    m, day = F.split("fye", "-")[0].cast("int"), F.split("fye", "-")[1].cast("int")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("_e")).join(orders, "l_orderkey")
    period = fiscal.duration_period(F.col("_b"), F.col("_e"), m, day)
    return lines.groupBy("fye", F.coalesce(period, F.lit("drop")).alias("period")).agg(F.count(F.lit(1)).alias("points"))


_GROSS = {"margin": "gross_profit / revenue", "grown": "gross_profit - gross_profit_prior_year", "goods": "goodwill + intangible_assets_net", "cash_less": "revenue - cash"}


@query(f"""
WITH {Q._QUARTERLY},
g AS (SELECT *, CASE WHEN fiscal_year % 2 = 0 THEN largest END AS gp, CASE WHEN ticker <> 'BUILDING' THEN n_orders * 1000 END AS cost FROM q),
h AS (SELECT a.*, coalesce(a.gp, a.revenue - a.cost) AS full_gp, b.gp AS before FROM g a LEFT JOIN g b ON a.ticker = b.ticker AND a.fiscal_period = b.fiscal_period AND a.fiscal_year = b.fiscal_year + 1),
m AS (
  SELECT ticker, fiscal_year, fiscal_period, unnest(['margin', 'grown', 'goods', 'cash_less']) AS field_key,
    unnest([full_gp / nullif(revenue, 0), full_gp - before, n_orders + 0.0, NULL]) AS value FROM h)
SELECT *, 'quarterly' AS period FROM m
""")
def derived_gross_profit(spark: SparkSession, d: str) -> DataFrame:
    """Gross profit from revenue and cost where it isn't reported; last year's
    is only what was reported; additive items count as 0, others don't."""
    q = Q._quarterly(spark, d)
    cube = q.select(
        *M.KEYS, "revenue", F.when(F.col("fiscal_year") % 2 == 0, F.col("largest")).alias("gross_profit"),
        F.when(F.col("ticker") != "BUILDING", F.col("n_orders") * 1000).alias("cost_of_revenue"), F.col("n_orders").alias("goodwill"),
    )
    fields = ["revenue", "gross_profit", "cost_of_revenue", "goodwill"]
    return M.derive(cube.unpivot(M.KEYS, fields, "field_key", "value"), _GROSS, fields)


_FACTORS = {
    "net_income": 0.5, "revenue": 1.0, "operating_income": 0.25, "depreciation_and_amortization": 0.125, "net_cash_from_operating_activities": 0.5, "capital_expenditures": 0.25,
    "dividends_per_share": 2.0**-20, "total_stockholders_equity": 2.0, "cash_and_cash_equivalents": 0.25, "short_term_investments": 0.125, "short_term_debt": 0.5, "long_term_debt": 0.25,
}


def _market(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of each segment, through JSON documents."""
    per = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("ticker")).agg(F.count(F.lit(1)).cast("double").alias("n"), (Q._money("c_acctbal") * 1000).alias("cap"))
    n, is_ = F.col("n"), lambda t: F.col("ticker") == t
    info = F.create_map(*(x for k, v in {
        "currentPrice": F.when(is_("HOUSEHOLD") | is_("BUILDING"), F.lit(0.0)).otherwise(n), "regularMarketPrice": F.when(is_("BUILDING"), F.lit(0.0)).otherwise(n + 0.5), "marketCap": F.col("cap"),
        "targetMeanPrice": n * 2, "numberOfAnalystOpinions": F.lit(12), "recommendationKey": F.lit("buy"), "recommendationMean": F.lit(1.75), "trailingPE": n / 8, "forwardPE": n / 16,
        "priceToBook": F.lit("n/a"), "enterpriseToEbitda": F.lit(9.5), "dividendYield": F.lit(0.5),
    }.items() for x in (F.lit(k), v.cast("string"))))
    estimate = lambda p, avg, g: F.struct(F.lit(p).alias("period"), avg.alias("avg"), F.lit(g).alias("growth"))
    rated = lambda *r: F.struct(*(F.lit(v).alias(k) for k, v in zip(("strongBuy", "buy", "hold", "sell", "strongSell"), r)))
    doc = F.struct(
        "ticker", F.lit("2026-01-05").alias("as_of"), info.alias("info"), F.struct(F.when(is_("MACHINERY"), F.lit(0.0)).otherwise(n * 1.5).alias("mean"), (n * 3).alias("high"), (n / 2).alias("low")).alias("price_targets"),
        F.array(estimate("0y", n / 8, 0.5), estimate("0y", n / 16, 0.12345), estimate("+1y", n / 4, -0.02675)).alias("earnings_estimate"), F.array(rated(5, 4, 3, 2, 1), rated(9, 9, 9, 9, 9)).alias("recommendations"),
    )
    folder = scratch(spark)
    per.select(F.to_json(doc).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return taken(market.quotes(market.snapshots(spark, folder), spark.createDataFrame([("BUILDING", 7.5), ("AUTOMOBILE", 1.0)], "ticker string, close double")), folder)


_ROUND = lambda x, n: f"CAST(printf('%.{n}f', {x}) AS DOUBLE)"


@query(f"""
WITH {Q._PERIODS},
st AS (SELECT ticker, value AS latest FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC, fiscal_year, fiscal_period) AS n FROM p) WHERE n = 1),
mk AS (SELECT c_mktsegment AS ticker, count(*)::DOUBLE AS n, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE * 1000 AS cap FROM customer GROUP BY 1),
px AS (SELECT *, CASE ticker WHEN 'BUILDING' THEN 7.5 WHEN 'HOUSEHOLD' THEN n + 0.5 ELSE n END AS price, CASE WHEN ticker = 'MACHINERY' THEN n * 2 ELSE n * 1.5 END AS target FROM mk),
watched(ticker) AS (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('UNLISTED')),
f AS (
  SELECT watched.ticker, price, cap, target, n, basis, 0.5 * ttm AS ni, ttm AS rev, 0.25 * ttm + 0.125 * ttm AS ebitda, 0.5 * ttm - 0.25 * ttm AS fcf, {_FACTORS["dividends_per_share"]!r} * ttm AS dps, 2 * latest AS equity,
    coalesce(0.5 * latest, 0) + CASE WHEN watched.ticker = 'FURNITURE' THEN 0 ELSE coalesce(0.25 * latest, 0) END AS debt, coalesce(0.25 * latest, 0) + coalesce(0.125 * latest, 0) AS cash
  FROM watched LEFT JOIN px USING (ticker) LEFT JOIN ttm USING (ticker) LEFT JOIN st USING (ticker))
SELECT ticker, price, cap AS market_cap, cap + debt - cash AS enterprise_value, cap / nullif(ni, 0) AS pe_ttm, cap / nullif(rev, 0) AS ps_ttm, cap / nullif(equity, 0) AS pb,
  (cap + debt - cash) / nullif(ebitda, 0) AS ev_ebitda, (cap + debt - cash) / nullif(rev, 0) AS ev_sales, {_ROUND("fcf / nullif(cap, 0) * 100", 2)} AS fcf_yield_pct, {_ROUND("ni / nullif(cap, 0) * 100", 2)} AS earnings_yield_pct,
  {_ROUND("dps / nullif(price, 0) * 100", 2)} AS dividend_yield_pct, basis AS ttm_net_income_basis, ebitda AS ttm_ebitda, fcf AS ttm_fcf, debt AS total_debt, cash - debt AS net_cash,
  CASE WHEN n IS NOT NULL THEN 12 END::BIGINT AS analyst_count, CASE WHEN n IS NOT NULL THEN 5 END::BIGINT AS rec_strong_buy, target AS target_mean, {_ROUND("(target / price - 1) * 100", 1)} AS target_upside_pct,
  n / 16 AS fwd_eps_cy, CASE WHEN n IS NOT NULL THEN {_ROUND("0.12345::DOUBLE * 100", 1)} END AS fwd_eps_cy_growth_pct, CASE WHEN n IS NOT NULL THEN {_ROUND("-0.02675::DOUBLE * 100", 1)} END AS fwd_eps_ny_growth_pct,
  price / nullif(n / 16, 0) AS fwd_pe_consensus, NULL::DOUBLE AS yf_price_to_book
FROM f
""")
def valuation_full(spark: SparkSession, d: str) -> DataFrame:
    """Trailing figures, quotes and estimates to multiples, rounded as Python
    does it; a company without either stays."""
    p = Q._periods(spark, d)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("field_key"), F.lit(f).alias("_f")) for k, f in _FACTORS.items())))
    facts = p.withColumn("_x", rows).select("ticker", "fiscal_year", "fiscal_period", "period", "period_end", "_x.field_key", (F.col("value") * F.col("_x._f")).alias("value"))
    facts = facts.where("NOT (ticker = 'FURNITURE' AND field_key = 'long_term_debt')")
    watched = spark.createDataFrame([(t,) for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNLISTED")], "ticker string")
    return V.valuation(watched, facts, _market(spark, d)).select(
        "ticker", "price", "market_cap", "enterprise_value", "pe_ttm", "ps_ttm", "pb", "ev_ebitda", "ev_sales", "fcf_yield_pct", "earnings_yield_pct", "dividend_yield_pct", "ttm_net_income_basis", "ttm_ebitda",
        "ttm_fcf", "total_debt", "net_cash", "analyst_count", "rec_strong_buy", "target_mean", "target_upside_pct", "fwd_eps_cy", "fwd_eps_cy_growth_pct", "fwd_eps_ny_growth_pct", "fwd_pe_consensus", "yf_price_to_book",
    )


@query("""
SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_extendedprice / l_quantity) AS DOUBLE) AS two, CAST(printf('%.0f', l_extendedprice / 8) AS DOUBLE) AS whole,
  CAST(printf('%.1f', CASE WHEN l_linenumber <> 3 THEN l_quantity / 20 END) AS DOUBLE) AS one FROM lineitem
""")
def python_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Prices rounded as Python does it, ties of the exact value to even."""
    q = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 20)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", py_round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("two"), py_round(F.col("l_extendedprice") / 8).alias("whole"), py_round(q, 1).alias("one")
    )


@query(f"""
WITH {Q._QUARTERLY},
r AS (SELECT *, CASE ticker WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 99 END AS place FROM q)
SELECT row_number() OVER (ORDER BY place, ticker, fiscal_year, fiscal_period) AS line, ticker, fiscal_year, fiscal_period, revenue, CASE WHEN n_orders > 3 THEN largest END AS largest FROM r
""")
def report_csv(spark: SparkSession, d: str) -> DataFrame:
    """A wide report in a given order of companies, written as CSV and read
    again; missing values are empty cells."""
    q = Q._quarterly(spark, d).withColumn("largest", F.when(F.col("n_orders") > 3, F.col("largest")))
    wide = M.wide(q.unpivot(M.KEYS, ["revenue", "largest"], "field_key", "value"), ["revenue", "largest"])
    folder = scratch(spark)
    K.write_report(M.ordered(wide, ["MACHINERY", "BUILDING"], ["ticker", "fiscal_year", "fiscal_period"]), folder)
    back = spark.read.schema("ticker string, fiscal_year int, fiscal_period string, revenue double, largest double").csv(folder, header=True)
    return taken(back.select((F.monotonically_increasing_id() + 1).alias("line"), "*"), folder)


@query("SELECT kind, r_regionkey::INT AS r_regionkey, r_name FROM region, (VALUES ('parquet'), ('csv'), ('json')) k(kind)")
def table_formats(spark: SparkSession, d: str) -> DataFrame:
    """A table written in each format, over what was there, and read again."""
    folder, out = scratch(spark), []
    regions = table(spark, d, "region").select("r_regionkey", "r_name")
    for kind in ("parquet", "csv", "json"):
        for rows in (regions.limit(1), regions):
            K.write_table(rows, f"{folder}/{kind}", kind)
        back = spark.read.schema("r_regionkey int, r_name string").format(kind).option("header", "true").load(f"{folder}/{kind}")
        out.append(back.select(F.lit(kind).alias("kind"), "r_regionkey", "r_name"))
    return taken(out[0].unionByName(out[1]).unionByName(out[2]), folder)
