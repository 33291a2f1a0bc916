"""Holdings queries: line items stand for positions, suppliers for managers.

A security is a part's brand and type, its position a line item's quantity and
price, a quarter that of the ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import holdings as H
from quillmark.plans.base import query
from quillmark.sources import filings as S
from quillmark.sources.tables import table

#: Quarters compared, and the least value of a security at this scale.
NOW, BEFORE = ("1998-04-01", "1998-07-01"), ("1998-01-01", "1998-04-01")
FLOOR = 200_000.0


def _lines(spark: SparkSession, d: str, span: tuple[str, str]) -> DataFrame:
    """Positions of a quarter.  The date range reaches the scan."""
    at = F.col("l_shipdate")
    return table(spark, d, "lineitem").where((at >= F.lit(span[0]).cast("timestamp_ntz")) & (at < F.lit(span[1]).cast("timestamp_ntz"))).select(
        "l_partkey", "l_suppkey", F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("value")
    )


def _securities(spark: SparkSession, d: str, span: tuple[str, str]) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type").alias("cusip"))
    return H.roll_up(_lines(spark, d, span).join(parts, "l_partkey"), ["cusip"], "l_suppkey")


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return H.market_flows(_securities(spark, d, NOW), _securities(spark, d, BEFORE), ["cusip"], FLOOR)


_SEC = """
sec AS (
  SELECT p_brand || '/' || p_type AS cusip, CASE WHEN l_shipdate >= TIMESTAMP '1998-04-01' THEN 1 ELSE 0 END AS cur,
    sum(CAST(l_quantity AS DECIMAL(28,4)))::DOUBLE AS shares, sum(CAST(l_extendedprice AS DECIMAL(28,4)))::DOUBLE AS value, count(DISTINCT l_suppkey) AS entities
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-07-01' GROUP BY 1, 2),
flows AS (
  SELECT a.cusip, a.entities AS holders, a.entities - coalesce(b.entities, 0) AS holders_chg, a.shares, a.value, coalesce(a.value / nullif(a.shares, 0), 0) AS implied_price,
    a.shares - coalesce(b.shares, 0) AS delta_shares, (a.shares - coalesce(b.shares, 0)) * coalesce(a.value / nullif(a.shares, 0), 0) AS net_flow,
    (a.shares - coalesce(b.shares, 0)) / nullif(b.shares, 0) * 100 AS shares_chg_pct
  FROM sec a LEFT JOIN sec b ON a.cusip = b.cusip AND b.cur = 0 WHERE a.cur = 1 AND a.value >= 200000),
flagged AS (
  SELECT *, CASE WHEN shares_chg_pct IS NULL THEN 'NEW/IPO?' WHEN shares_chg_pct > 150 OR shares_chg_pct < -60 THEN 'split/IPO?' ELSE '' END AS flag FROM flows)
"""


@query(f"""
WITH {_SEC},
clean AS (SELECT * FROM flagged WHERE flag = ''),
b AS (SELECT *, 'BOUGHT' AS side FROM clean ORDER BY net_flow DESC, cusip LIMIT 30),
s AS (SELECT *, 'SOLD' AS side FROM clean ORDER BY net_flow, cusip LIMIT 30)
SELECT * FROM b UNION ALL SELECT * FROM s
""")
def qoq_net_flow_topn(spark: SparkSession, d: str) -> DataFrame:
    """Largest net flows between two quarters, both sides."""
    return H.two_sided(_flows(spark, d).where(F.col("flag") == ""), ["cusip"])


@query(f"""
WITH {_SEC},
r AS (SELECT cusip, round_even(net_flow / 1e5, 0) AS net_flow_r FROM flagged WHERE flag = ''),
b AS (SELECT *, 'BOUGHT' AS side FROM r ORDER BY net_flow_r DESC, cusip LIMIT 30),
s AS (SELECT *, 'SOLD' AS side FROM r ORDER BY net_flow_r, cusip LIMIT 30)
SELECT * FROM b UNION ALL SELECT * FROM s
""")
def rounded_flow_topn(spark: SparkSession, d: str) -> DataFrame:
    """Largest flows on both sides by the rounded figure, ties by security."""
    flows = _flows(spark, d).where(F.col("flag") == "").select("cusip", F.bround(F.col("net_flow") / 1e5).alias("net_flow_r"))
    return H.two_sided(flows, ["cusip"], by="net_flow_r")


@query(f"WITH {_SEC} SELECT cusip, holders, holders_chg, shares, value FROM flagged ORDER BY holders DESC, value DESC, cusip LIMIT 30")
def qoq_breadth_topn(spark: SparkSession, d: str) -> DataFrame:
    """Securities with the most holders."""
    return _flows(spark, d).select("cusip", "holders", "holders_chg", "shares", "value").orderBy(F.desc("holders"), F.desc("value"), "cusip").limit(30)


@query(f"WITH {_SEC} SELECT cusip, shares_chg_pct, flag FROM flagged")
def split_flags(spark: SparkSession, d: str) -> DataFrame:
    """Marks of new positions and likely splits."""
    return _flows(spark, d).select("cusip", "shares_chg_pct", "flag")


def _holders(spark: SparkSession, d: str, span: tuple[str, str]) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("cusip"))
    managers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("family"))
    return H.roll_up(_lines(spark, d, span).join(parts, "l_partkey").join(managers, "l_suppkey"), ["cusip", "family"], "l_suppkey")


_HOLD = """
h AS (
  SELECT p_brand AS cusip, n_name AS family, CASE WHEN l_shipdate >= TIMESTAMP '1998-04-01' THEN 1 ELSE 0 END AS cur,
    sum(CAST(l_quantity AS DECIMAL(28,4)))::DOUBLE AS shares, sum(CAST(l_extendedprice AS DECIMAL(28,4)))::DOUBLE AS value, count(DISTINCT l_suppkey) AS entities
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-07-01' GROUP BY 1, 2, 3)
"""


@query(f"""
WITH {_HOLD},
j AS (SELECT a.*, coalesce(b.shares, 0) AS prev_shares FROM h a LEFT JOIN h b ON a.cusip = b.cusip AND a.family = b.family AND b.cur = 0 WHERE a.cur = 1),
r AS (
  SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY value DESC, family) AS rank,
    (sum(CAST(value AS DECIMAL(38,4))) OVER (PARTITION BY cusip))::DOUBLE AS total FROM j)
SELECT cusip, rank::INTEGER AS rank, family, entities, shares, value, value / nullif(total, 0) * 100 AS pct_of_value, prev_shares, shares - prev_shares AS delta_shares,
  (shares - prev_shares) / nullif(prev_shares, 0) * 100 AS delta_pct,
  CASE WHEN prev_shares = 0 THEN 'NEW' WHEN shares > prev_shares THEN 'increased' WHEN shares < prev_shares THEN 'decreased' ELSE 'unchanged' END AS status
FROM r WHERE rank <= 25
""")
def holder_rollup_top25(spark: SparkSession, d: str) -> DataFrame:
    """Largest holders of each brand and how they changed."""
    return H.top_holders(_holders(spark, d, NOW), _holders(spark, d, BEFORE))


@query(f"""
WITH {_HOLD},
t AS (
  SELECT cusip, cur, count(*) AS n, sum(CAST(shares AS DECIMAL(38,4)))::DOUBLE AS s, sum(CAST(value AS DECIMAL(38,4)))::DOUBLE AS v FROM h GROUP BY 1, 2)
SELECT a.cusip, a.n AS num_holders, a.s AS total_shares, a.v AS total_value, coalesce(b.n, 0) AS prev_num_holders, a.s - coalesce(b.s, 0) AS qoq_shares_chg,
  (a.s - coalesce(b.s, 0)) / nullif(b.s, 0) * 100 AS qoq_shares_chg_pct
FROM t a LEFT JOIN t b ON a.cusip = b.cusip AND b.cur = 0 WHERE a.cur = 1
""")
def holder_summary(spark: SparkSession, d: str) -> DataFrame:
    """Holders and shares of each brand in both quarters."""
    return H.holder_summary(_holders(spark, d, NOW), _holders(spark, d, BEFORE))


@query("""
SELECT 'holders' AS policy, count(*) AS positions, sum(CAST(l_quantity AS DECIMAL(28,2)))::DOUBLE AS shares
FROM lineitem JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
UNION ALL
SELECT 'flows', count(*), sum(CAST(l_quantity AS DECIMAL(28,2)))::DOUBLE
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) ON l_orderkey = o_orderkey WHERE coalesce(o_orderstatus <> 'P', true)
""")
def cover_missing_policy(spark: SparkSession, d: str) -> DataFrame:
    """Positions with and without those of filings that lack a cover: orders
    are covers, open ones (P) amendments, and some are missing."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ACCESSION_NUMBER"), "l_quantity")
    covers = table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), (F.col("o_orderstatus") == "P").alias("amended"))
    count = lambda df, p: df.agg(F.count(F.lit(1)).alias("positions"), F.sum(F.col("l_quantity").cast("decimal(28,2)")).cast("double").alias("shares")).select(F.lit(p).alias("policy"), "positions", "shares")
    return count(H.original_only(lines, covers, False), "holders").unionByName(count(H.original_only(lines, covers, True), "flows"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def semi_join_universe(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one segment's customers."""
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return H.restricted(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), wanted, "o_custkey")


_CLASSES = [("WID", "WIDGET"), ("GIZ", "GIZMO"), ("RNG", "RING"), ("GEA", "GEAR"), ("BLT", "BOLT")]


@query("""
WITH n AS (
  SELECT CASE WHEN contains(upper(p_name), 'WIDGET') THEN 'WID' WHEN contains(upper(p_name), 'GIZMO') THEN 'GIZ' WHEN contains(upper(p_name), 'RING') THEN 'RNG'
    WHEN contains(upper(p_name), 'GEAR') THEN 'GEA' WHEN contains(upper(p_name), 'BOLT') THEN 'BLT' END AS ticker, p_brand AS cusip, p_type AS title, p_retailprice FROM part),
g AS (SELECT ticker, cusip, title, sum(CAST(p_retailprice AS DECIMAL(38,2)))::DOUBLE AS value, count(*) AS filers FROM n WHERE ticker IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN ticker = 'WID' AND title = 'SMALL' THEN 0 ELSE 1 END, value DESC, cusip, title) AS n FROM g)
SELECT ticker, upper(cusip) AS cusip, title, value, filers FROM r WHERE n = 1
""")
def class_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The main class of each product by name pattern, hint and value."""
    info = table(spark, d, "part").select(F.col("p_name").alias("NAMEOFISSUER"), F.col("p_brand").alias("CUSIP"), F.col("p_type").alias("TITLEOFCLASS"), F.col("p_retailprice").cast("string").alias("VALUE"))
    return H.resolve_classes(info, _CLASSES, {"WID": "SMALL"})


@query("""
SELECT CASE WHEN contains(upper(p_name), 'RED') OR contains(upper(p_name), 'HOT') THEN 'Warm' WHEN contains(upper(p_name), 'BLUE') THEN 'Cold'
  ELSE array_to_string(string_split(p_name, ' ')[1:2], ' ') END AS family, count(*) AS parts
FROM part GROUP BY 1
""")
def family_alias(spark: SparkSession, d: str) -> DataFrame:
    """Families by the first alias that fits, else the first two words."""
    return table(spark, d, "part").groupBy(X.manager_family(F.col("p_name"), {"Warm": "RED|HOT", "Cold": "BLUE"}).alias("family")).agg(F.count(F.lit(1)).alias("parts"))


@query("""
SELECT p_partkey, p_name || ' fund' AS name, true AS fund FROM part WHERE p_size % 5 = 0
UNION ALL SELECT p_partkey, p_name, false FROM part WHERE p_size % 5 <> 0
""")
def fund_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Whether a name marks a fund."""
    name = F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" fund"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("fund", X.is_fund(F.col("name")))


@query("""
WITH t AS (SELECT sum(CAST(s_acctbal AS DECIMAL(38,4)))::DOUBLE AS total FROM supplier)
SELECT s_suppkey, s_acctbal AS value, total, s_acctbal / nullif(total, 0) * 100 AS pct FROM supplier, t
""")
def portfolio_share(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's part of the whole."""
    return H.shares_of_total(table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("value")))


@query("""
WITH r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN p_size || 'x' ELSE p_size || '.5' END AS raw FROM part)
SELECT p_partkey, raw, CASE WHEN trim(raw) = '' THEN 0.0 ELSE try_cast(trim(raw) AS DOUBLE) END AS value FROM r WHERE trim(raw) = '' OR try_cast(trim(raw) AS DOUBLE) IS NOT NULL
""")
def numeric_positions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from text: blank is 0, what isn't one goes."""
    n, m = F.col("p_size").cast("string"), F.col("p_size") % 4
    raw = F.when(m == 0, "").when(m == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(m == 2, F.concat(n, F.lit("x"))).otherwise(F.concat(n, F.lit(".5")))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("value", X.to_number(F.col("raw"))).where("value IS NOT NULL")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_returnflag = 'N' AND l_linestatus IN ('O', '') AND l_quantity > 45
""")
def common_stock_only(spark: SparkSession, d: str) -> DataFrame:
    """Positions in shares: returned lines are options, filled ones debt."""
    lines = table(spark, d, "lineitem").where("l_quantity > 45").withColumns({
        "PUTCALL": F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")), "SSHPRNAMTTYPE": F.when(F.col("l_linestatus") == "O", "sh").otherwise("PRN"),
    })
    return H.common_stock(lines).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice * 1000 ELSE o_totalprice END AS value FROM orders")
def unit_scale_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Values in thousands before a date, as they are after: positions of two
    periods."""
    number = F.col("o_totalprice").cast("string")
    raw = table(spark, d, "orders").select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("nameOfIssuer"), F.lit(None).cast("string").alias("cusip"), F.lit(None).cast("string").alias("putCall"), number.alias("value"),
        F.struct(F.lit("").alias("sshPrnamt")).alias("shrsOrPrnAmt"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("_old"),
    )
    old, new = S.positions(raw.where("_old"), F.lit("2022-12-31")), S.positions(raw.where("NOT _old"), F.lit("2023-01-01"))
    return old.unionByName(new).where("shares = 0 AND cusip = ''").select(F.col("issuer").cast("long").alias("o_orderkey"), "value")
