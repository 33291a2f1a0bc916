"""News, insider and context queries: documents stand for items, line items
for transactions, events for alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import fiscal
from quillmark.functions import text as X
from quillmark.operators import context as C
from quillmark.operators import holdings as H
from quillmark.operators import insider as I
from quillmark.operators import news as N
from quillmark.plans.base import query
from quillmark.sources import filings as S
from quillmark.sources import logs as L
from quillmark.sources.tables import table

_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as news items: the head of the text is the title."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("uid"), F.array("source").alias("tickers"), F.substring("text", 1, 40).alias("title"), "lang"
    )


@query(f"""
WITH i AS (SELECT doc_id AS pos, 'd:' || doc_id AS uid, source, substring(text, 1, 40) AS title FROM documents),
k AS (SELECT *, coalesce(nullif({_NORM.format('title')}, ''), uid) AS key FROM i)
SELECT min(pos) AS pos, arg_min(title, pos) AS title, string_agg(DISTINCT source, ',' ORDER BY source) AS tickers, string_agg(uid, ',' ORDER BY pos) AS uids FROM k GROUP BY key
""")
def title_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Items of one title as one, with the sources and ids of all."""
    return N.by_title(_items(spark, d)).select("pos", "title", F.array_join("tickers", ",").alias("tickers"), F.array_join("uids", ",").alias("uids"))


@query("""
WITH i AS (SELECT doc_id AS pos, source, lang || ' ' || (n_chars % 50) AS event, (doc_id * 37) % 100 AS m FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY m DESC, pos) AS n, count(*) OVER (PARTITION BY event) AS dup_count FROM i),
t AS (SELECT event, string_agg(DISTINCT source, ',' ORDER BY source) AS tickers FROM i GROUP BY 1)
SELECT event AS event_key, pos, m::INT AS materiality, tickers, dup_count FROM k JOIN t USING (event) WHERE n = 1
""")
def event_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Items of one event as one, the most material for all."""
    v = F.struct(F.lit(True).alias("relevant"), ((F.col("doc_id") * 37) % 100).cast("int").alias("materiality"), F.concat_ws(" ", "lang", (F.col("n_chars") % 50).cast("string")).alias("event"))
    items = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("uid"), F.array("source").alias("tickers"), F.lit("").alias("title"), v.alias("verdict"))
    return N.by_event(items).select("event_key", "pos", F.col("verdict.materiality").alias("materiality"), F.array_join("tickers", ",").alias("tickers"), "dup_count")


@query("""
WITH e AS (SELECT doc_id AS n, source, (doc_id * 37) % 100 AS m, 1 + doc_id % 3 AS dup, CASE WHEN doc_id % 4 = 0 THEN -doc_id ELSE doc_id % 25 + 1 END AS g FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m DESC, dup DESC, n) AS r, sum(dup) OVER (PARTITION BY g) AS total FROM e)
SELECT n, m::INT AS materiality, total::BIGINT AS dup_count FROM k WHERE r = 1
""")
def event_merge(spark: SparkSession, d: str) -> DataFrame:
    """Events of one group as one; those without a group stay alone."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("n"), "source")
    events = docs.select("n", F.array("source").alias("tickers"), (1 + F.col("n") % 3).alias("dup_count"), F.struct(((F.col("n") * 37) % 100).cast("int").alias("materiality")).alias("verdict"))
    groups = docs.where("n % 4 <> 0").select("n", (F.col("n") % 25 + 1).alias("group"))
    return N.merged_groups(events, groups).select("n", F.col("verdict.materiality").alias("materiality"), F.col("dup_count").cast("long").alias("dup_count"))


@query("""
SELECT event_id, (value * 0.2)::INT AS materiality FROM (SELECT event_id, value, event_type FROM events) WHERE event_type = 'purchase' AND (value * 0.2)::INT >= 40
""")
def push_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Relevant items of enough materiality."""
    m = F.bround(F.col("value") * 0.2).cast("int")
    e = table(spark, d, "events").select("event_id", F.struct((F.col("event_type") == "purchase").alias("relevant"), m.alias("materiality")).alias("verdict"))
    return N.worth_pushing(e, 40).select("event_id", F.col("verdict.materiality").alias("materiality"))


@query("""
SELECT event_id, floor(epoch(ts))::BIGINT AS published FROM events WHERE event_id % 10 = 0 OR floor(epoch(ts))::BIGINT >= 1706572800 - 14400
""")
def freshness_cap(spark: SparkSession, d: str) -> DataFrame:
    """Items of the last four hours, and those without a time."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", at.alias("published"), F.when(F.col("event_id") % 10 != 0, at).alias("_known"))
    return e.where(N.recent(F.col("_known"), F.lit(1706572800), 4 * 3600)).select("event_id", "published")


@query("SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-16')")
def anti_join_seen(spark: SparkSession, d: str) -> DataFrame:
    """Events that weren't there in the first half of the month."""
    e = table(spark, d, "events")
    return N.unseen(e.select("event_id", "event_type"), e.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")), "event_id")


@query("""
SELECT doc_id, p.p_name AS name FROM documents, (SELECT DISTINCT p_name FROM part WHERE p_partkey < 40) p
WHERE regexp_matches(lower(text), '\\bthe\\b') AND contains(lower(text), split_part(p.p_name, ' ', 1)) OR contains(lower(text), split_part(p.p_name, ' ', 2)) OR contains(lower(text), split_part(p.p_name, ' ', 1))
""")
def mention_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name a product by either of its words."""
    names = table(spark, d, "part").where("p_partkey < 40").select(F.col("p_name").alias("name"), F.col("p_name").alias("ticker")).distinct()
    return N.naming(table(spark, d, "documents").select("doc_id", "text"), names, "text").select("doc_id", F.col("ticker").alias("name"))


@query("""
SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < 100 AND b.p_partkey % 3 = 0
""")
def issuer_fuzzy_join(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose names mean the same, legal forms aside."""
    p = table(spark, d, "part")
    a = p.where("p_partkey < 100").select(F.col("p_partkey").alias("left_key"), F.concat(F.initcap("p_name"), F.lit(" Corp.")).alias("left_name"))
    b = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("right_key"), F.concat(F.upper("p_name"), F.lit(" HOLDINGS INC NEW")).alias("right_name"))
    return C.issuer_join(a, b, "left_name", "right_name").select("left_key", "right_key")


@query("""
WITH f AS (SELECT p_name, sum(CAST(p_retailprice AS DECIMAL(38,6)))::DOUBLE AS net_flow, count(*) AS rows FROM part WHERE p_size < 10 GROUP BY 1),
c AS (SELECT DISTINCT p_name FROM part)
SELECT p_name AS ticker, net_flow, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'absent' ELSE 'found' END AS status FROM c LEFT JOIN f USING (p_name)
""")
def institutional_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flow of each product over the rows that name it, if any."""
    p = table(spark, d, "part")
    flows = p.where("p_size < 10").select(F.concat(F.upper("p_name"), F.lit(" CO")).alias("issuer"), F.col("p_retailprice").cast("string").alias("net_flow"))
    return C.institutional_flow(flows, p.select(F.col("p_name").alias("ticker"), F.col("p_name").alias("name")).distinct())


@query("""
WITH k AS (SELECT user_id, event_type, ts, value, event_id, CASE WHEN event_type = 'purchase' THEN 'insider' ELSE 'news' END AS kind FROM events WHERE event_type IN ('purchase', 'view', 'error')),
a AS (
  SELECT user_id, count(*) FILTER (kind = 'news') AS news, count(*) FILTER (kind = 'insider') AS insider, max(CASE WHEN kind = 'news' THEN floor(value)::INT END) AS best,
    max(strftime(ts, '%Y-%m-%d')) AS latest FROM k GROUP BY 1)
SELECT 'U' || user_id AS ticker, news, insider, coalesce(best, 0) AS best, latest FROM a WHERE user_id < 60 ORDER BY insider * 2 + news DESC, best DESC, 'U' || user_id LIMIT 20
""")
def scout_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Users by their alerts, purchases counting twice."""
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "view", "error"))
    kind = F.when(F.col("event_type") == "purchase", "insider").otherwise("news")
    pushes = e.select(
        F.array(F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("tickers"), kind.alias("kind"), F.when(kind == "news", F.floor("value").cast("int")).alias("score"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("detail"), F.col("event_id").alias("pos"),
    )
    known = table(spark, d, "events").where("user_id < 60").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"))
    return C.scout(pushes, known, 20).select("ticker", "news", "insider", "best", "latest")


@query("SELECT event_type, (props->>'$.k')::INT % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_props_json(spark: SparkSession, d: str) -> DataFrame:
    """Counts by a field of a JSON column, read by schema."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


_NY = "timezone('America/New_York', timezone('UTC', ts))"


@query(f"""
SELECT event_id, hour({_NY})::INT AS hour, (isodow({_NY}) - 1)::INT AS weekday FROM events
WHERE isodow({_NY}) <= 5 AND hour({_NY}) >= 6 AND hour({_NY}) < 22
""")
def hours_gate(spark: SparkSession, d: str) -> DataFrame:
    """Events within filing hours in New York."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    inside = table(spark, d, "events").where(fiscal.within_hours(F.col("ts").cast("timestamp")))
    return inside.select("event_id", F.hour(local).alias("hour"), F.weekday(local).alias("weekday"))


@query("""
WITH a AS (
  SELECT l_orderkey AS accession,
    sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(28,6)) END)::DOUBLE AS buy_shares,
    sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(28,6)) END)::DOUBLE AS sell_shares,
    sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity * l_extendedprice AS DECIMAL(28,6)) END)::DOUBLE AS sell_value,
    max(CASE WHEN l_returnflag = 'R' THEN l_shipdate::DATE END) AS sell_date, bool_or(l_linestatus = 'O') AS has_plan
  FROM lineitem GROUP BY 1)
SELECT accession, buy_shares, sell_shares, sell_value, sell_value / nullif(sell_shares, 0) AS sell_price, sell_date,
  CASE WHEN buy_shares > 60 THEN 'HIGH' WHEN sell_shares > 0 AND sell_value >= CASE WHEN has_plan THEN 6e6 ELSE 3e6 END THEN 'HIGH' WHEN sell_shares > 0 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  CASE WHEN buy_shares > 60 THEN 'open_market_buy' WHEN sell_shares > 0 AND sell_value >= CASE WHEN has_plan THEN 6e6 ELSE 3e6 END THEN CASE WHEN has_plan THEN 'large_plan_sale' ELSE 'discretionary_sale' END
    WHEN sell_shares > 0 THEN 'ordinary_sale' ELSE 'routine' END AS reason
FROM a
""")
def weighted_avg_price_tier(spark: SparkSession, d: str) -> DataFrame:
    """Orders as filings: sides, weighted price, tier and reason."""
    lots = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("accession"), F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("F").alias("code"), F.col("l_quantity").alias("shares"),
        F.col("l_extendedprice").alias("price"), F.lit(None).cast("double").alias("after"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_linestatus") == "O").alias("plan"),
    )
    both = I.sides(lots, "accession").join(lots.groupBy("accession").agg(F.bool_or("plan").alias("has_plan")), "accession")
    level, reason = I.tier(F.when(F.col("buy_shares") > 60, 1).otherwise(0), F.col("sell_shares"), F.col("sell_value"), F.col("has_plan"), 3e6, 6e6)
    return both.select("accession", "buy_shares", "sell_shares", "sell_value", "sell_price", "sell_date", level.alias("tier"), reason.alias("reason"))


@query("""
WITH s AS (
  SELECT o_custkey AS ticker, o_orderkey, o_orderdate::DATE AS date, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos, o_totalprice FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY strftime(date, '%Y-%m-%d') DESC, o_totalprice * 10 DESC, pos) AS r FROM s WHERE pos <= 12 AND o_orderkey % 3 = 0)
SELECT ticker, strftime(date, '%Y-%m-%d') AS txn_date, o_totalprice * 10 AS value FROM n WHERE r = 1
""")
def latest_sales(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's last sale among the twelve newest orders."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lot = F.struct(day.alias("date"), F.lit("S").alias("code"), F.when(F.col("o_orderkey") % 3 == 0, "D").otherwise("A").alias("acq_disp"), F.lit(10.0).alias("shares"), F.col("o_totalprice").alias("price"), F.lit(0.0).alias("after"))
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.row_number().over(w).alias("pos"), day.alias("date"), F.array(lot).alias("lots"), F.lit("?").alias("owner"), F.lit(False).alias("has_plan"))
    return I.latest_sales(f).select("ticker", "found.txn_date", "found.value")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN '$' || printf('%.2f', o_totalprice / 1e6) || 'M' WHEN o_totalprice >= 1e3 THEN '$' || printf('%.1f', o_totalprice / 1e3) || 'K' ELSE 'small' END AS text,
  CASE WHEN o_totalprice >= 400000 THEN 'red' WHEN o_totalprice >= 200000 THEN 'yellow' ELSE 'white' END AS mark
FROM orders WHERE o_totalprice >= 1000 AND o_orderkey % 2 = 0 AND abs(o_totalprice / 100 - round(o_totalprice / 100)) < 0.4
""")
def display_forms(spark: SparkSession, d: str) -> DataFrame:
    """Dollars and marks as they are shown."""
    p = F.col("o_totalprice")
    o = table(spark, d, "orders").where((p >= 1000) & (F.col("o_orderkey") % 2 == 0) & (F.abs(p / 100 - F.round(p / 100)) < 0.4))
    mark = X.tier_mark(F.when(p >= 400000, 90).when(p >= 200000, 50).otherwise(10))
    return o.select("o_orderkey", X.usd(p).alias("text"), F.when(mark == "\U0001f534", "red").when(mark == "⚪", "white").otherwise("yellow").alias("mark"))


@query("SELECT event_id, datediff('second', ts, TIMESTAMP '2024-03-01') // 86400 AS age_days, datediff('second', ts, TIMESTAMP '2024-03-01') // 86400 > 45 AS stale FROM events")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """Age in days at a given time, and whether that is too old."""
    days, stale = C.staleness(F.date_trunc("second", F.col("ts").cast("timestamp")), F.lit("2024-03-01").cast("timestamp"))
    return table(spark, d, "events").select("event_id", days.alias("age_days"), stale.alias("stale"))


@query("""
SELECT 'nation' AS source, n_name AS title, n_nationkey::BIGINT AS published FROM nation UNION ALL SELECT 'region', r_name, r_regionkey::BIGINT FROM region
""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources as one; one that can't be read doesn't take the rest along."""
    from quillmark.sources.news import all_sources

    def items(name: str, title: str, key: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return table(spark, d, name).select(F.lit(name).alias("source"), none.alias("uid"), F.array(F.lit(name)).alias("tickers"), F.col(title).alias("title"), none.alias("summary"), none.alias("url"), F.col(key).cast("long").alias("published"))

    def broken() -> DataFrame:
        raise OSError("no such feed")

    out, _ = all_sources({"nation": lambda: items("nation", "n_name", "n_nationkey"), "region": lambda: items("region", "r_name", "r_regionkey"), "broken": broken})
    return out.select("source", "title", "published")


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 12
""")
def recency_list(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve events of each user."""
    return N.latest(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 12).select("user_id", "event_id")


_FORM = """<?xml version="1.0"?><ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>%s</rptOwnerName></reportingOwnerId>
<reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>1</isOfficer><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner>
<aff10b5One>%s</aff10b5One><footnotes><footnote>Under a 10b5–1 plan</footnote></footnotes><nonDerivativeTable><nonDerivativeTransaction>
<transactionDate><value>2026-01-05</value></transactionDate><transactionCoding><transactionCode>%s</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>%d</value></transactionShares><transactionPricePerShare><value>10.5</value></transactionPricePerShare>
<transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts>
<postTransactionAmounts><sharesOwnedFollowingTransaction><value>7</value></sharesOwnedFollowingTransaction></postTransactionAmounts>
</nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


@query("""
SELECT 's' || s_suppkey AS accession, s_name AS owner, 'Director/CFO' AS roles, true AS has_plan, CASE WHEN s_suppkey % 2 = 0 THEN 'HIGH' WHEN s_suppkey % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS tier,
  CASE WHEN s_suppkey % 2 = 0 THEN 'open_market_buy' WHEN s_suppkey % 3 = 0 THEN 'large_plan_sale' ELSE 'ordinary_sale' END AS reason FROM supplier
""")
def xml_form4_parse(spark: SparkSession, d: str) -> DataFrame:
    """Ownership forms from XML to tier."""
    k = F.col("s_suppkey")
    xml = F.format_string(_FORM, F.col("s_name"), F.lit("0"), F.when(k % 2 == 0, "P").otherwise("S"), F.when(k % 3 == 0, 5_000_000).otherwise(10).cast("long"))
    forms = table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("accession"), xml.alias("xml"))
    return I.classify(S.ownership(forms)).select("accession", "owner", F.array_join("roles", "/").alias("roles"), "has_plan", "tier", "reason")


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS date, 'news' AS kind, 'U' || user_id || ',T' AS tickers, floor(value)::INT AS score, event_type AS detail FROM events WHERE event_type <> 'error'
""")
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    """Pushes from log lines."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    mark = F.when(F.col("event_type") == "error", "[push:FAIL]").otherwise("[push:ok]")
    line = F.concat(stamp, F.lit("  "), mark, F.lit(" u"), F.col("user_id").cast("string"), F.lit(",t m="), F.floor("value").cast("string"), F.lit(" (2x) "), F.col("event_type"))
    return L.pushes(table(spark, d, "events").select(line.alias("value")), "news").withColumn("tickers", F.array_join("tickers", ","))


@query("""
SELECT c_custkey AS cik, '0' || o_orderkey AS accession, CASE WHEN o_orderstatus = 'O' THEN '4' ELSE '4/A' END AS form,
  'https://www.sec.gov/Archives/edgar/data/' || c_custkey || '/0' || o_orderkey || '/f' || o_orderkey || '.xml' AS xml_url
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P')
""")
def tracked_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings of some forms from parallel arrays."""
    form = F.when(F.col("o_orderstatus") == "O", "4").when(F.col("o_orderstatus") == "P", "4/A").otherwise("8-K")
    k = F.col("o_orderkey").cast("string")
    each = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cik"), F.struct(F.concat(F.lit("0-"), k).alias("a"), form.alias("f"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.concat(F.lit("xsl/f"), k, F.lit(".xml")).alias("p")).alias("_r"))
    names = (("a", "accessionNumber"), ("f", "form"), ("d", "filingDate"), ("p", "primaryDocument"), ("d", "reportDate"))
    recent = F.struct(*(F.col(f"_l.{c}").alias(n) for c, n in names))
    lists = each.groupBy("cik").agg(F.collect_list("_r").alias("_l")).select("cik", F.struct(recent.alias("recent")).alias("filings"))
    return S.tracked_filings(lists, ["4", "4/A"]).select("cik", F.replace("accession", F.lit("-"), F.lit("")).alias("accession"), "form", "xml_url")


@query("""
SELECT CASE WHEN o_totalprice > 250000 AND o_orderstatus = 'F' THEN 'increased' WHEN o_totalprice < 250000 AND o_orderstatus = 'F' THEN 'decreased' WHEN o_orderstatus = 'F' THEN 'unchanged' ELSE 'NEW' END AS status, count(*) AS n
FROM orders GROUP BY 1
""")
def holder_status(spark: SparkSession, d: str) -> DataFrame:
    """Change of a position in words."""
    before = F.when(F.col("o_orderstatus") == "F", 250000.0).otherwise(0.0)
    return table(spark, d, "orders").groupBy(H.status(F.col("o_totalprice"), before).alias("status")).agg(F.count(F.lit(1)).alias("n"))
