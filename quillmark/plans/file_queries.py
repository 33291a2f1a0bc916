"""Sources and sinks through files: tables are written in the raw form of a
source, landed or read by its reader, and held against the table itself."""

from __future__ import annotations

import gzip
import json
from urllib.error import HTTPError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import context as C
from quillmark.operators import holdings as H
from quillmark.operators import insider as I
from quillmark.operators import news as N
from quillmark.operators import sinks as K
from quillmark.plans import jobs as J
from quillmark.plans.base import query, scratch, taken
from quillmark.plans.news_queries import _FORM
from quillmark.sources import filings as S
from quillmark.sources import landing as L
from quillmark.sources import logs
from quillmark.sources import news as W
from quillmark.sources.tables import table
from quillmark.streaming import jobs as streams
from quillmark.streaming import processors as P

# Bulk tables

_BULK = """
i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_suppkey, l_shipdate, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos FROM lineitem WHERE l_orderkey % 20 = 0),
info AS (
  SELECT 'a' || l_orderkey AS accession, p_brand AS cusip, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE p_name || ' ' || (l_partkey % 7) END AS name, l_quantity AS shares, l_extendedprice AS value, pos
  FROM i JOIN part ON l_partkey = p_partkey WHERE l_partkey % 11 <> 0),
cover AS (SELECT 'a' || o_orderkey AS accession, arg_max(f, k) AS amended, 'Manager ' || (o_orderkey % 9) AS manager
  FROM (SELECT o_orderkey, k, CASE WHEN (o_orderkey + k) % 3 = 0 THEN true ELSE false END AS f FROM orders, (VALUES (0), (1)) v(k) WHERE o_orderkey % 20 = 0 AND o_orderkey % 60 <> 20) GROUP BY o_orderkey),
filer AS (SELECT 'a' || o_orderkey AS accession, (o_orderkey % 50 + 1)::VARCHAR AS cik FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey % 80 <> 0)
"""


def _tsv(spark: SparkSession, folder: str, name: str, columns: list[str], rows: DataFrame, order: list) -> DataFrame:
    """Rows as one file with header, and read again with their places."""
    cells = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    head = spark.createDataFrame([(None, "\t".join(columns))], "o struct<x:int>, value string").select(F.lit(0).alias("_h"), F.lit(None).alias("_o"), "value")
    body = rows.select(F.lit(1).alias("_h"), F.struct(*order).alias("_o"), cells.alias("value"))
    lines = head.select("_h", F.lit(None).cast(body.schema["_o"].dataType).alias("_o"), "value").unionByName(body)
    lines.repartition(1).sortWithinPartitions("_h", "_o").select("value").write.text(f"{folder}/{name}")
    return S.read_tsv(spark, f"{folder}/{name}", pos="_pos")


def _bulk(spark: SparkSession, d: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items as an information table, orders as covers and submissions,
    each filing of which has two lines."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name")
    lines = table(spark, d, "lineitem").where("l_orderkey % 20 = 0").join(part, "l_partkey")
    accession = lambda k: F.concat(F.lit("a"), F.col(k).cast("string"))
    info = lines.select(
        accession("l_orderkey").alias("ACCESSION_NUMBER"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat_ws(" ", "p_name", (F.col("l_partkey") % 7).cast("string"))).alias("NAMEOFISSUER"),
        F.col("p_brand").alias("CUSIP"), F.when(F.col("l_partkey") % 11 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("VALUE"), F.col("l_quantity").alias("SSHPRNAMT"),
        F.lit("SH").alias("SSHPRNAMTTYPE"), F.lit("").alias("PUTCALL"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
    )
    filings = table(spark, d, "orders").where("o_orderkey % 20 = 0").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    cover = filings.where("o_orderkey % 60 <> 20").select(
        accession("o_orderkey").alias("ACCESSION_NUMBER"), F.when((F.col("o_orderkey") + F.col("k")) % 3 == 0, " true ").otherwise("N").alias("ISAMENDMENT"),
        F.concat(F.lit("Manager "), (F.col("o_orderkey") % 9).cast("string")).alias("FILINGMANAGER_NAME"), "k", "o_orderkey",
    )
    sub = filings.where("o_orderkey % 80 <> 0").select(accession("o_orderkey").alias("ACCESSION_NUMBER"), (F.col("o_orderkey") % 50 + F.col("k")).alias("CIK"), "k", "o_orderkey")
    return (
        _tsv(spark, folder, "INFOTABLE", ["ACCESSION_NUMBER", "NAMEOFISSUER", "CUSIP", "VALUE", "SSHPRNAMT", "SSHPRNAMTTYPE", "PUTCALL"], info, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]),
        _tsv(spark, folder, "COVERPAGE", ["ACCESSION_NUMBER", "ISAMENDMENT", "FILINGMANAGER_NAME"], cover, ["k", "o_orderkey"]), _tsv(spark, folder, "SUBMISSION", ["ACCESSION_NUMBER", "CIK"], sub, ["k", "o_orderkey"]),
    )


@query(f"""
WITH {_BULK}
SELECT cusip, manager, sum(CAST(shares AS DECIMAL(28,4)))::DOUBLE AS shares, sum(CAST(value AS DECIMAL(28,4)))::DOUBLE AS value, count(DISTINCT coalesce(cik, accession)) AS entities
FROM info JOIN cover USING (accession) LEFT JOIN filer USING (accession) WHERE NOT amended GROUP BY 1, 2
""")
def bulk_holders(spark: SparkSession, d: str) -> DataFrame:
    """Holders from bulk files: the last line of a filing's cover and
    submission counts, a filing without a cover is left out."""
    folder = scratch(spark)
    info, cover, sub = _bulk(spark, d, folder)
    rows = H.original_only(H.numeric_positions(H.common_stock(info)).withColumnRenamed("CUSIP", "cusip"), H.cover_flags(cover, "_pos"), keep_unknown=False).join(H.filers(sub, "_pos"), "ACCESSION_NUMBER", "left")
    return taken(H.roll_up(rows.withColumn("filer", F.coalesce("cik", "ACCESSION_NUMBER")), ["cusip", "manager"], "filer"), folder)


@query(f"""
WITH {_BULK}
SELECT cusip, sum(CAST(shares AS DECIMAL(28,4)))::DOUBLE AS shares, sum(CAST(value AS DECIMAL(28,4)))::DOUBLE AS value, count(DISTINCT accession) AS entities, arg_min(CASE WHEN name <> '' THEN name END, CASE WHEN name <> '' THEN pos END) AS issuer
FROM info LEFT JOIN cover USING (accession) WHERE NOT coalesce(amended, false) GROUP BY 1
""")
def bulk_securities(spark: SparkSession, d: str) -> DataFrame:
    """Securities from bulk files, named as in their first line that has a
    name; a filing without a cover is kept."""
    folder = scratch(spark)
    info, cover, _ = _bulk(spark, d, folder)
    rows = H.original_only(H.numeric_positions(H.common_stock(info)).withColumnRenamed("CUSIP", "cusip"), H.cover_flags(cover, "_pos"), keep_unknown=True)
    return taken(H.roll_up(rows, ["cusip"], "ACCESSION_NUMBER").join(H.first_issuer(rows, ["cusip"], "_pos"), "cusip", "left"), folder)


@query("""
SELECT 'Brand ' || p_brand AS issuer, p_partkey::VARCHAR AS cusip, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_retailprice * 1000 END AS value, p_size::DOUBLE AS shares, CASE WHEN p_partkey % 7 = 0 THEN 'Put' ELSE '' END AS put_call FROM part
""")
def information_tables(spark: SparkSession, d: str) -> DataFrame:
    """Positions of XML files with name spaces; a blank number is 0."""
    value = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_retailprice").cast("string"))
    put = F.when(F.col("p_partkey") % 7 == 0, "<n:putCall> Put </n:putCall>").otherwise("")
    one = F.concat(
        F.lit("<n:infoTable><n:nameOfIssuer>Brand "), "p_brand", F.lit("</n:nameOfIssuer><n:cusip> "), F.col("p_partkey").cast("string"), F.lit("</n:cusip><n:value>"), value,
        F.lit("</n:value><n:shrsOrPrnAmt><n:sshPrnamt>"), F.col("p_size").cast("string"), F.lit("</n:sshPrnamt></n:shrsOrPrnAmt>"), put, F.lit("</n:infoTable>"),
    )
    docs = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(one), "").alias("_x"))
    folder = scratch(spark)
    docs.select(F.concat(F.lit('<n:informationTable xmlns:n="urn:x">'), "_x", F.lit("</n:informationTable>")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return taken(S.information_table(spark, folder, "2022-12-31"), folder)


@query("""
SELECT c_custkey AS filing, CASE WHEN c_custkey % 4 = 0 THEN 'form.XML' ELSE 'table.xml' END AS name FROM customer WHERE c_custkey % 5 <> 0
""")
def information_table_files(spark: SparkSession, d: str) -> DataFrame:
    """The file of each filing that holds the table, if there is one."""
    k = F.col("c_custkey")
    body = F.when(k % 5 != 0, F.lit("<x:infoTable/>")).otherwise("<other/>")
    files = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), c.alias("content")) for i, (n, c) in enumerate([
        ("primary_doc.xml", F.lit("<infoTable/>")), ("notes.txt", F.lit("infoTable")), ("form.XML", F.when(k % 4 == 0, body).otherwise("<cover/>")), ("table.xml", body), ("late.xml", body),
    ])))
    return S.information_table_file(table(spark, d, "customer").select(k.alias("filing"), F.inline(files)))


#: Filings of a file of lists, about.
_LISTED = 100_000


def _filing_lists(orders: DataFrame, folder: str, listed: int) -> None:
    """Orders as filing lists, newest first, of their customers: JSON arrays of
    as many companies as have about ``listed`` filings, one a file, so that a
    file doesn't grow with the table."""
    files = max(1, -(-orders.count() // listed))
    key = F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    cells = F.struct(-F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), "o_orderkey", F.concat(F.lit("0-"), key).alias("a"), F.when(F.col("o_orderstatus") == "O", "4").otherwise("8-K").alias("f"), day.alias("d"))
    lists = orders.groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.array_sort(F.collect_list(cells)).alias("_l"))
    recent = F.struct(*(F.col(f"_l.{c}").alias(n) for c, n in (("a", "accessionNumber"), ("f", "form"), ("d", "filingDate"), ("a", "primaryDocument"), ("d", "reportDate"))))
    docs = lists.select(F.pmod(F.xxhash64("cik"), F.lit(files)).alias("_file"), F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("v"))
    whole = docs.groupBy("_file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("v"), ","), F.lit("]")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(folder)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey AS cik, '0-' || o_orderkey AS accession, strftime(o_orderdate, '%Y-%m-%d') AS date FROM r WHERE n = 1
""")
def latest_filing(spark: SparkSession, d: str) -> DataFrame:
    """Each company's newest filing of a form, through JSON lists."""
    folder = scratch(spark)
    _filing_lists(table(spark, d, "orders"), folder, _LISTED)
    return taken(S.latest_filing(J.submissions(spark, folder), "4").select("cik", "accession", "date"), folder)


@query("""
SELECT 's' || s_suppkey AS accession, CASE WHEN s_suppkey % 5 = 0 THEN '?' ELSE s_name END AS owner, s_suppkey % 5 = 0 AS malformed, s_suppkey % 5 <> 0 AS notes, s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 AS flag,
  CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS lots FROM supplier
""")
def malformed_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms that can't be read stay as rows; the older readings of a plan."""
    k = F.col("s_suppkey")
    xml = F.format_string(_FORM, F.col("s_name"), F.when(k % 3 == 0, "true").otherwise("0"), F.lit("S"), F.lit(10).cast("long"))
    forms = table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("accession"), F.when(k % 5 == 0, "<ownershipDocument><broken").otherwise(xml).alias("xml"))
    full, ascii_, bare = (S.ownership(forms, **o) for o in ({}, {"en_dash": False}, {"footnotes": False}))
    other = lambda df, name: df.select("accession", F.col("has_plan").alias(name))
    return full.join(other(bare, "flag"), "accession").join(other(ascii_, "plain"), "accession").where("plain = flag").select("accession", "owner", "malformed", F.col("has_plan").alias("notes"), "flag", F.size("lots").alias("lots"))


@query("""
SELECT r_regionkey::BIGINT AS region, r_name AS name, r_regionkey % 2 = 0 AS zipped FROM region WHERE r_regionkey <> 3
""")
def landed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents landed through a throttled opener that fails at first, and
    read from where they are; what isn't there doesn't stop the rest."""
    rows = {f"r{r.r_regionkey}": r.asDict() for r in table(spark, d, "region").collect()}
    tried: dict[str, int] = {}

    def opener(url: str) -> bytes:
        tried[url] = tried.get(url, 0) + 1
        if url == "r3":
            raise HTTPError(url, 404, "gone", None, None)
        if tried[url] < 3:
            raise OSError("reset")
        raw = json.dumps({"region": rows[url]["r_regionkey"], "name": rows[url]["r_name"], "zipped": rows[url]["r_regionkey"] % 2 == 0}).encode()
        return gzip.compress(raw) if rows[url]["r_regionkey"] % 2 == 0 else raw

    folder = scratch(spark)
    local = folder.removeprefix("file:")
    throttle = L.Throttle(0.001)
    failed = L.land_each(sorted(rows), lambda k: L.fetch_json(k, opener, throttle, pause=lambda s: None), local)
    again = L.land_each(sorted(rows), lambda k: L.fetch_json(k, opener, throttle, tries=1, pause=lambda s: None), local)
    if list(failed) != ["r3"] or list(again) != ["r3"] or any(n != 3 for u, n in tried.items() if u != "r3") or tried["r3"] != 2:
        raise AssertionError(f"{failed} {again} {tried}")
    return taken(S.read_json(spark, folder, "region long, name string, zipped boolean").where("region IS NOT NULL"), folder)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey < 20 LIMIT 4")
def configured(spark: SparkSession, d: str) -> DataFrame:
    """A selection whose settings come from a JSON file over defaults."""
    folder = scratch(spark)
    defaults = {"region": 0, "rows": {"limit": 4, "below": 5}}
    if logs.config(f"{folder.removeprefix('file:')}/none.json", defaults) != defaults:
        raise AssertionError("defaults")
    L.cached(f"{folder.removeprefix('file:')}/c.json", lambda: {"region": 2, "rows": {"below": 20}})
    c = logs.config(f"{folder.removeprefix('file:')}/c.json", defaults)
    found = table(spark, d, "nation").where((F.col("n_regionkey") == c["region"]) & (F.col("n_nationkey") < c["rows"]["below"])).orderBy("n_nationkey").limit(c["rows"]["limit"])
    return taken(found.select("n_nationkey", "n_name"), folder)


# News

_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("""
WITH b AS (
  SELECT 'benzinga' AS source, 'bz:' || event_id AS uid, ['U' || (user_id % 50)] AS tickers, event_type AS title, substring(props, 1, 500) AS summary, '' AS url, epoch(date_trunc('second', ts))::BIGINT AS published
  FROM events WHERE user_id % 50 IN (1, 7, 13)),
k AS (SELECT p_partkey AS n, 'P' || p_partkey AS ticker, string_split(p_name, ' ') AS ws FROM part WHERE p_partkey < 20),
f AS (
  SELECT 'finnhub' AS source, 'fh:' || doc_id AS uid, [ticker] AS tickers, 'About ' || p_name AS title, '' AS summary, 'http://n/' || doc_id AS url, doc_id + 5 AS published
  FROM documents JOIN k ON n = doc_id % 20 JOIN part ON p_partkey = doc_id * 7 % 23 WHERE contains('about ' || p_name, ws[1]) OR contains('about ' || p_name, ws[2])),
e AS (
  SELECT 'sec_8k' AS source, '8k:0-' || o_orderkey AS uid, ['C' || o_custkey] AS tickers, 'C' || o_custkey || ' filed 8-K (material event)' AS title, 'Current report: official disclosure of a material event.' AS summary,
    'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/0' || o_orderkey || '/f.htm' AS url, epoch(date_trunc('day', o_orderdate))::BIGINT AS published FROM orders WHERE o_custkey < 50 AND o_orderstatus = 'P')
SELECT source, uid, array_to_string(tickers, ',') AS tickers, title, summary, url, published FROM (SELECT * FROM b UNION ALL SELECT * FROM f UNION ALL SELECT * FROM e)
""")
def feeds(spark: SparkSession, d: str) -> DataFrame:
    """The three kinds of feed in one shape, each read by itself; one that isn't
    there is left out."""

    def general() -> DataFrame:
        tag = lambda c: F.struct(c.alias("name"))
        stamp = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
        u = F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))
        raw = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit(" "), "event_type").alias("title"), F.col("props").alias("teaser"), F.lit(None).cast("string").alias("url"), stamp.alias("created"), F.array(tag(u), tag(F.lit("XX")), tag(u)).alias("stocks"))
        return W.tagged_feed(raw, ["U13", "U1", "U7"])

    def companies() -> DataFrame:
        part = table(spark, d, "part")
        known = part.where("p_partkey < 20").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.concat("p_name", F.lit(", Inc.")).alias("name"))
        docs = table(spark, d, "documents").join(part.select(F.col("p_partkey").alias("_k"), "p_name"), F.col("doc_id") * 7 % 23 == F.col("_k"))
        raw = docs.select(
            F.concat(F.lit("P"), (F.col("doc_id") % 20).cast("string")).alias("ticker"), F.col("doc_id").alias("id"), F.concat(F.lit("About "), "p_name").alias("headline"), F.lit(None).cast("string").alias("summary"),
            F.concat(F.lit("http://n/"), F.col("doc_id").cast("string")).alias("url"), (F.col("doc_id") + 5).alias("datetime"),
        )
        return W.company_feed(raw, known)

    def events() -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        filed = table(spark, d, "orders").where("o_orderstatus = 'P'").select(
            F.col("o_custkey").alias("cik"), F.concat(F.lit("0-"), key).alias("accession"), F.lit("8-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.concat_ws("/", F.lit(S.ARCHIVE), F.col("o_custkey").cast("string"), F.concat(F.lit("0"), key), F.lit("f.htm")).alias("view_url"),
        )
        who = table(spark, d, "customer").where("c_custkey < 50").select(F.col("c_custkey").alias("cik"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"))
        return W.event_filings(filed, who)

    out, bad = W.all_sources({"general": general, "companies": companies, "events": events, "none": lambda: spark.read.parquet(f"{d}/no-such-table")}, eager=True)
    if list(bad) != ["none"]:
        raise AssertionError(bad)
    return out.withColumn("tickers", F.array_join("tickers", ","))


@N.provider("arithmetic")
def _arithmetic():
    """A judge by numbers: what ends on 3 it leaves out."""
    return lambda batch: [
        {"n": r["n"], "relevant": r["pos"] % 7 != 0, "materiality": int(r["pos"] * 37 % 100), "direction": "up", "why": 'a < b & "c"', "event": f"{r['lang']} {r['pos'] % 50}"} for r in batch if r["pos"] % 10 != 3
    ]


_NOW = 1_700_000_000
_JUDGED = f"""
i AS (SELECT doc_id AS pos, 'd:' || doc_id AS uid, source, substring(text, 1, 40) AS title, lang, CASE WHEN doc_id % 9 <> 0 THEN {_NOW} - doc_id * doc_id * 11 END AS published FROM documents),
k AS (SELECT *, coalesce(nullif({_NORM.format("title")}, ''), uid) AS key FROM i),
d AS (SELECT key, min(pos) AS pos, arg_min(title, pos) AS title, arg_min(lang, pos) AS lang, arg_min(published, pos) AS published, arg_min(published IS NULL, pos) AS undated, list_distinct(list(source)) AS tickers FROM k GROUP BY 1),
v AS (SELECT *, (pos * 37 % 100)::INT AS m, pos % 7 <> 0 AS relevant, {_NORM.format("lang || ' ' || (pos % 50)")} AS event_key FROM d WHERE pos % 10 <> 3),
r AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY m DESC, len(tickers) DESC, pos) AS n, count(*) OVER (PARTITION BY event_key) AS dup_count FROM v),
t AS (SELECT event_key, string_agg(DISTINCT x, ',' ORDER BY x) AS tickers FROM (SELECT event_key, unnest(tickers) AS x FROM v) GROUP BY 1),
ev AS (SELECT r.* EXCLUDE (tickers, published), t.tickers, CASE WHEN NOT undated THEN {_NOW} - pos * pos * 11 END AS published FROM r JOIN t USING (event_key) WHERE n = 1 AND relevant AND m >= 60)
"""
_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("pos"), F.concat(F.lit("d:"), k.cast("string")).alias("uid"), F.array("source").alias("tickers"), F.substring("text", 1, 40).alias("title"), "lang", F.lit("s").alias("source"),
        F.when(k % 2 == 0, F.concat(F.lit("http://x/"), k.cast("string"))).alias("url"), F.when(k % 9 != 0, F.lit(_NOW) - k * k * 11).alias("published"),
    )


@query(f"""
WITH {_JUDGED},
a AS (SELECT *, ({_NOW} - published) / 60 AS minutes, {_ESCAPE.format("title")} AS safe FROM ev)
SELECT event_key, pos, dup_count,
  CASE WHEN m >= 70 THEN '🔴' ELSE '🟡' END || ' <b>' || tickers || '</b> · ' || m || ' · up' || CASE WHEN dup_count > 1 THEN ' · ' || dup_count || 'x' ELSE '' END || chr(10) ||
  CASE WHEN pos % 2 = 0 THEN '<a href="http://x/' || pos || '">' || safe || '</a>' || chr(10) WHEN safe <> '' THEN safe || chr(10) ELSE '' END || 'a &lt; b &amp; &quot;c&quot;' || chr(10) || 's' ||
  CASE WHEN published IS NULL THEN '' WHEN minutes < 1 THEN ' · just now' WHEN minutes < 60 THEN ' · ' || floor(minutes)::BIGINT || ' min ago' WHEN minutes < 1440 THEN ' · ' || round_even(minutes / 60, 0)::BIGINT || ' h ago'
    ELSE ' · ' || round_even(minutes / 60 / 24, 0)::BIGINT || ' d ago' END AS message
FROM a
""")
def news_messages(spark: SparkSession, d: str) -> DataFrame:
    """Items judged in batches, as events, and the text of what is pushed."""
    events = streams.review(_items(spark, d), "arithmetic", 60)
    return N.message(events, F.lit(_NOW)).select("event_key", "pos", "dup_count", "message")


_SHARES = "CASE WHEN s_suppkey % 3 = 0 THEN 5000000 ELSE 10 END"


@query(f"""
SELECT 's' || s_suppkey AS key, 'T' AS ticker, 'HIGH' AS tier, CASE WHEN s_suppkey % 2 = 0 THEN 'open_market_buy' ELSE 'large_plan_sale' END AS reason,
  '<b>T</b> ' || CASE WHEN s_suppkey % 2 = 0 THEN 'open_market_buy' ELSE 'large_plan_sale' END || chr(10) || s_name || ' &amp; Co · Director/CFO' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'bought ' ELSE 'sold ' END ||
  CASE WHEN s_suppkey % 3 = 0 THEN '5,000,000 shares @ $10.50 = $52.50M' ELSE '10 shares @ $10.50 = $105' END || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '7 left after this filing' || chr(10) END ||
  'traded 2026-01-05 · filed 2026-01-06 · 10b5-1: yes' || chr(10) || 'http://v' AS message
FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0
""")
def insider_messages(spark: SparkSession, d: str) -> DataFrame:
    """The text of each filing whose tier is pushed."""
    k = F.col("s_suppkey")
    xml = F.format_string(_FORM, F.concat("s_name", F.lit(" &amp; Co")), F.lit("0"), F.when(k % 2 == 0, "P").otherwise("S"), F.when(k % 3 == 0, 5_000_000).otherwise(10).cast("long"))
    forms = table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("accession"), F.lit("T").alias("ticker"), F.lit("2026-01-06").alias("date"), F.lit("http://v").alias("view_url"), xml.alias("xml"))
    return J.insider_alerts(forms)


@query("""
WITH p AS (
  SELECT strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_type = 'purchase' THEN 'insider' ELSE 'news' END AS kind, CASE WHEN event_type <> 'purchase' THEN floor(value)::INT END AS score, event_type || ' ' || event_id AS detail
  FROM events WHERE user_id = 7),
a AS (SELECT *, row_number() OVER (ORDER BY date DESC, kind, score DESC, detail) AS n FROM p),
f AS (SELECT count(*) AS rows, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS net FROM events WHERE user_id = 7)
SELECT '# U7' || chr(10) || chr(10) || 'Watchlist: yes' || chr(10) || chr(10) || '## Alerts' || chr(10) ||
  (SELECT string_agg('  ' || date || '  [' || kind || ']' || coalesce(' m=' || score, '') || '  ' || detail, chr(10) ORDER BY n) FROM a WHERE n <= 12) || chr(10) || chr(10) || '## Institutional flow' || chr(10) ||
  (SELECT '  net ' || CASE WHEN net >= 0 THEN '+' ELSE '' END || format('{:,}', round_even(net, 0)::BIGINT) || ' over ' || rows || ' rows' FROM f) || chr(10) || chr(10) || '## Valuation' || chr(10) || '  pe_ttm: 12.5' AS report
""")
def context_report(spark: SparkSession, d: str) -> DataFrame:
    """What is known about one ticker, as text."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    mine = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "purchase", "insider").otherwise("news")
    pushes = e.select(F.array(mine).alias("tickers"), kind.alias("kind"), F.when(kind == "news", F.floor("value").cast("int")).alias("score"), "date", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("detail"))
    companies = e.where("user_id < 20").select(mine.alias("ticker"), F.concat(F.lit("Company "), mine, F.lit(" Inc.")).alias("name")).distinct()
    flows = e.select(F.upper(F.concat(F.lit("Company "), mine)).alias("issuer"), F.col("value").cast("decimal(18,2)").cast("string").alias("net_flow")).where("issuer = 'COMPANY U7'")
    folder = scratch(spark)
    K.write_report(spark.createDataFrame([("U7", 12.5, None), ("U8", 1.0, 2.0)], "ticker string, pe_ttm double, pb double"), folder)
    worth = logs.read_csv_or_none(spark, folder)
    if logs.read_csv_or_none(spark, f"{folder}-none") is not None:
        raise AssertionError("a missing file has no table")
    known = C.context("u7", companies, pushes, C.institutional_flow(flows, companies), worth)
    return spark.createDataFrame([(C.render(known),)], "report string")


# Streams


class _Unsteady(K.MemoryNotifier):
    """Keeps messages but those of every third key."""

    def send(self, message: str) -> bool:
        super().send(message)
        return int(message.rsplit(" ", 1)[1]) % 3 != 0


@query("""
SELECT '[push:' || CASE WHEN event_id % 3 = 0 THEN 'FAIL' ELSE 'ok' END || '] ' || event_type || ' line ' || event_id AS line, 2 AS copies FROM events WHERE event_id < 300
""")
def pushed_log(spark: SparkSession, d: str) -> DataFrame:
    """Pushes of a stream and their log, failed ones marked; a second run with
    the same checkpoint pushes nothing again."""
    folder = scratch(spark)
    K.register_notifier("unsteady", _Unsteady)
    notifier = K.build_notifier("unsteady")
    e = table(spark, d, "events").where("event_id < 300")
    rows = e.select(F.col("event_id").cast("string").alias("key"), F.concat("event_type", F.lit("\nline "), F.col("event_id").cast("string")).alias("message"))
    rows.write.parquet(f"{folder}/in")
    for _ in range(2):
        streams.push_events(streams.stream(spark, f"{folder}/in", "key string, message string", 100), notifier, f"{folder}/checkpoint", f"{folder}/log")
    sent = spark.createDataFrame([(m.replace("\n", " "),) for m in notifier.messages], "message string").withColumn("_n", F.lit(1))
    line = F.regexp_extract("value", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}  (.*)$", 1)
    logged = spark.read.text(f"{folder}/log").select(line.alias("line"), F.regexp_extract(line, r"\] (.*)$", 1).alias("message"), F.lit(1).alias("_m"))
    return taken(logged.join(sent, "message").groupBy("line").agg(F.sum(F.col("_n") + F.col("_m")).cast("int").alias("copies")), folder)


@query("""
WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS date, epoch(date_trunc('day', ts))::BIGINT + 86400 AS now FROM events WHERE user_id < 200),
p AS (SELECT *, max(date) OVER (PARTITION BY user_id ORDER BY now RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e)
SELECT user_id AS cik, 'a' || event_id AS accession, date, now FROM p WHERE (mark IS NULL OR date >= mark) AND date > '2024-01-03'
""")
def seeded_watermark(spark: SparkSession, d: str) -> DataFrame:
    """New filings after a silent first run: the first days only fill the
    state."""
    day = F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))) + 86_400
    date = F.date_format("ts", "yyyy-MM-dd")
    polls = table(spark, d, "events").where("user_id < 200").select(
        F.col("user_id").alias("cik"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("accession"), date.alias("date"), F.col("event_id").alias("pos"), (date <= "2024-01-03").alias("seed"), day.alias("now")
    )
    return streams.replay(polls, P.new_filings, "now", parts=2)


@query("SELECT DISTINCT user_id || '/' || event_type AS uid FROM events WHERE user_id < 300")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Ids given out once, however often they come."""
    e = table(spark, d, "events").where("user_id < 300").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("uid"), F.col("ts").cast("timestamp").alias("ts"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("now"))
    return streams.replay(e, lambda s: P.first_seen(s, "100 days"), "now", parts=2).select("uid")
