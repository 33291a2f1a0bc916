"""Readers on small files."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from quillmark.sources import filings as S
from quillmark.sources import logs as L
from quillmark.sources import news


def test_company_facts(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"Rev": {"units": {"USD": [{"start": "2024-01-01", "end": "2024-12-31", "val": 5, "form": "10-K", "accn": "a"}, {"end": "2024-12-31", "val": 6, "form": "10-K", "accn": "b"}]}}}}}))
    got = S.company_facts(spark, str(p)).orderBy("pos").collect()
    assert [(r.cik, r.taxonomy, r.tag, r.unit, r.value, r.start is None) for r in got] == [(7, "us-gaap", "Rev", "USD", 5.0, False), (7, "us-gaap", "Rev", "USD", 6.0, True)]


def test_company_facts_in_pages(spark, tmp_path):
    """Points of a later page follow; a unit without points keeps its place."""
    for page, units in ((0, {"EUR": [{"end": "2024-01-01", "val": 1}, {"end": "2024-01-01", "val": 2}], "USD": []}), (1, {"EUR": [{"end": "2024-01-01", "val": 3}], "USD": [{"end": "2024-01-01", "val": 4}]})):
        (tmp_path / f"{page}.json").write_text(json.dumps({"cik": 7, "page": page, "facts": {"us-gaap": {"Rev": {"units": units}}}}))
    got = S.company_facts(spark, str(tmp_path)).orderBy("unit_pos", "pos").collect()
    assert [(r.unit_pos, r.unit, r.value) for r in got] == [(0, "EUR", 1.0), (0, "EUR", 2.0), (0, "EUR", 3.0), (1, "USD", 4.0)] and len({(r.unit, r.pos) for r in got}) == 4


def test_filing_lists(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"cik": "0000000009", "filings": {"recent": {"accessionNumber": ["1-2", "3-4", "5-6"], "form": ["8-K", "4", "4"], "filingDate": ["2026-01-03", "2026-01-02", "2026-01-01"], "primaryDocument": ["a.htm", "xsl/b.xml", "c.xml"], "reportDate": ["", "", ""]}}}))
    raw = S.read_json(spark, str(p), __import__("quillmark.schemas", fromlist=["x"]).SUBMISSIONS)
    t = S.tracked_filings(raw, ["4", "4/A"]).orderBy("pos").first()
    assert t.view_url.endswith("/data/9/34/xsl/b.xml") and t.xml_url.endswith("/data/9/34/b.xml")
    assert S.latest_filing(raw, "4").first()["accession"] == "3-4"


def test_tsv_in_an_archive(spark, tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("T.tsv", 'A\tB\n1\t"x\nshort\n2\ty\textra\r\n')
    S.unzip(z, tmp_path / "out")
    assert [tuple(r) for r in S.read_tsv(spark, str(tmp_path / "out" / "T.tsv")).orderBy("A").collect()] == [("1", '"x'), ("2", "y")]


def test_information_table(spark, tmp_path):
    p = tmp_path / "i.xml"
    p.write_text('<n:informationTable xmlns:n="u"><n:infoTable><n:nameOfIssuer>X</n:nameOfIssuer><n:cusip>1</n:cusip><n:value>5</n:value><n:shrsOrPrnAmt><n:sshPrnamt>7</n:sshPrnamt></n:shrsOrPrnAmt></n:infoTable><n:infoTable><n:nameOfIssuer>Y</n:nameOfIssuer><n:value> </n:value></n:infoTable></n:informationTable>')
    get = lambda period: [tuple(r) for r in S.information_table(spark, str(p), period).orderBy("issuer").collect()]
    assert get("2022-12-31") == [("X", "1", 5000.0, 7.0, ""), ("Y", "", 0.0, 0.0, "")]
    assert get("2023-03-31")[0][2] == 5.0
    files = spark.createDataFrame([("f", 0, "primary_doc.xml", "infoTable"), ("f", 1, "x.txt", "infoTable"), ("f", 2, "9.XML", "<infoTable>"), ("f", 3, "z.xml", "<infoTable>")], "filing string, pos int, name string, content string")
    assert S.information_table_file(files).first()["name"] == "9.XML"


FORM = """<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName> Doe </rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>true</isOfficer><isTenPercentOwner>1</isTenPercentOwner></reportingOwnerRelationship></reportingOwner>
<footnotes><footnote>sold under a 10b5–1 plan</footnote></footnotes><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2026-01-05</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>x</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_ownership(spark):
    df = spark.createDataFrame([("a", FORM), ("b", "<broken"), ("c", None)], "accession string, xml string")
    got = {r.accession: r for r in S.ownership(df).collect()}
    a = got["a"]
    assert (a.owner, a.roles, a.has_plan, a.malformed) == ("Doe", ["Officer", "10% Owner"], True, False)
    assert [(t.code, t.shares, t.price, t.after) for t in a.lots] == [("S", 100.0, None, None)]
    assert got["b"].owner == "?" and got["b"].lots == [] and got["c"].lots == []
    assert not S.ownership(df, en_dash=False).where("accession = 'a'").first()["has_plan"]
    assert not S.ownership(df, footnotes=False).where("accession = 'a'").first()["has_plan"]


def test_feeds(spark):
    raw = spark.createDataFrame([(1, " T ", None, "u", "Tue, 05 Aug 2025 12:00:00 +0000", [("mu",), ("XX",), ("NVDA",)]), (2, "t", "", "", "junk", [("ZZ",)])], "id int, title string, teaser string, url string, created string, stocks array<struct<name:string>>")
    r = news.tagged_feed(raw, ["NVDA", "MU"]).collect()
    assert [(x.uid, x.tickers, x.title, x.published) for x in r] == [("bz:1", ["MU", "NVDA"], "T", 1754395200)]
    companies = spark.createDataFrame([(1, "MU", "Micron Technology, Inc.")], "cik long, ticker string, name string")
    raw = spark.createDataFrame([("MU", 1, "Micron up", None, "u", 5), ("MU", 2, "Nothing", "here", "u", 5)], "ticker string, id int, headline string, summary string, url string, datetime long")
    assert [x.uid for x in news.company_feed(raw, companies).collect()] == ["fh:1"]
    eight = spark.createDataFrame([(1, "9-9", "8-K", "2026-01-02", "v")], "cik long, accession string, form string, date string, view_url string")
    x = news.event_filings(eight, companies).first()
    assert (x.uid, x.title, x.published) == ("8k:9-9", "MU filed 8-K (material event)", 1767312000)


def test_one_source_fails(spark):
    ok = lambda: spark.range(1).select(*(F.lit(None).cast("string").alias(c) for c in ("source", "uid", "tickers", "title", "summary", "url", "published")))
    out, bad = news.all_sources({"a": ok, "b": lambda: spark.read.parquet("/no/such/place"), "c": ok})
    assert out.count() == 2 and list(bad) == ["b"]
    late = lambda: ok().withColumn("url", F.raise_error(F.lit("closed")))
    out, bad = news.all_sources({"a": ok, "late": late, "b": lambda: spark.read.parquet("/no/such/place"), "c": ok}, eager=True)
    assert out.count() == 2 and list(bad) == ["late", "b"]


def test_logs(spark, tmp_path):
    lines = ["2026-01-02 10:00:00  [push:ok] mu,nvda m=90 (2x) Big thing", "2026-01-02 10:00:00  [push:FAIL] MU m=90 x", "no stamp [push:ok] MU x", "2026-01-03T10:00:00 [push:ok] MU HIGH open_market_buy Doe"]
    p = tmp_path / "l.log"
    p.write_text("\n".join(lines))
    got = [tuple(r) for r in L.read_pushes(spark, str(p), "news").orderBy("date").collect()]
    assert got == [("2026-01-02", "news", ["MU", "NVDA"], 90, "Big thing"), ("2026-01-03", "news", ["MU"], None, "HIGH open_market_buy Doe")]
    assert L.read_pushes(spark, str(tmp_path / "none"), "news").count() == 0
    assert L.read_csv_or_none(spark, str(tmp_path / "none")) is None


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"a": {"x": 2}}')
    assert L.config(p, {"a": {"x": 1, "y": 1}, "b": 3}) == {"a": {"x": 2, "y": 1}, "b": 3} and L.config(tmp_path / "no", {"b": 3}) == {"b": 3}
