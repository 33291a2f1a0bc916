"""Whole jobs on small files, and landing."""

from __future__ import annotations

import csv
import gzip
import json
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from quillmark.operators import news as N
from quillmark.plans import jobs as J
from quillmark.sources import landing as L


def report(path):
    with next(path.glob("part-*")).open() as f:
        return list(csv.DictReader(f))


def test_dataset(spark, tmp_path):
    def fact(tag, unit, points):
        return {tag: {"units": {unit: points}}}

    year = lambda y, v: {"start": f"{y}-01-01", "end": f"{y}-12-31", "val": v, "form": "10-K", "accn": str(y)}
    (tmp_path / "f.json").write_text(json.dumps({"cik": 1, "facts": {"us-gaap": fact("Rev", "USD", [year(2024, 8e6), year(2025, 10e6)]) | fact("NI", "USD", [year(2024, 1e6), year(2025, 2e6)])}}))
    (tmp_path / "m.json").write_text(json.dumps({"ticker": "T", "as_of": "2026-01-01", "info": {"currentPrice": "5", "marketCap": "40000000"}}))
    companies = spark.createDataFrame([("T", 1, "12-31", None)], "ticker string, cik long, fiscal_year_end string, xbrl_taxonomy string")
    fields = spark.createDataFrame([(k, k, "income", "USD", "duration", [t], False) for k, t in (("revenue", "Rev"), ("net_income", "NI"))], "key string, label string, statement string, unit string, period_type string, us_gaap_tags array<string>, dimensional boolean")
    formulas = {"net_margin": "net_income / revenue", "growth": "(revenue - revenue_prior_year) / revenue_prior_year"}
    J.build_dataset(spark, str(tmp_path / "f.json"), companies, fields, formulas, str(tmp_path / "out"), str(tmp_path / "m.json"), ["revenue"], ["net_margin", "growth"])
    wide = report(tmp_path / "out" / "wide_annual")
    assert [(r["fiscal_year"], r["revenue"], r["net_margin"], r["growth"]) for r in wide] == [("2024", "8000000.0", "0.125", ""), ("2025", "1.0E7", "0.2", "0.25")]
    assert report(tmp_path / "out" / "snapshot_latest") == [{"ticker": "T", "fiscal_year": "2025", "revenue_m": "10.0", "net_margin_pct": "20.0", "growth_pct": "25.0"}]
    assert report(tmp_path / "out" / "coverage") == [{"field_key": k, "T": "Y"} for k in ("net_income", "revenue")]
    assert report(tmp_path / "out" / "valuation_latest")[0]["pe_ttm"] == "20.0"


def bulk(folder, rows):
    folder.mkdir()
    head = "ACCESSION_NUMBER\tNAMEOFISSUER\tTITLEOFCLASS\tCUSIP\tVALUE\tSSHPRNAMT\tSSHPRNAMTTYPE\tPUTCALL\n"
    (folder / "INFOTABLE.tsv").write_text(head + "".join("\t".join(r) + "\n" for r in rows))
    (folder / "COVERPAGE.tsv").write_text("ACCESSION_NUMBER\tREPORTCALENDARORQUARTER\tISAMENDMENT\tFILINGMANAGER_NAME\na1\tx\tN\tVANGUARD GROUP\na2\tx\tN\tAcme Capital LLC\na3\tx\tY\tOther\n")
    (folder / "SUBMISSION.tsv").write_text("ACCESSION_NUMBER\tFILING_DATE\tSUBMISSIONTYPE\tCIK\tPERIODOFREPORT\na1\tx\t13F-HR\t7\tx\n")


def test_holders_and_flows(spark, tmp_path):
    bulk(tmp_path / "now", [("a1", "NVIDIA CORP", "COM", "n1", "1000", "10", "SH", ""), ("a2", "NVIDIA CORP", "COM", "n1", "500", "5", "SH", ""), ("a3", "NVIDIA CORP", "COM", "n1", "9", "9", "SH", ""), ("a4", "NVIDIA CORP", "COM", "n1", "100", "1", "SH", ""), ("a1", "BIG ETF", "COM", "e1", "900", "9", "SH", "")])
    bulk(tmp_path / "then", [("a1", "NVIDIA CORP", "COM", "n1", "800", "8", "SH", ""), ("a1", "NVIDIA CORP", "COM", "n1", "70", "7", "SH", "Put"), ("a1", "BIG ETF", "COM", "e1", "900", "8", "SH", "")])
    J.build_holders(spark, str(tmp_path / "now"), str(tmp_path / "then"), [("NVDA", "NVIDIA")], str(tmp_path / "out"))
    J.build_flows(spark, str(tmp_path / "now"), str(tmp_path / "then"), str(tmp_path / "out"), floor=100)
    holders = report(tmp_path / "out" / "institutional_holders")
    assert [(r["family"], r["rank"], r["shares"], r["status"]) for r in holders] == [("Vanguard", "1", "10.0", "increased"), ("Acme Capital", "2", "5.0", "NEW")]
    assert report(tmp_path / "out" / "institutional_holders_summary")[0]["total_shares"] == "15.0"
    flows = report(tmp_path / "out" / "market_flows")
    assert [(r["side"], r["issuer"], r["shares"], r["holders"]) for r in flows] == [("BOUGHT", "NVIDIA CORP", "16.0", "3"), ("SOLD", "NVIDIA CORP", "16.0", "3")]


def test_insider_alerts(spark):
    xml = "<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>A &amp; B</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>1000</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    forms = spark.createDataFrame([("a", "T", "2026-01-02", "http://v", xml), ("b", "T", "2026-01-02", "http://v", "<broken")], "accession string, ticker string, date string, view_url string, xml string")
    got = J.insider_alerts(forms).collect()
    assert [r.key for r in got] == ["a"] and got[0].message.split("\n")[1:3] == ["A &amp; B · —", "bought 1,000 shares @ $2.50 = $2.5K"]


def test_news_alerts(spark):
    @N.provider("all-big")
    def make():
        return lambda batch: [{"n": r["n"], "relevant": True, "materiality": 90, "direction": "up", "why": "w", "event": r["title"][:3]} for r in batch]

    rows = [(0, "s", "u1", ["A"], "abc one", "", "", 990), (1, "s", "u2", ["B"], "abc two", "", "", None), (2, "s", "u3", ["C"], "xyz", "", "", 1), (3, "s", "u4", ["D"], "def", "", "", 999)]
    items = spark.createDataFrame(rows, "pos int, source string, uid string, tickers array<string>, title string, summary string, url string, published long")
    got = {r.key: (r.tickers, r.dup_count) for r in J.news_alerts(items, "all-big", 1000, max_age=100).collect()}
    assert got == {"abc": (["A", "B"], 2), "def": (["D"], 1)}
    groups = spark.createDataFrame([(0, 1), (3, 1)], "n int, group int")
    assert [(r.tickers, r.dup_count) for r in J.news_alerts(items, "all-big", 1000, max_age=100, groups=groups).collect()] == [(["A", "B", "D"], 3)]


def test_throttle_and_retries():
    now, slept = [0.0], []
    t = L.Throttle(0.15, lambda: now[0], slept.append)
    t.wait()
    now[0] = 0.1
    t.wait()
    assert slept == [pytest.approx(0.05)]
    calls, pauses = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("reset")
        return gzip.compress(b'{"a": 1}')

    assert L.fetch_json("u", flaky, pause=pauses.append) == {"a": 1} and pauses == [1.0, 2.0]

    def gone(url):
        calls.append(url)
        raise HTTPError(url, 404, "gone", None, None)

    calls.clear()
    with pytest.raises(HTTPError):
        L.fetch_json("u", gone, pause=pauses.append)
    assert len(calls) == 1


def test_store(tmp_path):
    assert L.cached(tmp_path / "x" / "a.json", lambda: [1]) == [1] and L.cached(tmp_path / "x" / "a.json", lambda: [2]) == [1] and L.cached(tmp_path / "x" / "a.json", lambda: [3], refresh=True) == [3]

    def load(k):
        if k == "bad":
            raise OSError("no")
        return k

    assert list(L.land_each(["a", "bad", "c"], load, tmp_path)) == ["bad"] and (tmp_path / "c.json").exists()
