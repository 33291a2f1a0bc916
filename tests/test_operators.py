"""Operators on small frames."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from quillmark.operators import context as C
from quillmark.operators import facts as A
from quillmark.operators import holdings as H
from quillmark.operators import insider as I
from quillmark.operators import metrics as M
from quillmark.operators import news as N
from quillmark.operators import sinks as K
from quillmark.operators import valuation as V
from quillmark.sources import market


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_as_reported(spark):
    s = "k string, fiscal_period string, form string, accn string, pos int, value double"
    df = spark.createDataFrame([("a", "FY", "10-Q", "001", 0, 1.0), ("a", "FY", "10-K", "009", 1, 2.0), ("b", "FY", "10-K", "005", 0, 3.0), ("b", "FY", "10-K", "003", 1, 4.0), ("c", "Q1", "10-Q", "1", 1, 5.0), ("c", "Q1", "10-Q", "1", 0, 6.0)], s)
    assert rows(A.as_reported(df, ["k"]).select("k", "value"), "k") == [("a", 2.0), ("b", 4.0), ("c", 6.0)]


def test_splice_and_provenance(spark):
    df = spark.createDataFrame([("f", 24, 0, "A"), ("f", 24, 1, "B"), ("f", 25, 1, "B")], "field string, fy int, rank int, tag string")
    assert rows(A.spliced(df, ["field", "fy"]).select("fy", "tag"), "fy") == [(24, "A"), (25, "B")]
    assert A.provenance(df, ["field"]).first()["tags"] == "A+B"


def test_trailing_years(spark):
    df = spark.createDataFrame([("t", y, "annual") for y in range(2021, 2026)] + [("t", 2026, "quarterly"), ("u", 1999, "quarterly")], "ticker string, fiscal_year int, period string")
    assert [r[1] for r in rows(A.trailing_years(df), "ticker", "fiscal_year")] == [2023, 2024, 2025, 2026, 1999]


def test_facts_long(spark):
    companies = spark.createDataFrame([("T", 1, "12-31", None), ("I", 2, "12-31", "ifrs-full")], "ticker string, cik long, fiscal_year_end string, xbrl_taxonomy string")
    fields = spark.createDataFrame([("rev", "Revenue", "income", "USD", "duration", ["R1", "R2"], None), ("dim", "D", "x", "USD", "duration", ["R1"], True)], "key string, label string, statement string, unit string, period_type string, us_gaap_tags array<string>, dimensional boolean")
    d = date
    points = [
        (1, "us-gaap", "R1", "USD", 0, 0, d(2024, 1, 1), d(2024, 12, 31), 10.0, "10-K", "b"), (1, "us-gaap", "R1", "USD", 0, 1, d(2024, 1, 1), d(2024, 12, 31), 11.0, "10-K", "a"),
        (1, "us-gaap", "R2", "EUR", 0, 0, d(2025, 1, 1), d(2025, 12, 31), 1.0, "10-K", "c"), (1, "us-gaap", "R2", "USD", 1, 0, d(2025, 1, 1), d(2025, 12, 31), 12.0, "10-K", "c"),
        (1, "us-gaap", "R2", "USD", 1, 1, d(2025, 1, 1), d(2025, 6, 30), 5.0, "10-Q", "c"), (1, "us-gaap", "R2", "USD", 1, 2, d(2025, 1, 1), d(2025, 3, 31), 3.0, "10-Q/A", "c"),
        (2, "us-gaap", "R1", "USD", 0, 0, d(2024, 1, 1), d(2024, 12, 31), 10.0, "10-K", "b"),
    ]
    facts = spark.createDataFrame(points, "cik long, taxonomy string, tag string, unit string, unit_pos int, pos int, start date, end date, value double, form string, accn string")
    assert rows(A.facts_long(facts, fields, companies).select("ticker", "fiscal_year", "fiscal_period", "value", "xbrl_tag"), "fiscal_year") == [("T", 2024, "FY", 11.0, "R1"), ("T", 2025, "FY", 12.0, "R2")]
    assert A.tag_provenance(facts, fields, companies).first()["tags"] == "R1+R2"


def test_coverage(spark):
    pairs = spark.createDataFrame([("f", "A"), ("f", "A"), ("g", "B")], "field_key string, ticker string")
    fields = spark.createDataFrame([("f",), ("g",), ("h",)], "field_key string")
    assert rows(A.coverage_matrix(pairs, fields, ["A", "B"]), "field_key") == [("f", "Y", "-"), ("g", "-", "Y"), ("h", "-", "-")]


def test_derived(spark):
    f = [("T", 2024, "FY", "revenue", 8.0), ("T", 2024, "FY", "cost_of_revenue", 5.0), ("T", 2026, "FY", "revenue", 10.0), ("T", 2025, "FY", "revenue", None)]
    df = spark.createDataFrame(f, "ticker string, fiscal_year int, fiscal_period string, field_key string, value double")
    out = M.derive(df, {"gm": "gross_profit / revenue", "yoy": "revenue - revenue_prior_year", "debt": "short_term_debt + goodwill"}, ["revenue", "cost_of_revenue"])
    got = {(r.fiscal_year, r.field_key): r.value for r in out.collect()}
    assert got == {(2024, "gm"): 0.375, (2024, "yoy"): None, (2024, "debt"): 0.0, (2025, "gm"): None, (2025, "yoy"): None, (2025, "debt"): 0.0, (2026, "gm"): None, (2026, "yoy"): None, (2026, "debt"): 0.0}


def test_fourth_quarter_and_trailing_sum(spark):
    s = "ticker string, fiscal_year int, fiscal_period string, period string, period_end date, value double"
    full = [("T", 2025, "FY", "annual", date(2025, 12, 31), 100.0)] + [("T", 2025, f"Q{i}", "quarterly", date(2025, 3 * i, 28), v) for i, v in ((1, 20.0), (2, 25.0), (3, 30.0))]
    gap = [("U", 2025, "FY", "annual", date(2025, 12, 31), 100.0), ("U", 2025, "Q1", "quarterly", date(2025, 3, 28), 20.0)]
    df = spark.createDataFrame(full + gap, s)
    q = M.quarters_with_fourth(df, ["ticker"])
    assert {(r.ticker, r.fiscal_period): r.value for r in q.collect()} == {("T", "Q1"): 20.0, ("T", "Q2"): 25.0, ("T", "Q3"): 30.0, ("T", "Q4"): 25.0, ("U", "Q1"): 20.0}
    assert rows(M.trailing_sum(q, df.where("period = 'annual'"), ["ticker"]), "ticker") == [("T", 100.0, "ttm_4q"), ("U", 100.0, "latest_fy")]


def test_metrics_replace_facts(spark):
    s = "ticker string, fiscal_year int, fiscal_period string, period string, field_key string, value double"
    facts = spark.createDataFrame([("T", 1, "FY", "annual", "x", 1.0), ("T", 1, "FY", "annual", "y", 2.0)], s)
    assert {r.field_key: r.value for r in M.merged(facts, spark.createDataFrame([("T", 1, "FY", "annual", "x", None)], s)).collect()} == {"x": None, "y": 2.0}


def test_snapshot_takes_the_last_year(spark):
    df = spark.createDataFrame([("T", 2024, 1e6, 0.1), ("T", 2025, 2.5e6, 0.12345), ("U", 2023, None, None)], "ticker string, fiscal_year int, rev double, m double")
    assert rows(M.snapshot(df, ["rev"], ["m"]), "ticker") == [("T", 2025, 2.0, 12.3), ("U", 2023, None, None)]


def test_valuation(spark):
    s = "ticker string, fiscal_year int, fiscal_period string, period string, field_key string, period_end date, value double"
    flow = lambda k, v: ("T", 2025, "FY", "annual", k, date(2025, 12, 31), v)
    facts = spark.createDataFrame([flow("net_income", 10.0), flow("revenue", 100.0), flow("operating_income", 20.0), flow("depreciation_and_amortization", 5.0), flow("long_term_debt", 30.0), flow("cash_and_cash_equivalents", 40.0)], s)
    m = [("T", "2026-01-01", {"currentPrice": "0", "regularMarketPrice": "50", "marketCap": "200"}, (60.0, None, None), [("0y", 2.0, 0.1), ("0y", 4.0, 0.2)], [(1, 2, 3, 4, 5)]), ("U", None, {}, None, None, None)]
    quotes = market.quotes(spark.createDataFrame(m, "ticker string, as_of string, info map<string,string>, price_targets struct<mean:double,high:double,low:double>, earnings_estimate array<struct<period:string,avg:double,growth:double>>, recommendations array<struct<strongBuy:long,buy:long,hold:long,sell:long,strongSell:long>>"))
    out = {r.ticker: r.asDict() for r in V.valuation(spark.createDataFrame([("T",), ("U",), ("W",)], "ticker string"), facts, quotes).collect()}
    t = out["T"]
    assert (t["price"], t["enterprise_value"], t["pe_ttm"], t["ev_ebitda"], t["net_cash"], t["earnings_yield_pct"]) == (50.0, 190.0, 20.0, 7.6, 10.0, 5.0)
    assert (t["fwd_eps_cy"], t["fwd_eps_cy_growth_pct"], t["fwd_pe_consensus"], t["target_upside_pct"], t["rec_hold"]) == (4.0, 20.0, 12.5, 20.0, 3)
    assert out["W"]["pe_ttm"] is None and out["W"]["total_debt"] == 0.0 and len(t) == 42


def test_cover_policy(spark):
    info = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "ACCESSION_NUMBER string, v int")
    cover = spark.createDataFrame([("a", " Fund ", "N"), ("b", "Fund", " true")], "ACCESSION_NUMBER string, FILINGMANAGER_NAME string, ISAMENDMENT string")
    flags = H.cover_flags(cover)
    assert rows(H.original_only(info, flags, False).select("v"), "v") == [(1,)]
    assert rows(H.original_only(info, flags, True).select("v"), "v") == [(1,), (3,)]


def test_common_stock(spark):
    df = spark.createDataFrame([("Put", "SH", 1), (None, "PRN", 2), (" ", " sh", 3), (None, None, 4)], "PUTCALL string, SSHPRNAMTTYPE string, v int")
    assert rows(H.common_stock(df).select("v"), "v") == [(3,), (4,)]


@pytest.mark.parametrize(("now", "before", "status"), [(1.0, 0.0, "NEW"), (2.0, 1.0, "increased"), (1.0, 2.0, "decreased"), (1.0, 1.0, "unchanged")])
def test_status(spark, now, before, status):
    assert spark.range(1).select(H.status(F.lit(now), F.lit(before))).first()[0] == status


@pytest.mark.parametrize(("pct", "flag"), [(150.0, ""), (150.1, "split/IPO?"), (-60.0, ""), (-60.1, "split/IPO?"), (None, "NEW/IPO?")])
def test_flag(spark, pct, flag):
    assert spark.range(1).select(H.flag(F.lit(pct).cast("double"))).first()[0] == flag


def test_flows(spark):
    s = "cusip string, shares double, value double, entities long"
    out = H.market_flows(spark.createDataFrame([("a", 10.0, 100.0, 3), ("b", 0.0, 100.0, 1), ("c", 1.0, 1.0, 1)], s), spark.createDataFrame([("a", 5.0, 1.0, 1), ("z", 1.0, 1.0, 1)], s), ["cusip"], floor=50.0)
    assert rows(out.select("cusip", "holders_chg", "implied_price", "net_flow", "shares_chg_pct", "flag"), "cusip") == [("a", 2, 10.0, 50.0, 100.0, ""), ("b", 1, 0.0, 0.0, None, "NEW/IPO?")]


def test_class_hint(spark):
    info = spark.createDataFrame([("ALPHABET INC", "c1", "CAP STK CL C", "9"), ("ALPHABET INC", "c2", "CAP STK CL A", "5"), ("ALPHABET INC", "c2", "CAP STK CL A", "bad"), ("OTHER", "x", "COM", "1")], "NAMEOFISSUER string, CUSIP string, TITLEOFCLASS string, VALUE string")
    assert H.resolve_classes(info, [("GOOGL", "ALPHABET")], {"GOOGL": "A"}).first()["cusip"] == "C2"
    assert H.resolve_classes(info, [("GOOGL", "ALPHABET")]).first()["cusip"] == "C1"


TIERS = [
    ([("P", 10.0, 100.0), ("S", 1e6, 90.0)], False, "HIGH", "open_market_buy"), ([("S", 1e5, 50.0)], False, "HIGH", "discretionary_sale"), ([("S", 1e5, 50.0)], True, "MEDIUM", "ordinary_sale"),
    ([("S", 1e6, 50.0)], True, "HIGH", "large_plan_sale"), ([("F", 1e6, 50.0)], True, "LOW", "routine"), ([("S", 0.0, 50.0)], True, "LOW", "routine"),
]


@pytest.mark.parametrize(("lots", "plan", "tier", "reason"), TIERS)
def test_tiers(spark, lots, plan, tier, reason):
    df = spark.createDataFrame([("x", [("2026-01-01", c, "D", n, p, None) for c, n, p in lots], plan)], "accession string, lots array<struct<date:string,code:string,acq_disp:string,shares:double,price:double,after:double>>, has_plan boolean")
    r = I.classify(df).first()
    assert (r.tier, r.reason) == (tier, reason)


def test_titles(spark):
    items = spark.createDataFrame([(0, "u1", ["X"], "A, B!"), (1, "u2", ["W"], "a b"), (2, "u3", ["Z"], "??"), (3, "u4", ["Z"], "!!")], "pos int, uid string, tickers array<string>, title string")
    got = {r.uid: (r.tickers, r.uids) for r in N.by_title(items).collect()}
    assert got == {"u1": (["W", "X"], ["u1", "u2"]), "u3": (["Z"], ["u3"]), "u4": (["Z"], ["u4"])}


def test_clusters(spark):
    v = "verdict struct<relevant:boolean,materiality:int,direction:string,why:string,event:string>"
    e = lambda m, ev="E": (True, m, "up", "w", ev)
    items = spark.createDataFrame([(0, "a", ["X"], "t", e(70)), (1, "b", ["X", "Y"], "t", e(70)), (2, "c", ["Z"], "t", e(60)), (3, "d", ["Q"], "t", None)], f"pos int, uid string, tickers array<string>, title string, {v}")
    r = N.by_event(items).collect()
    assert [(x.uid, x.tickers, x.dup_count) for x in r] == [("b", ["X", "Y", "Z"], 3)]
    assert N.worth_pushing(N.by_event(items), 85).count() == 0


def test_judge_in_batches(spark):
    @N.provider("by-length")
    def make():
        def judge(batch):
            if any(r["title"] == "boom" for r in batch):
                raise RuntimeError("down")
            return [{"n": r["n"], "relevant": True, "materiality": len(r["title"]), "direction": "up", "why": "", "event": r["title"]} for r in batch if r["title"] != "skip"]

        return judge

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "skip", "boom", "bbb"])], "pos int, title string").coalesce(1)
    got = {r.title: r.verdict and r.verdict.materiality for r in N.judged(df, "by-length", batch=2).collect()}
    assert got == {"aa": 2, "skip": None, "boom": None, "bbb": None}
    with pytest.raises(ValueError, match="unknown judge"):
        N.find_provider("nobody")


def test_message(spark):
    v = "verdict struct<relevant:boolean,materiality:int,direction:string,why:string,event:string>"
    df = spark.createDataFrame([("s", ["A", "B"], "x < y", "http://u", 10**9 - 120, (True, 90, "up", "", "E"), 2)], f"source string, tickers array<string>, title string, url string, published long, {v}, dup_count long")
    text = N.message(df, F.lit(10**9)).first()["message"]
    assert text.split("\n") == ["\U0001f534 <b>A,B</b> · 90 · up · 2x", '<a href="http://u">x &lt; y</a>', "s · 2 min ago"]


@pytest.mark.parametrize(("a", "b", "same"), [("APPLIED OPTOELECTRONICS INC", "APPLIED MATLS INC", False), ("INTEL CORP", "Intel Corp", True), ("META PLATFORMS INC", "Meta", True), ("THE CO", "The Co", True)])
def test_issuers(spark, a, b, same):
    out = C.issuer_join(spark.createDataFrame([(a,)], "x string"), spark.createDataFrame([(b,)], "y string"), "x", "y")
    assert bool(out.count()) is same


def test_flow_status(spark):
    companies = spark.createDataFrame([("INTC", "Intel Corp"), ("ZZ", "Zed Inc")], "ticker string, name string")
    flows = spark.createDataFrame([("INTEL CORP", "5"), ("INTEL CORP DEL", "bad")], "issuer string, net_flow string")
    assert rows(C.institutional_flow(flows, companies), "ticker") == [("INTC", 5.0, 2, "found"), ("ZZ", None, 0, "absent")]
    assert {r.status for r in C.institutional_flow(None, companies).collect()} == {"missing"}


def test_context(spark):
    companies = spark.createDataFrame([("T", "Tee")], "ticker string, name string")
    pushes = spark.createDataFrame([("2026-01-02", "news", ["T"], 90, "b"), ("2026-01-01", "insider", ["T", "U"], None, "a")], "date string, kind string, tickers array<string>, score int, detail string")
    flow = C.institutional_flow(None, companies)
    known = C.context("t", companies, pushes, flow, None)
    text = C.render(known)
    assert known["on_watchlist"] and [a["detail"] for a in known["alerts"]] == ["b", "a"] and "m=90" in text and "missing" in text
    assert rows(C.scout(pushes, companies, 5).select("ticker", "news", "insider", "best", "headline"), "ticker") == [("T", 1, 1, 90, "b")]


def test_notifiers(spark, tmp_path):
    n = K.build_notifier("memory")
    log = str(tmp_path / "log")
    K.push_sink(n, log)(spark.createDataFrame([("k", "hello")], "key string, message string"), 0)
    assert n.messages == ["hello"] and "[push:ok] hello" in spark.read.text(log).first()[0]
    with pytest.raises(ValueError, match="unknown notifier"):
        K.build_notifier("pigeon")


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "k string, v double")
    K.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    K.write_report(df.orderBy("k"), str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("part-*")).read_text().splitlines() == ["k,v", "a,", "b,1.5"]


def test_naming(spark):
    """The automaton and the join say the same."""
    companies = spark.createDataFrame([("MU", "Micron Technology, Inc."), ("A", "Agilent Technologies"), ("C3", "The Co"), (None, None)], "ticker string, name string")
    said = ["MICRON up", "mu, a_b", "amu", "a!", "An agile team", "technology", None, "", "c3 the co.", "x_mu mu"]
    items = spark.createDataFrame(list(enumerate(said)), "n int, text string")
    got = [sorted((r.n, r.ticker) for r in N.naming(items, companies, "text", limit).collect()) for limit in (100, 0)]
    assert got[0] == got[1] and (0, "MU") in got[0] and (1, "MU") in got[0] and (3, "A") in got[0] and (2, "MU") not in got[0] and (9, "MU") in got[0]
