"""Fiscal calendar, formulas, rounding and text."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import fiscal
from quillmark.functions import text as X
from quillmark.functions.formula import FormulaError, layers, parse, with_metrics
from quillmark.functions.rounding import py_round


def rule(end: date, m: int, d: int) -> tuple[int, int]:
    """The fiscal label, stated on its own."""

    def close(y):
        try:
            return date(y, m, d)
        except ValueError:
            return date(y, m, 28)

    fy = end.year if end <= close(end.year) + timedelta(days=21) else end.year + 1
    return fy, min(4, max(1, round((end - close(fy - 1)).days / 91.25)))


@pytest.mark.parametrize(("end", "fye", "expected"), [("2025-01-26", "01-31", (2025, 4)), ("2025-02-03", "01-30", (2025, 4)), ("2025-03-01", "01-30", (2026, 1))])
def test_fiscal_fixtures(spark, end, fye, expected):
    m, d = map(int, fye.split("-"))
    r = spark.range(1).select(fiscal.fiscal_year(F.lit(end).cast("date"), F.lit(m), F.lit(d)), fiscal.fiscal_quarter(F.lit(end).cast("date"), F.lit(m), F.lit(d))).first()
    assert tuple(r) == expected == rule(date.fromisoformat(end), m, d)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.dates(date(1990, 1, 1), date(2060, 1, 1)), st.sampled_from([(1, 31), (2, 28), (2, 29), (6, 30), (9, 27), (12, 31)])), min_size=40, max_size=60))
def test_fiscal_label_follows_the_rule(spark, cases):
    rows = [(e, m, d, *rule(e, m, d)) for e, (m, d) in cases]
    df = spark.createDataFrame(rows, "e date, m int, d int, fy int, q int")
    bad = df.where((fiscal.fiscal_year(F.col("e"), F.col("m"), F.col("d")) != F.col("fy")) | (fiscal.fiscal_quarter(F.col("e"), F.col("m"), F.col("d")) != F.col("q")))
    assert bad.collect() == []


@pytest.mark.parametrize(("days", "kind"), [(79, None), (80, "Q"), (100, "Q"), (101, None), (299, None), (300, "FY"), (400, "FY"), (401, None)])
def test_spans(spark, days, kind):
    end = date(2025, 6, 30)
    got = spark.range(1).select(fiscal.duration_period(F.lit(end - timedelta(days=days)), F.lit(end), F.lit(12), F.lit(31))).first()[0]
    assert (got and got[0]) == (kind and kind[0])


def test_a_fourth_quarter_and_a_missing_start_are_left_out(spark):
    end = F.lit(date(2025, 12, 31))
    r = spark.range(1).select(
        fiscal.duration_period(F.lit(date(2025, 10, 1)), end, F.lit(12), F.lit(31)), fiscal.duration_period(F.lit(None).cast("date"), end, F.lit(12), F.lit(31)), fiscal.instant_period(end, F.lit(12), F.lit(31))
    )
    assert tuple(r.first()) == (None, None, "FY")


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (6.0, 3.0, 2.0)], "a double, b double, c double")
    out = with_metrics(df, {"m2": "m1 * 2", "m1": "a + 1", "ratio": "a / b", "miss": "a + c", "none": "a + zz", "x": "y", "y": "x", "neg": "-(a - +b) * 1.5"})
    assert [tuple(r) for r in out.select("m2", "m1", "ratio", "miss", "none", "x", "y", "neg").collect()] == [(4.0, 2.0, None, None, None, None, None, -1.5), (14.0, 7.0, 2.0, 8.0, None, None, None, -4.5)]


@pytest.mark.parametrize("bad", ["a ** 2", "f(a)", "a if b else c", "a.b", "a > b", "'x'", "a +", "True", "[a]"])
def test_formulas_reject_the_rest(bad):
    with pytest.raises(FormulaError):
        parse(bad)


def test_layers():
    assert layers({k: parse(f) for k, f in {"c": "b + a", "a": "1", "b": "a", "p": "q", "q": "p"}.items()}) == [["a"], ["b"], ["c"]]


_FORMULA = st.recursive(
    st.sampled_from(["a", "b", "c"]) | st.integers(0, 9).map(str), lambda s: st.tuples(s, st.sampled_from("+-*/"), s).map(lambda t: f"({t[0]} {t[1]} {t[2]})") | s.map(lambda x: f"-{x}"), max_leaves=8
)


def by_hand(formula: str, names: dict):
    try:
        return float(eval(formula, {}, {k: v for k, v in names.items() if v is not None}))  # noqa: S307 - generated arithmetic
    except (NameError, ZeroDivisionError):
        return None


@settings(max_examples=10, deadline=None)
@given(st.lists(_FORMULA, min_size=5, max_size=10))
def test_formulas_agree_with_python(spark, formulas):
    rows = [(2.0, 3.0, None), (0.0, -1.5, 4.0)]
    out = with_metrics(spark.createDataFrame(rows, "a double, b double, c double"), {f"m{i}": f for i, f in enumerate(formulas)}).collect()
    for r, (a, b, c) in zip(out, rows):
        for i, f in enumerate(formulas):
            want = by_hand(f, {"a": a, "b": b, "c": c})
            assert r[f"m{i}"] == pytest.approx(want, rel=1e-12) if want is not None else r[f"m{i}"] is None


def test_py_round(spark):
    values = [2.675, 0.125, 2.5, -0.04, 1e15 + 0.3, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(py_round(F.col("v"), 2)).collect()]
    assert got == [None if v is None else round(v, 2) for v in values]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_titles_and_keys(spark):
    assert one(spark, X.normal_title(F.lit("  A, B!  É c"))) == "a b c"
    assert one(spark, X.event_key(F.lit("!!"), F.lit("Big News"), F.lit("u1"))) == "big news"
    assert one(spark, X.event_key(F.lit(None).cast("string"), F.lit("?"), F.lit("u1"))) == "u1"


@pytest.mark.parametrize(("name", "words"), [("NVIDIA Corporation", ["nvidia"]), ("Applied Optoelectronics, Inc.", ["applied", "optoelectronics"]), ("The Co", ["the co"]), ("", [])])
def test_name_keywords(spark, name, words):
    assert one(spark, X.name_keywords(F.lit(name))) == words


@pytest.mark.parametrize(("text", "hit"), [("AI at MU.", True), ("must", False), ("micron shines", True), ("M.U", False)])
def test_mentions(spark, text, hit):
    assert one(spark, X.mentions(F.lit(text), F.lit("MU"), F.array(F.lit("micron")))) is hit


def test_ticker_with_a_sign_is_quoted(spark):
    assert one(spark, X.mentions(F.lit("see brkXb"), F.lit("BRK.B"), F.array().cast("array<string>"))) is False
    assert one(spark, X.mentions(F.lit("see brk.b now"), F.lit("BRK.B"), F.array().cast("array<string>"))) is True


@pytest.mark.parametrize(("name", "family"), [("VANGUARD GROUP INC", "Vanguard"), ("Fidelity Mgmt", "Fidelity (FMR)"), ("Acme  Capital Partners", "Acme Capital"), ("BofA Securities", "Bank of America")])
def test_manager_family(spark, name, family):
    assert one(spark, X.manager_family(F.lit(name))) == family


@pytest.mark.parametrize(("name", "fund"), [("SPDR S&P 500 ETF TR", True), ("Some Growth Fund", True), ("APPLE INC", False), ("Fundamental Co", True)])
def test_is_fund(spark, name, fund):
    assert one(spark, X.is_fund(F.lit(name))) is fund


def test_class_token(spark):
    assert one(spark, X.has_class_token(F.lit("CAP STK CL A"), "A")) and one(spark, X.has_class_token(F.lit("Class A"), "A")) and not one(spark, X.has_class_token(F.lit("CLASS AB"), "A"))


@pytest.mark.parametrize(("value", "text"), [(None, "—"), (0.0, "—"), (2.5e9, "$2.50B"), (-3e6, "$-3.00M"), (1500.0, "$1.5K"), (999.0, "$999")])
def test_usd(spark, value, text):
    assert one(spark, X.usd(F.lit(value).cast("double"))) == text


@pytest.mark.parametrize(("ago", "text"), [(None, ""), (30, "just now"), (150, "2 min ago"), (7200, "2 h ago"), (3 * 86400, "3 d ago")])
def test_age(spark, ago, text):
    assert one(spark, X.age_text(F.lit(None if ago is None else 10**9 - ago).cast("long"), F.lit(10**9))) == text


def test_plan_sale(spark):
    notes = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    assert one(spark, X.is_plan_sale(F.lit(" true "), notes())) and one(spark, X.is_plan_sale(F.lit(None).cast("string"), notes("a Rule 10B5–1 plan"))) and not one(spark, X.is_plan_sale(F.lit("0"), notes("none")))


def test_dates_and_numbers(spark):
    assert one(spark, X.unix_from_mail_date(F.lit("Tue, 05 Aug 2025 12:00:00 -0400"))) == 1754409600
    assert one(spark, X.unix_from_date(F.lit("2025-08-05"))) == 1754352000
    assert one(spark, X.unix_from_date(F.lit("soon"))) is None
    assert [one(spark, X.to_number(F.lit(t).cast("string"))) for t in ("", " 12 ", "5d", "1_000", "-1.5e3", None)] == [0.0, 12.0, None, None, -1500.0, 0.0]


def test_html(spark):
    assert one(spark, X.html_escape(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#x27;b&#x27;&gt;"
