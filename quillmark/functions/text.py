"""Text functions: titles, names, mentions and display forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms and filler in issuer names, in alphabetical order.
ISSUER_NOISE = tuple("A AG B C CLASS CO COM COMPANY CORP CORPORATION DEL GROUP HOLDING HOLDINGS INC INCORPORATED LIMITED LTD NEW NV PLC SA THE".split())

_LEGAL = "|".join(sorted(["ag", "co", "company", "corp", "corporation", "group", "holdings?", "inc", "llc", "ltd", "nv", "plc", "platforms?", "sa", "se", "technologies", "technology", "the"], key=len, reverse=True))
#: Words that carry no identity in a company's name.
NAME_NOISE = rf"(?i)\b({_LEGAL})\b|[.,]|'s"

#: Manager families: when their names are looked for, and what those are.
_FAMILIES = {
    "AllianceBernstein": (32, "ALLIANCEBERNSTEIN"),
    "Ameriprise": (22, "AMERIPRISE"),
    "Bank of America": (8, "MERRILL|BANK OF AMERICA|BOFA"),
    "Barclays": (20, "BARCLAYS"),
    "BlackRock": (1, "BLACKROCK"),
    "BNY Mellon": (15, "MELLON|BANK OF NEW YORK"),
    "Capital Group": (23, "CAPITAL RESEARCH|CAPITAL WORLD|CAPITAL INTERNATIONAL|CAPITAL GUARDIAN"),
    "Charles Schwab": (13, "SCHWAB"),
    "Citadel": (16, "CITADEL"),
    "Citigroup": (17, "CITIGROUP|CITIBANK"),
    "Credit Suisse": (21, "CREDIT SUISSE"),
    "D.E. Shaw": (27, "D. E. SHAW|D.E. SHAW"),
    "Deutsche Bank": (19, "DEUTSCHE"),
    "Dimensional": (14, "DIMENSIONAL"),
    "Fidelity (FMR)": (4, "FMR|FIDELITY"),
    "Franklin": (34, "FRANKLIN RES"),
    "Geode": (3, "GEODE"),
    "Goldman Sachs": (6, "GOLDMAN SACHS"),
    "Invesco": (12, "INVESCO"),
    "Jane Street": (24, "JANE STREET"),
    "JPMorgan": (7, "JPMORGAN|JP MORGAN|J P MORGAN"),
    "Legal & General": (33, "LEGAL & GENERAL"),
    "Millennium": (28, "MILLENNIUM"),
    "Morgan Stanley": (5, "MORGAN STANLEY"),
    "Norges (Norway)": (31, "NORGES"),
    "Northern Trust": (10, "NORTHERN TRUST"),
    "Point72": (29, "POINT72"),
    "Renaissance": (30, "RENAISSANCE TECH"),
    "State Street": (2, "STATE STREET"),
    "Susquehanna": (25, "SUSQUEHANNA"),
    "T. Rowe Price": (11, "T ROWE|ROWE PRICE"),
    "Two Sigma": (26, "TWO SIGMA"),
    "UBS": (18, "UBS "),
    "Vanguard": (0, "VANGUARD"),
    "Wells Fargo": (9, "WELLS FARGO"),
}
FAMILIES: dict[str, str] = {name: parts for name, (_, parts) in sorted(_FAMILIES.items(), key=lambda f: f[1][0])}

#: Parts of a padded upper-case issuer name that mark a fund.
FUND_MARKS = tuple(sorted([
    " FDS", " FUND", " TR ", "DIMENSIONAL", "DIREXION", "ETF", "FIRST TR", "GLOBAL X", "INDEX FD", "INVESCO QQQ", "ISHARES", "MONEY MARKET",
    "POWERSHARES", "PROSHARES", "SCHWAB STRATEGIC", "SELECT SECTOR", "SPDR", "TRUST II", "VANGUARD ", "WISDOMTREE",
]))


def normal_title(title: Column) -> Column:
    """Lower case ASCII letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def event_key(event: Column, title: Column, uid: Column) -> Column:
    """The event's label, else its title, else its id."""
    return F.coalesce(blank_to_null(normal_title(event)), blank_to_null(normal_title(title)), uid)


def name_keywords(name: Column) -> Column:
    """The first two telling words of a company's name, in lower case; the
    whole name where there is none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, NAME_NOISE, " ")), r"\s+", " ")), " ")
    long = F.slice(F.filter(words, lambda w: F.length(w) >= 3), 1, 2)
    return F.when(F.size(long) > 0, long).when(name != "", F.array(F.lower(name))).otherwise(F.array().cast("array<string>"))


def quote(text: Column) -> Column:
    """``text`` with signs that mean something in a pattern escaped."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def mentions(text: Column, ticker: Column, keywords: Column, lowered: bool = False) -> Column:
    """Whether the ticker stands in the text as a word, or any keyword as a part.

    The cheap tests come first: the pattern is only tried where the ticker is
    in the text at all.  ``lowered`` says that the text is in lower case.
    """
    low = text if lowered else F.lower(text)
    name = F.lower(ticker)
    word = F.contains(low, name) & F.regexp_like(low, F.concat(F.lit(r"\b"), quote(name), F.lit(r"\b")))
    return F.exists(keywords, lambda k: F.contains(low, k)) | word


def issuer_tokens(name: Column) -> Column:
    """Telling words of an issuer's name in upper case; all of them if none is."""
    words = F.filter(F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", " "), r"\s+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.isin(*ISSUER_NOISE))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def first_two_words(name: Column) -> Column:
    return F.array_join(F.slice(F.split(F.trim(name), r"\s+"), 1, 2), " ")


def first_match(text: Column, patterns: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first pattern that ``text`` contains."""
    chain = None
    for part, value in patterns:
        test = F.contains(text, F.lit(part))
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return otherwise if chain is None else chain.otherwise(otherwise)


def manager_family(name: Column, families: Mapping[str, str] | None = None) -> Column:
    """Parent of a manager: the first known family, else its first two words."""
    known = [(part, family) for family, parts in (FAMILIES if families is None else families).items() for part in parts.split("|")]
    return first_match(F.upper(name), known, first_two_words(name))


def is_fund(name: Column, marks: Sequence[str] = FUND_MARKS) -> Column:
    padded = F.concat(F.lit(" "), F.upper(name), F.lit(" "))
    return reduce(lambda a, b: a | b, (F.contains(padded, F.lit(m)) for m in marks))


def has_class_token(title: Column, hint: str) -> Column:
    """Whether a share class title has ``hint`` as a word, ``CLASS`` being ``CL``."""
    return F.array_contains(F.split(F.replace(F.upper(title), F.lit("CLASS"), F.lit("CL")), r"\s+"), hint)


def usd(value: Column) -> Column:
    """Dollars in B, M or K; a dash for nothing."""
    size = F.abs(value)
    return (
        F.when(value.isNull() | (value == 0), "—")
        .when(size >= 1e9, F.format_string("$%.2fB", value / 1e9)).when(size >= 1e6, F.format_string("$%.2fM", value / 1e6))
        .when(size >= 1e3, F.format_string("$%.1fK", value / 1e3)).otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))
    )


def age_text(published: Column, now: Column) -> Column:
    """How long ago, both in unix seconds; empty where unknown."""
    minutes = (now - published) / 60
    hours = minutes / 60
    whole = lambda c: c.cast("long").cast("string")
    return (
        F.when(published.isNull() | (published == 0), "").when(minutes < 1, "just now").when(minutes < 60, F.concat(whole(F.floor(minutes)), F.lit(" min ago")))
        .when(hours < 24, F.concat(whole(F.bround(hours)), F.lit(" h ago"))).otherwise(F.concat(whole(F.bround(hours / 24)), F.lit(" d ago")))
    )


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def tier_mark(score: Column) -> Column:
    """Red from 70, yellow from 40, white below."""
    return F.when(score >= 70, "\U0001f534").when(score >= 40, "\U0001f7e1").otherwise("⚪")


def is_plan_sale(flag: Column, footnotes: Column) -> Column:
    """10b5-1: the structured flag, or any footnote with a hyphen or an en dash."""
    notes = F.lower(F.concat_ws(" ", footnotes))
    return F.coalesce(F.trim(flag).isin("1", "true"), F.lit(False)) | F.contains(notes, F.lit("10b5-1")) | F.contains(notes, F.lit("10b5–1"))


def roles(director: Column, officer: Column, title: Column, owner: Column, other: Column, other_text: Column) -> Column:
    """Roles of a reporting owner in fixed order."""
    on = lambda c: F.trim(c).isin("1", "true")
    named = lambda c, default: F.coalesce(blank_to_null(F.trim(c)), F.lit(default))
    return F.array_compact(
        F.array(F.when(on(director), F.lit("Director")), F.when(on(officer), named(title, "Officer")), F.when(on(owner), F.lit("10% Owner")), F.when(on(other), named(other_text, "Other")))
    )


def unix_from_date(day: Column) -> Column:
    """Seconds of an ISO date at midnight UTC; null if it isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def unix_from_mail_date(stamp: Column) -> Column:
    """Seconds of an RFC 2822 date; the weekday is left out."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(stamp, r"^\s*[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")))


def to_number(text: Column) -> Column:
    """A double; blank is 0, anything else that isn't a number null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0.0)).when(F.regexp_like(t, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), t.try_cast("double"))
