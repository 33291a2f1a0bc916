"""News: duplicates, events and what is worth pushing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as X

#: Items of one call of the judge.
BATCH = 30
PUSH_FROM = 85
#: Companies that are looked for by one automaton.
NAMES = 100_000


def recent(published: Column, now: Column, seconds: float) -> Column:
    """Within the time before now; what has no time passes."""
    return published.isNull() | (published == 0) | (published >= now - seconds)


def by_title(items: DataFrame, pos: str = "pos") -> DataFrame:
    """One item for each normal title (or id, where the title is empty): the
    first by ``pos``, with the tickers of all and the ids in order."""
    key = F.coalesce(X.blank_to_null(X.normal_title(F.col("title"))), F.col("uid"))
    rest = [c for c in items.columns if c not in ("tickers",)]
    per = items.withColumn("_key", key).groupBy("_key").agg(
        F.min_by(F.struct(*rest), F.struct(pos, "uid")).alias("_i"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tickers")))).alias("tickers"),
        F.transform(F.array_sort(F.collect_list(F.struct(pos, "uid"))), lambda s: s["uid"]).alias("uids"),
    )
    return per.select("_i.*", "tickers", "uids")


def clustered(items: DataFrame, key: Column, materiality: Column, pos: str = "pos") -> DataFrame:
    """One item for each event: of most materiality, then most tickers, then
    first; tickers of all, and how many there were."""
    rest = [c for c in items.columns if c not in ("tickers",)]
    best = F.struct(-materiality, -F.size("tickers"), F.col(pos))
    per = items.withColumn("_key", key).groupBy("_key").agg(
        F.min_by(F.struct(*rest), best).alias("_i"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tickers")))).alias("tickers"), F.count(F.lit(1)).alias("dup_count")
    )
    return per.select("_i.*", "tickers", "dup_count", F.col("_key").alias("event_key"))


def by_event(items: DataFrame, pos: str = "pos") -> DataFrame:
    """Events of judged items (with a struct ``verdict``); others go."""
    judged = items.where("verdict IS NOT NULL")
    return clustered(judged, X.event_key(F.col("verdict.event"), F.col("title"), F.col("uid")), F.col("verdict.materiality"), pos)


def merged_groups(events: DataFrame, groups: DataFrame, n: str = "n") -> DataFrame:
    """Events that a second look put in one group (``n, group``): of most
    materiality, then most headlines; headlines add up.  What got no group
    stays by itself."""
    mine = events.join(groups, n, "left").withColumn("_g", F.coalesce(F.col("group").cast("long"), -F.col(n).cast("long")))
    rest = [c for c in events.columns if c not in ("tickers", "dup_count")]
    best = F.struct(-F.col("verdict.materiality"), -F.col("dup_count"), F.col(n))
    per = mine.groupBy("_g").agg(
        F.min_by(F.struct(*rest), best).alias("_i"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tickers")))).alias("tickers"), F.sum("dup_count").alias("dup_count")
    )
    return per.select("_i.*", "tickers", "dup_count")


def worth_pushing(events: DataFrame, least: int = PUSH_FROM) -> DataFrame:
    return events.where(F.coalesce("verdict.relevant", F.lit(False)) & (F.coalesce("verdict.materiality", F.lit(0)) >= least))


def naming(items: DataFrame, companies: DataFrame, text: str, limit: int = NAMES) -> DataFrame:
    """Items with each company (``ticker, name``) that their text mentions.

    Up to ``limit`` companies are looked for in one pass over each text, by an
    automaton of all keywords and tickers; more are joined, each item against
    each company.
    """
    known = companies.select("ticker", X.name_keywords(F.col("name")).alias("_keys"))
    rows = known.limit(limit + 1).collect()
    if len(rows) > limit:
        low = items.withColumn("_low", F.lower(text))
        return low.join(known, X.mentions(F.col("_low"), F.col("ticker"), F.col("_keys"), lowered=True)).drop("_low", "_keys")
    parts: dict[str, tuple[set[int], set[int]]] = {}
    for i, r in enumerate(rows):
        for kind, part in [*((0, k) for k in r["_keys"] or ()), (1, (r.ticker or "").lower())]:
            if part:
                parts.setdefault(part, (set(), set()))[kind].add(i)
    tickers = [r.ticker for r in rows]
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts and not built:
            a = ahocorasick.Automaton()
            for part, (by_key, by_ticker) in parts.items():
                a.add_word(part, (len(part), sorted(by_key), sorted(by_ticker)))
            a.make_automaton()
            built.append(a)
        for batch in batches:
            found: list[list[str]] = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                low, hits = (t or "").lower(), set()
                for end, (n, by_key, by_ticker) in built[0].iter(low) if built else ():
                    hits.update(by_key)
                    if by_ticker and _alone(low, end + 1 - n, end + 1):
                        hits.update(by_ticker)
                found.append([tickers[i] for i in sorted(hits)])
            yield batch.append_column(pa.field("_tickers", pa.list_(pa.string())), pa.array(found, pa.list_(pa.string())))

    schema = T.StructType([*items.schema.fields, T.StructField("_tickers", T.ArrayType(T.StringType()))])
    return items.mapInArrow(run, schema).withColumn("ticker", F.explode("_tickers")).drop("_tickers")


def _alone(text: str, begin: int, end: int) -> bool:
    """Whether a word begins and ends at these places, as ``\\b`` has it."""
    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    return word(begin - 1) != word(begin) and word(end - 1) != word(end)


def unseen(items: DataFrame, seen: DataFrame, key: str = "uid") -> DataFrame:
    """Items that weren't there before."""
    return items.join(seen.select(key), key, "left_anti")


def latest(items: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` items of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return items.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


Provider = Callable[[list[dict]], list[dict]]
_PROVIDERS: dict[str, Callable[[], Provider]] = {}


def provider(name: str) -> Callable[[Callable[[], Provider]], Callable[[], Provider]]:
    """Register a judge under a name; it gets items (``n`` and their columns)
    and gives verdicts with the same ``n``."""

    def add(make: Callable[[], Provider]) -> Callable[[], Provider]:
        _PROVIDERS[name] = make
        return make

    return add


def find_provider(name: str) -> Callable[[], Provider]:
    """The judge of a name; there is no fallback for an unknown one."""
    if name not in _PROVIDERS:
        raise ValueError(f"unknown judge: {name}")
    return _PROVIDERS[name]


_VERDICT = "struct<relevant:boolean,materiality:int,direction:string,why:string,event:string>"


def judged(items: DataFrame, name: str, batch: int = BATCH) -> DataFrame:
    """Items with the verdict of a judge, in batches; a batch that fails has
    none, as has an item that the answer leaves out."""
    make = find_provider(name)
    columns = list(items.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        for frame in frames:
            out: list[dict | None] = []
            for a in range(0, len(frame), batch):
                part = [{"n": i, **r} for i, r in enumerate(frame.iloc[a : a + batch].to_dict("records"), 1)]
                try:
                    answer = {v["n"]: {k: x for k, x in v.items() if k != "n"} for v in judge(part)}
                except Exception:  # noqa: BLE001 - a judge may fail in any way; its items stay unjudged
                    answer = {}
                out += [answer.get(r["n"]) for r in part]
            yield frame.assign(verdict=pd.Series(out, index=frame.index, dtype=object))[[*columns, "verdict"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + f", verdict {_VERDICT}"
    return items.mapInPandas(run, schema)


def message(events: DataFrame, now: Column) -> DataFrame:
    """Text of each pushed event."""
    v = F.col("verdict")
    head = F.concat(X.tier_mark(v["materiality"]), F.lit(" <b>"), F.array_join("tickers", ","), F.lit("</b> · "), v["materiality"].cast("string"), F.lit(" · "), v["direction"], F.when(F.col("dup_count") > 1, F.concat(F.lit(" · "), F.col("dup_count").cast("string"), F.lit("x"))).otherwise(""))
    title = X.html_escape(F.col("title"))
    link = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit('<a href="'), F.col("url"), F.lit('">'), title, F.lit("</a>"))).otherwise(title)
    age = X.age_text(F.col("published"), now)
    source = F.concat(F.col("source"), F.when(age != "", F.concat(F.lit(" · "), age)).otherwise(""))
    lines = F.filter(F.array(head, link, X.html_escape(F.coalesce(v["why"], F.lit(""))), source), lambda x: x != "")
    return events.withColumn("message", F.array_join(lines, "\n"))
