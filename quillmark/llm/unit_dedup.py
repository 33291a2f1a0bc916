"""Substring dedup by hashing lines, and the sentences of lines that stay."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_map, cut, lists, texts_of

#: Units of fewer words are too common by chance to count as repeats.
MIN_LINE_WORDS = 4
MIN_SENTENCE_WORDS = 5
#: A sentence ends with a run of marks and takes the white space after it.
SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*|[.!?]+\s*", re.ASCII)


def normalise(unit: str) -> tuple[str, int]:
    """Lower case, runs of white space as one space; and the number of words."""
    words = unit.lower().split()
    return " ".join(words), len(words)


def units(text: str, min_line: int = MIN_LINE_WORDS, min_sentence: int = MIN_SENTENCE_WORDS):
    """Per line: start, end, normal form or None if too short, and its
    sentences in the same shape (none where the line is one sentence)."""
    at = 0
    for line in text.split("\n"):
        norm, n = normalise(line)
        parts = []
        found = SENTENCE.findall(line) if n >= min_sentence else ()
        if len(found) > 1:
            p = at
            for s in found:
                form, k = normalise(s)
                parts.append((p, p + len(s), form if k >= min_sentence else None))
                p += len(s)
        yield at, at + len(line), norm if n >= min_line else None, parts
        at += len(line) + 1


def first_places(found: list[tuple]) -> dict[str, int]:
    """Each normal form of the ``units`` of a text and its first place: twice
    the start, plus 1 for a sentence, which may begin where its line does."""
    first: dict[str, int] = {}
    for start, _, norm, parts in found:
        if norm is not None:
            first.setdefault(norm, 2 * start)
        for p, _, form in parts:
            if form is not None:
                first.setdefault(form, 2 * p + 1)
    return first


def removed_spans(text: str, gone: set[int], min_line: int, min_sentence: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the units that go: those whose first place is in ``gone`` and
    those seen earlier in the same text; and the number of units.

    A line that goes takes its line break along.
    """
    found = list(units(text, min_line, min_sentence))
    first = first_places(found)
    drop = lambda form, place: form is not None and ((f := first[form]) != place or f in gone)
    spans, n = [], 0
    for start, end, norm, parts in found:
        n += 1 + len(parts)
        if drop(norm, 2 * start):
            spans.append((start, min(end + 1, len(text))))
        else:
            spans += [(p, q) for p, q, form in parts if drop(form, 2 * p + 1)]
    return spans, n


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept)


def unit_dedup(docs: DataFrame, min_line: int = MIN_LINE_WORDS, min_sentence: int = MIN_SENTENCE_WORDS) -> DataFrame:
    """Keep the earliest occurrence of each repeated line or sentence.

    Units are lines; a line that stays is looked at sentence by sentence.
    Normal forms (case and white space folded) are hashed to 128 bits and
    grouped over the whole table; the occurrence of least (doc_id, offset)
    stays and all others go.

    Lines of fewer than ``min_line`` words and sentences of fewer than
    ``min_sentence`` aren't compared and stay however often they repeat.  Words
    are split on white space, so that holds for whole lines in scripts without
    spaces.  The defaults are those of ``ORACLE``; 1 and 1 compare every unit
    that isn't blank.

    Result, one row for each row of ``docs``: ``doc_id, text`` (without the
    removed units), ``n_units, n_removed`` (spans removed, neighbours merged),
    ``removed_chars, removed_spans`` (``start-end`` offsets into the original
    text, joined by ``;``).  Null text stays null with no units.  Rows of null
    ``doc_id`` have no rank: they aren't compared with other documents and lose
    only what they repeat themselves.  Repeated rows of one ``doc_id`` share
    their rank and all lose the same.  Further columns are ignored; an empty
    table gives an empty result.

    Two occurrences at one rank are copies of one place and share its fate, so
    of equal units there is no further order to settle.  Texts of any length are
    worked on whole, in time and memory that grow with their length; offsets are
    64-bit.

    The first occurrence within a document is found where the text is read, so
    one row for each distinct unit of a document is shuffled, and the grouping
    keeps two integers for each digest.  The digests are made once and kept in
    the checkpoint folder for the grouping and for what follows from it.
    """
    base = docs.select("doc_id", "text")

    def emit(batch: pa.RecordBatch):
        starts, raw, counts = [], [], [0]
        for t in texts_of(batch.column(1)):
            first = first_places(list(units(t, min_line, min_sentence)))
            counts.append(len(first))
            starts += first.values()
            raw += [xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in first]
        digests, ends = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2), np.cumsum(counts)
        yield pa.record_batch([batch.column(0), *(lists(v, ends, pa.int64()) for v in (np.array(starts, np.int64), digests[:, 0], digests[:, 1]))], names=["doc_id", "at", "hi", "lo"])

    each = cut(arrow_map(base.where("doc_id IS NOT NULL"), emit, "doc_id long, at array<long>, hi array<long>, lo array<long>"))
    found = each.select("doc_id", F.inline(F.arrays_zip("at", "hi", "lo")))
    repeated = found.groupBy("hi", "lo").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    gone = found.join(repeated, ["hi", "lo"]).where("doc_id > _first").groupBy("doc_id").agg(F.collect_set("at").alias("_gone"))
    joined = base.join(gone, "doc_id", "left")

    def finish(batch: pa.RecordBatch):
        cols: list[list] = [[], [], [], [], []]
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            spans, n = removed_spans(text, set(drop or ()), min_line, min_sentence) if text is not None else ([], 0)
            spans = _merged(spans)
            for c, v in zip(cols, (cut_out(text, spans) if spans else text, n, len(spans), sum(b - a for a, b in spans), ";".join(f"{a}-{b}" for a, b in spans))):
                c.append(v)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "text", "n_units", "n_removed", "removed_chars", "removed_spans"])

    return arrow_map(joined, finish, "doc_id long, text string, n_units long, n_removed long, removed_chars long, removed_spans string")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln, length(text) AS size
  FROM documents),
placed AS (
  SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln) - length(line) - 1)::BIGINT AS a,
    trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM lines),
l AS (
  SELECT *, a + length(line) AS b, CASE WHEN norm = '' THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) + 1 END AS n,
    regexp_extract_all(line, '[^.!?]+[.!?]*\s*|[.!?]+\s*') AS parts FROM placed),
s0 AS (
  SELECT doc_id, ln, a AS la, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM l WHERE n >= 5 AND len(parts) > 1),
s1 AS (
  SELECT *, (la + sum(length(part)) OVER (PARTITION BY doc_id, ln ORDER BY k) - length(part))::BIGINT AS a,
    trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS norm FROM s0),
s AS (
  SELECT *, a + length(part) AS b, CASE WHEN norm = '' THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) + 1 END AS n FROM s1),
u AS (
  SELECT doc_id, ln, 0 AS kind, a, norm FROM l WHERE n >= 4 UNION ALL SELECT doc_id, ln, 1, a, norm FROM s WHERE n >= 5),
ranked AS (
  SELECT doc_id, ln, kind, a, norm, first_value(doc_id) OVER w AS fd, first_value(a) OVER w AS fa
  FROM u WINDOW w AS (PARTITION BY norm ORDER BY doc_id, a)),
dup AS (SELECT DISTINCT doc_id, ln, kind, a FROM ranked WHERE doc_id <> fd OR a <> fa),
gone_lines AS (SELECT l.doc_id, l.ln, l.a, least(l.b + 1, l.size) AS b FROM l JOIN dup d ON d.kind = 0 AND d.doc_id = l.doc_id AND d.ln = l.ln),
gone AS (
  SELECT doc_id, a, b FROM gone_lines
  UNION ALL
  SELECT s.doc_id, s.a, s.b FROM s JOIN dup d ON d.kind = 1 AND d.doc_id = s.doc_id AND d.a = s.a
  WHERE NOT EXISTS (SELECT 1 FROM gone_lines g WHERE g.doc_id = s.doc_id AND g.ln = s.ln)),
seg AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b) AS g FROM (
    SELECT *, CASE WHEN lag(b) OVER (PARTITION BY doc_id ORDER BY a, b) = a THEN 0 ELSE 1 END AS new FROM gone)),
spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM seg GROUP BY doc_id, g),
per AS (
  SELECT doc_id, count(*) AS n, sum(b - a)::BIGINT AS chars, string_agg(a || '-' || b, ';' ORDER BY a) AS txt, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb
  FROM spans GROUP BY doc_id),
nu AS (SELECT doc_id, sum(c)::BIGINT AS n FROM (SELECT doc_id, count(*) AS c FROM l GROUP BY 1 UNION ALL SELECT doc_id, count(*) FROM s GROUP BY 1) GROUP BY 1),
kept AS (
  SELECT d.doc_id, string_agg(substring(d.text, (CASE WHEN i = 1 THEN 0 ELSE p.bb[i - 1] END + 1)::BIGINT,
    (CASE WHEN i > p.n THEN length(d.text) ELSE p.aa[i] END - CASE WHEN i = 1 THEN 0 ELSE p.bb[i - 1] END)::BIGINT), '' ORDER BY i) AS text
  FROM documents d JOIN per p USING (doc_id), generate_series(1, p.n + 1) AS t(i) GROUP BY d.doc_id)
SELECT d.doc_id, CASE WHEN p.n IS NULL THEN d.text ELSE k.text END AS text, coalesce(nu.n, 0) AS n_units, coalesce(p.n, 0) AS n_removed,
  coalesce(p.chars, 0) AS removed_chars, coalesce(p.txt, '') AS removed_spans
FROM documents d LEFT JOIN per p USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN nu USING (doc_id)
"""
