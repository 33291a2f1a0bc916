"""Toxicity by a weighted lexicon and Aho-Corasick matching on folded text."""

from __future__ import annotations

import math
import unicodedata
import zlib
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import _CACHE, arrow_map, steps, texts_of

#: General insults; what the labels teach is added and raises a weight.
SEED_LEXICON = {
    "idiot": 0.8, "moron": 0.9, "imbecile": 0.9, "stupid": 0.6, "dumbass": 1.0, "loser": 0.6,
    "scum": 0.9, "trash": 0.4, "garbage": 0.4, "pathetic": 0.6, "disgusting": 0.5, "worthless": 0.6,
    "clown": 0.4, "bastard": 0.9, "bitch": 1.0, "asshole": 1.0, "vermin": 0.7, "subhuman": 1.0,
    "shithead": 1.0, "cretin": 0.8, "degenerate": 0.5, "filth": 0.5, "wanker": 0.9, "slut": 1.0,
}
#: Harmless phrases that hold a lexicon word; a match inside one doesn't count.
EXCEPTIONS = (
    "trash can", "trash bin", "trash collection", "trash bag", "garbage collector", "garbage collection", "garbage can",
    "clown fish", "circus clown", "class clown", "loser bracket", "losers bracket", "degenerate case", "degenerate triangle",
    "vermin control",
)
#: Score from which a document is toxic: weight per word.
THRESHOLD = 0.0025
#: Bound on the labelled documents that the lexicon is learned from.
LEARN_DOCS = 20_000
#: A learned word needs so many toxic documents, this share of them, and so many
#: different words before it for each of them.
MIN_DOCS = 3
MIN_SHARE = 0.005
MIN_CONTEXTS = 0.5
MIN_LOG_ODDS = 3.0
FULL_LOG_ODDS = 6.0

_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i", "|": "i"}
#: Signs of other scripts by the letter that they are taken for.  Where upper and
#: lower case look like different letters, both are listed.
_ALIKE = {
    "a": "\u0430\u03b1\u0251\u0391\u0410",
    "b": "\u0432\u044c\u03b2\u0392\u0412",
    "c": "\u0441\u03f2\u0421",
    "d": "\u0501\u0257",
    "e": "\u0435\u03b5\u0454\u0395\u0415",
    "f": "\u0192\u03dd",
    "g": "\u0261\u0581\u0260",
    "h": "\u043d\u04bb\u0570\u0397\u041d",
    "i": "\u0456\u03b9\u0131\u0269\u0399\u0406",
    "j": "\u0458\u0575\u03f3\u0408",
    "k": "\u043a\u03ba\u039a\u041a",
    "l": "\u04cf\u04c0",
    "m": "\u043c\u039c\u041c",
    "n": "\u0578\u03b7\u043f\u039d",
    "o": "\u043e\u03bf\u0585\u03c3\u039f\u041e",
    "p": "\u0440\u03c1\u03a1\u0420",
    "q": "\u051b\u0566",
    "r": "\u0433\u0280",
    "s": "\u0455\u0405",
    "t": "\u0442\u03c4\u03a4\u0422",
    "u": "\u03c5\u057d\u028b",
    "v": "\u03bd\u0475",
    "w": "\u051d\u03c9\u0561\u0461",
    "x": "\u0445\u03c7\u03a7\u0425",
    "y": "\u0443\u03b3\u04af\u03a5\u0423",
    "z": "\u03b6\u0396",
}
_LOOKALIKE = {sign: letter for letter, signs in _ALIKE.items() for sign in signs}


def fold_table() -> np.ndarray:
    """For each code point the BMP code unit that it folds to: lower case,
    accents removed, homoglyphs and digit substitutions replaced, ``l`` and
    ``i`` as one; what isn't part of a word is a space."""
    if "fold" not in _CACHE:
        table = np.full(0x110000, 32, np.uint16)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            s = chr(c)
            if c < 128:
                t = s.lower()
            elif s in _LOOKALIKE:
                t = _LOOKALIKE[s]
            else:
                kind = unicodedata.category(s)
                if kind[0] not in "LN" and s not in _DIGITS:
                    if kind[0] == "M" or kind == "Cf":
                        table[c] = 0  # combining and invisible marks: removed
                    continue
                t = unicodedata.normalize("NFKD", s).lower()[:1]
                t = unicodedata.normalize("NFKD", t)[:1]
            t = _LOOKALIKE.get(t, t)
            t = _DIGITS.get(t, t)
            if t.isalnum() and ord(t) < 0x10000:
                table[c] = ord(t)
            elif s.isalnum():
                table[c] = 0xFFFD  # still a letter, of no pattern
        _CACHE["fold"] = table
    return _CACHE["fold"]


def fold(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Folded texts, each between two spaces with any run of other signs as
    the spaces found, and the number of words of each."""
    joined = "\n" + "\n\n".join(texts) + "\n"
    units = fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    sizes = np.array([len(t) + 2 for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    if "!" in joined:  # inside a word it stands for i
        bang = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4") == 33)
        bang = bang[(units[bang - 1] != 32) & (units[np.minimum(bang + 1, len(units) - 1)] != 32)]
        units[bang] = ord("i")
    kept = units != 0
    if not kept.all():
        at = np.concatenate([[0], np.cumsum(kept)])
        units, begins = units[kept], at[begins]
    head = (units != 32) & (np.concatenate([[32], units[:-1]]) == 32)
    counts = np.add.reduceat(head, begins[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    whole = units.tobytes().decode("utf-16-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(begins, begins[1:])], counts


def fold_word(word: str) -> str:
    return fold([word])[0][0].strip()


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    """Patterns are whole words, a space on each side; exceptions have weight None."""
    a = ahocorasick.Automaton()
    weights: dict[str, float] = {}
    for w, x in lexicon.items():
        if k := " ".join(fold_word(w).split()):
            weights[k] = max(x, weights.get(k, 0.0))
    for k, x in weights.items():
        a.add_word(f" {k} ", (len(k) + 2, x))
    for e in exceptions:
        if k := " ".join(fold_word(e).split()):
            a.add_word(f" {k} ", (len(k) + 2, None))
    a.make_automaton()
    return a


def score_folded(text: str, a: ahocorasick.Automaton) -> tuple[float, int]:
    """Sum of weights and number of matches outside exception phrases."""
    found = [(end - n + 1, end + 1, w) for end, (n, w) in a.iter(text)]
    if not found:
        return 0.0, 0
    # A match is spared if an exception that begins at it or before ends at it
    # or after; the furthest end so far tells that.
    spared = sorted((b, e) for b, e, w in found if w is None)
    begins, furthest = [b for b, _ in spared], list(accumulate((e for _, e in spared), max))
    within = lambda b, e: (k := bisect_right(begins, b)) > 0 and furthest[k - 1] >= e
    hits = [w for b, e, w in found if w is not None and not (spared and within(b, e))]
    return math.fsum(hits), len(hits)


def learn_lexicon(docs: DataFrame, labels: DataFrame, bound: int = LEARN_DOCS, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_contexts: float = MIN_CONTEXTS) -> dict[str, float]:
    """Words that labelled toxic documents hold far more often than others.

    ``bound`` is the largest number of labelled documents used (those of least
    MD5 of the id), so the word counts and the lexicon are bounded too.  Copies of a
    text count once.  A word needs ``min_docs`` toxic documents, ``min_share`` of
    all of them, and log odds of ``MIN_LOG_ODDS``.  It also has to follow on
    ``min_contexts`` different words for each of these documents: an insult
    stands anywhere, while the words of a passage or of near copies always
    follow on the same, however many documents hold them.  The weight is the log
    odds over ``FULL_LOG_ODDS``, 1 at most.  Without labels the result is empty.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(bound)
    )
    sample = (
        docs.select("doc_id", "text").where("text IS NOT NULL")
        .join(F.broadcast(picked), "doc_id")
        .groupBy(F.xxhash64("text").alias("_h")).agg(F.max("_toxic").alias("_toxic"), F.min("text").alias("text"))
    )

    def step(batch: pa.RecordBatch):
        counts: dict[str, list[int]] = {}
        follows: set[tuple[str, int]] = set()
        toxic = batch.column(0).to_pylist()
        texts = texts_of(batch.column(1))
        t = [0, 0]
        for b, e in steps(texts):
            for folded, y in zip(fold(texts[b:e])[0], toxic[b:e]):
                t[y > 0] += 1
                words = folded.split()
                for w in set(words):
                    counts.setdefault(w, [0, 0])[y > 0] += 1
                if y > 0:
                    follows |= {(w, zlib.crc32(before.encode("utf-8", "surrogatepass")) + 1) for before, w in zip(["", *words], words)}
        counts[""] = t
        follow = list(follows)
        w = [*counts, *(w for w, _ in follow)]
        c = [0] * len(counts) + [c for _, c in follow]
        n, t = ([*(x[k] for x in counts.values()), *[0] * len(follow)] for k in (0, 1))
        yield pa.record_batch([pa.array(w), *(pa.array(x, pa.int64()) for x in (c, n, t))], names=["w", "c", "n", "t"])

    each = arrow_map(sample.select("_toxic", "text"), step, "w string, c long, n long, t long").groupBy("w", "c").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    words = each.groupBy("w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.count_if(F.col("c") > 0).alias("c"))
    enough = (F.col("t") >= min_docs) & (F.col("n") <= F.col("t")) & (F.col("c") >= min_contexts * F.col("t"))
    rows = words.where(enough | (F.col("w") == "")).collect()
    total = next(((r.n, r.t) for r in rows if r.w == ""), (0, 0))
    out = {}
    for r in rows:
        if len(r.w) > 2 and r.t >= min_share * total[1]:
            odds = math.log((r.t + 0.5) / (total[1] + 1)) - math.log((r.n + 0.5) / (total[0] + 1))
            if odds >= MIN_LOG_ODDS:
                out[r.w] = min(1.0, odds / FULL_LOG_ODDS)
    return out


def toxicity(docs: DataFrame, lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """Score each document by its lexicon words.

    Text and lexicon are folded alike (case, accents, homoglyphs, digits used
    as letters, invisible marks), words are found by one Aho-Corasick pass over
    the whole text, matches inside exception phrases are left out, and the sum
    of weights is divided by the number of words.

    Result, one row for each row of ``docs``: ``doc_id, n_words, hits, score,
    toxic``.  Null or wordless text has score 0 and isn't toxic.  A null
    ``doc_id`` stays null.  A score equal to the threshold is toxic.  Texts of
    any length are scored whole, in time that grows with their length.  Repeated
    rows are scored each; further columns of ``docs`` are ignored; an empty table
    gives an empty result.
    """
    words = dict(SEED_LEXICON if lexicon is None else lexicon)
    built: list = []

    def step(batch: pa.RecordBatch):
        if not built:
            built.append(automaton(words, exceptions))
        texts = texts_of(batch.column(1))
        n, sums, hits = [], [], []
        for b, e in steps(texts):
            folded, counts = fold(texts[b:e])
            n.append(counts)
            for f in folded:
                s, h = score_folded(_single(f), built[0])
                sums.append(s)
                hits.append(h)
        counts = np.concatenate(n)
        score = np.array(sums) / np.maximum(counts, 1)
        yield pa.record_batch(
            [batch.column(0), pa.array(counts), pa.array(hits, pa.int64()), pa.array(score), pa.array(score >= threshold)],
            names=["doc_id", "n_words", "hits", "score", "toxic"],
        )

    return arrow_map(docs.select("doc_id", "text"), step, "doc_id long, n_words long, hits long, score double, toxic boolean")


def _single(folded: str) -> str:
    """Runs of spaces as one.  Adjacent words share their space, which the
    automaton allows, since it reports overlapping matches."""
    return f" {' '.join(folded.split())} "


def lexicon_for(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """The seed lexicon and what the labels teach, each word at its larger weight."""
    out = {fold_word(w): x for w, x in SEED_LEXICON.items()}
    for w, x in learn_lexicon(docs, labels).items():
        out[w] = max(x, out.get(w, 0.0))
    return out


def keep_clean(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that aren't toxic, all columns as they were.

    The verdict is made row by row in the same Arrow pass, so neither a join
    nor a unique ``doc_id`` is needed.  Null and wordless texts stay; repeated
    rows share their fate; an empty table stays empty.
    """
    built: list = []

    def step(batch: pa.RecordBatch):
        if not built:
            built.append(automaton(lexicon, exceptions))
        texts = texts_of(batch.column(batch.schema.get_field_index("text")))
        keep = []
        for b, e in steps(texts):
            folded, counts = fold(texts[b:e])
            keep += [score_folded(_single(f), built[0])[0] / max(int(c), 1) < threshold for f, c in zip(folded, counts)]
        yield batch.filter(pa.array(keep))

    return arrow_map(docs, step, docs.schema)


def _sql_fold(text: str) -> str:
    """SQL of the folded text, for Latin letters with accents and the signs of
    ``_ALIKE`` (DuckDB has no compatibility forms)."""
    signs, letters = "".join(_LOOKALIKE), "".join(_LOOKALIKE.values())
    t = f"translate(strip_accents(lower(translate({text}, '{signs}', '{letters}'))), '{signs}', '{letters}')"
    t = f"translate(regexp_replace({t}, '[\\p{{M}}\\p{{Cf}}]', '', 'g'), '{''.join(_DIGITS)}', '{''.join(_DIGITS.values())}')"
    for _ in range(2):  # twice, as matches don't overlap
        t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}])!([\\p{{L}}\\p{{N}}])', '\\1i\\2', 'g')"
    return f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"


#: The lexicon as it is learned, and every score with it.  All lexicon words are
#: single words, all exceptions two.
ORACLE = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(trim({_sql_fold("coalesce(text, '')")}), ' ') AS ws FROM documents),
each AS (SELECT r, doc_id, text, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
seq AS (SELECT *, lag(w) OVER o AS before, lead(w) OVER o AS after FROM each WHERE w <> '' WINDOW o AS (PARTITION BY r ORDER BY i)),
picked AS (
  SELECT doc_id, max(toxic) AS y FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {LEARN_DOCS}),
sample AS (SELECT text, max(y) > 0 AS y, min(r) AS r FROM w JOIN picked USING (doc_id) WHERE text IS NOT NULL GROUP BY 1),
total AS (SELECT count(*) FILTER (NOT y) AS n, count(*) FILTER (y) AS t FROM sample),
word AS (
  SELECT w, count(DISTINCT s.r) FILTER (NOT y) AS n, count(DISTINCT s.r) FILTER (y) AS t, count(DISTINCT coalesce(before, '')) FILTER (y) AS c
  FROM sample s JOIN seq USING (r) GROUP BY 1),
odds AS (
  SELECT w, ln((word.t + 0.5) / (total.t + 1)) - ln((word.n + 0.5) / (total.n + 1)) AS o FROM word, total
  WHERE word.t >= {MIN_DOCS} AND word.n <= word.t AND word.c >= {MIN_CONTEXTS} * word.t AND length(w) > 2 AND word.t >= {MIN_SHARE} * total.t),
lexicon AS (
  SELECT w, max(x) AS x FROM (
    SELECT w, least(1.0, o / {FULL_LOG_ODDS}) AS x FROM odds WHERE o >= {MIN_LOG_ODDS}
    UNION ALL VALUES {", ".join(f"('{fold_word(w)}', {x})" for w, x in SEED_LEXICON.items())}) GROUP BY 1),
spare(p) AS (VALUES {", ".join(f"('{fold_word(e)}')" for e in EXCEPTIONS)}),
hit AS (
  SELECT r, count(*) AS hits, fsum(x) AS s FROM seq JOIN lexicon USING (w)
  WHERE coalesce(before || ' ' || w NOT IN (SELECT p FROM spare), true) AND coalesce(w || ' ' || after NOT IN (SELECT p FROM spare), true) GROUP BY 1),
size AS (SELECT r, count(*) AS n FROM seq GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(hits, 0) AS hits, round(coalesce(s, 0) / greatest(coalesce(n, 0), 1), 9) AS score,
  coalesce(s, 0) / greatest(coalesce(n, 0), 1) >= {THRESHOLD} AS toxic
FROM w LEFT JOIN hit USING (r) LEFT JOIN size USING (r)
"""
