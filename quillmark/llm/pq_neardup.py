"""Embedding near-dedup by product quantisation over inverted lists."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_map, cut, lists
from quillmark.llm.components import components

#: Cosine from which vectors are near duplicates.
THRESHOLD = 0.95
#: Sub-vectors of a residual, and words of the codebook of each.
PARTS, WORDS = 8, 256
#: Inverted lists for each square root of the number of vectors.
LISTS = 4
#: Deviations of the normal part across a plane that a probe allows for.
DEVIATIONS = 3.0
#: Passes of Lloyd's method over all vectors, for lists and codebooks together.
PASSES = 5
#: Vectors of the lists that one task holds, and queries that it takes.
BLOCK_VECTORS, TASK_QUERIES = 16_384, 20_000
#: Cells of a table that one vectorised step holds.
STEP_CELLS = 1 << 19
#: Cells of the lookup tables that a task holds at a time, four bytes each.
TABLE_CELLS = 1 << 23
#: Vectors, and their numbers in all, of a side of a tile, where all pairs are
#: looked at, and partitions that the tiles are put in at most.
TILE_VECTORS, TILE_NUMBERS, TILE_PARTITIONS = 8_192, 1 << 22, 4_096
#: Rounding that the bounds leave room for.
EPS = 1e-5
#: The same for tables, which have single precision.
TABLE_EPS = 1e-4


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _chunks(n: int, width: int, cells: int = STEP_CELLS):
    size = max(1, cells // max(1, width))
    return ((a, min(a + size, n)) for a in range(0, n, size))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    out = np.empty(len(x), np.int64)
    for a, b in _chunks(len(x), len(centres)):
        out[a:b] = np.argmax(x[a:b] @ centres.T - half, axis=1)
    return out


def sufficient_lists(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, list) such that every list that can hold a vector
    within ``margin`` of the row is there.

    A vector of list c lies on c's side of the plane midway between c and the
    row's own centre, so c matters only if that plane is within the margin:
    (|x - c|^2 - |x - own|^2) / (2 |c - own|) <= margin.
    """
    square = (centres * centres).sum(axis=1)
    rows, found = [], []
    for a, b in _chunks(len(x), len(centres)):
        d = square - 2 * (x[a:b] @ centres.T)
        own = np.argmin(d, axis=1)
        apart = np.sqrt(np.maximum(square[own][:, None] + square[None, :] - 2 * (centres[own] @ centres.T), 0))
        near = d - d[np.arange(b - a), own][:, None] <= 2 * (margin + EPS) * apart + EPS
        r, c = np.nonzero(near)
        rows.append(r + a)
        found.append(c)
    return np.concatenate(rows), np.concatenate(found)


def margin_of(threshold: float, dim: int, deviations: float) -> float:
    """How far off a list's plane may be for the list to be probed.

    Near vectors differ by at most the radius, of which only the part across the
    plane counts.  If they differ in any direction alike, that part is normal
    with the radius over the square root of the dimension as its deviation, so
    a pair at the very threshold is beyond three deviations in 0.13 % of cases,
    and missed only if that holds for both of its vectors.  In low dimensions,
    or with infinite ``deviations``, it is the radius itself, which no pair
    exceeds.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    return radius * min(1.0, deviations / math.sqrt(dim))


def parts_of(residual: np.ndarray, parts: int) -> np.ndarray:
    """Sub-vectors, zeros added where ``parts`` doesn't divide the dimension."""
    n, d = residual.shape
    width = -(-d // parts)
    if width * parts > d:
        residual = np.concatenate([residual, np.zeros((n, width * parts - d))], axis=1)
    return residual.reshape(n, parts, width)


def encode(residual: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each residual and how far it is from what they stand for."""
    sub = parts_of(residual, len(books))
    codes = np.stack([nearest(sub[:, m], books[m]) for m in range(len(books))], axis=1)
    gone = sub - books[np.arange(len(books)), codes]
    return codes, np.sqrt((gone**2).sum(axis=(1, 2)))


def blocks_of(centres: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """A block number for each list: neighbouring lists together, ``limit``
    vectors a block but for a list that is larger by itself.  A query then
    travels once to a block, whatever number of its lists it asks."""
    n = max(1, -(-int(sizes.sum()) // limit))
    seeds = centres[:: max(1, len(centres) // n)][:n].copy()
    for _ in range(10):
        k = nearest(centres, seeds)
        for g in range(len(seeds)):
            if (k == g).any():
                seeds[g] = centres[k == g].mean(axis=0)
    out, block, held = np.zeros(len(centres), np.int64), 0, 0
    for i in np.argsort(k, kind="stable"):
        if held and held + sizes[i] > limit:
            block, held = block + 1, 0
        out[i] = block
        held += sizes[i]
    return out


def query_tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """For each part and query the inner products with all words.  They don't
    depend on the list, so a query needs one table however many lists it asks."""
    return np.matmul(parts_of(q, len(books)).transpose(1, 0, 2).astype(np.float32), books.transpose(0, 2, 1).astype(np.float32))


def member_terms(codes: np.ndarray, home: np.ndarray, centres: np.ndarray, books: np.ndarray) -> np.ndarray:
    """For each member 2 c.w + |w|^2, c being its centre and w what its codes
    stand for: the part of a distance that no query changes."""
    out = np.zeros(len(codes))
    centre = parts_of(centres, len(books))
    for m, book in enumerate(books):
        w = book[codes[:, m]]
        out += 2 * np.einsum("nd,nd->n", w, centre[home, m]) + (w * w).sum(axis=1)
    return out


def scan_list(qid: np.ndarray, q: np.ndarray, tables: np.ndarray, home: np.ndarray, vid: np.ndarray, v: np.ndarray, codes: np.ndarray, terms: np.ndarray, error: np.ndarray, centre: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, member) of a list by their places, with their cosine.
    Queries whose ``home`` is the list meet members of greater id only.

    The asymmetric distance |q - c - w|^2 is |q - c|^2 plus the member's term
    less twice what the query's table has for the member's codes.  A member
    whose codes are ``error`` off can be within the radius only if that is at
    most radius + error; what passes is reranked by its exact cosine.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    apart = ((q - centre) ** 2).sum(axis=1).astype(np.float32)
    least = ((terms - (radius + error) ** 2 - TABLE_EPS) / 2).astype(np.float32)
    found = np.zeros((len(q), len(vid)), np.float32)
    for m in range(len(tables)):
        found += np.take(tables[m], codes[:, m], axis=1)
    i, j = np.nonzero(found >= least[None, :] + apart[:, None] / 2)
    once = np.where(home[i], qid[i] < vid[j], qid[i] != vid[j])
    i, j = i[once], j[once]
    cosine = np.einsum("ij,ij->i", q[i], v[j])
    ok = cosine >= threshold
    return i[ok], j[ok], cosine[ok]


def merge(lead: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of the nodes ``a`` to those of ``b``; ``lead`` has the least
    node of each node's set, before and after."""
    while len(a):
        x, y = lead[a], lead[b]
        other = x != y
        a, b, x, y = a[other], b[other], x[other], y[other]
        np.minimum.at(lead, np.maximum(x, y), np.minimum(x, y))
        while (lead[lead] != lead).any():
            lead[:] = lead[lead]


def _lloyd(df: DataFrame, dim: int, centres: np.ndarray, books: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lloyd's method over all rows, for lists and for the books of their
    residuals in the same passes; and how many vectors each list had.

    A task adds up its own points, the sums of a centre or word meet in one
    task, and one row for each comes to the driver.
    """
    spark = df.sparkSession
    k, (parts, words, width) = len(centres), books.shape
    sizes = np.zeros(k, np.int64)
    for _ in range(passes):
        held = spark.sparkContext.broadcast((centres, books))

        def run(batches, held=held):
            centres, books = held.value
            total, count = np.zeros(centres.shape), np.zeros(k, np.int64)
            word_total, word_count = np.zeros((parts * words, width)), np.zeros(parts * words, np.int64)
            for batch in batches:
                x = vectors_of(batch.column(1), dim)
                own = nearest(x, centres)
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=k)
                rest = parts_of(x - centres[own], parts)
                for m in range(parts):
                    w = nearest(rest[:, m], books[m]) + m * words
                    np.add.at(word_total, w, rest[:, m])
                    word_count += np.bincount(w, minlength=parts * words)
            for base, n, sums in ((0, count, total), (k, word_count, word_total)):
                if len(some := np.flatnonzero(n)):
                    yield _sums(base + some, n[some], sums[some])

        def add(batches):
            at: dict[int, int] = {}
            n: list[int] = []
            totals: list[np.ndarray] = []
            for batch in batches:
                ends = batch.column(2).offsets.to_numpy()
                flat = batch.column(2).values.to_numpy()
                for j, (key, c) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    x = flat[ends[j] : ends[j + 1]]
                    if (i := at.setdefault(key, len(n))) == len(n):
                        n.append(c)
                        totals.append(x.copy())
                    else:
                        n[i] += c
                        totals[i] += x
            for size in (dim, width) if width != dim else (dim,):
                some = [key for key in at if len(totals[at[key]]) == size]
                if some:
                    yield _sums(np.array(some), np.array([n[at[key]] for key in some]), np.array([totals[at[key]] for key in some]))

        sums = df.mapInArrow(run, _SUMS).repartition("k").mapInArrow(add, _SUMS).toArrow()
        centres, books = centres.copy(), books.reshape(-1, width).copy()
        for i, n, x in zip(sums["k"].to_pylist(), sums["n"].to_pylist(), sums["total"]):
            if i < k:
                centres[i], sizes[i] = x.values.to_numpy() / n, n
            else:
                books[i - k] = x.values.to_numpy() / n
        books = books.reshape(parts, words, width)
        held.unpersist()
    return centres, books, sizes


_SUMS = "k long, n long, total array<double>"


def _sums(k: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(k), pa.array(n), lists(total.reshape(-1), np.arange(len(k) + 1) * total.shape[1], pa.float64())], names=["k", "n", "total"])


_FOUND = "vec_a long, vec_b long, cosine double, links_a long, links_b long"


def _search(base: DataFrame, dim: int, n: int, threshold: float, deviations: float, parts: int, words: int, passes: int, block_vectors: int, task_queries: int) -> DataFrame:
    """What is near among the ``n`` rows of ``base`` (``vec_id, embedding,
    weight, apart``), all of dimension ``dim``.

    A pair with a row that is ``apart`` is a row of the result, with its cosine
    and what it adds to the links of either side.  It comes once for each pair
    of rows.  Other pairs stay in their task: for each vector in one the task
    gives its links there, weights of partners added up, and as ``vec_b`` the
    least id that it is joined to.
    """
    spark = base.sparkSession
    k = min(n, math.ceil(LISTS * math.sqrt(n)))
    start = base.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(k + words).select("embedding").toArrow()
    seeds = vectors_of(start["embedding"].combine_chunks(), dim)
    centres, others = seeds[:k], seeds[k:] if n > k else seeds
    books = np.ascontiguousarray(parts_of(others - centres[nearest(others, centres)], parts).transpose(1, 0, 2))
    centres, books, sizes = _lloyd(base, dim, centres, books, passes)
    block = blocks_of(centres, sizes, block_vectors)
    margin = margin_of(threshold, dim, deviations)
    learned = spark.sparkContext.broadcast((centres, books))

    def place(batch: pa.RecordBatch):
        centres, books = learned.value
        x = vectors_of(batch.column(1), dim)
        own = nearest(x, centres)
        codes, error = encode(x - centres[own], books)
        for a, b in _chunks(len(x), len(centres)):
            row, at = sufficient_lists(x[a:b], centres, margin)
            ends = np.searchsorted(row, np.arange(b - a + 1))
            part = batch.slice(a, b - a)
            yield pa.record_batch(
                [*part.columns, pa.array(own[a:b]), lists(codes[a:b].reshape(-1), np.arange(b - a + 1) * len(books), pa.int16()), pa.array(error[a:b]), lists(at, ends, pa.int32())],
                names=["vec_id", "embedding", "weight", "apart", "own", "codes", "error", "asked"],
            )

    # Written once: both sides of a pair go by the same lists asked.
    kind = base.schema["embedding"].dataType.simpleString()
    placed = cut(arrow_map(base, place, f"vec_id long, embedding {kind}, weight long, apart boolean, own long, codes array<short>, error double, asked array<int>"))

    def asking(batch: pa.RecordBatch, column: int):
        """Rows and the lists that they ask, by rows, blocks and lists; and where
        a row and block begin."""
        asked = batch.column(column)
        row, at = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
        by = np.lexsort((at, block[at], row))
        row, at = row[by], at[by]
        return row, at, np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[at][1:] != block[at][:-1])))

    def asked_blocks(batch: pa.RecordBatch):
        count = np.zeros(block.max() + 1, np.int64)
        for a, b in _chunks(batch.num_rows, len(block)):
            _, at, starts = asking(batch.slice(a, b - a), 0)
            count += np.bincount(block[at[starts]], minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some), pa.array(count[some])], names=["block", "n"])

    # A block meets its queries in as many tasks as they need.
    split = np.ones(block.max() + 1, np.int64)
    for r in arrow_map(placed.select("asked"), asked_blocks, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        split[r.block] = -(-r.n // task_queries)

    def members(batch: pa.RecordBatch):
        at = block[batch.column(4).to_numpy()]
        yield pa.record_batch([pa.array(at), pa.array(split[at]), *batch.columns], names=["block", "split", *batch.schema.names])

    def queries(batch: pa.RecordBatch):
        for a, b in _chunks(batch.num_rows, len(block)):
            part = batch.slice(a, b - a)
            row, at, starts = asking(part, 5)
            of = block[at[starts]]
            yield pa.record_batch(
                [pa.array(of), pa.array(split[of]), *(part.column(c).take(pa.array(row[starts])) for c in range(5)), lists(at, np.append(starts, len(at)), pa.int32())],
                names=["block", "split", "vec_id", "embedding", "weight", "apart", "own", "lists"],
            )

    coded = arrow_map(placed, members, f"block long, split long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in placed.schema)}")
    probes = arrow_map(placed.select("vec_id", "embedding", "weight", "apart", "own", "asked"), queries, f"block long, split long, vec_id long, embedding {kind}, weight long, apart boolean, own long, lists array<int>")
    left = probes.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.col("split"))).drop("split")
    right = coded.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("split") - 1))).drop("split")

    def scan(key, q: pa.Table, v: pa.Table) -> pa.Table:
        centres, books = learned.value
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0), none, none)]
        col = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
        number = lambda t, c: col(t, c).to_numpy(zero_copy_only=False)
        nodes = lead = links = none
        if q.num_rows and v.num_rows:
            qid, qx, q_weight, q_apart, own, asked = number(q, "vec_id"), vectors_of(col(q, "embedding"), dim), number(q, "weight"), number(q, "apart"), number(q, "own"), col(q, "lists")
            row = np.repeat(np.arange(len(qid)), asked.value_lengths().to_numpy())
            asked = asked.flatten().to_numpy()
            v = v.take(pa.array(np.argsort(number(v, "own"), kind="stable")))
            vid, vx, v_weight, v_apart, home, error = number(v, "vec_id"), vectors_of(col(v, "embedding"), dim), number(v, "weight"), number(v, "apart"), number(v, "own"), number(v, "error")
            codes = col(v, "codes").flatten().to_numpy().reshape(-1, len(books)).astype(np.int64)
            theirs = np.repeat(np.arange(len(vid)), col(v, "asked").value_lengths().to_numpy()) * len(centres) + col(v, "asked").flatten().to_numpy()
            terms = member_terms(codes, home, centres, books)
            kinds, heads = np.unique(home, return_index=True)
            tails = np.append(heads[1:], len(home))
            nodes, node = np.unique(np.concatenate([qid, vid]), return_inverse=True)
            q_node, v_node = node[: len(qid)], node[len(qid) :]
            lead, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
            for x, y in _chunks(len(qid), books.shape[0] * books.shape[1], TABLE_CELLS):
                tables = query_tables(qx[x:y], books)
                mine = slice(*np.searchsorted(row, [x, y]))
                by_q = np.argsort(asked[mine], kind="stable")
                r_all, asked_all = row[mine][by_q] - x, asked[mine][by_q]
                for c, h, t in zip(kinds, heads, tails):
                    r_list = r_all[slice(*np.searchsorted(asked_all, [c, c + 1]))]
                    for g, e in _chunks(len(r_list), t - h):
                        r = r_list[g:e]
                        i, j, cosine = scan_list(qid[x + r], qx[x + r], tables[:, r], own[x + r] == c, vid[h:t], vx[h:t], codes[h:t], terms[h:t], error[h:t], centres[c], threshold)
                        i, j = x + r[i], h + j
                        # Where the member asks the query's list too, the lesser id of both has the pair.
                        ask = j * len(centres) + own[i]
                        once = (qid[i] < vid[j]) | (theirs[np.minimum(np.searchsorted(theirs, ask), len(theirs) - 1)] != ask)
                        i, j, cosine = i[once], j[once], cosine[once]
                        alone = q_apart[i] | v_apart[j]
                        if alone.any():
                            found.append((qid[i[alone]], vid[j[alone]], cosine[alone], v_weight[j[alone]], q_weight[i[alone]]))
                            i, j = i[~alone], j[~alone]
                        np.add.at(links, q_node[i], v_weight[j])
                        np.add.at(links, v_node[j], q_weight[i])
                        merge(lead, q_node[i], v_node[j])
        a, b, cosine, links_a, links_b = (np.concatenate(x) for x in zip(*found))
        less, some = a < b, np.flatnonzero(links)
        pairs = [np.minimum(a, b), np.maximum(a, b), cosine, np.where(less, links_a, links_b), np.where(less, links_b, links_a)]
        sums = [nodes[some], nodes[lead[some]], np.full(len(some), np.nan), links[some], np.zeros(len(some), np.int64)]
        columns = [np.concatenate(x) for x in zip(pairs, sums)]
        return pa.table([pa.array(x, from_pandas=True) for x in columns], names=["vec_a", "vec_b", "cosine", "links_a", "links_b"])

    return left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(scan, _FOUND)


def tile_pairs(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray | None, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of rows of ``x`` and ``y`` (without it, of ``x`` with itself,
    once each) whose ids differ and whose cosine reaches the threshold, some rows
    at a time: the ids of either side and the cosine.

    Products in single precision, which are off by less than the dimension and a
    few times their rounding, say which pairs to look at by their exact cosine.
    """
    alone = y is None
    if alone:
        other_ids, y = ids, x
    dim = x.shape[1]
    x_low, y_low = x.astype(np.float32), y.astype(np.float32)
    least = np.float32(threshold - (dim + 4) * 2.0**-23)
    for a, b in _chunks(len(x), len(y)):
        skip = a if alone else 0
        i_all, j_all = np.nonzero(x_low[a:b] @ y_low[skip:].T >= least)
        i_all, j_all = i_all + a, j_all + skip
        ok = ids[i_all] != other_ids[j_all]
        if alone:
            ok &= i_all < j_all
        i_all, j_all = i_all[ok], j_all[ok]
        for g, e in _chunks(len(i_all), dim):
            i, j = i_all[g:e], j_all[g:e]
            cosine = np.einsum("ij,ij->i", x[i], y[j])
            ok = cosine >= threshold
            if ok.any():
                yield ids[i[ok]], other_ids[j[ok]], cosine[ok]


def _all_pairs(base: DataFrame, dim: int, n: int, threshold: float, tile_vectors: int = TILE_VECTORS) -> DataFrame:
    """Pairs among the ``n`` rows of ``base``, all of dimension ``dim``, by
    looking at all: ``vec_a, vec_b, cosine``, once for each pair of rows.

    Rows are dealt to blocks, and each two blocks, or one by itself, are a tile.
    A task holds one tile at a time and gives its pairs as it finds them, so its
    memory depends on the size of a block alone.
    """
    blocks = -(-n // min(tile_vectors, max(1, TILE_NUMBERS // max(1, dim))))
    tiles = blocks * (blocks + 1) // 2
    parted = min(tiles, TILE_PARTITIONS)
    # Numbered once and written: a block must be the same whenever it is read.
    placed = cut(base.select("vec_id", "embedding").withColumn("_at", F.monotonically_increasing_id()))
    own, other = F.col("_own"), F.col("_other")
    high = F.greatest(own, other)
    sides = placed.select("vec_id", "embedding", F.pmod(F.xxhash64("_at"), F.lit(blocks)).alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_other"))
    dealt = sides.select((F.floor(high * (high + 1) / 2) + F.least(own, other)).alias("tile"), (other < own).alias("second"), "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(first: list, second: list):
            if not first:
                return
            sides = [[np.concatenate(c) for c in zip(*side)] if side else [None, None] for side in (first, second)]
            for a, b, cosine in tile_pairs(*sides[0], *sides[1], threshold):
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine)], names=["vec_a", "vec_b", "cosine"])

        at, held = None, ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, second = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (second[1:] != second[:-1])))
            for begin, end in zip(begins, np.append(begins[1:], len(tile))):
                if tile[begin] != at:
                    if at is not None and (held[1] or is_single(at)):
                        yield from pairs(*held)
                    at, held = tile[begin], ([], [])
                part = batch.slice(begin, end - begin)
                held[int(second[begin])].append((part.column(2).to_numpy(), vectors_of(part.column(3), dim)))
        if at is not None and (held[1] or is_single(at)):
            yield from pairs(*held)

    def is_single(tile: int) -> bool:
        """Whether a tile is a block by itself, the last of its row."""
        row = (math.isqrt(8 * int(tile) + 1) - 1) // 2
        return int(tile) == row * (row + 3) // 2

    return dealt.repartitionById(parted, F.pmod("tile", F.lit(parted)).cast("int")).sortWithinPartitions("tile", "second").mapInArrow(run, "vec_a long, vec_b long, cosine double")


def _with_cosine(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", "embedding").where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(embedding, x -> x <> 0)"
    )


def _searched(base: DataFrame, search: Callable[..., DataFrame], *settings) -> DataFrame:
    """``search`` by dimension: vectors of different ones have no cosine with
    each other."""
    found = [
        search(base.where(F.size("embedding") == r["d"]), r["d"], r["count"], *settings)
        for r in base.groupBy(F.size("embedding").alias("d")).count().where("count > 1").orderBy("d").collect()
    ]
    return reduce(DataFrame.unionByName, found) if found else base.sparkSession.createDataFrame([], _FOUND)


def near_pairs(
    embeddings: DataFrame, threshold: float = THRESHOLD, deviations: float = DEVIATIONS, parts: int = PARTS, words: int = WORDS, passes: int = PASSES, block_vectors: int = BLOCK_VECTORS, task_queries: int = TASK_QUERIES
) -> DataFrame:
    """All pairs of vectors whose cosine reaches ``threshold``.

    Vectors are scaled to unit length and put in ``LISTS`` times the square root
    of their number of inverted lists; residuals are coded by parts.  Lists and
    codebooks are learned from all vectors by Spark passes of Lloyd's method.
    Every vector is a query; each dimension that occurs is searched by itself.
    It probes each list whose plane is within ``deviations`` (see
    :func:`margin_of`), is compared by table lookup with a bound that no pair
    above the threshold fails, and reranked by exact cosine.  So the only pairs
    that may be missed are those beyond the margin on both sides.

    Infinite ``deviations`` lose none: probes would ask most lists then, so
    nothing is learned and all pairs are looked at (:func:`_all_pairs`), in time
    quadratic in the vectors, in tasks of bounded memory.

    Result, one row for each pair of ids: ``vec_a < vec_b, cosine``.  A cosine
    equal to the threshold counts, within the rounding of a double.  Vectors
    that are null, hold a null or NaN, or are all 0 have no cosine here and take
    no part, and neither do rows of null ``vec_id``; vectors of different
    dimensions are no pair.  Of rows with one ``vec_id`` the
    pairs of each count, once, with the largest cosine; they are no pair of
    each other.  Further columns are ignored; an empty table gives an empty
    result.
    """
    base = _with_cosine(embeddings).select(F.col("vec_id").cast("long"), "embedding", F.lit(1).cast("long").alias("weight"), F.lit(True).alias("apart"))
    if math.isinf(deviations):
        found = _searched(base, _all_pairs, threshold)
    else:
        found = _searched(base, _search, threshold, deviations, parts, words, passes, block_vectors, task_queries)
    # Each pair of rows comes once, so pairs are put together only where ids have several rows.
    if base.groupBy("vec_id").count().where("count > 1").head(1):
        return found.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))
    return found.select("vec_a", "vec_b", "cosine")


def _without_copies(valid: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows to search (``vec_id, embedding, weight, apart``), and the class of
    copies of each id that has some: ``vec_id, rep, weight``.

    Of equal vectors that of least id stays, with their number as its weight.
    An id of several different vectors is ``apart``: it may meet a partner by
    more than one of them, so its pairs have to be told from each other.
    """
    one, no = F.lit(1).cast("long").alias("weight"), F.lit(False).alias("apart")
    valid, apart, copies = valid.select(F.col("vec_id").cast("long"), "embedding"), None, None
    again = cut(valid.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if again.head(1):
        rows = valid.join(again, "vec_id", "left_semi").distinct()
        rows = cut(rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("vec_id"))))
        valid = cut(valid.join(again, "vec_id", "left_anti").unionByName(rows.where("n = 1").drop("n")))
        apart = rows.where("n > 1").select("vec_id", "embedding", one, F.lit(True).alias("apart"))
    digest = F.xxhash64("embedding")
    alike = cut(valid.groupBy(digest.alias("h")).count().where("count > 1").select("h"))
    base = valid.select("vec_id", "embedding", one, no)
    if alike.head(1):
        hashed = valid.withColumn("h", digest)
        same = cut(hashed.join(alike, "h", "left_semi").drop("h"))
        reps = cut(same.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
        copies = cut(same.join(reps.where("weight > 1"), "embedding").select("vec_id", "rep", "weight"))
        base = hashed.join(alike, "h", "left_anti").select("vec_id", "embedding", one, no).unionByName(reps.select(F.col("rep").alias("vec_id"), "embedding", "weight", no))
    if apart is not None:
        base = base.unionByName(apart)
    return (base if apart is None and copies is None else cut(base)), copies


def near_classes(
    embeddings: DataFrame, threshold: float = THRESHOLD, deviations: float = DEVIATIONS, parts: int = PARTS, words: int = WORDS, passes: int = PASSES, block_vectors: int = BLOCK_VECTORS, task_queries: int = TASK_QUERIES
) -> DataFrame:
    """Class and number of links of every vector, a link being a pair of
    :func:`near_pairs` and a class what links join, directly or not.

    Every link is looked at as there, and counted in the task that finds it.  A
    task gives one row for each vector that has links in it, so what is shuffled
    and returned doesn't grow with the pairs.  Equal vectors are searched as one
    and their links multiplied.

    Result, one row for each row of ``embeddings``: ``vec_id, class_id`` (least
    ``vec_id`` of the class), ``links`` (ids linked to this one).  What has no
    link is a class of its own, and so is what has no cosine; rows of null
    ``vec_id`` have a null class.  Rows of one ``vec_id`` get the same result:
    the links of any count, once.  Further columns are ignored; an empty table
    gives an empty result.
    """
    base, copies = _without_copies(_with_cosine(embeddings))
    found = cut(_searched(base, _search, threshold, deviations, parts, words, passes, block_vectors, task_queries))
    pairs = found.where("cosine IS NOT NULL").dropDuplicates(["vec_a", "vec_b"])
    counted = found.where("cosine IS NULL").select("vec_a", "links_a").unionByName(pairs.select("vec_a", "links_a")).unionByName(pairs.select(F.col("vec_b").alias("vec_a"), F.col("links_b").alias("links_a")))
    links = counted.groupBy(F.col("vec_a").alias("rep")).agg(F.sum("links_a").alias("links"))
    roots = components(found.select(F.col("vec_a").alias("a"), F.col("vec_b").alias("b"))).withColumnRenamed("id", "rep")
    stats = links.join(roots, "rep", "left")
    rows = embeddings.select("vec_id")
    rows = rows.select("vec_id", F.col("vec_id").alias("rep"), F.lit(1).alias("weight")) if copies is None else rows.join(copies, "vec_id", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"))
    return rows.join(stats, "rep", "left").select("vec_id", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))


def oracle(threshold: float) -> str:
    return f"""
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {threshold}
"""


ORACLE = oracle(THRESHOLD)


def classes_oracle(threshold: float) -> str:
    """All pairs by exact cosine, and the components of what they join."""
    return f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {threshold} ELSE false END),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
root AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY 1),
degree AS (SELECT a AS vec_id, count(*) AS links FROM link GROUP BY 1)
SELECT vec_id, least(vec_id, coalesce(root.least, vec_id)) AS class_id, coalesce(degree.links, 0) AS links
FROM embeddings LEFT JOIN root USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


CLASSES_ORACLE = classes_oracle(THRESHOLD)
