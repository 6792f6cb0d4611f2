"""Exact top-k inner-product search with vector-approximation files.

Components become integers, ``floor(SCALE * x)``. A component's cell is its leading ``BITS``
bits below the vector's largest one, so a vector's cells bound its product with a query from below and above.
The approximation file holds a byte for each component and is written once. The first scan reads that file
only: the k-th largest lower bound over all vectors is a score that the k-th result reaches.
The second scan takes exact vectors, in each block in order of their lower bounds, as long
as the upper bound can still reach the k-th score; the k best are then certain.

Queries go to the tasks in lots of at most ``QUERY_BYTES``, whatever their number; each lot is
held against all vectors in blocks of ``BLOCK_ROWS``.

Defined results: rows with a null key, and vectors that are null or hold a null or a non-finite
component, take no part. Products beyond 64-bit integers are added up exactly; a component or a
score that is itself no 64-bit integer ends the query with an error. Only vectors of equal length are
compared. A key names its row: no row with a query's key is a candidate of that query, and
exact repeats of a query row are one query; repeated candidates count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SCALE = 1024
BITS = 6
BLOCK_ROWS = 4096
QUERY_TILE = 1024
QUERY_BYTES = 32 << 20
NOTHING = np.iinfo(np.int64).min


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and integer vectors of one length, in blocks."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(lo, BLOCK_ROWS)
            keys = part.column(0).to_numpy(zero_copy_only=False)
            lists = part.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            flat = np.floor(SCALE * flat.astype(np.float64))
            if np.abs(flat).max(initial=0) >= 2.0**62:
                raise OverflowError("a component is too large for 64-bit scores")
            flat = flat.astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                yield keys[at], flat[(starts[at][:, None] + np.arange(size)).reshape(-1)].reshape(len(at), size)


class Cells:
    """A block of vectors as cells: ``corners`` (the lowest value of each component) and ``wide`` (by how
    much a component of the vector can exceed it)."""

    def __init__(self, keys: np.ndarray, cells: np.ndarray, shift: np.ndarray):
        self.keys, self.corners = keys, cells.astype(np.int64) << shift.astype(np.int64)[:, None]
        self.wide = (np.int64(1) << shift.astype(np.int64)) - 1
        self.top = float(np.abs(self.corners).max(initial=0)) + float(self.wide.max(initial=0)) + 1

    @classmethod
    def of(cls, keys: np.ndarray, vectors: np.ndarray) -> Cells:
        return cls(keys, *_cells(vectors))


def _cells(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each component's cell (a signed byte) and the number of bits that each vector's cells leave out."""
    bits = np.frexp(np.abs(vectors).max(axis=1, initial=0).astype(np.float64))[1]
    shift = np.maximum(0, bits + 1 - BITS)
    return (vectors >> shift.astype(np.int64)[:, None]).astype(np.int8), shift.astype(np.int8)


def _approximated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the approximation file."""
    for keys, vectors in _blocks(batches):
        cells, shift = _cells(vectors)
        n, size = cells.shape
        packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cells))])
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(shift), packed], names=["key", "shift", "cells"])


def _cell_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Cells]:
    """Blocks of vectors of one length, from the approximation file."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(lo, BLOCK_ROWS)
            keys, shift, cells = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_pylist()
            sizes = np.fromiter(map(len, cells), np.int64, len(cells))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                yield Cells(keys[at], np.frombuffer(b"".join([cells[i] for i in at]), np.int8).reshape(len(at), size), shift[at])


class Lot:
    """Queries of one length with the k-th scores known so far."""

    def __init__(self, places: np.ndarray, keys: np.ndarray, vectors: np.ndarray, reach: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.places, self.keys, self.q, self.reach = places[order], keys[order], vectors[order], reach[order]
        self.plus = np.where(self.q > 0, self.q, 0).sum(1, dtype=np.float64)
        self.minus = np.where(self.q < 0, self.q, 0).sum(1, dtype=np.float64)
        self.size = int(np.abs(self.q).max(initial=0))

    def bounds(self, block: Cells) -> Iterator[tuple[int, np.ndarray]]:
        """For each tile of queries: first query, the product with the cells' lower corners
        (-inf for the query's own row)."""
        kind = np.float32 if block.corners.shape[1] * max(1, self.size) * block.top < 1 << 24 else np.float64
        corners = block.corners.T.astype(kind)
        first, last = np.searchsorted(self.keys, block.keys, "left"), np.searchsorted(self.keys, block.keys, "right")
        own = [(q, v) for v in np.flatnonzero(last > first) for q in range(first[v], last[v])]
        for lo in range(0, len(self.q), QUERY_TILE):
            near = (self.q[lo : lo + QUERY_TILE].astype(kind) @ corners).astype(np.float64)
            for q, v in own:
                if lo <= q < lo + QUERY_TILE:
                    near[q - lo, v] = -np.inf
            yield lo, near

    def slack(self, block: Cells) -> float:
        """What rounding can add to a bound; none while sums stay below 2^53."""
        most = float(block.corners.shape[1]) * self.size * block.top
        return 0.0 if most < 2.0**52 else most * 2.0**-48


def _lots(packed: list[tuple[int, int, np.ndarray]], reach: np.ndarray | None) -> dict[int, Lot]:
    out = {}
    for size in {len(v) for _, _, v in packed}:
        rows = [r for r in packed if len(r[2]) == size]
        places = np.array([r[0] for r in rows])
        out[size] = Lot(places, np.array([r[1] for r in rows]), np.stack([r[2] for r in rows]).astype(np.int64).reshape(len(rows), size), np.full(len(rows), -np.inf) if reach is None else reach[places])
    return out


def _lower_bounds(lots: dict[int, Lot], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors, the k largest lower bounds of each query."""
    best: dict[int, np.ndarray] = {}
    for block in _cell_blocks(batches):
        size = block.corners.shape[1]
        lot = lots.get(size)
        if lot is None:
            continue
        held = best.setdefault(size, np.full((len(lot.q), k), -np.inf))
        slack = lot.slack(block)
        for lo, near in lot.bounds(block):
            rows = slice(lo, lo + len(near))
            low = near + np.outer(lot.minus[rows], block.wide) - slack
            if low.shape[1] > k:
                low = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
            both = np.concatenate([held[rows], low], axis=1)
            held[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    for size, held in best.items():
        some = np.isfinite(held).any(axis=1)
        lows = [r[np.isfinite(r)] for r in held[some]]
        yield pa.record_batch([pa.array(lots[size].places[some], pa.int64()), pa.array(lows, pa.list_(pa.float64()))], names=["q", "lows"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows, as 64-bit integers."""
    if float(a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    sums = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]
    if any(abs(s) >= 2**63 for s in sums):
        raise OverflowError("a score is no 64-bit integer")
    return np.array(sums, dtype=np.int64)


class _Best:
    """The k best (query, score, key) triples seen in a task."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.q, self.score, self.key = (np.empty(0, np.int64) for _ in range(3))
        self.kth = np.full(n, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        q, score, key = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.key, key])
        order = np.lexsort((key, -score, q))
        q, score, key = q[order], score[order], key[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = rank == self.k - 1
        self.kth[q[last]] = score[last]
        stay = rank < self.k
        self.q, self.score, self.key = q[stay], score[stay], key[stay]


def _exact(lots: dict[int, Lot], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors, those that can be among the k best of a query, with exact scores."""
    best: dict[int, _Best] = {}
    for keys, vectors in _blocks(batches):
        lot = lots.get(vectors.shape[1])
        if lot is None:
            continue
        held = best.setdefault(vectors.shape[1], _Best(len(lot.q), k))
        block = Cells.of(keys, vectors)
        slack, wide = lot.slack(block), block.wide
        for lo, near in lot.bounds(block):
            rows = slice(lo, lo + len(near))
            least = np.maximum(lot.reach[rows], held.kth[rows])
            high = near + np.outer(lot.plus[rows], wide) + slack
            q, v = np.nonzero((high >= least[:, None]) & np.isfinite(near))
            low = near[q, v] + lot.minus[rows][q] * wide[v]
            order = np.lexsort((-low, q))
            q, v = q[order], v[order]
            high = high[q, v]
            while len(q):  # the next 2k of each query, best bounds first; then what still can matter
                starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                now = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < 2 * k
                for part in np.array_split(np.flatnonzero(now), max(1, int(now.sum()) * vectors.shape[1] // (1 << 22))):
                    score = _products(lot.q[q[part] + lo], vectors[v[part]])
                    held.add(q[part] + lo, score, keys[v[part]])
                q, v, high = q[~now], v[~now], high[~now]
                can = high >= np.maximum(lot.reach[q + lo], held.kth[q + lo])
                q, v, high = q[can], v[can], high[can]
    for size, held in best.items():
        some = held.score >= lots[size].reach[held.q]
        yield pa.record_batch([pa.array(lots[size].places[held.q[some]], pa.int64()), pa.array(held.key[some], pa.int64()), pa.array(held.score[some], pa.int64())], names=["q", "key", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``key`` and ``score``: the k highest scores of each row
    of ``vectors`` for which ``is_query`` holds, ties to the smaller key."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector}`").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(f"`{key}`").isNotNull() & good).select(F.col(f"`{key}`").cast("bigint").alias("key"), v.alias("v"), is_query.alias("query"))
    queries = rows.filter("query").select("key", "v").distinct()
    n, widest = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    lots = max(1, -(-n * 8 * max(1, widest) // query_bytes))
    found, cells = [], None
    for i in range(lots):
        # A lot holds query_bytes on average; its rows go to every task.
        got = sorted(queries.filter(F.pmod(F.xxhash64("key", "v"), F.lit(lots)) == i).collect())
        packed = [(p, r["key"], np.floor(SCALE * np.array(r["v"], np.float64)).astype(np.int64)) for p, r in enumerate(got)]
        first = spark.sparkContext.broadcast(packed)
        if cells is None:
            cells = durable(rows.select("key", "v").mapInArrow(_approximated, "key bigint, shift tinyint, cells binary"), "cells")
        bounds = cells.mapInArrow(lambda b, s=first: _lower_bounds(_lots(s.value, None), k, b), "q bigint, lows array<double>")
        # k numbers from each task for a query: its own group, merged before and after the shuffle.
        kth = bounds.groupBy("q").agg(F.get(F.sort_array(F.flatten(F.collect_list("lows")), asc=False), F.lit(k - 1)).alias("kth")).filter("kth is not null")
        reach = np.full(len(packed), -np.inf)
        for r in kth.collect():
            reach[r["q"]] = r["kth"]
        second = spark.sparkContext.broadcast((packed, reach))
        best = rows.select("key", "v").mapInArrow(lambda b, s=second: _exact(_lots(*s.value), k, b), "q bigint, key bigint, score bigint")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(p, q) for p, q, _ in packed], "q bigint, query_id bigint")
        out = ranked.join(F.broadcast(names), "q").select("query_id", "rank", F.col("key").alias(key), "score")
        found.append(durable(out, "found") if lots > 1 else out)
    return reduce(DataFrame.union, found)
