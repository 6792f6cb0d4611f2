"""Nearest neighbours as a join, and the local outlier factor over all rows.

Space is cut into the cells of some pivots: each row belongs to its nearest one. A row first meets the rows of its own
cell; the distance of its k-th neighbour there bounds which other cells can hold a nearer one, by the cells' radii and by
the planes between pivots. It visits those and no others, so the k neighbours are certain. Cells are brought together by
shuffling; a cell that very many rows visit is dealt to several tasks. Reachability and density are joins over the neighbour table.
The driver sees pivots and cell sizes only.

All rows judge each other by their places: rows of equal values have the same neighbours, density and factor, so a place with its number of rows
and its smallest keys (for ties) stands for them. Places fall in cells of some ``CELL`` each, halved as a tree over a bounded sample. A cell is one row of
arrays, whose task finds neighbours in a tree of boxes; only what balls across borders reach travels to the cells that need it, and k-th
distances, densities and factors are a pass each over cells and those borders. The driver sees the cells' boxes.

Where a caller sets ``lof_switch``, larger tables are judged against a bounded sample and don't move: the sample with its densities, ``lof_rows`` rows at
most, is broadcast like the trees of a forest, and each batch of rows looks its neighbours up in such a tree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..session import written
from .profile import col
from .sampling import hash_sample

#: Cells; rows that one task compares with a cell's rows; distances that it holds at once.
PIVOTS, VISITORS, HELD = 256, 20_000, 2_000_000
#: Least rows of a leaf of a tree of boxes; visits to leaves that are compared at once.
LEAF, VISITED = 32, 16_384
#: Places of a cell, about; rows of the sample that cuts are chosen by, for each cell.
CELL, OF_CELL = 16_384, 32


def _points(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), d)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):  # summed in the order of the columns, so that equal distances are equal
        total += (x[:, j, None] - y[None, :, j]) ** 2
    return np.sqrt(total)


def _in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (``key``, ``x``) with ``cell`` and ``off``, the distance from its pivot."""
    d = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _points(b.column(1), d)
            cells, offs = [], []
            for lo in range(0, len(x), 4096):
                dist = _distances(x[lo : lo + 4096], pivots)
                cell = dist.argmin(1)
                cells.append(cell)
                offs.append(dist[np.arange(len(dist)), cell])
            yield pa.record_batch([*b.columns, pa.array(np.concatenate(cells) if cells else [], pa.int32()), pa.array(np.concatenate(offs) if offs else [], pa.float64())], names=[*b.schema.names, "cell", "off"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, x array<double>, cell int, off double")


def _met(visits: DataFrame, base: DataFrame, k: int, d: int) -> DataFrame:
    """``key`` and ``near`` (up to ``k`` pairs of distance and key, within ``within``) for every visit (``key``, ``x``, ``cell``, ``within``)
    to a cell of ``base``."""
    kind = visits.schema["key"].dataType.simpleString()
    sizes = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
    parts = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, -(-n // VISITORS))]) if sizes else None
    if parts is None:
        return visits.select("key", F.array().cast(f"array<struct<d:double,nb:{kind}>>").alias("near"))
    left = visits.withColumn("part", F.pmod(F.xxhash64("key"), parts[F.col("cell")]).cast("int"))
    right = base.filter(F.col("cell").isin(*sizes)).select(F.col("key").alias("nb"), F.col("x").alias("y"), "cell", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)).alias("part"))

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        r = r.sort_by("nb")
        x, y, within = _points(q["x"], d), _points(r["y"], d), q["within"].to_numpy()
        own = pc.fill_null(pc.index_in(q["key"].combine_chunks(), value_set=r["nb"].combine_chunks()), -1).to_numpy()
        ends, dist, at = [np.zeros(1, np.int64)], [], []
        step = max(1, HELD // max(1, len(y)))
        for lo in range(0, len(x), step):
            found = _distances(x[lo : lo + step], y)
            n = len(found)
            mine = own[lo : lo + n]
            found[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.inf
            limit = within[lo : lo + n].copy()
            if found.shape[1] > k:
                limit = np.minimum(limit, np.partition(found, k - 1, axis=1)[:, k - 1])
            row, place = np.nonzero((found <= limit[:, None]) & np.isfinite(found))
            value = found[row, place]
            by = np.lexsort((place, value, row))  # rows of r are in order of key: ties go to the smaller
            row, place, value = row[by], place[by], value[by]
            first = np.searchsorted(row, np.arange(n))
            few = np.arange(len(row)) - first[row] < k
            ends.append(np.cumsum(np.bincount(row[few], minlength=n)) + ends[-1][-1])
            dist.append(value[few])
            at.append(place[few])
        keys = r["nb"].combine_chunks().take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(dist) if dist else np.zeros(0)), keys], names=["d", "nb"])
        return pa.table({"key": q["key"], "near": pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pairs)})

    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(meet, f"key {kind}, near array<struct<d:double,nb:{kind}>>")


def nearest(queries: DataFrame, base: DataFrame, key: str, columns: list[str], k: int, config: Config = DEFAULT, same: bool = False) -> DataFrame:
    """``key`` and ``near``, the ``k`` rows of ``base`` nearest to each row of ``queries`` but itself, as (``d``, ``nb``) by distance and key.
    ``same``: both are one table. Values are taken in single precision, as the models have them."""
    d = len(columns)
    point = F.array(*[col(c).cast("float").cast("double") for c in columns])
    pool = base.select(col(key).alias("key"), point.alias("x"))
    pivots = np.unique(np.array([r["x"] for r in hash_sample(pool, "key", PIVOTS, config.seed).collect()]).reshape(-1, d), axis=0)
    pool = written(_in_cells(pool, pivots))
    rows = pool if same else written(_in_cells(queries.select(col(key).alias("key"), point.alias("x")), pivots))
    stats = {r["cell"]: (r["n"], r["r"]) for r in pool.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("r")).collect()}
    counts = np.array([stats.get(c, (0, 0.0))[0] for c in range(len(pivots))])
    radii = np.array([stats.get(c, (0, 0.0))[1] for c in range(len(pivots))])
    first = written(_met(rows.select("key", "x", "cell", F.lit(float("inf")).alias("within")), pool, k, d))
    bounded = rows.join(first.select("key", F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))["d"]).otherwise(float("inf")).alias("within")), "key")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own, within = _points(b.column(1), d), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).copy()
            for lo in range(0, len(x), 2048):
                part = slice(lo, lo + 2048)
                dist = _distances(x[part], pivots)
                limit = within[part]
                open_ = np.flatnonzero(~np.isfinite(limit))
                if len(open_):  # own cell too small: the nearest cells that surely hold enough
                    far = dist[open_] + radii
                    order = np.argsort(far, axis=1)
                    enough = (np.cumsum(counts[order], axis=1) >= k + 1).argmax(1)
                    total = np.cumsum(counts[order], axis=1)[:, -1] >= k + 1
                    limit[open_] = np.where(total, far[np.arange(len(open_)), order[np.arange(len(open_)), enough]], np.inf)
                apart = np.sqrt(((pivots[own[part]][:, None, :] - pivots[None]) ** 2).sum(-1))
                mine = dist[np.arange(len(dist)), own[part]]
                # a point of another cell lies beyond the plane between the pivots, and within its cell's radius
                plane = (dist**2 - mine[:, None] ** 2) / np.maximum(2 * apart, 1e-300)
                least = np.maximum(np.maximum(dist - radii, plane), 0.0)
                go = (least * (1 - 1e-9) - 1e-12 <= limit[:, None]) & (counts > 0)
                go[np.arange(len(dist)), own[part]] = False
                row, cell = np.nonzero(go)
                take = pa.array(row + lo)
                yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(cell, pa.int32()), pa.array(limit[row] * (1 + 1e-12))], names=["key", "x", "cell", "within"])

    kind = pool.schema["key"].dataType.simpleString()
    others = written(bounded.select("key", "x", "cell", "within").mapInArrow(visits, f"key {kind}, x array<double>, cell int, within double"))
    both = first.unionByName(_met(others, pool, k, d)).groupBy("key").agg(F.flatten(F.collect_list("near")).alias("near"))  # k a cell
    return both.select("key", F.slice(F.array_sort("near"), 1, k).alias("near"))


def _joined(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The boxes of a tree by level, the root's first, from those of its leaves; an empty one ends before it begins."""
    boxes = [(low, high)]
    while len(low) > 1:
        low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
        boxes.insert(0, (low, high))
    return boxes


def _leaf(x: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf that each of ``x`` falls in by the sides and values of a tree's ``cuts``."""
    leaf = np.zeros(len(x), dtype=np.int64)
    for sides, values in cuts:
        leaf = 2 * leaf + (x[np.arange(len(x)), sides[leaf]] >= values[leaf])
    return leaf


def _reached(x: np.ndarray, reach: np.ndarray, boxes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one of ``x`` and a leaf whose box lies within its ``reach``."""
    q, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for low, high in boxes[1:]:
        q, node = np.repeat(q, 2), np.repeat(2 * node, 2)
        node[1::2] += 1
        total = np.zeros(len(q))
        for j in range(x.shape[1]):
            at = x[:, j].take(q)
            total += np.maximum(np.maximum(low[:, j].take(node) - at, at - high[:, j].take(node)), 0.0) ** 2
        go = (np.sqrt(total) * (1 - 1e-9) - 1e-12 <= reach.take(q)) & (low[:, 0].take(node) <= high[:, 0].take(node))
        q, node = q[go], node[go]
    return q, node


class _Tree:
    """Points (``x``, in order of their keys) in the leaves of a tree of boxes, halved along their widest sides. ``near`` is exact: a
    query visits all leaves that its k-th distance reaches."""

    def __init__(self, x: np.ndarray, k: int):
        # of rows in one place only the first k + 1 can be neighbours: ties go to the smaller key
        place = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
        by = np.argsort(place, kind="stable")
        ends = np.flatnonzero(np.r_[True, np.diff(place[by]) > 0]) if len(by) else by
        kept = np.arange(len(by)) - np.repeat(ends, np.diff(np.r_[ends, len(by)])) <= k
        rank = np.sort(by[kept])
        rank = rank[np.isfinite(x[rank]).all(1)]
        self.k, self.levels = k, max(0, int(np.log2(max(1, len(rank) / max(LEAF, 2 * k + 2)))))
        parts, self.cuts = [rank], []
        for _ in range(self.levels):
            halves, cuts = [], []
            for part in parts:
                side = int(np.argmax(np.ptp(x[part], axis=0)))
                order = np.argpartition(x[part, side], len(part) // 2)
                cuts.append((side, x[part[order[len(part) // 2]], side]))
                halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
            self.cuts.append((np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])))
            parts = halves
        self.rows = np.full((len(parts), max(1, max(map(len, parts)))), len(x))  # a leaf's rows by key; beyond them a row far away
        for i, part in enumerate(parts):
            self.rows[i, : len(part)] = np.sort(part)
        self.x = np.vstack([x, np.full((1, x.shape[1]), np.inf)])
        low = np.array([x[p].min(0) if len(p) else np.full(x.shape[1], np.inf) for p in parts])
        high = np.array([x[p].max(0) if len(p) else np.full(x.shape[1], -np.inf) for p in parts])
        self.boxes = _joined(low, high)

    def _far(self, x: np.ndarray, own: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The distances of each of ``x`` from the rows of its ``leaf``, its own row infinitely far."""
        rows = self.rows[leaf]
        total = np.zeros(rows.shape)
        for j in range(x.shape[1]):
            total += (x[:, j, None] - self.x[:, j].take(rows)) ** 2
        total[rows == own[:, None]] = np.inf
        return np.sqrt(total)

    def near(self, x: np.ndarray, own: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, distance and row of the ``k`` points nearest to each of the finite ``x``, by query and distance; ties at the end go to the smaller
        row. ``own`` is the row that is a query itself, or -1; ``within`` bounds the distances."""
        found = [self._near(x[lo : lo + 1024], own[lo : lo + 1024], None if within is None else within[lo : lo + 1024]) for lo in range(0, len(x), 1024)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        return np.concatenate([q + 1024 * i for i, (q, _, _) in enumerate(found)]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])

    def _near(self, x: np.ndarray, own: np.ndarray, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, leaf = len(x), _leaf(x, self.cuts)
        near = self._far(x, own, leaf)
        reach = np.partition(near, self.k - 1, axis=1)[:, self.k - 1] if near.shape[1] >= self.k else np.full(n, np.inf)
        if within is not None:
            reach = np.minimum(reach, within)
        q, node = _reached(x, reach, self.boxes)
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for lo in range(0, len(q), VISITED):
            of, leaves = q[lo : lo + VISITED], node[lo : lo + VISITED]
            far = self._far(x[of], own[of], leaves)
            pair, place = np.nonzero((far <= reach[of][:, None]) & np.isfinite(far))
            found.append((of[pair], far[pair, place], self.rows[leaves[pair], place]))
        q, far, row = (np.concatenate(c) for c in zip(*found))
        by = np.argsort(far, kind="stable")
        by = by[np.argsort(q[by].astype(np.uint16), kind="stable")]
        q, far, row = q[by], far[by], row[by]
        starts = np.searchsorted(q, np.arange(n))
        place = np.arange(len(q)) - starts[q]
        # where the k-th distance is also the next one's, the smaller keys come first
        last = starts + self.k
        tied = np.zeros(n, dtype=bool)
        more = np.flatnonzero(np.bincount(q, minlength=n) > self.k)
        tied[more] = far[last[more]] == far[last[more] - 1]
        some = np.flatnonzero(tied[q])
        if len(some):
            by = some[np.lexsort((row[some], far[some], q[some]))]
            far[some], row[some] = far[by], row[by]
        few = place < self.k
        return q[few], far[few], row[few]


class _Judges(_Tree):
    """Rows of a sample (points ``x`` in order of their keys, distances ``kd`` of their k-th neighbours, densities ``lrd``) as a tree."""

    def __init__(self, x: np.ndarray, kd: np.ndarray, lrd: np.ndarray, k: int):
        super().__init__(x, k)
        self.kd, self.lrd = np.append(kd, np.nan), np.append(lrd, np.nan)

    def factors(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The local outlier factor of each of ``x``; ``own`` is its place among the keys, or -1. 1 where there are no neighbours."""
        out = np.ones(len(x))
        known = np.flatnonzero(np.isfinite(x).all(1))
        for lo in range(0, len(known), 1024):
            out[known[lo : lo + 1024]] = self._factors(x[known[lo : lo + 1024]], own[known[lo : lo + 1024]])
        return out

    def _factors(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        n = len(x)
        q, far, row = self._near(x, own, None)
        count = np.bincount(q, minlength=n)
        dense = ~np.isnan(self.lrd[row])
        with np.errstate(divide="ignore", invalid="ignore"):
            own_density = 1 / (np.bincount(q, np.fmax(far, self.kd[row]), n) / count + 1e-10)
            around = np.bincount(q[dense], self.lrd[row[dense]], n) / np.bincount(q[dense], minlength=n)
            return np.where(np.isfinite(around), around / own_density, 1.0)


def _judged(df: DataFrame, judges: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """``df`` and ``lof`` by ``judges`` (``key``, ``x``, ``kd``, ``lrd``), a bounded sample."""
    held = judges.toArrow().sort_by("key")
    number = lambda c: held[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    tree = _Judges(_points(held["x"], len(columns)), number("kd"), number("lrd"), k)
    sent = df.sparkSession.sparkContext.broadcast((tree, held["key"].combine_chunks()))

    @F.arrow_udf("double")
    def lof(keys: pa.Array, *values: pa.Array) -> pa.Array:
        tree, names = sent.value
        own = pc.fill_null(pc.index_in(keys, value_set=names), -1).to_numpy(zero_copy_only=False)
        return pa.array(tree.factors(np.stack([v.to_numpy(zero_copy_only=False) for v in values], axis=1), own))

    return df.withColumn("lof", lof(col(key), *[col(c).cast("float").cast("double") for c in columns]))


def _places(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """``x0``, ``x1``... and ``keys`` (the smallest in order, up to k + 1 of them) of each place that holds rows of finite values."""
    names = [f"x{i}" for i in range(len(columns))]
    rows = df.select(col(key).alias("key"), *[col(c).cast("float").cast("double").alias(n) for c, n in zip(columns, names)]).dropna(subset=["key", *names])
    for n in names:
        rows = rows.filter(~F.isnan(n) & (F.abs(n) < float("inf")))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*names).orderBy("key"))).filter(F.col("r") <= k + 1)
    return first.groupBy(*names).agg(F.array_sort(F.collect_list("key")).alias("keys"))


def _halved(x: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """So many levels of cuts that halve the sample ``x``."""
    parts, cuts = [x], []
    for _ in range(levels):
        now, halves = [], []
        for part in parts:
            side = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = np.partition(part[:, side], len(part) // 2)[len(part) // 2] if len(part) else np.inf
            now.append((side, value))
            halves += [part[part[:, side] < value], part[part[:, side] >= value]]
        cuts.append((np.array([c[0] for c in now]), np.array([c[1] for c in now])))
        parts = halves
    return cuts


def _list(values: np.ndarray | pa.Array) -> pa.Array:
    """One row that holds all ``values``."""
    values = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _flat(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks().flatten()


class _Cell:
    """The places of a cell in order of their smallest keys, then those of its border: ``x``, the number of keys that each holds, all keys."""

    def __init__(self, own: pa.Table, border: pa.Table | None, d: int, k: int):
        more = [] if border is None or not border.num_rows else [border.sort_by("key")]
        self.k, self.n = k, len(_flat(own, "key"))
        self.x = np.vstack([_flat(own, "x").to_numpy().reshape(-1, d)] + [_points(b["x"], d) for b in more])
        self.held = np.concatenate([_flat(own, "held").to_numpy()] + [pc.list_value_length(b["keys"].combine_chunks()).to_numpy() for b in more]).astype(np.int64)
        self.keys = pa.concat_arrays([_flat(own, "keys")] + [_flat(b, "keys") for b in more])
        self.starts = np.cumsum(self.held) - self.held
        self.border = more[0] if more else None

    def beside(self, own: np.ndarray, column: str) -> np.ndarray:
        """``own`` (of its places) and ``column`` of the border."""
        return own if self.border is None else np.concatenate([own, self.border[column].to_numpy()])

    def settled(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of its places ``which``: the places of up to ``k`` neighbours (else -1), the neighbours in each, the k-th distance, the number of
        neighbours. Rows in the same place come first; ties go to the smaller key."""
        ranks = np.empty(len(self.keys), np.int64)
        ranks[pc.sort_indices(self.keys).to_numpy()] = np.arange(len(self.keys))
        order = np.argsort(ranks[self.starts])
        own = np.empty(len(order), np.int64)
        own[order] = np.arange(len(order))
        q, far, row = _Tree(self.x[order], self.k).near(self.x[which], own[which])
        row = order[row]
        left = self.k - np.minimum(self.held[which] - 1, self.k)
        taken = np.ones(len(q), np.int64)
        if (self.held[row] > 1).any() or (left < self.k).any():
            times = self.held[row]
            of = np.repeat(np.arange(len(q)), times)
            within = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            by = np.lexsort((ranks[self.starts[row[of]] + within], far[of], q[of]))
            whose = q[of][by]
            few = np.arange(len(by)) - np.searchsorted(whose, whose) < left[whose]
            taken = np.bincount(of[by][few], minlength=len(q))
        near, counts = np.full((len(which), self.k), -1, np.int32), np.zeros((len(which), self.k), np.int32)
        at = np.arange(len(q)) - np.searchsorted(q, q)
        near[q, at], counts[q, at] = row, taken
        kd, on = np.zeros(len(which)), taken > 0
        np.maximum.at(kd, q[on], far[on])
        return near, counts, kd, self.k - left + counts.sum(1)

    def mean(self, near: np.ndarray, counts: np.ndarray, of: np.ndarray, reach: bool) -> np.ndarray:
        """The mean over the neighbours of each of its places of ``of``, or of how far they count as being if ``of`` is their k-th distance. NaN without any."""
        own = np.minimum(self.held[: self.n] - 1, self.k)
        value = of[near]
        if reach:
            total = np.zeros(near.shape)
            for j in range(self.x.shape[1]):
                total += (self.x[: self.n, j, None] - self.x[:, j].take(near)) ** 2
            value = np.maximum(np.sqrt(total), value)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (own * of[: self.n] + np.where(counts > 0, counts * value, 0.0).sum(1)) / (own + counts.sum(1))


def _all_judged(df: DataFrame, key: str, columns: list[str], k: int, config: Config) -> DataFrame:
    """``df`` and ``lof``, all rows judging each other."""
    d, names = len(columns), [f"x{i}" for i in range(len(columns))]
    places = written(_places(df, key, columns, k))
    n = places.count()
    if not n:
        return df.withColumn("lof", F.lit(1.0))
    levels = max(0, int(np.ceil(np.log2(n / CELL))))
    sample = hash_sample(places.select(F.get("keys", F.lit(0)).alias("key"), *names), "key", OF_CELL << levels, config.seed).toArrow() if levels else None
    cuts = _halved(np.stack([sample[c].to_numpy() for c in names], axis=1), levels) if levels else []
    kind = df.select(col(key).alias("key")).schema["key"].dataType.simpleString()

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(d)], axis=1)
            points = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
            yield pa.record_batch([pc.list_element(b.column(d), 0), b.column(d), points, pa.array(_leaf(x, cuts), pa.int32())], names=["key", "keys", "x", "cell"])

    fallen = places.select(*names, "keys").mapInArrow(fall, f"key {kind}, keys array<{kind}>, x array<double>, cell int")
    form = f"cell int, key array<{kind}>, held array<int>, keys array<{kind}>, x array<double>, near array<int>, counts array<int>, kd array<double>"

    def record(cell: int, c: _Cell, key: pa.Array, keys: pa.Array, near: np.ndarray, counts: np.ndarray, kd: np.ndarray) -> pa.Table:
        values = [pa.array([cell], pa.int32()), _list(key), _list(c.held[: c.n].astype(np.int32)), _list(keys), _list(c.x[: c.n].ravel()), _list(near.ravel()), _list(counts.ravel()), _list(kd)]
        return pa.table(values, names=["cell", "key", "held", "keys", "x", "near", "counts", "kd"])

    def settle(g: pa.Table) -> pa.Table:
        g = g.sort_by("key")
        key, keys = g["key"].combine_chunks(), _flat(g, "keys")
        own = pa.table({"key": _list(key), "held": _list(pc.list_value_length(g["keys"].combine_chunks())), "keys": _list(keys), "x": _list(_flat(g, "x"))})
        c = _Cell(own, None, d, k)
        near, counts, kd, total = c.settled(np.arange(c.n))
        low, high = c.x.min(0), c.x.max(0)
        kd = np.where(total < k, np.inf, kd)
        return record(g["cell"][0].as_py(), c, key, keys, near, counts, kd).append_column("low", _list(low)).append_column("high", _list(high))

    cells = written(fallen.groupBy("cell").applyInArrow(settle, f"{form}, low array<double>, high array<double>"))
    edges = cells.select("cell", F.size("key").alias("n"), "low", "high").collect()  # a row for each cell
    low, high, sizes = np.full((1 << levels, d), np.inf), np.full((1 << levels, d), -np.inf), np.zeros(1 << levels, np.int64)
    for r in edges:
        low[r["cell"]], high[r["cell"]], sizes[r["cell"]] = r["low"], r["high"], r["n"]
    boxes = _joined(low, high)

    def crossing(x: np.ndarray, kd: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose k-th distance reaches other cells, these cells, and the distance to look within."""
        limit = kd.copy()
        open_ = np.flatnonzero(np.isinf(limit))
        for lo in range(0, len(open_), 256):  # own cell too small: the nearest cells that surely hold enough
            some = open_[lo : lo + 256]
            far = np.zeros((len(some), len(sizes)))
            for j in range(d):
                far += np.maximum(np.abs(x[some, j, None] - low[:, j]), np.abs(x[some, j, None] - high[:, j])) ** 2
            far = np.where(sizes > 0, np.sqrt(far), np.inf)
            by = np.argsort(far, axis=1)
            enough = np.cumsum(sizes[by], axis=1) >= k + 1
            limit[some] = np.where(enough[:, -1], far[np.arange(len(some)), by[np.arange(len(some)), enough.argmax(1)]], np.inf)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo in range(0, len(x), 4096):
            q, to = _reached(x[lo : lo + 4096], limit[lo : lo + 4096], boxes)
            found.append((q[to != cell] + lo, to[to != cell]))
        q, to = (np.concatenate(f) for f in zip(*found))
        return q, to, limit[q] * (1 + 1e-12)

    def visit(g: pa.Table) -> pa.Table:
        x, cell = _flat(g, "x").to_numpy().reshape(-1, d), g["cell"][0].as_py()
        q, to, within = crossing(x, _flat(g, "kd").to_numpy(), cell)
        points = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * d), pa.array(x[q].ravel()))
        return pa.table({"home": pa.array(np.full(len(q), cell), pa.int32()), "i": pa.array(q, pa.int32()), "x": points, "within": within, "cell": pa.array(to, pa.int32())})

    found = f"home int, i int, near array<struct<d:double,nb:{kind},source:int,at:int>>"

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        x, key = _flat(r, "x").to_numpy().reshape(-1, d), _flat(r, "key")
        who, far, row = _Tree(x, k).near(_points(q["x"], d), np.full(q.num_rows, -1), q["within"].to_numpy())
        pairs = pa.StructArray.from_arrays([pa.array(far), key.take(pa.array(row)), pa.array(np.full(len(row), r["cell"][0].as_py()), pa.int32()), pa.array(row, pa.int32())], names=["d", "nb", "source", "at"])
        ends = np.searchsorted(who, np.arange(q.num_rows + 1)).astype(np.int32)
        return pa.table({"home": q["home"], "i": q["i"], "near": pa.ListArray.from_arrays(pa.array(ends), pairs)})

    def lend(b: pa.Table, r: pa.Table) -> pa.Table:
        at, held = b["at"].to_numpy(), _flat(r, "held").to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(held)])
        few = held[at]
        keys = _flat(r, "keys").take(pa.array(np.repeat(ends[at], few) + np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]), pa.int32()), keys)
        points = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d), pa.array(_flat(r, "x").to_numpy().reshape(-1, d)[at].ravel()))
        return pa.table({"home": b["home"], "source": b["source"], "at": b["at"], "key": _flat(r, "key").take(b["at"].combine_chunks()), "keys": lists, "x": points})

    border = None
    if len(edges) > 1:
        visits = written(cells.select("cell", "x", "kd").groupBy("cell").applyInArrow(visit, "home int, i int, x array<double>, within double, cell int"))
        many = {r["cell"]: -(-r["n"] // VISITORS) for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if many:
            parts = F.create_map(*[F.lit(v) for c, n in many.items() for v in (c, n)])[F.col("cell")]
            left = visits.withColumn("part", F.pmod(F.xxhash64("home", "i"), parts).cast("int"))
            right = cells.select("cell", "key", "x").filter(F.col("cell").isin(*many)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
            met = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(meet, found)
            nearest_ = met.groupBy("home", "i").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # k a cell
            needed = nearest_.select("home", F.explode("near").alias("p")).select("home", "p.source", "p.at").distinct()
            lent = needed.groupBy("source").cogroup(cells.select("cell", "key", "held", "keys", "x").groupBy("cell")).applyInArrow(_if_both(lend), f"home int, source int, at int, key {kind}, keys array<{kind}>, x array<double>")
            border = written(lent)

    def own_and_border(run, rows: DataFrame, beside: DataFrame | None, into: str) -> DataFrame:
        if beside is None:
            return rows.groupBy("cell").applyInArrow(lambda g: run(g, None), into)
        return rows.groupBy("cell").cogroup(beside.groupBy("home")).applyInArrow(lambda g, b: run(g, b) if g.num_rows else None, into)

    def resettle(g: pa.Table, b: pa.Table | None) -> pa.Table:
        c, cell = _Cell(g, b, d, k), g["cell"][0].as_py()
        near, counts = (_flat(g, name).to_numpy().reshape(-1, k).copy() for name in ("near", "counts"))
        kd = _flat(g, "kd").to_numpy().copy()
        again = np.unique(crossing(c.x[: c.n], kd, cell)[0]) if c.border is not None else np.zeros(0, np.int64)
        again = np.union1d(again, np.flatnonzero(np.isinf(kd)))
        if len(again):
            near[again], counts[again], kd[again], _ = c.settled(again)
        return record(cell, c, _flat(g, "key"), _flat(g, "keys"), near, counts, kd)

    def lending(name: str, of: DataFrame) -> DataFrame | None:
        """The border with ``name`` as ``of`` has it."""
        def run(b: pa.Table, r: pa.Table) -> pa.Table:
            return b.append_column(name, pa.array(_flat(r, name).to_numpy()[b["at"].to_numpy()]))

        if border is None:
            return None
        return border.groupBy("source").cogroup(of.select("cell", name).groupBy("cell")).applyInArrow(_if_both(run), f"home int, source int, at int, key {kind}, keys array<{kind}>, x array<double>, {name} double")

    def dense(g: pa.Table, b: pa.Table | None) -> pa.Table:
        c = _Cell(g, b, d, k)
        near, counts = (_flat(g, name).to_numpy().reshape(-1, k) for name in ("near", "counts"))
        lrd = 1 / (c.mean(near, counts, c.beside(_flat(g, "kd").to_numpy(), "kd"), True) + 1e-10)
        return g.select(["cell", "key", "held", "keys", "x", "near", "counts"]).append_column("lrd", _list(lrd))

    def judge(g: pa.Table, b: pa.Table | None) -> pa.Table:
        c = _Cell(g, b, d, k)
        near, counts = (_flat(g, name).to_numpy().reshape(-1, k) for name in ("near", "counts"))
        lrd = _flat(g, "lrd").to_numpy()
        lof = c.mean(near, counts, c.beside(lrd, "lrd"), False) / lrd
        return pa.table([*[pa.array(c.x[: c.n, j]) for j in range(d)], pa.array(np.where(np.isnan(lof), 1.0, lof))], names=[*names, "lof"])

    settled = written(own_and_border(resettle, cells.drop("low", "high"), border, form))
    denser = written(own_and_border(dense, settled, lending("kd", settled), form.replace("kd array", "lrd array")))
    factors = own_and_border(judge, denser, lending("lrd", denser), ", ".join(f"{c} double" for c in [*names, "lof"]))
    at = {n: f"__at{i}" for i, n in enumerate(names)}
    factors = factors.select(*[F.col(n).alias(a) for n, a in at.items()], "lof")
    here = [col(c).cast("float").cast("double") == F.col(a) for c, a in zip(columns, at.values())]
    return df.join(factors, reduce(lambda a, b: a & b, here), "left").drop(*at.values()).withColumn("lof", F.coalesce("lof", F.lit(1.0)))


def _if_both(run):
    """``run`` for keys that both sides have: cogroup() calls it for the others too."""
    def over(left: pa.Table, right: pa.Table) -> pa.Table | None:
        return run(left, right) if left.num_rows and right.num_rows else None

    return over


def local_outlier_factor(df: DataFrame, key: str, columns: list[str], config: Config = DEFAULT) -> DataFrame:
    """``df`` and ``lof``. All rows judge each other, however many they are; only if ``lof_switch`` is set, larger tables are judged against ``lof_rows``
    of their rows (the smallest hashes). Ties between neighbours go to the smaller key; keys tell rows apart."""
    n = df.count()
    if not 0 < config.lof_switch < n:
        return df.withColumn("lof", F.lit(1.0)) if n <= 2 else _all_judged(df, key, columns, min(config.neighbours, max(2, n - 1)), config)
    train = written(hash_sample(df.select(col(key), *map(col, columns)), key, config.lof_rows, config.seed))
    size = min(n, config.lof_rows)
    if size <= 2:
        return df.withColumn("lof", F.lit(1.0))
    k = min(config.neighbours, max(2, size - 1))
    near = written(nearest(train, train, key, columns, k, config, same=True))
    reach = near.select(F.col("key").alias("nb"), F.array_max(F.transform("near", lambda p: p["d"])).alias("kd"))
    pairs = near.select("key", F.explode("near").alias("p")).select("key", "p.d", "p.nb")
    density = pairs.join(reach, "nb").groupBy("key").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    point = F.array(*[col(c).cast("float").cast("double") for c in columns])
    judges = train.select(col(key).alias("key"), point.alias("x")).join(reach.select(F.col("nb").alias("key"), "kd"), "key", "left").join(density, "key", "left")
    return _judged(df, judges, key, columns, k)
