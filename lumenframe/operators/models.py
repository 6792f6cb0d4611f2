"""Model detectors: isolation forest, and the score of all detectors.

The forest learns from a bounded sample (rows of smallest key hash); its trees, of bounded size, are broadcast, and every row is
scored in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import clip, scaled, severity
from .neighbours import local_outlier_factor  # noqa: F401
from .profile import col
from .sampling import hash_sample


def _matrix(rows: list, columns: list[str]) -> np.ndarray:
    return np.array([[r[c] for c in columns] for r in rows], dtype=np.float32).reshape(len(rows), len(columns))


def _mean_path(m: np.ndarray | float) -> np.ndarray:
    m = np.asarray(m, dtype=float)
    return np.where(m <= 1, 0.0, np.where(m == 2, 1.0, 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / np.maximum(m, 1)))


def grow(data: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """One isolation tree as flat arrays: feature (-1 at leaves), cut, left, right, path length."""
    feature, cut, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for a, v in ((feature, -1), (cut, 0.0), (left, at), (right, at), (path, depth + float(_mean_path(len(rows))))):
            a.append(v)
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            return at
        f = int(rng.choice(open_))
        x = rng.uniform(low[f], high[f])
        goes = rows[:, f] <= x
        if goes.all() or not goes.any():
            return at
        feature[at], cut[at] = f, x
        left[at] = node(rows[goes], depth + 1)
        right[at] = node(rows[~goes], depth + 1)
        return at

    node(data, 0)
    return tuple(np.array(a) for a in (feature, cut, left, right, path))


def _levels(left: np.ndarray, right: np.ndarray) -> int:
    """The steps to a tree's deepest leaf; children come after their parents."""
    depth = np.zeros(len(left), dtype=int)
    for i in range(len(left)):
        for child in (left[i], right[i]):
            if child != i:
                depth[child] = depth[i] + 1
    return int(depth.max())


#: A tree of up to so many cells (of the grid that its cuts make) is read from a table of them, others are walked.
CELLS = 1 << 15


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, levels: int) -> np.ndarray:
    """The leaf of each of ``x``; leaves lead to themselves, so that all rows take as many steps as a tree has levels."""
    at, flat, rows = np.zeros(len(x), dtype=np.int64), x.ravel(), np.arange(len(x)) * x.shape[1]
    for _ in range(levels):
        at = child.take(2 * at + (flat.take(rows + feature.take(at)) <= cut.take(at)))
    return at


class _Paths:
    """The path lengths of a forest. Which way a value goes at a cut depends on its rank among all cuts of its column alone, so
    that is looked up once; a tree's own ranks, then its cell and path, follow from tables."""

    def __init__(self, forest: list[tuple[np.ndarray, ...]], width: int):
        inner = [feature >= 0 for feature, *_ in forest]
        self.cuts = [np.unique(np.concatenate([cut[on & (feature == f)] for on, (feature, cut, *_) in zip(inner, forest)])).astype(float) for f in range(width)]
        self.trees = []
        for feature, cut, left, right, path in forest:
            child, levels = np.stack([right, left], axis=1).ravel(), _levels(left, right)
            own = [np.unique(cut[feature == f]).astype(float) for f in range(width)]
            shape = [len(c) + 1 for c in own]
            if np.prod(shape, dtype=float) > CELLS:
                self.trees.append((np.maximum(feature, 0), cut.astype(float), child, levels, path))
                continue
            place = np.zeros(len(cut))
            for f, c in enumerate(own):
                place[feature == f] = np.searchsorted(c, cut[feature == f])
            cells = np.stack([g.ravel() for g in np.meshgrid(*map(np.arange, shape), indexing="ij")], axis=1).astype(float)
            strides = np.cumprod([1, *shape[:0:-1]])[::-1]
            ranks = [(np.searchsorted(np.searchsorted(all_, c), np.arange(len(all_) + 1)) * n).astype(np.uint16) for all_, c, n in zip(self.cuts, own, strides)]
            self.trees.append((ranks, path[_walk(cells, np.maximum(feature, 0), place, child, levels)]))

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum over all trees, in their order."""
        rank = [np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)]
        total = np.zeros(len(x))
        for tree in self.trees:
            if len(tree) == 2:
                ranks, path = tree
                cell = ranks[0].take(rank[0])
                for r, at in zip(ranks[1:], rank[1:]):
                    cell = cell + r.take(at)
                total += path.take(cell)
            else:
                total += tree[-1].take(_walk(x, *tree[:-1]))
        return total


def isolation_scores(df: DataFrame, key: str, columns: list[str], config: Config = DEFAULT) -> DataFrame:
    """``df`` and ``iso_score`` (0..1; over 0.5 is unusual)."""
    pool = _matrix(hash_sample(df.select(col(key), *map(col, columns)), key, config.trees * config.tree_rows, config.seed).collect(), columns)
    size = min(config.tree_rows, len(pool))
    forest = []
    for t in range(config.trees):
        rng = np.random.default_rng([config.seed, t])
        forest.append(grow(pool[rng.choice(len(pool), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))))
    held = df.sparkSession.sparkContext.broadcast((_Paths(forest, len(columns)), float(_mean_path(size)) or 1.0))

    @F.arrow_udf("double")
    def score(*values: pa.Array) -> pa.Array:
        paths, usual = held.value
        x = np.stack([v.to_numpy(zero_copy_only=False).astype(np.float32).astype(float) for v in values], axis=1)
        return pa.array(2.0 ** (-paths.total(x) / len(paths.trees) / usual))

    return df.withColumn("iso_score", score(*[col(c).cast("double") for c in columns]))


def ensemble(flags: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``flags`` (points.flagged with iso_score and lof) and ``iso_norm``, ``lof_norm``, ``votes``,
    ``score``, ``severity``, ``multivariate``."""
    ends = flags.agg(F.min("iso_score").alias("__i0"), F.max("iso_score").alias("__i1"), F.min("lof").alias("__l0"), F.max("lof").alias("__l1"))
    d = flags.crossJoin(F.broadcast(ends))  # one row
    d = d.withColumns({"iso_norm": scaled(F.col("iso_score"), F.col("__i0"), F.col("__i1")), "lof_norm": scaled(F.col("lof"), F.col("__l0"), F.col("__l1")), "iso_flag": F.col("iso_score") > 0.5, "lof_flag": F.col("lof") > config.lof_limit})
    votes = (F.col("iqr_any").cast("int") + F.col("z_any").cast("int") + F.col("iso_flag").cast("int") + F.col("lof_flag").cast("int")) / 4
    d = d.withColumn("votes", votes)
    d = d.withColumn("score", clip(0.36 * F.col("votes") + 0.2 * F.col("iqr_ratio") + 0.2 * F.col("z_peak") + 0.14 * F.col("iso_norm") + 0.1 * F.col("lof_norm"), 0.0, 1.0))
    return d.withColumns({"severity": severity(F.col("score")), "multivariate": (F.col("iso_flag") & F.col("lof_flag")) | (F.col("iso_norm") > 0.8)}).drop("__i0", "__i1", "__l0", "__l1")
