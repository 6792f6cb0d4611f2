"""Anomalies of ordered series: spikes, dips, trend changes, seasonal breaks, high runs.

Rows get their place in the order from a range-partitioned table and its partitions' sizes,
then fall in blocks of ``block_rows`` with the neighbours' edge rows added, so that every
rolling window and lag of every column is whole inside its block and no task holds the series. The blocks are laid out once, with the
widest halo, as one row of arrays each; whatever is asked of them later is a map over those rows, without another shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..session import written
from .profile import col
from .quantiles import quantiles

LAGS = DEFAULT.lags


def positioned(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``df`` with the 0-based place of each row; ``order`` must tell rows apart."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged)  # so that a row's partition number can't change
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each partition; the running sum goes through one task.
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn(name, local).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def blocked(df: DataFrame, halo: int, size: int = DEFAULT.block_rows) -> DataFrame:
    """Rows with ``__block``, edge rows once more for each neighbour block that needs them."""
    home = F.floor(F.col("pos") / size)
    inside = F.col("pos") - home * size
    blocks = F.array(home, F.when(inside < halo, home - 1), F.when(inside >= size - halo, home + 1))
    return df.withColumn("__block", F.explode(F.array_compact(blocks)))


def window_size(n: int) -> int:
    return min(31, max(7, n // 40))


def sliding_median(x: np.ndarray, w: int) -> np.ndarray:
    """The median of the known values in the centred window of ``w`` around each place, NaN where there are none: the window's
    order statistics from its sorted buffer."""
    padded = np.concatenate([np.full(w // 2, np.nan), x, np.full((w - 1) // 2, np.nan)])
    ordered = np.sort(np.lib.stride_tricks.sliding_window_view(padded, w), axis=1)  # NaN last
    n = w - np.isnan(ordered).sum(1)
    at = np.arange(len(x))
    low, high = ordered[at, np.maximum(n - 1, 0) // 2], ordered[at, n // 2 * (n > 0) * (n < 2 * w)]
    return np.where(n % 2 == 1, low, (low + high) / 2)


def steps_of(x: np.ndarray) -> np.ndarray:
    """Each value less the one before; 0 where either isn't known."""
    return np.nan_to_num(np.diff(x, prepend=np.nan), nan=0.0, posinf=np.inf, neginf=-np.inf)


def lag_of(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]])


class Series:
    """The series of ``columns`` of ``df`` (with ``pos``), laid out in blocks. ``w`` is the rolling window."""

    FEATURES = ("v", "med", "mad", "step", "smed", "smad", "lag")

    def __init__(self, df: DataFrame, columns: list[str], w: int, config: Config = DEFAULT, size: int = DEFAULT.block_rows):
        self.columns, self.w, self.config, self.size = columns, w, config, size
        self.rest = [c for c in df.columns if c not in columns]  # pos is one
        halo = max(2 * (w // 2) + 2, *config.lags)
        values = [f"v{i}" for i in range(len(columns))]
        rows = blocked(df.select("pos", F.struct(*map(col, self.rest)).alias("rest"), *[col(c).cast("double").alias(v) for c, v in zip(columns, values, strict=True)]), halo, size)
        packed = rows.groupBy("__block").agg(F.sort_array(F.collect_list(F.struct("pos", "rest", *values))).alias("r"))  # a block's rows
        self.blocks = written(packed.select("__block", *[F.col(f"r.{c}").alias(c) for c in ("pos", "rest", *values)]))
        self._stats: dict[str, dict] | None = None

    def _mapped(self, schema: str, of_block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1)
                    yield of_block(row.column(0)[0].as_py(), *[c.flatten() for c in row.columns[1:]])

        return self.blocks.mapInArrow(run, schema)

    def stats(self) -> dict[str, dict]:
        """For each column ``n``, ``sd``, ``step_sd`` and ``lags`` (correlation with itself by lag, None if the series is too short or
        constant): sums of all blocks, around the column's mean."""
        if self._stats is None:
            k, lags, size = len(self.columns), self.config.lags, self.size
            means = self.blocks.select(*[F.aggregate(F.filter(f"v{i}", lambda x: ~F.isnan(x)), F.lit(0.0), lambda s, x: s + x).alias(f"s{i}") for i in range(k)], *[F.size(F.filter(f"v{i}", lambda x: ~F.isnan(x))).alias(f"n{i}") for i in range(k)]).agg(*[(F.sum(f"s{i}") / F.nullif(F.sum(f"n{i}"), F.lit(0))).alias(f"m{i}") for i in range(k)]).first()
            around = [m if m is not None and math.isfinite(m) else 0.0 for m in means]  # halo rows count twice: any shift is right
            width = 6 + 6 * len(lags)

            def sums(block: int, pos: pa.Array, rest: pa.Array, *values: pa.Array) -> pa.RecordBatch:
                own = pos.to_numpy() // size == block
                out = []
                for v, m in zip(values, around, strict=True):
                    x = v.to_numpy(zero_copy_only=False).astype(float) - m
                    step, mine = steps_of(x)[own], x[own]
                    mine = mine[~np.isnan(mine)]
                    out += [len(mine), mine.sum(), (mine**2).sum(), len(step), step.sum(), (step**2).sum()]
                    for lag in lags:
                        y = lag_of(x, lag)
                        both = own & ~np.isnan(x) & ~np.isnan(y)
                        a, b = x[both], y[both]
                        out += [len(a), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()]
                return pa.record_batch([pa.array([float(o)]) for o in [*out, own.sum()]], names=[f"s{j}" for j in range(k * width + 1)])

            got = self._mapped(", ".join(f"s{j} double" for j in range(k * width + 1)), sums).agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k * width + 1)]).first()
            rows = int(got[k * width] or 0)
            self._stats = {}
            for i, c in enumerate(self.columns):
                s = [x or 0.0 for x in got[i * width : (i + 1) * width]]
                spread = lambda n, a, q: math.sqrt(max(q / n - (a / n) ** 2, 0.0)) if n else None
                of = {"n": rows, "sd": spread(*s[:3]), "step_sd": spread(*s[3:6]), "lags": {}}
                for j, lag in enumerate(lags):
                    n, a, b, aa, bb, ab = s[6 + 6 * j : 12 + 6 * j]
                    da, db = n * aa - a * a, n * bb - b * b
                    of["lags"][lag] = round((n * ab - a * b) / math.sqrt(da * db), 6) if rows >= 3 * lag and n and da > 0 and db > 0 else None
                self._stats[c] = of
        return self._stats

    def season(self, column: str) -> int | None:
        """The lag of strongest correlation, the smaller of equals, if it is strong enough."""
        found = [(abs(r), -lag) for lag, r in self.stats()[column]["lags"].items() if r is not None]
        best = max(found, default=None)
        return -best[1] if best and best[0] >= self.config.lag_correlation else None

    def features(self, seasons: bool = True) -> DataFrame:
        """All rows, each once, with ``v``, ``med``, ``mad``, ``step``, ``smed``, ``smad``, ``lag`` and the column's number for each column."""
        w, size, fields = self.w, self.size, [f"{f}{i}" for i in range(len(self.columns)) for f in self.FEATURES]
        lags = [self.season(c) if seasons else None for c in self.columns]
        rest = self.blocks.schema["rest"].dataType.elementType

        def rows(block: int, pos: pa.Array, rest_: pa.Array, *values: pa.Array) -> pa.RecordBatch:
            own = pos.to_numpy() // size == block
            out = []
            for v, lag in zip(values, lags, strict=True):
                x = v.to_numpy(zero_copy_only=False).astype(float)
                step = steps_of(x)
                med, smed = sliding_median(x, w), sliding_median(step, w)
                known = (x, med, sliding_median(np.abs(x - med), w), step, smed, sliding_median(np.abs(step - smed), w), lag_of(x, lag) if lag else np.full(len(x), np.nan))
                out += [pa.array(a[own], from_pandas=True) for a in known]  # NaN is null
            return pa.record_batch([rest_.filter(pa.array(own)), *out], names=["rest", *fields])

        return self._mapped(f"rest {rest.simpleString()}, " + ", ".join(f"{f} double" for f in fields), rows).select("rest.*", *fields)

    def limits(self, found: DataFrame) -> list[tuple[float, float] | None]:
        """For each column the limit of seasonal deviations and its season, None without one. ``found`` is features()."""
        lags = [self.season(c) for c in self.columns]
        devs = {i: F.abs(F.col(f"v{i}") - F.col(f"lag{i}")) for i, lag in enumerate(lags) if lag}
        if not devs:
            return [None] * len(lags)
        names = {f"d{i}": d for i, d in devs.items()}
        middles, sds = quantiles(found, names, (0.5,), {n: F.stddev_pop(d) for n, d in names.items()})
        spreads, _ = quantiles(found, {n: F.abs(d - F.lit(middles[n][0])) for n, d in names.items()}, (0.5,))
        return [(max(middles[f"d{i}"][0] + 6 * spreads[f"d{i}"][0], 2.5 * sds[f"d{i}"]), lag) if lag else None for i, lag in enumerate(lags)]

    def events(self, kinds: tuple[str, ...] = ("spike", "dip", "trend", "seasonal")) -> DataFrame:
        """The rows with an event, once for each: their other columns, ``column``, ``kind``, ``value``, ``baseline``, ``deviation``, ``threshold``, ``lag``."""
        seasonal = "seasonal" in kinds
        found = self.features(seasonal)
        # read several times for the seasonal limits, else once
        found = written(found) if seasonal else found
        limits = self.limits(found) if seasonal else [None] * len(self.columns)
        stats, made = self.stats(), []

        def event(i: int, kind: Column, base: Column, dev: Column, limit: Column, lag: int | None = None) -> Column:
            parts = {"column": F.lit(self.columns[i]), "kind": kind, "value": F.col(f"v{i}"), "baseline": base, "deviation": dev, "threshold": limit, "lag": F.lit(lag).cast("int")}
            return F.struct(*[c.alias(n) for n, c in parts.items()])

        for i, c in enumerate(self.columns):
            v, med = F.col(f"v{i}"), F.col(f"med{i}")
            limit = F.greatest(6 * F.coalesce(F.col(f"mad{i}"), F.lit(0.0)), F.lit(1.5 * (stats[c]["sd"] or 0.0)))
            if "spike" in kinds:
                made.append(F.when(F.abs(v - med) > limit, event(i, F.when(v > med, "spike").otherwise("dip"), med, v - med, limit)))
            step, smed = F.col(f"step{i}"), F.col(f"smed{i}")
            limit = F.greatest(6 * F.coalesce(F.col(f"smad{i}"), F.lit(0.0)), F.lit(2 * (stats[c]["step_sd"] or 0.0)))
            if "trend" in kinds:
                made.append(F.when((F.abs(step - smed) > limit) & (F.col("pos") > max(2, self.w // 3)), event(i, F.lit("trend"), smed, F.abs(step - smed), limit)))
            if seasonal and limits[i]:
                dev, before = F.abs(v - F.col(f"lag{i}")), F.col(f"lag{i}")
                made.append(F.when(dev > limits[i][0], event(i, F.lit("seasonal"), before, dev, F.lit(limits[i][0]), limits[i][1])))
        if not made:
            made = [F.when(F.lit(False), event(0, F.lit("seasonal"), F.col("v0"), F.col("v0"), F.col("v0")))]
        return found.select(*map(col, self.rest), F.explode(F.array_compact(F.array(*made))).alias("e")).select(*map(col, self.rest), "e.*")


def rolling(df: DataFrame, value: str, w: int, size: int = DEFAULT.block_rows) -> DataFrame:
    """``df`` (with ``pos``) and ``{value}_med`` (centred rolling median), ``{value}_mad``
    (rolling median of each row's distance from its own median)."""
    b = blocked(df, 2 * (w // 2) + 1, size)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{value}_med` double", f"`{value}_mad` double"])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        block, own = t["__block"][0].as_py(), None
        x = t[value].to_numpy().astype(float)
        med = sliding_median(x, w)
        mad = sliding_median(np.abs(x - med), w)
        own = pa.array(t["pos"].to_numpy() // size == block)
        return t.drop_columns(["__block"]).append_column(f"{value}_med", pa.array(med, from_pandas=True)).append_column(f"{value}_mad", pa.array(mad, from_pandas=True)).filter(own)

    return b.groupBy("__block").applyInArrow(run, schema)


def level_shifts(df: DataFrame, value: str, w: int) -> DataFrame:
    """``pos``, ``value``, ``baseline``, ``deviation``, ``threshold``, ``kind`` (spike, dip) of outlying rows."""
    return Series(df, [value], w).events(("spike", "dip"))


def trend_changes(df: DataFrame, value: str, w: int) -> DataFrame:
    """Rows whose step from the row before differs from the steps around it."""
    return Series(df, [value], w).events(("trend",))


def lag_scores(df: DataFrame, value: str, config: Config = DEFAULT) -> DataFrame:
    """``lag``, ``correlation`` of the series with itself, for lags it is long enough for."""
    scores = Series(df, [value], LAGS[0], config).stats()[value]["lags"]
    return df.sparkSession.createDataFrame(list(scores.items()), "lag int, correlation double")


def seasonal_breaks(df: DataFrame, value: str, config: Config = DEFAULT) -> DataFrame:
    """Rows far from the value one season before, if a season shows."""
    return Series(df, [value], LAGS[0], config).events(("seasonal",))


#: Blocks whose runs are joined at once.
FAN = 1_000


def high_runs(df: DataFrame, score: str, config: Config = DEFAULT, size: int = DEFAULT.block_rows, fan: int = FAN) -> DataFrame:
    """``start_pos``, ``end_pos``, ``length``, ``peak`` of the maximal runs of high scores.

    A block's runs are islands of ``pos`` less their rank among its high rows. A block then counts only by the runs that are open
    at its ends: those of neighbouring blocks join, which is associative, so blocks merge as a tree, ``fan`` at a time, and what
    is closed inside leaves. No task sees the ends of more than ``fan`` blocks."""
    quarter, extra = quantiles(df, {"s": col(score)}, (0.9,), {"n": F.count(F.lit(1)), "last": F.max("pos")})
    limit = max(quarter["s"][0] if quarter["s"][0] is not None else 0.0, config.run_floor)
    high = df.filter(F.lit(extra["n"] >= 6) & (col(score) >= limit)).select("pos", col(score).alias("s"), F.floor(F.col("pos") / size).alias("b"))
    w = Window.partitionBy("b").orderBy("pos")
    runs = high.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy("b", "island").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.max("s").alias("peak")).select("p0", "p1", "peak")
    whole, done = size, None
    while whole <= (extra["last"] or 0):
        open_ = (F.col("p0") % whole == 0) | (F.col("p1") % whole == whole - 1)
        closed, whole = runs.filter(~open_), whole * fan
        done = closed if done is None else done.unionByName(closed)
        o = Window.partitionBy("b").orderBy("p0")
        e = runs.filter(open_).withColumn("b", F.floor(F.col("p0") / whole))
        e = e.withColumn("new", (F.coalesce(F.lag("p1").over(o), F.lit(-2)) + 1 != F.col("p0")).cast("int")).withColumn("run", F.sum("new").over(o))
        runs = e.groupBy("b", "run").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.max("peak").alias("peak")).select("p0", "p1", "peak")
    runs = runs if done is None else runs.unionByName(done)
    runs = runs.withColumn("length", F.col("p1") - F.col("p0") + 1).filter(F.col("length") >= config.run_rows)
    return runs.select(F.col("p0").alias("start_pos"), F.col("p1").alias("end_pos"), "length", F.round("peak", 6).alias("peak"))
