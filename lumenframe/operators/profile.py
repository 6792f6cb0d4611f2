"""Semantic types and column profiles. All numbers of a table come from one or two
aggregates over it; only samples of up to 300 values a column reach the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import number
from .quantiles import quantiles
from .times import counted, lenient

#: Parts of a name that hint at an identifier or a date.
ID_NAMES, DATE_NAMES = ("id", "uuid", "key", "code"), ("date", "time", "timestamp", "day", "month", "year")
GEOMETRIES = "POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION"
SAMPLE = 300


def _plain(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def col(name: str):
    return F.col(f"`{name}`")


def kind_of(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "number" if isinstance(t, (T.NumericType, T.BooleanType)) else "text"


class Scan:
    """The aggregates of several operators, in one scan."""

    def __init__(self, df: DataFrame):
        self.df, self.parts = df, {("rows",): F.count(F.lit(1))}

    def add(self, *key: str, value) -> None:
        self.parts[key] = value

    def run(self) -> dict[tuple[str, ...], object]:
        row = self.df.agg(*[x.alias(f"a{i}") for i, x in enumerate(self.parts.values())]).first()
        return dict(zip(self.parts, row, strict=True))


def is_missing(df: DataFrame, c: str):
    return col(c).isNull() | F.isnan(col(c)) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col(c).isNull()


def distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column`` and ``distinct_values`` (exact, missing ones are none). Each column is a scan of its own, pruned to it, and its values are
    made distinct in each task before they meet: nothing is multiplied by the number of columns."""
    parts = [df.select(F.when(~is_missing(df, c), col(c)).alias("v")).distinct().agg(F.lit(c).alias("column"), F.count("v").alias("distinct_values")) for c in columns]
    return reduce(DataFrame.unionAll, parts)


#: Size of a distinct sketch as a power of two, and the standard errors within which its count is taken as sure.
SKETCH, ERRORS = 14, 4


def distinct_sketch(df: DataFrame, c: str):
    value = F.when(~is_missing(df, c), col(c).cast("bigint") if isinstance(df.schema[c].dataType, T.IntegralType) else col(c).cast("string"))
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, SKETCH))


def distinct_by_need(df: DataFrame, estimates: dict[str, int], present: dict[str, int], whole: tuple[int, ...] = (1, 25, 30, 50, 200), shares: tuple[float, ...] = (0.5, 0.9)) -> dict[str, tuple[int, bool]]:
    """Distinct values of each column, and whether they are exact. An estimate stays where its error bounds lie on one side of every
    threshold of the analysis; only columns that straddle one are counted, in one job."""
    off = ERRORS * 1.04 / 2 ** (SKETCH / 2)

    def sure(c: str) -> bool:
        low, high = estimates[c] * (1 - off), min(estimates[c] * (1 + off), present[c])
        return high > max(whole) and low > max(whole) and not any(low <= s * present[c] <= high for s in shares)

    out = {c: (min(n, present[c]), True) for c, n in estimates.items() if present[c] == 0}
    unsure = [c for c in estimates if c not in out and not sure(c)]
    out |= {c: (min(n, present[c]), False) for c, n in estimates.items() if c not in out and c not in unsure}
    if unsure:
        # a row for each value of these columns; most have few, which meet once for each task
        cells = [F.struct(F.lit(i).alias("i"), _canonical(df, c).alias("v")) for i, c in enumerate(unsure)]
        kinds = df.select(F.explode(F.array(*cells)).alias("s")).filter("s.v is not null").select("s.i", "s.v").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
        exact = {r["i"]: r["n"] for r in kinds.collect()}
        out |= {c: (exact.get(i, 0), True) for i, c in enumerate(unsure)}
    return out


def _canonical(df: DataFrame, c: str):
    """A text that is the same for equal values only; null for missing ones."""
    floats = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return F.when(~is_missing(df, c), F.when(col(c) == 0, F.lit("0.0")).otherwise(col(c).cast("string")) if floats else col(c).cast("string"))


def counts(df: DataFrame) -> DataFrame:
    """One row for each column: ``column``, ``missing``, ``missing_pct``, ``distinct_values``, ``rows``."""
    names = _plain(df)
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.round(100 * F.col(f"m{i}") / F.col("n"), 2).alias("missing_pct")) for i, c in enumerate(names)])
    return wide.select("n", F.explode(rows).alias("r")).join(F.broadcast(distinct(df, names)), F.col("r.column") == F.col("column")).select("r.column", "r.missing", "r.missing_pct", "distinct_values", F.col("n").alias("rows"))  # a row for each column


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``duplicate_rows``: rows beyond the first of each kind."""
    names = _plain(df)
    return df.groupBy(*map(col, names)).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_rows"))


def skew(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``skewness`` (bias-corrected)."""
    n = [F.count(col(c)) for c in columns]
    wide = df.agg(*[(F.skewness(col(c)) * F.sqrt(k * (k - 1)) / F.nullif(k - 2, F.lit(0))).alias(f"s{i}") for i, (c, k) in enumerate(zip(columns, n, strict=True))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(f"s{i}", 6).alias("skewness")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def iqr_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """``column``, ``q1``, ``q3``, ``outliers`` beyond the fences, on non-null values."""
    quarters, _ = quantiles(df, {c: col(c) for c in columns}, (0.25, 0.75))
    parts = []
    for i, c in enumerate(columns):
        q1, q3 = quarters[c]
        spread = (q3 or 0.0) - (q1 or 0.0)
        parts.append((F.count_if((col(c) < q1 - factor * spread) | (col(c) > q3 + factor * spread)) if spread > 1e-8 else F.lit(0).cast("bigint")).alias(f"o{i}"))
    # with one aggregate at least, so that there is one row
    wide = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.lit(quarters[c][0]).cast("double"), 6).alias("q1"), F.round(F.lit(quarters[c][1]).cast("double"), 6).alias("q3"), F.col(f"o{i}").alias("outliers")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def type_mismatch(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``castable_share``, ``not_castable`` among non-null texts."""
    wide = df.agg(*[F.avg(F.when(col(c).isNotNull(), number(col(c)).isNotNull().cast("double"))).alias(f"s{i}") for i, c in enumerate(columns)], *[F.count_if(col(c).isNotNull() & number(col(c)).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(f"s{i}", 6).alias("castable_share"), F.col(f"n{i}").alias("not_castable")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def invalid_dates(df: DataFrame, *columns: str) -> DataFrame:
    """``column``, ``invalid_dates`` and ``dates`` (present values) of each of ``columns``."""
    found = counted(df, list(columns))
    return df.sparkSession.createDataFrame([(c, p - v, p) for c, (p, v) in found.items()], "column string, invalid_dates bigint, dates bigint")


def samples(df: DataFrame, columns: list[str], n: int = SAMPLE) -> dict[str, list[str]]:
    """Up to ``n`` non-null values of each column as text, the first that come: from the table's head, and for columns that are sparse there
    from each task's first ones. Two jobs at most, whatever the number of columns."""
    if not columns:
        return {}
    texts = df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    head = texts.limit(2 * n).collect()
    found = {c: [r[i] for r in head if r[i] is not None][:n] for i, c in enumerate(columns)}
    sparse = [i for i, c in enumerate(columns) if len(found[c]) < n]
    if not sparse or len(head) < 2 * n:
        return found

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = dict.fromkeys(range(len(sparse)), n)
        for b in batches:
            for i in list(left):
                values = b.column(i).drop_null().slice(0, left[i])
                if len(values):
                    yield pa.record_batch([pa.array([sparse[i]] * len(values), pa.int32()), values], names=["i", "v"])
                    left[i] -= len(values)
                    if not left[i]:
                        del left[i]
            if not left:
                return

    rows = texts.select(*[f"c{i}" for i in sparse]).mapInArrow(firsts, "i int, v string").select("i", "v", F.monotonically_increasing_id().alias("at"))
    kept = rows.groupBy("i").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), 1, n).alias("v"))  # n of each task and column
    for r in kept.collect():
        found[columns[r["i"]]] = r["v"]
    return found


def looks_date(name: str, values: list[str]) -> bool:
    if not values:
        return False
    times = lenient(pd.Series(values))
    if times.notna().mean() < 0.8:
        return False
    hint = any(k in name.lower() for k in DATE_NAMES)
    if sum(v.strip().isdigit() for v in values) / len(values) > 0.9 and not hint:
        return False
    marked = sum(bool(re.search(r"[-/:T ]", v)) for v in values) / len(values)
    return hint or marked >= 0.6 or times.dropna().dt.year.between(1900, 2100).mean() >= 0.7


def whole_share(df: DataFrame, c: str):
    """The share of a number column's values that are whole."""
    return F.avg(F.when(col(c).isNotNull(), (F.abs(F.pmod(col(c).cast("double"), F.lit(1.0))) < 1e-8).cast("int")))


def semantic_types(df: DataFrame) -> dict[str, str]:
    """``date``, ``id-like``, ``numeric``, ``text`` or ``categorical`` for each plain column, ``unsupported`` for nested ones."""
    plain, scan = _plain(df), Scan(df)
    for c in plain:
        scan.add("missing", c, value=F.count_if(is_missing(df, c)))
        scan.add("distinct", c, value=distinct_sketch(df, c))
        if kind_of(df, c) == "number":
            scan.add("whole", c, value=whole_share(df, c))
    got = scan.run()
    found = distinct_by_need(df, {c: got["distinct", c] for c in plain}, {c: got["rows",] - got["missing", c] for c in plain})
    stats = {c: {"rows": got["rows",], "missing": got["missing", c], "distinct_values": found[c][0]} for c in plain}
    return typed(df, stats, {c: got.get(("whole", c)) for c in plain}, samples(df, [c for c in plain if kind_of(df, c) != "time"]))


def typed(df: DataFrame, stats: dict[str, dict], whole: dict[str, float | None], values: dict[str, list[str]]) -> dict[str, str]:
    """The types from counts, shares of whole numbers and samples."""
    plain = _plain(df)
    out = {}
    for f in df.schema.fields:
        c = f.name
        if c not in plain:
            out[c] = "unsupported"
            continue
        kind, sample = kind_of(df, c), values.get(c, [])
        present = stats[c]["rows"] - stats[c]["missing"]
        unique = stats[c]["distinct_values"] / present if present else 0.0
        hint = any(k in c.lower() for k in ID_NAMES)
        boolean = isinstance(f.dataType, T.BooleanType)
        if kind == "time" or (not boolean and looks_date(c, sample)):
            out[c] = "date"
        elif kind == "number":
            alike = unique > 0.9 and (whole[c] or 0) > 0.95 and (hint or stats[c]["distinct_values"] > 25)
            out[c] = "id-like" if alike and not boolean else "numeric"
        else:
            length = sum(map(len, sample)) / len(sample) if sample else 0.0
            words = sum(len(v.split()) for v in sample) / len(sample) if sample else 0.0
            simple = sum(bool(re.fullmatch(r"[A-Za-z0-9_\-]+", v)) for v in sample) / len(sample) if sample else 0.0
            if unique > 0.9 and simple > 0.8 and (hint or length >= 6):
                out[c] = "id-like"
            else:
                out[c] = "text" if length >= 24 or words >= 4 else "categorical"
    return out


def as_number(df: DataFrame, c: str):
    """Null for what isn't a number; only texts have to be parsed."""
    return F.when(~is_missing(df, c), col(c).cast("double")) if kind_of(df, c) == "number" else number(col(c))


def geo_scores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column``, ``castable`` (share of all rows), ``lat_share``, ``lon_share`` (of castable ones) for each column."""
    names = columns or [c for c in _plain(df) if kind_of(df, c) != "time"]
    parts = []
    for i, c in enumerate(names):
        x = as_number(df, c)
        parts += [F.avg(x.isNotNull().cast("double")).alias(f"c{i}"), F.avg(x.between(-90, 90).cast("double")).alias(f"a{i}"), F.avg(x.between(-180, 180).cast("double")).alias(f"o{i}")]
    wide = df.agg(*parts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(f"c{i}", 6).alias("castable"), F.round(f"a{i}", 6).alias("lat_share"), F.round(f"o{i}", 6).alias("lon_share")) for i, c in enumerate(names)])).alias("r")).select("r.*")


def pick_coordinates(rows: list) -> tuple[str | None, str | None]:
    """The latitude and longitude columns among geo_scores rows."""

    def best(share: str, hints: tuple[str, ...], without: str | None = None) -> str | None:
        found, top = None, 0.0
        for r in rows:
            if r["column"] == without or (r["castable"] or 0) < 0.55 or (r[share] or 0) < 0.7:
                continue
            score = 2 * any(h in r["column"].lower() for h in hints) + r[share]
            if score > top:
                found, top = r["column"], score
        return found

    lat, lon_hints = best("lat_share", ("lat", "latitude")), ("lon", "lng", "longitude")
    lon = best("lon_share", lon_hints)
    return lat, best("lon_share", lon_hints, lat) if lon and lon == lat else lon


def geo_summary(df: DataFrame, lat: str, lon: str) -> DataFrame:
    a, o = number(col(lat)), number(col(lon))
    ok_a, ok_o = a.between(-90, 90), o.between(-180, 180)
    both = a.isNotNull() & o.isNotNull()
    ok = both & ok_a & ok_o
    return df.agg(
        F.count_if(~ok_a).alias("invalid_latitude"), F.count_if(~ok_o).alias("invalid_longitude"), F.count_if(ok).alias("valid_pairs"),
        F.count_if(both & ~ok).alias("invalid_pairs"), F.count_if(a.isNull() != o.isNull()).alias("missing_pairs"),
        *[F.round(g(F.when(ok, x)), 6).alias(n) for n, g, x in (("min_lat", F.min, a), ("max_lat", F.max, a), ("min_lon", F.min, o), ("max_lon", F.max, o))],
    )


def geometry_counts(df: DataFrame, column: str) -> DataFrame:
    value = F.upper(F.trim(col(column)))
    like = value.rlike(f"^({GEOMETRIES})") & value.contains("(")
    return df.agg(F.count_if(like).alias("geometries"), F.count_if(col(column).isNotNull() & ~like).alias("invalid_geometries"))


def invalid_geometries(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """The invalid values of each geometry column, all in one scan."""
    scan = Scan(df)
    for c in columns:
        value = F.upper(F.trim(col(c)))
        scan.add(c, value=F.count_if(col(c).isNotNull() & ~(value.rlike(f"^({GEOMETRIES})") & value.contains("("))))
    got = scan.run() if columns else {}
    return {c: got[c,] for c in columns}


MISSING = "missing values"


def status_of(missing_pct: float, issues: list[str]) -> str:
    return "critical" if missing_pct >= 30 or len(issues) >= 3 else "warning" if issues else "ok"


def with_missing(health: list[dict], missing_pct: dict[str, float]) -> list[dict]:
    """A sample's health by column with the whole table's missing shares: the issue and the status follow them."""
    out = []
    for h in health:
        pct = missing_pct.get(h["column"], h["missing_pct"])
        issues = ([MISSING] if pct else []) + [x for x in h["issues"] if x != MISSING]
        out.append(h | {"missing_pct": pct, "issues": issues, "status": status_of(pct, issues)})
    return out


def column_health(parts: list[DataFrame]) -> DataFrame:
    """``column``, ``issues`` and ``status`` from (column, issue) rows and their missing share."""
    rows = reduce(DataFrame.unionByName, parts)
    issues = F.array_sort(F.collect_set("issue"))
    return rows.groupBy("column").agg(F.array_join(issues, ",").alias("issues"), F.max("missing_pct").alias("missing_pct"), F.count_distinct("issue").alias("k")).select(
        "column", "issues", "missing_pct", F.when((F.col("missing_pct") >= 30) | (F.col("k") >= 3), "critical").when(F.col("k") >= 1, "warning").otherwise("ok").alias("status"))
