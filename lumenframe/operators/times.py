"""Times in text columns: one lenient parser for typing, counting, choosing and ordering.

A value's spelling is inferred from its shape. Shapes that Spark's own parser reads exactly as the lenient rules do (ISO
dates and times, month/day/year) never leave the JVM; whatever is left, and only that, goes to pandas' mixed parser in Arrow
batches. Counts send each distinct spelling once, however many rows have it. Numbers are times too, as nanoseconds since 1970,
so every present number is valid; they keep their own order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shapes, and the pattern that reads them natively. Month first, as the lenient rules have it; a month above 12 is left to them.
NATIVE = {
    r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$": "M/d/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$": "M/d/yyyy H:mm:ss",
    r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$": "yyyy/M/d H:mm:ss", r"^(19|20)\d{6}$": "yyyyMMdd"}
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
#: Years that nanoseconds since 1970 in 64 bits hold whole.
FIRST_YEAR, LAST_YEAR = 1678, 2261


def native(text: Column) -> Column:
    """The time of a spelling that needs no Python, else null."""
    found = F.when(text.rlike(ISO), text.try_cast("timestamp"))
    for shape, pattern in NATIVE.items():
        found = found.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
    return F.when(F.year(found).between(FIRST_YEAR, LAST_YEAR), found)


def lenient(texts: pd.Series) -> pd.Series:
    """Times in UTC; NaT for what is none."""
    return pd.to_datetime(texts, errors="coerce", format="mixed", utc=True)


@F.pandas_udf(T.TimestampType())
def _lenient(texts: pd.Series) -> pd.Series:
    out = pd.Series(pd.NaT, index=texts.index, dtype="datetime64[ns, UTC]")
    some = texts.notna()
    if some.any():
        kinds = texts[some].unique()
        out[some] = texts[some].map(dict(zip(kinds, lenient(pd.Series(kinds)), strict=True)))
    return out


def parsed_time(x: Column) -> Column:
    """The time of a text, null for what is none; Python sees only spellings that native() doesn't read."""
    text = F.trim(x.cast("string"))
    quick = native(text)
    return F.coalesce(quick, _lenient(F.when(quick.isNull() & (text != ""), text)))


def _is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def counted(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """For each of ``columns`` its present and its valid times. One scan and one aggregate for all columns: what isn't read natively is
    counted by spelling before it meets Python."""
    if not columns:
        return {}
    parts, left = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        texts = isinstance(df.schema[c].dataType, T.StringType)
        present = x.isNotNull() & ~F.isnan(x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x.isNotNull()
        text = F.trim(x.cast("string"))
        parts += [F.count_if(present).alias(f"p{i}"), (F.count_if(native(text).isNotNull()) if texts else F.count_if(present)).alias(f"v{i}")]
        if texts:
            left.append(F.when(x.isNotNull() & native(text).isNull(), F.struct(F.lit(i).alias("i"), text.alias("text"))))
    got = df.agg(*parts).first()
    valid = {i: got[f"v{i}"] for i in range(len(columns))}
    if any(got[f"p{i}"] > got[f"v{i}"] for i in range(len(columns))):
        spellings = df.select(F.explode(F.array_compact(F.array(*left))).alias("s")).groupBy("s.i", "s.text").agg(F.count(F.lit(1)).alias("n"))

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.loc[lenient(f["text"]).notna(), ["i", "n"]]

        for r in spellings.mapInPandas(sums, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each column
            valid[r["i"]] += r["n"]
    return {c: (got[f"p{i}"], valid[i]) for i, c in enumerate(columns)}


def best_time(df: DataFrame, columns: list[str], least: int = 8) -> str | None:
    """Of ``columns`` the one with the most valid times, the first of several; None below ``least``."""
    valid = {c: v for c, (_, v) in counted(df, columns).items()}
    best = max(columns, key=lambda c: (valid[c], -columns.index(c)), default=None)
    return best if best is not None and valid[best] >= least else None


def ordered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` as something to order by: times and numbers as they are, texts as times."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, parsed_time(F.col(f"`{column}`")))
    return df
