"""Tables from files: the format by the suffix, names cleaned, null tokens set, rows numbered."""

from __future__ import annotations

import math
import re
from decimal import Decimal
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

FORMATS = {".csv": ",", ".tsv": "\t", ".txt": "\t", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".xlsx": "xlsx"}
#: Fixed value: texts that mean a missing value in delimited files.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class TableError(ValueError):
    """A file that can't be used as a table."""


def suffix_of(path: str) -> str:
    found = re.search(r"\.[A-Za-z0-9]+$", path.rstrip("/"))
    ext = found.group().lower() if found else ""
    if ext not in FORMATS:
        raise TableError(f"unsupported file type {ext or path!r}; supported: {', '.join(FORMATS)}")
    return ext


def clean_names(names: list[str]) -> list[str]:
    """Stripped, and told apart by .1, .2 where they repeat."""
    stripped = [x.strip() for x in names]
    used, out = {n.lower() for n in stripped}, []
    first: set[str] = set()
    for n in stripped:
        k, name = 0, n
        while name.lower() in first or (k and name.lower() in used):  # Spark takes names that differ in case for one
            k += 1
            name = f"{n}.{k}"
        first.add(name.lower())
        out.append(name)
    return out


def _inferred(df: DataFrame) -> DataFrame:
    """String columns whose every value is a number or a boolean get that type, in one pass."""
    if not df.columns:
        return df
    cells = {c: F.trim(F.col(f"`{c}`")) for c in df.columns}
    tests = []
    for i, c in enumerate(df.columns):
        x = cells[c]
        tests += [
            F.bool_and(x.try_cast("bigint").isNotNull() & x.rlike(r"^[+-]?\d+$")).alias(f"i{i}"),
            F.bool_and(x.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$")).alias(f"d{i}"),
            F.bool_and(F.lower(x).isin("true", "false")).alias(f"b{i}"),
        ]
    got = df.agg(*tests).first()
    made = []
    for i, c in enumerate(df.columns):
        kind = "bigint" if got[f"i{i}"] else "double" if got[f"d{i}"] else "boolean" if got[f"b{i}"] else None
        made.append((cells[c].cast(kind) if kind else F.col(f"`{c}`")).alias(c))
    return df.select(*made)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the file or folder, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def _from_columns(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """The rows of one JSON object that holds columns, as lists or by row number; anything else as it is.
    Such an object is one value of a file, which one task reads."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    lists = all(isinstance(k, T.ArrayType) for k in kinds.values())
    numbered = all(isinstance(k, T.StructType) and k.names and all(n.isdigit() for n in k.names) for k in kinds.values())
    if not kinds or not (lists or numbered) or df.limit(2).count() != 1:
        return df
    if not spark.read.text(path).filter("trim(value) <> ''").first()[0].lstrip().startswith("{"):
        return df
    arrays = [F.col(f"`{c}`") for c in kinds]
    if numbered:
        rows = sorted({n for k in kinds.values() for n in k.names}, key=int)
        arrays = []
        for c, k in kinds.items():
            types = {k[n].dataType.simpleString() for n in k.names}
            cells = [F.col(f"`{c}`").getField(n) if n in k.names else F.lit(None) for n in rows]
            mixed = len(types) > 1 and types != {"bigint", "double"}
            arrays.append(F.array(*[x.cast("string") if mixed else x for x in cells]))
    named = df.select(*[a.alias(f"c{i}") for i, a in enumerate(arrays)])
    return named.select(F.explode(F.arrays_zip(*named.columns)).alias("r")).select("r.*").toDF(*kinds)


def read_table(spark: SparkSession, path: str, multiline: bool = False, infer: bool = True, max_mb: float = 0) -> DataFrame:
    """The table at ``path`` (any store that Spark reads). ``multiline`` allows line feeds in
    quoted cells, at the cost of one task for each file. Raises TableError without rows, or where the
    input is larger than ``max_mb`` (0 or less: no limit)."""
    ext = suffix_of(path)
    if max_mb > 0 and size_of(spark, path) > max_mb * 2**20:
        raise TableError(f"the input is larger than {max_mb:g} MB")
    if ext in (".csv", ".tsv", ".txt"):
        df = spark.read.csv(path, sep=FORMATS[ext], header=False, multiLine=multiline, escape='"', ignoreLeadingWhiteSpace=False)
        head = df.first()
        if head is None:
            raise TableError("the file is empty")
        names = clean_names([x or f"column_{i}" for i, x in enumerate(head)])
        first = spark.read.option("header", True).csv(path, sep=FORMATS[ext], multiLine=multiline, escape='"', enforceSchema=True, schema=T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]))
        df = first.toDF(*names)
        df = df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in names])
        df = _inferred(df) if infer else df
    elif ext in (".json", ".jsonl"):
        df = spark.read.json(path, multiLine=ext == ".json")
        df = _from_columns(spark, df, path) if ext == ".json" else df
        df = df.toDF(*clean_names(df.columns))
    elif ext == ".parquet":
        df = spark.read.parquet(path)
    else:
        try:
            import openpyxl  # noqa: F401
            import pandas as pd
        except ImportError as e:
            raise TableError("reading .xlsx needs openpyxl") from e
        sheet = pd.read_excel(path)  # a workbook sheet has at most 1048576 rows
        df = spark.createDataFrame(sheet.set_axis(clean_names([str(c) for c in sheet.columns]), axis=1))
    if df.isEmpty():
        raise TableError("the table has no rows")
    return df


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based place of each row: files in order of their paths, rows as they stand in them. Nothing is written where the rows come
    straight from files; no task sees all rows."""
    found = _by_file(df, name)
    return found if found is not None else _by_partition(df, name)


def _numbered(rows: DataFrame, keys: list[str], place, name: str, columns: list[str], least) -> DataFrame:
    """``rows`` with the number of rows of all groups before theirs (by ``keys``, few: files or their splits), plus their place in their own."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), least.alias("__least"))
    before = sizes.select(*keys, "__least", (F.sum("__n").over(Window.orderBy(*keys)) - F.col("__n")).alias("__before"))  # a row for each file or split
    return rows.join(F.broadcast(before), keys).withColumn(name, (F.col("__before") + place).cast("bigint")).select(*[F.col(f"`{c}`") for c in columns], name)


def _by_file(df: DataFrame, name: str) -> DataFrame | None:
    """By what the scan knows of each row: in Parquet its place in the file, elsewhere the split that it comes from. None where
    the rows don't come straight from files."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    for fields, place in ((("file_path", "row_index"), F.col("__row_index")), (("file_path", "file_block_start"), F.col("__id") - F.col("__least"))):
        try:
            rows = df.select(*columns, *[F.col(f"_metadata.{f}").alias(f"__{f}") for f in fields])
            if "file_block_start" in fields:
                rows = rows.withColumn("__id", F.monotonically_increasing_id())  # grows along a split
                return _numbered(rows, ["__file_path", "__file_block_start"], place, name, df.columns, F.min("__id"))
            return _numbered(rows, ["__file_path"], place, name, df.columns, F.lit(0))
        except AnalysisException:
            continue
    return None


def _by_partition(df: DataFrame, name: str) -> DataFrame:
    """By partition, in reading order. The table is written once, so that a row's partition can't change."""
    placed = written(df.withColumn("__id", F.monotonically_increasing_id()))
    rows = placed.withColumn("__part", F.shiftright("__id", 33))
    return _numbered(rows, ["__part"], F.col("__id").bitwiseAND(F.lit(2**33 - 1)), name, df.columns, F.lit(0))


def metadata(df: DataFrame, preview: int = 10) -> dict:
    """Counts, names and the first rows (by ``row_index`` where there is one), as JSON has them."""
    shown = [c for c in df.columns if c != "row_index"]
    first = df.orderBy("row_index").limit(preview) if "row_index" in df.columns else df.limit(preview)
    rows = [{k: json_safe(v) for k, v in r.asDict(recursive=True).items()} for r in first.select(*[F.col(f"`{c}`") for c in shown]).collect()]
    return {"row_count": df.count(), "column_count": len(shown), "columns": shown, "preview": rows}


def json_safe(v):
    """``v`` as JSON can hold it: null for NaN and infinities, ISO text for times, numbers for decimals, hexadecimal text for bytes."""
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [json_safe(x) for x in v]
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, Decimal):
        return json_safe(float(v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v.isoformat() if hasattr(v, "isoformat") else v


def url_filename(url: str, hint: str | None = None) -> str:
    """The table's file name for a URL: the hint, the path's last part, or a query parameter."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise TableError("only http and https addresses")
    given = dict(parse_qsl(parts.query))
    likely = [given[k] for k in ("filename", "file", "name", "key", "path", "download") if k in given]
    for name in [hint, unquote(parts.path).rsplit("/", 1)[-1], *likely, *given.values()]:
        name = (name or "").rsplit("/", 1)[-1].strip()
        if name and any(name.lower().endswith(x) for x in FORMATS):
            return name
    raise TableError("the address names no supported file")


def capabilities(max_mb: float = 0) -> dict:
    return {"formats": sorted(FORMATS), "max_upload_mb": max_mb if max_mb > 0 else None, "stores": "any path that Spark reads"}
