"""What several operators share: tables, durable intermediate results, components, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read by Spark alone (the folder may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a single-machine master without that setting gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_lumen_scratch", None)
    if made is None:
        made = spark._lumen_scratch = tempfile.mkdtemp(prefix="spark-lumen-")
    return made


#: Shuffle files go when their query ends, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before else spark.conf.unset(CLEAN_UP)
    return spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and
    a lost executor costs nothing that was written."""
    return _written(df, f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


#: So many rows go to Python at once. Both sides hold whole batches, so 10 000 documents of some kilobytes take a task hundreds of megabytes.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def in_small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS``; a session that states a smaller number keeps it."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` and what it holds, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Durable tables of one operator, which go together once its result is durable too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.made = spark, f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def durable(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.made += 1
        return _written(df, f"{self.base}/{label}-{self.made}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed) -> None:
        delete(self.spark, self.base)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (columns ``a`` and ``b``, same type).

    Returns ``node``, ``root`` with root the smallest node of the component; only nodes
    with an edge to another node appear. Alternates star contractions, each a min
    aggregate joined back, so that no group is held in one place; the rounds
    grow with the logarithm of the longest path. Each round's table goes when the next is written.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(low.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    with Scratch(edges.sparkSession) as kept:
        now = kept.durable(edges.select("a", "b").filter("a <> b").distinct(), "edges")
        seen = mark(now)
        for _ in range(max_rounds):
            if not seen[0]:
                break
            after = kept.durable(small_star(large_star(now)), "edges")
            marked = mark(after)
            now, done, seen = after, marked == seen, marked
            if done:
                break
        else:
            raise RuntimeError("components did not settle")
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
        return durable(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "components")


def ahead(array: Column, *values: Column) -> Column:
    """``array``, to be exploded. As its expression now needs ``values``, generated code computes
    them before its loop over the elements; otherwise it does so anew for each element."""
    return F.when(F.hash(*values).bitwiseOR(F.lit(1)) != 0, array)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, compared as Spark compares names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo; null keys go with the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
