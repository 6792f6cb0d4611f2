"""Sessions as the analysis expects them, and intermediate tables with owners."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lumenframe", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the master and sizes come from outside."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def scratch_base(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, ``spark.checkpoint.dir``; a single-machine master may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local.get(spark.sparkContext.applicationId) is None:
        _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-lumen-")
    return _local[spark.sparkContext.applicationId]


_local: dict[str, str] = {}


class Owner:
    """A folder of intermediate tables that go together. Each user holds it; the last to let go deletes it, in whatever store it is."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.users = spark, f"{scratch_base(spark)}/owned-{uuid.uuid4().hex}", 1

    def hold(self) -> Owner:
        self.users += 1
        return self

    def let_go(self) -> None:
        self.users -= 1
        if not self.users:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/t-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


_owner: ContextVar[Owner | None] = ContextVar("owner", default=None)


@contextmanager
def into(owner: Owner) -> Iterator[Owner]:
    """What is written inside belongs to ``owner``."""
    token = _owner.set(owner)
    try:
        yield owner
    finally:
        _owner.reset(token)


@contextmanager
def owned(spark: SparkSession) -> Iterator[Owner]:
    """What is written inside goes when it ends, unless someone else holds it by then. For results that are final: rows collected, or
    tables written elsewhere."""
    owner = Owner(spark)
    try:
        with into(owner):
            yield owner
    finally:
        owner.let_go()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here. It belongs to the owner in whose scope it is made; without
    one it stays, as a lazy result may read it at any time."""
    owner = _owner.get()
    if owner is not None:
        return owner.written(df)
    path = f"{scratch_base(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
