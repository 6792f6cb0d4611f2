"""Token counts by the whole-token shortcut.

For every string of the vocabulary that is a whole pre-token, merging it offline proves
whether it encodes alone as one token. A text's pre-tokens that are in the proven set count
as one each, straight from a hash set; only the rest are merged.

Defined results: null and empty texts have no bytes and no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, loaded, vocabulary

REMEMBERED = 200_000


def proven_whole(bpe: Bpe) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and merge to one token."""
    out = set()
    for raw in bpe.table.values():
        try:
            s = raw.decode()
        except UnicodeDecodeError:
            continue
        if s not in bpe.specials and bpe.pieces(s) == [s] and len(bpe.merge(raw)) == 1:
            out.add(s)
    return frozenset(out)


class Counter:
    """Counts tokens; ``whole`` are the proven strings."""

    def __init__(self, bpe: Bpe, whole: frozenset[str]):
        self.bpe, self.whole = bpe, whole
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def rest(self, piece: str) -> int:
        n = self.young.get(piece) or self.old.get(piece) or len(self.bpe.merge(piece.encode()))
        if len(piece) <= 48:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[piece] = n
        return n

    def count(self, text: str) -> int:
        n, known, bpe = 0, self.young, self.bpe
        for part in bpe.cut.split(text) if bpe.cut else [text]:
            if part in bpe.specials:
                n += 1
                continue
            pieces = bpe.pieces(part)
            left = [p for p in pieces if p not in self.whole]
            n += len(pieces) - len(left)
            for p in left:
                n += known.get(p) or self.rest(p)
            known = self.young
        return n


_counters: dict[int, Counter] = {}


def with_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """All columns of ``df``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``
    tokens); columns of ``df`` with these names are replaced."""
    spark = df.sparkSession
    source = vocabulary(spark, path)
    proven = spark.sparkContext.broadcast(proven_whole(Bpe(source.value)))  # part of the vocabulary
    added = ["n_bytes", "n_tokens", "over_limit"]
    rest = [c for c in df.columns if c.lower() not in added]
    slim = df.select(F.col(text).cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        if id(bpe) not in _counters:
            _counters.clear()
            _counters[id(bpe)] = Counter(bpe, proven.value)
        count = _counters[id(bpe)].count
        for b in batches:
            counts = pa.array([count(t.as_py() or "") for t in b.column(0)], pa.int64())
            sizes = pa.array([len((t.as_py() or "").encode()) for t in b.column(0)], pa.int64())
            yield pa.record_batch([*b.columns[1:], sizes, counts], names=[*b.schema.names[1:], "n_bytes", "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]), "n_bytes bigint", "n_tokens bigint"])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(rest)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
