"""Periodic runs of words, by bit-parallel lags.

A text's words get ids, and bit k of all ids stands in one big integer, the plane k. A plane
XORed with itself shifted by a lag has ones where words that far apart differ in bit k; ORed
over the planes, the zeros are the words that repeat at that lag. Shift-doubling ANDs of the
complement leave only the places where enough zeros follow each other.

A run of period q and length l >= 4 q has l - q >= 3 q such zeros. For lags of more than
``DIRECT`` words those cover whole aligned blocks of s words (s < q <= 2 s, s a power of two),
so a lag is only tried where the rolling hash of some aligned block comes again at that lag:
no run is missed, and the work grows with n log n instead of its square. All tried lags go
through the planes.

Defined results: null, empty and blank texts have no words, no runs and collapse to the empty
text. Words are told apart by their bytes. Repeated rows stay; columns of the table that have
the name of an added one are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, fresh

#: The least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Lags up to this are tried without a look at block hashes.
DIRECT = 32
SPACES = r"[\x20\x09-\x0D]+"


def planes(ids: np.ndarray) -> list[int]:
    """The bits of all ids: plane k has bit i set where ids[i] has bit k. The lowest come first; as ids count
    up with first occurrences, these tell words apart best."""
    width = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(width)]


def long_ones(z: int, least: int) -> int:
    """The places in ``z`` where ``least`` ones begin."""
    have = 1
    while z and have < least:
        step = min(have, least - have)
        z &= z >> step
        have += step
    return z


def set_bits(z: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(z.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


def stretches(bits: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """First and one past the last place of each maximal stretch of ``least`` or more places whose word comes again ``lag`` words later."""
    mask = (1 << (n - lag)) - 1
    differ = bits[0] ^ (bits[0] >> lag)
    if not long_ones(~differ & mask, least):  # most lags end here
        return []
    for b in bits[1:]:
        differ |= b ^ (b >> lag)
    begin = long_ones(~differ & mask, least)
    if not begin:
        return []
    firsts, lasts = set_bits(begin & ~(begin << 1), n), set_bits(begin & ~(begin >> 1), n)
    return list(zip(firsts.tolist(), (lasts + least).tolist(), strict=True))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def likely_lags(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block size s = 32, 64, ... the lags in (s, 2 s] at which the hash of an aligned block comes again, as three
    arrays: lags, first and one past the last words that the two blocks take."""
    n, s = len(ids), 1
    h = ids.astype(np.uint64)
    while s * LEAST_PERIODS < n:
        if s >= DIRECT:
            rows = (len(h) - 1) // s  # h[1 + j s : 1 + (j + 1) s] are the blocks that begin 1..s words past j s
            if rows < 2:
                return
            later = h[1 + s : 1 + rows * s].reshape(rows - 1, s)
            row, off = np.nonzero(later == h[: (rows - 1) * s : s, None])
            rest = h[1 + rows * s :]  # the part of a last row
            off2 = np.flatnonzero(rest == h[(rows - 1) * s])
            row, off = np.concatenate([row, np.full(len(off2), rows - 1)]), np.concatenate([off, off2])
            yield s + 1 + off, row * s, row * s + s + 1 + off + s
        if len(h) <= s:
            return
        h = _mixed(h[:-s], h[s:])
        s *= 2


def _divisors(q: int) -> list[int]:
    """q divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, q // rest] if rest > 1 else out


def runs_of(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(words)
    if n < least_words:
        return []
    table: dict[bytes, int] = {}
    ids = np.array([table.setdefault(w, len(table)) for w in words], dtype=np.int64)
    bits = planes(ids)
    found: list[tuple[int, int, int]] = []

    def look(lag: int) -> None:
        for lo, hi in stretches(bits, n, lag, max(least_words, least_periods * lag) - lag):
            # a smaller period of so long a run divides it
            if not any((ids[lo : lo + lag - p] == ids[lo + p : lo + lag]).all() for p in _divisors(lag)):
                found.append((lo, hi + lag - lo, lag))

    for lag in range(1, min(DIRECT, n // least_periods) + 1):
        look(lag)
    if n // least_periods > DIRECT:
        for lag, lo, hi in likely_lags(ids):
            # both blocks inside a run whose period divides the lag: the lag is no smallest period there
            # maximal runs of one period don't overlap by a period, so the last that begins before is the only candidate
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for p in {r[2] for r in found}:
                of = sorted((a, a + m) for a, m, q in found if q == p)
                known[p] = (np.array([x[0] for x in of]), np.array([x[1] for x in of]))
            left = lag <= n // least_periods
            for p, (begins, ends) in known.items():
                k = np.searchsorted(begins, lo, "right") - 1
                left &= ~((lag % p == 0) & (k >= 0) & (ends[np.maximum(k, 0)] >= hi))
            for q in np.unique(lag[left]).tolist():
                look(q)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", short: str = "collapsed") -> DataFrame:
    """All columns of ``df``, ``runs`` (array of start, length, period, by start and period) and ``short`` (the collapsed text)."""
    added = {runs.lower(), short.lower()}
    rest = [c for c in df.columns if c.lower() not in added]
    slim = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)])
    of_run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, texts = [], []
            for t in b.column(0):
                words = (t.as_py() or "").encode().split()  # bytes: only ASCII white space
                got = runs_of(words)
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in got])
                texts.append(collapsed(words, got).decode())
            yield pa.record_batch([*b.columns[1:], pa.array(lists, of_run), pa.array(texts, pa.string())], names=[*b.schema.names[1:], "__runs", "__short"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]), "__runs array<struct<start:bigint,length:bigint,period:bigint>>, __short string"])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(rest)], F.col("__runs").alias(runs), F.col("__short").alias(short))


def planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with periods planted in a tenth of the texts: with h = crc32 of the key's decimal text (null: the empty text),
    g = h // 10 and n words, where h % 10 = 0 each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8)."""
    h = crc_bucket(F.col(f"`{key}`"), 2**32)
    name, col = fresh(df, "words"), F.col(f"`{text}`").cast("string")
    words = F.filter(F.split(col, SPACES), lambda w: w != "")
    n, g = F.size(name).cast("bigint"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))

    def word(i: Column) -> Column:
        return F.get(F.col(name), F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

    chosen = F.when(h % 10 == 0, words)
    made = F.when(F.size(name) > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), word), " "))
    return df.withColumn(name, chosen).withColumn(text, F.coalesce(made, col)).drop(name)


def figures(runs: str = "runs", short: str = "collapsed") -> list[Column]:
    """The digest of a row of with_runs(): n_runs, the longest run, and two checksums."""
    longest = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 0)
    line = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return [
        F.size(runs).cast("bigint").alias("n_runs"), longest["s"].alias("start"), (-longest["l"]).alias("length"), longest["p"].alias("period"),
        F.floor(-1000 * longest["l"] / longest["p"]).cast("bigint").alias("exponent_milli"), F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode(F.col(short), "UTF-8"), 256).alias("collapsed_sha256")]
