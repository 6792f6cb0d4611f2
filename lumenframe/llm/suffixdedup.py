"""Removal of repeated byte strings, by merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else, in another
document or in the same one. Strings that are equal have to meet in one task, and no task may see the corpus:

1. Every window of ``LENGTH`` bytes is filed under its minimizer, the gram of least hash in it. Windows in a row with
   the same minimizer are a span; equal windows have the same gram at the same place, so only spans that share a gram can hold
   equal windows. Equal spans are counted by hash before they travel: all their windows are repeated.
2. Spans that share their gram with other spans ("rivals") send their bytes, once for each kind, to the gram's task. There each
   shard of some 64 KB gets its own suffix order and Burrows-Wheeler transform, and the shards are merged by refining
   their interleave: round h puts the suffixes in order of their first h bytes by a stable distribution over
   the transform's symbols and a step back (LF) in each shard. No suffixes are sorted again. A suffix alone in its block has its longest
   common prefix and leaves; those still in company after ``LENGTH`` rounds are the repeated windows.
3. A gram with more than ``CROWD`` kinds of spans (a short passage in very many documents) would gather too much in one task;
   its windows are counted by their 128-bit hashes instead, which is exact too, and spread over all tasks.

Defined results: null and empty texts have no bytes; texts below ``LENGTH`` bytes lose none. Runs of removed bytes that touch
are one. What is kept can end inside a character, so it is binary. Each row is an occurrence, repeated rows too. Columns of the
table that have the name of an added one are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH = 200
#: Bytes of a shard with a transform of its own, and of the shards that are merged at once.
SHARD, MERGED = 1 << 16, 1 << 19
#: Kinds of spans that meet in one task for one gram.
CROWD = 2000
#: Windows that are looked at together.
BLOCK = 1 << 16
WIDTH = 1024  # more than a span has windows: start and number of windows share one integer

_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)  # any fixed mixing of bytes


def gram_of(length: int) -> int:
    """Bytes of a gram: the power of two up to a third of a window. Longer grams are shared by chance less often, shorter ones make fewer spans."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def spans_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, first windows and numbers of windows of the spans of ``data``."""
    gram, n = gram_of(length), len(data) - length + 1
    seeds, starts, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], -1
    for lo in range(0, max(n, 0), BLOCK):
        part = np.frombuffer(data, np.uint8)[lo : min(lo + BLOCK, n) + length - 1]
        h, have = _BYTES[part], 1
        while have < gram:
            h = (h[:-have] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[have:] + np.uint64(0x632BE59BD9B4E019))
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            have *= 2
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # the first of equal hashes wins
        have = 1
        while have < length - gram + 1:
            step = min(have, length - gram + 1 - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[at[0] + lo != last], at[1:] != at[:-1]])
        starts.append(np.flatnonzero(new) + lo)
        seeds.append(h[at[new]])
        last = int(at[-1]) + lo
    begin = np.concatenate(starts)
    return np.concatenate(seeds), begin, np.diff(begin, append=max(n, 0))


def _prepared(docs: DataFrame, key_columns: list[str], text: str, length: int) -> DataFrame:
    """Each row with its packed text and its spans (``seed``, ``span``: a hash of the bytes, ``at``: start and number of windows)."""
    slim = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(key_columns)])
    whole = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            packed, sizes, ends, parts = [], [], [0], []
            for t in b.column(0):
                data = (t.as_py() or "").encode()
                seeds, starts, counts = spans_of(data, length)
                spans = np.array([digest(data[i : i + k + length - 1]) for i, k in zip(starts.tolist(), counts.tolist(), strict=True)], dtype=np.uint64)
                parts.append((seeds.view(np.int64), spans.view(np.int64), starts * WIDTH + counts))
                packed.append(pack(data))
                sizes.append(len(data))
                ends.append(ends[-1] + len(starts))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64())) for k in range(3)]
            yield pa.record_batch([*b.columns[1:], pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), *[x.cast(whole) for x in lists]], names=[*b.schema.names[1:], "packed", "n_bytes", "seed", "span", "at"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]), "packed binary", "n_bytes bigint", "seed array<bigint>", "span array<bigint>", "at array<bigint>"])
    return slim.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id())


def transform(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's suffix order by the first ``depth`` symbols, the symbol before each suffix in that order (its Burrows-Wheeler
    transform) and the step back (LF): the place in the order of the suffix that starts one symbol before."""
    n, have = len(data), 8
    padded = np.concatenate([data, np.zeros(have, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)  # eight symbols to a number: the first round
    for k in range(have):
        first = (first << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(first, kind="stable")
    k = first[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
    while True:
        sorted_ = rank[order]
        if have >= depth or (sorted_[1:] != sorted_[:-1]).all():
            break
        key = rank * (int(rank.max()) + 2)
        key[: max(0, n - have)] += rank[have:] + 1  # none: the least
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        have *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, data[order - 1], place[order - 1]


def repeated(strings: list[bytes], length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """For each of ``strings`` the places at which a substring of ``length`` bytes starts that also starts elsewhere in them."""
    shards: list[list[int]] = []
    size = shard
    for i, s in enumerate(strings):
        if size + len(s) + 1 > shard:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(s) + 1
    owner, offset, ends, before, back, base = [], [], [], [], [], 0
    for of in shards:
        # each byte one up (UTF-8 has no 255), 0 in front of each string and at the end
        data = np.concatenate([*(x for i in of for x in (np.zeros(1, np.uint8), np.frombuffer(strings[i], np.uint8) + np.uint8(1))), np.zeros(1, np.uint8)])
        order, symbols, lf = transform(data, length)
        lengths = np.array([len(strings[i]) + 1 for i in of])
        begins = np.cumsum(lengths) - lengths
        own = np.append(np.repeat(np.arange(len(of)), lengths), 0)
        within = np.arange(len(data)) - begins[own] - 1
        # a window that ends before place p is where all the steps back from p lead
        from_end = np.zeros(len(data), bool)
        for lo, m in zip((begins + 1).tolist(), (lengths - 1).tolist(), strict=True):
            from_end[lo + length : lo + m + 1] = True
        owner.append(np.array(of)[own[order]])
        offset.append(within[order])
        ends.append(from_end[order])
        before.append(symbols)
        back.append((lf + base).astype(np.int32))
        base += len(data)
    who, where, start, symbol, step = (np.concatenate(x) for x in (owner, offset, ends, before, back))
    # The interleave: suffixes of all shards, in order of their first h symbols, and the number of each one's block of equals.
    # Round h needs those only from which the rounds left lead back to a window. Whoever is alone in its block
    # stays alone in later rounds, as do those that a step back makes of it.
    now = np.flatnonzero(start).astype(np.int32)
    block = np.zeros(len(now), np.int32)
    for _ in range(length):
        if not len(now):
            break
        s = symbol[now]
        by = np.argsort(s, kind="stable")  # of small integers: a distribution by counting
        s, block, now = s[by], block[by], step[now[by]]
        new = np.ones(len(now) + 1, bool)  # where a block begins; one more at the end
        new[1:-1] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new[:-1], dtype=np.int32)
        alone = new[:-1] & new[1:]
        if alone.any():
            now, block = now[~alone], block[~alone]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    if len(now):
        by = np.lexsort((where[now], who[now]))
        w, o = who[now][by], where[now][by]
        for part, i in zip(np.split(o, np.flatnonzero(np.diff(w)) + 1), np.unique(w), strict=True):
            out[i] = part
    return out


def _cut(length: int, packed: DataFrame) -> DataFrame:
    """The bytes of wanted spans: rows of ``packed``, ``wanted`` (seed, at, single, crowded) and ``rid`` to a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for rid, text, wanted in zip(*[b.column(i) for i in range(3)], strict=True):
                data, rows = unpack(text.as_py()), wanted.as_py()
                starts = [w["at"] // WIDTH for w in rows]
                cut = [data[i : i + w["at"] % WIDTH + length - 1] for i, w in zip(starts, rows, strict=True)]
                yield pa.record_batch([
                    pa.array([w["seed"] for w in rows], pa.int64()), pa.array([rid.as_py()] * len(rows), pa.int64()), pa.array(starts, pa.int64()), pa.array([w["single"] for w in rows]), pa.array([w["crowded"] for w in rows]),
                    pa.array(cut, pa.binary())], names=["seed", "rid", "start", "single", "crowded", "bytes"])

    return packed.mapInArrow(run, "seed bigint, rid bigint, start bigint, single boolean, crowded boolean, bytes binary")


def _merged(strings: DataFrame, length: int) -> DataFrame:
    """``rid``, ``first`` and ``last`` window of the repeated stretches of single spans; all spans of a gram are in one task, in a row."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        rids, firsts, lasts = [], [], []
        for (_, rid, start, single, _), at in zip(rows, repeated([r[4] for r in rows], length), strict=True):
            if single and len(at):
                cut = np.flatnonzero(np.diff(at) != 1)
                a, z = np.concatenate([at[:1], at[cut + 1]]), np.concatenate([at[cut], at[-1:]])
                rids += [rid] * len(a)
                firsts += (a + start).tolist()
                lasts += (z + start).tolist()
        return pa.record_batch([pa.array(x, pa.int64()) for x in (rids, firsts, lasts)], names=["rid", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, seed = 0, None
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[0] != seed and size > MERGED:
                    yield found(rows)
                    rows, size = [], 0
                seed = r[0]
                rows.append(r)
                size += len(r[4])
        if rows:
            yield found(rows)

    spread = strings.select("seed", "rid", "start", "single", "bytes").repartition("seed").sortWithinPartitions("seed")
    return spread.mapInArrow(run, "rid bigint, first bigint, last bigint")


def _windows(strings: DataFrame, length: int) -> DataFrame:
    """Every window of ``strings`` with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for rid, start, single, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n = len(data) - length + 1
                hashes = np.frombuffer(b"".join(digest(data[i : i + length]) for i in range(n)), "<i8").reshape(n, 2)
                yield pa.record_batch([pa.array(np.full(n, rid)), pa.array(np.arange(start, start + n)), pa.array([single] * n), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=["rid", "first", "single", "h0", "h1"])

    return strings.select("rid", "start", "single", "bytes").mapInArrow(run, "rid bigint, first bigint, single boolean, h0 bigint, h1 bigint")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``n_bytes``, ``removed`` (array of first and one past the last byte of each removed
    run) and ``kept`` (binary: the rest)."""
    added = {text.lower(), "n_bytes", "removed", "kept"}
    rest = [c for c in docs.columns if c.lower() not in added]
    scratch = Scratch(docs.sparkSession)
    rows = scratch.durable(_prepared(docs, rest, text, length), "texts")
    spans = rows.select("rid", F.explode(F.arrays_zip("seed", "span", "at")).alias("s")).select("rid", "s.*")
    # written, so that the join below reads two plain shuffles, of which adaptive execution splits a hot gram's part
    shared = scratch.durable(spans.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed"), "seeds")
    shared = scratch.durable(spans.join(shared, "seed"), "shared")
    # first(): any occurrence of a kind has the same bytes
    kinds = shared.groupBy("seed", "span").agg(F.count(F.lit(1)).alias("n"), F.first("rid").alias("rid"), F.first("at").alias("at"))
    kinds = scratch.durable(kinds, "kinds")
    rivals = kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    whole = shared.join(kinds.filter("n > 1").select("seed", "span"), ["seed", "span"]).select("rid", F.floor(F.col("at") / WIDTH).alias("first"), (F.floor(F.col("at") / WIDTH) + F.col("at") % WIDTH - 1).alias("last"))
    wanted = kinds.join(rivals, "seed").groupBy("rid").agg(F.collect_list(F.struct("seed", "at", (F.col("n") == 1).alias("single"), (F.col("kinds") > crowd).alias("crowded"))).alias("wanted"))  # spans of one text
    strings = scratch.durable(_cut(length, rows.select("rid", "packed").join(wanted, "rid").select("rid", "packed", "wanted")), "strings")
    met = _merged(strings.filter("not crowded"), length)
    windows = scratch.durable(_windows(strings.filter("crowded"), length), "windows")
    again = windows.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h0", "h1")
    crowded = windows.filter("single").join(again, ["h0", "h1"]).select("rid", "first", F.col("first").alias("last"))
    gone = whole.unionByName(met).unionByName(crowded)
    gone = gone.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("gone"))  # windows of one text
    out = rows.drop("seed", "span", "at").join(gone, "rid", "left").drop("rid")
    of_run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            kept, runs = [], []
            for text_, gone_ in zip(b.column(b.schema.get_field_index("packed")), b.column(b.schema.get_field_index("gone")), strict=True):
                data, left, end = unpack(text_.as_py()), [], 0
                made: list[dict] = []
                for g in sorted((g["first"], g["last"] + length) for g in gone_.as_py() or []):
                    if made and g[0] <= made[-1]["end"]:
                        made[-1]["end"] = max(made[-1]["end"], g[1])
                    else:
                        made.append({"start": g[0], "end": g[1]})
                for r in made:
                    left.append(data[end : r["start"]])
                    end = r["end"]
                kept.append(b"".join([*left, data[end:]]))
                runs.append(made)
            names = [x for x in b.schema.names if x not in ("packed", "gone")]
            yield pa.record_batch([*[b.column(b.schema.get_field_index(x)) for x in names], pa.array(runs, of_run), pa.array(kept, pa.binary())], names=[*names, "removed", "kept"])

    fields = [f for f in out.schema.fields if f.name not in ("packed", "gone")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "removed array<struct<start:bigint,end:bigint>>", "kept binary"])
    return out.mapInArrow(run, schema).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(rest)], "n_bytes", "removed", "kept")
