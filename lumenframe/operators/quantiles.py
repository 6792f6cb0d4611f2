"""Exact quantiles by distributed selection, with states of fixed size.

One scan makes a mergeable rank sketch (KLL) of every column, whose rank error bounds bracket each
wanted rank. A second scan only counts: values below the bracket, at its ends, inside. A third reads the values strictly
inside, of which the sketch leaves about ``6 / K`` of all; where that is more than ``KEPT``, the inside is sketched in its turn
instead, so that each further round divides what is left by some hundreds. Counts prove every answer: a bracket that
misses its rank, as a sketch may by chance, is widened to the column's end and the search goes on. All columns share all scans."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch (its rank error is about 2.3 / K), and values that reach the driver for one bracket at most.
K, KEPT = 1_000, 20_000


@dataclass
class _Bracket:
    """The search for the values at the 0-based ranks ``first`` and ``last`` (the same or neighbours) of a column."""

    column: str
    first: int
    last: int
    low: float
    high: float
    below: int = 0
    at_low: int = 0
    inside: int = 0
    at_high: int = 0


def _known(x: Column) -> Column:
    d = x.cast("double")
    return F.when(~F.isnan(d), d)


def _ends(sketch: Column, low: float, high: float) -> Column:
    """The sketch's values at two fractions."""
    return F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, f)))) for f in (low, high)])


def _counted(df: DataFrame, open_: list[_Bracket]) -> None:
    sums = []
    for i, b in enumerate(open_):
        x = F.col(b.column)
        sums += [F.sum(c.cast("bigint")).alias(f"{n}{i}") for n, c in (("b", x < b.low), ("l", x == b.low), ("i", (x > b.low) & (x < b.high)), ("h", x == b.high))]
    got = df.agg(*sums).first()
    for i, b in enumerate(open_):
        b.below, b.at_low, b.inside = got[f"b{i}"], got[f"l{i}"], got[f"i{i}"]
        b.at_high = got[f"h{i}"] if b.high > b.low else 0


def _settled(b: _Bracket, rank: int) -> float | None:
    """The value at ``rank`` if it stands at an end of the bracket."""
    place = rank - b.below
    if 0 <= place < b.at_low:
        return b.low
    return b.high if b.at_low + b.inside <= place < b.at_low + b.inside + b.at_high else None


def _sketch(x: Column, k: int) -> Column:
    return F.kll_sketch_agg_double(x, F.lit(k))


def _collected(df: DataFrame, tests: dict[int, Column], columns: dict[int, str]) -> dict[int, list[float]]:
    """The sorted values that pass each test, few by the caller's count, in one scan."""
    hit = reduce(lambda a, b: a | b, tests.values())
    got = df.filter(hit).agg(*[F.sort_array(F.collect_list(F.when(t, F.col(columns[i])))).alias(f"v{i}") for i, t in tests.items()]).first()
    return {i: got[f"v{i}"] for i in tests}


def selected(df: DataFrame, brackets: list[_Bracket], ends: dict[str, tuple[float, float]], k: int, kept: int) -> dict[tuple[str, int], float]:
    """The values at the ranks of all brackets; ``df`` has the columns as doubles."""
    found: dict[tuple[str, int], float] = {}
    open_ = brackets
    for _ in range(60):
        if open_:
            _counted(df, open_)
        far, near = [], []
        for b in open_:
            ranks = [r for r in {b.first, b.last} if (b.column, r) not in found]
            for r in ranks:
                value = _settled(b, r)
                if value is not None:
                    found[b.column, r] = value
            ranks = [r for r in ranks if (b.column, r) not in found]
            if not ranks:
                continue
            if min(ranks) < b.below:  # a sketch's unlikely miss
                b.low = ends[b.column][0]
                far.append(b)
            elif max(ranks) >= b.below + b.at_low + b.inside + b.at_high:
                b.high = ends[b.column][1]
                far.append(b)
            else:
                (near if b.inside <= kept else far).append(b)
        if near:
            values = _collected(df, {i: (F.col(b.column) > b.low) & (F.col(b.column) < b.high) for i, b in enumerate(near)}, {i: b.column for i, b in enumerate(near)})
            for i, b in enumerate(near):
                v = values[i]
                for r in {b.first, b.last}:
                    if (b.column, r) not in found:
                        found[b.column, r] = v[r - b.below - b.at_low]
        if not far:
            return found
        # what is inside is a smaller problem of the same kind; a bracket whose two ranks part splits
        parts = []
        for i, b in enumerate(far):
            inner = (F.col(b.column) > b.low) & (F.col(b.column) < b.high)
            parts += [_sketch(F.when(inner, F.col(b.column)), k).alias(f"s{i}"), F.sum(inner.cast("bigint")).alias(f"n{i}"), F.sum((F.col(b.column) <= b.low).cast("bigint")).alias(f"u{i}")]
        sizes = df.agg(*parts).first()
        held = df.sparkSession.createDataFrame([tuple(sizes[f"s{i}"] for i in range(len(far)))], ", ".join(f"s{i} binary" for i in range(len(far))))
        open_, asked = [], []
        for i, b in enumerate(far):
            n, under = sizes[f"n{i}"], sizes[f"u{i}"]
            for r in [r for r in {b.first, b.last} if (b.column, r) not in found]:
                if 0 <= r - under < n:
                    margin = 3.0 / k + 2 / n
                    asked.append((b, r, _ends(F.col(f"s{i}"), (r - under) / n - margin, (r - under + 1) / n + margin)))
                else:  # the rank is at an end of the widened bracket
                    open_.append(_Bracket(b.column, r, r, b.low, b.high))
        if asked:
            new = held.select(*[e.alias(f"e{i}") for i, (_, _, e) in enumerate(asked)]).first()
            open_ += [_Bracket(b.column, r, r, *new[f"e{i}"]) for i, (b, r, _) in enumerate(asked)]
    raise RuntimeError("selection did not settle")


def quantiles(df: DataFrame, columns: dict[str, Column], probabilities: tuple[float, ...] | dict[str, tuple[float, ...]], extra: dict[str, Column] | None = None, k: int = K, kept: int = KEPT) -> tuple[dict[str, list[float | None]], dict]:
    """For each of ``columns`` its quantiles, interpolated between neighbouring values, None where it has no values (nulls and
    NaN are none); and the values of the ``extra`` aggregates, which join the first scan."""
    names, others = list(columns), dict(extra or {})
    wanted = probabilities if isinstance(probabilities, dict) else dict.fromkeys(names, probabilities)
    xs = {c: _known(x) for c, x in columns.items()}
    firsts = [a for i, c in enumerate(names) for a in (_sketch(xs[c], k).alias(f"s{i}"), F.count(xs[c]).alias(f"n{i}"), F.min(xs[c]).alias(f"a{i}"), F.max(xs[c]).alias(f"z{i}"))]
    asked = [(i, p) for i, c in enumerate(names) for p in wanted[c]]
    # k values or fewer are in the sketch whole; beyond that a rank's fraction is within 1 / k of its probability
    ends_of = [F.when(F.col(f"n{i}") > 0, _ends(F.col(f"s{i}"), p - 5.0 / k, p + 5.0 / k)).alias(f"e{j}") for j, (i, p) in enumerate(asked)]
    plain = [f"{x}{i}" for i in range(len(names)) for x in "naz"]
    held = df.agg(*firsts, *[c.alias(f"x{i}") for i, c in enumerate(others.values())]).select(*plain, *[f"x{i}" for i in range(len(others))], *ends_of).first()
    counts = {c: held[f"n{i}"] for i, c in enumerate(names)}
    found: dict[tuple[str, int], float] = {}
    few = [i for i, c in enumerate(names) if 0 < counts[c] <= kept and wanted[c]]
    values = df.select(*[xs[c].alias(f"q{i}") for i, c in enumerate(names)])
    if few:  # their values are no more than a bracket's
        sorted_ = _collected(values, {i: F.col(f"q{i}").isNotNull() for i in few}, {i: f"q{i}" for i in few})
        found |= {(f"q{i}", r): x for i in few for r, x in enumerate(sorted_[i])}
    brackets = [_Bracket(f"q{i}", math.floor(p * (counts[names[i]] - 1)), math.ceil(p * (counts[names[i]] - 1)), *held[f"e{j}"]) for j, (i, p) in enumerate(asked) if counts[names[i]] > kept]
    if brackets:
        found |= selected(values, brackets, {f"q{i}": (held[f"a{i}"], held[f"z{i}"]) for i in range(len(names))}, k, kept)
    out: dict[str, list[float | None]] = {c: [] for c in names}
    for i, c in enumerate(names):
        for p in wanted[c]:
            place = p * (counts[c] - 1)
            if not counts[c]:
                out[c].append(None)
                continue
            a, b = found[f"q{i}", math.floor(place)], found[f"q{i}", math.ceil(place)]
            out[c].append(a if a == b else (math.ceil(place) - place) * a + (place - math.floor(place)) * b)
    return out, {c: held[f"x{i}"] for i, c in enumerate(others)}


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, columns, (0.5,))[0].items()}
