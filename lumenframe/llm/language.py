"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes, forwards and backwards, and gives every byte
position a distribution over the languages; a document's distribution is the mean over all
its positions. It is trained in numpy by backpropagation through time on a bounded sample of
labelled rows: ``SAMPLE_ROWS`` snippets of ``SNIPPET`` characters. Labelling covers every
byte of every text.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is
every text when there is nothing to learn from. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
WINDOW = 96
HIDDEN = 8
BATCH = 2048
SAMPLE_ROWS = 3000
SNIPPET = 384
LEAST_STEPS = 600
#: Texts are labelled in lots of about this many bytes.
LOT = 4 << 20


class BiGru:
    """Parameters have a leading axis of two: forward and backward. Units run along rows and
    windows along columns, so that every gate is one contiguous block."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        f = np.float32
        self.p = {
            "x": rng.normal(0, 0.5, (2, 3 * hidden, 256)).astype(f),  # input part of the gates, for each byte
            "u": rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(f),
            "v": rng.normal(0, 0.3, (2, len(languages), hidden)).astype(f),
            "c": np.zeros(len(languages), f),
        }

    def states(self, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states (direction, step, unit, window) of ``codes`` (window, byte); the
        backward direction's step 0 reads the last byte."""
        n, steps = codes.shape
        h2 = 2 * self.hidden
        order = np.stack([codes.T, codes.T[::-1]]).astype(np.intp)
        x, u = self.p["x"], self.p["u"]
        h = np.zeros((2, self.hidden, n), np.float32)
        out = np.empty((2, steps, self.hidden, n), np.float32)
        gates = np.empty((2, 3 * self.hidden, n), np.float32)
        for t in range(steps):
            for d in (0, 1):
                np.take(x[d], order[d, t], axis=1, out=gates[d], mode="clip")
            own = u @ h
            zr = gates[:, :h2] + own[:, :h2]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, : self.hidden], zr[:, self.hidden :]
            new = r * own[:, h2:]
            new += gates[:, h2:]
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((h, z, r, new, own[:, h2:]))
            h = h - new
            h *= z
            h += new
            out[:, t] = h
        return out

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (step, language, window) of every position."""
        logits = self.p["v"][0] @ states[0] + self.p["v"][1] @ states[1, ::-1] + self.p["c"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        trace: list = []
        states = self.states(codes, trace)
        probs = self.positions(states)
        steps, _, n = probs.shape
        at = np.arange(n)
        loss = -float(np.log(probs[:, labels, at] + 1e-9).mean())
        d = probs
        d[:, labels, at] -= 1
        d /= steps * n
        back = states[1, ::-1]
        v, u, hidden = self.p["v"], self.p["u"], self.hidden
        g = {"c": d.sum(axis=(0, 2)), "v": np.stack([np.einsum("tlb,thb->lh", d, states[0], optimize=True), np.einsum("tlb,thb->lh", d, back, optimize=True)])}
        down = np.stack([v[0].T @ d, (v[1].T @ d)[::-1]])
        g["u"] = np.zeros_like(u)
        inputs = np.empty((2, steps, 3 * hidden, n), np.float32)
        carry = np.zeros((2, hidden, n), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, own = trace[t]
            dh = down[:, t] + carry
            dz = dh * (before - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * own * r * (1 - r)
            part = np.concatenate([dz, dr, dn * r], axis=1)
            carry = dh * z + u.transpose(0, 2, 1) @ part
            g["u"] += part @ before.transpose(0, 2, 1)
            inputs[:, t] = np.concatenate([dz, dr, dn], axis=1)
        g["x"] = np.zeros_like(self.p["x"])
        for k, order in enumerate((codes.T, codes.T[::-1])):
            place = order.reshape(-1)
            for i in range(3 * hidden):
                g["x"][k, i] = np.bincount(place, inputs[k, :, i].reshape(-1), minlength=256)
        return loss, g

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (text, language); zeros for empty texts."""
        counts = np.array([-(-len(t) // WINDOW) for t in texts])
        codes = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
        used = np.full(int(counts.sum()), WINDOW)
        ends = np.cumsum(counts)
        for t, end, k in zip(texts, ends.tolist(), counts.tolist(), strict=True):
            if k:
                lo = (end - k) * WINDOW
                codes[lo : lo + len(t)] = np.frombuffer(t, np.uint8)
                used[end - 1] = len(t) - (k - 1) * WINDOW
        codes = codes.reshape(-1, WINDOW)
        sums = np.zeros((len(codes) + 1, len(self.languages)))
        for lo in range(0, len(codes), BATCH):
            probs = self.positions(self.states(codes[lo : lo + BATCH]))
            inside = np.arange(WINDOW)[:, None] < used[lo : lo + BATCH]
            sums[lo + 1 : lo + 1 + BATCH] = np.einsum("tlb,tb->bl", probs, inside.astype(np.float32), optimize=True)
        total = np.cumsum(sums, axis=0)
        out = total[ends] - total[ends - counts]
        return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def train(snippets: list[tuple[str, bytes]], epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 5) -> BiGru | None:
    """A network from (language, text) pairs; None without any."""
    languages = sorted({s[0] for s in snippets})
    windows, labels = [], []
    for lang, raw in snippets:
        for lo in range(0, len(raw), WINDOW):
            part = raw[lo : lo + WINDOW]
            windows.append(np.frombuffer(part.ljust(WINDOW, b"\0"), np.uint8))
            labels.append(languages.index(lang))
    if not windows:
        return None
    net = BiGru(languages)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(labels) // batch)))  # a small sample is seen more often
    codes, y = np.stack(windows), np.array(labels)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            _, g = net.gradients(codes[pick], y[pick])
            size = sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()) ** 0.5
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, x in g.items():
                x = (x * min(1.0, 1.0 / (size + 1e-12))).astype(np.float32)
                m[k] += 0.1 * (x - m[k])
                s[k] += 0.001 * (x * x - s[k])
                net.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", learn_from: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> BiGru | None:
    """A network learned from the rows of ``docs`` with a language and a letter; ``learn_from``
    (over the columns of ``docs``) says which rows may be used. The sample are the snippets
    of smallest hash; a snippet begins at a place that its text's hash gives."""
    rows = docs.filter(learn_from) if learn_from is not None else docs
    t = F.col(f"`{text}`").cast("string")
    rows = rows.filter(F.col(f"`{lang}`").isNotNull() & t.rlike(r"\p{L}")).select(F.col(f"`{lang}`").cast("string").alias("lang"), t.alias("t"), F.xxhash64(t).alias("h"))
    begin = F.pmod("h", F.greatest(F.length("t") - SNIPPET, F.lit(1))) + 1
    rows = rows.select("h", "lang", F.substring(F.col("t"), begin.cast("int"), F.lit(SNIPPET)).alias("t"))
    # About four times the sample pass this threshold, whatever the size of the table; the
    # texts' own hashes decide, so copies of a text are in or out together.
    share = min(1.0, 4 * sample_rows / max(1, docs.count()))
    rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    got = rows.orderBy(F.xxhash64("h"), "lang", "t").limit(sample_rows).collect()
    return train([(r["lang"], r["t"].encode()) for r in got])


def with_language(docs: DataFrame, net: BiGru | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs``, ``lang`` and ``score`` (replaced if there)."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # some KB
    rest = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    t = F.col(f"`{text}`").cast("string")
    slim = docs.select(F.when(t.rlike(r"\p{L}"), t).alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            langs: list[str] = []
            scores: list[float] = []
            lot: list[bytes] = []

            def label() -> None:
                probs = net.pooled(lot) if net else np.zeros((len(lot), 1))
                for t, row in zip(lot, probs, strict=True):
                    best = int(row.argmax())
                    langs.append(net.languages[best] if net and t else UNDETERMINED)
                    scores.append(min(1.0, float(row[best])) if net and t else 0.0)
                lot.clear()

            size = 0
            for t in b.column(0):
                lot.append((t.as_py() or "").encode())
                size += len(lot[-1])
                if size >= LOT:
                    label()
                    size = 0
            label()
            yield pa.record_batch([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[1:], "__lang", "__score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]), "__lang string, __score double"])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(rest)], F.col("__lang").alias(lang), F.col("__score").alias(score))
