"""Byte-level BPE: encoding and decoding with a given vocabulary.

A pre-token's merges are chosen by a segment tree over the ranks of its adjacent pairs. A
leaf holds ``rank << 32 | position`` (NONE or more where the pair can't merge), an inner node the
smaller of its children: the root is the leftmost pair of lowest rank. A merge changes three
leaves, each a walk to the root, so a pre-token of n bytes takes O(n log n).

Defined results: null and empty texts have no tokens and decode to the empty text. Added
special strings inside a text are single tokens, as the vocabulary file's library has them.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches

NONE = 1 << 62
#: Fixed value: the byte-level pre-token pattern that belongs to such vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on texts below U+0250, where letters, numbers and white space are these.
LETTERS, NUMBERS, SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Encoded pre-tokens that a Python worker remembers (two generations of this many,
#: and as many chunks), and
#: the longest pre-token, in characters, that it remembers.
REMEMBERED, LONGEST_REMEMBERED = 60_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file, by rule:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary read from the JSON text of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        of_char = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.table: dict[int, bytes] = {i: bytes(of_char[c] for c in s) for s, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.table |= {i: s.encode() for s, i in self.specials.items()}
        self.of_byte = [vocab[c] for c, _ in sorted(of_char.items(), key=lambda x: x[1])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: By pair: its rank, shifted to leave room for a position.
        self.rank = {(vocab[a] << 32) | vocab[b]: r << 32 for r, (a, b) in enumerate(pairs)}
        #: The same by two bytes, for the pairs that a pre-token begins with.
        self.first = [self.rank.get((x << 32) | y, NONE) for x in self.of_byte for y in self.of_byte]
        self.made = [vocab[a + b] for a, b in pairs]
        self.full = regex.compile(PATTERN).findall
        self.plain = re.compile(PLAIN_PATTERN).findall
        self.foreign = re.compile("[^\x00-\u024f]").search
        #: A space at an end or beside other white space: such a part isn't cut at its spaces.
        self.loose = re.compile(rf" [{SPACES}]|[{SPACES}] |^ | $").search
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of one pre-token, merged until no pair of it has a rank."""
        ids = list(map(self.of_byte.__getitem__, raw))
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length()
        first = self.first
        tree = [NONE] * size
        tree += [first[a << 8 | b] + i for i, (a, b) in enumerate(zip(raw, raw[1:]))]
        tree += [NONE] * (2 * size - len(tree))
        for i in range(size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x < y else y
        if tree[1] >= NONE:
            return ids
        rank, made = self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (top := tree[1]) < NONE:
            i = top & 0xFFFFFFFF
            gone, left = after[i], before[i]
            right = after[gone]
            ids[i] = token = made[top >> 32]
            ids[gone] = -1
            after[i] = right
            before[right] = i
            c = size + gone
            tree[c if c < 2 * size else size + i] = NONE  # the last position begins no pair
            b = size + i
            tree[b] = rank(token << 32 | ids[right], NONE) + i if right < n else NONE
            if left >= 0:
                a = size + left
                tree[a] = rank(ids[left] << 32 | token, NONE) + left
            else:
                a = b
            if c >= 2 * size:
                c = b
            while b > 1:  # the three walks to the root go together where they meet
                a, b, c = a >> 1, b >> 1, c >> 1
                x, y = tree[2 * b], tree[2 * b + 1]
                tree[b] = x if x < y else y
                if a != b:
                    x, y = tree[2 * a], tree[2 * a + 1]
                    tree[a] = x if x < y else y
                if c != b:
                    x, y = tree[2 * c], tree[2 * c + 1]
                    tree[c] = x if x < y else y
        return [t for t in ids if t >= 0]

    def packed(self, text: str) -> bytes:
        return array("I", self.merge(text.encode())).tobytes()

    def piece(self, text: str) -> bytes:
        """Packed ids of one pre-token, remembered."""
        got = self.young.get(text)
        if got is None:
            got = self.old.get(text)
            if got is None:
                got = self.packed(text)
            if len(text) <= LONGEST_REMEMBERED:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[text] = got
        return got

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; the plain pattern is the same as the full one on the scripts it knows."""
        return self.full(text) if self.foreign(text) else self.plain(text)

    def chunk(self, word: str) -> bytes:
        """Packed ids of a single space and what stands to the next, remembered by the latter."""
        got = self.old_chunks.get(word)
        if got is None:
            pieces = self.pieces(" " + word)
            # what is remembered here need not be remembered as a pre-token too
            got = self.packed(pieces[0]) if len(pieces) == 1 else b"".join([self.piece(p) for p in pieces])
        if len(word) < LONGEST_REMEMBERED:
            if len(self.chunks) >= REMEMBERED:
                self.old_chunks = dict(self.chunks)
                self.chunks.clear()
            self.chunks[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.specials:
                out.append(self.specials[part].to_bytes(4, "little"))
            elif self.loose(part):
                out += [self.piece(p) for p in self.pieces(part)]
            elif part:
                # A space between two other characters always begins a pre-token, so what
                # stands from one such space to the next encodes by itself.
                first, *rest = part.split(" ")
                out.append(b"".join([self.piece(p) for p in self.pieces(first)]))
                known, chunk = self.chunks.get, self.chunk
                out += [known(word) or chunk(word) for word in rest]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.table.__getitem__, array("I", packed))).decode("utf-8", errors="replace")


_loaded: dict[int, Bpe] = {}


def loaded(source: str) -> Bpe:
    """The vocabulary of ``source``, read once in each Python worker."""
    key = hash(source)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(source)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str):
    """A broadcast of the vocabulary file's JSON text. Its size is that of the vocabulary,
    a few MB whatever the corpus; ``path`` is a file that the driver sees."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def with_tokens(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded") -> DataFrame:
    """All columns of ``df``, ``ids`` (binary: the token ids as little-endian unsigned 32-bit
    integers, as training shards hold them) and, where named, ``decoded`` (the text that
    those ids decode to). Columns of ``df`` with these names are replaced."""
    in_small_batches(df.sparkSession)
    source = vocabulary(df.sparkSession, path)
    added = [ids] + ([decoded] if decoded else [])
    rest = [c for c in df.columns if c.lower() not in {a.lower() for a in added}]
    slim = df.select(F.col(text).cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                packed = [bpe.encode(t.as_py() or "") for t in part.column(0)]
                made = [pa.array(packed, pa.binary())]
                if decoded:
                    made.append(pa.array([bpe.decode(p) for p in packed], pa.string()))
                yield pa.record_batch([*part.columns[1:], *made], names=[*part.schema.names[1:], *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]), f"`{ids}` binary", *([f"`{decoded}` string"] if decoded else [])])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(rest)], *[F.col(f"`{a}`") for a in added])


def n_tokens(ids: str = "token_ids"):
    """Number of tokens in a column of packed ids."""
    return (F.octet_length(ids) / 4).cast("bigint")
