"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A pre-token (one match of the pattern) is a row of bytes. Leaf i of the tree holds the rank of
the pair that starts at live position i, or NONE; an inner node holds the smaller of its
children, the left one in a tie. The root thus names the leftmost pair of lowest rank. A merge
kills the right position and changes the pairs of two live neighbours: three point updates of
logarithmic cost, so a pre-token of n bytes takes O(n log n) whatever its length.

Pre-tokens repeat, and so do the chunks that a text's plain single spaces divide it into; a
pattern whose matches begin with at most one space and otherwise hold either only white space or
none never reaches across such a space. Each worker keeps the ids of both in bounded caches.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import TEXT_BATCH_ROWS, Recent, prepare

NONE = 1 << 60
CACHE_ENTRIES = 400_000

_CODERS: dict[tuple[str, str], ByteBpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: repeatedly merges the leftmost pair of lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    end = list(range(1, n + 1))  # a live position's token is piece[i:end[i]]
    before = list(range(-1, n))  # the live position to the left; n stands for the end
    low = tree[1]
    while low < NONE:
        i = 1
        while i < size:
            i += i
            if tree[i] != low:
                i += 1
        i -= size
        gone = end[i]
        stop = end[i] = end[gone]
        before[stop] = i
        left = before[i]
        changed = [(gone, NONE), (i, get(piece[i : end[stop]], NONE) if stop < n else NONE)]
        if left >= 0:
            changed.append((left, get(piece[left:stop], NONE)))
        for at, value in changed:
            at += size
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
        low = tree[1]
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Glued(Exception):
    """A space that is not known to stand alone."""


class ByteBpe:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        top = max(self.ranks.values(), default=-1) + 1
        self.tokens = [b""] * top
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.divide = regex.compile(r"(?<=\S) (?=\S)").split
        self.pieces = Recent(self._piece, CACHE_ENTRIES // 2)
        self.chunks = Recent(self._chunk, CACHE_ENTRIES)

    def _piece(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of the chunk after its space; raises if the space may be part of a longer run."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Glued
        return self._matches(" " + chunk)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        try:
            if not rest:
                return self._matches(first)
            if not first or first[-1].isspace():
                raise Glued
            return self._matches(first) + b"".join(map(self.chunks.__getitem__, rest))
        except Glued:
            first, *rest = self.divide(text)
            return b"".join([self._matches(first), *(self._matches(" " + x) for x in rest)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id that is not in the vocabulary raises IndexError."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder a worker process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of docs and ``ids`` (binary, little-endian unsigned 32 bits).

    NULL and empty texts give no ids. Columns of docs named ``ids`` are replaced.
    """
    prepare(docs.sparkSession)
    return _mapped(docs, text, "ids", "string", lambda x: b"" if x is None else coder(path, pattern).encode(x))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns of rows and ``decoded`` (binary): the bytes of the ids. NULL ids give no bytes."""
    prepare(rows.sparkSession)
    return _mapped(rows, ids, "decoded", "binary", lambda x: b"" if x is None else coder(path, pattern).decode(x))


def _mapped(rows: DataFrame, source: str, target: str, kind: str, function) -> DataFrame:
    rows = rows.drop(target) if target != source else rows
    names = rows.columns
    at = names.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                part = batch.slice(begin, TEXT_BATCH_ROWS)
                made = pa.array([function(x) for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*names, target])

    schema = rows.withColumn(target, F.lit(b"")).schema
    assert rows.schema[source].dataType.simpleString() == kind
    return rows.mapInArrow(run, schema)
