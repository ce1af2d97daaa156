"""Suffix-array deduplication: a distributed merge sort of suffixes that never compares a known prefix again.

A byte goes if a string of LENGTH bytes that also starts earlier covers it. The suffixes that decide this are sorted:
each task sorts its own into runs, front-codes them (the length of the prefix shared with the one before, and the
rest) and deals them by range; a range merges its runs by a loser tree whose nodes hold the length of the prefix
shared with the last winner. Two contenders with different lengths are decided by these alone; with equal ones only
the bytes behind are compared. Equal strings end up side by side, and all but the earliest go.

Not every suffix is sorted. The window of LENGTH bytes at a place is named by its least gram of K bytes (by hash, the
first of equal ones), its anchor, which follows from the window's bytes alone; neighbouring windows share it. The
string that the windows of one anchor cover is its context, so equal windows have one anchor at one place in it.
Levels of K grow to LENGTH:

1. Of the anchors of all texts, those whose gram occurs once are set aside: chunks send the hashes of their grams to the
   hashes' owners, which answer what came twice. The contexts of the others are sorted; all but the earliest of equal
   ones go, with all their windows.
2. Contexts that differ may still share windows, if they have their gram in common. The earliest of each of these are
   anchored anew by longer grams, and these shorter contexts sorted.
3. So on with grams of LENGTH bytes, whose contexts are single windows.

A task sends one of equal strings only, the earliest; the others go at once, so that a range gets a string as often as
there are runs at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import drop, freeing, materialise, mix64, prepare, shuffle_parts

LENGTH = 100
#: Bits of a place in a block of bytes, and in a context.
PLACE, WITHIN = 20, 10
#: Texts that are anchored at once, and anchors of a chunk.
BLOCK = 900_000
CHUNK = 400_000
#: Bytes that are hashed at once, and strings: so many that the hashes stay in a core's cache.
HASHED, HASHED_STRINGS = 1 << 16, 512
#: Bytes in which two strings are compared first.
NEAR = 16
#: Contexts that are handed on at once.
TOGETHER = 50_000
#: Strings of a run, and their bytes.
RUN_STRINGS = 200_000
RUN_BYTES = 24_000_000
#: Documents, and strings of each, from which ranges are cut: so many at least, and so many a range.
SAMPLED, SAMPLED_A_RANGE, STRINGS = 400, 8, 48
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(256, dtype=np.uint64))
ASKS = "chunk long, range int, data binary"
PLACES = "doc_id long, digest long, places binary"
RUNS = "kind string, range int, doc_id long, digest long, data binary"
MERGED = "kind string, doc_id long, digest long, start long, gram long, data binary"


def levels(length: int) -> list[int]:
    return sorted({max(1, length * part // 100) for part in (32, 78, 93, 100)})


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k`` bytes in a row, from those of powers of two."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    power, size, done, out = _BYTES[data], 1, 0, None
    while True:
        base = np.uint64(pow(_BASE, size, 1 << 64))
        if k & size:
            out = power if out is None else out[: len(power) - done] * base + power[done:]
            done += size
        if done == k:
            return mix64(out)
        power = power[:-size] * base + power[size:]
        size *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """The anchors of strings that lie one after another: (string, place, left, right, gram).

    The windows of an anchor start ``left`` to ``right`` bytes before it. Places count from the string's begin.
    """
    width = length - k + 1
    ends = np.cumsum(sizes)
    found = []
    total = len(data) - length + 1
    for begin in range(0, max(0, total), HASHED):
        end = min(begin + HASHED, total)
        low, high = max(0, begin - width), min(total, end + width)  # an anchor has width windows at most
        grams = gram_hashes(data[low : high + length - 1], k)
        place = np.arange(len(grams), dtype=np.uint64)
        key = grams >> np.uint64(PLACE) << np.uint64(PLACE) | place
        at = (_least(key, width) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        start = np.arange(low, high)
        edge = np.searchsorted(ends, (low, high - 1), side="right")
        string = edge[0] + np.cumsum(np.bincount(ends[edge[0] : edge[1]] - low, minlength=high - low))
        whole = start + length <= ends[string]
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (at[1:] != at[:-1]) | (string[1:] != string[:-1]) | (whole[1:] != whole[:-1])
        edge = np.flatnonzero(edge)
        first, last = edge[:-1], edge[1:] - 1
        ok = whole[first] & (start[first] >= begin) & (start[first] < end)
        first, last = first[ok], last[ok]
        of, place = string[first], at[first]
        found.append((of, low + place - (ends - sizes)[of], place - first, place - last, grams[place]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (*(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3).tolist()
    out, at = [], 8 + 24 * n
    for kind, size, count in head:
        out.append(np.frombuffer(raw, f"{chr(kind)}{size}", count, at))
        at += size * count
    return out


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns)})


# Which grams come twice


def _survey(docs: DataFrame, length: int, k: int, ranges: int) -> DataFrame:
    """Rows ASKS: each chunk's own row, in range -1 (documents, anchors, and each anchor's place among the distinct
    hashes), and these hashes by owner."""

    def packed(number: int, docs: list[tuple[int, int]], parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
        doc, place, gram = (np.concatenate(x) for x in zip(*parts))
        distinct, index = np.unique(gram, return_inverse=True)
        owner = (distinct % np.uint64(ranges)).astype(np.int64)
        asked = np.argsort(owner, kind="stable")
        turn = np.empty(len(asked), np.uint32)
        turn[asked] = np.arange(len(asked))
        edge = np.searchsorted(owner[asked], np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(edge)).tolist()
        ids = np.array(docs, np.int64).reshape(-1, 2)
        own = pack(ids[:, 0].copy(), ids[:, 1].copy(), doc.astype(np.uint32), place, turn[index], edge)
        asks = [pack(distinct[asked[edge[r] : edge[r + 1]]]) for r in some]
        return _table(ASKS, [number] * (1 + len(some)), [-1, *some], [own, *asks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs, parts, held, size, count = [], [], [], 0, 0

        def settle() -> None:
            nonlocal held, size, count
            sizes = np.array([len(x) for x in held], np.int64)
            of, place, left, right, gram = anchors(np.frombuffer(b"".join(held), np.uint8), sizes, length, k)
            parts.append((of + len(docs) - len(held), place << 2 * WITHIN | left << WITHIN | right, gram))
            count += len(of)
            held, size = [], 0

        for batch in batches:
            for doc, digest, raw in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append((doc, digest))
                held.append(raw)
                size += len(raw)
                if size >= BLOCK:
                    settle()
                    if count >= CHUNK:
                        yield from packed(number, docs, parts).to_batches()
                        number, docs, parts, count = number + 1, [], [], 0
        if held:
            settle()
        if parts:
            yield from packed(number, docs, parts).to_batches()

    return docs.mapInArrow(freeing(run), ASKS)


def _repeated(asks: DataFrame) -> DataFrame:
    """Rows ASKS: of each chunk's hashes, by owner, whether another chunk has them too."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpack(x)[0] for x in rows["data"].to_pylist()]
        _, index, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        often = np.split(count[index] > 1, np.cumsum([len(x) for x in parts])[:-1])
        answers = [(c, pack(np.packbits(x))) for c, x in zip(rows["chunk"].to_pylist(), often) if x.any()]
        return _table(ASKS, [c for c, _ in answers], [rows["range"][0].as_py()] * len(answers), [x for _, x in answers])

    return asks.groupBy("range").applyInArrow(run, ASKS)


def _candidates(rows: DataFrame) -> DataFrame:
    """Rows PLACES of documents with anchors whose gram comes twice, from chunks and their answers."""

    def run(rows: pa.Table) -> pa.Table:
        part, data = rows["range"].to_pylist(), rows["data"]
        doc_id, digest, doc, place, turn, edge = unpack(data[part.index(-1)].as_py())
        often = np.bincount(turn, minlength=int(edge[-1])) > 1
        for i, r in enumerate(part):
            if r >= 0:
                mask = np.unpackbits(unpack(data[i].as_py())[0], count=int(edge[r + 1] - edge[r]))
                often[edge[r] : edge[r + 1]] |= mask.astype(bool)
        kept = often[turn]
        doc, place = doc[kept], place[kept]
        some, at = np.unique(doc, return_index=True)
        return _table(PLACES, doc_id[some], digest[some], [x.tobytes() for x in np.split(place, at[1:])] if len(some) else [])

    return rows.groupBy("chunk").applyInArrow(run, PLACES)


# Runs of sorted strings


def shared(strings: list[bytes]) -> np.ndarray:
    """How many bytes each string has in common with the one before."""
    out = np.zeros(len(strings), np.int64)
    sizes = np.array([len(x) for x in strings], np.int64)
    for at in range(0, len(strings), 4096):
        some = strings[max(0, at - 1) : at + 4096]
        width = max(1, *map(len, some))
        cells = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in some), np.uint8).reshape(-1, width)
        same = np.ones((len(some) - 1, width + 1), bool)
        same[:, width] = False
        same[:, :width] = cells[1:] == cells[:-1]
        out[max(1, at) : at + 4096] = same.argmin(axis=1)
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, touching ones joined."""
    if not len(start):
        return start, stop
    by = np.argsort(start, kind="stable")
    start, stop = start[by], np.maximum.accumulate(stop[by])
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    return start[new], stop[np.concatenate((new[1:], [True]))]


def _gone(doc_id: np.ndarray, digest: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Spans by document."""
    by = np.lexsort((start, digest, doc_id))
    doc_id, digest, start, stop = (x[by] for x in (doc_id, digest, start, stop))
    edge = np.flatnonzero(np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (digest[1:] != digest[:-1])))) if len(by) else by
    out = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(by)]):
        out.append((int(doc_id[a]), int(digest[a]), np.stack(spans(start[a:b], stop[a:b])).tobytes()))
    return out


class Run:
    """Strings of a task, each with the document and place where it starts."""

    def __init__(self):
        self.strings, self.docs, self.doc, self.start, self.size, self.count = [], [], [], [], 0, 0

    def add(self, docs: np.ndarray, of: np.ndarray, start: np.ndarray, raw: bytes, first: np.ndarray, stop: np.ndarray) -> None:
        for a in range(0, len(first), RUN_STRINGS):
            ends = stop[a : a + RUN_STRINGS].tolist()
            made = [raw[x:y] for x, y in zip(first[a : a + RUN_STRINGS].tolist(), ends)]
            self.strings += made
            self.size += sum(map(len, made))
        self.doc.append(of + self.count)
        self.docs.append(docs)
        self.count += len(docs)
        self.start.append(start)

    def full(self) -> bool:
        return len(self.strings) >= RUN_STRINGS or self.size >= RUN_BYTES

    def tables(self, cuts: list[bytes]) -> Iterator[pa.Table]:
        """Rows RUNS: front-coded sorted strings by range, and the spans of documents that go at once."""
        from bisect import bisect_left

        if not self.strings:
            return
        ids = np.concatenate(self.docs)
        doc, start = np.concatenate(self.doc), np.concatenate(self.start)
        by = np.lexsort((start, ids[doc, 1], ids[doc, 0]))
        earliest: dict[bytes, int] = {}
        first = np.empty(len(by), np.int64)
        first[by] = [earliest.setdefault(self.strings[i], i) for i in by.tolist()]
        late = np.flatnonzero((first != np.arange(len(by))) & ((start != start[first]) | (ids[doc] != ids[doc[first]]).any(axis=1)))
        size = np.array([len(x) for x in self.strings], np.int64)
        gone = _gone(ids[doc[late], 0], ids[doc[late], 1], start[late], start[late] + size[late])
        n = len(gone)
        yield _table(RUNS, ["gone"] * n, [None] * n, [x[0] for x in gone], [x[1] for x in gone], [x[2] for x in gone])
        names = sorted(earliest)
        at = np.array([earliest[x] for x in names], np.int64)
        lcp = shared(names)
        edge = [0, *(bisect_left(names, c) for c in cuts), len(names)]
        rows = []
        for r, (a, b) in enumerate(zip(edge, edge[1:])):
            if a < b:
                some, own = at[a:b], lcp[a:b].copy()
                own[0] = 0
                used, index = np.unique(doc[some], return_inverse=True)
                tails = b"".join(x[h:] for x, h in zip(names[a:b], own.tolist()))
                rows.append((r, pack(
                    own.astype(np.uint16), size[some].astype(np.uint16), ids[used, 0].copy(), ids[used, 1].copy(),
                    index.astype(np.uint32), start[some], np.frombuffer(tails, np.uint8),
                )))
        n = len(rows)
        yield _table(RUNS, ["run"] * n, [x[0] for x in rows], [None] * n, [None] * n, [x[1] for x in rows])


def _strings(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[tuple]:
    """Contexts of rows (doc_id, digest, base, text, places): documents (doc_id, digest), of each context its document among
    these and where it starts there, and bytes and where it lies in them.

    Without places, all contexts are found, those of many rows at once.
    """

    def found(held: list[tuple]) -> Iterator[tuple]:
        doc, digest, base, texts, _ = zip(*held)
        docs, raw = np.array([doc, digest], np.int64).T, b"".join(texts)
        sizes = np.array([len(x) for x in texts], np.int64)
        of, place, left, right, _ = anchors(np.frombuffer(raw, np.uint8), sizes, length, k)
        before = (np.cumsum(sizes) - sizes)[of]
        start, first, stop = np.array(base, np.int64)[of] + place - left, before + place - left, before + place - right + length
        for a in range(0, len(of), TOGETHER):
            x = slice(a, a + TOGETHER)
            low = int(of[a])
            yield docs[low : int(of[x][-1]) + 1], of[x] - low, start[x], raw, first[x], stop[x]

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[4] is not None:
                packed = np.frombuffer(row[4], np.int64)
                place, low = packed >> 2 * WITHIN, (1 << WITHIN) - 1
                first = place - (packed >> WITHIN & low)
                yield np.array([row[:2]], np.int64), np.zeros(len(first), np.int64), first + row[2], row[3], first, place - (packed & low) + length
                continue
            held.append(row)
            size += len(row[3])
            if size >= BLOCK:
                yield from found(held)
                held, size = [], 0
    if held:
        yield from found(held)


def _runs(rows: DataFrame, length: int, k: int, cuts: list[bytes]) -> DataFrame:
    """Rows RUNS of rows (doc_id, digest, base, text, places)."""
    held_cuts = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Run()
        for found in _strings(batches, length, k):
            made.add(*found)
            if made.full():
                for table in made.tables(held_cuts.value):
                    yield from table.to_batches()
                made = Run()
        for table in made.tables(held_cuts.value):
            yield from table.to_batches()

    return rows.mapInArrow(freeing(run), RUNS)


def _cuts(rows: DataFrame, length: int, k: int, ranges: int) -> list[bytes]:
    """Where ranges begin, from at most STRINGS contexts of each of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, of, _, raw, first, stop in _strings(batches, length, k):
            few = np.arange(len(of)) - np.searchsorted(of, of) < STRINGS
            made = [raw[a:b] for a, b in zip(first[few].tolist(), stop[few].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["s"])

    found = sorted({bytes(r.s) for r in rows.mapInArrow(run, "s binary").collect()})
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


# The merge


def _common(a: bytes, b: bytes, known: int) -> int:
    """How many bytes two strings have in common, ``known`` being in common."""
    n = min(len(a), len(b))
    if a[known : known + NEAR] != b[known : known + NEAR]:  # most part soon
        n = min(n, known + NEAR)
    elif a == b:
        return n
    unlike = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (unlike.bit_length() + 7) // 8


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """The sorted order of all strings of sorted runs: each one's run, and the length of its prefix shared with the one before.

    A run is its strings and the lengths of the prefixes that each shares with the one before it. Node i of the
    loser tree has the loser of its two subtrees and the prefix it shares with the winner that passed there, which at
    the time of its next match is the last string that has left the tree. An ended run shares -1 bytes.
    """
    count = len(runs)
    size = 1 << max(0, count - 1).bit_length()
    at = [0] * size
    loser, known = [0] * size, [-1] * size
    texts, prefixes = [x[0] for x in runs], [x[1] for x in runs]
    front = [t[0] if t else b"" for t in texts] + [b""] * (size - count)

    def play(i: int, h: int, j: int, g: int) -> tuple[int, int, int, int]:
        """Winner, its prefix, loser, its prefix."""
        if h > g:
            return i, h, j, g
        if g > h:
            return j, g, i, h
        if h < 0:
            return i, h, j, g
        a, b = front[i], front[j]
        both = _common(a, b, h)
        if len(a) <= len(b) if both == min(len(a), len(b)) else a[both] < b[both]:
            return i, h, j, both
        return j, h, i, both

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            run = node - size
            return run, 0 if run < count and texts[run] else -1
        i, h = build(2 * node)
        j, g = build(2 * node + 1)
        winner, best, loser[node], known[node] = play(i, h, j, g)
        return winner, best

    order, prefix = [], []
    run, h = build(1)
    while h >= 0:
        order.append(run)
        prefix.append(h)
        at[run] += 1
        place = at[run]
        if place < len(texts[run]):
            front[run] = texts[run][place]
            h = prefixes[run][place]
        else:
            h = -1
        node = (run + size) >> 1
        while node:
            g = known[node]
            if g > h:
                run, loser[node] = loser[node], run
                h, known[node] = g, h
            elif g == h and h >= 0:
                run, h, loser[node], known[node] = play(run, h, loser[node], g)
            node >>= 1
    return order, prefix


def _decoded(tails: bytes, lcp: list[int], size: list[int]) -> list[bytes]:
    out, at, last = [], 0, b""
    for h, n in zip(lcp, size):
        last = last[:h] + tails[at : at + n - h]
        at += n - h
        out.append(last)
    return out


def _merged(runs: DataFrame, k: int, last: bool) -> DataFrame:
    """Rows MERGED: spans that go, and the earliest of equal strings with the hash of their gram (but on the last level)."""

    def run(rows: pa.Table) -> pa.Table:
        texts, meta = [], []
        for data in rows["data"].to_pylist():
            lcp, size, doc_id, digest, doc, start, tails = unpack(data)
            texts.append((_decoded(tails.tobytes(), lcp.tolist(), size.tolist()), lcp.tolist()))
            meta.append((doc_id[doc], digest[doc], start, size.astype(np.int64)))
        order, prefix = (np.array(x, np.int64) for x in merge(texts))
        by = np.empty(len(order), np.int64)  # of each place in the order, its place in the runs, one after another
        begin = np.cumsum([0, *(len(x[0]) for x in texts)])
        turn = np.argsort(order, kind="stable")
        by[turn] = np.arange(len(order))
        doc_id, digest, start, size = (np.concatenate(x)[by] for x in zip(*meta))
        new = np.ones(len(order), bool)
        new[1:] = (prefix[1:] != size[1:]) | (size[1:] != size[:-1])
        group = np.cumsum(new) - 1
        first = np.lexsort((start, digest, doc_id, group))[np.flatnonzero(new)]
        head = first[group]
        late = (doc_id != doc_id[head]) | (digest != digest[head]) | (start != start[head])
        gone = _gone(doc_id[late], digest[late], start[late], start[late] + size[late])
        n, m = len(gone), 0 if last else len(first)
        kept, grams = [], np.zeros(0, np.uint64)
        if m:
            place = by[first]
            which = np.searchsorted(begin, place, side="right") - 1
            kept = [texts[i][0][p] for i, p in zip(which.tolist(), (place - begin[which]).tolist())]
            grams = _least_grams(kept, k)
        return _table(
            MERGED, ["gone"] * n + ["kept"] * m, [*(x[0] for x in gone), *doc_id[first[:m]].tolist()],
            [*(x[1] for x in gone), *digest[first[:m]].tolist()], [*[None] * n, *start[first[:m]].tolist()],
            [*[None] * n, *grams.view(np.int64).tolist()], [*(x[2] for x in gone), *kept],
        )

    return runs.groupBy("range").applyInArrow(run, MERGED)


def _least_grams(strings: list[bytes], k: int) -> np.ndarray:
    """The least hash of each string's grams, its anchor's, without the bits that break ties by place."""
    out = np.empty(len(strings), np.uint64)
    for at in range(0, len(strings), HASHED_STRINGS):
        some = strings[at : at + HASHED_STRINGS]
        sizes = np.array([len(x) for x in some], np.int64)
        hashes = gram_hashes(np.frombuffer(b"".join(some), np.uint8), k) >> np.uint64(PLACE)
        ends = np.cumsum(sizes)
        of = np.searchsorted(ends, np.arange(len(hashes)), side="right")
        hashes[np.arange(len(hashes)) + k > ends[of]] = np.uint64(LAST)  # not within one string
        out[at : at + HASHED_STRINGS] = np.minimum.reduceat(hashes, ends - sizes)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, digest, found): lists of packed spans that repeat earlier bytes. docs (doc_id, digest, text), none null.

    The earlier of two places is that of the smaller (doc_id, digest), in one text the one further to the left. Equal
    (doc_id, digest) are one document.
    """
    if not 1 <= length < 1 << WITHIN:
        raise ValueError(f"length must be 1 to {(1 << WITHIN) - 1}")
    spark = docs.sparkSession
    prepare(spark)
    ranges = shuffle_parts(spark)
    docs = docs.where(F.length("text") >= length)
    key = ["doc_id", "digest"]
    steps = levels(length)
    asks = materialise(_survey(docs, length, steps[0], ranges), "asks")
    answers = _repeated(asks.where("range >= 0"))
    places = materialise(_candidates(asks.where("range < 0").unionByName(answers)), "places")
    drop(asks)
    some = max(SAMPLED, SAMPLED_A_RANGE * ranges)
    whole = ["doc_id", "digest", F.lit(0).cast("long").alias("base"), "text", "places"]
    few = places.orderBy(F.xxhash64(*key), *key).limit(some).withColumn("places", F.expr(f"substring(places, 1, {8 * STRINGS})"))
    sample = docs.join(F.broadcast(few), key).select(*whole)  # ``some`` rows of STRINGS places at most
    rows, gone = docs.join(places, key).select(*whole), []
    for k in steps:
        cuts = _cuts(sample, length, k, ranges)
        runs = materialise(_runs(rows, length, k, cuts), "runs", "kind")
        merged = materialise(_merged(runs.where("kind = 'run'"), k, k == steps[-1]), "merged", "kind")
        gone += [runs.where("kind = 'gone'").select(*key, "data"), merged.where("kind = 'gone'").select(*key, "data")]
        drop(runs, part="kind=run")
        kept = merged.where("kind = 'kept'")
        mixed = kept.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
        rows = kept.join(mixed, "gram").select(*key, F.col("start").alias("base"), F.col("data").alias("text"), F.lit(None).cast("binary").alias("places"))
        if k != steps[-1]:
            rows = materialise(rows, "mixed")
            drop(merged, part="kind=kept")
            sample = rows.orderBy(F.xxhash64("text"), *key, "base").limit(some)
    found = gone[0]
    for more in gone[1:]:
        found = found.unionByName(more)
    return found.groupBy(*key).agg(F.collect_list("data").alias("found"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans array<struct<start,stop>>, kept binary): a row for each row of docs.

    spans are the maximal runs of removed bytes, kept is what is left; it may cut characters. NULL texts are empty. A NULL doc_id
    counts as the largest one. Of rows with one doc_id and different texts, the one with the smaller xxhash64 of its
    text comes first; rows with one doc_id and equal texts are one document and get the same result. A task holds the longest
    text a few times. Other columns of docs play no part, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    body = F.coalesce(docs[text], F.lit("")).cast("binary")
    rows = docs.select(docs[key].cast("long").alias("own"), F.coalesce(docs[key].cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(body).alias("digest"), body.alias("text"))
    found = repeated_spans(rows.select("doc_id", "digest", "text"), length)
    left = rows.join(found, ["doc_id", "digest"], "left").select("own", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, raw, found in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [np.frombuffer(x, np.int64).reshape(2, -1) for x in found or []]
                start, stop = spans(*np.concatenate(parts, axis=1)) if parts else (np.zeros(0, np.int64),) * 2
                edge = [0, *np.stack((start, stop), axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2]))
                cut = [{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist())]
                out.append((own, len(raw), len(raw) - len(kept), len(cut), cut, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
            names = ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=list(names))

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary"
    return left.mapInArrow(freeing(run), kinds)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, hash(h[i + 1 : i + 100]) AS w FROM d, unnest(range(n - 99)) AS u(i)),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS late FROM w),
r AS (SELECT doc_id, i AS a, i + 100 AS b FROM g WHERE late),
m AS (SELECT *, coalesce(a > lag(b) OVER (PARTITION BY doc_id ORDER BY a), true) AS fresh FROM r),
s AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM m) GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT e.doc_id, sum(b - a) AS gone, count(*) AS c, max(b) AS z, string_agg(hex(h[before + 1 : a]), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(h[coalesce(z, 0) + 1 :]))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
