"""Line deduplication by an exact set-similarity join.

Lines are sets of tokens (words, A-Z lower-cased, by 52-bit hashes); equal sets form a class, named
by 128 bits, whose first line is the earliest in order of (doc_id, line number). For a Jaccard
similarity of PERCENT, two sets of sizes a >= b share a token among the first a - ceil(p a) + 1
tokens of each in any common order, so each class posts its prefix in order of rarity. Rarity is
read off a sketch of token counts of fixed size: it decides the cost, never the result, as any
common order is exact. A token whose counter is 1 is in one class only and isn't posted. A token
beyond COMMON is posted with each later token of a prefix longer by one: two similar sets that share
at least two tokens share two in those prefixes, and the rarest that they share is the first of them.

Postings meet by key, in order of their sizes. Length, positional and bitmap filters bound the
overlap that two sets can still reach (a bitmap is the parity of the tokens' 7-bit hashes: two differ
in no more bits than the sets in tokens; short lines fold theirs to 64 bits). Pairs that pass are never
emitted: tasks join them by union-find and return one edge a class, and the edges' components are groups
outside of which nothing is similar. Within its group every set meets every other once, on full sets;
what is returned is each class's number of similar classes and the earliest line among theirs. Keys
and groups of more than BLOCK classes are cut into blocks, and pairs of blocks are dealt as cells, so that
no task has a large one to itself. A line goes if its class has an earlier line, or a similar class has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import components, cut_lines, doc_bytes, drop, freeing, materialise, mix64, prepare, shuffle_parts, words_of

PERCENT = 80
#: Counters of the rarity sketch: 8 MB on a worker, whatever the input.
SKETCH = 1 << 23
SKETCH_BLOCK = 1 << 14
BATCH_BYTES = 1_000_000
#: Tokens with more on their counter are posted with a second token.
COMMON = 2_000
#: Classes of a key or group that meet in one task.
BLOCK = 2048
#: Postings that a task holds before it packs them.
HELD = 300_000
#: Pairs that a task holds before it hands them on, that it filters at once, and tokens of pairs that it looks up at once.
PAIRS = 250_000
SOUGHT = 500_000
#: Larger groups of sets are compared so many rows at once: by pairs that pass the bitmaps or, where these
#: are many, by products of matrices.
FEW = 48
STRIPE = 512
#: Columns of a matrix at once, and what a token of a pair costs beside a multiplication.
COLUMNS = 2048
PAIR_COST = 800
#: Sets and tokens that a task compares together, unless one cell has more.
TOGETHER = 20_000
TOKENS = 500_000
#: Classes that a task remembers as counted and posted.
REMEMBERED = 1 << 18
POSTING = (("key", "<u8"), ("class", "<i8"), ("n", "<i4"), ("at", "<i4"), ("low", "<u8"), ("high", "<u8"))
#: Lines of fewer tokens have folded bitmaps.
LONG = 72
#: Bits of the filter of candidate classes, 16 MB; it spares texts the second exchange, and false hits are harmless.
FILTER = 1 << 27
#: Lines that are sorted together, and the bits that leaves to a token.
SORTED = 1 << 12
_BITS = 52
_TOKEN = np.uint64((1 << _BITS) - 1)
_KEY = np.uint64((1 << 44) - 1)

Postings = dict[str, np.ndarray]
LINKED = "class long, more long, links long, w struct<doc_id:long,line:long,digest:long>"


def sets_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each line in order, the line (counted over all texts) of each, and how many lines each text has."""
    low = b"\n".join(raws).lower()
    hashes, start = words_of(low)
    hashes >>= np.uint64(64 - _BITS)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(low, np.uint8) == 10), start)
    per = np.array([raw.count(b"\n") + 1 for raw in raws], np.int64)
    made = _sorted(line, hashes, int(per.sum()))
    fresh = np.ones(len(line), bool)
    fresh[1:] = (made[1:] != made[:-1]) | (line[1:] != line[:-1])
    return made[fresh] & _TOKEN, line[fresh], per


def _sorted(line: np.ndarray, value: np.ndarray, total: int) -> np.ndarray:
    """52-bit values in ascending order within each line, below the line's place among SORTED ones."""
    out = np.empty(len(line), np.uint64)
    for base in range(0, total, SORTED):
        a, b = np.searchsorted(line, (base, base + SORTED))
        out[a:b] = np.sort((line[a:b] - base).astype(np.uint64) << np.uint64(_BITS) | value[a:b])
    return out


def names(token: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names, in two halves, of sets of ``n`` distinct tokens that begin at ``start``; none is empty."""
    if not len(start):
        return np.zeros((2, 0), np.int64)
    size = n.astype(np.uint64)
    sums = (np.add.reduceat(mix64(token ^ np.uint64(salt)), start) for salt in (1 << 60, 1 << 61))
    return tuple(mix64(x + size).view(np.int64) for x in sums)


def bitmaps(token: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the tokens' hashes, 128 bits a set in two halves; short sets have theirs folded into the first."""
    if not len(start):
        return np.zeros((2, 0), np.uint64)
    keyed = mix64(token)
    one = np.uint64(1) << (keyed >> np.uint64(57) & np.uint64(63))
    upper = keyed >> np.uint64(63) == 1
    low, high = (np.bitwise_xor.reduceat(np.where(upper == x, one, 0).astype(np.uint64), start) for x in (False, True))
    low ^= np.where(n < LONG, high, 0).astype(np.uint64)
    return low, np.where(n < LONG, 0, high).astype(np.uint64)


class Recent:
    """Which classes a task has met lately; it may forget one, and that one comes again."""

    def __init__(self):
        self.table = np.zeros(REMEMBERED, np.int64)

    def fresh(self, names: np.ndarray) -> np.ndarray:
        """Indices of the names that are new, one for each."""
        distinct, first = np.unique(names, return_index=True)
        slot = distinct & (REMEMBERED - 1)
        new = self.table[slot] != distinct
        self.table[slot] = distinct
        return first[new]


def survey(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Lines (doc_id, digest, line, class, more), and the rarity sketch: a byte a counter, 8 log2(1 + count).

    docs: (doc_id, digest, text). A task counts a class's tokens once, unless it has forgotten it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        counts, recent = np.zeros(SKETCH, np.uint32), Recent()
        for batch in batches:
            raws = [doc_bytes(x) for x in batch.column(2).to_pylist()]
            docs, digests = (batch.column(c).to_numpy() for c in range(2))
            for a, b in cut_lines(map(len, raws), BATCH_BYTES):
                token, line, per = sets_of(raws[a:b])
                n = np.bincount(line, minlength=int(per.sum()))
                used = np.flatnonzero(n)
                name, more = names(token, (np.cumsum(n) - n)[used], n[used])
                new = np.zeros(len(n), bool)
                new[used[recent.fresh(name)]] = True
                np.add.at(counts, (token[new[line]] & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
                number = np.arange(len(n)) - np.repeat(np.cumsum(per) - per, per)
                columns = (np.repeat(docs[a:b], per)[used], np.repeat(digests[a:b], per)[used], number[used], name, more)
                blank = [pa.nulls(len(used), pa.int32()), pa.nulls(len(used), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *blank], SURVEY)
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        for at in np.flatnonzero(blocks.any(axis=1)).tolist():
            made = zlib.compress(np.ascontiguousarray(blocks[at].view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(5)), pa.array([at], pa.int32()), pa.array([made])], SURVEY)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, made in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.ascontiguousarray(np.frombuffer(zlib.decompress(made), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                sums[at] = sums.get(at, 0) + counts.astype(np.int64)
        logs = [np.minimum(255, 8 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], ["block", "counts"])

    made = materialise(docs.mapInArrow(freeing(run), "doc_id long, digest long, line long, class long, more long, block int, counts binary"), "lines")
    parts = made.where("block is not null").select("block", "counts")
    parts = parts.repartition(min(SKETCH // SKETCH_BLOCK, shuffle_parts(docs.sparkSession)), "block")
    out = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.uint8)
    for row in parts.mapInArrow(total, "block int, counts binary").collect():
        out[row.block] = np.frombuffer(row.counts, np.uint8)
    return made, out.ravel()


SURVEY = ["doc_id", "digest", "line", "class", "more", "block", "counts"]


def _pack(rows: Postings) -> bytes:
    """Postings in order of their keys, as byte planes: most planes are all zero."""
    rows = rows | {"key": np.diff(rows["key"], prepend=np.uint64(0))}
    flat = (np.ascontiguousarray(rows[name], kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T for name, kind in POSTING)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in flat)


def _unpack(blobs: list[bytes]) -> Postings:
    parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind)] for name, kind in POSTING}
    width = sum(np.dtype(kind).itemsize for _, kind in POSTING)
    for blob in blobs:
        m, at = len(blob) // width, 0
        for name, kind in POSTING:
            size = np.dtype(kind).itemsize
            plane = np.frombuffer(blob, np.uint8, m * size, at).reshape(size, m)
            value = np.ascontiguousarray(plane.T).view(kind).ravel()
            parts[name].append(np.cumsum(value, dtype=np.uint64) if name == "key" else value)
            at += m * size
    return {name: np.concatenate(x) for name, x in parts.items()}


def _take(rows: Postings, at) -> Postings:
    return {name: x[at] for name, x in rows.items()}


def postings(token: np.ndarray, line: np.ndarray, n: np.ndarray, name: np.ndarray, chosen: np.ndarray, rank: np.ndarray, percent: int) -> Postings:
    """Postings of the chosen lines; name: by line."""
    keep = chosen[line]
    token, line = token[keep], line[keep]
    n_ = np.where(chosen, n, 0)
    start = np.cumsum(n_) - n_
    used = np.flatnonzero(chosen)
    low, high = np.zeros((2, len(n)), np.uint64)
    low[used], high[used] = bitmaps(token, start[used], n[used])
    rarity = rank[(token & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
    made = _sorted(line, rarity << np.uint64(44) | token >> np.uint64(8), len(n))
    key, rarity = made & _KEY, made >> np.uint64(44) & np.uint64(255)
    alpha = -(-percent * n // 100)
    at = np.arange(len(key)) - start[line]
    shared = rarity > 8  # by two classes, perhaps
    posts = (at < (n - alpha + 1)[line]) & shared
    common = posts & (rarity > 8 * np.log2(1 + COMMON)) & (percent > 50)
    single, two = np.flatnonzero(posts & ~common), np.flatnonzero(common)
    times = np.maximum(0, (n - np.maximum(alpha, 2) + 2)[line[two]] - 1 - at[two])
    ahead = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + 1
    two = np.repeat(two, times)
    some = shared[two + ahead]
    two, ahead = two[some], ahead[some]
    take = np.concatenate([single, two])
    keys = np.concatenate([key[single], mix64(key[two] + mix64(key[two + ahead])) & _KEY])
    rows = line[take]
    return {"key": keys, "class": name[rows], "n": n[rows].astype(np.int32), "at": at[take].astype(np.int32), "low": low[rows], "high": high[rows]}


def _posted(docs: DataFrame, rarity, percent: int, min_tokens: int, parts: int) -> DataFrame:
    """(part, blob): packed postings of each task's classes, dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, held = Recent(), []

        def flush() -> pa.RecordBatch:
            rows = {name: np.concatenate([x[name] for x in held]) for name, _ in POSTING}
            held.clear()
            part = (mix64(rows["key"]) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((rows["key"], part))
            rows, part = _take(rows, order), part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [_pack(_take(rows, slice(i, j))) for i, j in zip(cuts, [*cuts[1:], len(part)])]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            raws = [doc_bytes(x) for x in batch.column(0).to_pylist()]
            for a, b in cut_lines(map(len, raws), BATCH_BYTES):
                token, line, per = sets_of(raws[a:b])
                n = np.bincount(line, minlength=int(per.sum()))
                # smaller sets are similar to equal ones only
                used = np.flatnonzero((n >= max(1, min_tokens)) & (100 * n >= percent * (n + 1)))
                name, chosen = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
                if len(used):
                    full = np.flatnonzero(n)
                    name[full] = names(token, (np.cumsum(n) - n)[full], n[full])[0]
                    chosen[used[recent.fresh(name[used])]] = True
                held.append(postings(token, line, n, name, chosen, rarity.value, percent))
                if sum(len(x["n"]) for x in held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(freeing(run), "part int, blob binary").repartitionById(parts, "part")


def _can_reach(a: Postings, b: Postings, percent: int) -> np.ndarray:
    """Length, bitmap and (of postings of one key) positional filters."""
    both = a["n"] + b["n"]
    need = -(-percent * both // (100 + percent))
    low, high = a["low"] ^ b["low"], a["high"] ^ b["high"]
    folded = np.minimum(a["n"], b["n"]) < LONG
    apart = np.bitwise_count(np.where(folded, low ^ high, low)).astype(np.int32)
    apart += np.where(folded, 0, np.bitwise_count(high)).astype(np.int32)
    fits = 100 * np.minimum(a["n"], b["n"]) >= percent * np.maximum(a["n"], b["n"])
    fits &= apart <= both - 2 * need
    if "at" in a:
        fits &= np.minimum(a["n"] - a["at"], b["n"] - b["at"]) + np.minimum(a["at"], b["at"]) >= need
    return fits


class Groups:
    """Union-find over the classes of some rows."""

    def __init__(self, names: np.ndarray):
        self.names, self.of = np.unique(names, return_inverse=True)
        self.label = np.arange(len(self.names))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.label[self.of[i]] != self.label[self.of[j]]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.of[i], self.of[j]
        while True:
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(class, its group's first class), where they differ."""
        some = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.names[some], self.names[self.label[some]]


def near(rows: Postings, place: np.ndarray, percent: int, groups: Groups | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key that pass the filters; sizes ascend within a key, place: a row's among its key's.

    With groups, pairs that are in one group already are left out.
    """
    n, folded = rows["n"], rows["low"] ^ rows["high"]
    share = n * ((100 - percent) / (100 + percent)) + 1e-6
    parts, held, d = [], 0, 1
    alive = np.flatnonzero(place > 0)
    while len(alive):
        other = alive - d
        fits = 100 * n[other] >= percent * n[alive]
        alive, other = alive[fits], other[fits]
        ok = np.bitwise_count(folded[alive] ^ folded[other]) <= share[alive] + share[other]
        parts.append(_fitting(rows, alive[ok], other[ok], percent, groups))
        held += parts[-1].shape[1]
        if held > PAIRS:
            yield tuple(np.concatenate(parts, axis=1))
            parts, held = [], 0
        d += 1
        alive = alive[place[alive] >= d]
    if parts:
        yield tuple(np.concatenate(parts, axis=1))


def across(rows: Postings, m: int, percent: int, groups: Groups | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one of the first ``m`` rows and one of the others that pass the filters."""
    folded = rows["low"] ^ rows["high"]
    share = rows["n"] * ((100 - percent) / (100 + percent)) + 1e-6
    for begin in range(0, m, 256):
        end = min(m, begin + 256)
        apart = np.bitwise_count(folded[begin:end, None] ^ folded[None, m:])
        i, j = np.nonzero(apart <= share[begin:end, None] + share[None, m:])
        yield tuple(_fitting(rows, i + begin, j + m, percent, groups))


def _fitting(rows: Postings, i: np.ndarray, j: np.ndarray, percent: int, groups: Groups | None) -> np.ndarray:
    if groups is not None:
        open_ = groups.apart(i, j)
        i, j = i[open_], j[open_]
    read = {name: x for name, x in rows.items() if name not in ("key", "class")}
    out = [np.zeros((2, 0), np.int64)]
    for a in range(0, len(i), PAIRS):
        some = i[a : a + PAIRS], j[a : a + PAIRS]
        ok = _can_reach(_take(read, some[0]), _take(read, some[1]), percent)
        out.append(np.stack([x[ok] for x in some]))
    return np.concatenate(out, axis=1)


def _meet(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges between classes, such that any two that can be similar are connected.

    Each task finds all pairs that pass the filters, and returns the groups that they form: one
    edge a class, whatever the number of pairs.
    """
    schema = "a long, b long, left binary, right binary"

    def edges(groups: Groups) -> pa.RecordBatch:
        a, b = groups.edges()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.binary())] * 2], ["a", "b", "left", "right"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unpack([x for batch in batches for x in batch.column(0).to_pylist()])
        rows = _take(rows, np.lexsort((rows["class"], rows["n"], rows["key"])))
        fresh = np.ones(len(rows["n"]), bool)
        fresh[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["class"][1:] != rows["class"][:-1])
        rows = _take(rows, fresh)
        begin = np.flatnonzero(np.diff(rows["key"], prepend=rows["key"][:1] + np.uint64(1)))
        size = np.diff(np.append(begin, len(rows["n"])))
        for a, m in zip(begin[size > BLOCK].tolist(), size[size > BLOCK].tolist()):
            cuts = [slice(x, min(x + BLOCK, a + m)) for x in range(a, a + m, BLOCK)]
            packed = [_pack(_take(rows, c)) for c in cuts]
            for i, left in enumerate(cuts):
                for j in range(i, len(cuts)):
                    if 100 * int(rows["n"][left.stop - 1]) < percent * int(rows["n"][cuts[j].start]):
                        break
                    columns = ([None], [None], [packed[i]], [packed[j] if j > i else None])
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "left", "right"])
        small = np.repeat((size > 1) & (size <= BLOCK), size)
        place = (np.arange(len(small)) - np.repeat(begin, size))[small]
        rows = _take(rows, small)
        groups = Groups(rows["class"])
        for i, j in near(rows, place, percent, groups):
            groups.join(i, j)
        yield edges(groups)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = _unpack([left] if right is None else [left, right])
                groups = Groups(rows["class"])
                whole = np.arange(len(rows["n"]))
                found = near(rows, whole, percent, groups) if right is None else across(rows, len(_unpack([left])["n"]), percent, groups)
                for i, j in found:
                    groups.join(i, j)
                yield edges(groups)

    met = materialise(posted.select("blob").mapInArrow(freeing(meet), schema), "met")
    cells = met.where("left is not null").select("left", "right").repartition(shuffle_parts(met.sparkSession), F.xxhash64("left", "right"))
    return met.where("left is null").unionByName(cells.mapInArrow(freeing(again), schema)).select("a", "b")


def _class_filter(used: DataFrame) -> np.ndarray:
    """One bit a hash of a wanted class: a filter of fixed size, gathered as its non-empty blocks."""
    block = 1 << 16
    bits = used.select(F.pmod("class", F.lit(FILTER)).alias("at")).distinct()  # names are hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_numpy()
            for b in np.unique(values // block).tolist():
                mine = values[values // block == b] % block
                np.bitwise_or.at(found.setdefault(b, np.zeros(block // 8, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["b", "bits"])

    out = np.zeros((FILTER // block, block // 8), np.uint8)
    dealt = bits.repartition(shuffle_parts(used.sparkSession), F.floor(F.col("at") / block))
    for row in dealt.mapInArrow(freeing(run), "b long, bits binary").collect():
        out[row.b] |= np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, used: DataFrame) -> DataFrame:
    """(class, more, items): the full sets of the wanted classes, from one more pass over the texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(_class_filter(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            raws = [doc_bytes(x) for x in batch.column(0).to_pylist()]
            for a, b in cut_lines(map(len, raws), BATCH_BYTES):
                token, line, per = sets_of(raws[a:b])
                n = np.bincount(line, minlength=int(per.sum()))
                full = np.flatnonzero(n)
                start = (np.cumsum(n) - n)[full]
                name, more = names(token, start, n[full])
                at = name % FILTER
                some = np.flatnonzero(wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                some = some[recent.fresh(name[some])]
                size = n[full][some]
                which = np.repeat(start[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
                items = pa.ListArray.from_arrays(offsets, pa.array(token[which].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(more[some]), items], ["class", "more", "items"])

    made = docs.select("text").mapInArrow(freeing(run), "class long, more long, items array<long>").join(used, "class", "left_semi")
    return made.groupBy("class", "more").agg(F.first("items").alias("items"))


class Sets:
    """Sets of tokens, told apart and compared: tokens one set after another, in order within each."""

    def __init__(self, token: np.ndarray, n: np.ndarray):
        self.n, self.start = n, np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        low, high = bitmaps(token, self.start, n)
        self.rows: Postings = {"n": n.astype(np.int32), "low": low, "high": high}
        self.distinct, self.id = np.unique(token, return_inverse=True)
        self.place = row * len(self.distinct) + self.id

    def similar(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs are similar, by their full sets."""
        out = np.zeros(len(i), bool)
        for a, b in cut_lines(self.n[i].tolist(), SOUGHT):
            size = self.n[i[a:b]]
            pair = np.repeat(np.arange(b - a), size)
            sought = j[a:b][pair] * len(self.distinct) + self.id[_flat(self, i[a:b])]
            at = np.minimum(np.searchsorted(self.place, sought), len(self.place) - 1)
            shared = np.bincount(pair, self.place[at] == sought, b - a)
            out[a:b] = 100 * shared >= percent * (size + self.n[j[a:b]] - shared)
        return out


class Incidence:
    """Which of the rows ``left`` and ``right`` of some sets hold which of the tokens that occur in several."""

    def __init__(self, sets: Sets, left: np.ndarray, right: np.ndarray):
        self.sizes = sets.n[left][:, None], sets.n[right][None, :]
        self.left, self.right = ((sets, rows) for rows in (left, right))
        both = np.unique(np.concatenate([left, right]))
        ids, times = np.unique(sets.id[_flat(sets, both)], return_counts=True)
        self.used = ids[times > 1]

    def cost(self, rows: int) -> float:
        return rows * self.sizes[1].shape[1] * len(self.used)

    def _table(self, sets: Sets, rows: np.ndarray, base: int) -> np.ndarray:
        used = self.used[base : base + COLUMNS]
        out = np.zeros((len(rows), len(used) + 1), np.float32)
        ids = sets.id[_flat(sets, rows)]
        at = np.searchsorted(used, ids)
        at[(at < len(used)) & (used[np.minimum(at, len(used) - 1)] != ids)] = len(used)
        out[np.repeat(np.arange(len(rows)), sets.n[rows]), at] = 1
        return out[:, : len(used)]

    def similar(self, a: int, b: int, percent: int) -> np.ndarray:
        """[left row from a to b, right row]: by full sets, from products of matrices."""
        sizes = self.sizes[0][a:b], self.sizes[1]
        shared = np.zeros((b - a, sizes[1].shape[1]), np.float32)
        for base in range(0, len(self.used), COLUMNS):
            shared += self._table(self.left[0], self.left[1][a:b], base) @ self._table(*self.right, base).T
        return 100 * shared >= percent * (sizes[0] + sizes[1] - shared)


def _flat(sets: Sets, rows: np.ndarray) -> np.ndarray:
    """Places of the tokens of some rows, one row after another."""
    size = sets.n[rows]
    return np.repeat(sets.start[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def count_links(sets: Sets, cell: np.ndarray, half: np.ndarray, order: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per set its number of similar sets in its cell, and the least ``order`` among them (or the largest integer).

    Rows lie cell by cell. Sets of a cell with one half all meet; in one with two, those of different halves.
    """
    links, best = np.zeros(len(cell), np.int64), np.full(len(cell), np.iinfo(np.int64).max)

    folded = sets.rows["low"] ^ sets.rows["high"]
    share = sets.n * ((100 - percent) / (100 + percent)) + 1e-6

    def found_left(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(links, i, np.int64(1))
        np.minimum.at(best, i, order[j])

    def found(i: np.ndarray, j: np.ndarray) -> None:
        found_left(i, j)
        found_left(j, i)

    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    size = np.diff(np.append(begin, len(cell)))
    two = np.maximum.reduceat(half, begin) > np.minimum.reduceat(half, begin)
    few = ~two & (size <= FEW)
    small = np.flatnonzero(np.repeat(few, size))
    small = small[np.lexsort((sets.n[small], cell[small]))]
    place = np.arange(len(small)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    for i, j in near(_take(sets.rows, small), place, percent):
        i, j = small[i], small[j]
        ok = sets.similar(i, j, percent)
        found(i[ok], j[ok])
    for a, m, cut in zip(begin[~few].tolist(), size[~few].tolist(), two[~few].tolist()):
        rows = np.arange(a, a + m)
        left, right = (rows[half[rows] == 0], rows[half[rows] == 1]) if cut else (rows, rows)
        table = Incidence(sets, left, right)
        for x in range(0, len(left), STRIPE):
            part = left[x : x + STRIPE]
            i, j = np.nonzero(np.bitwise_count(folded[part][:, None] ^ folded[right]) <= share[part][:, None] + share[right])
            i, j = part[i], right[j]
            i, j = _fitting(sets.rows, i[i != j], j[i != j], percent, None)
            if table.cost(len(part)) < PAIR_COST * len(i) * sets.n[rows].mean():
                hit = table.similar(x, x + len(part), percent) & (part[:, None] != right)
                i, j = np.nonzero(hit)
                i, j = part[i], right[j]
            else:
                ok = sets.similar(i, j, percent)
                i, j = i[ok], j[ok]
            found(i, j) if cut else found_left(i, j)
    return links, best


def _count(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(class, more, links, w): the similar sets of each, by number and with the least first line.

    sets (class, more, items, f). Sets meet in their group; one of more than BLOCK sets is cut into
    blocks, each two of which are a cell.
    """
    spark = sets.sparkSession
    size = groups.groupBy("component").agg(F.count("*").alias("m"))
    rows = sets.join(groups.select(F.col("id").alias("class"), "component"), "class").join(size, "component")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class", "more"), blocks).cast("int")
    rows = rows.select("component", mine.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"), "class", "more", "f", "items")
    rows = rows.select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("half"), "class", "more", "f.doc_id", "f.line", "f.digest", "items")
    dealt = rows.repartition(shuffle_parts(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        component, i, j, half, name, more, doc, line, digest = (batch.column(c).to_numpy() for c in range(9))
        items = batch.column(9)
        token = items.flatten().to_numpy().view(np.uint64)
        n = np.diff(items.offsets.to_numpy()).astype(np.int64)
        change = np.zeros(len(n), bool)
        for x in (component, i, j):
            change[1:] |= x[1:] != x[:-1]
        by = np.lexsort((digest, line, doc))
        order = np.empty(len(n), np.int64)
        order[by] = np.arange(len(n))
        links, best = count_links(Sets(token, n), np.cumsum(change), half, order, percent)
        some = np.flatnonzero(links)
        w = by[best[some]]
        first = pa.StructArray.from_arrays([pa.array(x[w]) for x in (doc, line, digest)], ["doc_id", "line", "digest"])
        return pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(more[some]), pa.array(links[some]), first], ["class", "more", "links", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(x.num_rows for x in held) > TOGETHER or sum(len(x.column(9).flatten()) for x in held) > TOKENS:
                # all but the last cell are complete
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                keys = np.stack([whole.column(c).to_numpy() for c in range(3)])
                last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield settle(_compact(whole.slice(0, cut)))
                held = [_compact(whole.slice(cut))]
            held.append(batch)
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    made = dealt.mapInArrow(freeing(run), LINKED)
    return made.groupBy("class", "more").agg(F.sum("links").alias("links"), F.min("w").alias("w"))


def _compact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A slice with buffers of its own."""
    return pa.Table.from_batches([batch]).take(pa.array(np.arange(batch.num_rows))).combine_chunks().to_batches()[0] if batch.num_rows else batch


def _linked(docs: DataFrame, percent: int, min_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines (doc_id, digest, line, class, more); first (class, more, f); linked (class, more, links, w)."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    made, sketch = survey(docs)
    rarity = spark.sparkContext.broadcast(sketch)
    groups = materialise(components(_meet(_posted(docs, rarity, percent, min_tokens, parts), percent)), "groups")
    lines = made.where("block is null").select("doc_id", "digest", "line", "class", "more")
    first = materialise(lines.groupBy("class", "more").agg(F.min(F.struct("doc_id", "line", "digest")).alias("f")), "first")
    sets = _sets(docs, groups.select(F.col("id").alias("class"))).join(first, ["class", "more"])
    linked = materialise(_count(sets, groups, percent), "linked")
    drop(groups)
    return lines, first, linked


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, digest, text), without rows that take no part."""
    prepare(docs.sparkSession)
    body = F.col(text).cast("binary")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("digest"), body.alias("text"))
    return rows.where("doc_id is not null and text is not null")


def line_links(docs: DataFrame, percent: int = PERCENT, min_tokens: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, line, first_doc_id, first_line, class_doc_id, class_line, links): every line with a token.

    Lines are numbered from 0; digest is that of the whole text, which tells rows with one doc_id
    apart. class_doc_id and class_line name the line's class by its first line; links is the number
    of other classes that are similar to it, earlier or later. first_doc_id and first_line are the
    class's first line where that is another, or else the earliest line of a similar class if it is
    earlier, or else null. Lines of fewer than ``min_tokens`` distinct tokens are similar to equal
    ones only. Rows with NULL doc_id or text take no part; repeated rows count as one document and
    keep their rows.
    """
    lines, first, linked = _linked(_rows(docs, key, text), percent, min_tokens)
    rows = lines.join(first, ["class", "more"]).join(linked, ["class", "more"], "left")
    witness = F.when(F.struct("doc_id", "line", "digest") > F.col("f"), F.col("f")).when(F.col("w") < F.col("f"), F.col("w"))
    return rows.select(
        "doc_id", "digest", "line", witness["doc_id"].alias("first_doc_id"), witness["line"].alias("first_line"),
        F.col("f.doc_id").alias("class_doc_id"), F.col("f.line").alias("class_line"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def drop_similar_lines(docs: DataFrame, percent: int = PERCENT, min_tokens: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without the lines that have an earlier line (see ``line_links``), n_chars counted anew.

    A document that loses every line goes; one that never had any, or a null text, stays as it is. All other columns,
    whatever their names, stay as they are.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # so that no column clashes with those made here
    key, text = (f"c{names.index(x)}" for x in (key, text))
    lines, first, linked = _linked(_rows(docs, key, text), percent, min_tokens)
    rows = lines.join(first, ["class", "more"]).join(linked, ["class", "more"], "left")
    late = (F.struct("doc_id", "line", "digest") > F.col("f")) | (F.col("w") < F.col("f"))
    gone = rows.where(late).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.collect_set("line").alias("_gone"))
    gone = materialise(gone, "gone")
    drop(lines, first, linked)
    same = (docs[key].cast("long") == F.col("_id")) & (F.xxhash64(docs[text].cast("binary")) == F.col("_digest"))
    left = docs.join(gone, same, "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", i.cast("long")))
    left = left.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    left = left.where(F.col("_gone").isNull() | F.exists("_kept", lambda x: F.trim(x) != ""))
    out = left.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n")))
    if "n_chars" in names:
        counted = f"c{names.index('n_chars')}"
        kind = docs.schema[counted].dataType
        out = out.withColumn(counted, F.when(F.col("_gone").isNull(), F.col(counted)).otherwise(F.length(text).cast(kind)))
    return out.select(*docs.columns).toDF(*names)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS line, list_sort(list_distinct(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'))) AS s FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
c AS (SELECT row_number() OVER () AS id, s, len(s) AS n, f FROM (SELECT s, min((doc_id, line)) AS f FROM l WHERE len(s) > 0 GROUP BY s)),
x AS (SELECT id, n, unnest(s) AS w FROM c), df AS (SELECT w, count(*) AS df FROM x GROUP BY w),
o AS (SELECT id, n, x.w, row_number() OVER (PARTITION BY id ORDER BY df, x.w) AS p FROM x JOIN df USING (w)),
e AS (SELECT id, n, w FROM o WHERE p <= n - (80 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM e a JOIN e b ON a.w = b.w AND a.id < b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
i AS (SELECT a, b, x.n + y.n AS n, len(list_intersect(x.s, y.s)) AS shared FROM q JOIN c x ON x.id = a JOIN c y ON y.id = b),
k AS (SELECT a, b FROM i WHERE 100 * shared >= 80 * (n - shared)),
t AS (SELECT a AS id, count(*) AS links, min(f) AS w FROM (SELECT a, b FROM k UNION ALL SELECT b, a FROM k) JOIN c ON c.id = b GROUP BY a),
r AS (SELECT doc_id, line, f, coalesce(links, 0) AS links, CASE WHEN (doc_id, line) > f THEN f WHEN w < f THEN w END AS v FROM l JOIN c USING (s) LEFT JOIN t USING (id))
SELECT doc_id, line::BIGINT AS line, v[1] AS first_doc_id, v[2]::BIGINT AS first_line, f[1] AS class_doc_id, f[2]::BIGINT AS class_line, links::BIGINT AS links FROM r
"""
