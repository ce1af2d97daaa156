"""Language-model scoring with a probabilistic suffix tree, beside a unigram base score.

Text model. A text is its lower-cased words joined by single spaces and an end mark: a string of
bytes. All strings of DEPTH bytes and the byte after them are counted over all training texts. A
context of up to LOW bytes is always a state. A longer one passes if it was seen MIN_COUNT times and
its next-byte distribution diverges from that of its longest proper suffix by MIN_GAIN nats (summed
over its occurrences) for each of its different next bytes; it is a state if it passes or is a
suffix of one that does. A byte is predicted by the longest suffix of what precedes it that is a
state. A state's distribution is smoothed towards its parent's with the weight of SMOOTHING times its
number of different next bytes; the root's has half a count added for each byte. No threshold depends on the
corpus's size, so the tree grows with the input.

The tree is never in one place: strings are dealt by the last LOW + 1 bytes of their context, so
that each range holds whole subtrees, and only contexts of up to LOW bytes (256^3 counts at most) are
known to all. Tasks emit, per chunk of about CHUNK_BYTES, its distinct strings with training counts;
ranges add up counts, build their subtrees and answer every chunk with a probability a string.

Base. c, N and V of the unigram formula are exact over all training texts. Chunks ask for their
distinct words in the same way, by range of their hash. A chunk's documents then meet its answers.

Everything exchanged is packed: sorted differences in byte planes, which compress well. Logarithms of
probabilities are exchanged in single precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import batch_words, cut_lines, doc_bytes, drop, freeing, materialise, mix64, prepare, shuffle_parts

#: A string, context and next byte, must fit 64 bits: 7 at most.
DEPTH = 6
#: Contexts of so many bytes are known to all tasks: at most 256^3 counts.
LOW = 2
MIN_COUNT = 4
MIN_GAIN = 1.0
#: Chosen among CANDIDATES by smoothing_by_fold(): on training rows alone.
SMOOTHING = 4
CANDIDATES = (1, 1.5, 2, 3, 4, 6)
CHUNK_BYTES = 6_000_000
#: Short strings that a task counts before it hands them on.
LOW_ENTRIES = 1_000_000
#: Bytes whose strings are sorted at once.
SORTED_BYTES = 1_000_000
#: The end's token among words' hashes.
END_TOKEN = np.uint64(0x656E64)
ADDED = 0.1


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True) if raw else b""


def unsqueeze(raw: bytes) -> bytes:
    return _ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True) if raw else b""


def planes(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueeze(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, "<u8"), dtype=np.uint64)


def add_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, one text after another, and how many each has."""
    hashes, per = batch_words(raws)
    return np.insert(hashes, np.cumsum(per), END_TOKEN), per + 1


def count_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of canonical texts, sorted, and their counts."""
    made = [np.unique(grams(texts[a:b]), return_counts=True) for a, b in cut_lines(map(len, texts), SORTED_BYTES)]
    return add_counts(*(np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.uint64, np.int64), zip(*made) if made else ((), ()))))


def canonical(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def grams(texts: list[bytes]) -> np.ndarray:
    """Per byte of canonical texts: DEPTH bytes before it (end marks before the first) and itself."""
    if not texts:
        return np.zeros(0, np.uint64)
    pad = b"\n" * DEPTH
    stream = np.frombuffer(pad + pad.join(texts), np.uint8)
    key = np.zeros(len(stream) - DEPTH, np.uint64)
    for i in range(DEPTH + 1):
        key = (key << np.uint64(8)) | stream[i : len(stream) - DEPTH + i]
    ends = np.cumsum([len(t) + DEPTH for t in texts])
    real = np.ones(len(key), bool)
    for e in ends[:-1] - DEPTH:  # the pads between texts
        real[e : e + DEPTH] = False
    return key[real]


def held_out(key: Column, fold: int = 0, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


NAMES = ["kind", "part", "chunk", "a", "b", "c"]
SCHEMA = "kind int, part int, chunk long, a binary, b binary, c binary"


def _row(kind: int, part: int, chunk: int, *blobs: bytes) -> list:
    return [kind, part, chunk, *blobs, *[None] * (3 - len(blobs))]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)


def gram_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of each string: by the last LOW + 1 bytes of its context."""
    return (mix64(keys >> np.uint64(8) & np.uint64(256 ** (LOW + 1) - 1)) % np.uint64(parts)).astype(np.int64)


def gram_order(keys: np.ndarray, parts: int) -> np.ndarray:
    """By range, then from the last byte to the first: neighbours share most, so their differences are small."""
    return np.lexsort((keys.byteswap(), gram_part(keys, parts)))


def pack_grams(keys: np.ndarray) -> bytes:
    """Strings of one range in their order."""
    return pack_sorted(keys.byteswap())


def unpack_grams(raw: bytes) -> np.ndarray:
    return unpack_sorted(raw).byteswap()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list]]:
    """Rows (doc_id, text, held) of about CHUNK_BYTES of text, whatever the batches' sizes."""
    rows: tuple[list, list[bytes], list] = ([], [], [])
    size = 0
    for batch in batches:
        for doc, raw, held in zip(*(c.to_pylist() for c in batch.columns)):
            raw = doc_bytes(raw)
            if rows[0] and size + len(raw) > CHUNK_BYTES:
                yield rows
                rows, size = ([], [], []), 0
            for column, x in zip(rows, (doc, raw, held)):
                column.append(x)
            size += len(raw)
    if rows[0]:
        yield rows


def gather(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text binary, held): packed rows of kinds 0 (words), 1 (strings), 2 (documents) and 3 (short strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        salt = int.from_bytes(os.urandom(8), "little") >> 1  # chunks only need different numbers
        number = 0
        low: list[tuple[np.ndarray, np.ndarray]] = []

        def short() -> pa.RecordBatch:
            keys, counts = add_counts(*(np.concatenate(x) for x in zip(*low)))
            low.clear()
            part = (keys % np.uint64(parts)).astype(np.int64)
            return _batch([
                _row(3, x, 0, pack_sorted(keys[part == x]), planes(counts[part == x].astype("<u8"))) for x in np.unique(part).tolist()
            ])

        for ids, raws, held in chunks(batches):
            texts = [canonical(x.lower().split()) for x in raws]
            flat, sizes = tokens(raws)
            train = ~np.array(held)
            words, index = np.unique(flat, return_inverse=True)
            counts = np.bincount(index[np.repeat(train, sizes)], minlength=len(words)).astype("<u4")
            number += 1
            chunk = (salt + number * 0x9E3779B97F4A7C15) % 2**63
            cell = np.minimum((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.uint64(parts - 1)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            rows = [
                _row(0, int(cell[i]), chunk, pack_sorted(words[i:j]), planes(counts[i:j]))
                for i, j in zip(cuts, [*cuts[1:], len(words)])
            ]
            learnt, times = count_strings([t for t, x in zip(texts, train) if x])
            other, _ = count_strings([t for t, x in zip(texts, train) if not x])
            keys, seen = add_counts(np.concatenate([learnt, other]), np.concatenate([times, np.zeros(len(other), np.int64)]))
            low.append(add_counts(learnt & np.uint64(256 ** (LOW + 1) - 1), times))
            order = gram_order(keys, parts)
            keys, seen = keys[order], seen[order].astype("<u4")
            part = gram_part(keys, parts)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            rows += [_row(1, int(part[i]), chunk, pack_grams(keys[i:j]), planes(seen[i:j])) for i, j in zip(cuts, [*cuts[1:], len(keys)])]
            some = np.array([x is not None for x in ids])
            numbers = np.array([x or 0 for x in ids], "<i8")
            rows.append(_row(
                2, 0, chunk, np.stack([numbers.view("<u8"), some.astype("<u8"), (~train).astype("<u8")]).tobytes(),
                squeeze(b"".join(texts)), planes(np.array(list(map(len, texts)), "<u8")),
            ))
            yield _batch(rows)
            if sum(len(k) for k, _ in low) > LOW_ENTRIES:
                yield short()
        if low:
            yield short()

    return docs.select("doc_id", "text", "held").mapInArrow(freeing(run), SCHEMA)


Counts = tuple[np.ndarray, np.ndarray]


def find(known: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each sought value in sorted ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
    return at, known[at] == sought


class Level:
    """The contexts of one length: each with its total, its number of different next bytes, and whether it is a state."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.context, self.total = add_counts(keys >> np.uint64(8), n)
        self.of, _ = find(self.context, keys >> np.uint64(8))
        self.distinct = np.bincount(self.of, minlength=len(self.context))
        self.state = np.ones(len(self.context), bool)

    def gains(self, parent: Level) -> np.ndarray:
        """By context, the nats that its distribution saves over that of its longest proper suffix, over all its occurrences."""
        event, _ = find(parent.keys, self.keys & _mask(parent.depth + 1))
        shorter = parent.of[event]
        nats = self.n * np.log(self.n * parent.total[shorter] / (self.total[self.of] * parent.n[event].astype(float)))
        return np.bincount(self.of, nats, len(self.context))

    depth = 0


def _mask(size: int) -> np.uint64:
    return np.uint64(256**size - 1)


def levels(keys: np.ndarray, n: np.ndarray, top: int, bottom: int) -> dict[int, Level]:
    """Levels of contexts of ``top`` bytes down to ``bottom``, from distinct sorted strings of the longest."""
    out = {}
    for d in range(top, bottom - 1, -1):
        keys, n = add_counts(keys & _mask(d + 1), n)
        out[d] = Level(keys, n)
        out[d].depth = d
    return out


def retain(tree: dict[int, Level]) -> None:
    """Marks the states among contexts of more than LOW bytes."""
    for d in range(LOW + 1, DEPTH + 1):
        level = tree[d]
        level.state = (level.total >= MIN_COUNT) & (level.gains(tree[d - 1]) >= MIN_GAIN * level.distinct)
    for d in range(DEPTH, LOW + 1, -1):
        at, _ = find(tree[d - 1].context, tree[d].context[tree[d].state] & _mask(d - 1))
        tree[d - 1].state[at] = True


def chances(keys: np.ndarray, tree: dict[int, Level], smoothing: float = SMOOTHING) -> np.ndarray:
    """log10 probabilities of the last byte of strings after the rest, by their longest suffix that is a state."""
    made = np.full(len(keys), 0.5)
    at, has = find(tree[0].keys, keys & _mask(1))
    if len(tree[0].n):
        made += np.where(has, tree[0].n[at], 0)
    made /= tree[0].n.sum() + 128
    for d in range(1, DEPTH + 1):
        level, event = tree[d], keys & _mask(d + 1)
        at, has = find(level.context, event >> np.uint64(8))
        some = np.flatnonzero(has)
        some = some[level.state[at[some]]]
        place, seen = find(level.keys, event[some])
        n = np.where(seen, level.n[place], 0) if len(level.n) else 0
        k = smoothing * level.distinct[at[some]]
        made[some] = (n + k * made[some]) / (level.total[at[some]] + k)
    return np.log10(made)


def low_counts(gathered: DataFrame, parts: int) -> Counts:
    """Counts of the strings of LOW + 1 bytes in all training texts: 256^3 rows at most, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys, counts = add_counts(np.concatenate([keys, unpack_sorted(a)]), np.concatenate([counts, unplanes(b, "<u8").astype(np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    rows = gathered.where("kind = 3").select("part", "a", "b").repartitionById(parts, "part")
    made = rows.mapInArrow(freeing(run), "key long, n long").toArrow()
    return add_counts(made.column("key").to_numpy().astype(np.uint64), made.column("n").to_numpy())


def _chances(gathered: DataFrame, low: Counts, parts: int, smoothing: float) -> DataFrame:
    """(chunk, part, a): log10 probabilities of a chunk's strings of a range, in their order."""
    shared = gathered.sparkSession.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for batch in batches:
            for part, chunk, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                asked.setdefault(part, []).append((chunk, a, b))
        if not asked:
            return
        short = levels(*shared.value, LOW, 0)
        for part, rows in asked.items():
            keys, n = add_counts(
                np.concatenate([unpack_grams(a) for _, a, _ in rows]),
                np.concatenate([unplanes(b, "<u4").astype(np.int64) for _, _, b in rows]),
            )
            tree = short | levels(keys[n > 0], n[n > 0], DEPTH, LOW + 1)
            retain(tree)
            made = chances(keys, tree, smoothing).astype("<f4")
            for chunk, a, _ in rows:
                blob = planes(made[np.searchsorted(keys, unpack_grams(a))])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "part", "a"])

    rows = gathered.where("kind = 1").select("part", "chunk", "a", "b").repartitionById(parts, "part")
    return rows.mapInArrow(freeing(run), "chunk long, part int, a binary")


def score_strings(texts: list[bytes], made: np.ndarray, parts: int) -> np.ndarray:
    """log10 probabilities of canonical texts; made: those of their distinct strings, in order."""
    distinct, _ = count_strings(texts)
    value = np.empty(len(distinct))
    value[gram_order(distinct, parts)] = made
    out = np.zeros(len(texts))
    for a, b in cut_lines(map(len, texts), SORTED_BYTES):
        keys, which = np.unique(grams(texts[a:b]), return_inverse=True)
        doc = np.repeat(np.arange(b - a), list(map(len, texts[a:b])))
        out[a:b] = np.bincount(doc, value[np.searchsorted(distinct, keys)][which], b - a)
    return out


def _answers(gathered: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, a, n, v): training counts of a chunk's words, in their order; n and v of the part once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        by: dict[int, list] = {}
        for part, chunk, a, b in rows:
            by.setdefault(part, []).append((chunk, unpack_sorted(a), unplanes(b, "<u4").astype(np.int64)))
        for part, asked in by.items():
            keys, n = add_counts(np.concatenate([k for _, k, _ in asked]), np.concatenate([c for _, _, c in asked]))
            for i, (chunk, words, _) in enumerate(asked):
                made = planes(n[np.searchsorted(keys, words)].astype("<u8"))
                first = (int(n.sum()), int((n > 0).sum())) if i == 0 else (0, 0)
                columns = ([chunk], [part], [made], [first[0]], [first[1]])
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "part", "a", "n", "v"])

    rows = gathered.where("kind = 0").select("part", "chunk", "a", "b").repartitionById(parts, "part")
    return rows.mapInArrow(freeing(run), "chunk long, part int, a binary, n long, v long")


def _scores(gathered: DataFrame, answers: DataFrame, strings: DataFrame, n: int, v: int, parts: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score): one row a document, from a chunk's answers and its texts."""
    floor = np.log10(n + ADDED * (v + 1))
    none = [F.lit(None).cast("binary").alias(x) for x in "bc"]
    docs = gathered.where("kind = 2").select("chunk", F.lit(2).alias("kind"), "part", *"abc")
    counts = answers.select("chunk", F.lit(0).alias("kind"), "part", "a", *none)
    chance = strings.select("chunk", F.lit(1).alias("kind"), "part", "a", *none)
    met = docs.unionByName(counts).unionByName(chance).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for batch in batches:
            for kind, a, b, c in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5))):
                if kind < 2:
                    held[kind].append(unplanes(a, "<f4" if kind else "<u8"))
                    continue
                seen, made = (np.concatenate(held[x]).astype(float) for x in (0, 1))
                held = {0: [], 1: []}
                ids, some, out = np.frombuffer(a, "<u8").reshape(3, -1)
                ends = np.cumsum(unplanes(c, "<u8")).tolist()
                whole = unsqueeze(b)
                texts = [whole[x:y] for x, y in zip([0, *ends], ends)]
                flat, sizes = tokens(texts)
                count = seen[np.unique(flat, return_inverse=True)[1]]
                doc = np.repeat(np.arange(len(ids)), sizes)
                base = np.bincount(doc, np.log10(count + ADDED) - floor, len(ids))
                known = np.bincount(doc, count > 0, len(ids)).astype(np.int64)
                columns = (
                    pa.array(ids.view(np.int64), pa.int64(), mask=some == 0), pa.array(out.astype(bool)),
                    pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score_strings(texts, made, parts)),
                )
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return met.mapInArrow(freeing(run), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", smoothing: float = SMOOTHING, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row a row of docs.

    Training rows are those for which ``held_out`` (of this fold) is false; NULL ids train. A null text is empty:
    the end alone. With no training text, base and model are their smoothing alone. Repeated rows
    keep their rows. What has been asked is deleted once it is answered. The texts are read once; a text is never cut, so a very long one is a chunk of
    its own.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = shuffle_parts(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.withColumn("held", held_out(F.col("doc_id"), fold))
    gathered = materialise(gather(rows, parts), "gathered", "kind")
    answers = materialise(_answers(gathered, parts), "answers")
    drop(gathered, part="/kind=0")
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    strings = materialise(_chances(gathered, low_counts(gathered, parts), parts, smoothing), "strings")
    drop(gathered, part="/kind=1")
    scored = _scores(gathered, answers, strings, n, v, parts)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def smoothing_by_fold(docs: DataFrame, candidates: tuple[float, ...] = CANDIDATES, fold: int = 1) -> dict[float, float]:
    """{candidate: log10 probability of the rows of ``fold``, from the other training rows}: how SMOOTHING is chosen.

    Rows that score_documents() holds out (fold 0) take no part.
    """
    training = docs.where(~held_out(F.col("doc_id").cast("long")))
    score = lambda k: score_documents(training, smoothing=k, fold=fold).where("held_out").agg(F.sum("score")).first()[0]
    return {k: score(k) or 0.0 for k in candidates}
