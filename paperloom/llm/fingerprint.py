"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

A text's set is its five-word shingles (of all its words if it has fewer), words lower-cased A-Z.
Every shingle is hashed once: the high part of the hash names one of BINS bins, the rest is its
value there, and a bin keeps its least value. An empty bin takes the value of the first occupied
bin in a fixed random sequence of its own (optimal densification: the sequences of different bins
are independent). Values are mixed with the bin's number, and BITS low-order bits of each are kept.

Two fingerprints agree by chance in 2^-BITS of the bins, so with m matching bins of BINS the
estimate (m / BINS - 2^-BITS) / (1 - 2^-BITS) is unbiased, up to its clipping to 0 .. 1.
A text without words has the empty fingerprint: alike (1.0) to the empty one, unlike all others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import TEXT_BATCH_ROWS, mix64, prepare, shingle_hashes, shuffle_parts, word_hashes

BINS = 512
BITS = 4
SHINGLE = 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 55) - 1)


#: [empty bin, other bin]: the other bin's place in the empty bin's random sequence of bins.
_PLACE = (mix64(mix64(np.arange(BINS * BINS, dtype=np.uint64))) >> np.uint64(32)).astype(np.uint32).reshape(BINS, BINS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """BINS values of BITS bits of a set of 64-bit hashes (repeats don't matter); not of an empty set."""
    bins = (hashes >> np.uint64(55)).astype(np.int64)
    least = np.full(BINS, _NONE)
    np.minimum.at(least, bins, hashes & _LOW)
    empty = np.flatnonzero(least == _NONE)
    if len(empty):
        used = np.flatnonzero(least != _NONE)
        least[empty] = least[used[_PLACE[np.ix_(empty, used)].argmin(axis=1)]]
    return (mix64(least + np.arange(BINS, dtype=np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def values(text: str | None) -> np.ndarray | None:
    """The fingerprint's values, None for a text without words."""
    hashes = shingle_hashes(word_hashes((text or "").encode()), SHINGLE)
    return sketch(hashes) if len(hashes) else None


def packed(made: np.ndarray | None) -> str:
    """The values as base64 of their packed bits; empty for None."""
    if made is None:
        return ""
    bits = np.unpackbits(made[:, None], axis=1)[:, 8 - BITS :]
    return base64.b64encode(np.packbits(bits)).decode()


def unpacked(text: str) -> np.ndarray | None:
    if not text:
        return None
    bits = np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8)).reshape(BINS, BITS)
    return np.packbits(np.pad(bits, ((0, 0), (8 - BITS, 0))), axis=1)[:, 0]


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The estimated Jaccard similarity, 0 to 1."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and ``fingerprint`` (string). One pass, no exchange."""
    prepare(docs.sparkSession)
    docs = docs.drop("fingerprint")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([packed(values(x)) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*names, "fingerprint"])

    return docs.mapInArrow(run, docs.withColumn("fingerprint", F.lit("")).schema)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_part, doc_id, text, _carried), dealt and sorted so that each row's successor follows it.

    Rows go to ranges of doc_id. The first row of each range goes also, marked, to the end of the
    range before it (that of the first range to the last): one exchange of the texts and no join.
    Range bounds and first rows' ids (one a range) are all that the driver sees. Among rows that
    share a doc_id, the order is by text; NULL ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = shuffle_parts(spark)
    ids = rows.where("doc_id is not null").select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c")).first().c if n > 1 else []
    cuts = sorted(set(cuts or []))
    place = F.lit(0)
    if cuts:
        bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
        place = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: F.col("doc_id") >= c)))
    dealt = rows.withColumn("_part", place.cast("int"))
    first = dealt.groupBy("_part").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id")).alias("f")
    ).orderBy("_part").collect()
    to = {first[i]._part: first[i - 1]._part for i in range(len(first))}
    firsts = [(r._part, r.f.doc_id, to[r._part]) for r in first]
    if not firsts:
        return dealt.withColumn("_carried", F.lit(False))
    heads = F.array(
        *(F.struct(F.lit(p).alias("p"), F.lit(d).cast("long").alias("d"), F.lit(t).alias("t")) for p, d, t in firsts)
    )
    again = F.transform(
        F.filter(heads, lambda h: (h.p == F.col("_part")) & h.d.eqNullSafe(F.col("doc_id"))), lambda h: h.t
    )
    targets = F.concat(
        F.array(F.struct(F.col("_part").alias("to"), F.lit(False).alias("carried"))),
        F.transform(again, lambda t: F.struct(t.alias("to"), F.lit(True).alias("carried"))),
    )
    spread = dealt.select("doc_id", "text", F.explode(targets).alias("_to"))
    spread = spread.select(
        F.col("_to.to").alias("_part"), "doc_id", "text", F.col("_to.carried").alias("_carried")
    )
    return spread.repartitionById(n, "_part").sortWithinPartitions("_part", "_carried", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first code points of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and likenesses to it and to the next row.

    (doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next). Null
    text counts as empty. Rows with equal doc_id follow each other by text; the last row's next is
    the first row; a single row's next is itself.
    """
    prepare(docs.sparkSession)
    sorted_rows = with_next(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its successor
        done = None  # the part whose successor row has come

        def pairs() -> Iterable[tuple]:
            nonlocal held, done
            for batch in batches:
                for begin in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                    out = []
                    for part, doc, body, carried in zip(*(c.to_pylist() for c in batch.slice(begin, TEXT_BATCH_ROWS).columns)):
                        if carried and done == part:
                            continue  # of equal first ids only the first row follows
                        body = body or ""
                        row = (part, doc, body, values(body))
                        if held is not None and held[0] == part:
                            out.append((held, row))
                        held, done = (None, part) if carried else (row, None)
                    yield out

        for chunk in pairs():
            rows: list[list] = [[] for _ in range(7)]
            for (_, doc, body, mine), (_, _, other, theirs) in chunk:
                changed = edited(body, other)
                made = mine if changed == body else values(changed)
                for column, value in zip(rows, (doc, len(body), changed, packed(mine), packed(made), likeness(mine, made), likeness(mine, theirs))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], NAMES)

    return sorted_rows.select("_part", "doc_id", "text", "_carried").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = (
    "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
