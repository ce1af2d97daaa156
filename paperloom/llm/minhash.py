"""Near-duplicate documents by SuperMinHash: banding, exact verification, union-find.

SuperMinHash gives every element one random permutation of the M signature slots: in step j the
element offers the value j + u to slot p(j). A slot keeps its least offer, so its owner is uniform
over the set (collision probability = Jaccard), while one element's ranks differ between slots,
which lowers the variance. Steps stop once j exceeds every slot's integer part: no later offer can
win. All elements of a batch of documents take a step together in numpy.

Stages: (1) set sizes, a 128-bit digest of the whole set and band keys, one pass over the texts;
(2) equal sets collapse onto their smallest doc_id; (3) every set meets the smallest set of each of
its buckets; verified links are joined by union-find; (4) in buckets that still hold several
components, every set outside the component of the bucket's smallest set meets all sets of other
components in the bucket, dealt in blocks, in which pairs are compared and joined by union-find at
once: no bucket is gathered in one task, no pair is skipped but those already connected, and pairs
are never emitted. A link counts only if it holds on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import (
    components,
    cut_lines,
    doc_bytes,
    freeing,
    materialise,
    mix64,
    prepare,
    shingle_hashes,
    shuffle_parts,
    word_hashes,
)

#: A pair at the threshold shares no band with probability (1 - .8^5)^40 = 1e-7.
BANDS = 40
ROWS = 5
SLOTS = BANDS * ROWS
BATCH_ELEMENTS = 60_000
BLOCK_ROWS = 400


def signatures(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[set, slot] of uint64: ids of the elements that own the slots. Sets lie one after another, none empty."""
    sets, n = len(sizes), len(elements)
    owner = np.repeat(np.arange(sets), sizes)
    best = np.full(sets * SLOTS, np.inf)
    spread = np.tile(np.arange(SLOTS, dtype=np.uint8 if SLOTS <= 256 else np.int16), (n, 1))
    live, seed = np.arange(n), mix64(elements)
    for j in range(SLOTS):
        draw = mix64(seed + np.uint64(j * 0xD1342543DE82EF95 % 2**64))
        offer = j + (draw >> np.uint64(32)).astype(np.float64) / 2.0**32
        k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j) >> np.uint64(32)).astype(np.int64)
        slot = spread[live, k]
        spread[live, k] = spread[live, j]
        np.minimum.at(best, owner[live] * SLOTS + slot, offer)
        if j % 2 or j < 2:
            done = best.reshape(sets, SLOTS).max(axis=1) < j + 1
            if done.all():
                break
            keep = ~done[owner[live]]
            live, seed = live[keep], seed[keep]
    return best.reshape(sets, SLOTS).view(np.uint64)


def band_keys(made: np.ndarray) -> np.ndarray:
    """[set, band] of int64."""
    grid = made.reshape(len(made), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(made), BANDS))
    for r in range(ROWS):
        key = mix64(key + grid[:, :, r])
    return key.view(np.int64)


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(word_hashes(raw), size))


def sketches(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, bands): one row a document; empty sets have no digest and no bands."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = [shingle_set(doc_bytes(x), size) for x in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            bands: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            for begin, end in cut_lines((len(sets[i]) for i in full), BATCH_ELEMENTS):
                part = [sets[i] for i in full[begin:end]]
                made = band_keys(signatures(np.concatenate(part), np.array([len(s) for s in part])))
                for i, row in zip(full[begin:end], made):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>"
    )


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on full sets (doc_id, n_shingles, items)."""
    sized = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(sized, "a").join(other, "b")
    return joined.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_duplicates(
    docs: DataFrame, size: int = 2, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row a row of docs.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; a
    component's id is the smallest doc_id in it. A text that is null or has no words has an empty
    set and no link. Rows with one doc_id get the same component. Texts are read twice: for the
    sketches, and for the sets of candidates alone.
    """
    spark = docs.sparkSession
    made = materialise(sketches(docs, size, key, text), "sketches")
    some = made.where("digest is not null and doc_id is not null")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = materialise(classes, "classes")

    rows = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("k"), F.min(F.struct("rep", "n")).alias("head")).where("k > 1")
    member = rows.join(buckets, "bucket")
    member = materialise(member.select("bucket", "rep", "n", "k", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n")), "buckets")

    wanted = member.select("rep").distinct()
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).cast("binary").alias("t")).join(wanted, "rep", "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(doc_bytes(x), size).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "items"]
            )

    sets = texts.mapInArrow(freeing(to_sets), "doc_id long, items array<long>")
    sets = materialise(sets.where(F.size("items") > 0), "sets")

    near = (100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")) & (F.col("rep") != F.col("head"))
    pairs = member.where(near).select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    links = materialise(_verified(pairs, sets, percent), "links")
    same = components(links)

    known = member.join(same.select(F.col("id").alias("rep"), "component"), "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    more = _rest(spark, known, sets, percent)
    links = links.unionByName(more)

    repeated = some.select("digest", F.col("doc_id").alias("b")).join(classes.select("digest", "rep"), "digest")
    equal = repeated.where("b <> rep").select(F.col("b").alias("a"), F.col("rep").alias("b"))
    if made.groupBy("doc_id").count().where("count > 1").isEmpty():
        same = materialise(components(links), "components")
        of = some.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest")
        of = of.join(same.select(F.col("id").alias("rep"), "component"), "rep", "left")
        of = of.select("doc_id", F.coalesce("component", "rep").alias("c"))
    else:  # a doc_id with several texts joins their classes
        same = components(links.unionByName(equal))
        of = same.select(F.col("id").alias("doc_id"), F.col("component").alias("c"))
    out = made.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _rest(spark, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a bucket that its smallest set doesn't give.

    known: (bucket, rep, n, k, head, component). In a bucket of k sets, m of which lie outside the
    head's component, each outside row goes to every one of about k / BLOCK_ROWS blocks of all
    rows, and each row to every one of about m / BLOCK_ROWS blocks of outside rows.
    """
    heads = known.where("rep = head").select("bucket", F.col("component").alias("main"))
    state = known.join(heads, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    open_ = state.groupBy("bucket").agg(F.sum(F.col("outside").cast("long")).alias("m")).where("m > 0")
    state = state.join(open_, "bucket").where("k > 2 or outside or rep = head")
    # with two rows the only pair has been compared
    state = state.where("k > 2")
    blocks = F.ceil(F.col("k") / BLOCK_ROWS).cast("int")
    outer = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    at = F.xxhash64("rep", "bucket")
    probe = state.where("outside").select(
        "bucket", "rep", "n", "component", F.lit(1).alias("probe"), F.pmod(at, outer).cast("int").alias("o"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"),
    )
    build = state.select(
        "bucket", "rep", "n", "component", F.lit(0).alias("probe"), F.explode(F.sequence(F.lit(0), outer - 1)).alias("o"),
        F.pmod(at, blocks).cast("int").alias("i"),
    )
    rows = probe.unionByName(build).withColumn("cell", F.xxhash64("bucket", "o", "i"))
    rows = rows.join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")
    dealt = rows.select("cell", "probe", "rep", "component", "items").repartition(shuffle_parts(spark), "cell")
    dealt = dealt.sortWithinPartitions("cell", "probe", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, built, groups = None, [], {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            items = batch.column(4)
            ends, flat = items.offsets.to_numpy(), items.values.to_numpy()
            for r, (cell, probe, rep, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if cell != now:
                    now, built, groups = cell, [], {}
                mine = flat[ends[r] : ends[r + 1]].view(np.uint64)
                if not probe:
                    built.append((len(mine), rep, part, mine.copy()))
                    continue
                for n, other, theirs, set_ in built:
                    if 100 * min(n, len(mine)) < percent * max(n, len(mine)) or other == rep:
                        continue
                    a, b = _root(groups, part), _root(groups, theirs)
                    if a != b and linked(mine, set_, percent):
                        groups[a] = b
                        found.append((rep, other))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"]
            )

    return materialise(dealt.mapInArrow(freeing(run), "a long, b long"), "links")


def _root(groups: dict[int, int], x: int) -> int:
    while x in groups:
        x = groups[x]
    return x


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicates; their columns as they are."""
    made = near_duplicates(docs, size, percent, key, text)
    kept = made.where("kept or doc_id is null").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[key].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id, d.doc_id = min(root) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n
"""
