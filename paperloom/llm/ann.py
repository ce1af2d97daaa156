"""Approximate nearest neighbours by multi-index hashing.

Codes are learned: the vectors of a bounded sample (SAMPLE rows, the first by a hash of their ids)
are centred and rotated to principal axes, and a rotation that brings them closest to their signs
is found by alternation (iterative quantisation). Every vector is indexed by the signs of its
rotated components, at most 64 bits.

Codes are split into TABLES substrings, and each block of the index holds a table of rows by value
for each substring. If two codes differ in at most r bits, some substring differs in at most
floor(r / TABLES): probing those values retrieves every code within radius r. The radius grows
until a wanted share of a block's rows is within it; all of these are reranked on the original vectors.
That share is measured, not set: on the sample, it is the least that would have found RECALL of the
true k nearest rows of PROBES sample rows. A wanted recall of 1 takes in all rows and is exact.

Rows and queries meet in cells of one block of rows and one block of queries, so no task's input
grows with the tables; each cell returns its nearest k of each query, which are merged. Distances
are defined between vectors of one dimension: those of another than most of the sample's have
cells of their own, in which all rows are reranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import prepare, shuffle_parts

SAMPLE = 10_000
BITS = 64
TABLES = 8
BLOCK_ROWS = 8192
BLOCK_QUERIES = 512
#: The share of the sample rows' nearest that the radius must take in, and the rows of a block that it takes in at least.
RECALL = 0.97
PROBES = 500
LEAST = 200
ROUNDS = 25


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not empty or zero and has only finite components."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(sound & F.exists("v", lambda x: x != 0))


class Codes:
    """The learned rotation: vectors to codes."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(axis=0)
        self.scale = max(float(np.abs(sample - self.mean).max()), 1e-300)
        centred = (sample - self.mean) / self.scale
        bits = min(BITS, sample.shape[1])
        axes = np.linalg.svd(centred.T @ centred)[0][:, :bits]
        flat = centred @ axes
        turn = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ w).T
        self.turn = axes @ turn

    def code(self, rows: np.ndarray) -> np.ndarray:
        """[row, table] of uint8: the substrings of each row's code."""
        signs = ((rows - self.mean) / self.scale @ self.turn >= 0).astype(np.uint8)
        signs = np.pad(signs, ((0, 0), (0, 8 * TABLES - signs.shape[1])))
        return np.packbits(signs, axis=1)


    def share(self, sample: np.ndarray, k: int, recall: float) -> float:
        """The share of rows, nearest by code, that holds ``recall`` of the nearest k by distance."""
        if recall >= 1 or len(sample) <= k + 1:
            return 1.0
        codes = self.code(sample).view(np.uint64).ravel()
        size = (sample**2).sum(axis=1)
        needed = []
        for i in range(min(PROBES, len(sample))):
            away = size - 2 * (sample @ sample[i])
            away[i] = np.inf
            apart = np.bitwise_count(codes ^ codes[i])
            within = np.cumsum(np.bincount(apart, minlength=8 * TABLES + 1))
            needed.append(within[apart[np.argpartition(away, k)[:k]]])
        return float(np.quantile(np.concatenate(needed), recall, method="higher")) / len(sample)


#: Values of a substring by the number of bits that differ from 0.
_FLIPS = [np.array([sum(1 << b for b in c) for c in combinations(range(8), n)], np.uint8) for n in range(9)]
_COUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class Block:
    """Rows of one block, found by the substrings of their codes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray | None, share: float = 1.0):
        self.ids, self.rows, self.codes, self.share = ids, rows, codes, share
        if codes is None or share >= 1:
            self.share = 1.0
            return
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(TABLES)]
        self.start = [np.searchsorted(codes[o, t], np.arange(257)) for t, o in enumerate(self.order)]

    def search(self, own: int, vector: np.ndarray, code: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest rows found, nearest first, smaller ids first in ties."""
        near = np.arange(len(self.ids)) if self.share >= 1 else self.within(code, k)
        near = near[self.ids[near] != own]
        away = np.sqrt(((self.rows[near] - vector) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[near], away))[:k]
        return self.ids[near][best], away[best]

    def within(self, code: np.ndarray, k: int) -> np.ndarray:
        """All rows in the least radius that takes in the wanted share."""
        wanted = min(len(self.ids), max(LEAST, k + 1, int(np.ceil(self.share * len(self.ids)))))
        apart = np.full(len(self.ids), 255, np.uint8)  # bits, of the rows that have been retrieved
        for flips in range(9):
            hits = [
                self.order[t][self.start[t][v] : self.start[t][v + 1]]
                for t in range(TABLES)
                for v in (code[t] ^ _FLIPS[flips]).astype(int).tolist()
            ]
            hit = np.concatenate(hits)
            hit = np.unique(hit[apart[hit] == 255])
            apart[hit] = _COUNT[self.codes[hit] ^ code].sum(axis=1)
            complete = TABLES * (flips + 1) - 1  # every code within this radius has been retrieved
            counts = np.cumsum(np.bincount(apart[apart < 255], minlength=8 * TABLES + 1))
            if counts[min(complete, 8 * TABLES)] >= wanted or flips == 8:
                return np.flatnonzero(apart <= min(int(np.searchsorted(counts, wanted)), complete))
        return np.arange(len(self.ids))


def learn(rows: DataFrame, k: int, recall: float) -> tuple[Codes, float] | None:
    """Codes of the most common dimension in the sample, and the share to rerank; None if there are no rows."""
    got = rows.withColumn("h", F.xxhash64("id", "v")).orderBy("h", "id").limit(SAMPLE).collect()
    if not got:
        return None
    sizes = [len(r.v) for r in got]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
    sample = np.array([r.v for r in got if len(r.v) == dim])
    codes = Codes(sample)
    return codes, codes.share(sample, k, recall)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows found by Euclidean distance.

    A query's own id is no candidate. Unusable vectors (see ``usable``) take no part, and only
    vectors of one dimension meet. Of rows with one id the one with the least vector counts.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    learned = learn(rows, k, recall)
    schema = "query_id long, vec_id long, score double"
    if learned is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes, share = learned
    main = len(codes.mean)
    blocks, chunks = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-asked.count() // BLOCK_QUERIES))
    rows, asked = (x.groupBy("id").agg(F.min("v").alias("v")) for x in (rows, asked))

    def dealt(frame: DataFrame, query: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(chunks if query else blocks))
        all_ = F.explode(F.sequence(F.lit(0), F.lit((blocks if query else chunks) - 1)))
        frame = frame.select(mine.alias("x"), all_.alias("y"), F.lit(query).alias("query"), F.size("v").alias("dim"), "id", "v")
        cell = F.col("y") * chunks + F.col("x") if query else F.col("x") * chunks + F.col("y")
        return frame.select(cell.cast("long").alias("cell"), "dim", "query", "id", "v")

    met = dealt(rows, 0).unionByName(dealt(asked, 1))
    met = met.repartition(max(shuffle_parts(spark), min(blocks * chunks, 100_000)), "cell", "dim")
    met = met.sortWithinPartitions("cell", "dim", "query", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, block = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, dim, query, key_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            values, offsets = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
            out: list[list[np.ndarray]] = [[], [], []]
            change = np.ones(len(cell), bool)
            change[1:] = (cell[1:] != cell[:-1]) | (dim[1:] != dim[:-1]) | (query[1:] != query[:-1])
            cuts = np.flatnonzero(change)
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                mine = values[offsets[a] : offsets[b]].reshape(b - a, -1)
                made = codes.code(mine) if dim[a] == main else None
                if (cell[a], dim[a]) != now:
                    now, ids, parts, block = (cell[a], dim[a]), [], [], None
                if not query[a]:
                    ids.append(key_[a:b])
                    parts.append((mine, made))
                    continue
                if block is None and ids:
                    names = None if made is None else np.concatenate([p for _, p in parts])
                    block = Block(np.concatenate(ids), np.concatenate([p for p, _ in parts]), names, share)
                for i in range(b - a) if block is not None else ():
                    found, away = block.search(key_[a + i], mine[i], None if made is None else made[i], k)
                    for column, value in zip(out, (np.full(len(found), key_[a + i]), found, away)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64())
            arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
