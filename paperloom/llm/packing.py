"""Sequence packing by cutting-stock column generation.

1. Every document's ids are cut into full pieces of ``capacity`` ids and one remainder.
2. The remainders' lengths, rounded up to a grid, form a histogram (at most capacity / grid rows).
3. The linear program "cover the histogram with as few patterns as possible" is solved by column
   generation: a knapsack dynamic program prices columns, until none pays or Farley's bound
   shows the plan to be within ``gap`` of the optimum.
4. Pattern counts are rounded down; what that leaves over, fewer sequences than the program has
   columns, is placed by best fit, decreasing.
5. Pieces are ranked within their length on the executors, in groups of about RANK_GROUP_ROWS by
   hash whose sizes a distributed prefix scan adds up; rank r of a length fills slot r of that length in the plan. Only histogram and plan, whose size the grid bounds, are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import TEXT_BATCH_ROWS, freeing, materialise, prefix_scan, prepare
from paperloom.llm.tokens import forget, tokenizer

CAPACITY = 2048
GRID = 8
GAP = 2e-4
MAX_COLUMNS = 6000
RANK_GROUP_ROWS = 250


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the cut documents, each with ``end_id`` at its end.

    ids: little-endian unsigned 32 bits. A null or empty text is one piece, the end alone.
    Repeated rows are cut each by itself.
    """
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                part = batch.slice(begin, TEXT_BATCH_ROWS)
                rows = [[], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer(path).encode(part.column(1).to_pylist())):
                    ids += end
                    for at in range(0, len(ids), step):
                        cut = ids[at : at + step]
                        for column, value in zip(rows, (doc, at // 4, len(cut) // 4, len(ids) // 4, cut)):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "start", "length", "doc_tokens", "ids"]
                )

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("binary")).mapInArrow(freeing(run, forget), schema)


def price(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The best unbounded knapsack of sizes 1.. with these values: its value and its pattern."""
    sizes = len(values)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        n = min(c, sizes)
        gain = values[:n] + best[c - n : c][::-1]
        took[c] = k = int(gain.argmax())
        best[c] = gain[k]
        if best[c] <= best[c - 1] + 1e-12:  # leaving a unit free is as good
            best[c], took[c] = best[c - 1], -1
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] = pattern.get(took[c], 0) + 1
            c -= took[c] + 1
    return float(best[capacity]), pattern


def solve(demand: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """[(pattern {size: copies}, count)] that together hold every demanded size exactly once."""
    sizes = sorted(u for u, n in demand.items() if n)
    if not sizes:
        return []
    wanted = np.array([demand[u] for u in sizes], float)
    row = {u: i for i, u in enumerate(sizes)}
    m = len(sizes)
    columns = [{u: capacity // u} for u in sizes]
    inverse = np.diag([1.0 / (capacity // u) for u in sizes])
    count = inverse @ wanted
    bound = 0.0
    for _ in range(MAX_COLUMNS):
        dual = inverse.sum(axis=0)
        values = np.zeros(sizes[-1])
        values[np.array(sizes) - 1] = np.maximum(dual, 0)
        worth, pattern = price(values, capacity)
        bound = max(bound, float(np.maximum(dual, 0) @ wanted) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or count.sum() <= bound * (1 + gap):
            break
        column = {u + 1: n for u, n in pattern.items() if u + 1 in row}
        entry = np.zeros(m)
        for u, n in column.items():
            entry[row[u]] = n
        way = inverse @ entry
        ratio = np.full(m, np.inf)
        np.divide(count, way, out=ratio, where=way > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = max(0.0, ratio[out])
        count = np.maximum(count - step * way, 0)
        count[out] = step
        inverse[out] /= way[out]
        others = way.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        columns[out] = column
    left = dict(demand)
    plan = []
    for column, x in sorted(zip(columns, count), key=lambda p: -p[1]):
        n = int(x + 1e-6)
        n = min([n, *(left[u] // k for u, k in column.items())])
        if n > 0:
            plan.append((column, n))
            for u, k in column.items():
                left[u] -= k * n
    return plan + [(p, 1) for p in best_fit({u: n for u, n in left.items() if n}, capacity)]


def best_fit(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Best fit, decreasing, of what rounding left over."""
    bins: list[dict[int, int]] = []
    by_room: dict[int, list[int]] = {}
    for u in sorted(left, reverse=True):
        for _ in range(left[u]):
            room = next((r for r in range(u, capacity + 1) if by_room.get(r)), None)
            if room is None:
                bins.append({})
                at, room = len(bins) - 1, capacity
            else:
                at = by_room[room].pop()
            bins[at][u] = bins[at].get(u, 0) + 1
            by_room.setdefault(room - u, []).append(at)
    return bins


class Plan:
    """Slots of each size in order: rank within the size to (sequence, place in it)."""

    def __init__(self, plan: list[tuple[dict[int, int], int]], first: int):
        self.slots: dict[int, list] = {}
        for column, n in plan:
            place = 0
            for u in sorted(column, reverse=True):
                k = column[u]
                ends, rows = self.slots.setdefault(u, ([], []))
                ends.append((ends[-1] if ends else 0) + n * k)
                rows.append((ends[-1] - n * k, k, first, place))
                place += k
            first += n
        self.slots = {u: (np.array(e), np.array(r)) for u, (e, r) in self.slots.items()}

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for u in np.unique(size):
            at = np.flatnonzero(size == u)
            ends, rows = self.slots[int(u)]
            begin, k, first, shift = rows[np.searchsorted(ends, rank[at], side="right")].T
            sequence[at] = first + (rank[at] - begin) // k
            place[at] = shift + (rank[at] - begin) % k
        return sequence, place


def pack(cut: DataFrame, capacity: int = CAPACITY, grid: int = GRID, gap: float = GAP) -> DataFrame:
    """cut (doc_id, start, length, ... as of ``pieces``) with sequence_id, offset and padding.

    Each row gets a place of its own: offsets are gapless from 0 in every sequence, and no
    sequence exceeds ``capacity``. padding: of the row's sequence, which is padded to the
    capacity unless its length is a power of two. No rows give no rows. ``cut`` is read three
    times, so it should be a written table. Equal (doc_id, start) rows keep separate places.
    """
    room = capacity // grid
    units = F.when(F.col("length") == capacity, room + 1).otherwise(F.ceil(F.col("length") / grid)).cast("int")
    sized = cut.withColumn("_units", units)
    histogram = {r._units: r.n for r in sized.groupBy("_units").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(room + 1, 0)
    plan = Plan([({room + 1: 1}, full)] * bool(full) + solve(histogram, room, gap), 0)

    sizes = [full if u == room + 1 else histogram.get(u, 0) for u in range(room + 2)]
    groups = F.array(*(F.lit(max(1, -(-n // RANK_GROUP_ROWS))) for n in sizes))
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.get(groups, F.col("_units"))).cast("int")
    salted = sized.withColumn("_salt", salt)
    counts = salted.groupBy("_units", "_salt").agg(F.count("*").alias("_n"))
    counts = prefix_scan(counts, ["_units", "_salt"], {"_upto": ("sum", F.col("_n"))}, "ranks")
    smaller = F.array(*(F.lit(int(x)) for x in np.cumsum([0, *sizes[:-1]])))
    counts = counts.select("_units", "_salt", (F.col("_upto") - F.get(smaller, F.col("_units"))).alias("_before"))
    within = Window.partitionBy("_units", "_salt").orderBy("doc_id", "start")
    ranked = salted.join(counts, ["_units", "_salt"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(within) - 1
    )

    @F.pandas_udf("sequence_id long, place long")
    def slot(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, place = plan.place(size.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "place": place})

    placed = ranked.withColumn("_slot", slot("_units", "_rank"))
    placed = placed.withColumn("sequence_id", F.col("_slot.sequence_id")).withColumn("_place", F.col("_slot.place"))
    whole = Window.partitionBy("sequence_id")
    before = whole.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.sum("length").over(whole)
    exact = F.col("_filled").bitwiseAND(F.col("_filled") - 1) == 0
    return (
        placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .withColumn("_filled", filled)
        .withColumn("padding", F.when(exact, 0).otherwise(capacity - F.col("_filled")).cast("long"))
        .drop("_units", "_salt", "_before", "_rank", "_slot", "_place", "_filled")
    )


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """The sequences' pieces with their ids: tokenises, cuts and packs ``docs``."""
    return pack(materialise(pieces(docs, path, end_id, capacity, text), "pieces"), capacity)


def piece_digests(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """pack() over pieces whose ids are replaced by ids_crc32 before anything is written."""
    cut = pieces(docs, path, end_id, capacity)
    cut = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(materialise(cut, "pieces"), capacity)

