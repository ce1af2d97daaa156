"""What the corpus operators share: the shared scratch folder, cut points, hashes, scans."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows of an Arrow batch where rows hold whole texts.
TEXT_BATCH_ROWS = 500

#: Spark's setting to delete an action's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Longer keys aren't kept by Recent.
CACHED_LENGTH = 48


def prepare(spark: SparkSession) -> None:
    """Workers can import this package, and Arrow batches of whole texts stay small."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    base = base or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/paperloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder: cuts its lineage.

    Any executor can reread it, so a lost executor costs a reread, not a recomputation. The
    exchanges behind it are deleted as soon as it is written. by: a column of few values, each of
    which gets a folder that drop() can delete alone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.unset(CLEANUP) if held is None else spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame, part: str = "") -> None:
    """Deletes tables that materialise() has written and that nothing reads any more; of tables in
    folders by a value, only those of ``part``."""
    for table in tables:
        spark = table.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if not name.endswith(part):
                continue
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything that materialise() has written; results built on it end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark) + "/paperloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable:
    """run, after which the worker gives its free memory back: workers outlive tasks and stages. forget: drops caches before."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return whole


class Recent(dict):
    """A cache of two generations: what a generation of entries doesn't use is forgotten."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
            if len(key) > CACHED_LENGTH:
                return made
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = made
        return made


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (finaliser of the public splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doc_bytes(raw: bytes | None) -> bytes:
    return b"" if raw is None else raw


#: Words are hashed in blocks of so many bytes; longer ones than LONG_WORD one by one.
WORD_BLOCK = 1 << 16
LONG_WORD = 64
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(WORD_BLOCK - 1, base, np.uint64))), dtype=np.uint64)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = mix64(np.arange(256, dtype=np.uint64))


def words_of(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of bytes, and where they begin.

    Sums of value * base^place over a block's bytes give all words' polynomials at once; what
    stands before a word is divided out. A word's hash doesn't depend on its place.
    """
    import xxhash

    data = np.frombuffer(low, np.uint8)
    space = _SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(data)]))
    start, stop = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    size = stop - start
    at = 0
    while at < len(start):
        begin = start[at]
        to = max(at + 1, int(np.searchsorted(stop, begin + WORD_BLOCK, side="right")))
        if stop[to - 1] - begin <= WORD_BLOCK:
            sums = np.zeros(stop[to - 1] - begin + 1, np.uint64)
            np.cumsum(_VALUES[data[begin : stop[to - 1]]] * _POWERS[: len(sums) - 1], out=sums[1:])
            a = start[at:to] - begin
            out[at:to] = (sums[stop[at:to] - begin] - sums[a]) * _INVERSE[a]
        at = to
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(low[start[i] : stop[i]])
    return mix64(out + size.astype(np.uint64)), start


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, A-Z lower-cased."""
    return words_of(raw.lower())[0]


def batch_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of many texts, one after another, and how many each text has."""
    hashes, start = words_of(b"\n".join(raws).lower())
    ends = np.cumsum([len(x) + 1 for x in raws]) if raws else np.zeros(0, np.int64)
    return hashes, np.diff(np.searchsorted(start, ends, side="left"), prepend=0)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = mix64(out) + words[i : len(words) - size + 1 + i]
    return mix64(out)


def cut_lines(lengths: Iterable[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive row ranges whose lengths sum to about ``limit`` at most (one row at least)."""
    out, begin, total, i = [], 0, 0, -1
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if i >= 0:
        out.append((begin, i + 1))
    return out


def prefix_scan(df: DataFrame, order: Sequence[str], scans: dict[str, tuple[str, Column]], name: str) -> DataFrame:
    """df with exclusive prefix aggregates over a total order, without one task for all rows.

    scans: {new column: ("sum" or "max", value)}. Rows are dealt by range and written once;
    each range scans its own rows, ranges are scanned by their totals (one row a range).
    The first row gets 0 for a sum and NULL for a maximum.
    """
    spark = df.sparkSession
    kind = {"sum": F.sum, "max": F.max}
    values = {f"_v{i}": value for i, (_, value) in enumerate(scans.values())}
    dealt = df.withColumns(values).repartitionByRange(shuffle_parts(spark), *order)
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()), name)
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ops = [kind[op] for op, _ in scans.values()]
    totals = dealt.groupBy("_range").agg(*(op(f"_v{i}").alias(f"_t{i}") for i, op in enumerate(ops)))
    totals = totals.select("_range", *(op(f"_t{i}").over(earlier).alias(f"_b{i}") for i, op in enumerate(ops)))
    out = dealt.withColumns({f"_l{i}": op(f"_v{i}").over(before) for i, op in enumerate(ops)})
    out = out.join(totals, "_range", "left")
    done = {}
    for i, (column, (op, _)) in enumerate(scans.items()):
        if op == "sum":
            done[column] = F.coalesce(F.col(f"_l{i}"), F.lit(0)) + F.coalesce(F.col(f"_b{i}"), F.lit(0))
        else:
            done[column] = F.greatest(f"_l{i}", f"_b{i}")
    out = out.withColumns(done)
    return out.drop("_range", *(f"_{c}{i}" for c in "vlb" for i in range(len(ops))))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` reaches. Distributed union-find.

    Alternates hooking of neighbours onto the smallest neighbour (large star, then small star)
    until no edge changes; every round is written to the shared folder. A hub's edges are joined
    with its minimum, never gathered.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    now = now.where("a is not null and b is not null and a <> b")
    now = materialise(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        now = materialise(small.where("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == mark:
            break
        mark = (seen.n, seen.s)
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
