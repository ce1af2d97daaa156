"""Phrase collocations by hierarchical pair naming.

A phrase of k words is a pair of adjacent phrases of k-1 words that overlap in all but one, so each level
replaces two adjacent ids of the level below by the id of their pair: a pair can be frequent only if both its
halves are. Texts are cut into chunks of one language, kept as sequences of local word numbers, with 0 between
pieces. A chunk tells each distinct word once; words join globally and the frequent ones get an id. From then on
chunks send their distinct pairs of ids, counted, to the owner of the pair's hash, which adds them up, names the
frequent pairs and answers each chunk in the order it asked; infrequent pairs have id 0 and end there.

A pair's two ids are its parent pointers. Going down the levels, each phrase inherits from its left half the counts
of its first words, from its right half those of its last words: every cut of the phrase is a lookup in these.
A phrase lies inside a longer one that is frequent enough just if it is a half of such a one, because halves are at
least as frequent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import drop, freeing, materialise, mix64, prepare, shuffle_parts

UNKNOWN = "und"
#: Words of a chunk, and its distinct ones, at which it is handed on.
CHUNK_WORDS = 3_000_000
CHUNK_DISTINCT = 300_000
#: Longer texts are cut in blocks of about so many bytes, between two pieces.
TEXT_BLOCK = 1 << 20
SCALE = 1_000_000
_SEPARATOR = re.compile(rb"[.,;:!?\n-\r]")
_TO_DOT = bytes(0x2E if _SEPARATOR.match(bytes([c])) else c for c in range(256))
CHUNKS = "kind string, chunk long, lang string, word string, local int, n long, data binary"
ASKED = "range int, chunk long, lang string, data binary"
OWNED = "kind string, range int, chunk long, data binary, lang string, id long, left_id long, right_id long, f long"
ROWS = "chunk long, lang string, level int, range int, local int, id long, data binary"


class Numbers(dict):
    """Words by number, in order of their coming; 0 stands between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks_of(raw: bytes) -> Iterator[bytes]:
    """The text in blocks that each begin at a separator, but the first one."""
    at = 0
    while len(raw) - at > TEXT_BLOCK and (found := _SEPARATOR.search(raw, at + TEXT_BLOCK)):
        yield raw[at : found.start()]
        at = found.start()
    yield raw[at:]


class Chunk:
    def __init__(self):
        self.numbers, self.parts, self.size = Numbers({b".": 0}), [], 0

    def add(self, raw: bytes) -> None:
        for block in blocks_of(raw):
            words = block.lower().translate(_TO_DOT).replace(b".", b" . ").split()
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
            self.size += len(words) + 1
        self.parts.append(np.zeros(1, np.uint32))

    def batches(self, number: int, lang: str) -> Iterator[pa.RecordBatch]:
        import zstandard

        sequence = np.concatenate(self.parts)
        count = np.bincount(sequence, minlength=len(self.numbers))
        words = list(self.numbers)
        names = CHUNKS.replace(",", "").split()[::2]

        def batch(kind: str, word: list, local: list, n: list, data: list) -> pa.RecordBatch:
            rows = len(data)
            columns = ([kind] * rows, [number] * rows, [lang] * rows, pa.array(word, pa.binary()).cast(pa.string()), local, n, data)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds)], names)

        yield batch("sequence", [None], [None], [None], [zstandard.compress(sequence.tobytes(), 3)])
        for at in range(1, len(words), 50_000):
            to = min(at + 50_000, len(words))
            yield batch("word", words[at:to], list(range(at, to)), count[at:to].tolist(), [None] * (to - at))


def chunks(docs: DataFrame, words: int = CHUNK_WORDS, distinct: int = CHUNK_DISTINCT) -> DataFrame:
    """Rows CHUNKS of docs (lang, text): a chunk's sequence, and how often it has each of its words.

    A task holds a chunk for each language; when all have ``words`` words or ``distinct`` different ones, it hands the largest on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Chunk] = {}
        number, size, different = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for lang, raw in zip(*(c.to_pylist() for c in batch.columns)):
                chunk = held.setdefault(lang, Chunk())
                before = chunk.size, len(chunk.numbers)
                chunk.add(raw)
                size, different = size + chunk.size - before[0], different + len(chunk.numbers) - before[1]
                while held and (size > words or different > distinct):
                    largest = max(held, key=lambda x: held[x].size)
                    chunk = held.pop(largest)
                    size, different = size - chunk.size, different - len(chunk.numbers)
                    yield from chunk.batches(number, largest)
                    number += 1
        for lang, chunk in held.items():
            yield from chunk.batches(number, lang)
            number += 1

    return docs.mapInArrow(freeing(run), CHUNKS)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """Arrays of one length, packed one after another."""
    import zstandard

    raw = zstandard.decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _owner(left: np.ndarray, right: np.ndarray, ranges: int) -> np.ndarray:
    return (mix64(mix64(left.view(np.uint64)) + right.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)


class Level:
    """The ids of one level over a chunk's sequence: each place's code (-1: none) and each code's id (0: infrequent)."""

    def __init__(self, code: np.ndarray, ids: np.ndarray):
        self.code, self.ids = code, ids

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the pairs that begin at each place, their left and right ids, and how often they occur."""
        known = np.zeros(len(self.code), bool)
        there = self.code >= 0
        known[there] = self.ids[self.code[there]] > 0
        at = np.flatnonzero(known[:-1] & known[1:])
        key = self.code[at].astype(np.uint64) << np.uint64(32) | self.code[at + 1].astype(np.uint64)
        pair, code, n = np.unique(key, return_inverse=True, return_counts=True)
        codes = np.full(len(self.code), -1, np.int64)
        codes[at] = code
        return codes, self.ids[(pair >> np.uint64(32)).astype(np.int64)], self.ids[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)], n


def _level(rows: pa.Table, level: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a chunk's level, from its sequence and the answers of all levels up to this one."""
    at, local = rows["level"].to_numpy(), rows["local"].combine_chunks()
    (sequence,) = _unpack(rows["data"][int(np.flatnonzero(at == 0)[0])].as_py(), "<u4")
    ids = np.zeros(int(sequence.max(initial=0)) + 1, np.int64)
    words = np.flatnonzero(at == 1)
    ids[local.take(pa.array(words)).to_numpy()] = rows["id"].combine_chunks().take(pa.array(words)).to_numpy()
    found = Level(sequence.astype(np.int64), ids).pairs()
    for k in range(2, level + 1):
        code, left, right, _ = found
        owner = _owner(left, right, ranges)
        asked = np.argsort(owner, kind="stable")
        edge = np.searchsorted(owner[asked], np.arange(ranges + 1))
        ids = np.zeros(len(left), np.int64)
        for i in np.flatnonzero(at == k).tolist():
            part = rows["range"][i].as_py()
            ids[asked[edge[part] : edge[part + 1]]] = _unpack(rows["data"][i].as_py(), "<i8")[0]
        found = Level(code, ids).pairs()
    return found


def _ask(rows: DataFrame, level: int, ranges: int) -> DataFrame:
    """Rows ASKED: of each chunk the distinct pairs of its ids of ``level``, by their owners."""

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        _, left, right, n = _level(rows, level, ranges)
        owner = _owner(left, right, ranges)
        asked = np.argsort(owner, kind="stable")
        edge = np.searchsorted(owner[asked], np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(edge))
        packed = []
        for r in some.tolist():
            i = asked[edge[r] : edge[r + 1]]
            packed.append(zstandard.compress(left[i].tobytes() + right[i].tobytes() + n[i].astype("<u4").tobytes(), 3))
        chunk, lang = rows["chunk"][0].as_py(), rows["lang"][0].as_py()
        return pa.table({
            "range": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int64()),
            "lang": pa.array([lang] * len(some), pa.string()), "data": pa.array(packed, pa.binary()),
        })

    return rows.groupBy("chunk").applyInArrow(run, ASKED)


def _own(asked: DataFrame, least: int) -> DataFrame:
    """Rows OWNED: the pairs that occur ``least`` times, named, and the names in the order in which each chunk has asked."""

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        parts = [_unpack(x, "<i8", "<i8", "<u4") for x in rows["data"].to_pylist()]
        left, right, n = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((right, left))
        a, b = left[by], right[by]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        f = np.add.reduceat(n[by].astype(np.int64), at)
        often = f >= least
        number = rows["range"][0].as_py()
        name = np.zeros(len(at), np.int64)
        name[often] = (number << 40) + 1 + np.arange(int(often.sum()))
        ids = np.empty(len(by), np.int64)
        ids[by] = np.repeat(name, np.diff(np.concatenate((at, [len(by)]))))
        ends = np.cumsum([len(x[0]) for x in parts])
        answers = [(c, x) for c, x in zip(rows["chunk"].to_pylist(), np.split(ids, ends[:-1])) if x.any()]
        which = np.searchsorted(ends, by[at[often]], side="right")
        size, m = len(answers), int(often.sum())
        none = lambda k, kind: pa.nulls(k, kind)
        lang = rows["lang"].combine_chunks().take(pa.array(which))
        columns = {
            "kind": ["answer"] * size + ["pair"] * m, "range": pa.array([number] * (size + m), pa.int32()),
            "chunk": pa.concat_arrays([pa.array([c for c, _ in answers], pa.int64()), none(m, pa.int64())]),
            "data": pa.concat_arrays([pa.array([zstandard.compress(x.tobytes(), 3) for _, x in answers], pa.binary()), none(m, pa.binary())]),
            "lang": pa.concat_arrays([none(size, pa.string()), lang.cast(pa.string())]),
        }
        for c, v in (("id", name[often]), ("left_id", a[at[often]]), ("right_id", b[at[often]]), ("f", f[often])):
            columns[c] = pa.concat_arrays([none(size, pa.int64()), pa.array(v, pa.int64())])
        return pa.table(columns)

    return asked.groupBy("range").applyInArrow(run, OWNED)


def phrases(docs: DataFrame, longest: int, least: int, chunk_words: int = CHUNK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases by level, and each language's number of words: (lang, n). docs (lang, text), none null.

    A level has (lang, id, left_id, right_id, phrase, last, f, first_f, last_f): the last word, and the counts of the
    phrase's first and last 1, 2, ... words, as arrays.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranges = shuffle_parts(spark)
    made = materialise(chunks(docs, chunk_words), "chunks", "kind")
    told = made.where("kind = 'word'")
    counted = told.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counted = materialise(counted, "words")
    total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counted.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id() + 1)
    words = materialise(words, "words")
    none = F.array().cast("array<long>")
    levels = [words.select(
        "lang", "id", F.lit(None).cast("long").alias("left_id"), F.lit(None).cast("long").alias("right_id"),
        F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("first_f"), none.alias("last_f"),
    )]

    def row(df: DataFrame, level: int) -> DataFrame:
        given = {"level": F.lit(level)}
        return df.select(*(
            (given[n] if n in given else F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n)
            for n, k in (x.split() for x in ROWS.split(", "))
        ))

    known = materialise(row(told.join(words, ["lang", "word"]), 1), "known")
    rows = row(made.where("kind = 'sequence'"), 0).unionByName(known)
    for level in range(1, longest):
        owned = materialise(_own(_ask(rows, level, ranges), least), "pairs", "kind")
        rows = rows.unionByName(row(owned.where("kind = 'answer'"), level + 1))
        half = levels[-1]
        left = half.select(F.col("id").alias("left_id"), F.col("phrase").alias("l"), F.col("f").alias("lf"), "first_f")
        right = half.select(F.col("id").alias("right_id"), "last", F.col("f").alias("rf"), "last_f")
        pairs = owned.where("kind = 'pair'").select("lang", "id", "left_id", "right_id", "f")
        named = pairs.join(left, "left_id").join(right, "right_id").select(
            "lang", "id", "left_id", "right_id", F.concat_ws(" ", "l", "last").alias("phrase"), "last", "f",
            F.array_append("first_f", F.col("lf")).alias("first_f"), F.array_append("last_f", F.col("rf")).alias("last_f"),
        )
        levels.append(materialise(named, "phrases"))
    drop(made, known)
    return levels, total


def lowest_cut(a: Column, first: Column, last: Column) -> Column:
    """struct<score, k, l, r> of the lowest-scoring cut, of equal ones the first: floor(SCALE a^2 / (l r)) in decimals."""
    whole = lambda x, digits=16: x.cast(f"decimal({digits},0)")
    top = whole(a) * whole(a) * F.lit(SCALE).cast("decimal(7,0)")

    def cut(l, i):
        r = F.get(last, F.size(last) - 1 - i)
        score = F.call_function("div", top, whole(l, 19) * whole(r, 19))
        return F.struct(score.alias("score"), (i + 1).alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(first, cut))


def _first(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` rows, ranked.

    Only rows that reach the score of the language's row of that rank are sorted; it is read off the number of rows of
    each score, of which there are SCALE + 1 at most.
    """
    higher = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = rows.groupBy("lang", "score").agg(F.count("*").alias("c"))
    scores = scores.withColumn("above", F.coalesce(F.sum("c").over(higher), F.lit(0))).where(F.col("above") < top)
    rows = rows.join(scores.groupBy("lang").agg(F.min("score").alias("least")), "lang").where("score >= least")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def mine(
    docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, lang: str = "lang", text: str = "text",
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    Words are ``[^\\x20\\x09]+``, A-Z lower-cased, within pieces between ``[.,;:!?\\x0A-\\x0D]``. a counts all occurrences, n the
    language's words; l and r are the counts of the two parts of the cut that scores lowest. Phrases that occur less
    than ``least`` times aren't candidates, and neither are those that lie in a longer phrase with ``inside`` percent of
    their occurrences or more. By falling score, falling count, phrase.

    NULL texts are empty, NULL languages are ``und``; a language without phrases has no rows, and an empty table none at
    all. Repeated rows count as often as they occur; other columns of docs, of any name, play no part. Texts of any
    length: a task cuts them between pieces, so it holds the longest text, and its longest piece in words.
    """
    docs = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("text"))
    levels, total = phrases(docs, longest, least, chunk_words)
    scored = []
    for k, level in enumerate(levels[1:], 1):
        if k + 1 < len(levels):
            longer = levels[k + 1]
            halves = longer.select(F.col("left_id").alias("id"), F.col("f").alias("c")).unionByName(longer.select(F.col("right_id").alias("id"), F.col("f").alias("c")))
            level = level.join(halves.groupBy("id").agg(F.max("c").alias("c")), "id", "left")
            level = level.where(F.col("c").isNull() | (100 * F.col("c") < inside * F.col("f"))).drop("c")
        best = lowest_cut(F.col("f"), F.col("first_f"), F.col("last_f"))
        scored.append(level.select("lang", "phrase", F.col("f").alias("a"), best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score"))
    if not scored:
        raise ValueError("phrases have two words or more")
    ranked = _first(materialise(reduce(DataFrame.unionByName, scored), "scored"), top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\n-\r]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
o AS (SELECT p, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
g AS (SELECT lang, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM o WINDOW x AS (PARTITION BY p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
h AS (SELECT lang, w1, w2, max(f) AS m FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, a.f AS l, b.f AS r FROM f2
    JOIN f1 a ON a.lang = f2.lang AND a.w1 = f2.w1 JOIN f1 b ON b.lang = f2.lang AND b.w1 = f2.w2
    LEFT JOIN h ON h.lang = f2.lang AND h.w1 = f2.w1 AND h.w2 = f2.w2 WHERE coalesce(100 * m < 50 * f2.f, true)
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, a.f, b.f FROM f3 t
    JOIN f1 a ON a.lang = t.lang AND a.w1 = t.w1 JOIN f2 b ON b.lang = t.lang AND b.w1 = t.w2 AND b.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, a.f, b.f FROM f3 t
    JOIN f2 a ON a.lang = t.lang AND a.w1 = t.w1 AND a.w2 = t.w2 JOIN f1 b ON b.lang = t.lang AND b.w1 = t.w3),
s AS (SELECT *, (1000000 * a::HUGEINT * a) // (l::HUGEINT * r) AS score FROM c),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM s) WHERE j = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= 2000
"""
