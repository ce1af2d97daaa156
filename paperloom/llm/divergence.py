"""Source divergence audit: how far apart the sources of a language lie, and by which terms.

Texts are cut in numpy: a table of 256 flags over the concatenated UTF-8 bytes gives the boundaries of all
terms at once. Terms are grouped by the xxhash of their bytes, and every byte is held against its group's
first term, so that colliding terms part. A task adds up (language, source) rows of sparse counts before
anything is exchanged. A language keeps the terms of enough documents; smoothed shares are whole numbers
of parts in 10^9, exact in decimals.

Pairs of sources meet in cells of a language's terms: a cell is a CSR matrix of sources by terms, whose
missing entries have their source's share of an unseen term. What a source differs from all others is summed
by reduceat over the entries of these, plus what only it has, plus the share of terms that neither has.
Cells are added up by Spark. Cells of many sources are cut by the first source of a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import freeing, materialise, prepare, shuffle_parts

PARTS = 1_000_000_000
#: Bytes of text that are cut at once, and distinct terms or rows that a task adds up before it hands them on.
BLOCK_BYTES = 2_000_000
HELD_TERMS = 200_000
HELD_ROWS = 1_000_000
#: Entries of a cell (or four times its pairs of sources, if these are more), and its sources that are held against all others.
CELL = 20_000
SOURCES = 256
COUNTS = "lang string, source string, term string, count long, docs long"

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of bytes begin and end: longest runs of ASCII letters and bytes from 0x80 on."""
    flag = np.zeros(len(low) + 2, np.int8)
    flag[1:-1] = _TERM[np.frombuffer(low, np.uint8)]
    step = np.diff(flag)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def group_slices(low: bytes, start: np.ndarray, stop: np.ndarray, digest=None) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal slices: each slice's group, and each group's first slice. digest: bytes to 64 bits, xxhash unless given.

    Every slice is held byte by byte against the first one of its hash; those that differ get groups by their bytes.
    """
    import xxhash

    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slices = (low[a:b] for a, b in zip(start.tolist(), stop.tolist()))
    hashes = np.fromiter(map(digest or xxhash.xxh64_intdigest, slices), np.uint64, len(start))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size = stop - start
    other = first[group]
    differ = size != size[other]
    n = np.where(differ, 0, size)
    ends = np.cumsum(n)
    step = np.arange(ends[-1]) - np.repeat(ends - n, n)
    data = np.frombuffer(low, np.uint8)
    unlike = data[np.repeat(start, n) + step] != data[np.repeat(start[other], n) + step]
    if unlike.any():
        differ[np.searchsorted(ends, np.flatnonzero(unlike), side="right")] = True
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(differ).tolist():
        name = (int(hashes[i]), low[start[i] : stop[i]])
        if name not in more:
            more[name] = len(first)
            first = np.append(first, i)
        group[i] = more[name]
    return group, first


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and each one's sums by reduceat."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *((np.add.reduceat(v[by], at) if len(at) else v[:0]) for v in values)


class Held:
    """What a task has counted and not yet handed on: (language, source), term -> occurrences, documents."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.sums = np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 2

    def add(self, rows: list[tuple[str, str, bytes]]) -> None:
        low = b"\0".join(raw for _, _, raw in rows).lower()
        start, stop = terms_of(low)
        group, first = group_slices(low, start, stop)
        names = [low[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
        term = np.fromiter((self.terms.setdefault(x, len(self.terms)) for x in names), np.int64, len(names))
        source = np.fromiter((self.groups.setdefault(x[:2], len(self.groups)) for x in rows), np.int64, len(rows))
        ends = np.cumsum([len(raw) + 1 for _, _, raw in rows])
        doc = np.searchsorted(ends, start, side="right")
        cell, n = _summed(doc << 32 | term[group], np.ones(len(start), np.int64))  # documents by terms
        keys = source[cell >> 32] << 32 | (cell & 0xFFFFFFFF)
        ones = np.ones(len(cell), np.int64)
        joined = (np.concatenate((a, b)) for a, b in zip(self.sums, (n, ones)))
        self.keys, *sums = _summed(np.concatenate((self.keys, keys)), *joined)
        self.sums = tuple(sums)

    def full(self) -> bool:
        return len(self.terms) > HELD_TERMS or len(self.keys) > HELD_ROWS

    def batches(self) -> Iterator[pa.RecordBatch]:
        groups, terms = list(self.groups), list(self.terms)
        for at in range(0, len(self.keys), 100_000):
            keys = self.keys[at : at + 100_000]
            pairs = [groups[i] for i in (keys >> 32).tolist()]
            words = pa.array([terms[i] for i in (keys & 0xFFFFFFFF).tolist()], pa.binary()).cast(pa.string())
            lang, source = (pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1))
            n, docs = (pa.array(x[at : at + 100_000]) for x in self.sums)
            yield pa.RecordBatch.from_arrays([lang, source, words, n, docs], ["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of docs (lang, source, text), none null: sums of parts of the rows, several a key."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = Held(), [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    held.add(rows)
                    rows, size = [], 0
                    if held.full():
                        yield from held.batches()
                        held = Held()
        if rows:
            held.add(rows)
        yield from held.batches()

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(freeing(run), COUNTS)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(PARTS * (count + 2) / (n + 2 v)), in decimals; NULL if there is no term."""
    whole = lambda x: x.cast("decimal(19,0)")
    two, parts = F.lit(2).cast("decimal(1,0)"), F.lit(PARTS).cast("decimal(10,0)")
    low = whole(n) + two * whole(v)
    return F.call_function("div", parts * (whole(count) + two), F.nullif(low, F.lit(0).cast("decimal(1,0)"))) + 1


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def cell_sums(indptr: np.ndarray, column: np.ndarray, p: np.ndarray, unseen: np.ndarray, width: int, mine: np.ndarray) -> np.ndarray:
    """Of each source of ``mine``: sums over ``width`` terms of how far its shares lie from every source's.

    A CSR matrix of shares; unseen: each source's share of a term that it lacks.
    """
    n = np.diff(indptr)
    some = np.flatnonzero(n)
    out = np.zeros((len(mine), len(n)), np.int64)
    per = np.repeat(unseen, n)

    def by_row(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(n), np.int64)
        if len(some):
            sums[some] = np.add.reduceat(values, indptr[some])
        return sums

    for k, s in enumerate(mine.tolist()):
        at = slice(indptr[s], indptr[s + 1])
        dense, has = np.full(width, unseen[s], np.int64), np.zeros(width, bool)
        dense[column[at]], has[column[at]] = p[at], True
        there = dense[column]
        both = has[column]
        theirs = by_row(_apart(p, there))
        shared = by_row(np.where(both, _apart(per, there), 0))
        alone = np.array([_apart(p[at], u).sum() for u in unseen.tolist()], np.int64) - shared
        neither = width - n - n[s] + by_row(both.astype(np.int64))
        out[k] = theirs + alone + neither * _apart(unseen, unseen[s])
    return out


def _cells(kept: DataFrame, groups: DataFrame, entries: int, sources: int) -> DataFrame:
    """(lang, source, item, value): sums of a language's terms for each two of its sources.

    kept (lang, source, term, p); groups (lang, source, at, unseen, v, s): each group's number in its language,
    share of an unseen term, and the language's numbers of terms and sources.
    """
    blocks = F.ceil(F.col("v") * F.col("s") / F.greatest(F.lit(entries), 4 * F.col("s") * F.col("s"))).cast("int")
    blocks = F.greatest(blocks, F.lit(1))
    cuts = F.ceil(F.col("s") / sources).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = kept.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int"))
    rows = rows.select("lang", "block", every(cuts).alias("cut"), "at", "term", "p")
    heads = groups.withColumn("block", every(blocks)).select("lang", "block", every(cuts).alias("cut"), "source", "at", "unseen")

    def cell(rows: pa.Table, heads: pa.Table) -> pa.Table:
        heads = heads.sort_by("at").combine_chunks()
        names, number = heads["source"].combine_chunks(), len(heads)
        at = rows["at"].to_numpy()
        by = np.argsort(at, kind="stable")
        codes = rows["term"].combine_chunks().dictionary_encode()
        column, p = codes.indices.to_numpy().astype(np.int64)[by], rows["p"].to_numpy()[by]
        indptr = np.searchsorted(at[by], np.arange(number + 1))
        cut = heads["cut"][0].as_py()
        mine = np.arange(cut * sources, min(number, (cut + 1) * sources))
        sums = cell_sums(indptr, column, p, heads["unseen"].to_numpy(), len(codes.dictionary), mine)
        i, j = np.repeat(mine, number), np.tile(np.arange(number), len(mine))
        other = i != j
        i, j = i[other], j[other]
        lang = pa.array([heads["lang"][0].as_py()] * len(i), pa.string())
        return pa.table({"lang": lang, "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": sums.ravel()[other]})

    key = ["lang", "block", "cut"]
    made = rows.groupBy(*key).cogroup(heads.groupBy(*key)).applyInArrow(cell, "lang string, source string, item string, value long")
    return made.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text",
    entries: int = CELL, sources: int = SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (language, source) that occurs; NULLs are empty strings.

    part ``pair``: every other source of the language by falling divergence from this one, over the terms in at least
    ``least`` of the language's documents (rows); 0 where there is none. part ``term``: the ``top`` terms
    that this source has and by more than the language, by falling divergence from the language. Ties by item.
    Repeated rows count as often as they occur, whatever their ids. Texts of any length; a task holds the longest one.
    Other columns of docs, of any name, play no part; an empty table gives no rows. entries, sources: the size of cells,
    which doesn't change the result.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = term_counts(docs).repartition(shuffle_parts(spark), "lang", "term")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"in_lang": F.sum("docs").over(term), "of_lang": F.sum("count").over(term)})
    kept = materialise(counted.where(F.col("in_lang") >= least).drop("docs", "in_lang"), "terms")

    per_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    per_lang = kept.groupBy("lang", "term").agg(F.sum("count").alias("c")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.fillna(0, ["n", "v", "lang_n"])
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns({
        "s": F.count("*").over(of_lang), "at": F.row_number().over(of_lang.orderBy("source")) - 1,
        "unseen": F.coalesce(share(F.lit(0), F.col("n"), F.col("v")), F.lit(1)).cast("long"),
    })
    groups = materialise(groups, "groups")
    shares = kept.join(groups.select("lang", "source", "n", "v", "lang_n"), ["lang", "source"])
    found = {"p": share(F.col("count"), F.col("n"), F.col("v")), "q": share(F.col("of_lang"), F.col("lang_n"), F.col("v"))}
    shares = shares.select("lang", "source", "term", *(x.alias(n) for n, x in found.items()))

    pairs = _cells(shares.drop("q"), groups.drop("n", "lang_n"), entries, sources)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    p, q = F.col("p"), F.col("q")
    terms = shares.where(p > q).select("lang", "source", F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms.withColumn("part", F.lit("term")))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(t.c), 0) AS n FROM g LEFT JOIN t ON g.lang = t.lang AND g.source = t.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(t.c, 0) AS c, (1 + (1000000000 * (coalesce(t.c, 0) + 2)::HUGEINT) // (n.n + 2 * l.v))::HUGEINT AS p,
    (1 + (1000000000 * (k.c + 2)::HUGEINT) // (l.n + 2 * l.v))::HUGEINT AS q
  FROM n JOIN k ON n.lang = k.lang JOIN l ON n.lang = l.lang LEFT JOIN t ON t.lang = n.lang AND t.source = n.source AND t.term = k.term),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT * FROM y UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z) WHERE part = 'pair' OR rank <= 10
"""
