import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall(text.translate(ASCII))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, mine = len(kept), sorted({r[1] for r in rows if r[0] == lang})

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(sum((counts[lang, s] for s in mine), Counter()))
        p = {s: shares(counts[lang, s]) for s in mine}
        for s in mine:
            pair = [(-sum(f(p[s][t], p[u][t]) for t in kept), u.encode()) for u in mine if u != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, i.decode(), -x, k) for k, (x, i) in enumerate(found, 1)}
    return out


def rows_of(df):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(set(got)) == len(got)
    return set(got)


def fixture(n=300, seed=0):
    rng = np.random.default_rng(seed)
    words = ["Ähre", "ähre", "The", "the", "a", "ünder", "Z", "x1y", "don't", "日本", "É", "é", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(n):
        lang = [None, "", "en", "de", "en"][rng.integers(5)]
        source = [None, "", "s1", "s2", "hot", "hot", "hot", "é"][rng.integers(8)]
        p = 1 / np.arange(1, len(words) + 1)
        text = " ,".join(rng.choice(words, rng.integers(0, 40), p=p / p.sum()))
        rows.append((lang, source, [text, None, "", text][rng.integers(4)]))
    rows += rows[:40]  # repeated rows
    rows += [("solo", "only", "alone " * 3), ("bare", "a", None), ("bare", "b", "1 2 3"), ("en", "quiet", "77")]
    return rows


@pytest.mark.parametrize("least,entries,sources", [(10, dv.CELL, dv.SOURCES), (3, 20, 2), (1, 7, 1)])
def test_equals_brute_force(spark, least, entries, sources):
    rows = fixture()
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(dv.audit(docs, least, entries=entries, sources=sources)) == brute(rows, least)


def test_clashing_columns_long_texts_and_own_names(spark):
    rows = [("en", "a", "Lorem ipsum " * 400_000), *[("en", "b", "ipsum dolor")] * 12, *[("en", "a", "x" * 3_000_000)] * 10]
    docs = spark.createDataFrame(rows, "l string, s string, t string")
    for c in ("lang", "source", "term", "count", "docs", "p", "q", "n", "v", "at", "block", "cut", "unseen", "rank", "item", "value", "part"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(c, F.lit(1))
    assert rows_of(dv.audit(docs, lang="l", source="s", text="t")) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert dv.audit(docs).collect() == []


def test_counts_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(10**12, 3 * 10**12, 5), (0, 7, 1), (10**10, 10**10, 10**6)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = [r.p for r in df.select(dv.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]


@given(st.lists(st.text(alphabet="aB é1 .Z日", max_size=12), max_size=12), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_slices_of_one_hash_part_by_their_bytes(texts, bits):
    low = "\0".join(texts).encode().lower()
    start, stop = dv.terms_of(low)
    want = TERM.findall("\0".join(texts).translate(ASCII))
    assert [low[a:b].decode() for a, b in zip(start, stop)] == want
    group, first = dv.group_slices(low, start, stop, lambda x: len(x) % bits)
    assert len(first) == len(set(want))
    assert [want[first[g]] for g in group] == want


def test_query_is_equal_to_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = rows_of(entry.queries()["op13_source_divergence"](spark, folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got == set(db.execute(entry.oracle_sql()["op13_source_divergence"]).fetchall())
