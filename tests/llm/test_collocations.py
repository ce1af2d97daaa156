import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import collocations as co

ASCII = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    return [w for p in re.split("[.,;:!?\n-\r]", text.translate(ASCII)) if (w := re.findall("[^ \t]+", p))]


def brute(rows, longest=3, least=10, inside=50, top=2000):
    out = set()
    for lang in {r[0] or "und" if r[0] is None else r[0] for r in rows}:
        f = Counter()
        for l, text in rows:
            if ("und" if l is None else l) == lang:
                for w in pieces(text or ""):
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(c for x, c in f.items() if len(x) == 1)
        cands = {x: c for x, c in f.items() if len(x) > 1 and c >= least}
        found = []
        for x, a in cands.items():
            within = lambda y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))  # noqa: E731, B023
            if any(len(y) > len(x) and 100 * c >= inside * a and within(y) for y, c in cands.items()):
                continue
            score, k = min((10**6 * a * a // (f[x[:k]] * f[x[k:]]), k) for k in range(1, len(x)))
            found.append((-score, -a, " ".join(x).encode(), f[x[:k]], f[x[k:]]))
        for rank, (s, a, x, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, x.decode(), -a, l, r, n, -s))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def fixture(n=120, seed=1):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "é", "É", "日本", "x1", "don't", "a", "b\x0cC", "\x1c", *"cdefgh"]
    p = 1 / np.arange(1, len(words) + 1)
    rows = []
    for _ in range(n):
        w = rng.choice(words, rng.integers(0, 60), p=p / p.sum())
        glue = rng.choice([" ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", ":!", " ; "], len(w), p=[0.4, 0.2, 0.1, *[0.3 / 7] * 7])
        rows.append((["en", "en", "de", None, ""][rng.integers(5)], "".join(x for y in zip(w, glue) for x in y)))
    return rows + rows[:30] + [("en", None), (None, None), ("xx", ""), ("yy", " .,\n"), ("zz", "one two three")]


@pytest.mark.parametrize("longest,least,inside,top,chunk", [(3, 10, 50, 2000, co.CHUNK_WORDS), (4, 3, 50, 7, 100), (5, 2, 80, 50, 1), (2, 5, 50, 3, 500)])
def test_equals_brute_force(spark, longest, least, inside, top, chunk):
    rows = fixture()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert rows_of(co.mine(docs, longest, least, inside, top, chunk_words=chunk)) == brute(rows, longest, least, inside, top)


def test_ties_clashing_columns_and_own_names(spark):
    rows = [("en", "b a. d c. f e. a b")] * 10 + [("en", "z " * 30)]
    docs = spark.createDataFrame(rows, "l string, t string")
    for c in ("lang", "text", "word", "id", "f", "n", "kind", "chunk", "local", "data", "rank", "phrase", "a", "r", "score", "level", "range"):
        docs = docs.withColumn(c, F.lit(1))
    assert rows_of(co.mine(docs, lang="l", text="t")) == brute(rows)


def test_long_texts_are_cut_between_pieces_only(spark):
    whole = "alpha beta gamma " * 100_000  # one piece
    parts = "alpha beta, gamma delta; " * 120_000
    rows = [("en", whole), ("en", parts), ("en", "w" * 3_000_000 + " v. " + "w" * 3_000_000 + " v")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(co.mine(docs, least=2)) == brute(rows, least=2)


def test_empty_table(spark):
    assert co.mine(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_products_beyond_64_bits_are_exact(spark):
    rows = [(3 * 10**12, [10**13, 4 * 10**12], [5 * 10**12, 3 * 10**13]), (1, [1], [1])]
    df = spark.createDataFrame(rows, "a long, first array<long>, last array<long>")
    got = [tuple(r.b) for r in df.select(co.lowest_cut(F.col("a"), F.col("first"), F.col("last")).alias("b")).collect()]
    want = []
    for a, first, last in rows:
        cuts = [(10**6 * a * a // (x * last[len(last) - 1 - i]), i + 1, x, last[len(last) - 1 - i]) for i, x in enumerate(first)]
        want.append(min(cuts))
    assert got == want


@given(st.text(alphabet="aB .\n,", max_size=60), st.integers(1, 10))
@settings(max_examples=200, deadline=None)
def test_blocks_keep_pieces_whole(text, size):
    raw = text.encode()
    held, co.TEXT_BLOCK = co.TEXT_BLOCK, size
    try:
        blocks = list(co.blocks_of(raw))
    finally:
        co.TEXT_BLOCK = held
    assert b"".join(blocks) == raw
    assert [w for b in blocks for w in pieces(b.decode())] == pieces(text)
