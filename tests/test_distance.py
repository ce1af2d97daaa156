import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import distance as D
from paperloom.functions import scalars as S


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def chain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


word = st.lists(st.sampled_from("abc"), max_size=90)


@given(word, word)
@settings(max_examples=400, deadline=None)
def test_distance_and_chain_equal_the_plain_program(a, b):
    assert D.distance(a, b) == plain(a, b)
    at = D._places(a)
    assert D.aligned([at.get(x, 0) for x in b], len(a)) == chain(a, b)


def test_known_distances():
    assert (D.distance("kitten", "sitting"), D.distance("cat", "cats"), D.distance("", "abc"), D.distance("x", "x")) == (3, 1, 3, 0)
    many = [f"w{i}" for i in range(6_000)]
    assert D.distance(many, many[:100] + ["new"] + many[102:] + ["tail"]) == 3


def edits(rng, words):
    out = []
    for w in words:
        out += rng.choice([[w]] * 12 + [[], ["§"], [w, "+"]])
    return out


def test_columns_of_any_length(spark):
    rng = random.Random(3)
    rows = [(None, None), ("", "one two"), ("a b", None), (" same \n text ", "same text"), ("日本 x", "日本"), ("\tx", "")]
    for n in (3, 20, 200, 800):
        words = [f"w{rng.randint(0, n)}" for _ in range(n)]
        rows.append((" ".join(words), "  ".join(edits(rng, words)) + " "))
    df = spark.createDataFrame(rows, "a string, b string")
    for cells in (0, 64, 1 << 30):
        got = df.select(D.cer("a", "b", cells).alias("c"), D.wer("a", "b", cells).alias("w"), S.cer("a", "b").alias("c0"), S.wer("a", "b").alias("w0")).collect()
        for (a, b), r in zip(rows, got):
            assert (r.c, r.w) == (pytest.approx(r.c0), pytest.approx(r.w0))
            x, y = (a or "").split(), (b or "").split()
            if len(x) < 500:
                assert r.w == pytest.approx(plain(x, y) / len(x) if x else len(y))


def test_very_long_text(spark):
    text = "word and " * 20_000
    df = spark.createDataFrame([(text, text[:50_000] + "§" + text[50_001:90_000] + text[90_003:])], "a string, b string")
    r = df.select(D.text_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert r.d == 4


near = st.lists(st.tuples(st.integers(0, 80), st.sampled_from(["", "x", "ab"])), max_size=8)


@given(word, near, st.integers(1, 6))
@settings(max_examples=400, deadline=None)
def test_windows_find_the_same_distances(a, changes, first):
    b = list(a)
    for at, new in changes:
        b[at : at + 1] = new
    kept, D.FIRST = D.FIRST, first
    try:
        assert D.distance(a, b) == D.distance(b, a) == plain(a, b)
    finally:
        D.FIRST = kept


def test_a_close_copy_needs_no_whole_columns(monkeypatch):
    monkeypatch.setattr(D, "_whole", None)
    rng = random.Random(5)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(30_000))
    copy = "".join("#" if i % 50 == 25 else "" if i % 97 == 60 else c for i, c in enumerate(text))
    assert D.distance(text, copy) == sum(i % 50 == 25 or i % 97 == 60 for i in range(30_000))
