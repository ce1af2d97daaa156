import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import repeats as rp


def brute(rows, length):
    """By document of (doc_id, text): n_bytes, n_removed, n_spans and what is left."""
    digest = lambda raw: int(np.uint64(xxhash.xxh64_intdigest(raw, 42)).view(np.int64))
    docs = {}
    for doc, text in rows:
        raw = (text or "").encode()
        docs[rp.LAST if doc is None else doc, digest(raw), raw] = doc
    seen, out = set(), {}
    for (key, _, raw), doc in sorted(docs.items(), key=lambda x: x[0][:2]):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(raw[i : i + length])
        starts = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[doc, raw] = (len(raw), int(gone.sum()), starts, bytes(b for b, g in zip(raw, gone) if not g))
    return sorted(((doc, *out[doc, (text or "").encode()]) for doc, text in rows), key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans")) + (bytes(r.kept),) for r in df.collect()), key=str)


def texts(n, seed, words=30):
    rng = random.Random(seed)
    lexicon = ["ab", "abab", "ä日", "\0", "zz ", "nope", "aaa", *(f"w{rng.randint(0, 99)}" for _ in range(6))]
    made = [" ".join(rng.choice(lexicon) for _ in range(rng.randint(0, words))) for _ in range(n)]
    for _ in range(n // 2):  # passages of other texts
        a, b = rng.randrange(n), rng.choice(made)
        i, j = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
        at = rng.randint(0, len(made[a]))
        made[a] = made[a][:at] + b[i:j] + made[a][at:]
    return made


@pytest.mark.parametrize("length,words", [(1, 5), (7, 30), (25, 60), (100, 200)])
def test_equals_brute_force(spark, length, words):
    rows = list(enumerate(texts(60, length, words)))
    random.Random(1).shuffle(rows)
    rows += [(100, None), (101, ""), (102, "a" * 700), (103, "ab" * 300), (-5, rows[0][1])]
    rows += [(7, rows[3][1] + "tail"), (7, "another " + rows[3][1]), (None, rows[4][1]), (None, rows[5][1])]  # ids not unique
    rows += rows[:5] + [(102, "a" * 700)]  # repeated rows are one document
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(rp.cut_repeats(docs, length)) == brute(rows, length)


def test_copies_clashing_columns_and_own_names(spark):
    hot = "".join(random.Random(0).choice("abcdefgh ") for _ in range(900))
    rows = [(i, hot) for i in range(60)] + [(i, f"{i} {hot[100:400]} {i * i}") for i in range(60, 90)]
    docs = spark.createDataFrame(rows, "k long, t string").repartition(6)
    for c in ("doc_id", "text", "digest", "own", "found", "range", "chunk", "data", "places", "base", "start", "gram", "kind", "spans", "kept"):
        docs = docs.withColumn(c, F.lit(1))
    assert found(rp.cut_repeats(docs, key="k", text="t")) == brute(rows, 100)


def test_very_long_text(spark):
    rng = random.Random(3)
    part = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_100_000))
    rows = [(1, long[:900_050] + part + long[900_050:]), (2, part[5:2_000] + "é" + part[2_000:]), (3, " " * 200_000)]
    got = {r.doc_id: r for r in rp.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, bytes(got[2].kept)) == (0, 2_995, "é".encode())
    assert got[3].spans == [(1, 200_000)]


def test_empty_table_and_short_texts(spark):
    assert rp.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "short"), (2, "short"), (3, None)]
    assert found(rp.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 100)
    with pytest.raises(ValueError):
        rp.repeated_spans(spark.createDataFrame([], "doc_id long, digest long, text binary"), 0)


low = st.text(alphabet="ab", max_size=40).map(str.encode)


@given(st.lists(low, min_size=1, max_size=6), st.integers(1, 12), st.data())
@settings(max_examples=300, deadline=None)
def test_anchors_part_all_windows_by_their_bytes(strings, length, data):
    k = data.draw(st.integers(1, length))
    held, rp.BLOCK = rp.BLOCK, data.draw(st.integers(1, 50))
    try:
        sizes = np.array([len(x) for x in strings])
        made = rp.anchors(np.frombuffer(b"".join(strings), np.uint8), sizes, length, k)
    finally:
        rp.BLOCK = held
    windows = []
    for of, place, left, right, gram in zip(*(x.tolist() for x in made)):
        windows += [(of, i, place - i, gram) for i in range(place - left, place - right + 1)]
    assert sorted(w[:2] for w in windows) == [(s, i) for s, x in enumerate(strings) for i in range(len(x) - length + 1)]
    by_bytes = {}
    for of, i, within, gram in windows:
        assert by_bytes.setdefault(strings[of][i : i + length], (within, gram)) == (within, gram)


@given(st.lists(st.lists(low, max_size=8).map(lambda x: sorted(set(x))), min_size=1, max_size=7))
@settings(max_examples=300, deadline=None)
def test_merge_is_sorted_and_knows_shared_prefixes(runs):
    order, prefix = rp.merge([(r, rp.shared(r).tolist()) for r in runs])
    at, out = [0] * len(runs), []
    for i in order:
        out.append(runs[i][at[i]])
        at[i] += 1
    assert out == sorted(x for r in runs for x in r)
    for a, b, n in zip(out, out[1:], prefix[1:]):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_spans_are_the_union(pairs):
    start, stop = np.array([p[0] for p in pairs], np.int64), np.array([sum(p) for p in pairs], np.int64)
    a, b = rp.spans(start, stop)
    assert (a[1:] > b[:-1]).all() and {x for i, j in zip(a, b) for x in range(i, j)} == {x for i, j in zip(start, stop) for x in range(i, j)}


@given(st.binary(max_size=40), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_equal_grams_have_equal_hashes(raw, k):
    hashes = rp.gram_hashes(np.frombuffer(raw, np.uint8), k).tolist()
    grams = [raw[i : i + k] for i in range(len(raw) - k + 1)]
    assert len(hashes) == len(grams) and len(set(zip(hashes, grams))) == len(set(grams)) == len(set(hashes))


def test_query_is_right_on_the_given_table(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in entry.queries()["op12_suffix_dedup"](spark, folder).collect())
    assert got == sorted((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(rows, 100))


def test_contexts_of_many_rows_are_found_and_handed_on_together():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, int(n)).astype(np.uint8).tobytes() for n in rng.integers(100, 180, 1500)]
    n = len(texts)
    columns = [pa.array(np.arange(n)), pa.array(np.arange(n) + 7), pa.array(np.arange(n) * 3), pa.array(texts), pa.nulls(n, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "base", "text", "places"])
    made = list(rp._strings(iter([batch]), 100, 78))
    assert len(made) < 10
    got = [(*docs[o].tolist(), s, raw[a:b]) for docs, of, start, raw, first, stop in made for o, s, a, b in zip(of, start, first, stop)]
    want = []
    for i, x in enumerate(texts):
        _, place, left, right, _ = rp.anchors(np.frombuffer(x, np.uint8), np.array([len(x)]), 100, 78)
        want += [(i, i + 7, 3 * i + p - a, x[p - a : p - b + 100]) for p, a, b in zip(place, left, right)]
    assert got == want
