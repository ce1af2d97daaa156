import math
import random
import zlib
from collections import Counter

import numpy as np

import pytest
from pyspark.sql import functions as F

from paperloom.llm import suffixtree as st
from tests.llm import test_langid


def corpus(n):
    texts = {i: test_langid.prose("aa", 5 + i % 40, i) for i in range(n)}
    texts |= {n + i: texts[i] + "  EXTRA\twords" for i in range(20)}
    return texts | {1000: None, 1001: "", 1002: "x" * 3000}


def test_base_score_against_the_formula(spark, monkeypatch):
    monkeypatch.setattr(st, "CHUNK_BYTES", 900)
    texts = corpus(150)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in texts.items()], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in st.score_documents(docs.repartition(3)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(texts) and any(held.values())
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def plain_model(texts):
    """{context: Counter of next bytes} of all contexts, and the set of states, by the definition."""
    after = {}
    for t in texts:
        padded = b"\n" * st.DEPTH + t
        for i in range(st.DEPTH, len(padded)):
            for d in range(st.DEPTH + 1):
                after.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    states = {c for c in after if len(c) <= st.LOW}
    for c, out in after.items():
        if len(c) > st.LOW and sum(out.values()) >= st.MIN_COUNT:
            n, parent = sum(out.values()), after[c[1:]]
            m = sum(parent.values())
            gain = sum(x * math.log((x / n) / (parent[b] / m)) for b, x in out.items())
            if gain >= st.MIN_GAIN * len(out):
                states |= {c[i:] for i in range(len(c) + 1)}
    return after, states


def plain_chance(after, states, context, byte):
    out = after.get(b"", Counter())
    p = (out[byte] + 0.5) / (sum(out.values()) + 128)
    for d in range(1, st.DEPTH + 1):
        c = context[len(context) - d :]
        if c in states:
            out = after[c]
            k = st.SMOOTHING * len(out)
            p = (out[byte] + k * p) / (sum(out.values()) + k)
    return p


def test_states_and_chances_against_the_definition():
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abc\xc3", k=rng.randint(1, 9))) for _ in range(25)]
    texts = [st.canonical(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)]
    keys, n = np.unique(st.grams(texts), return_counts=True)
    tree = st.levels(keys, n, st.DEPTH, 0)
    st.retain(tree)
    after, states = plain_model(texts)
    mine = {int(c).to_bytes(d, "big") for d, level in tree.items() for c in level.context[level.state].tolist()}
    assert mine == states and 20 < sum(len(c) > st.LOW for c in states) < len(after)
    asked = np.unique(np.concatenate([keys, st.grams([b"abz\xff cab abc\n", texts[0][::-1]])]))
    for key, got in zip(asked.tolist(), st.chances(asked, tree).tolist()):
        raw = key.to_bytes(st.DEPTH + 1, "big")
        assert math.isclose(got, math.log10(plain_chance(after, states, raw[:-1], raw[-1])), rel_tol=1e-9, abs_tol=1e-12)
    for context in (b"\n" * st.DEPTH, b"abcabcabc"[: st.DEPTH], b"z" * st.DEPTH):
        every = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert math.isclose((10.0 ** st.chances(every, tree)).sum(), 1, rel_tol=1e-9)


def test_scores_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(st, "CHUNK_BYTES", 900)
    monkeypatch.setattr(st, "LOW_ENTRIES", 100)
    texts = corpus(60)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in st.score_documents(docs.repartition(3)).collect()}
    plain = {i: st.canonical((t or "").encode().lower().split()) for i, t in texts.items()}
    after, states = plain_model([t for i, t in plain.items() if zlib.crc32(str(i).encode()) % 10])
    for i, t in plain.items():
        padded = b"\n" * st.DEPTH + t
        want = sum(math.log10(plain_chance(after, states, padded[j : j + st.DEPTH], padded[j + st.DEPTH])) for j in range(len(t)))
        assert math.isclose(got[i], want, rel_tol=1e-5)


def test_the_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = st.score_documents(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows.s > 0.97 * rows.b


def test_no_training_rows_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (7, "c")], "doc_id long, text string")
    rows = st.score_documents(docs).collect()
    assert len(rows) == 4 and len({(r.doc_id, r.score) for r in rows}) == 3
    assert st.score_documents(docs.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = st.score_documents(spark.createDataFrame([(held, "a")], "doc_id long, text string")).first()
    assert only.held_out and only.train_tokens == 0 and math.isclose(only.base_score, 2 * math.log10(0.1 / 0.1))


def test_smoothing_is_chosen_on_training_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    made = st.smoothing_by_fold(docs, (1, st.SMOOTHING))
    other = docs.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit("zzz")).otherwise(F.col("text")))
    assert st.smoothing_by_fold(other, (1, st.SMOOTHING)) == pytest.approx(made) and made[st.SMOOTHING] > made[1]
