import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from paperloom.llm import fingerprint as fp


def doc(seed, words=400):
    rng = random.Random(seed)
    return " ".join(str(rng.randint(0, 5000)) for _ in range(words))


def jaccard(a, b):
    def parts(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    return len(parts(a) & parts(b)) / len(parts(a) | parts(b))


def test_estimate_is_close_and_unbiased():
    errors = []
    for seed in range(150):
        a = doc(seed).split()
        b = a[: len(a) * (seed % 10) // 10] + doc(-seed - 1).split()[len(a) * (seed % 10) // 10 :]
        a, b = " ".join(a), " ".join(b)
        errors.append(fp.likeness(fp.values(a), fp.values(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


@given(st.text(max_size=40))
def test_packing_round_trip(text):
    made = fp.values(text)
    back = fp.unpacked(fp.packed(made))
    assert (made is None and back is None) or (made == back).all()


def test_short_texts_differ():
    assert fp.likeness(fp.values("one two"), fp.values("one three")) < 0.2
    assert fp.likeness(fp.values("One two"), fp.values("one  TWO")) == 1
    assert fp.likeness(fp.values(""), fp.values(" ")) == 1 and fp.likeness(fp.values(""), fp.values("x")) == 0


@pytest.mark.parametrize("n", [1, 2, 57])
def test_edits_follow_the_ids(spark, n):
    texts = {7 * i - 20: doc(i, 5 + 9 * i) if i % 6 else (None if i % 12 else "") for i in range(n)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fp.compare_edits(frame).collect()}
    assert set(got) == set(texts)
    ids = sorted(texts)
    for i, d in enumerate(ids):
        mine, other = texts[d] or "", texts[ids[(i + 1) % n]] or ""
        k = len(mine) // 4
        changed = mine[: len(mine) - k] + other[:k]
        r = got[d]
        assert (r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest()) == (len(mine), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fp.packed(fp.values(mine)) and r.edited_fingerprint == fp.packed(fp.values(changed))
        assert r.near_next == fp.likeness(fp.values(mine), fp.values(other))


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(None, "x")], "doc_id long, text string")
    assert fp.compare_edits(frame).count() == 4
    assert fp.compare_edits(frame.limit(0)).count() == 0
    assert [r.fingerprint for r in fp.fingerprints(frame.selectExpr("text", "1 fingerprint")).collect()].count("") == 0
