import random

import numpy as np

from paperloom.llm import minhash
from paperloom.llm.common import components


def brute(texts, size, percent):
    def parts(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = {d: parts(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(seed, n):
    """Unrelated texts, exact copies, chains of edits and a large family around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    new = lambda k: rng.choices(vocabulary, k=k)
    texts = [new(rng.randint(1, 200)) for _ in range(n)]
    base = new(120)
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(t)
    chain = new(100)
    for i in range(n // 3):
        chain = list(chain)
        chain[(7 * i) % 100] = rng.choice(vocabulary)
        texts.append(chain)
    texts += [list(rng.choice(texts)) for _ in range(n)]
    rng.shuffle(texts)
    out = {3 * i - 50: " ".join(t) for i, t in enumerate(texts)}
    return out | {10_000: None, 10_001: "", 10_002: " \n ", 10_003: "One", 10_004: "one", 10_005: "ONE two"}


def test_components_against_brute_force(spark):
    for seed, size, percent in ((1, 2, 80), (2, 5, 80)):
        texts = corpus(seed, 120)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, size, percent).collect()}
        assert got == brute(texts, size, percent)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    texts = corpus(5, 90)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(texts, 2, 80)


def test_signatures_estimate_jaccard_with_less_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 150, dtype=np.uint64)
        a, b = np.unique(pool[:100]), np.unique(pool[50:])
        made = minhash.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        errors.append((made[0] == made[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 1.1 * np.sqrt(1 / 3 * 2 / 3 / minhash.SLOTS)


def test_repeated_ids_empty_table_and_extra_columns(spark):
    rows = [(1, "a b c d", 0), (1, "e f g h", 0), (2, "e f g h", 0), (3, "x y", 0), (None, "x y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, None)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.deduplicate(docs, 2).columns == docs.columns


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 80)] + [(9, 9)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {500 + i: 500 for i in range(80)}
