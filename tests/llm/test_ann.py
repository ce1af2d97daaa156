import math

import numpy as np
import pytest

from paperloom.llm import ann, catalog


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    flat = np.array([v for _, v in rows], float)
    out = {}
    for q, v in queries:
        away = np.sqrt(((flat - np.array(v, float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, away)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(away[i])) for i in order]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 900)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 64))
    rows = [(i, (centres[i % 10] + rng.normal(size=64) * 0.7).astype(np.float32).tolist()) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    true = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert set(got) == set(true) and all([x[0] for x in sorted(g)] == list(range(1, 11)) for g in got.values())
    assert np.mean([len({x[1] for x in got[q]} & {x for x, _ in true[q]}) / 10 for q in true]) > 0.93
    flat = dict(rows)
    for q, found in got.items():
        for _, other, score in found:
            assert math.isclose(score, math.dist(flat[q], flat[other]), rel_tol=1e-9)


def test_every_code_within_the_radius_is_retrieved(monkeypatch):
    monkeypatch.setattr(ann, "LEAST", 1)
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(700, 64))
    codes = ann.Codes(rows)
    block = ann.Block(np.arange(700), rows, codes.code(rows), 0.125)
    for i in range(20):
        ids, _ = block.search(-1, rows[i], codes.code(rows[i : i + 1])[0], 700)
        apart = ann._COUNT[block.codes ^ block.codes[i]].sum(axis=1)
        radius = apart[ids].max()
        assert set(ids) == set(np.flatnonzero(apart <= radius)) and len(ids) >= 700 * 0.125


def test_ties_odd_vectors_and_few_rows(spark):
    one = [1.0, 2.0, 0.0]
    rows = [(0, one), (7, one), (3, one), (5, [1.0, 2.0, 1.0]), (8, [0.0] * 3), (9, None), (10, [1.0, None, 2.0]), (11, [float("nan"), 1.0, 1.0]), (12, [float("inf"), 1.0, 1.0]), (None, one), (100, one), (100, one)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(frame, frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.0), (0, 2, 7, 0.0), (0, 3, 100, 0.0), (0, 4, 5, 1.0), (100, 1, 0, 0.0), (100, 2, 3, 0.0), (100, 3, 7, 0.0), (100, 4, 5, 1.0)]
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0
    assert ann.search(frame, frame.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = {}
    for r in catalog.op8_nearest(spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    true = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert set(found) == set(true) and all(len(x) == 10 for x in found.values())
    assert np.mean([len(found[q] & {x for x, _ in true[q]}) / 10 for q in true]) >= 0.9


def test_exact_search_and_other_dimensions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64 if i % 10 else 5).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 15 = 0"), recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for size in (64, 5):
        mine = [r for r in rows if len(r[1]) == size]
        for q, true in brute(mine, [r for r in mine if r[0] % 15 == 0], 10).items():
            assert got[q] == [i for i, _ in true]
