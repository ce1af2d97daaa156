import random

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import catalog, linededup


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and", "a"] * 40
    shared = [rng.choices(words, k=rng.randint(5, 60)) for _ in range(8)]
    docs = {}
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 7)):
            kind = rng.random()
            line = list(rng.choice(shared)) if kind < 0.5 else rng.choices(words, k=rng.randint(1, 40))
            if kind < 0.35:
                for _ in range(rng.randint(0, max(1, len(line) // 5))):
                    line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        docs[5 * i - 30] = "\n".join(lines)
    return docs


def brute(docs, percent=80, least=1):
    rows = []
    for d in sorted(docs):
        for i, line in enumerate((docs[d] or "").split("\n")):
            tokens = set(line.lower().split())
            if len(tokens) >= least:
                rows.append(((d, i), tokens))
    gone = set()
    for j, (at, b) in enumerate(rows):
        if any(100 * len(a & b) >= percent * len(a | b) for _, a in rows[:j]):
            gone.add(at)
    return gone, {at: t for at, t in rows}


@pytest.mark.parametrize(("seed", "block", "common"), [(1, 2048, 2000), (2, 4, 3)])
def test_removed_lines_against_brute_force(spark, monkeypatch, seed, block, common):
    monkeypatch.setattr(linededup, "BLOCK", block)
    monkeypatch.setattr(linededup, "COMMON", common)
    docs = corpus(seed, 120)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    rows = linededup.line_links(frame).where("first_doc_id is not null").collect()
    gone, sets = brute(docs)
    assert sorted((r.doc_id, r.line) for r in rows) == sorted(gone)
    for r in rows:
        a, b = sets[r.doc_id, r.line], sets[r.first_doc_id, r.first_line]
        assert 100 * len(a & b) >= 80 * len(a | b) and (r.first_doc_id, r.first_line) < (r.doc_id, r.line)


def test_texts_without_their_lines(spark):
    rows = [
        (1, "one two three four five six\nyes\nalpha beta gamma delta epsilon", 1, "x"),
        (2, "yes\nOne two three four five six\nlast", 2, None),
        (3, "alpha beta gamma delta epsilon", 3, None),
        (4, None, None, None),
        (5, "", 0, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, line string")
    out = linededup.drop_similar_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (rows[0][1], 1), 2: ("last", 4), 4: (None, None), 5: ("", 0)}
    assert linededup.line_links(docs.limit(0)).count() == 0 and linededup.drop_similar_lines(docs.limit(0)).count() == 0


def test_repeated_rows_and_shared_ids(spark):
    rows = [(1, "a b c d e f")] * 2 + [(None, "a b c d e f"), (2, "f e d c b a"), (3, "x\ny z"), (3, "x\nother")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = linededup.line_links(docs).where("first_doc_id is not null").collect()
    assert sorted((r.doc_id, r.line, r.first_doc_id) for r in found) == [(2, 0, 1), (3, 0, 3)]
    left = sorted((r.doc_id, r.text) for r in linededup.drop_similar_lines(docs).where("doc_id is not null").collect())
    assert left[:2] == rows[:2] and [x.split("\n")[-1] for _, x in left[2:]] == ["other", "y z"] and min(len(x) for _, x in left[2:]) < 6


def test_very_long_texts(spark):
    rng = random.Random(9)
    long_line = " ".join(f"t{rng.randrange(10**6)}" for _ in range(60_000))
    many = "\n".join(f"line {i} of {i * i} and {i + 7}" for i in range(9000))
    word = "z" * 300_000
    docs = spark.createDataFrame([(1, long_line), (2, many), (3, word + "\nline 8999 of 80982001 and 9006"), (4, long_line.replace("t77", "u77")), (5, word)], "doc_id long, text string")
    rows = linededup.line_links(docs).where("first_doc_id is not null").collect()
    assert {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in rows} == {(3, 1): (2, 8999), (4, 0): (1, 0), (5, 0): (3, 0)}


def short_lines(seed, n):
    rng = random.Random(seed)
    return {i: "\n".join(" ".join(rng.choices("abcdefg", k=rng.randint(0, 7))) for _ in range(rng.randint(1, 3))) for i in range(n)}


def test_short_lines_against_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(linededup, "REMEMBERED", 4)
    docs = corpus(3, 60) | {1000 + i: t for i, t in short_lines(4, 40).items()}
    docs |= {2000: "All rights reserved.", 2001: "no  RIGHTS\nall rights RESERVED.", 2002: "日本語の文\n \n", 2003: "日本語の文", 2004: "v w x y", 2005: "z y x w v", 2006: "v v v", 2007: "v"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    gone, _ = brute(docs)
    assert {(2001, 1), (2003, 0), (2005, 0), (2007, 0)} <= gone
    rows = linededup.line_links(frame).where('first_doc_id is not null').collect()
    assert sorted((r.doc_id, r.line) for r in rows) == sorted(gone)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.op7_line_dedup(spark, str(tmp_path)).where("first_doc_id is not null").collect()
    assert sorted((r.doc_id, r.line) for r in made) == sorted(gone)
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, "").collect()}
    assert 2003 not in left and 2007 not in left and left[2001] == "no  RIGHTS"


@pytest.mark.parametrize(("percent", "common"), [(80, 5), (80, 2000), (40, 5)])
def test_all_links_against_brute_force(spark, monkeypatch, tmp_path, percent, common):
    monkeypatch.setattr(linededup, "COMMON", common)
    monkeypatch.setattr(linededup, "PAIRS", 20)
    monkeypatch.setattr(linededup, "TOGETHER", 30)
    if common == 5:
        monkeypatch.setattr(linededup, "FEW", 3)
        monkeypatch.setattr(linededup, "STRIPE", 2)
        monkeypatch.setattr(linededup, "BLOCK", 4)
    docs = corpus(5, 60) | {1000 + i: t for i, t in short_lines(6, 40).items()}
    sets = {at: frozenset(t) for at, t in brute(docs)[1].items()}
    first = {}
    for at in sorted(sets):
        first.setdefault(sets[at], at)
    want = []
    for at, mine in sets.items():
        others = [first[s] for s in first if s != mine and 100 * len(s & mine) >= percent * len(s | mine)]
        witness = first[mine] if first[mine] < at else min((w for w in others if w < at), default=(None, None))
        want.append((*at, *witness, *first[mine], len(others)))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert max(w[-1] for w in want) > 3
    assert sorted(map(tuple, linededup.line_links(frame, percent).drop("digest").collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    if percent == linededup.PERCENT:
        frame.write.parquet(f"{tmp_path}/documents.parquet")
        assert sorted(map(tuple, catalog.op7_line_dedup(spark, str(tmp_path)).collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize(("few", "stripe", "pairs", "cost"), [(48, 512, 10**6, 800), (2, 3, 5, 0), (0, 1, 1, 10**9), (0, 7, 9, 1)])
def test_counted_links_of_cells(monkeypatch, few, stripe, pairs, cost):
    for name, value in (("FEW", few), ("STRIPE", stripe), ("PAIRS", pairs), ("PAIR_COST", cost), ("COLUMNS", 17)):
        monkeypatch.setattr(linededup, name, value)
    rng = np.random.default_rng(3)
    cells = [(int(c), int(h)) for c, size in enumerate((1, 7, 60, 2, 30)) for h in (rng.integers(0, 2, size) if c in (2, 4) else [0] * size)]
    base = rng.integers(0, 2**52, 30, np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(8, 30)], rng.integers(0, 2**52, rng.integers(0, 4), np.uint64)])) for _ in cells]
    cell, half = (np.array(x) for x in zip(*cells))
    order = rng.permutation(len(cells))
    made = linededup.Sets(np.concatenate(sets), np.array([len(s) for s in sets]))
    links, best = linededup.count_links(made, cell, half, order, 80)
    for i, mine in enumerate(sets):
        other = [
            j for j, s in enumerate(sets)
            if j != i and cell[j] == cell[i] and (cell[i] not in (2, 4) or half[j] != half[i])
            and 100 * len(np.intersect1d(s, mine)) >= 80 * len(np.union1d(s, mine))
        ]
        assert links[i] == len(other) and best[i] == min((order[j] for j in other), default=np.iinfo(np.int64).max)
    assert links.max() > 3


def test_pairs_are_filtered_and_looked_up_a_bounded_number_at_once():
    import tracemalloc

    sets = linededup.Sets(np.arange(40_000, dtype=np.uint64), np.full(2_000, 20))
    i, j = np.divmod(np.arange(600_000), 2_000)
    tracemalloc.start()
    same = sets.similar(i[:200_000], j[:200_000], 80)
    looked_up = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    fits = linededup._fitting(sets.rows, i, j, 80, None)
    filtered = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (same == (i == j)[:200_000]).all()
    kept = np.zeros(len(i), bool)
    kept[fits[0] * 2_000 + fits[1]] = True
    assert (kept == linededup._can_reach(*(linededup._take(sets.rows, x) for x in (i, j)), 80)).all()
    assert looked_up < 60e6 and filtered < 50e6, (looked_up, filtered)
