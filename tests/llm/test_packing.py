import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import packing, tokens
from paperloom.llm.tokens import ChunkTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = ChunkTokenizer(PATH, "I")


@functools.cache
def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])) | st.text("aeTh ñé'\n .,1IKàçé×÷́İΣ\x1c ", max_size=60))
def test_chunks_give_the_library_ids(text):
    assert np.frombuffer(CODER.encode([text.encode()])[0], "<u4").tolist() == ids(text)


def test_program_is_near_the_lower_bound():
    rng = random.Random(1)
    demand = defaultdict(int)
    for _ in range(30_000):
        demand[min(512, max(1, int(rng.lognormvariate(4.5, 0.8))))] += 1
    plan = packing.solve(demand, 512)
    made = defaultdict(int)
    for column, n in plan:
        assert sum(u * k for u, k in column.items()) <= 512
        for u, k in column.items():
            made[u] += k * n
    assert made == demand
    least = sum(u * n for u, n in demand.items()) / 512
    assert sum(n for _, n in plan) <= least * 1.005 + 2


@pytest.mark.parametrize("demand", [{}, {5: 1}, {512: 7}, {300: 9}, {1: 100_000}, {171: 3000, 170: 1}])
def test_small_programs(demand):
    plan = packing.solve(demand, 512)
    assert sum(n * k for c, n in plan for k in c.values()) == sum(demand.values())


def check(rows, texts):
    """Every id lies in one piece, sequences are gapless and within capacity."""
    spans = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        whole = [*(ids(texts[r.doc_id]) if texts[r.doc_id] else []), 1]
        assert r.doc_tokens == len(whole)
        part = whole[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        spans[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for groups in (spans, places):
        for cut in groups.values():
            at = 0
            for start, length in sorted(cut):
                assert start == at
                at += length
    assert {d: sum(n for _, n in s) for d, s in spans.items()} == {
        d: len(ids(t)) + 1 if t else 1 for d, t in texts.items()
    }
    fills = {s: sum(n for _, n in p) for s, p in places.items()}
    assert max(fills.values()) <= packing.CAPACITY
    return fills


def test_pack_documents(spark):
    rng = random.Random(2)
    words = ["the", "thation", "Éter", "onerly,", "x" * 40]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([1, 20, 300, 700, 5000]))) for i in range(300)}
    texts |= {300: None, 301: "", 302: texts[1], 303: " \n"}
    docs = spark.createDataFrame(
        [(i, t, 1) for i, t in texts.items()], "doc_id long, text string, ids_crc32 int"
    )
    fills = check(packing.piece_digests(docs, PATH, 1).collect(), texts)
    assert sum(fills.values()) / (len(fills) * packing.CAPACITY) > 0.95
    whole = packing.pack_documents(docs, PATH, 1)
    assert all(len(r.ids) == 4 * r.length for r in whole.collect())


def test_empty_table_and_copies(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.piece_digests(docs, PATH, 1).collect() == []
    docs = spark.createDataFrame([(7, "same text")] * 50, "doc_id long, text string")
    rows = packing.piece_digests(docs, PATH, 1).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 50


def test_more_distinct_chunks_than_the_cache_holds(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    coder = ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"), "I")
    rng = random.Random(3)
    words = [f"id{i:05x}" for i in range(40)] + ["the", "of", "café", "end."]
    texts = [" ".join(rng.choices(words, k=k)) for k in (60, 1, 3, 25, 4)] + [None, "", "the of"]
    for part in (texts, texts[:1], texts[1:3], texts[::-1], ["the of", "of the end."]):
        got = coder.encode([None if t is None else t.encode() for t in part])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [coder.library.encode(t or "", add_special_tokens=False).ids for t in part]
        assert len(coder.chunks) <= 5


def test_words_of_small_letters_skip_the_normaliser():
    made = ChunkTokenizer(PATH, "I")
    library, asked = made.library, []

    class Noting:
        def encode(self, text, **kinds):
            asked.append(text)
            return library.encode(text, **kinds)

        def encode_batch_fast(self, texts, **kinds):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **kinds)

    made.library = Noting()
    text = "inering!! caf\u00e9 \u00ed\u00e0a&&& Zeta, \u00c9t\u00e9 it's x'll o'### 12%% \u0142a"
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(made.encode([text.encode()])[0], "<u4").tolist() == want
    assert {w for x in asked for w in x.split()} == {"!!", "&&&", ",", "it's", "x'll", "o'###", "12%%", "\u00c9t\u00e9", "\u0142a"}
