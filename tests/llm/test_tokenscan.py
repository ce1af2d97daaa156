import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm import tokenscan

PATH = public_tokenizers.path("word_bpe_49k.json")


def lengths(stream, end):
    out, start = [], 0
    for i, x in enumerate(stream):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(stream) - start, False)] if start < len(stream) else [])


@pytest.mark.parametrize("width", [2, 4])
def test_stream_across_files_and_blocks(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(tokenscan, "BLOCK_TOKENS", 64)
    rng = random.Random(width)
    stream = []
    for f in range(9):
        ids = [rng.choice([7] + [rng.randint(0, 60_000)] * (4 if f % 3 else 4000)) for _ in range(rng.choice([0, 1, 63, 64, 65, 900]))]
        np.array(ids, f"<u{width}").tofile(f"{tmp_path}/part-{f}")
        stream += ids
    got = [tuple(r) for r in tokenscan.scan(spark, str(tmp_path), 7, width).orderBy("doc_no").collect()]
    assert got == lengths(stream, 7)


def test_written_documents(spark, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [None, "", "one", "The harbour,\nthe hill. " * 2000, "one", "ünï <|endoftext|>"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    tokenscan.write_token_files(docs, PATH, 49407, f"{tmp_path}/flat")
    rows = tokenscan.scan(spark, f"{tmp_path}/flat", 49407).collect()
    tokenizer.encode_special_tokens = True
    wanted = Counter(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert Counter(r.n_tokens for r in rows) == wanted and all(r.terminated for r in rows)
    tokenscan.write_token_files(docs.limit(0), PATH, 49407, f"{tmp_path}/none")
    assert tokenscan.scan(spark, f"{tmp_path}/none", 49407).count() == 0
