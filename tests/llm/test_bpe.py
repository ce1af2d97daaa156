import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODER = bpe.ByteBpe(PATH, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])) | st.text("aehint ñé'\n .1", max_size=80))
def test_same_ids_as_the_library_and_round_trip(text):
    made = CODER.encode(text)
    assert ids(made) == LIBRARY.encode_ordinary(text)
    assert CODER.decode(made) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 20_000, "x" * 50_000, "the" * 9_999, "   " * 5_000])
def test_long_pre_tokens(text):
    assert ids(CODER.encode(text)) == LIBRARY.encode_ordinary(text)


def test_frame_with_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "Hello, wörld <|endoftext|>", "c"), (3, "Hello, wörld <|endoftext|>", None)],
        "doc_id long, text string, ids string",
    )
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    rows = out.orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in rows] == ["", "", *["Hello, wörld <|endoftext|>"] * 2]
    assert [len(r.ids) for r in rows[:2]] == [0, 0]
    assert bpe.encode(docs.where(F.lit(False)), PATH, public_tokenizers.PATTERN).count() == 0
