"""The registered queries of the corpus operators, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import ann, bpe, chat, collocations, divergence, fingerprint, langid, linededup, minhash, packing, repeats, suffixtree, tokenscan
from paperloom.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document's ids into sequences of at most 2048."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.piece_digests(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 2048)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets have a Jaccard similarity of 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 2, 80)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    made = fingerprint.compare_edits(_table(spark, sf_dir, "documents"))
    return made.withColumn("edited_sha256", F.sha2(F.encode("edited_text", "UTF-8"), 256)).drop("edited_text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as flat token files and counts the tokens of each document in them."""
    flat = scratch_path(spark, "flat")
    docs = _table(spark, sf_dir, "documents")
    tokenscan.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 49407, flat)
    return tokenscan.scan(spark, flat, 49407)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language, learning from two of three folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", langid.fold(F.col("doc_id"), 3) == 1)
    labelled = langid.sample(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), labelled).drop("text")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by suffix tree and by unigrams, learnt from nine of ten folds."""
    return suffixtree.score_documents(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of documents: the earlier line that each repeats, its class and its number of similar classes."""
    return linededup.line_links(_table(spark, sf_dir, "documents")).drop("digest")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 100 = 0"), 10)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the multilingual byte-level vocabulary."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return bpe.decode(ids, path, pattern).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in the order of their replies, without quotes."""
    return chat.conversations(_table(spark, sf_dir, "conversations"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases of two and three words."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat 100 earlier ones."""
    cut = repeats.cut_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie from each other and, by which terms, from their language."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: In the order of their numbers.
OPERATORS = (
    op1_packing,
    op2_minhash,
    op3_fingerprints,
    op4_token_counts,
    op5_language_id,
    op6_lm_score,
    op7_line_dedup,
    op8_nearest,
    op9_byte_bpe,
    op10_chat_format,
    op11_collocations,
    op12_suffix_dedup,
    op13_source_divergence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash": minhash.ORACLE_SQL, "op7_line_dedup": linededup.ORACLE_SQL, "op10_chat_format": chat.ORACLE_SQL,
        "op11_collocations": collocations.ORACLE_SQL, "op12_suffix_dedup": repeats.ORACLE_SQL, "op13_source_divergence": divergence.ORACLE_SQL,
    }
