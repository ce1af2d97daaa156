"""The corpus pipeline: documents to packed sequences, in four stages.

1. language: documents without a language (no letter in the text) go. Short and noisy ones stay: a
   close decision between languages says nothing against a document.
2. lines: lines that repeat an earlier line go; documents left without any line go.
3. near_duplicates: of each group of near-duplicate documents (five-word shingles, 0.8) the one
   with the smallest doc_id stays.
4. packing: the documents' ids are packed into sequences; one row a piece.

Stages 1 to 3 return the columns of documents, whatever their names, with their own values. Each works on all that
the one before has kept. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import langid, linededup, minhash, packing
from paperloom.llm.common import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language can be told; NULL texts and those without a letter go. Repeated rows stay."""
    labelled = langid.sample(docs)
    if not labelled:  # nothing to learn a language from says nothing against a document
        return langid.with_letters(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes with the prediction's
    found = langid.identify(docs.toDF(*names), labelled, names[docs.columns.index("text")])
    return found.where(F.col("lang_pred") != langid.UNDEFINED).select(*names).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with what is left of their texts, n_chars counted anew. NULL doc_ids stay; rows that repeat one with its text stay alike."""
    return linededup.drop_similar_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the documents that stay: a doc_id's rows stay or go together, NULL doc_ids stay."""
    return minhash.deduplicate(docs, 5, 80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, of every row that is left."""
    return packing.piece_digests(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None
