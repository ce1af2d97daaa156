"""Token counts of flat token files by a separator scan.

A flat file is nothing but ids of fixed width; documents end with a separator id, and there is no
index. Files count as one stream, in the order of their names, so a document may begin in one file
and end in another. Every block of BLOCK_TOKENS ids is searched at once in numpy. Blocks know only
their own positions: exclusive prefix scans over (file, block) of the blocks' tokens, separators
and last separators give each block where it lies and where its first document began.

Each file is read as one row, so writers keep files small: one a task here, in proportion to the
task's input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import TEXT_BATCH_ROWS, materialise, prefix_scan, prepare
from paperloom.llm.tokens import tokenizer

BLOCK_TOKENS = 1 << 20
WIDTHS = {2: ("H", "<u2"), 4: ("I", "<u4")}


def write_token_files(docs: DataFrame, path: str, end_id: int, out: str, width: int = 2, text: str = "text") -> None:
    """Writes the ids of all texts, each followed by ``end_id``, to flat files in the folder ``out``.

    Special tokens' strings are ordinary text, so no text holds the separator. Null and empty texts are the separator alone. The text writer makes the files: its rows are
    the packed ids, its line separator the packed end_id, whose bytes Latin-1 keeps as they are.
    """
    prepare(docs.sparkSession)
    kind, dtype = WIDTHS[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                made = tokenizer(path, kind, special=False).encode(batch.column(0).slice(begin, TEXT_BATCH_ROWS).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["ids"])

    packed = docs.select(F.col(text).cast("binary")).mapInArrow(run, "ids binary").select(F.col("ids").cast("string"))
    mark = np.array([end_id], dtype).tobytes().decode("latin-1")
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", mark).text(out)


def scan(spark: SparkSession, folder: str, end_id: int, width: int = 2) -> DataFrame:
    """(doc_no, start, n_tokens, terminated): the documents of the stream, numbered from 0.

    start counts ids from the stream's first; n_tokens leaves the separator out and may be 0. Ids
    after the last separator are a document that isn't terminated. A file whose size isn't a
    multiple of ``width`` raises an error. Empty files hold nothing.
    """
    prepare(spark)
    dtype = WIDTHS[width][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if content.as_buffer().size % width:
                    raise ValueError(f"{name} isn't a whole number of ids")
                ids = np.frombuffer(content.as_buffer(), dtype)
                for block, at in enumerate(range(0, len(ids), BLOCK_TOKENS)):
                    part = ids[at : at + BLOCK_TOKENS]
                    ends = np.flatnonzero(part == end_id).astype(np.int32)
                    columns = ([name], [block], [len(part)], [ends])
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "n", "ends"]
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).where("length > 0")
    blocks = files.select("path", "content").mapInArrow(run, "file string, block int, n long, ends array<int>")
    blocks = materialise(blocks, "blocks")
    order = ["file", "block"]
    sums = blocks.select(*order, "n", F.size("ends").cast("long").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    if sums.isEmpty():
        return spark.createDataFrame([], "doc_no long, start long, n_tokens long, terminated boolean")
    sums = prefix_scan(sums, order, {"tokens": ("sum", F.col("n")), "docs": ("sum", F.col("k"))}, "blocks")
    sums = sums.withColumn("final", F.col("tokens") + F.col("last"))
    sums = prefix_scan(sums, order, {"before": ("max", F.col("final"))}, "blocks")
    sums = materialise(sums.withColumn("first", F.coalesce(F.col("before") + 1, F.lit(0).cast("long"))), "blocks")

    where = blocks.select(*order, "ends").join(sums.select(*order, "tokens", "docs", "first"), order)
    docs = where.select("*", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("first")).otherwise(
        F.col("tokens") + F.get("ends", F.col("i") - 1) + 1
    )
    docs = docs.select(
        (F.col("docs") + F.col("i")).alias("doc_no"), start.cast("long").alias("start"),
        (F.col("tokens") + F.col("end") - start).cast("long").alias("n_tokens"), F.lit(True).alias("terminated"),
    )
    total = sums.agg(
        F.sum("k").alias("doc_no"), F.coalesce(F.max("final") + 1, F.lit(0).cast("long")).alias("start"), F.sum("n").alias("t")
    )
    tail = total.where("t > start").select("doc_no", "start", (F.col("t") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return docs.unionByName(tail)
