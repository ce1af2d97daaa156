"""Continuous ingestion: the same per-document expressions on a stream, results upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.layout import TOKENS
from paperloom.plans.process import process
from paperloom.sources.results import Conflict, Results

#: Changes after which a table is folded into a new base.
CHANGES = 16


def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON documents (doc_id, filename, ocr, created_at) as they arrive."""
    return spark.readStream.schema(f"doc_id string, filename string, ocr {TOKENS}, created_at timestamp").json(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The index rows as of the last published change; None before the first one."""
    target = Results(spark, folder)
    return target.table("index") if target.last() else None


def ingest(stream: DataFrame, folder: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Processes arriving documents and stores their results: index rows, fields and line items in one change a batch.

    A batch writes its own rows only, whatever lies in the tables; after CHANGES of them they are compacted. The
    manifest carries the stream's last batch, so a batch that is run again after it was published changes
    nothing. Of a document's rows in one batch the latest by created_at counts. What fails before publishing fails the
    batch and replaces nothing.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        target = Results(spark, folder)
        source = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        target.upsert(process(rows, as_of), (source, number))
        if len(target.manifest()["changes"]) > CHANGES:
            try:
                target.compact()
            except Conflict:  # the next batch tries again
                pass

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window, for batch and stream; late rows beyond the watermark are left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
