"""Event-time joins of streams: results with the corrections made soon after, without repeated deliveries.

The same functions work on tables, whose result is what the streams come to if no row is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def delivered_once(rows: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """rows without those that repeat a ``key``. In a stream a key is remembered until the watermark has passed it by ``late``."""
    if not rows.isStreaming:
        return rows.dropDuplicates([key])
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def corrected(results: DataFrame, corrections: DataFrame, key: str, within: str = "2 hours", at: str = "ts", how: str = "inner") -> DataFrame:
    """Each result with each correction of the same ``key`` made at most ``within`` after it; corrections' columns begin with ``c_``.

    how: inner, or left_outer, whose unmatched results come out of a stream once the watermark shows that no correction
    can follow. State is kept for as long as a match can come: both streams need a watermark, which
    ``delivered_once`` gives them. Rows with a NULL key match nothing.
    """
    later = corrections.select(*(F.col(c).alias(f"c_{c}") for c in corrections.columns))
    begin, end = F.col(at), F.col(at) + F.expr(f"INTERVAL {within}")
    same = (F.col(key) == F.col(f"c_{key}")) & (F.col(f"c_{at}") >= begin) & (F.col(f"c_{at}") <= end)
    return results.join(later, same, how)


def run_available(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived so far to Parquet files, each row exactly once over restarts with one checkpoint."""
    written = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return written.outputMode("append").trigger(availableNow=True).start()
