"""Analytics kept up to date by changes: partial sums by type and vendor, with retraction of replaced rows.

Counts are whole numbers and amounts decimals of cents, so that what was added can be taken back exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("doc_type", "vendor")
SUMS = ("n", "to_review", "amount", "amounts")


def _summed(rows: DataFrame) -> DataFrame:
    kinds = {"amount": "decimal(38,2)"}
    sums = rows.groupBy(*KEY).agg(*(F.sum(c).cast(kinds.get(c, "long")).alias(c) for c in SUMS))
    return sums.where("n <> 0")


def delta(changed: DataFrame) -> DataFrame:
    """Partial sums of index rows with ``sign`` 1 (as they are now) and -1 (as they were); a group may cancel out to n = 0."""
    sign, amount = F.col("sign"), F.col("total_amount").cast("decimal(14,2)")
    rows = changed.select(
        *KEY, sign.cast("long").alias("n"), F.when(F.col("needs_review"), sign).otherwise(0).cast("long").alias("to_review"),
        (F.coalesce(amount, F.lit(0)).cast("decimal(14,2)") * sign.cast("decimal(1,0)")).alias("amount"),
        F.when(amount.isNotNull(), sign).otherwise(0).cast("long").alias("amounts"),
    )
    return rows.groupBy(*KEY).agg(*(F.sum(c).cast("decimal(38,2)" if c == "amount" else "long").alias(c) for c in SUMS))


def state(index: DataFrame) -> DataFrame:
    """Partial sums of a whole index: (doc_type, vendor, n, to_review, amount, amounts); a few numbers a vendor and type."""
    return delta(index.withColumn("sign", F.lit(1))).where("n <> 0")


def apply(before: DataFrame, change: DataFrame) -> DataFrame:
    """The state after a change: groups that lose their last document go."""
    return _summed(before.unionByName(change))


def kpis(sums: DataFrame) -> DataFrame:
    """As ``store.kpis``."""
    n, review = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("to_review"), F.lit(0))
    rate = F.when(n == 0, 100.0).otherwise(F.round(100.0 * (n - review) / n, 2))
    volume = F.coalesce(F.sum("amount").cast("double"), F.lit(0.0))
    return sums.agg(n.alias("total"), review.alias("needs_review"), (n - review).alias("stp"), rate.alias("stp_rate"), F.round(volume, 2).alias("volume"))


def type_distribution(sums: DataFrame) -> DataFrame:
    """As ``store.type_distribution``."""
    return sums.groupBy("doc_type").agg(F.sum("n").alias("n"))


def top_vendors(sums: DataFrame, k: int = 5) -> DataFrame:
    """As ``store.top_vendors``."""
    volume = F.when(F.sum("amounts") > 0, F.round(F.sum("amount").cast("double"), 2))
    per = sums.where("vendor is not null").groupBy("vendor").agg(F.sum("n").alias("n"), volume.alias("volume"))
    return per.orderBy(F.desc("n"), "vendor").limit(k).where("vendor <> ''")
