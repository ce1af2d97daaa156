"""As-of and interval joins by equal keys and bins: no nested loops, and no key's rows in one task.

An as-of join looks within a bin of time first; what a bin lacks is carried over from the key's earlier bins, of which
there is a row each. An interval join files intervals by size, so that each lies in two bins of its size at
most, and asks every size that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(at: Column, kind: str) -> Column:
    """Seconds of timestamps and dates, else the number itself."""
    return F.unix_micros(at.cast("timestamp")) / 1e6 if kind.startswith(("timestamp", "date")) else at.cast("double")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, bins: float = 86_400.0, within: float | None = None, prefix: str = "r_") -> DataFrame:
    """Every row of left with the last row of right of the same ``by`` that isn't later, its columns named with ``prefix``, NULL if none.

    on: a time or number in both; bins and within are in its seconds or units. Of right rows at one time the greatest by
    all their columns counts (maps can't be compared). Rows of left with a NULL in ``by`` or ``on`` match nothing, ones of right
    never do. Repeated rows of left each come out. within: no match from further back.
    """
    kind = dict(left.dtypes)[on]
    keys = [f"_k{i}" for i in range(len(by))]

    def filed(df: DataFrame, row: str, other: str, side: int) -> DataFrame:
        body = F.struct(*(F.col(c) for c in df.columns))
        return df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), _number(F.col(on), kind).alias("_t"), body.alias(row), F.lit(side).alias("_side"))

    whole = lambda df: df.na.drop(subset=[*keys, "_t"]).withColumn("_bin", F.floor(F.col("_t") / bins))
    lefts, rights = filed(left, "_l", "_r", 1), whole(filed(right, "_r", "_l", 0))
    both = whole(lefts).unionByName(rights, allowMissingColumns=True)
    here = Window.partitionBy(*keys, "_bin").orderBy("_t", "_side", F.col("_r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.struct(F.col("_t"), F.col("_r"))
    both = both.withColumn("_m", F.last(F.when(F.col("_side") == 0, latest), ignorenulls=True).over(here))
    ends = both.groupBy(*keys, "_bin").agg(F.max(F.when(F.col("_side") == 0, latest)).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_bin", F.last("_end", ignorenulls=True).over(before).alias("_c"))
    found = both.where("_side = 1").join(ends, [*keys, "_bin"], "left").withColumn("_m", F.coalesce("_m", "_c"))
    rest = lefts.where(F.greatest(*(F.col(c).isNull() for c in (*keys, "_t")), F.lit(False))).withColumn("_m", F.lit(None).cast(found.schema["_m"].dataType))
    out = found.select("_t", "_l", "_m").unionByName(rest.select("_t", "_l", "_m"))
    if within is not None:
        out = out.withColumn("_m", F.when(F.col("_t") - F.col("_m._t") <= within, F.col("_m")))
    return out.select("_l.*", *(F.col("_m")["_r"][c].alias(prefix + c) for c in right.columns))


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, low: str, high: str, width: float = 1.0, prefix: str = "r_") -> DataFrame:
    """Each point with each interval of the same ``by`` that it lies in, low included, high not; the interval's columns get ``prefix``.

    width: the size of the smallest bins, in seconds or units of ``at``; it decides the cost only. Empty intervals and NULLs
    match nothing.
    """
    kinds = dict(intervals.dtypes)
    right = intervals.select(*(F.col(c).alias(prefix + c) for c in intervals.columns), _number(F.col(low), kinds[low]).alias("_low"), _number(F.col(high), kinds[high]).alias("_high"))
    right = right.where("_low < _high")
    size = F.greatest(F.ceil(F.log2((F.col("_high") - F.col("_low")) / width)), F.lit(0)).cast("int")
    right = right.withColumn("_size", size)
    sizes = [r[0] for r in right.select("_size").distinct().collect()]  # a power of two each: some tens at most
    step = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_size"))
    last = F.floor(F.col("_high") / step)
    right = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / step), last)))
    left = points.withColumns({"_at": _number(F.col(at), dict(points.dtypes)[at]), "_size": F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))})
    left = left.withColumn("_bin", F.floor(F.col("_at") / step))
    same = [left[c] == right[prefix + c] for c in by] + [left["_size"] == right["_size"], left["_bin"] == right["_bin"], left["_at"] >= right["_low"], left["_at"] < right["_high"]]
    made = left.join(right, same)
    return made.select(*(left[c] for c in points.columns), *(right[prefix + c] for c in intervals.columns))
