"""Line-item tables: header line, column bounds, rows until the totals."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.layout import line_text, once

#: Fixed values.
HEADERS = ("item", "description", "qty", "quantity", "rate", "price", "unit price", "amount", "total", "sr", "sl", "no", "hsn")
COMPOUNDS = ("unit price", "item description", "item name", "sr no", "sl no", "tax rate", "total amount")
STOPS = ("grand total", "subtotal", "total due", "total:", "total ")
TABLES = "array<struct<headers:array<string>,rows:array<array<string>>>>"


def header_score(line: Column) -> Column:
    has = lambda low: [F.contains(low, F.lit(k)).cast("int") for k in HEADERS]
    return once(F.lower(line_text(line)), lambda low: reduce(add, has(low)))


def header_index(lines: Column) -> Column:
    """The first line (from 1) with the most keywords, NULL unless it has two."""

    def first(scores):
        best = F.array_max(scores)
        return F.when(best >= 2, F.array_position(scores, best).cast("int"))

    return once(F.transform(lines, header_score), first)


def columns(header: Column) -> Column:
    """array<struct<name,x0>> of the header's words; the compounds are one column."""
    bare = lambda w: F.lower(F.regexp_replace(w["text"], "^:+|:+$", ""))
    named = F.transform(header, lambda w: F.struct(bare(w).alias("name"), w["x0"].alias("x0")))
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<name:string,x0:double>>").alias("out"))

    def step(s, c):
        n = F.size(s["out"])
        last = F.element_at(s["out"], F.greatest(n, F.lit(1)))
        pair = F.concat_ws(" ", last["name"], c["name"])
        joins = s["open"] & pair.isin(*COMPOUNDS)
        merged = F.concat(F.slice(s["out"], 1, n - 1), F.array(F.struct(pair.alias("name"), last["x0"].alias("x0"))))
        added = F.concat(s["out"], F.array(c))
        return F.struct((~joins).alias("open"), F.when(joins, merged).otherwise(added).alias("out"))

    return F.aggregate(named, start, step, lambda s: s["out"])


def column_of(bounds: Column, x: Column) -> Column:
    """The last column (from 1) that begins at or left of x; the first for what lies left of all."""
    return F.greatest(F.size(F.filter(bounds, lambda b: b <= x)), F.lit(1))


def body(lines: Column, header: Column) -> Column:
    """The lines after the header, up to one that speaks of totals."""

    def until_totals(rest):
        stops = F.transform(rest, lambda l: F.lower(line_text(l)).rlike("|".join(r"\Q" + s + r"\E" for s in STOPS)))
        return once(F.array_position(stops, True).cast("int"), lambda at: F.when(at > 0, F.slice(rest, 1, at - 1)).otherwise(rest))

    return once(F.slice(lines, header + 1, F.size(lines) + 1), until_totals)


def extract_tables(docs: DataFrame) -> DataFrame:
    """docs (lines) with ``tables``: at most one. Same-named columns share their cells; empty rows and columns go."""
    none = F.array().cast(TABLES)
    made = docs.withColumn("_at", header_index(F.col("lines")))
    made = made.withColumn("_cols", F.when(F.col("_at").isNotNull(), columns(F.element_at("lines", F.coalesce("_at", F.lit(1))))))
    made = made.withColumn("_body", F.when(F.col("_at").isNotNull(), body(F.col("lines"), F.col("_at"))))
    made = made.withColumn("_names", F.array_distinct(F.col("_cols")["name"]))

    def placed(bounds):
        name = lambda w: F.element_at("_cols", column_of(bounds, w["xc"]))["name"]
        return F.transform("_body", lambda l: F.transform(l, lambda w: F.struct(name(w).alias("n"), w["text"].alias("t"))))

    made = made.withColumn("_placed", once(F.col("_cols")["x0"], placed))  # not made anew for each word

    def cells(line):
        return F.transform("_names", lambda n: F.trim(F.array_join(F.filter(line, lambda w: w["n"] == n)["t"], " ")))

    made = made.withColumn("_rows", F.filter(F.transform("_placed", cells), lambda r: F.exists(r, lambda c: c != "")))
    used = F.filter(F.sequence(F.lit(1), F.size("_names")), lambda i: F.exists("_rows", lambda r: F.element_at(r, i) != ""))
    made = made.withColumn("_used", F.when(F.size("_rows") > 0, used))
    table = F.struct(
        F.transform("_used", lambda i: F.element_at("_names", i)).alias("headers"),
        F.transform("_rows", lambda r: F.transform("_used", lambda i: F.element_at(r, i))).alias("rows"),
    )
    tables = F.when(F.size("_used") > 0, F.array(table)).otherwise(none).cast(TABLES)
    return made.withColumn("tables", tables).drop("_at", "_cols", "_body", "_names", "_placed", "_rows", "_used")
