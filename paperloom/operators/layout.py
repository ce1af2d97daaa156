"""Tokens and lines of a page: one row a document, tokens as array<struct<text,bbox,conf>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scalars import once

TOKENS = "array<struct<text:string,bbox:array<double>,conf:double>>"
MEAN_TOLERANCE, ANCHOR_TOLERANCE = 8.0, 10.0


def words(ocr: Column) -> Column:
    """Tokens as words: text, x0, y0, x1, y1, conf, centres xc and yc, and pos in the input. Missing parts get defaults."""
    box = lambda t, i: F.coalesce(F.get(t["bbox"], F.lit(i)), F.lit(0.0))
    return F.transform(
        F.coalesce(ocr, F.array().cast(TOKENS)),
        lambda t, i: F.struct(
            ((box(t, 1) + box(t, 3)) / 2).alias("yc"), i.alias("pos"), F.coalesce(t["text"], F.lit("")).alias("text"),
            box(t, 0).alias("x0"), box(t, 1).alias("y0"), box(t, 2).alias("x1"), box(t, 3).alias("y1"),
            ((box(t, 0) + box(t, 2)) / 2).alias("xc"), F.coalesce(t["conf"], F.lit(1.0)).alias("conf"),
        ),
    )


def full_text(ocr: Column) -> Column:
    return F.array_join(ocr["text"], " ", "")


def line_starts(centres: Column, tolerance: float, by_mean: bool) -> Column:
    """Where lines begin (from 1) among words sorted by height: one fold, as only the last line can take a word.

    A word joins the line if its centre lies within ``tolerance`` of the line's running mean
    (by_mean) or of its first word. The fold's state grows with the lines, not with the words.
    """
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("out"))

    def step(s, y):
        at = s["sum"] / s["n"] if by_mean else s["sum"]
        joins = (s["n"] > 0) & (F.abs(y - at) <= tolerance)
        i = s["i"] + 1
        state = lambda total, n, out: F.struct(total.alias("sum"), n.alias("n"), i.alias("i"), out.alias("out"))
        goes_on = state(s["sum"] + y if by_mean else s["sum"], s["n"] + 1, s["out"])
        return F.when(joins, goes_on).otherwise(state(y, F.lit(1), F.concat(s["out"], F.array(i))))

    return F.aggregate(centres, state, step, lambda s: s["out"])


def with_lines(docs: DataFrame, tolerance: float = MEAN_TOLERANCE, by_mean: bool = True, name: str = "lines") -> DataFrame:
    """docs with its lines, arrays of words from left to right; each step is a column of its own, computed once."""
    found = docs.withColumn("_words", F.sort_array(words(F.col("ocr"))))
    found = found.withColumn("_starts", line_starts(F.col("_words")["yc"], tolerance, by_mean))

    def line(start, k):
        end = F.coalesce(F.get("_starts", k + 1), F.size("_words") + 1)
        mine = F.transform(
            F.transform(F.sequence(start - 1, end - 2), lambda i: F.get("_words", i)),  # a slice would read all words for each line
            lambda w: F.struct(w["x0"].alias("a"), w["yc"].alias("b"), w["pos"].alias("c"), w.alias("w")),
        )
        return F.sort_array(mine)["w"]

    return found.withColumn(name, F.transform("_starts", line)).drop("_words", "_starts")


def line_text(line: Column) -> Column:
    return F.array_join(line["text"], " ")


def region(word: Column, height: Column | float) -> Column:
    """header above 15 % of the page's height, footer below 85 %, else body."""
    h = F.lit(height) if isinstance(height, (int, float)) else height
    return F.when(word["y1"] <= 0.15 * h, "header").when(word["y0"] >= 0.85 * h, "footer").otherwise("body")


def regions(docs: DataFrame, height: float) -> DataFrame:
    """(doc_id, header, body, footer): texts of each region in input order."""
    found = docs.withColumn("_w", words(F.col("ocr")))
    pick = lambda r: F.transform(F.filter("_w", lambda w: region(w, height) == r), lambda w: w["text"])
    return found.select("doc_id", *(pick(r).alias(r) for r in ("header", "body", "footer")))


def key_values(lines: Column) -> Column:
    """map: a line's first token that ends with a colon and has a right neighbour, to the rest; later lines win."""

    def pair(line):
        n = F.size(line)
        ends = F.array_position(F.transform(line, lambda w, i: F.endswith(w["text"], F.lit(":")) & (i < n - 1)), True).cast("int")

        def made(at):
            rest = F.array_join(F.transform(F.slice(line, at + 1, n), lambda w: w["text"]), " ")
            return F.when(
                at > 0, F.struct(F.trim(F.regexp_replace(F.element_at(line, at)["text"], ":$", "")).alias("k"), F.trim(rest).alias("v"))
            )

        return once(ends, made)

    pairs = F.filter(F.transform(lines, pair), lambda p: p.isNotNull())
    # of equal keys the last in line order stays: the first of the reversed ones, by name
    latest = F.sort_array(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), (-i).alias("i"), p["v"].alias("v"))))
    last = once(latest, lambda a: F.filter(a, lambda p, i: (i == 0) | (F.get(a, i - 1)["k"] != p["k"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))


def table_rows(lines: Column, least: int = 3) -> Column:
    """Texts of the lines with at least so many tokens, none of which ends with a colon."""
    rows = F.filter(lines, lambda l: (F.size(l) >= least) & ~F.exists(l, lambda w: F.endswith(w["text"], F.lit(":"))))
    return F.transform(rows, lambda l: F.transform(l, lambda w: w["text"]))
