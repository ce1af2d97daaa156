"""Evaluation of predictions: field and class counts, rates, straight-through processing, the report."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.distance import aligned, cer, wer
from paperloom.functions.scalars import agree, amount_of, comparable, normal_of, strip
from paperloom.operators.layout import full_text, once
from paperloom.operators.store import field_rows
from paperloom.sources.shared import importable, saved


def field_counts(truth: DataFrame, predicted: DataFrame, normalized: bool = True) -> DataFrame:
    """(doc_id, name, tp, fp, fn) of field rows (doc_id, name, value): a mismatch is both fp and fn."""
    a = truth.select("doc_id", "name", F.col("value").alias("t"))
    b = predicted.select("doc_id", "name", F.col("value").alias("p"))
    both = a.join(b, ["doc_id", "name"], "full_outer")
    met = F.col("t").isNotNull() & F.col("p").isNotNull()  # only these are parsed
    both = both.withColumns({f"c{x}": F.when(met, comparable(x, normalized, F.col("name"))) for x in ("t", "p")})
    hit = F.coalesce(met & agree(F.col("name"), F.col("ct"), F.col("cp")), F.lit(False))
    one = lambda c: F.when(c, 1).otherwise(0)
    return both.select(
        "doc_id", "name", one(hit).alias("tp"), one(F.col("p").isNotNull() & ~hit).alias("fp"),
        one(F.col("t").isNotNull() & ~hit).alias("fn"),
    )


def _ratio(hit, missed, other):
    n = F.col(hit) + F.col(missed)
    return F.when(n > 0, F.col(hit) / n).when(F.col(other) > 0, 0.0).otherwise(1.0)


def field_scores(counts: DataFrame, by: str = "name") -> DataFrame:
    """Precision, recall and F1 a field; nothing to find and nothing found is 1."""
    sums = counts.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = _ratio("tp", "fp", "fn"), _ratio("tp", "fn", "fp")
    made = sums.withColumns({"p": p, "r": r})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return made.select(
        by, "tp", "fp", "fn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1")
    )


def overall_scores(counts: DataFrame, by: str = "name") -> DataFrame:
    """Pooled precision, recall and F1 (0 where undefined), and the mean of the fields' F1 (1 without fields)."""
    pooled = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    macro = field_scores(counts, by).agg(F.round(F.coalesce(F.avg("f1"), F.lit(1.0)), 4).alias("macro_f1"))
    return pooled.select(
        "tp", "fp", "fn", F.round(div(tp, tp + fp), 4).alias("precision"), F.round(div(tp, tp + fn), 4).alias("recall"),
        F.round(div(2 * tp, 2 * tp + fp + fn), 4).alias("micro_f1"),
    ).join(macro)  # one row each


def class_counts(pairs: DataFrame) -> DataFrame:
    """(class, tp, fp, fn) of pairs (truth, predicted)."""
    n = pairs.where("truth is not null and predicted is not null").groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    hit = F.col("truth") == F.col("predicted")
    zero = F.lit(0).cast("long")
    a = n.select(F.col("truth").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), zero.alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn"))
    b = n.where(~hit).select(F.col("predicted").alias("class"), zero.alias("tp"), F.col("n").alias("fp"), zero.alias("fn"))
    return a.unionByName(b).groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def class_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 a class, 0 where undefined."""
    div = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_counts(pairs).select(
        "class", "tp", "fp", "fn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
        div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def class_overall(pairs: DataFrame) -> DataFrame:
    """accuracy, and means over the classes that occur; zeros for no pairs."""
    rows = class_scores(pairs)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return rows.agg(
        zero(F.sum("tp") / F.nullif(F.sum("tp") + F.sum("fn"), F.lit(0))).alias("accuracy"),
        *(zero(F.avg(c)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")),
    )


def class_report(pairs: DataFrame, by: str) -> DataFrame:
    """(by, class, precision, recall, f1, support) of pairs (by, truth, predicted): a report for each value of ``by``.

    A row a class that is true or predicted somewhere, 0 where undefined, then ``accuracy`` (in f1 alone), ``macro avg`` and
    ``weighted avg`` (by support). Pairs are counted before anything else, so what follows has some rows a class.
    """
    n = pairs.where("truth is not null and predicted is not null").groupBy(by, "truth", "predicted").agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(True).alias("is_true")), F.struct(F.col("predicted").alias("class"), F.lit(False).alias("is_true"))))
    hit, true = F.col("truth") == F.col("predicted"), F.col("s.is_true")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("double")
    rows = n.withColumn("s", sides).groupBy(by, F.col("s.class").alias("class")).agg(
        total(hit & true).alias("tp"), total(~true).alias("found"), total(true).alias("support"),
    )
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, found, support = F.col("tp"), F.col("found"), F.col("support")
    rows = rows.withColumns({"precision": div(tp, found), "recall": div(tp, support), "f1": div(2 * tp, found + support)})
    scores = ("precision", "recall", "f1")
    none = F.lit(None).cast("double")
    every = F.sum("support")
    means = rows.groupBy(by).agg(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"), div(F.sum("tp"), every).alias("f1"), every.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in scores), every.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), *(div(F.sum(F.col(c) * support), every).alias(c) for c in scores), every.alias("support")),
    )).alias("r")).select(by, "r.*")
    made = rows.select(by, "class", *scores, "support").unionByName(means)
    return made.select(by, "class", *(F.round(c, 4).alias(c) for c in scores), F.col("support").cast("long").alias("support"))


def document_scores(truth: DataFrame, predicted: DataFrame, normalized: bool = True) -> DataFrame:
    """A row a document: type_match, cer and wer (NULL without true text), tp, fp, fn, is_stp.

    Straight-through: not flagged, type right, and every true field that has a value matched.
    """
    once = truth.dropDuplicates(["doc_id"])
    return _scored(once, predicted, field_counts(field_rows(once), field_rows(predicted), normalized))


def _scored(truth: DataFrame, predicted: DataFrame, counts: DataFrame) -> DataFrame:
    """``document_scores`` of true rows, one a document, from the counts of their fields."""
    a = truth.select("doc_id", F.col("doc_type").alias("truth"), full_text(F.col("ocr")).alias("t"))
    b = predicted.select("doc_id", F.col("doc_type").alias("predicted"), "needs_review", full_text(F.col("ocr")).alias("p"))
    sums = counts.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    made = a.join(b, "doc_id").join(sums, "doc_id", "left").na.fill(0, ["tp", "fp", "fn"])
    has = F.coalesce("t", F.lit("")) != ""
    match = F.col("truth") == F.col("predicted")
    return made.select(
        "doc_id", "truth", "predicted", match.alias("type_match"), F.when(has, F.round(cer("t", "p"), 4)).alias("cer"),
        F.when(has, F.round(wer("t", "p"), 4)).alias("wer"), "tp", "fp", "fn",
        (~F.col("needs_review") & match & (F.col("fn") == 0)).alias("is_stp"),
    )


def corpus_scores(truth: DataFrame, predicted: DataFrame, normalized: bool = True) -> DataFrame:
    """One row: documents, stp_rate_pct, mean cer and wer, accuracy, pooled field counts."""
    rows = document_scores(truth, predicted, normalized)
    n = F.count("*")
    return rows.agg(
        n.alias("documents"), F.when(n == 0, 0.0).otherwise(F.round(100.0 * F.count_if("is_stp") / n, 2)).alias("stp_rate_pct"),
        F.round(F.avg("cer"), 4).alias("cer"), F.round(F.avg("wer"), 4).alias("wer"),
        F.round(F.avg(F.col("type_match").cast("double")), 4).alias("accuracy"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")),
    )


def evaluation(truth: DataFrame, predicted: DataFrame, normalized: bool = True) -> DataFrame:
    """(part, name, metric, value): the whole report as rows, some tens of them.

    part ``overall``: documents, total_stp, stp_rate_pct, accuracy, class_macro_f1, field_micro_f1, field_macro_f1, cer, wer. ``class``: precision,
    recall and f1 of each class. ``field``: pooled tp, fp, fn, precision and recall. field_macro_f1 is the mean over every
    field of every document, found or true.
    """
    once = truth.dropDuplicates(["doc_id"])
    known = once.join(predicted.select("doc_id"), "doc_id", "left_semi")
    found = predicted.join(once.select("doc_id"), "doc_id", "left_semi")
    # both are read several times below: counted and compared once
    counts = saved(field_counts(field_rows(known), field_rows(found).where("value is not null"), normalized), "field-counts")
    docs = saved(_scored(once, predicted, counts), "document-scores")
    pairs = docs.select("truth", "predicted")
    fields = saved(overall_scores(counts.withColumn("key", F.concat_ws("_", "doc_id", "name")), "key"), "field-scores")
    n = F.count("*")
    totals = docs.agg(
        n.alias("documents"), F.count_if("is_stp").alias("total_stp"), F.when(n == 0, 0.0).otherwise(F.round(100.0 * F.count_if("is_stp") / n, 2)).alias("stp_rate_pct"),
        F.round(F.avg("cer"), 4).alias("cer"), F.round(F.avg("wer"), 4).alias("wer"),
    )
    classes = class_overall(pairs).select("accuracy", F.col("macro_f1").alias("class_macro_f1"))
    field = fields.select(F.col("micro_f1").alias("field_micro_f1"), F.col("macro_f1").alias("field_macro_f1"))

    def tall(df: DataFrame, part: str, columns: list[str], name: str | None = None) -> DataFrame:
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns)))
        named = df.select(F.lit(part).alias("part"), (F.col(name) if name else F.lit(part)).alias("name"), cells.alias("c"))
        return named.select("part", "name", "c.metric", "c.value")

    made = [tall(df, "overall", df.columns) for df in (totals, classes, field)]
    made += [tall(class_scores(pairs), "class", ["precision", "recall", "f1"], "class"), tall(fields, "field", ["tp", "fp", "fn", "precision", "recall"])]
    return reduce(DataFrame.unionByName, made)


def report(truth: DataFrame, predicted: DataFrame) -> str:
    """``evaluation`` as fixed-width text: overall scores, a table of classes, pooled fields."""
    rows = evaluation(truth, predicted).collect()
    show = lambda v: "-" if v is None else f"{v:.4f}".rstrip("0").rstrip(".")
    lines = ["EVALUATION", "=" * 48, *(f"{r.metric:<24}{show(r.value):>12}" for r in rows if r.part == "overall")]
    classes = sorted({r.name for r in rows if r.part == "class"})
    of = {(r.name, r.metric): r.value for r in rows if r.part == "class"}
    lines += ["", f"{'class':<16}{'precision':>12}{'recall':>12}{'f1':>8}", "-" * 48]
    lines += [f"{c:<16}{of[c, 'precision']:>12.4f}{of[c, 'recall']:>12.4f}{of[c, 'f1']:>8.4f}" for c in classes]
    return "\n".join([*lines, "", "fields", "-" * 48, *(f"{r.metric:<24}{show(r.value):>12}" for r in rows if r.part == "field")])


def _row_places(truth: list[dict], found: list[dict], least: float) -> list[int]:
    """For each found row the true rows, as bits, of which a share ``least`` or more of all cells agrees."""
    at: dict[tuple[str, str], list[int]] = {}
    for i, row in enumerate(truth):
        for cell in row.items():
            at.setdefault(cell, []).append(i)
    out = []
    for row in found:
        hits: dict[int, int] = {}
        for cell in row.items():
            for i in at.get(cell, ()):
                hits[i] = hits.get(i, 0) + 1
        fits = (i for i, n in hits.items() if n >= least * len(truth[i].keys() | row.keys()))
        out.append(sum(1 << i for i in fits))
    return out


def _cell(s: Column) -> Column:
    """A cell, without white space at its ends, as it is compared: an amount with two decimals, or else normalised text."""
    amount = F.when(s.rlike(r"^[^A-Za-z]*$"), amount_of(s))
    made = once(amount, lambda x: F.when(x.isNotNull(), F.format_string("%.2f", x)).otherwise(normal_of(s)))
    return F.when(s.rlike(r"^(0|[1-9][0-9]{0,11})\.[0-9]{2}\z"), s).otherwise(made)  # most are printed so already


def _table_rows(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, table_index, name): each table's rows in order, a row its cells: the header's length, a colon, header and value."""
    keys = F.transform(F.map_keys("data"), lambda k: F.lower(F.trim(k)))
    texts = F.transform(F.map_values("data"), lambda v: strip(F.coalesce(v, F.lit(""))))
    rows = rows.select("doc_id", "table_index", "row_index", keys.alias("k"), texts.alias("s"))
    cells = F.transform(F.arrays_zip("k", "s"), lambda c: F.concat(F.length(c["k"]).cast("string"), F.lit(":"), c["k"], _cell(c["s"])))
    last = F.filter(cells, lambda c, i: ~F.array_contains(F.slice("k", i + 2, F.size("k") + 1), F.get("k", i)))
    kept = F.when(F.size(F.array_distinct("k")) < F.size("k"), last).otherwise(cells)
    rows = rows.select("doc_id", "table_index", F.struct("row_index", kept.alias("cells")).alias("r"))
    return rows.groupBy("doc_id", "table_index").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias(name))


def _as_dict(cells: Iterable[str]) -> dict[str, str]:
    """A row's cells by header."""
    made = {}
    for cell in cells:
        n, _, rest = cell.partition(":")
        made[rest[: int(n)]] = rest[int(n) :]
    return made


def _agreeing(truth: list[tuple], found: list[tuple], least: float, cell: Callable[[Hashable], str]) -> int:
    """The most pairs of agreeing rows in order; rows are tuples of codes, equal codes being equal cells.

    Equal rows at both ends are paired first: any alignment can be changed to pair them without losing a pair.
    """
    low, most = 0, min(len(truth), len(found))
    while low < most and truth[low] and truth[low] == found[low]:
        low += 1
    high = 0
    while high < most - low and truth[-1 - high] and truth[-1 - high] == found[-1 - high]:
        high += 1
    if low + high == most:
        return most
    a, b = ([_as_dict(map(cell, row)) for row in rows[low : len(rows) - high]] for rows in (truth, found))
    return low + high + aligned(_row_places(a, b, least), len(a))


def _coded(tables: pa.Array, codes: list[int], at: int) -> Iterator[list[tuple]]:
    """Each table's rows as tuples of codes, which begin at ``at``."""
    sizes = iter(tables.flatten().value_lengths().to_pylist())
    for n in tables.value_lengths().to_pylist():
        rows = []
        for size in islice(sizes, n):
            rows.append(tuple(codes[at : at + size]))
            at += size
        yield rows


def table_row_counts(truth: DataFrame, predicted: DataFrame, least: float = 1.0) -> DataFrame:
    """(doc_id, table_index, tp, fp, fn): rows of tables that align, that were found beside these, and that were missed.

    truth, predicted: (doc_id, table_index, row_index, data map), as ``store.line_item_rows`` gives them. Two rows agree if a share
    ``least`` of the cells of both, by header, are equal: as amounts if both are, else as normalised texts. The alignment keeps
    the order of rows and has as many agreeing pairs as any. A table is one row here: tables lie on pages.
    """

    importable(truth.sparkSession)

    @F.arrow_udf("long")
    def pairs(a: pa.Array, b: pa.Array) -> pa.Array:
        first, second = (x.flatten().flatten() for x in (a, b))
        coded = pa.concat_arrays([first, second]).dictionary_encode()
        codes, cell = coded.indices.to_pylist(), lambda i: coded.dictionary[i].as_py()
        both = zip(_coded(a, codes, 0), _coded(b, codes, len(first)))
        return pa.array([_agreeing(x, y, least, cell) for x, y in both], pa.int64())

    none = F.array().cast("array<array<string>>")
    both = _table_rows(truth, "a").join(_table_rows(predicted, "b"), ["doc_id", "table_index"], "full")
    both = both.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    both = both.withColumn("tp", pairs("a", "b"))
    return both.select("doc_id", "table_index", "tp", (F.size("b") - F.col("tp")).alias("fp"), (F.size("a") - F.col("tp")).alias("fn"))


def table_row_scores(counts: DataFrame) -> DataFrame:
    """One row: pooled tp, fp, fn, precision, recall, micro F1 of rows, and the mean F1 of tables; 0 where undefined."""
    div = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    tp, fp, fn = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    each = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return counts.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
        div(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.round(F.coalesce(F.avg(each), F.lit(0.0)), 4).alias("macro_f1"),
    )
