"""Registered queries of error rates of whole texts and of table rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import distance as D
from paperloom.functions import scalars as S
from paperloom.functions.scalars import strip
from paperloom.operators import metrics, store
from paperloom.plans.catalog import Query, _results
from paperloom.plans.tables import INDEX_SQL, table
from paperloom.sources.shared import saved

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: What no text of the tables has.
MARK = ""


def query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _documents(spark, d):
    """The documents, dealt to all cores: a file may be one row group, which one task would read and compare."""
    return table(spark, d, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")


def _edited(parts: F.Column, replaced, dropped) -> F.Column:
    """Parts without those that are dropped, and with the mark in place of those that are replaced."""
    marked = F.transform(parts, lambda x, i: F.when(replaced(i), F.lit(MARK)).when(~dropped(i), x))
    return F.filter(marked, lambda x: x.isNotNull())


def _edited_text(t: F.Column) -> F.Column:
    """A text with the mark for each 26th of 50 characters, without each 61st of 97 that isn't marked; the last two stay.

    By two patterns that go from block to block; a text that has the mark itself is edited character by character.
    """
    n = F.length(t)
    marked = F.regexp_replace(F.substring(t, F.lit(1), n - 2), r"(?s)\G(.{25}).(.{0,24})", f"$1{MARK}$2")
    made = F.regexp_replace(marked, rf"(?s)\G(.{{60}})(?:({MARK})|.)(.{{0,36}})", "$1$2$3")
    c = F.split(t, "")
    inner = lambda i: (i > 1) & (i < F.size(c) - 2)
    each = F.array_join(_edited(c, lambda i: inner(i) & (i % 50 == 25), lambda i: inner(i) & (i % 97 == 60)), "")
    return F.when(n <= 2, t).when(F.contains(t, F.lit(MARK)), each).otherwise(F.concat(made, F.substring(t, n - 1, F.lit(2))))


@query(r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+')) AS n FROM documents)
  SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 0.0 ELSE round(len(list_filter(range(n), lambda i: i % 10 = 3 OR i % 17 = 5)) / n::DOUBLE, 6) END AS wer FROM w""")
def wer_documents(spark, d):
    """Word error rate of every whole document against a copy with words replaced and left out."""
    words = F.filter(F.split(strip(F.coalesce("text", F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    rows = _documents(spark, d).select("doc_id", "text", words.alias("w"))
    rows = rows.withColumn("copy", F.array_join(_edited(F.col("w"), lambda i: i % 10 == 3, lambda i: i % 17 == 5), " "))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.round(D.wer("text", "copy"), 6).alias("wer"))


@query(r"""WITH t AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS n FROM documents)
  SELECT doc_id, len(list_filter(range(n), lambda i: i > 1 AND i < n - 2 AND (i % 50 = 25 OR i % 97 = 60))) AS dist,
    CASE WHEN n = 0 THEN 0.0 ELSE round(len(list_filter(range(n), lambda i: i > 1 AND i < n - 2 AND (i % 50 = 25 OR i % 97 = 60))) / n::DOUBLE, 6) END AS cer FROM t""")
def cer_documents(spark, d):
    """Character error rate of every whole document against a copy with characters replaced and left out."""
    rows = _documents(spark, d).select("doc_id", strip(F.coalesce("text", F.lit(""))).alias("t"))
    rows = rows.withColumn("copy", _edited_text(F.col("t")))
    rows = rows.withColumn("dist", D.text_distance(F.col("t"), F.col("copy")))  # once: the texts are stripped already
    return rows.select("doc_id", "dist", F.round(S._rate(F.col("dist"), F.length("t"), F.length("copy")), 6).alias("cer"))


def _line_items(spark, d):
    """True line items, and found ones: a heading as first row, every third line missing, the first line's amount wrong."""
    rows = saved(store.line_item_rows(_results(spark, d)), "line-items")  # named three times below
    k, line = F.col("doc_id").cast("long"), F.col("data")["line"].cast("int")
    wrong = F.map_concat(F.map_filter("data", lambda h, v: h != "amount"), F.create_map(F.lit("amount"), F.lit("0.01")))
    found = rows.where((k % 2 == 1) | (line % 3 != 0)).withColumn("data", F.when((k % 4 == 1) & (line == 1), wrong).otherwise(F.col("data")))
    found = found.withColumns({"row_index": F.col("row_index") + 1, "data": F.transform_values("data", lambda h, v: F.concat(F.lit(" $"), v))})
    heads = rows.where(k % 5 == 0).select("doc_id", "table_index").distinct()
    heads = heads.withColumns({"row_index": F.lit(0), "data": F.create_map(F.lit("line"), F.lit("Line"), F.lit("amount"), F.lit("Amount"))})
    return rows, found.unionByName(heads)


ROW_SQL = """l AS (SELECT l_orderkey AS k, l_linenumber AS line, printf('%.2f', l_extendedprice) AS amount FROM lineitem WHERE l_orderkey IN (SELECT CAST(doc_id AS BIGINT) FROM idx)),
c AS (SELECT k, count(*) AS n, count(*) FILTER (k % 2 = 1 OR line % 3 <> 0) AS kept, count(*) FILTER (k % 4 = 1 AND line = 1) AS wrong FROM l GROUP BY k),
r AS (SELECT CAST(k AS VARCHAR) AS doc_id, kept - {0} AS tp, {0} + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS fp, n - kept + {0} AS fn FROM c)"""


@query("WITH " + INDEX_SQL + ", " + ROW_SQL.format("wrong") + " SELECT doc_id, tp, fp, fn FROM r")
def table_row_alignment(spark, d):
    counts = metrics.table_row_counts(*_line_items(spark, d))
    return counts.select("doc_id", "tp", F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"))


@query("WITH " + INDEX_SQL + ", " + ROW_SQL.format("0") + """ SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
  round(sum(tp) / (sum(tp) + sum(fp))::DOUBLE, 4) AS precision, round(sum(tp) / (sum(tp) + sum(fn))::DOUBLE, 4) AS recall,
  round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 4) AS micro_f1, round(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE), 4) AS macro_f1 FROM r""")
def table_row_f1(spark, d):
    """Half of a row's cells are enough here, so a wrong amount alone doesn't lose the row."""
    return metrics.table_row_scores(metrics.table_row_counts(*_line_items(spark, d), least=0.5))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
