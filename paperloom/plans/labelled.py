"""Registered queries of public label formats and of the classifiers' report, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import classify, metrics
from paperloom.plans.catalog import Query
from paperloom.plans.tables import INDEX_SQL, doc_index
from paperloom.sources import documents

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, filename, k, json, lines): an annotation in one of three public formats for each order."""
    i = doc_index(spark, d).withColumn("k", F.col("doc_id").cast("long"))
    item = lambda text, label, box=None: F.struct(text.alias("text"), F.lit(label).alias("label"), F.lit(box).cast("array<double>").alias("box"))
    sroie = F.to_json(F.struct(F.col("vendor").alias("company"), F.col("doc_date").alias("date"), F.when(F.col("k") % 2 == 0, F.col("priority")).alias("address")))
    cord = F.to_json(F.struct(F.col("vendor").alias("merchant"), F.col("k").alias("total"), F.array("priority").alias("tax"), F.struct("k").alias("date"), F.array(F.struct("k")).alias("menu")))
    funsd = F.to_json(F.struct(F.array(
        item(F.concat(F.lit("Order "), "doc_id"), "header", [5, 6]), item(F.lit("Full Name:"), "question", [1, 2, 3, 4]), item(F.col("vendor"), "answer"),
        item(F.lit(""), "other", [0, 0, 1, 1]), item(F.lit("FULL NAME?"), "question"), item(F.lit("??"), "question"),
    ).alias("form")))
    line = lambda c: F.struct(F.col(c).alias("text"), F.array(*map(F.lit, (0.0, 0.0, 9.0, 9.0))).alias("bbox"))
    made = F.when(F.col("k") % 3 == 0, sroie).when(F.col("k") % 3 == 1, cord).otherwise(funsd)
    return i.select("doc_id", "filename", "k", made.alias("json"), F.array(line("vendor"), line("doc_date")).alias("lines"))


@query(f"""WITH {INDEX_SQL}, k AS (SELECT *, CAST(doc_id AS BIGINT) AS k FROM idx), f AS (SELECT doc_id, k, unnest(CASE k % 3
    WHEN 0 THEN [('merchant', vendor), ('vendor', vendor), ('date', doc_date), ('address', CASE WHEN k % 2 = 0 THEN priority END)]
    WHEN 1 THEN [('merchant', vendor), ('total', doc_id)] ELSE [('order_' || doc_id, 'Order ' || doc_id), ('full_name', 'FULL NAME?')] END) AS f FROM k)
  SELECT doc_id, CASE k % 3 WHEN 2 THEN 'form' ELSE 'receipt' END AS doc_type, f[1] AS name, f[2] AS value, [2, 0, 5][k % 3 + 1] AS n_tokens FROM f WHERE f[1] <> 'address' OR k % 2 = 0""")
def label_adapters(spark, d):
    """Fields and tokens of every annotation: receipts with OCR lines, receipts with nested values, forms with questions asked twice."""
    rows = annotations(spark, d)
    parts = [
        documents.from_sroie(rows.where("k % 3 = 0").drop("k")), documents.from_cord(rows.where("k % 3 = 1").drop("k", "lines")),
        documents.from_funsd(rows.where("k % 3 = 2").drop("k", "lines")),
    ]
    made = reduce(DataFrame.unionByName, parts).select("doc_id", "doc_type", F.size("ocr").alias("n_tokens"), F.explode_outer("fields").alias("name", "f"))
    return made.select("doc_id", "doc_type", "name", "f.value", "n_tokens")


@query(f"""WITH {INDEX_SQL}, e AS (SELECT ['invoice', 'receipt', 'form', 'certificate'][k % 4 + 1] AS truth, k FROM (SELECT CAST(doc_id AS BIGINT) AS k FROM idx)),
p AS (SELECT 'rules' AS predictor, truth, CASE WHEN k % 10 = 0 OR truth = 'form' THEN 'unknown' ELSE truth END AS predicted FROM e
  UNION ALL SELECT 'model', truth, CASE WHEN k % 10 = 0 THEN 'unknown' ELSE truth END FROM e),
c AS (SELECT predictor, class, count(*) FILTER (truth = class AND predicted = class)::DOUBLE AS tp, count(*) FILTER (predicted = class)::DOUBLE AS found, count(*) FILTER (truth = class)::DOUBLE AS support
  FROM p, (SELECT unnest(['invoice', 'receipt', 'form', 'certificate', 'unknown']) AS class) GROUP BY predictor, class),
s AS (SELECT *, CASE WHEN found > 0 THEN tp / found ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, CASE WHEN found + support > 0 THEN 2 * tp / (found + support) ELSE 0 END AS f FROM c WHERE found + support > 0)
SELECT predictor, class, round(p, 4)::DOUBLE AS precision, round(r, 4)::DOUBLE AS recall, round(f, 4)::DOUBLE AS f1, support::BIGINT AS support FROM s
UNION ALL SELECT predictor, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 4), sum(support)::BIGINT FROM s GROUP BY predictor
UNION ALL SELECT predictor, 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(support)::BIGINT FROM s GROUP BY predictor
UNION ALL SELECT predictor, 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4), sum(support)::BIGINT FROM s GROUP BY predictor""")
def classifier_report(spark, d):
    """The rules beside the model on words that the rules know, that only the model knows, and that neither does."""
    k = F.col("doc_id").cast("long")
    said = F.when(k % 10 == 0, F.lit("Hello")).when(k % 4 == 0, F.concat(F.lit("Bill To "), "vendor", F.lit(" Subtotal Tax Balance Due"))).when(
        k % 4 == 1, F.lit("Cashier Change Due Thank You")).when(k % 4 == 2, F.lit("Full Name Date of Birth Check One Box")).otherwise(
        F.concat(F.lit("Awarded To "), "vendor", F.lit(" Authorized Signatory")))
    kind = F.element_at(F.array(*map(F.lit, ("invoice", "receipt", "form", "certificate"))), (k % 4 + 1).cast("int"))
    token = lambda w, i: F.struct(w.alias("text"), F.array(i * 10.0, F.lit(0.0), i * 10.0 + 9, F.lit(9.0)).alias("bbox"), F.lit(0.99).alias("conf"))
    docs = doc_index(spark, d).select(kind.alias("doc_type"), F.transform(F.split(said, " "), token).alias("ocr"))
    return metrics.class_report(classify.predictions(docs, classify.train(spark)), "predictor")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
