"""Inputs of the registered queries, derived from the driver's tables; SQL texts of the same for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.layout import TOKENS

TYPES = ("invoice", "receipt", "form", "certificate", "unknown")
AS_OF = "1997-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers as an index of documents."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    amount = F.round("o_totalprice", 2)
    made = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("doc_id"), F.format_string("order_%d.pdf", "o_orderkey").alias("filename"),
        kind.alias("doc_type"), F.col("c_name").alias("vendor"), day.alias("doc_date"), amount.alias("total_amount"),
        (F.col("o_orderstatus") == "P").alias("needs_review"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.col("o_orderpriority").alias("priority"),
    )
    body = F.concat(F.lit('{"doc_id":"'), "doc_id", F.lit('","vendor":"'), "vendor", F.lit('","priority":"'), "priority", F.lit('"}'))
    return made.withColumn("result_json", body)


INDEX_SQL = """
idx AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'order_' || o_orderkey || '.pdf' AS filename,
    CASE o_orderkey % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'form' WHEN 3 THEN 'certificate' ELSE 'unknown' END AS doc_type,
    c_name AS vendor, strftime(o_orderdate, '%Y-%m-%d') AS doc_date, round(o_totalprice, 2) AS total_amount,
    o_orderstatus = 'P' AS needs_review, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, o_orderpriority AS priority,
    '{"doc_id":"' || o_orderkey || '","vendor":"' || c_name || '","priority":"' || o_orderpriority || '"}' AS result_json
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a printed document for each order, its form chosen by the key."""
    i = doc_index(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    if table(spark, sf_dir, "orders").rdd.getNumPartitions() < cores:  # one small file: one task would do it all
        i = i.repartition(cores)
    money = lambda x: F.format_string("%.2f", x)
    sub, tax = F.round(F.col("total_amount") / 1.18, 2), F.round(F.col("total_amount") - F.round(F.col("total_amount") / 1.18, 2), 2)
    key = F.col("doc_id").cast("long")
    head = F.when(key % 5 == 0, F.lit("INVOICE")).when(key % 5 == 1, F.lit("Store Receipt")).when(key % 5 == 2, F.lit("APPLICATION FORM")).when(
        key % 5 == 3, F.lit("CERTIFICATE OF COMPLETION")).otherwise(F.lit("Memo"))
    lines = F.array(
        head, F.concat(F.lit("Vendor: "), "vendor"), F.concat(F.lit("Invoice No: INV-"), "doc_id"),
        F.concat(F.lit("Date: "), F.when(key % 3 == 0, F.date_format(F.to_date("doc_date"), "dd/MM/yyyy")).otherwise(F.col("doc_date"))),
        F.lit("Item Qty Price Amount"), F.concat(F.lit("Widget 2 10.00 "), money(sub)),
        F.concat(F.lit("Subtotal: "), money(sub)), F.concat(F.lit("Tax: $ "), money(tax)),
        F.when(key % 7 == 0, F.lit("Thank you")).otherwise(F.concat(F.lit("Total: "), money(F.col("total_amount")))),
        F.when(key % 4 == 0, F.lit("Paid by Visa Card")).otherwise(F.lit("Contact: desk.1@example.com")),
    )
    return i.select("doc_id", F.array_join(lines, "\n").alias("text"))


TEXT_SQL = INDEX_SQL + """,
txt AS (
  SELECT doc_id, array_to_string([
    CASE k % 5 WHEN 0 THEN 'INVOICE' WHEN 1 THEN 'Store Receipt' WHEN 2 THEN 'APPLICATION FORM' WHEN 3 THEN 'CERTIFICATE OF COMPLETION' ELSE 'Memo' END,
    'Vendor: ' || vendor, 'Invoice No: INV-' || doc_id,
    'Date: ' || CASE WHEN k % 3 = 0 THEN strftime(CAST(doc_date AS DATE), '%d/%m/%Y') ELSE doc_date END,
    'Item Qty Price Amount', 'Widget 2 10.00 ' || printf('%.2f', sub), 'Subtotal: ' || printf('%.2f', sub),
    'Tax: $ ' || printf('%.2f', round(total_amount - sub, 2)),
    CASE WHEN k % 7 = 0 THEN 'Thank you' ELSE 'Total: ' || printf('%.2f', total_amount) END,
    CASE WHEN k % 4 = 0 THEN 'Paid by Visa Card' ELSE 'Contact: desk.1@example.com' END], chr(10)) AS text
  FROM (SELECT *, CAST(doc_id AS BIGINT) AS k, round(total_amount / 1.18, 2) AS sub FROM idx))
"""


def tokens(texts: DataFrame) -> DataFrame:
    """(doc_id, filename, ocr): a token for each word, lines 20 px apart, with a jitter within the tolerance."""
    line = F.split("text", "\n")

    def words(l, i):
        return F.transform(
            F.filter(F.split(l, " "), lambda w: w != ""),
            lambda w, j: F.struct(
                w.alias("text"),
                F.array(10 * j, 20 * i + j % 3, 10 * j + 8, 20 * i + 12 + j % 3).alias("bbox"),  # cast below, all at once
                F.lit(0.95).alias("conf"),
            ),
        )

    ocr = F.flatten(F.transform(line, words)).cast(TOKENS)
    return texts.select("doc_id", F.concat("doc_id", F.lit(".png")).alias("filename"), ocr.alias("ocr"))


def invoice_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(text_lines(spark, sf_dir))
