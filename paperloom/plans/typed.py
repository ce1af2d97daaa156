"""Registered queries over printed documents of five real kinds, made of orders, customers and their line items, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import metrics, validate
from paperloom.plans.catalog import Query
from paperloom.plans.process import process
from paperloom.plans.tables import AS_OF, INDEX_SQL, doc_index, table, tokens
from paperloom.sources.shared import saved

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def typed_text(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): an invoice, receipt, form, certificate or memo for each order, by its key.

    Invoices print their line items; every third has a total that these don't come to, every fourth of them a
    GSTIN in small letters.
    """
    index = doc_index(spark, d).select("doc_id", "vendor", "doc_date", "total_amount")
    money = lambda x: F.format_string("%.2f", x)
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("line"), money(F.col("l_extendedprice")).alias("amount"),
        F.concat_ws(" ", F.concat(F.lit("P"), "l_partkey"), F.col("l_quantity").cast("int"), F.lit("-"), F.lit("1.00")).alias("head"),
    )
    items = items.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("line", "amount", "head"))).alias("rows"), F.sum(F.col("amount").cast("decimal(14,2)")).alias("made"),
    )
    # dealt anew: the join's few bytes are put together into few tasks, and what follows costs by document
    rows = index.join(items, "doc_id", "left").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    k, day = F.col("doc_id").cast("long"), F.to_date("doc_date")
    made = F.coalesce("made", F.lit(0).cast("decimal(24,2)"))
    off = F.when(k % 3 == 0, 5).otherwise(0)
    none = F.array().cast("array<struct<line:int,amount:string,head:string>>")
    cells = F.transform(F.coalesce("rows", none), lambda r: F.concat_ws(" ", r["head"], r["amount"]))
    invoice = F.concat(
        F.array(
            F.lit("TAX INVOICE"), F.concat(F.lit("Invoice No: INV-"), "doc_id"), F.concat(F.lit("Date: "), F.date_format(day, "dd/MM/yyyy")),
            F.concat(F.lit("Bill To: "), "vendor"), F.when(k % 4 == 0, F.lit("GSTIN: 29abcde1234f1z5")).otherwise(F.lit("GSTIN: 29ABCDE1234F1Z5")),
            F.lit("Item Qty Unit Price Amount Notes"),
        ),
        cells, F.array(F.concat(F.lit("Subtotal: "), (made + off).cast("string")), F.concat(F.lit("Total: "), (made + off).cast("string"))),
    )
    comma = F.replace(money(F.col("total_amount") % 1000), F.lit("."), F.lit(","))
    receipt = F.array(
        F.lit("CORNER SHOP"), F.concat(F.lit("Receipt No: R-"), "doc_id"), F.date_format(day, "d.M.yyyy"), F.concat(F.lit("Total "), comma), F.lit("Paid by Debit Card Thank you"),
    )
    form = F.array(
        F.lit("APPLICATION FORM"), F.concat(F.lit("Applicant Name: "), "vendor"), F.lit("Date of Birth: 1990-01-02"), F.lit("PAN ABCDE1234F"), F.lit("Address - 12 High Street"),
    )
    certificate = F.array(
        F.lit("CERTIFICATE OF MERIT"), F.concat(F.lit("Certificate No: C-"), "doc_id"), F.concat(F.lit("Awarded To: "), "vendor"), F.date_format(day, "yyyy-MM-dd"), F.lit("Issued by Board of Trade"),
    )
    memo = F.array(F.lit("Hello World"), F.concat(F.lit("Memo "), "doc_id"))
    lines = F.when(k % 5 == 0, invoice).when(k % 5 == 1, receipt).when(k % 5 == 2, form).when(k % 5 == 3, certificate).otherwise(memo)
    return rows.select("doc_id", F.array_join(lines, "\n").alias("text"))


def results(spark: SparkSession, d: str) -> DataFrame:
    return process(tokens(typed_text(spark, d)), AS_OF)


TYPED_SQL = INDEX_SQL + f""",
li AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS line, l_partkey AS part, CAST(l_quantity AS INT) AS qty, printf('%.2f', l_extendedprice) AS amount FROM lineitem),
sums AS (SELECT doc_id, count(*) AS n, sum(CAST(amount AS DECIMAL(14,2))) AS made FROM li GROUP BY doc_id),
ty AS (SELECT idx.doc_id, CAST(idx.doc_id AS BIGINT) AS k, vendor, CAST(doc_date AS DATE) AS day, coalesce(n, 0) AS n, coalesce(made, 0) AS made,
    CAST(coalesce(made, 0) + CASE WHEN CAST(idx.doc_id AS BIGINT) % 3 = 0 THEN 5 ELSE 0 END AS DECIMAL(24,2)) AS shown, printf('%.2f', total_amount % 1000) AS paid FROM idx LEFT JOIN sums USING (doc_id)),
pd AS (SELECT *, ['invoice', 'receipt', 'form', 'certificate', 'unknown'][k % 5 + 1] AS kind,
    CASE k % 5 WHEN 0 THEN strftime(day, '%d/%m/%Y') WHEN 1 THEN strftime(day, '%-d.%-m.%Y') WHEN 2 THEN '1990-01-02' WHEN 3 THEN strftime(day, '%Y-%m-%d') END AS date FROM ty),
ck AS (SELECT *, k % 5 IN (0, 1, 3) AND day > DATE '{AS_OF}' AS future, k % 5 = 0 AND n > 0 AND k % 3 = 0 AS off,
    'Field ''date'' value ''' || date || ''' is in the future' AS late, 'Line items sum to ' || made::VARCHAR || ' but extracted total is ' || shown::VARCHAR AS sums FROM pd)"""


@query(f"""WITH {TYPED_SQL} SELECT doc_id, kind AS doc_type, CASE kind WHEN 'form' THEN 0.6 WHEN 'unknown' THEN 0.1 ELSE 0.8 END::DOUBLE AS doc_type_conf, future OR off AS needs_review,
  concat_ws(' | ', CASE WHEN future THEN late END, CASE WHEN off THEN sums END) AS messages,
  CASE WHEN kind = 'invoice' AND n > 0 THEN 'item,qty,unit price,amount' ELSE '' END AS headers, CASE WHEN kind = 'invoice' THEN n ELSE 0 END AS n_rows FROM ck""")
def process_typed(spark, d):
    """Five kinds of documents from tokens to validated results: invoices whose items come to the total, and others."""
    t = F.get("tables", F.lit(0))
    return results(spark, d).select(
        "doc_id", "doc_type", "doc_type_conf", "needs_review", F.array_join(F.transform("validation", lambda v: v["message"]), " | ").alias("messages"),
        F.coalesce(F.array_join(t["headers"], ","), F.lit("")).alias("headers"), F.coalesce(F.size(t["rows"]), F.lit(0)).cast("long").alias("n_rows"),
    )


@query(f"""WITH {TYPED_SQL}, f AS (SELECT doc_id, unnest(CASE kind
    WHEN 'invoice' THEN [('invoice_no', 'INV-' || k), ('receipt_no', 'To'), ('date', date), ('customer', vendor), ('gstin', CASE WHEN k % 4 = 0 THEN '29abcde1234f1z5' ELSE '29ABCDE1234F1Z5' END),
      ('subtotal', shown::VARCHAR), ('total', shown::VARCHAR)]
    WHEN 'receipt' THEN [('receipt_no', 'R-' || k), ('date', date), ('total', paid), ('payment_method', 'Debit Card'), ('vendor', 'CORNER SHOP'), ('merchant', 'CORNER SHOP')]
    WHEN 'form' THEN [('applicant_name', vendor), ('name', vendor), ('date', date), ('date_of_birth', date), ('pan', 'ABCDE1234F'), ('address', '12 High Street'),
      ('title', 'Application Form'), ('vendor', 'APPLICATION FORM'), ('merchant', 'APPLICATION FORM')]
    WHEN 'certificate' THEN [('certificate_id', 'C-' || k), ('awarded_to', vendor), ('date', date), ('issuer', 'Board of Trade'), ('issued_by', 'Board of Trade'),
      ('title', 'Certificate Of Merit'), ('vendor', 'CERTIFICATE OF MERIT'), ('merchant', 'CERTIFICATE OF MERIT')]
    ELSE [('vendor', 'Hello World'), ('merchant', 'Hello World')] END) AS f FROM ck)
  SELECT doc_id, f[1] AS name, f[2] AS value, 0.9::DOUBLE AS conf FROM f""")
def typed_fields(spark, d):
    """Every field found, with its value: patterns, labels, windows of labels, decimal commas, fallbacks, titles."""
    rows = results(spark, d).select("doc_id", F.explode_outer("fields").alias("name", "f")).where("f.value is not null")
    return rows.select("doc_id", "name", "f.value", "f.conf")


@query(f"""WITH {TYPED_SQL}, s AS (SELECT k, unnest(['invoice_no', 'receipt_no', 'certificate_id', 'date', 'subtotal', 'tax', 'total', 'gstin', 'pan', 'email', 'phone', 'issuer', 'payment_method',
    'vendor', 'customer', 'applicant_name', 'name', 'awarded_to', 'date_of_birth', 'address', 'merchant']) AS name FROM ck
  UNION ALL SELECT k, 'title' FROM ck WHERE kind IN ('form', 'certificate') UNION ALL SELECT k, 'issued_by' FROM ck WHERE kind = 'certificate')
  SELECT ['invoice', 'receipt', 'form', 'certificate', 'unknown'][k % 5 + 1] AS doc_type, name, count(*) AS n FROM s GROUP BY ALL""")
def typed_contract(spark, d):
    """The fields that each kind of document has, found or not."""
    rows = results(spark, d).select("doc_type", F.explode_outer(F.map_keys("fields")).alias("name"))
    return rows.groupBy("doc_type", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {TYPED_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, amount, part, qty) - 1 AS BIGINT) AS row, amount FROM li JOIN ck USING (doc_id) WHERE kind = 'invoice'""")
def typed_line_items(spark, d):
    """Rows under compound headers; the column of notes, in which nothing stands, is left out."""
    rows = results(spark, d).select("doc_id", F.explode_outer("tables").alias("t")).select("doc_id", F.posexplode_outer("t.rows").alias("row", "r")).where("r is not null")
    return rows.select("doc_id", F.col("row").cast("long").alias("row"), F.col("r")[3].alias("amount"))


@query(f"""WITH {TYPED_SQL} SELECT doc_id, concat_ws(' | ', CASE WHEN future THEN 'date_format: ' || late END,
    CASE WHEN kind = 'invoice' AND k % 4 = 0 THEN 'gstin_format: GSTIN ''29abcde1234f1z5'' does not match expected format' END, CASE WHEN off THEN 'line_items_sum' END) AS failed FROM ck""")
def typed_full_rules(spark, d):
    """The fuller rules: dates, GSTINs and sums of all kinds of documents."""
    made = validate.validate(results(spark, d).drop("validation", "needs_review"), AS_OF, validate.full_rules)
    shown = F.transform("validation", lambda v: F.when(v["rule"].startswith("line_items"), F.lit("line_items_sum")).otherwise(F.concat(v["rule"], F.lit(": "), v["message"])))
    return made.select("doc_id", F.array_join(shown, " | ").alias("failed"))


@query(f"""WITH {TYPED_SQL}, e AS (SELECT doc_id, CASE WHEN k % 7 = 0 THEN 'form' ELSE kind END AS truth, kind AS predicted,
    CASE kind WHEN 'invoice' THEN 1 WHEN 'receipt' THEN 1 WHEN 'certificate' THEN 1 ELSE 0 END AS tp, CASE kind WHEN 'invoice' THEN 6 WHEN 'receipt' THEN 5 WHEN 'form' THEN 9 WHEN 'certificate' THEN 7 ELSE 2 END AS fp,
    CASE kind WHEN 'receipt' THEN 0 WHEN 'form' THEN 2 WHEN 'unknown' THEN 2 ELSE 1 END AS fn, CASE kind WHEN 'invoice' THEN 8 WHEN 'receipt' THEN 6 WHEN 'form' THEN 9 WHEN 'certificate' THEN 8 ELSE 3 END AS keys,
    kind = 'receipt' AND NOT future AND k % 7 <> 0 AS stp FROM ck),
  o AS (SELECT count(*) AS documents, count(*) FILTER (stp) AS total_stp, round(100.0 * count(*) FILTER (stp) / count(*), 2) AS rate, round(avg((truth = predicted)::INT), 4) AS accuracy,
    sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, round(sum(tp) / sum(keys)::DOUBLE, 4) AS macro FROM e),
  c AS (SELECT c, count(*) FILTER (truth = c AND predicted = c) AS tp, count(*) FILTER (truth <> c AND predicted = c) AS fp, count(*) FILTER (truth = c AND predicted <> c) AS fn FROM e, (SELECT DISTINCT predicted AS c FROM e) GROUP BY c),
  s AS (SELECT c, round(tp / (tp + fp)::DOUBLE, 4) AS p, round(tp / (tp + fn)::DOUBLE, 4) AS r, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS f FROM c),
  u AS (SELECT 'overall' AS part, 'overall' AS name, unnest([('documents', documents::DOUBLE), ('total_stp', total_stp::DOUBLE), ('stp_rate_pct', rate::DOUBLE), ('cer', 0.0::DOUBLE), ('wer', 0.0::DOUBLE), ('accuracy', accuracy::DOUBLE),
      ('class_macro_f1', (SELECT round(avg(f), 4) FROM s)::DOUBLE), ('field_micro_f1', round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4)), ('field_macro_f1', macro::DOUBLE)]) AS m FROM o
    UNION ALL SELECT 'class', c, unnest([('precision', p), ('recall', r), ('f1', f)]) FROM s
    UNION ALL SELECT 'field', 'field', unnest([('tp', tp::DOUBLE), ('fp', fp::DOUBLE), ('fn', fn::DOUBLE), ('precision', round(tp / (tp + fp)::DOUBLE, 4)), ('recall', round(tp / (tp + fn)::DOUBLE, 4))]) FROM o)
  SELECT part, name, m[1] AS metric, m[2] AS value FROM u""")
def evaluation_typed(spark, d):
    """The whole report: five kinds of documents against labels of which every seventh has another type."""
    found = saved(results(spark, d), "found")
    k, kind = F.col("doc_id").cast("long"), F.col("doc_id").cast("long") % 5
    index = doc_index(spark, d).select("doc_id", "vendor", "doc_date")
    value = lambda v: F.struct(v.alias("value"), F.lit(1.0).alias("conf"), F.lit(None).cast("array<double>").alias("bbox"))
    vendor = F.create_map(F.lit("vendor"), value(F.when(kind == 1, F.lit("Corner  shop")).otherwise(F.col("vendor"))))
    fields = F.when(kind == 1, vendor).otherwise(F.map_concat(vendor, F.create_map(F.lit("date"), value(F.col("doc_date")))))
    names = F.array(*map(F.lit, ("invoice", "receipt", "form", "certificate", "unknown")))
    truth = index.withColumns({"fields": fields, "doc_type": F.when(k % 7 == 0, F.lit("form")).otherwise(F.element_at(names, (kind + 1).cast("int")))})
    truth = truth.join(found.select("doc_id", "ocr"), "doc_id").select("doc_id", "doc_type", "ocr", "fields")
    return metrics.evaluation(saved(truth, "truth"), found)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
