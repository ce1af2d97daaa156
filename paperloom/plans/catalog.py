"""Registered queries of the document engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import scalars as S
from paperloom.operators import classify as C
from paperloom.operators import fields as X
from paperloom.operators import layout as L
from paperloom.operators import lineitems, metrics, review, store, validate
from paperloom.plans.process import process
from paperloom.plans.tables import AS_OF, INDEX_SQL, TEXT_SQL, doc_index, invoice_tokens, table, text_lines
from paperloom.sources import documents as sources
from paperloom.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def over_index(body: str) -> str:
    return f"WITH {INDEX_SQL} {body}"


def over_text(body: str) -> str:
    return f"WITH {TEXT_SQL} {body}"


PAGE = "SELECT doc_id, filename, doc_type, vendor, doc_date, total_amount, needs_review, created_at FROM idx {} ORDER BY created_at DESC, doc_id DESC LIMIT {} OFFSET {}"


# Search and analytics over the index


@query(over_index(PAGE.format("WHERE doc_type = 'invoice'", 20, 0)))
def search_doc_type(spark, d):
    return store.search(doc_index(spark, d), doc_type="invoice")


@query(over_index(PAGE.format("WHERE needs_review", 20, 0)))
def search_needs_review(spark, d):
    return store.search(doc_index(spark, d), needs_review=True)


@query(over_index(PAGE.format("WHERE vendor ILIKE '%customer_0_0%'", 100, 0)))
def search_vendor_ilike(spark, d):
    return store.search(doc_index(spark, d), limit=100, vendor="CUSTOMER_0_0")


@query(over_index(PAGE.format("WHERE doc_date BETWEEN '1995-03-01' AND '1995-03-31'", 50, 0)))
def search_date_range(spark, d):
    return store.search(doc_index(spark, d), limit=50, date_from="1995-03-01", date_to="1995-03-31")


@query(over_index(PAGE.format("WHERE total_amount BETWEEN 1000 AND 50000", 50, 0)))
def search_amount_range(spark, d):
    return store.search(doc_index(spark, d), limit=50, min_amount=1000.0, max_amount=50000.0)


@query(over_index(PAGE.format("WHERE doc_type = 'receipt' AND NOT needs_review AND vendor ILIKE '%1%' AND total_amount >= 5000", 30, 0)))
def search_combined(spark, d):
    return store.search(doc_index(spark, d), limit=30, doc_type="receipt", needs_review=False, vendor="1", min_amount=5000.0)


@query(over_index(PAGE.format("WHERE result_json ILIKE '%urgent%'", 40, 0)))
def search_q_json(spark, d):
    return store.search(doc_index(spark, d), limit=40, q="urgent")


@query(over_index(PAGE.format("", 25, 75)))
def search_page_offset(spark, d):
    return store.search(doc_index(spark, d), limit=25, offset=75)


@query(over_index("SELECT count(*) AS total FROM idx WHERE doc_type = 'form' AND total_amount <= 100000"))
def search_total(spark, d):
    return store.search_total(doc_index(spark, d), doc_type="form", max_amount=100000.0)


@query(over_index("SELECT doc_id, vendor, total_amount FROM idx WHERE doc_id = '7'"))
def point_lookup(spark, d):
    return store.point_lookup(doc_index(spark, d), "7").select("doc_id", "vendor", "total_amount")


KPI = """SELECT count(*) AS total, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (NOT needs_review) AS stp,
  CASE WHEN count(*) = 0 THEN 100.0 ELSE round(100.0 * count(*) FILTER (NOT needs_review) / count(*), 2) END::DOUBLE AS stp_rate,
  round(coalesce(sum(total_amount), 0.0), 2) AS volume FROM idx"""


@query(over_index(KPI))
def kpi_summary(spark, d):
    return store.kpis(doc_index(spark, d))


@query(over_index(KPI + " WHERE doc_type = 'nothing'"))
def kpi_empty(spark, d):
    return store.kpis(doc_index(spark, d).where("doc_type = 'nothing'"))


@query(over_index("SELECT doc_type, count(*) AS n FROM idx GROUP BY doc_type"))
def kpi_type_distribution(spark, d):
    return store.type_distribution(doc_index(spark, d))


@query(over_index("SELECT vendor, count(*) AS n, round(sum(total_amount), 2) AS volume FROM idx GROUP BY vendor ORDER BY n DESC, vendor LIMIT 5"))
def kpi_top_vendors(spark, d):
    return store.top_vendors(doc_index(spark, d))


# Scalar functions

AMOUNT_TEXT = {
    0: "printf('%.2f', o_totalprice)", 1: "'$ ' || printf('%.2f', o_totalprice)", 2: "replace(printf('%.2f', o_totalprice), '.', ',')",
    3: "'1,' || printf('%.2f', o_totalprice)", 4: "'N/A'", 5: "'1.2.3'", 6: "'1.' || replace(printf('%.2f', o_totalprice), '.', ',')",
}
AMOUNT_SQL = "SELECT o_orderkey AS k, CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN {x}" for i, x in AMOUNT_TEXT.items()) + " END AS v FROM orders"


def _amount_texts(spark, d):
    p = F.format_string("%.2f", "o_totalprice")
    k = F.col("o_orderkey") % 7
    forms = [p, F.concat(F.lit("$ "), p), F.replace(p, F.lit("."), F.lit(",")), F.concat(F.lit("1,"), p), F.lit("N/A"), F.lit("1.2.3"), F.concat(F.lit("1."), F.replace(p, F.lit("."), F.lit(",")))]
    v = F.coalesce(*(F.when(k == i, f) for i, f in enumerate(forms)))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), v.alias("v"))


@query(f"""WITH t AS ({AMOUNT_SQL}), u AS (SELECT k, CASE WHEN contains(v, ',') AND contains(v, '.') THEN
    CASE WHEN strpos(reverse(v), ',') < strpos(reverse(v), '.') THEN replace(replace(v, '.', ''), ',', '.') ELSE replace(v, ',', '') END
    WHEN contains(v, ',') THEN CASE WHEN regexp_matches(v, ',\\d{{1,2}}$') THEN replace(v, ',', '.') ELSE replace(v, ',', '') END ELSE v END AS v FROM t)
    SELECT k, TRY_CAST(nullif(regexp_replace(v, '[^0-9.-]', '', 'g'), '') AS DOUBLE) AS amount FROM u""")
def parse_amount(spark, d):
    return _amount_texts(spark, d).select("k", S.parse_amount("v").alias("amount"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def parse_date_index(spark, d):
    fmt = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, fmt("yyyy-MM-dd")).when(k == 1, fmt("dd/MM/yyyy")).when(k == 2, fmt("d MMM yyyy")).otherwise(fmt("yyyy/MM/dd"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), S.index_date(v).alias("iso"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def parse_date_validation(spark, d):
    fmt = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, fmt("dd.MM.yyyy")).when(k == 1, fmt("d/M/yy")).when(k == 2, fmt("yyyy/MM/dd")).otherwise(fmt("d MMM yyyy"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.date_format(S.parse_date(v), "yyyy-MM-dd").alias("iso"))


@query("SELECT p_partkey AS k, trim(regexp_replace(lower('  ' || p_name || '   ' || p_type || ' '), '\\s+', ' ', 'g')) AS t FROM part")
def normalize_text(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), S.normalize_text(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("t"))


@query("""SELECT p_partkey AS k, list_reduce(list_transform(regexp_extract_all(p_name || '-' || p_type || '2nd', '[A-Za-z]+|[^A-Za-z]+'),
    lambda x: upper(x[1]) || lower(x[2:])), lambda a, b: a || b) AS t FROM part""")
def title_case(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), S.title_case(F.concat("p_name", F.lit("-"), "p_type", F.lit("2nd"))).alias("t"))


@query("SELECT p_partkey AS k, CAST(levenshtein(p_name, p_type) AS BIGINT) AS dist, round(levenshtein(trim(p_name), trim(p_type)) / length(trim(p_name))::DOUBLE, 4) AS cer FROM part")
def cer(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), F.levenshtein("p_name", "p_type").cast("long").alias("dist"), F.round(S.cer("p_name", "p_type"), 4).alias("cer"))


@query("SELECT p_partkey AS k, round(1.0 / len(string_split(p_name, ' '))::DOUBLE, 4) AS wer FROM part")
def wer(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), F.round(S.wer("p_name", F.regexp_replace("p_name", r"^\S+", "zzz")), 4).alias("wer"))


@query("SELECT k, NOT (m = 3) AS same FROM (SELECT o_orderkey AS k, o_orderkey % 4 AS m FROM orders)")
def fields_match(spark, d):
    m = F.col("o_orderkey") % 4
    p = F.format_string("%.2f", "o_totalprice")
    name = F.when(m == 0, "total").when(m == 1, "date").otherwise("vendor")
    a = F.when(m == 0, p).when(m == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("ACME  Traders"))
    b = F.when(m == 0, F.concat(F.lit("$ "), p)).when(m == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(m == 2, F.lit("acme traders ")).otherwise(F.lit("Acme"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), S.fields_match(name, a, b).alias("same"))


# Tokens, lines and layout


@query(over_text("SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i, j) AS t FROM (SELECT doc_id, i, unnest(string_split(l, ' ')) AS w, unnest(range(len(string_split(l, ' ')))) AS j FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM txt)) WHERE w <> '' GROUP BY doc_id"))
def tokens_full_text(spark, d):
    t = invoice_tokens(spark, d)
    return t.select("doc_id", F.size("ocr").cast("long").alias("n"), L.full_text(F.col("ocr")).alias("t"))


LINE_SQL = over_text("SELECT doc_id, CAST(i AS BIGINT) AS line, l AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM txt)")


@query(LINE_SQL)
def lines_mean(spark, d):
    rows = L.with_lines(invoice_tokens(spark, d)).select("doc_id", F.posexplode_outer("lines").alias("line", "l")).where("line is not null")
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), L.line_text(F.col("l")).alias("t"))


@query(LINE_SQL)
def lines_anchor(spark, d):
    rows = L.with_lines(invoice_tokens(spark, d), L.ANCHOR_TOLERANCE, by_mean=False).select("doc_id", F.posexplode_outer("lines").alias("line", "l")).where("line is not null")
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), L.line_text(F.col("l")).alias("t"))


WORD_SQL = TEXT_SQL + """, word AS (SELECT doc_id, i, j, w FROM (SELECT doc_id, i, unnest(string_split(l, ' ')) AS w, unnest(range(len(string_split(l, ' ')))) AS j
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM txt)) WHERE w <> '')"""


@query(f"""WITH {WORD_SQL} SELECT doc_id, count(*) FILTER (20 * i + 12 + j % 3 <= 30) AS header, count(*) FILTER (20 * i + 12 + j % 3 > 30 AND 20 * i + j % 3 < 170) AS body,
  count(*) FILTER (20 * i + 12 + j % 3 > 30 AND 20 * i + j % 3 >= 170) AS footer FROM word GROUP BY doc_id""")
def regions(spark, d):
    r = L.regions(invoice_tokens(spark, d), 200.0)
    return r.select("doc_id", *(F.size(c).cast("long").alias(c) for c in ("header", "body", "footer")))


@query(f"""WITH {WORD_SQL}, m AS (SELECT doc_id, i, max(j) AS mx FROM word GROUP BY ALL),
  f AS (SELECT doc_id, i, min(j) AS first FROM word JOIN m USING (doc_id, i) WHERE w LIKE '%:' AND j < mx GROUP BY ALL)
  SELECT doc_id, trim(rtrim(any_value(w) FILTER (j = first), ':')) AS key, string_agg(w, ' ' ORDER BY j) FILTER (j > first) AS val
  FROM word JOIN f USING (doc_id, i) GROUP BY doc_id, i""")
def key_value_pairs(spark, d):
    rows = L.with_lines(invoice_tokens(spark, d), L.ANCHOR_TOLERANCE, by_mean=False)
    return rows.select("doc_id", F.explode_outer(L.key_values(F.col("lines"))).alias("key", "val")).where("key is not null")


@query(f"""WITH {WORD_SQL} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i FROM word GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (w LIKE '%:') = 0) GROUP BY doc_id""")
def table_rows_min3(spark, d):
    rows = L.with_lines(invoice_tokens(spark, d), L.ANCHOR_TOLERANCE, by_mean=False)
    return rows.select("doc_id", F.size(L.table_rows(F.col("lines"))).cast("long").alias("n"))


# Classification

RULE_SQL = "CASE WHEN " + " ELSE 'unknown' END AS doc_type".join([" WHEN ".join(
    "(" + " OR ".join(f"contains(lower(text), '{k}')" for k in ks) + f") THEN '{kind}'"
    for kind, ks in (("invoice", C.INVOICE), ("receipt", C.RECEIPT), ("certificate", C.CERTIFICATE), ("form", C.FORM))
), ""])


@query(f"SELECT doc_type, count(*) AS n FROM (SELECT {RULE_SQL} FROM documents) GROUP BY doc_type")
def classify_rules(spark, d):
    docs = table(spark, d, "documents").select(C.rules(F.coalesce("text", F.lit("")), F.lit(True))["doc_type"].alias("doc_type"))
    return docs.groupBy("doc_type").agg(F.count("*").alias("n"))


@query(over_text("SELECT count(*) FILTER (regexp_matches(lower(text), 'total|subtotal|tax|amount|price|eur|\\$')) AS financial, count(*) AS n FROM txt"))
def classify_financial(spark, d):
    t = text_lines(spark, d)
    return t.agg(F.count_if(C.is_financial(F.col("text"))).alias("financial"), F.count("*").alias("n"))


@query()
def classify_model(spark, d):
    made = C.classify(invoice_tokens(spark, d), C.train(spark))
    return made.groupBy("doc_type", "doc_type_conf").agg(F.count("*").alias("n"))


@query(f"""SELECT label, sum((doc_type = 'invoice')::INT)::BIGINT AS invoice, sum((doc_type = 'receipt')::INT)::BIGINT AS receipt, sum((doc_type = 'form')::INT)::BIGINT AS form,
  sum((doc_type = 'certificate')::INT)::BIGINT AS certificate, sum((doc_type = 'unknown')::INT)::BIGINT AS unknown
  FROM (SELECT lang AS label, {RULE_SQL} FROM documents) GROUP BY label""")
def confusion_matrix(spark, d):
    docs = table(spark, d, "documents")
    return C.confusion(docs.select(F.col("lang").alias("label"), C.rules(F.coalesce("text", F.lit("")), F.lit(True))["doc_type"].alias("predicted")))


# Fields and tables


@query("SELECT doc_id, nullif(regexp_extract(text, '([a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})', 1), '') AS email FROM documents")
def field_email(spark, d):
    return table(spark, d, "documents").select("doc_id", X.by_pattern(F.col("text"), "email").alias("email"))


@query("SELECT doc_id, nullif(regexp_extract(text, '(?:\\+?[0-9]{1,3}[-. \\t\\r\\n]?)?([0-9]{10})', 1), '') AS phone FROM documents")
def field_phone(spark, d):
    return table(spark, d, "documents").select("doc_id", X.by_pattern(F.col("text"), "phone").alias("phone"))


@query(over_text("SELECT doc_id, nullif(regexp_extract(text, '\\b(\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4}|\\d{4}[/.-]\\d{1,2}[/.-]\\d{1,2})\\b', 1), '') AS date FROM txt"))
def field_date(spark, d):
    return text_lines(spark, d).select("doc_id", X.by_pattern(F.col("text"), "date").alias("date"))


@query(over_text("SELECT doc_id, 'INV-' || doc_id AS invoice_no, nullif(regexp_extract(text, 'Subtotal: ([0-9.]+)', 1), '') AS subtotal, nullif(regexp_extract(text, 'Tax: . ([0-9.]+)', 1), '') AS tax, coalesce(nullif(regexp_extract(text, '\\nTotal: ([0-9.]+)', 1), ''), NULL) AS total FROM txt"))
def field_amounts(spark, d):
    t = text_lines(spark, d)
    return t.select("doc_id", *(X.by_pattern(F.col("text"), n).alias(n) for n in ("invoice_no", "subtotal", "tax", "total")))


@query(over_index("SELECT doc_id, vendor FROM idx"))
def label_anchor(spark, d):
    rows = L.with_lines(invoice_tokens(spark, d))
    return rows.select("doc_id", X.label_values(X.labelled_lines(F.col("lines")))["vendor"].alias("vendor"))


@query(over_text("SELECT doc_id, CASE CAST(doc_id AS BIGINT) % 5 WHEN 0 THEN 'Vendor: ' || vendor WHEN 1 THEN 'Vendor: ' || vendor WHEN 2 THEN 'APPLICATION FORM' WHEN 3 THEN 'CERTIFICATE OF COMPLETION' ELSE 'Memo' END AS guess FROM idx"))
def vendor_heuristic(spark, d):
    return L.with_lines(invoice_tokens(spark, d)).select("doc_id", X.vendor_guess(F.col("lines")).alias("guess"))


@query(over_text("SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 4 = 0 THEN 'Visa Card' END AS payment FROM idx"))
def payment_fallback(spark, d):
    return text_lines(spark, d).select("doc_id", X.payment_guess(F.col("text")).alias("payment"))


@query(over_text("SELECT doc_id, CASE CAST(doc_id AS BIGINT) % 5 WHEN 2 THEN 'Application Form' WHEN 3 THEN 'Certificate Of Completion' END AS title FROM idx"))
def title_field(spark, d):
    return L.with_lines(invoice_tokens(spark, d)).select("doc_id", X.title(F.col("lines")).alias("title"))


@query(over_index("SELECT doc_id, CAST(21 + CASE WHEN CAST(doc_id AS BIGINT) % 5 IN (2, 3) THEN 1 ELSE 0 END AS BIGINT) AS n FROM idx"))
def extract_fields(spark, d):
    made = X.extract_fields(L.with_lines(invoice_tokens(spark, d)))
    return made.select("doc_id", F.size("fields").cast("long").alias("n"))


@query(over_text("SELECT doc_id, 'item,qty,price,amount' AS headers, 'Widget,2,10.00,' || regexp_extract(text, 'Subtotal: ([0-9.]+)', 1) AS first_row, CAST(1 AS BIGINT) AS n FROM txt"))
def line_item_tables(spark, d):
    made = lineitems.extract_tables(L.with_lines(invoice_tokens(spark, d)))
    t = F.col("tables")[0]
    return made.select("doc_id", F.array_join(t["headers"], ",").alias("headers"), F.array_join(t["rows"][0], ",").alias("first_row"), F.size(t["rows"]).cast("long").alias("n"))


@query(over_index("SELECT doc_id, CAST(5 AS BIGINT) AS header_line FROM idx"))
def header_line(spark, d):
    rows = L.with_lines(invoice_tokens(spark, d))
    return rows.select("doc_id", lineitems.header_index(F.col("lines")).cast("long").alias("header_line"))


# Validation, storage, correction


def _results(spark, d, *more: str):
    """Orders with their lines as results: fields and one table. more: columns of the index to keep."""
    i = doc_index(spark, d)
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), "l_linenumber",
        F.format_string("%.2f", "l_extendedprice").alias("amount"),
    )
    rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "amount"))).alias("r"))
    i = i.join(rows, "doc_id", "left")
    field = lambda v, c=0.9: F.struct(v.alias("value"), F.lit(c).alias("conf"), F.lit(None).cast("array<double>").alias("bbox"))
    key = F.col("doc_id").cast("long")
    number = F.when(key % 6 != 0, F.concat(F.lit("INV-"), "doc_id"))
    total = F.format_string("%.2f", "total_amount")
    fields = F.map_from_arrays(
        F.array(*map(F.lit, ("invoice_no", "date", "total", "vendor"))),
        F.array(field(number), field(F.col("doc_date")), field(total), F.struct(F.col("vendor").alias("value"), F.when(key % 11 == 0, 0.5).otherwise(0.9).alias("conf"), F.lit(None).cast("array<double>").alias("bbox"))),
    )
    cells = F.transform(F.coalesce("r", F.array().cast("array<struct<l_linenumber:int,amount:string>>")), lambda x: F.array(x["l_linenumber"].cast("string"), x["amount"]))
    one = F.struct(F.array(F.lit("line"), F.lit("amount")).alias("headers"), cells.alias("rows"))
    return i.select(
        "doc_id", "filename", "doc_type", F.lit(0.8).alias("doc_type_conf"), F.array().cast(L.TOKENS).alias("ocr"), fields.alias("fields"),
        F.array(one).alias("tables"), *more,
    )


VALID_SQL = INDEX_SQL + f""", li AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, sum(CAST(printf('%.2f', l_extendedprice) AS DOUBLE)) AS s FROM lineitem GROUP BY ALL),
v AS (SELECT idx.*, CAST(doc_id AS BIGINT) % 6 = 0 AND doc_type = 'invoice' AS missing, doc_date > '{AS_OF}' AS future, abs(coalesce(s, 0) - total_amount) > 1.0 AS off, CAST(doc_id AS BIGINT) % 11 = 0 AS low
  FROM idx LEFT JOIN li USING (doc_id))"""


@query(f"WITH {VALID_SQL} SELECT doc_type, count(*) FILTER (missing) AS required_fields, count(*) FILTER (future) AS date_validity, count(*) FILTER (off) AS line_items_sum, count(*) FILTER (missing OR future OR off OR low) AS needs_review FROM v GROUP BY doc_type")
def validation_rules(spark, d):
    made = validate.validate(_results(spark, d), AS_OF)
    has = lambda r: F.count_if(F.exists("validation", lambda v: v["rule"] == r)).alias(r)
    return made.groupBy("doc_type").agg(*(has(r) for r in ("required_fields", "date_validity", "line_items_sum")), F.count_if("needs_review").alias("needs_review"))


@query(f"WITH {VALID_SQL} SELECT doc_id, missing OR future OR low AS needs_review FROM v")
def validation_compat(spark, d):
    return validate.validate(_results(spark, d), AS_OF, compat=True).select("doc_id", "needs_review")


@query(f"WITH {VALID_SQL} SELECT doc_id, low FROM v")
def low_confidence(spark, d):
    return _results(spark, d).select("doc_id", validate.low_confidence().alias("low"))


@query("""SELECT doc_id, k % 3 = 0 AS ok, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN (k % 100)::DOUBLE || '+' || 2.5 || '!=' || (k % 100 + 3)::DOUBLE ELSE 'missing subtotal/tax/total' END AS message
  FROM (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)""")
def total_matches(spark, d):
    k = F.col("doc_id").cast("long")
    value = lambda v: F.struct(v.alias("value"), F.lit(0.9).alias("conf"), F.lit(None).cast("array<double>").alias("bbox"))
    part, total = (k % 100).cast("string"), F.when(k % 3 == 0, k % 100 + 2.5).when(k % 3 == 1, (k % 100 + 3).cast("double"))
    fields = F.map_from_arrays(F.array(*map(F.lit, ("subtotal", "tax", "total"))), F.array(value(part), value(F.lit("2.5")), value(total.cast("string"))))
    made = doc_index(spark, d).select("doc_id", fields.alias("fields")).select("doc_id", validate.total_matches().alias("r"))
    return made.select("doc_id", F.col("r").isNull().alias("ok"), F.coalesce("r.message", F.lit("")).alias("message"))


@query(f"WITH {VALID_SQL} SELECT count(*) FILTER (doc_type = 'form') AS no_name, count(*) FILTER (future) AS bad_dates, count(*) FILTER (off AND doc_type = 'invoice') AS bad_sums FROM v")
def validation_full_rules(spark, d):
    made = validate.validate(_results(spark, d), AS_OF, validate.full_rules)
    has = lambda r, m="": F.count_if(F.exists("validation", lambda v: (v["rule"] == r) & F.contains(v["message"], F.lit(m))))
    return made.agg(has("required_fields", "'name'").alias("no_name"), has("date_format").alias("bad_dates"), has("line_items_complete").alias("bad_sums"))


@query(over_index("SELECT doc_id, unnest(['invoice_no', 'date', 'total', 'vendor']) AS name, unnest([CASE WHEN CAST(doc_id AS BIGINT) % 6 <> 0 THEN 'INV-' || doc_id END, doc_date, printf('%.2f', total_amount), vendor]) AS value FROM idx"))
def explode_fields(spark, d):
    return store.field_rows(_results(spark, d)).select("doc_id", "name", "value")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, printf('%.2f', l_extendedprice)) - 1 AS BIGINT) AS row_index, printf('%.2f', l_extendedprice) AS amount FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)")
def explode_line_items(spark, d):
    rows = store.line_item_rows(_results(spark, d))
    return rows.select("doc_id", F.col("row_index").cast("long").alias("row_index"), F.col("data")["amount"].alias("amount"))


@query(over_index("SELECT doc_id, vendor, doc_date, total_amount FROM idx"))
def index_summary(spark, d):
    return store.index_rows(_results(spark, d)).select("doc_id", "vendor", "doc_date", "total_amount")


@query(over_index("SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN 'changed' ELSE vendor END AS vendor, created_at FROM idx"))
def upsert_result(spark, d):
    stored = doc_index(spark, d)
    new = stored.where("cast(doc_id as long) % 3 = 0").withColumns({"vendor": F.lit("changed"), "created_at": F.lit("2030-01-01 00:00:00")})
    return store.upsert(stored, new).select("doc_id", "vendor", "created_at")


@query(f"WITH {VALID_SQL} SELECT doc_id, 'INV-fixed' AS invoice_no, total_amount AS total, future OR off OR low AS needs_review FROM v WHERE CAST(doc_id AS BIGINT) % 6 = 0")
def patch_fields(spark, d):
    made = validate.validate(_results(spark, d), AS_OF)
    fix = made.where("cast(doc_id as long) % 6 = 0").select("doc_id", F.lit("invoice_no").alias("name"), F.lit("INV-fixed").alias("value"))
    out = store.correct(made, fix, AS_OF)
    return out.select("doc_id", F.col("fields")["invoice_no"]["value"].alias("invoice_no"), S.parse_amount(F.col("fields")["total"]["value"]).alias("total"), "needs_review")


@query(over_index("SELECT doc_id, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'empty') AS empty, count(*) FILTER (s = 'low') AS low FROM (SELECT doc_id, unnest([CASE WHEN CAST(doc_id AS BIGINT) % 6 <> 0 THEN 'ok' WHEN doc_type = 'invoice' THEN 'empty' END, 'ok', 'ok', CASE WHEN CAST(doc_id AS BIGINT) % 11 = 0 THEN 'low' ELSE 'ok' END]) AS s FROM idx) GROUP BY doc_id"))
def review_status(spark, d):
    rows = review.review_fields(_results(spark, d))
    return rows.groupBy("doc_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "empty", "low")))


# Evaluation


def _field_pairs(spark, d):
    i = doc_index(spark, d)
    k = F.col("doc_id").cast("long")
    names = {"vendor": F.col("vendor"), "total": F.format_string("%.2f", "total_amount"), "date": F.when(k % 9 != 0, F.col("doc_date"))}
    wrong = {"vendor": F.when(k % 4 == 0, F.lit("someone")).otherwise(F.upper("vendor")), "total": F.when(k % 5 != 0, F.concat(F.lit("$ "), names["total"])), "date": F.col("doc_date")}
    rows = lambda m: i.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in m.items()))).alias("f")).select("doc_id", "f.name", "f.value")
    return rows(names), rows(wrong)


COUNT_SQL = INDEX_SQL + """, c AS (SELECT k, n, CASE n WHEN 'vendor' THEN (k % 4 <> 0)::INT WHEN 'total' THEN (k % 5 <> 0)::INT ELSE (k % 9 <> 0)::INT END AS tp,
  CASE n WHEN 'vendor' THEN (k % 4 = 0)::INT WHEN 'total' THEN 0 ELSE (k % 9 = 0)::INT END AS fp,
  CASE n WHEN 'vendor' THEN (k % 4 = 0)::INT WHEN 'total' THEN (k % 5 = 0)::INT ELSE 0 END AS fn
  FROM (SELECT CAST(doc_id AS BIGINT) AS k, unnest(['vendor', 'total', 'date']) AS n FROM idx)),
f AS (SELECT n AS name, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY n),
s AS (SELECT name, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall,
  round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 4) AS f1 FROM f)"""


@query(f"WITH {COUNT_SQL} SELECT * FROM s")
def prf_per_field(spark, d):
    return metrics.field_scores(metrics.field_counts(*_field_pairs(spark, d)))


@query(f"WITH {COUNT_SQL}, t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(f1), 4) AS macro_f1 FROM s) SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS micro_f1, macro_f1 FROM t")
def prf_micro_macro(spark, d):
    return metrics.overall_scores(metrics.field_counts(*_field_pairs(spark, d)))


def _class_pairs(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("truth"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("string").alias("predicted"))


CLASS_SQL = """p AS (SELECT CAST(label AS VARCHAR) AS t, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS VARCHAR) AS p FROM embeddings),
k AS (SELECT c AS class, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t <> c AND p = c) AS fp, count(*) FILTER (t = c AND p <> c) AS fn
  FROM p, (SELECT DISTINCT t AS c FROM p UNION SELECT DISTINCT p FROM p) GROUP BY c),
s AS (SELECT class, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 4) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 4) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) ELSE 0.0 END AS f1 FROM k)"""


@query(f"WITH {CLASS_SQL} SELECT * FROM s")
def class_metrics(spark, d):
    return metrics.class_scores(_class_pairs(spark, d))


@query(f"WITH {CLASS_SQL} SELECT round(sum(tp) / (sum(tp) + sum(fn))::DOUBLE, 4) AS accuracy, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1 FROM s")
def class_overall(spark, d):
    return metrics.class_overall(_class_pairs(spark, d))


# Sources, streaming and the whole pipeline


@query()
def benchmark_scores(spark, d):
    truth = sources.benchmark(spark)
    made = process(truth.select("doc_id", "filename", "ocr"), "2027-01-01")
    return metrics.corpus_scores(truth, made)


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = windowed_counts(table(spark, d, "events"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("value", 2).alias("value"))


@query(f"""WITH {TEXT_SQL}, t AS (SELECT idx.*, CAST(doc_id AS BIGINT) AS k, round(total_amount / 1.18, 2) AS sub FROM idx),
  u AS (SELECT *, round(total_amount - sub, 2) AS tax, strptime(doc_date, '%Y-%m-%d') > TIMESTAMP '{AS_OF}' AS future FROM t)
  SELECT doc_id, 'invoice' AS doc_type, 0.8::DOUBLE AS doc_type_conf, 'INV-' || doc_id AS invoice_no, vendor,
    CASE WHEN k % 3 = 0 THEN strftime(CAST(doc_date AS DATE), '%d/%m/%Y') ELSE doc_date END AS date, printf('%.2f', sub) AS subtotal, printf('%.2f', tax) AS tax,
    CASE WHEN k % 7 <> 0 THEN printf('%.2f', total_amount) END AS total, CASE WHEN k % 4 = 0 THEN 'Visa Card' END AS payment_method, 1::INT AS n_tables FROM u""")
def process_documents(spark, d):
    made = process(invoice_tokens(spark, d), AS_OF)
    return made.select(
        "doc_id", "doc_type", "doc_type_conf", *(F.col("fields")[n]["value"].alias(n) for n in ("invoice_no", "vendor", "date", "subtotal", "tax", "total", "payment_method")),
        F.size("tables").alias("n_tables"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to results to KPIs by type."""
    made = process(invoice_tokens(spark, sf_dir), AS_OF)
    rows = store.index_rows(made)
    return rows.groupBy("doc_type").agg(
        F.count("*").alias("n"), F.count_if("needs_review").alias("needs_review"),
        F.round(F.sum(F.col("total_amount")), 2).alias("volume"),
    )


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
