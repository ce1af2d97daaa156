from pyspark.sql import functions as F

from paperloom.operators import fields as X
from paperloom.operators import layout as L
from paperloom.operators import lineitems
from paperloom.plans.process import process
from paperloom.plans.tables import AS_OF, tokens

TEXTS = (
    "Invoice No: INV-7\nTotal: 12,50\nvat $ 3.00 a@@b.co x.y+z@q-r.org 1995-03-01 Paid by Cash total", "GRAND TOTAL 5", "ſubtotal: 7.00 ßtotal 8", "İnvoice # 9 bıll no 4",
    "receipt nº 12", "reciBo 3", "Kticket 5", "payment method: Visa date", "PAID WITH apple\x1cdate", "29ABCDE1234F1Z5 ABCDE1234F", "+91-9876543210 ٣٤/٠١/٢٠٢٠", "issuer: A & B", "Issued By Nobody",
    "via cash\x85 total", "ṃ@b.co a.@c.dd %@e.ff", "..@x.yy", "a@b a@b.c a@b.cd", "", "Amount Due: 1,000", "certificate #: C-1", "fatura/recibo 8", "gst 1 iva 2", "inv-12 INV-",
)


def test_patterns_find_the_same_with_and_without_unicode_classes(spark):
    df = spark.createDataFrame([(t,) for t in (*TEXTS, *(t + " é" for t in TEXTS), *(t.upper() for t in TEXTS), *(t.replace("\n", " ") for t in TEXTS))], "t string")

    def plain(n):
        hits = [F.nullif(F.regexp_extract("t", "(?iU)" + X.PATTERNS[n], g), F.lit("")) for g in range(1, 3 if n == "invoice_no" else 2)]
        v = F.trim(F.coalesce(*hits))
        return F.when(v.rlike(r"^\d+,\d{2}$"), F.replace(v, F.lit(","), F.lit("."))).otherwise(v) if n in ("subtotal", "tax", "total") else v

    for n in X.PATTERNS:
        got = df.select("t", X.by_pattern(F.col("t"), n).alias("a"), plain(n).alias("b")).collect()
        assert [r for r in got if r.a != r.b] == [], n


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_lines_are_made_once(spark):
    docs = tokens(spark.createDataFrame([("1", "INVOICE\nItem Qty Price\na 1 2.00\nTotal: 2.00")], "doc_id string, text string"))
    lined = spark.createDataFrame(L.with_lines(docs).select("doc_id", "lines").collect(), L.with_lines(docs).select("doc_id", "lines").schema)
    assert _plan(lined.select(lineitems.header_index(F.col("lines")))).count("array_join(") <= 2  # 39 before
    assert _plan(lined.select(L.key_values(F.col("lines")))).count("array_position(") <= 2
    assert "array_sort(" not in _plan(process(docs, AS_OF).select("fields", "tables"))
