from pyspark.sql import functions as F

from paperloom.operators import fields as X
from paperloom.operators import layout as L
from paperloom.operators.layout import TOKENS


def _docs(spark, pages):
    """Pages of (x, y, text)."""
    rows = [(d, [(t, [float(x), float(y), float(x) + 8, float(y) + 12], 1.0) for x, y, t in words]) for d, words in pages.items()]
    return spark.createDataFrame(rows, f"doc_id string, ocr {TOKENS}")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_read_each_word_once(spark):
    docs = _docs(spark, {"a": [(30, 0, "c"), (0, 0, "a"), (0, 100, "z"), (10, 2, "b")], "b": []})
    made = L.with_lines(docs)
    assert "slice(" not in _plan(made)  # read all words of the page for each line
    assert {r.doc_id: [[w.text for w in line] for line in r.lines] for r in made.collect()} == {"a": [["a", "b", "c"], ["z"]], "b": []}


def test_fields_that_are_always_there_are_not_filtered(spark):
    docs = L.with_lines(_docs(spark, {"a": [(0, 0, "FORM"), (0, 40, "Name:"), (10, 40, "Ann")]}))
    assert "map_from_entries(concat(array(" in _plan(X.extract_fields(docs).select("fields"))


def test_only_lines_with_a_label_are_taken_apart(spark):
    pages = {
        "apart": [(30, 40, "Ann"), (10, 40, "To:"), (0, 40, "BILL"), (0, 80, "none")],  # in line order, not in token order
        "whole": [(0, 0, "Awarded To:"), (50, 0, "Bo"), (0, 40, "Date of Birth: 1990-01-02")],
        "none": [(0, 0, "Hello"), (0, 40, "World")],
    }
    docs = L.with_lines(_docs(spark, pages))
    kept = {r.doc_id: [x.low for x in r.f] for r in docs.select("doc_id", X.labelled_lines(F.col("lines")).alias("f")).collect()}
    assert kept == {"apart": ["bill to: ann"], "whole": ["awarded to: bo", "date of birth: 1990-01-02"], "none": []}
    got = {r.doc_id: {k: v.value for k, v in r.fields.items() if k in ("customer", "awarded_to", "date_of_birth", "vendor")} for r in X.extract_fields(docs).collect()}
    assert got["apart"] == {"customer": "Ann", "awarded_to": None, "date_of_birth": None, "vendor": "BILL To: Ann"}
    assert got["whole"] == {"customer": None, "awarded_to": "Bo", "date_of_birth": "1990-01-02", "vendor": "Awarded To: Bo"}
    assert got["none"]["vendor"] == "Hello"


def test_dates_and_phones_by_shape(spark):
    texts = {"on 1-2-99 x": "1-2-99", "12345": None, "at 12/3456": None, "v1.2.2020": None, "x 2020.1.2": "2020.1.2", "٣٤/٠١/٢٠٢٠": "٣٤/٠١/٢٠٢٠"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.by_pattern(F.col("t"), "date").alias("d"), X.by_pattern(F.col("t"), "phone").alias("p"))
    assert {r.t: r.d for r in rows.collect()} == texts
