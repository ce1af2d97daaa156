from pyspark.sql import functions as F

from paperloom.functions import distance as D
from paperloom.operators import metrics
from paperloom.plans.process import process
from paperloom.sources import documents


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evaluation_counts_and_compares_once(spark):
    truth = documents.benchmark(spark, 2, 2, 1, 1)
    made = metrics.evaluation(truth, process(truth.select("doc_id", "filename", "ocr"), "2027-01-01"))
    assert "Join" not in _plan(made) and "levenshtein" not in _plan(made)  # each part of the report repeated them
    got = {(r.part, r.metric): r.value for r in made.where("part <> 'class'").collect()}
    assert got["overall", "documents"] == 6.0 and got["overall", "cer"] == got["overall", "wer"] == 0.0


def test_fields_are_parsed_where_both_have_a_value(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id string, name string, value string")
    truth = rows(("a", "total", "1,000.00"), ("a", "date", "2020-01-02"), ("a", "vendor", "A  b"), ("a", "x", "1.0"), ("a", "y", "z"), ("a", "n", None))
    found = rows(("a", "total", "1000"), ("a", "date", "02/01/2020"), ("a", "vendor", " a B"), ("a", "x", "1"), ("a", "w", "z"), ("a", "n", None))
    counts = metrics.field_counts(truth, found)
    assert "CASE WHEN (isnotnull(t#" in _plan(counts.select("tp"))  # all values were parsed before, as amount, date and text
    assert {r.name: (r.tp, r.fp, r.fn) for r in counts.collect()} == {
        "total": (1, 0, 0), "date": (1, 0, 0), "vendor": (1, 0, 0), "x": (0, 1, 1), "y": (0, 0, 1), "w": (0, 1, 0), "n": (0, 0, 0),
    }


def test_equal_texts_are_not_aligned(spark):
    long = "ab c" * 200  # beyond the cells of Spark's own function
    pairs = [(long, long, 0.0, 0.0), ("", "", 0.0, 0.0), (None, "", 0.0, 0.0), (" a", "a", 0.0, 0.0), ("a b", "a c", 1 / 3, 0.5), (long, long + "x", 1 / 800, 1 / 201), ("", "xy z", 4.0, 2.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, c double, w double")
    for r in rows.select("c", "w", D.cer("a", "b").alias("cer"), D.wer("a", "b").alias("wer")).collect():
        assert (r.cer, r.wer) == (r.c, r.w)
    assert "WHEN (a#" in _plan(rows.select(D.text_distance(F.col("a"), F.col("b"))))
