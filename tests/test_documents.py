import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import classify, fields, layout, lineitems, metrics, review, store, validate
from paperloom.plans.process import process
from paperloom.sources import documents


def page(lines, gap=25):
    return [
        (w, [10.0 + 80 * j, 20.0 + gap * i, 80.0 + 80 * j, 38.0 + gap * i], 0.95)
        for i, line in enumerate(lines) for j, w in enumerate(line.split(" "))
    ]


def frame(spark, pages):
    return spark.createDataFrame([(k, k + ".png", page(v)) for k, v in pages.items()], f"doc_id string, filename string, ocr {layout.TOKENS}")


PAGES = {
    "invoice": ["TAX INVOICE", "Invoice No: INV-77", "Date: 15/03/2026", "Bill To: Ann Lee", "Item Qty Unit Price Amount", "Bolt 2 - 150.00 300.00", "Nut 1 - 200.00 200.00", "Total: 500.00"],
    "certificate": ["CERTIFICATE OF MERIT", "Certificate No: C-9", "Awarded to: Ben Ode", "Issued by Board", "20/06/2026"],
    "receipt": ["CORNER SHOP", "Receipt No: R-1", "Total 12,20", "Paid by cash"],
    "empty": [],
    "blank": ["hello world"],
}


def test_pipeline(spark):
    rows = {r.doc_id: r for r in process(frame(spark, {k: v for k, v in PAGES.items()}), "2026-12-31").collect()}
    value = lambda d, n: rows[d].fields[n].value
    assert (rows["invoice"].doc_type, value("invoice", "invoice_no"), value("invoice", "customer")) == ("invoice", "INV-77", "Ann Lee")
    assert rows["invoice"].tables[0].headers == ["item", "qty", "unit price", "amount"] and len(rows["invoice"].tables[0].rows) == 2
    assert not rows["invoice"].needs_review
    assert (rows["certificate"].doc_type, value("certificate", "awarded_to"), value("certificate", "title")) == ("certificate", "Ben Ode", "Certificate Of Merit")
    assert (rows["receipt"].doc_type, value("receipt", "total"), value("receipt", "payment_method"), value("receipt", "vendor")) == ("receipt", "12.20", "cash", "CORNER SHOP")
    assert (rows["empty"].doc_type, rows["empty"].doc_type_conf) == ("unknown", 0.0) and rows["empty"].tables == []
    assert rows["blank"].doc_type == "unknown" and value("blank", "total") is None


def plain_lines(words, tolerance, by_mean):
    lines = []
    for w in sorted(words, key=lambda w: w[0]):
        for line in lines:
            at = sum(x[0] for x in line) / len(line) if by_mean else line[0][0]
            if abs(at - w[0]) <= tolerance:
                line.append(w)
                break
        else:
            lines.append([w])
    return [[t for _, _, t in sorted(line, key=lambda w: w[1])] for line in lines]


@pytest.mark.parametrize("by_mean", [True, False])
def test_lines_against_plain_grouping(spark, by_mean):
    rng = random.Random(by_mean)
    docs, wanted = [], {}
    for d in range(40):
        words = [(float(rng.randint(0, 60)), float(rng.randint(0, 400)), f"w{i}") for i in range(rng.randint(0, 30))]
        docs.append((str(d), [(t, [x, y, x, y], 1.0) for y, x, t in words]))
        wanted[str(d)] = plain_lines(words, 8.0, by_mean)
    made = layout.with_lines(spark.createDataFrame(docs, f"doc_id string, ocr {layout.TOKENS}"), 8.0, by_mean)
    got = {r.doc_id: [[w.text for w in line] for line in r.lines] for r in made.collect()}
    assert got == wanted


def test_layout_helpers(spark):
    docs = frame(spark, {"a": ["Date: 2026-10-02", "one two three", "only: ", "Date: later value"]})
    made = layout.with_lines(docs, 10.0, by_mean=False)
    row = made.select(layout.key_values(F.col("lines")).alias("kv"), layout.table_rows(F.col("lines")).alias("rows")).first()
    assert row.kv["Date"] == "later value" and row.rows == [["one", "two", "three"]]


def test_rules_and_model(spark, tmp_path):
    kinds = spark.createDataFrame([("Company INVOICE Total:",), ("cabinet",), ("information",), ("Signature: x",), ("Hello World",)], "t string")
    got = [r.r.doc_type for r in kinds.select(classify.rules(F.col("t"), F.lit(True)).alias("r")).collect()]
    assert got == ["invoice", "receipt", "form", "form", "unknown"]
    model = classify.train(spark)
    classify.save(model, f"{tmp_path}/m")
    out = classify.model_types(spark.createDataFrame([("Bill To: Subtotal Tax",), ("Hello World",)], "text string"), classify.load(f"{tmp_path}/m")).collect()
    assert out[0].model_type == "invoice" and abs(out[0].model_conf - 0.6538) < 2e-3 and out[1].model_type == "unknown"


def results(spark, values, tables=(), kind="invoice", conf=0.99):
    row = ("d", "d.png", kind, 1.0, [], {k: (v, conf, None) for k, v in values.items()}, list(tables), [], False)
    return spark.createDataFrame([row], documents.LABEL)


def test_validation(spark):
    good = {"invoice_no": "1", "date": "2026-03-15", "subtotal": "1000", "tax": "180", "total": "1180"}
    check = lambda v, **k: validate.validate(results(spark, v, **k), "2026-12-31").first()
    assert check(good).validation == [] and not check(good).needs_review
    assert "invoice_no" in check(good | {"invoice_no": None}).validation[0].message
    table = (["item", "amount"], [["a", "100"], ["b", "50"]])
    assert "sum to" in check(good | {"total": "999.00"}, tables=[table]).validation[0].message
    assert "future" in check(good | {"date": "01/01/2099"}).validation[0].message
    assert check(good, conf=0.5).needs_review
    full = validate.validate(results(spark, good | {"gstin": "bad"}), "2026-12-31", validate.full_rules).first()
    assert [v.rule for v in full.validation] == ["gstin_format"]
    assert results(spark, good).select(validate.total_matches().alias("r")).first().r is None
    full = lambda t, **k: [v.message for v in validate.validate(results(spark, good | k, tables=[t]), "2026-12-31", validate.full_rules).first().validation]
    assert full(table) == ["Line items sum to 150.00 but extracted total is 1180.00 (difference: 1030.00)"]
    assert full((["item", "price"], [["a", "x"], ["b", "50"]])) == ["Could not parse all values in table column 'price'; sum check skipped"]
    assert full(table, total=None) == ["Missing required field: 'total'"] and full((["item"], [["a"]])) == []


def test_store_and_corrections(spark):
    made = validate.validate(results(spark, {"invoice_no": None, "date": "2026-03-15", "total": "10"}), "2026-12-31")
    fix = spark.createDataFrame([("d", "invoice_no", "X-1"), ("d", "note", "n")], "doc_id string, name string, value string")
    row = store.correct(made, fix, "2026-12-31").first()
    assert row.fields["invoice_no"].value == "X-1" and row.fields["note"].conf == 1.0 and not row.needs_review
    bad = spark.createDataFrame([("d", "Bad Name", "x")], "doc_id string, name string, value string")
    with pytest.raises(Exception, match="bad field"):
        store.correct(made, bad, "2026-12-31").collect()
    twice = results(spark, {}, tables=[(["a", "a", "b"], [["1", "2", "3", "4"], ["5"]])])
    assert [r.data for r in store.line_item_rows(twice).orderBy("row_index").collect()] == [{"a": "2", "b": "3"}, {"a": "5"}]
    index = store.index_rows(made.withColumn("created_at", F.lit("2026-01-01")))
    assert store.matching(index, q="invoice_NO").count() == 1
    for wrong in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"date_from": "2026-02-01", "date_to": "2026-01-01"}):
        with pytest.raises(ValueError):
            store.search(index, **wrong)
    assert store.kpis(index.limit(0)).first().stp_rate == 100.0
    assert {r.status for r in review.review_fields(made).collect()} == {"empty", "ok"}


def test_metrics(spark):
    rows = lambda m: spark.createDataFrame([("d", k, v) for k, v in m.items()], "doc_id string, name string, value string")
    counts = metrics.field_counts(rows({"total": "10", "vendor": "A", "x": None}), rows({"total": "11", "vendor": None, "date": "2026-01-01"}))
    assert [metrics.overall_scores(counts).first()[c] for c in ("tp", "fp", "fn")] == [0, 2, 2]
    pairs = spark.createDataFrame([("invoice", "invoice"), ("invoice", "receipt"), ("receipt", "receipt"), ("form", "form")], "truth string, predicted string")
    assert metrics.class_overall(pairs).first().accuracy == 0.75
    assert metrics.class_overall(pairs.limit(0)).first().accuracy == 0.0
    truth = documents.benchmark(spark, 2, 2, 1, 1)
    made = process(truth.select("doc_id", "filename", "ocr"), "2027-01-01")
    assert metrics.corpus_scores(truth, made).first().stp_rate_pct == 100.0
    text = metrics.report(truth, made)
    assert all(x in text for x in ("stp_rate_pct", "class_macro_f1", "field_micro_f1", "certificate", "recall"))
    rows = {(r.part, r.name, r.metric): r.value for r in metrics.evaluation(truth, made).collect()}
    assert rows["overall", "overall", "total_stp"] == 6.0 and rows["class", "receipt", "f1"] == 1.0 and rows["field", "field", "fn"] == 0.0
    none = {r.metric: r.value for r in metrics.evaluation(truth.limit(0), made.limit(0)).where("part = 'overall'").collect()}
    assert none["documents"] == 0.0 and none["stp_rate_pct"] == 0.0 and none["accuracy"] == 0.0 and none["field_macro_f1"] == 1.0


def test_sources(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.PNG").write_bytes(b"x")
    (tmp_path / "up/b.txt").write_bytes(b"y")
    good, bad = documents.read_uploads(spark, str(tmp_path / "up"))
    assert [r.filename for r in good.collect()] == ["a.PNG"] and [r.reason for r in bad.collect()] == ["unsupported type"]
    labels = documents.benchmark(spark, 1, 1, 0, 0)
    (tmp_path / "labels").mkdir()
    for r in labels.select("doc_id", documents.pretty_json(labels).alias("j")).collect():
        (tmp_path / f"labels/{r.doc_id}.json").write_text(r.j)
    (tmp_path / "labels/broken.json").write_text("{")
    assert documents.read_labels(spark, str(tmp_path / "labels")).count() == 2
    raw = lambda j: spark.createDataFrame([("d", "f", j)], "doc_id string, filename string, json string")
    assert documents.from_sroie(raw('{"company": "A", "total": "9"}')).first().fields["vendor"].value == "A"
    assert set(documents.from_cord(raw('{"total": 9, "date": ["x"]}')).first().fields) == {"total"}
    form = documents.from_funsd(raw('{"form": [{"text": "Full Name:", "label": "question", "box": [1, 2, 3, 4]}, {"text": "Z", "label": "other", "box": [1]}]}')).first()
    assert set(form.fields) == {"full_name"} and len(form.ocr) == 1


def test_stream(spark, tmp_path):
    from paperloom.streaming.ingest import ingest, stored, token_stream

    assert stored(spark, f"{tmp_path}/out") is None

    docs = frame(spark, PAGES).withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    docs.write.json(f"{tmp_path}/in")
    ingest(token_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", "2026-12-31").awaitTermination()
    frame(spark, {"blank": ["INVOICE now"]}).withColumn("created_at", F.current_timestamp()).write.mode("append").json(f"{tmp_path}/in")
    ingest(token_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", "2026-12-31").awaitTermination()
    rows = {r.doc_id: r for r in stored(spark, f"{tmp_path}/out").collect()}
    assert len(rows) == len(PAGES) and rows["blank"].doc_type == "invoice" and str(rows["blank"].created_at) == "2026-01-01 00:00:00"


def test_unreadable_index_is_not_replaced(spark, tmp_path):
    import shutil

    from paperloom.streaming.ingest import ingest, stored, token_stream

    docs = frame(spark, PAGES).withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    docs.write.json(f"{tmp_path}/in")
    run = lambda: ingest(token_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", "2026-12-31").awaitTermination()
    run()
    shutil.move(f"{tmp_path}/out/index", f"{tmp_path}/gone")
    docs.write.mode("append").json(f"{tmp_path}/in")
    with pytest.raises(Exception):  # noqa: B017
        run()
    shutil.rmtree(f"{tmp_path}/out/index", ignore_errors=True)
    shutil.move(f"{tmp_path}/gone", f"{tmp_path}/out/index")
    run()
    assert stored(spark, f"{tmp_path}/out").count() == len(PAGES)


def test_lines_of_a_dense_page(spark):
    rows = [("d", "d.png", page([" ".join(f"w{i}x{j}" for j in range(20)) for i in range(100)]))]
    made = layout.with_lines(spark.createDataFrame(rows, f"doc_id string, filename string, ocr {layout.TOKENS}")).first().lines
    assert [len(x) for x in made] == [20] * 100 and [w.text for w in made[99]] == [f"w99x{j}" for j in range(20)]


def test_plans_have_no_python(spark):
    plan = process(frame(spark, PAGES), "2026-12-31")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert fields.LABELS and lineitems.HEADERS


def test_ocr_without_engines(spark, monkeypatch):
    from paperloom.sources import ocr

    files = spark.createDataFrame([("a", "a.png", "png", bytearray(b"x")), ("b", "b.pdf", "pdf", bytearray())], "doc_id string, filename string, suffix string, content binary")
    got = {r.doc_id: r.ocr for r in ocr.recognise(files).collect()}
    assert got == {"a": [], "b": []}
    corners = ocr.order_points([[9, 8], [0, 0], [10, 1], [1, 9]])
    assert corners.tolist() == [[0, 0], [10, 1], [9, 8], [1, 9]]


def test_evaluation_command_and_file_fetch(spark, tmp_path):
    from paperloom.plans.evaluate import main

    labels = documents.benchmark(spark, 1, 1, 0, 0)
    (tmp_path / "l").mkdir()
    for r in labels.select("doc_id", documents.pretty_json(labels).alias("j")).collect():
        (tmp_path / f"l/{r.doc_id}.json").write_text(r.j)
    text = main(["--labels-dir", str(tmp_path / "l"), "--as-of", "2027-01-01", "--report", str(tmp_path / "r.md")])
    assert "stp_rate_pct" in text and text in (tmp_path / "r.md").read_text()
    (tmp_path / "a.png").write_bytes(b"x")
    index = spark.createDataFrame([("a", f"{tmp_path}/a.png"), ("b", f"{tmp_path}/none.png"), ("c", None)], "doc_id string, file_path string")
    assert [bytes(r.content) for r in documents.fetch_file(spark, index, "a").collect()] == [b"x"]
    assert all(documents.fetch_file(spark, index, d).count() == 0 for d in ("b", "c", "d"))
