import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import classify, metrics
from paperloom.sources import documents, labels

TOKEN = {"text": "A", "bbox": [1, 2, 3, 4], "conf": 0.5}


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, body in files.items():
        (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def test_own_labels_defaults_and_rejected_files(spark, tmp_path):
    whole = {"doc_id": "a", "filename": "a.png", "doc_type": "invoice", "doc_type_conf": 0.9, "ocr": [TOKEN], "fields": {"vendor": {"value": "V", "conf": 1.0}}, "tables": [{"headers": ["h"], "rows": [["1"]]}], "needs_review": True}
    write(
        tmp_path / "l", good=whole, least={"doc_id": "b"}, broken="{", array="[1]", empty="", no_id={"filename": "x"}, kind={"doc_id": "c", "doc_type": "memo"},
        box={"doc_id": "d", "ocr": [{**TOKEN, "bbox": [1, 2]}]}, conf={"doc_id": "e", "ocr": [{**TOKEN, "conf": 2}]}, word={"doc_id": "f", "ocr": [{"bbox": [1, 2, 3, 4], "conf": 1}]},
    )
    (tmp_path / "l/note.txt").write_text("no label")
    good, bad = labels.read(spark, str(tmp_path / "l"))
    rows = {r.stem: r for r in good.collect()}
    assert set(rows) == {"good", "least"}
    assert rows["good"].fields["vendor"].value == "V" and rows["good"].tables[0].rows == [["1"]] and rows["good"].needs_review
    least = rows["least"]
    assert (least.filename, least.doc_type, least.doc_type_conf, least.ocr, least.fields, least.needs_review) == ("", "unknown", 0.0, [], {}, False)
    assert {r.file: r.reason for r in bad.collect()} == {
        "broken.json": "not a label", "array.json": "not a label", "no_id.json": "no doc_id", "kind.json": "unknown type",
        "box.json": "a box without four numbers", "conf.json": "a confidence outside 0 to 1", "word.json": "a token without text",
    }
    # every good label as the plain reader gives it
    plain = {r.doc_id: r.fields for r in documents.read_labels(spark, str(tmp_path / "l")).collect()}
    assert plain["a"] == rows["good"].fields


def test_keys_by_stem_and_filename_last_file_wins(spark, tmp_path):
    write(tmp_path / "k", a={"doc_id": "1", "filename": "x.png"}, b={"doc_id": "2", "filename": "x.png"}, c={"doc_id": "3"}, d={"doc_id": "4", "filename": "a"})
    good, _ = labels.read(spark, str(tmp_path / "k"))
    assert {r.key: r.doc_id for r in labels.by_key(good).collect()} == {"a": "4", "b": "2", "c": "3", "d": "4", "x.png": "2"}


def test_names_prune_files_before_they_are_read(spark, tmp_path):
    write(tmp_path / "n", **{f"f{i}": {"doc_id": str(i)} for i in range(20)})
    good, _ = labels.read(spark, str(tmp_path / "n"), names=F.col("_metadata.file_name").startswith("f1"))
    assert {r.stem for r in good.collect()} == {f"f{i}" for i in (1, *range(10, 20))}
    some = labels.files(spark, str(tmp_path / "n"), F.col("_metadata.file_name") == "f3.json")
    some.collect()
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 1


@pytest.mark.parametrize("kind,body,fields,tokens", [
    ("sroie", {"company": "A", "total": "9", "date": None}, {"merchant": "A", "vendor": "A", "total": "9", "date": None}, 0),
    ("cord", {"total": 9, "date": ["x"], "tax": None, "other": "y"}, {"total": "9"}, 0),
    ("funsd", {"form": [{"text": "Total Due:", "label": "question"}, {"text": "Z", "box": [1]}, {"label": "other", "box": [1, 2, 3, 4]}, {"text": "?!", "label": "header"}]}, {"total_due": "Total Due:"}, 3),
    ("funsd", {"other": 1}, {}, 0),
])
def test_public_formats(spark, tmp_path, kind, body, fields, tokens):
    write(tmp_path / "p", one=body, bad="[]", worse="x")
    good, bad = labels.read(spark, str(tmp_path / "p"), kind)
    (row,) = good.collect()
    assert (row.doc_id, row.filename) == ("one", "one.json") and {k: v.value for k, v in row.fields.items()} == fields and len(row.ocr) == tokens
    assert {r.file for r in bad.collect()} == {"bad.json", "worse.json"}


def test_receipts_with_ocr_lines_and_default_boxes(spark):
    rows = spark.createDataFrame([("d", "f", '{"company": "A"}', [("A", [1.0, 2.0, 3.0, 4.0])]), ("e", "f", "{}", None)], "doc_id string, filename string, json string, lines array<struct<text string, bbox array<double>>>")
    made = {r.doc_id: r for r in documents.from_sroie(rows).collect()}
    assert [(t.text, t.bbox, t.conf) for t in made["d"].ocr] == [("A", [1.0, 2.0, 3.0, 4.0], 1.0)] and made["e"].ocr == [] and made["e"].fields == {}
    form = spark.createDataFrame([("d", "f", '{"form": [{"text": "A"}]}')], "doc_id string, filename string, json string")
    assert documents.from_funsd(form).first().ocr[0].bbox == [0.0, 0.0, 100.0, 100.0]


def test_class_report_by_hand(spark):
    pairs = [("m", "a", "a")] * 3 + [("m", "a", "b"), ("m", "b", "b"), ("m", "c", "a"), ("r", "a", "u"), ("r", None, "a")]
    got = {(r.who, r["class"]): (r.precision, r.recall, r.f1, r.support) for r in metrics.class_report(spark.createDataFrame(pairs, "who string, truth string, predicted string"), "who").collect()}
    assert got["m", "a"] == (0.75, 0.75, 0.75, 4) and got["m", "b"] == (0.5, 1.0, 0.6667, 1) and got["m", "c"] == (0.0, 0.0, 0.0, 1)
    assert got["m", "accuracy"] == (None, None, 0.6667, 6) and got["m", "macro avg"] == (0.4167, 0.5833, 0.4722, 6) and got["m", "weighted avg"] == (0.5833, 0.6667, 0.6111, 6)
    assert got["r", "u"] == (0.0, 0.0, 0.0, 0) and got["r", "accuracy"][2] == 0.0
    assert metrics.class_report(spark.createDataFrame([], "who string, truth string, predicted string"), "who").count() == 0


def test_predictions_of_documents_without_tokens(spark):
    docs = spark.createDataFrame([("invoice", [("Invoice", [0.0, 0.0, 1.0, 1.0], 1.0)]), ("form", [])], "doc_type string, ocr array<struct<text string, bbox array<double>, conf double>>")
    got = {(r.predictor, r.truth): r.predicted for r in classify.predictions(docs, classify.train(spark)).collect()}
    assert got["rules", "invoice"] == "invoice" and got["rules", "form"] == got["model", "form"] == "unknown"
