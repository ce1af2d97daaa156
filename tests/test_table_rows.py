import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.operators import metrics, store


def plain(a, b, least):
    """Longest order-preserving alignment of rows that agree."""
    fits = lambda x, y: len(set(x.items()) & set(y.items())) >= max(1e-9, least * len(x.keys() | y.keys()))
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + fits(x, y))
    return row[-1]


cells = st.fixed_dictionaries({}, optional={h: st.sampled_from("12") for h in "pqr"})


@given(st.lists(cells, max_size=9), st.lists(cells, max_size=9), st.sampled_from([0.3, 0.5, 0.67, 1.0]))
@settings(max_examples=300, deadline=None)
def test_alignment_equals_the_plain_program(a, b, least):
    assert metrics.aligned(metrics._row_places(a, b, least), len(a)) == plain(a, b, least)


def frame(spark, tables):
    rows = [(d, t, i, data) for (d, t), found in tables.items() for i, data in enumerate(found)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id string, table_index int, row_index int, data map<string,string>")


def test_shifted_missing_and_damaged_rows(spark):
    item = lambda n, q, a: {"Item": n, "qty": q, "Amount": a}
    full = [item("Bolt", "2", "10.00"), item("Nut", "1", "5.00"), item("Nut", "1", "5.00"), item("Cap", "3", "1,200.50")]
    truth = {("a", 0): full, ("a", 1): full[:1], ("b", 0): full, ("c", 0): full[:2]}
    found = {
        ("a", 0): [item("Item", "Qty", "Amount"), {"item ": " bolt", "qty": "2.0", "amount": "$ 10"}, item("Nut", "1", "5,00"), item("CAP", "3", "1200.5")],
        ("b", 0): [full[3], full[0], item("Nut", "1", "6.00"), full[2]], ("d", 0): full[:1],
    }
    a, b = frame(spark, truth), frame(spark, found)
    got = {(r.doc_id, r.table_index): (r.tp, r.fp, r.fn) for r in metrics.table_row_counts(a, b).collect()}
    assert got == {("a", 0): (3, 1, 1), ("a", 1): (0, 0, 1), ("b", 0): (2, 2, 2), ("c", 0): (0, 0, 2), ("d", 0): (0, 1, 0)}
    some = {(r.doc_id, r.table_index): r.tp for r in metrics.table_row_counts(a, b, 0.6).collect()}
    assert some["b", 0] == 3
    r = metrics.table_row_scores(metrics.table_row_counts(a, b)).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.micro_f1) == (5, 4, 6, 0.5556, 0.4545, 0.5)
    assert r.macro_f1 == pytest.approx((0.75 + 0.5) / 5)
    none = metrics.table_row_scores(metrics.table_row_counts(a.limit(0), b.limit(0))).first()
    assert (none.tp, none.micro_f1, none.macro_f1) == (0, 0.0, 0.0)


def test_texts_that_differ_do_not_agree(spark):
    truth = frame(spark, {("a", 0): [{"Item": "Bolt", "Unit": "box"}, {"Item": "Nut", "Unit": None}]})
    found = frame(spark, {("a", 0): [{"item": "Washer", "unit": "bag"}, {"ITEM ": "nut", "unit": " "}]})
    assert [tuple(r)[2:] for r in metrics.table_row_counts(truth, found).collect()] == [(1, 1, 1)]


@given(st.lists(cells, max_size=9), st.lists(cells, max_size=9), st.sampled_from([0.3, 0.5, 1.0]))
@settings(max_examples=200, deadline=None)
def test_equal_rows_at_the_ends_cost_no_pair(a, b, least):
    texts = sorted({f"{len(k)}:{k}{v}" for row in a + b for k, v in row.items()})
    coded = lambda rows: [tuple(texts.index(f"{len(k)}:{k}{v}") for k, v in sorted(row.items())) for row in rows]
    assert metrics._agreeing(coded(a), coded(b), least, texts.__getitem__) == plain(a, b, least)


def test_a_cell_is_stripped_once(spark):
    rows = frame(spark, {("a", 0): [{"Item": "Bolt"}]})
    plan = metrics._table_rows(rows, "a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)^\s+|\s+$") == 1 and plan.count(r"^[^A-Za-z]*$") <= 2  # one of two branches is computed


def test_of_equal_headers_the_last_counts(spark):
    results = spark.sql("""SELECT 'a' AS doc_id, array(struct(array('x', 'y', 'x') AS headers, array(array('1', '2', '3'), array('4')) AS rows)) AS tables
      UNION ALL SELECT 'b', array(struct(array('x', 'y'), array(array('1', CAST(NULL AS STRING), '3'))))""")
    got = {(r.doc_id, r.row_index): r.data for r in store.line_item_rows(results).collect()}
    assert got == {("a", 0): {"y": "2", "x": "3"}, ("a", 1): {"x": "4"}, ("b", 0): {"x": "1", "y": None}}
