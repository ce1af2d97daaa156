import duckdb

from paperloom.llm import chat

ROWS = [
    (1, 0, "user", "Where is the  harbour?\nI am lost.\n\nThank you."),
    (1, 1, "assistant", "> where is the harbour?\n> I am lost.\n\nBehind the hill."),
    (1, 2, "user", "Another thing altogether."),
    (1, 3, "user", "> > Where is the harbour? I am lost.\n>\n> Behind the hill.\n\nWhich hill?"),
    (1, 4, "assistant", ">> Behind the hill.\n> Which hill?\n\nThe green one."),
    (1, 5, "user", "> never said\nok"),
    (1, 6, "user", "> Another thing ALTOGETHER.\nyes"),
    (2, 0, None, None),
    (2, 0, "user", ""),
    (2, 1, "user", "x\n" * 3000),
    (2, 1, "user", "x\n" * 3000),
    (2, None, "user", "no turn"),
    (None, 3, "user", "> x"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links_and_order(spark):
    frame = spark.createDataFrame([(*r, 0) for r in ROWS], SCHEMA + ", position int")
    out = chat.conversations(frame)
    one = out.where("conv_id = 1").orderBy("position").collect()
    assert [(r.turn, r.parent_turn, r.thread_turn, r.depth) for r in one] == [
        (0, None, 0, 0), (1, 0, 0, 1), (3, 1, 0, 2), (4, 3, 0, 3), (2, None, 2, 0), (6, 2, 2, 1), (5, None, 5, 0)
    ]
    assert one[2].body == "Which hill?" and one[2].formatted == "<|user|>\nWhich hill?<|end|>\n"
    two = out.where("conv_id = 2").orderBy("position").collect()
    assert [r.position for r in two] == [1, 2, 3, 4, 5] and two[0].turn is None
    assert out.count() == len(ROWS)
    assert chat.conversations(frame.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_same_rows_as_sql(spark):
    rows = [r for r in ROWS if r[0] is not None and r[1] is not None]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in chat.conversations(frame).collect()}
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert got == set(db.sql(chat.ORACLE_SQL).fetchall())
