import random

from pyspark.sql import functions as F

from paperloom.functions import distance as D
from paperloom.plans import scores


def plain(t: str) -> str:
    out = []
    for i, c in enumerate(t):
        inner = 1 < i < len(t) - 2
        if inner and i % 50 == 25:
            out.append(scores.MARK)
        elif not (inner and i % 97 == 60):
            out.append(c)
    return "".join(out)


def test_texts_are_edited_by_blocks(spark):
    rng = random.Random(3)
    sizes = [*range(0, 6), *range(24, 32), *range(58, 66), 99, 100, 126, 127, 128, 129, 160, 4426, 4427, 4428, 4429, 9300]  # 4425 is marked and left out at once
    texts = ["".join(rng.choice("ab \n\r é😀") for _ in range(n)) for n in sizes]
    texts += [scores.MARK * 70, "x" * 60 + scores.MARK + "y" * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in rows.select("i", scores._edited_text(F.col("t")).alias("c")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != plain(t)] == []


def test_a_distance_of_some_hundreds_takes_one_pass(monkeypatch):
    passes, within = [], D._within
    monkeypatch.setattr(D, "_within", lambda *x: passes.append(x[-1]) or within(*x))
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    copy = plain(text)
    assert D.distance(text, copy) == D._whole(D._places(text), len(text), copy) and len(passes) == 1  # two before, the first in vain
