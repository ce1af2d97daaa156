import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import catalog, langid

SYLLABLES = {"aa": "th er on an re he in ed".split(), "bb": "sch ung ei ü ber en ge".split(), "cc": "ción es el ño rr ar".split()}


def prose(lang, words, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def brute(text, source):
    """Phrases of greedy longest matches over the whole text."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in source:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


@pytest.mark.parametrize("lane", [2, 3, 17, 256])
def test_phrases_against_brute_force(monkeypatch, lane):
    monkeypatch.setattr(langid, "LANE", lane)
    sample = {x: prose(x, 120, x) for x in SYLLABLES}
    parser = langid.Parser(sample)
    texts = [prose(x, n, n) + z for x in SYLLABLES for n, z in ((1, ""), (7, " 東京"), (150, "!?9"), (90, " zq"))]
    texts += [" ".join(prose(x, 40, i) for i, x in enumerate(list(SYLLABLES) * 3)), sample["aa"] * 3, "q" * 700, "", "a"]
    made = parser.phrases([langid.letters(t) for t in texts])
    for t, row in zip(texts, made):
        plain = "".join(map(chr, langid.letters(t)))
        wanted = [brute(plain, "".join(map(chr, langid.letters(sample[x])))) for x in parser.languages]
        assert row.tolist() == wanted


def test_automaton_has_every_substring_and_no_other():
    rng = random.Random(3)
    s = [rng.randint(1, 3) for _ in range(60)]
    table = langid.automaton(s, 4)
    for _ in range(2000):
        t = [rng.randint(1, 3) for _ in range(rng.randint(1, 9))]
        state = 0
        for c in t:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == (bytes(t) in bytes(s))


def test_held_out_accuracy_and_odd_rows(spark):
    rows = [(i, prose(x, 30 + i, i), x, "src") for i, x in enumerate(list(SYLLABLES) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    docs = docs.withColumn("held", langid.fold(F.col("doc_id"), 3) == 1)
    out = langid.identify(docs, langid.sample(docs.where("not held"))).where("held").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) == 1 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " 12 !"), (4, "q" * 9000), (4, "q" * 9000)], "doc_id long, text string")
    model = {x: prose(x, 90, 1) for x in SYLLABLES}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] in SYLLABLES
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0
    none = spark.createDataFrame([(1, "x", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert langid.sample(none) == {}


def test_sample_of_long_rows_and_the_query(spark, tmp_path):
    rows = [(i, prose(x, 4000 if x == "aa" else 60, i), x, "s", 1) for i, x in enumerate(list(SYLLABLES) * 30)] + [(None, "x", "aa", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = langid.sample(docs)
    long = sorted((r[1] for r in rows if r[2] == "aa" and r[1] != "x"), key=len)
    taken = next(n for n in range(30) if 1 + sum(map(len, long[: n + 1])) > langid.SAMPLE_CHARS)
    assert taken and made["aa"] == " ".join(["x", *long[:taken]])
    assert len(made["bb"]) == sum(len(r[1]) + 1 for r in rows if r[2] == "bb") - 1
    twice = docs.where("doc_id < 15").union(docs.where("doc_id < 15"))
    assert langid.sample(twice)["bb"] == langid.sample(docs.where("doc_id < 15"))["bb"]
    one = docs.where("doc_id = 0").withColumn("text", F.repeat("text", 9))
    assert len(langid.sample(one)["aa"]) == 9 * len(rows[0][1]) > langid.SAMPLE_CHARS
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.op5_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r.held_out is not None for r in out)
    assert np.mean([rows[r.doc_id][2] == r.lang_pred for r in out if r.held_out]) == 1


def test_ties_go_to_the_first_language(spark):
    text = prose("aa", 80, 1)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert langid.identify(docs, {"x2": text, "x1": text}).first().lang_pred == "x1"
