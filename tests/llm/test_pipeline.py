import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_langid, test_linededup, test_minhash

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def documents():
    rng = random.Random(4)
    lines = {x: [test_langid.prose(x, 25, f"{x}{i}") for i in range(60)] for x in test_langid.SYLLABLES}
    rows = []
    for i in range(90):
        lang = rng.choice(list(lines))
        text = "\n".join(rng.sample(lines[lang], rng.randint(1, 2)) + [test_langid.prose(lang, 60, f"own{i}")])
        rows.append((i, text, lang))
    rows += [(90 + i, rows[i][1] + " last word", rows[i][2]) for i in range(20)]
    rows += [(120 + i, rows[i][1].replace("\n", " "), rows[i][2]) for i in range(9)]  # other lines, same shingles
    return rows + [(200, None, "aa"), (201, "12 %", "bb"), (202, "", None)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = [(d, t, x, f"src{d % 3}", len(t or "")) for d, t, x in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    gone, _ = test_linededup.brute(texts)
    left = {}
    for d, t in texts.items():
        kept = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        if kept:
            left[d] = "\n".join(kept)
    final = {d for d, (_, _, kept) in test_minhash.brute(left, 5, 80).items() if kept}

    now = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        sizes.append({r.doc_id: r.text for r in now.collect()})
    assert sizes[0] == texts and sizes[1] == left and sizes[2] == {d: left[d] for d in final}

    lengths = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(TOKENIZER.encode(left[d], add_special_tokens=False).ids) + 1 for d in final}
    assert len(final) < len(left) < len(rows) and final


def test_no_document_has_a_label(spark, tmp_path):
    rows = [(d, t, None, f"src{d % 3}", len(t or "")) for d, t, _ in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == texts
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count()


def test_own_columns_stay_as_they_are(spark, tmp_path):
    made = ("score", "bits", "lang_pred", "_kept", "_id", "_gone", "_digest", "c0", "kept", "component_id")
    rows = [(d, t, x, f"src{d % 3}", len(t or ""), *(f"{c}{d}" for c in made)) for d, t, x in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in made))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.schema == docs.schema
        for r in now.collect():
            assert tuple(r[c] for c in made) == tuple(f"{c}{r.doc_id}" for c in made) and r.n_chars == len(r.text)
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count()


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "ein text", None, None, None), (1, None, "aa", "s", 0), (1, "same words here", None, None, 15), (1, "same words here", None, None, 15), (2, "", "bb", None, 0)]
    for name, given in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(given, schema)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, f"{tmp_path}/{name}")
            assert now.columns == docs.columns
        left = sorted((str(r.doc_id), r.text) for r in now.collect())
        assert left == ([("1", "same words here")] * 2 + [("None", "ein text")] if given else [])
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() >= (2 if given else 0)
