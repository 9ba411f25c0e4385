"""The pipeline's stages, each against what it has to keep, and on odd rows."""

import corpus_pipeline as pipeline

from .conftest import SMALL
from .test_operators import plain_base, plain_components


def test_stages_on_documents(spark, documents, texts):
    docs = pipeline.language(spark, documents, SMALL)
    assert docs.columns == documents.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(len(texts[d]["text"]) < 30 or not any(c.isalpha() for c in texts[d]["text"]) for d in set(texts) - set(kept))
    docs = pipeline.near_duplicates(spark, docs.cache(), SMALL)
    plain = plain_components(kept)
    once = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(once) == {d for d, (_, c) in plain.items() if c == d}
    docs = pipeline.personal_data(spark, docs.cache(), SMALL)
    clean = docs.collect()
    assert docs.columns == documents.columns and {r["doc_id"] for r in clean} == set(once)
    assert all(not plain_base(r["text"]) and r["n_chars"] == len(r["text"]) for r in clean)
    docs = pipeline.mixed(spark, docs.cache(), SMALL)
    assert docs.columns == documents.columns and {r["doc_id"] for r in docs.collect()} <= set(once)
    coded = pipeline.encoded(spark, docs, SMALL).collect()
    assert coded and all(r["round_trip"] for r in coded)


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0, name
        got = stage(spark, odd, SMALL)
        if name != "sentencepiece":
            assert got.columns == odd.columns, name
        got.collect()
    once = pipeline.near_duplicates(spark, odd, SMALL).collect()
    assert sorted(r["doc_id"] for r in once if r["doc_id"] is not None) == [1, 2, 3, 5, 6, 7, 8]
    assert sum(r["doc_id"] is None for r in once) == 2


def test_unlike_texts_of_one_id_stay(spark):
    a, b = "one two three four five six seven eight", "red green blue white black grey brown pink"
    rows = [(1, a, "en", "s", 1), (1, a, None, "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "fr", "s", 1), (None, a, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] is not None) == [a, b] and sum(r["doc_id"] is None for r in kept) == 1


def test_run(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "sentencepiece"]
    assert pipeline.run(spark, SMALL).count() > 0
