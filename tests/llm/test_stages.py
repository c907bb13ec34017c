"""The stages of the pipeline on odd rows and on an empty table."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(30_000))
PLAIN = "The quick brown fox jumps over the lazy dog and runs far away from here until night falls on the quiet hills"
ROWS = [
    (1, "a", "en", 3, PLAIN), (1, "a", "en", 3, PLAIN), (2, None, None, None, None), (None, "a", "en", 1, PLAIN), (None, None, "en", 0, None),
    (3, "b", "de", 0, ""), (4, "b", "de", 2, " \n\t "), (5, "b", "en", None, LONG), (6, "c", "fr", 1, "ça été là"), (6, "c", "fr", 1, "x"),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, sf_dir, name, stage):
    odd = spark.createDataFrame(ROWS, SCHEMA)
    out = stage(spark, odd, sf_dir)
    texts = [r.text for r in out.select("text").collect()]
    if name == "shard":
        assert set(odd.columns) <= set(out.columns) and len(texts) == len(ROWS)
    else:
        assert out.columns == odd.columns
    if name == "rules":
        assert None not in texts and "" not in texts
    if name == "near_dedup":
        assert texts.count(PLAIN) == 1 and texts.count(None) == 2 and "" in texts and LONG in texts
    if name == "decontaminate":
        assert sorted(map(str, texts)) == sorted(str(r[4]) for r in ROWS)
    assert stage(spark, odd.limit(0), sf_dir).collect() == []
