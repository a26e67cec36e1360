"""The pipeline's stages keep all columns of documents, whatever they are called."""

import random

import pytest

import corpus_pipeline

#: Names that the stages use themselves.
NAMES = (
    "__n_words", "n_words", "kept", "base_failed", "longest_repeat", "rest", "row", "__gone", "gone", "__id", "__th", "__marks", "__found", "__copy", "__hot", "__spans", "bucket", "name", "node", "component",
    "copies", "size", "of", "cut", "share", "item_id", "n_shared", "a.b",
)


@pytest.mark.parametrize("k", range(5))
def test_stage_keeps_columns(spark, tmp_path, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", texts[2][:200] + " " + texts[3][:200], None, "", "two words"]
    names = [x for x in NAMES if not (k == 4 and x in ("size", "source_size", "target", "taken"))]
    rows = [(i, t, "en", f"s{i % 3}", 1, *[f"{x}-{i}" for x in names]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in names)
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, schema).repartition(2), str(tmp_path))
    assert got.columns[: len(names) + 5] == ["doc_id", "text", "lang", "source", "n_chars", *names]
    out = got.collect()
    assert len(out) >= 10
    for r in out:
        assert [r[x] for x in names] == [f"{x}-{r.doc_id}" for x in names] and r.source == f"s{r.doc_id % 3}"
