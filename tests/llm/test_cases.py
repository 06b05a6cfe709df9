"""Cases that every stage has a stated result for: nulls, empty and very long texts, repeated rows, no rows, clashing columns."""

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_Id long, fp string, keys string, uid long, score string"


@pytest.fixture(scope="module")
def rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "alone is this text with some words in it"), (2, None), (3, ""), (4, " \n "), (5, long), (6, long + " end"), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", 1, "other", 9, "f", "k", 7, "x") for i, t in texts], KIND)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (2, 0, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{d}/labels.parquet")
    spark.createDataFrame([(1, "w100 w101 w102 w103 w104 w105 w106 w107"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    return f"file://{d}"


def test_every_stage(spark, rows, tables):
    import corpus_pipeline as p

    n = rows.count()
    for name, stage in p.STAGES:
        some, none = stage(spark, rows, tables), stage(spark, rows.limit(0), tables)
        assert none.count() == 0
        got = some.collect()
        if name != "packing":
            assert some.columns == rows.columns and len(got) <= n
        if name == "near_duplicates":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 2), (False, 5), (True, 0)]
        if name == "decontamination":
            assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 1, 1, 2, 3, 4]
        if name == "packing":
            assert len({r["sequence_id"] for r in got if r["doc_id"] in (5, 6)}) > 2 and sum(r["doc_id"] == 1 for r in got) == 2


def test_op5_and_op6(spark, rows):
    from pyspark.sql import functions as F

    from tidemark.llm import sharding, tokens

    out, _ = sharding.reshard(rows, F.lit(0), 3, blocks=8, file_bytes=100_000)
    assert out.count() == rows.count() and sorted(r["text"] or "" for r in out.collect()) == sorted(r["text"] or "" for r in rows.collect())
    got = tokens.token_counts(rows).collect()
    assert len(got) == rows.count() and all((r["n_tokens"] == 0) == (r["n_bytes"] == 0) or r["doc_id"] == 4 for r in got)


def test_a_worker_holds_one_memory():
    from tidemark.llm import common, quality, templates, tokens

    quality.term_counts(["some words here"]), templates.canonical(["some", "words"]), tokens.piece_counter().count(["some words"])
    assert quality._terms and templates._words and tokens._loaded
    common.only_memory("quality")
    assert quality._terms and not templates._words and not tokens._loaded
    common.only_memory("similar")
    assert not quality._terms
