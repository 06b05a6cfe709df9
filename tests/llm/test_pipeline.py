"""Each stage on its own input, against brute force; then the whole."""

from tidemark.llm import templates
from tidemark.llm.common import components

from test_similar import groups

D = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
    good = p.good_quality(spark, docs, D).cache()
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.97 * sum(labels.values())
    one = p.one_of_each(spark, good, D).cache()
    assert {r["doc_id"] for r in one.collect()} == groups([(r["doc_id"], r["text"]) for r in good.collect()])
    clean = p.without_benchmark(spark, one, D).cache()
    index = templates.Benchmark([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect() if not index.find(r["text"])}
    rows = p.packed(spark, clean, D).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in clean.collect()}
    key = lambda x: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in x)
    assert key(p.run(spark, D).collect()) == key(rows)


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_all_are_registered():
    from tidemark.llm import queries

    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
