import random
from itertools import combinations

from tidemark.llm import similar, simhash


def plain(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """The smallest id of each group, all pairs compared."""
    sets = {i: plain(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i for i in up if find(i) == i}


def test_near_copies_beyond_two_bits(docs):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        rows.append((len(rows), " ".join(base)))
        for k in range(6):
            other = list(base)
            for _ in range(k):
                other[rng.randrange(120)] = f"new{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(other)))
    want = groups(rows)
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    assert any((prints[i] ^ prints[i - i % 7]).bit_count() > 2 for i, _ in rows if i not in want)
    assert {r["doc_id"] for r in similar.keep_one(docs(rows)).collect()} == want


def test_keep_one(docs):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    df = docs([(5, text), (2, text.upper()), (2, text.upper()), (9, "something else entirely here today"), (None, None), (7, ""), (None, text)])
    kept = similar.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 9]
    assert similar.keep_one(docs([])).count() == 0


def test_stage_against_brute_force(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/documents.parquet")
    want = groups([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {r["doc_id"] for r in p.one_of_each(spark, df, d).collect()} == want


def test_shards_of_many_blocks(docs):
    """A shard is a grid of blocks: a chain of near copies, whose ends aren't alike, stays one group, and other texts stay."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(base)))
        base = list(base)
        base[rng.randrange(150)] = f"new{i}"
    rows += [(100 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(80))) for i in range(40)]
    want = groups(rows)
    assert 100 > len(want) >= 41
    for n in (512, 7):
        assert {r["doc_id"] for r in similar.keep_one(docs(rows), block_points=n).collect()} == want


def test_distances_of_fingerprints():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 9, 16), np.uint64)
    want = [[sum(int(x ^ y).bit_count() for x, y in zip(r, q, strict=True)) for q in b] for r in a]
    assert similar.differing(a, b).tolist() == want


def test_shingles_are_sets_of_five_words():
    text = "A b c d e f a B c d e  f g"
    assert len(similar.shingle_set(text)) == len(plain(text)) and len(similar.shingle_set("one two")) == 1 and not len(similar.shingle_set(" \n"))
    assert set(similar.shingle_set("x y z p q")) & set(similar.shingle_set("w x y z p q r")) and not set(similar.shingle_set("x y")) & set(similar.shingle_set("x y z"))
    long = " ".join(f"w{i}" for i in range(5000))
    whole = similar.shingle_set(long)
    old, similar.PART_BYTES = similar.PART_BYTES, 100
    try:
        assert (similar.shingle_set(long) == whole).all()
    finally:
        similar.PART_BYTES = old


def test_links_begin_with_trees(docs, monkeypatch):
    """The stage's first links come from op 3's BK-trees: also with no other proposals, near copies of two bits form groups; sets decide them."""
    called, real = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda points: called.append(1) or real(points))
    points = docs([(1, "a")]).sparkSession.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 7), (5, 1 << 40 | 7 << 50)], "uid long, fp long")
    found = {tuple(r) for r in similar._by_trees(points).collect()}
    assert found == {(1, 2), (1, 3), (3, 4)}
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(1, words), (2, words + " end"), (3, "something else")]
    assert {r["doc_id"] for r in similar.keep_one(docs(rows)).collect()} == groups(rows) == {1, 3}
    assert len(called) == 2
