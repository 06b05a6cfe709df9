import random

import pytest
import xxhash

from tidemark.llm import simhash


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", " \n\t", "One", "one TWO", "A b c", "a B c d e f a b c", "Éa Ñ ü x", "x y z w", "a\x1cb c\x1d d", "word " * 3000]


def test_fingerprints():
    assert [simhash.fingerprint(t) for t in TEXTS] == [plain(t) for t in TEXTS]


def test_parts_of_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)) for n in (1, 2, 3, 50, 400)]
    want = [plain(t) for t in texts]
    monkeypatch.setattr(simhash, "PART_BYTES", 7)
    assert [simhash.fingerprint(t) for t in texts] == want


def test_bk_tree():
    rng = random.Random(1)
    points = {rng.getrandbits(10) for _ in range(300)}
    tree = simhash.BkTree()
    for p in points:
        tree.add(p)
    for r in (0, 1, 2, 5):
        for q in range(0, 1024, 37):
            assert sorted(tree.within(q, r)) == sorted(p for p in points if (p ^ q).bit_count() <= r)


@pytest.mark.parametrize("size", [4, 512])
def test_links_equal_brute_force(spark, size):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    points = set(base) | {0, (1 << 64) - 1, 1, 3, 7}
    for b in base[:20]:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    points = sorted(points)
    prints = spark.createDataFrame([(i, simhash._signed(p)) for i, p in enumerate(points)], "doc_id long, fp long")
    got = {r["fp"] & (1 << 64) - 1: r["component_id"] for r in simhash.labelled(prints, tree_points=size).collect()}
    up = list(range(len(points)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, p in enumerate(points):
        for j in range(i):
            if (p ^ points[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert got == {p: find(i) for i, p in enumerate(points)}


def test_rows(docs):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(5, text), (2, text.upper()), (9, text + " x" * 400), (7, None), (8, ""), (None, text), (5, text), (11, "long " * 100_000)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect()), key=repr)
    assert got == sorted([(5, 2), (2, 2), (9, 9), (7, 7), (8, 7), (None, 2), (5, 2), (11, 11)], key=repr)
    assert simhash.near_duplicates(docs([])).count() == 0
