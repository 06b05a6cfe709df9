"""Op 11 against plain Python: exact integers of any size, ties, and rows that don't count."""

import hashlib
from math import floor

import numpy as np
import pytest

from tidemark.llm import clusters, vectors

KIND = "vec_id long, embedding array<double>, label int, x string, CLUSTER string, Embedding string, dims int"


def brute(rows, dims=3, k=4, rounds=3, factor=64):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 in Python integers."""
    finite = lambda v: v is not None and len(v) == dims and all(x is not None and x == x and abs(x) != float("inf") for x in v)
    whole = lambda x: int(x) * factor if abs(x) > 2**60 else floor(x * factor)
    kept = [(i, [whole(x) for x in v], v) for i, v in rows if finite(v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))[:k]
    c = [x for _, x, _ in start]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for _, x, _ in kept]
        return [(min(range(len(c)), key=d.__getitem__), min(d)) for d in far]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [x for (_, x, _), (a, _) in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, a, d, sum(e for b, e in at if b == a), sum(e for _, e in at), name[a]) for (i, _, _), (a, d) in zip(kept, at, strict=True)]


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c", "e", 9) for i, v in rows], KIND)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def check(spark, rows, **more):
    got = sorted(map(tuple, clusters.cluster(make(spark, rows), dims=3, k=4, **more).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


def test_against_plain_python(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (300, [0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(301, None), (302, []), (303, [1.0, 2.0]), (304, [1.0, None, 2.0]), (305, [float("nan"), 1.0, 1.0]), (306, [float("inf"), 1.0, 1.0]), (307, [1.0] * 4)]
    got = check(spark, rows)
    assert len(got) == 205


def test_ties_and_fewer_vectors_than_centroids(spark):
    check(spark, [(i, [float(i % 2), 0.0, 0.0]) for i in range(40)])
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])
    assert clusters.cluster(make(spark, []), dims=3).count() == 0
    assert clusters.cluster(make(spark, [(1, None)]), dims=3).count() == 0


@pytest.mark.parametrize("scale", [2.0**20, 2.0**23, 2.0**24])
def test_beyond_what_a_double_holds(spark, scale):
    """Squares beyond 2^53 differ in their last digits only: doubles would call them equal."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-64, 64, 3) / 64 + scale).tolist()) for i in range(60)] + [(100 + i, (rng.integers(-64, 64, 3) / 64 - scale / 2).tolist()) for i in range(60)]
    check(spark, rows)


def test_huge_components_are_exact(spark):
    """One value beyond a long; a distance that a long can't hold is an error, not a wrong number."""
    big = [1e30, 0.0, 0.0]
    check(spark, [(1, big), (2, [1.0, 1.0, 1.0]), (3, [2.0, 1.0, 1.0])])
    with pytest.raises(Exception, match="beyond a long|too large|overflow|OverflowError"):
        clusters.cluster(make(spark, [(1, big), (2, [-1e30, 0.0, 0.0])]), dims=3, k=1).collect()


@pytest.mark.parametrize("top", [10, 2**20, 2**26, 2**30, 2**33])
def test_expansion_equals_integers(top):
    """The guard lets only exact products through; rows on either side of it in one block."""
    rng = np.random.default_rng(3)
    x = rng.integers(-top, top + 1, (300, 64))
    x[::3] //= 2**12
    c = rng.integers(-top, top + 1, (5, 64)) // 2**10
    want = [[sum((a - b) ** 2 for a, b in zip(r, s, strict=True)) for s in c.tolist()] for r in x.tolist()]
    assert [list(map(int, r)) for r in clusters.distances(x, c).tolist()] == want


def test_whole_numbers():
    x = np.array([[0.99, -0.01, -0.0], [1e18, -1e18, 2.0**61], [1.7e308, -1.7e308, 1.0]])
    assert vectors.whole(x, 64).tolist() == [[floor(v) * 64 if abs(v) > 2**53 else floor(v * 64) for v in r] for r in x.tolist()]
    assert vectors.whole(x[:1], 64).dtype == np.int64


def test_against_sql(spark, duck, same, data_dir):
    same(clusters.op11_gemm_clusters(spark, data_dir).toPandas(), duck.sql(clusters.OP11_SQL).df())
