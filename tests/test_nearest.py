"""The vector index finds what all pairs give, whatever its centroids."""

from pathlib import Path

import numpy as np
import pytest

from tidemark.operators import nearest

KIND = "id long, embedding array<float>"


def brute(rows, asked, threshold):
    held = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            held.setdefault(i, []).append(np.array(v, np.float64) / np.linalg.norm(v))
    out = []
    for q in asked:
        for a in held.get(q, []):
            out += [(q, i) for i, own in held.items() for b in own if i != q and len(a) == len(b) and a @ b >= threshold]
    return sorted(out)


def clustered(n=400, groups=12, dim=16):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(groups, dim))
    return [(i, (centre[i % groups] + rng.normal(size=dim) * 0.25).astype("f4").tolist()) for i in range(n)]


ODD = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None, 1.0]), (1005, [1.0, 2.0]), (1006, [1.0, 2.1]), (1007, [1e-30, 2e-30]), (1008, [3.0]), (1009, [4.0]), (1010, [-4.0])]


@pytest.mark.parametrize("threshold", [0.99, 0.88, 0.3, -0.5])
def test_all_pairs(spark, threshold):
    rows = clustered() + ODD
    df = spark.createDataFrame(rows, KIND)
    asked = [i for i, _ in rows if i % 5 == 0 or i > 999]
    index = nearest.build(df)
    got = sorted((r["a"], r["b"]) for r in nearest.within(index, df.where("id % 5 = 0 OR id > 999"), threshold).collect())
    assert got == brute(rows, asked, threshold)


def test_any_centroids(spark):
    """Centroids that say nothing, or too few of them, cost comparisons and no result."""
    rows = clustered(120)
    df = spark.createDataFrame(rows, KIND)
    for c in ({16: np.eye(1, 16)}, {16: -np.eye(3, 16)}, {}):
        got = sorted((r["a"], r["b"]) for r in nearest.within(nearest.build(df, centroids=c), df, 0.9).collect())
        assert got == brute(rows, range(120), 0.9)


def test_share_read(spark):
    rows = clustered(600, 30)
    df = spark.createDataFrame(rows, KIND)
    share = nearest.share_read(nearest.build(df), df.where("id % 20 = 0"), 0.95)
    assert 0 < share < 0.3


def test_blocks_of_a_ring(spark, monkeypatch):
    """Equal vectors share a ring, which is many blocks."""
    monkeypatch.setattr(nearest, "ROWS", 7)
    df = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(40)], KIND)
    index = nearest.build(df)
    assert nearest.within(index, df, 0.88).count() == 40 * 39 and index.blocks().selectExpr("max(n)").first()[0] <= 7


def test_no_rows(spark):
    df = spark.createDataFrame([], KIND)
    index = nearest.build(df)
    assert nearest.within(index, df).count() == 0 and nearest.share_read(index, df) == 0.0


def test_small_tiles(spark, monkeypatch):
    """Tiles and parts of queries of a few vectors each: the same pairs, each once."""
    monkeypatch.setattr(nearest, "TILE_BYTES", 640)
    rows = clustered(200)
    df = spark.createDataFrame(rows, KIND)
    got = sorted((r["a"], r["b"]) for r in nearest.within(nearest.build(df), df.where("id % 3 = 0"), 0.8).collect())
    assert got == brute(rows, range(0, 200, 3), 0.8)


def test_queries_are_not_copied_by_ring(spark):
    """Vectors without clusters, whose queries meet nearly every ring: what lies in the shared folder stays near the size of the vectors."""
    x = np.random.default_rng(1).normal(size=(2000, 64)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    before = held()
    asked = df.where("id % 20 = 0")
    index = nearest.build(df)
    nearest.within(index, asked, 0.88).count()
    assert held() - before < 4 * x.nbytes and nearest.share_read(index, asked) > 0.5
