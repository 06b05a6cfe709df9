import numpy as np
import pytest

from tidemark.llm import ego


def brute(ids, vectors, threshold):
    good = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    n, comp = [0] * len(ids), list(range(len(ids)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(vectors[a]) == len(vectors[b]):
                x, y = (np.array(vectors[i], float) / np.abs(vectors[i]).max() for i in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    comp[find(b)] = find(a)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: (n[i], min(groups[find(i)])) for i in range(len(ids))}


def frame(spark, ids, vectors, kind="array<double>"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in zip(ids, vectors, strict=True)], f"vec_id long, embedding {kind}, label int, kept string")


def check(spark, ids, vectors, **how):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ego.near_duplicate_vectors(frame(spark, ids, vectors), **how).collect()}
    want = brute(ids, vectors, how.get("threshold", 0.95))
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    return got


@pytest.mark.parametrize("seed,block", [(0, 16), (1, 64), (2, 2048)])
def test_clusters(spark, seed, block):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 8))
    x = np.repeat(centres, 20, 0) + rng.standard_normal((240, 8)) * rng.uniform(0.01, 0.5, (240, 1))
    x = np.vstack([x, np.tile(centres[0], (40, 1)) * rng.uniform(0.5, 2, (40, 1)), x[:15], rng.standard_normal((60, 8))])
    ids = rng.permutation(len(x)).tolist()
    got = check(spark, ids, x.tolist(), block_rows=block)
    assert max(n for n, _, _ in got.values()) >= 54


def test_odd_vectors(spark):
    v = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0, 0.0], [1e-200, 0.0], [1e200, 1e198], [-1.0, 0.0], [-0.0, 1.0], [0.0, 1.0]]
    got = check(spark, list(range(len(v))), v)
    assert got[6] == (3, 6, True) and got[7][1] == 6 and got[8] == (0, 8, True)


def test_dense_group_is_proved_near(spark):
    rng = np.random.default_rng(5)
    x = np.ones((300, 4)) + rng.standard_normal((300, 4)) * 1e-4
    got = check(spark, list(range(300)), x.tolist(), block_rows=32)
    assert set(got.values()) == {(299, 0, i == 0) for i in (0, 1)}


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.1]), (3, [1.0, 0.1]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in ego.near_duplicate_vectors(df).collect()), key=repr)
    assert got == [(3, 2, 3), (3, 2, 3), (None, 0, None), (None, 2, 3)]
    assert ego.near_duplicate_vectors(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ego.near_duplicate_vectors(df, threshold=1.5)
