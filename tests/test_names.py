"""The name join against all pairs, at any threshold, with names of any length."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import names


def pairs(spark, rows, threshold):
    df = spark.createDataFrame(rows, "id long, name string, country string")
    got = [(r["a_id"], r["b_id"], round(r["score"], 6)) for r in names.name_pairs(df, threshold, normalized=True).collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute(rows, threshold):
    """Every pair of points compared; equal rows link to the first."""
    points = {}
    for i, n, c in rows:
        if n:
            points[n, c or ""] = min(i, points.get((n, c or ""), i))
    out = {(points[n, c or ""], i, 100.0) for i, n, c in rows if n and points[n, c or ""] != i}
    held = sorted(points.items(), key=lambda x: x[1])
    for k, ((n, c), i) in enumerate(held):
        for (m, d), j in held[k + 1 :]:
            score = 100.0 if n == m else names.indel_ratio(n, m)
            if score >= threshold and (not c or not d or c == d):
                out.add((i, j, round(score, 6)))
    return out


def made(seed, letters, longest, n=70):
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), w, rng.choice([None, None, "US", "BD"])))
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 2)
            w = "".join(w)
    return rows


@pytest.mark.parametrize("threshold,letters,longest", [(92, "abcdefgh ", 40), (88, "ab", 30), (80, "abcé日𝔘 ", 20), (67, "abcd", 9), (51, "abc", 6), (100, "abc", 4), (90, "abcdefghij", 90)])
def test_all_pairs(spark, threshold, letters, longest):
    rows = made(threshold, letters, longest)
    want = brute(rows, threshold)
    assert want and pairs(spark, rows, threshold) == want


def test_cases(spark):
    assert pairs(spark, [], 92) == set() and pairs(spark, [(1, None, None), (2, "", None)], 92) == set()
    rows = [(3, "acme", None), (1, "acme", None), (2, "acme", "US"), (4, "acme", "BD"), (5, "b", None), (6, "b", "US"), (7, "x" * 300, None), (8, "x" * 299 + "y", None)]
    assert pairs(spark, rows, 92) == brute(rows, 92)
    with pytest.raises(ValueError):
        names.name_pairs(spark.createDataFrame([(1, "a", None)], "id long, name string, country string"), 50)


def test_no_frequent_key(spark):
    """Names that share all but their last characters: no key gathers them."""
    df = spark.range(3000).select("id", F.format_string("customer%09d", F.col("id") * 7).alias("name"), F.lit(None).cast("string").alias("country"))
    keys = names.keyed(df.select("id", F.col("name").alias("n")), 0.08)
    assert keys.groupBy("key", "shorter").count().agg(F.max("count")).first()[0] <= 1500  # of 3000 names, each with ten keys
    rows = [(r["id"], r["name"], None) for r in df.where("id < 300").collect()]
    assert pairs(spark, rows, 92.0) == brute(rows, 92.0)


def test_ratios_in_blocks():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé日𝔘") for _ in range(rng.choice([0, 1, 5, 20, 63, 64, 65, 130])))
    a, b = [word() for _ in range(300)], [word() for _ in range(300)]
    assert names.indel_ratios(a, b).tolist() == [names.indel_ratio(x, y) for x, y in zip(a, b, strict=True)]


def test_lost_characters():
    """No pair that is alike loses more grams than the bounds say."""
    for a, b in ((x, y) for x in range(1, 30) for y in range(x, 30)):
        gone = names.lost(a, b, 0.2)
        assert (gone is None) == (200 * a / (a + b) < 80 - 1e-9)
        assert gone is None or (gone[1] - gone[0] == b - a and sum(gone) <= 0.2 * (a + b) + 1e-9)
