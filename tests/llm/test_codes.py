"""Op 13 against plain Python, and the partial-distance search against the whole one."""

import hashlib
from math import floor

import numpy as np
import pytest

from tidemark.llm import codes

KIND = "vec_id long, embedding array<float>, label int, code string, of int, LABEL string, x string"


def brute(rows, entries=16, rounds=6):
    """vec_id, code, error, label_error, codebooks_sha256 in Python integers; lengths are taken one by one."""
    finite = lambda v: v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)
    out = []
    for n in sorted({len(v) for _, v, _ in rows if finite(v)}):
        kept = sorted(((i, v, lab) for i, v, lab in rows if finite(v) and len(v) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = [i * (n // 8) + min(i, n % 8) for i in range(9)]
        parts = [[[floor(4096 * x) for x in v[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)] for _, v, _ in kept]
        books = [[list(p[j]) for p in parts[:entries]] for j in range(8)]

        def assign(j, parts=parts, books=books):
            far = [[sum((a - b) ** 2 for a, b in zip(p[j], e, strict=True)) for e in books[j]] for p in parts]
            return [(min(range(len(d)), key=d.__getitem__), min(d)) for d in far]

        for _ in range(rounds):
            for j in range(8):
                at = assign(j)
                for k in range(len(books[j])):
                    own = [p[j] for p, (a, _) in zip(parts, at, strict=True) if a == k]
                    if own:
                        books[j][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
        found = [assign(j) for j in range(8)]
        name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        out += [(i, "".join(f"{found[j][r][0]:02x}" for j in range(8)), sum(found[j][r][1] for j in range(8)), lab, name) for r, (i, _, lab) in enumerate(kept)]
    return [(i, code, e, sum(o[2] for o in out if o[3] == lab), name) for i, code, e, lab, name in out]


def make(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 9, "L", "x") for i, v, lab in rows], KIND)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def check(spark, rows):
    got = sorted(map(tuple, codes.codes(make(spark, rows)).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


def f32(v):
    return [float(x) for x in np.asarray(v, np.float32)]


def test_against_plain_python(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f32(rng.normal(size=16)), i % 3 if i % 7 else None) for i in range(150)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[9][1], None), (None, f32(range(16)), 2)]
    rows += [(201, None, 0), (202, [1.0, None] * 8, 0), (203, [float("nan")] * 16, 0), (204, [float("-inf")] * 16, None)]
    assert len(check(spark, rows)) == 154


def test_ties_and_few_vectors(spark):
    check(spark, [(i, f32([i % 2] * 8), 0) for i in range(40)])
    check(spark, [(3, f32(range(8)), None)])
    assert codes.codes(make(spark, [])).count() == 0
    assert codes.codes(make(spark, [(1, None, 1)])).count() == 0


def test_other_lengths(spark):
    """Lengths have books of their own; 8 needn't divide them, and a vector may be empty."""
    rng = np.random.default_rng(2)
    rows = [(i, f32(rng.normal(size=(16, 11, 3, 0)[i % 4])), i % 2) for i in range(80)]
    check(spark, rows)


def test_large_values(spark):
    """Beyond 64-bit squares for some of the rows, exact for all of them."""
    rng = np.random.default_rng(3)
    rows = [(i, f32(rng.normal(size=8) * (2.0**30 if i % 2 else 1)), 0) for i in range(40)]
    rows = [(i, v, None if i < 16 else 0) for i, v, _ in rows][:16]
    check(spark, rows)


@pytest.mark.parametrize("scale", [3, 1000, 2**29, 2**33])
def test_partial_search_is_the_whole_search(scale):
    rng = np.random.default_rng(4)
    x, book = rng.integers(-scale, scale + 1, (500, 8)), rng.integers(-scale, scale + 1, (16, 8))
    book[5] = book[2]  # a tie that the lower index wins
    x[:16] = book
    seen = []
    at, d = codes.nearest(x, book, None, seen)
    want = [[sum((a - b) ** 2 for a, b in zip(r, e, strict=True)) for e in book.tolist()] for r in x.tolist()]
    assert at.tolist() == [min(range(16), key=w.__getitem__) for w in want]
    assert list(map(int, d)) == [min(w) for w in want]
    assert sum(seen) < x.size * 16  # some dimensions were never added up


def test_dimensions_in_descending_variance():
    book = np.array([[0, 5, 1], [0, -5, 2], [0, 9, 3]])
    assert codes.variance_order(book) == [1, 2, 0]


def test_against_sql(spark, duck, same, data_dir):
    same(codes.op13_partial_distance(spark, data_dir).toPandas(), duck.sql(codes.OP13_SQL).df())
