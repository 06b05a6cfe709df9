"""As-of joins and intervals against plain Python."""

import random
from datetime import datetime, timedelta

from tidemark.operators import history

T0 = datetime(2024, 1, 1)


def made(seed, n=400):
    rng = random.Random(seed)
    at = lambda: T0 + timedelta(hours=rng.randrange(24 * 9), minutes=rng.choice([0, 0, 30]))
    changes = {(rng.choice([1, 2, 3, 3, 3, 3, None]), at()): rng.choice(["A", "B", "C", None]) for _ in range(n // 4)}
    rows = [(rng.choice([1, 2, 3, 3, 3, 3, 4, None]), rng.choice([at(), at(), at(), None]), i) for i in range(n)]
    return [(k, t, v) for (k, t), v in changes.items() if k is not None], rows


def frames(spark, changes, rows):
    return spark.createDataFrame(changes, "k long, at timestamp_ntz, value string"), spark.createDataFrame(rows, "k long, at timestamp_ntz, _kind long")


def test_as_of(spark):
    for seed in range(3):
        changes, rows = made(seed)
        c, r = frames(spark, changes, rows)
        got = history.as_of(r, c, "tier")
        assert got.columns == ["k", "at", "_kind", "tier"]
        want = {}
        for k, t, i in rows:
            before = [(u, v) for j, u, v in changes if j == k and t is not None and u <= t]
            want[i] = max(before, key=lambda x: x[0])[1] if before else None
        assert {x["_kind"]: x["tier"] for x in got.collect()} == want


def test_intervals(spark):
    changes, _ = made(5)
    got = sorted(((r["k"], r["from_at"], r["value"], r["to_at"]) for r in history.intervals(frames(spark, changes, [])[0]).collect()), key=lambda x: x[:2])
    want = []
    for k in (1, 2, 3):
        own = sorted(((t, v) for j, t, v in changes if j == k), key=lambda x: x[0])
        kept = [x for i, x in enumerate(own) if i == 0 or own[i - 1][1] != x[1]]
        want += [(k, t, v, kept[i + 1][0] if i + 1 < len(kept) else None) for i, (t, v) in enumerate(kept)]
    assert got == want


def test_no_rows(spark):
    c, r = frames(spark, [], [(1, T0, 1)])
    assert [x["value"] for x in history.as_of(r, c).collect()] == [None] and history.as_of(r.limit(0), c).count() == 0 and history.intervals(c).count() == 0


def test_dispatched(spark):
    at = lambda h: T0 + timedelta(hours=h)
    scores = [(1, at(0), "A"), (1, at(50), "C"), (2, at(0), "C"), (2, at(60), "A"), (3, at(70), "B"), (4, at(0), "C"), (4, at(9), "A"), (5, at(0), "REJECT"), (5, at(40), "B")]
    sent = [(k, at(30)) for k in (1, 2, 3, 4, 5, 6)] + [(1, at(55))]
    live = spark.createDataFrame([(1,), (2,), (2,), (3,), (5,)], "k long")
    x = history.dispatched_tiers(spark.createDataFrame(sent, "k long, at timestamp_ntz"), spark.createDataFrame(scores, "k long, at timestamp_ntz, value string"), live)
    got = {r["k"]: (r["then"], r["now"], r["demoted"], r["archived"], r["resend"]) for r in x.collect()}
    assert got == {1: ("A", "C", True, False, False), 2: ("C", "A", False, False, True), 3: (None, "B", False, False, False), 4: ("A", "A", False, True, False), 5: ("REJECT", "B", False, False, True), 6: (None, None, False, True, False)}
