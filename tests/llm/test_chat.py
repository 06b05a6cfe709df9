import pytest

from tidemark.llm import chat

KIND = "conv_id long, turn long, role string, text string, part string, k string"


def rendered(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def brute(rows):
    """Maximal conversations by plain comparison of turn lists."""
    convs = {}
    for c, n, r, t in {(c, n, (r if r is not None else "unknown"), t or "") for c, n, r, t in rows}:
        convs.setdefault(c, []).append((n is not None, n or 0, r, t))
    lists = {c: [(r.replace("<|", "< |"), t.replace("<|", "< |")) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    order = lambda c: (c is None, c or 0)
    gone = {a for a in lists for b in lists if a != b and lists[b][: len(lists[a])] == lists[a] and (len(lists[b]) > len(lists[a]) or order(b) < order(a))}
    return {c: rendered(x) for c, x in lists.items() if c not in gone}


def make(spark, rows):
    return spark.createDataFrame([(*r, "p", "k") for r in rows], KIND)


ROWS = (
    [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    + [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c")]
    + [(3, 0, "user", "a"), (3, 1, "assistant", "B"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c")]
    + [(5, 0, "user", None), (5, 0, "user", None), (5, 1, None, "x <|user|> y"), (None, 0, "user", "q"), (None, None, "user", "first")]
    + [(6, 0, "user", "dup"), (6, 0, "user", "dup"), (7, 0, "user", "dup"), (7, 1, "assistant", ""), (8, 3, "user", "long " * 5000)]
)


def test_collapse(spark):
    got = {r["conv_id"]: r["text"] for r in chat.collapse_and_render(make(spark, ROWS)).where("part IS NOT NULL OR conv_id IS NULL").collect() if r["part"] is not None}
    want = brute(ROWS)
    null = want.pop(None)
    assert {k: v for k, v in got.items() if k is not None} == want
    parts = chat.collapse_and_render(make(spark, ROWS)).where("conv_id IS NULL").orderBy("part").collect()
    assert "".join(r["text"] for r in parts) == null


@pytest.mark.parametrize("seed", [1, 2])
def test_random_prefixes_and_parts(spark, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for c in range(60):
        n = rng.randint(1, 7)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab") if t else "same") for t in range(n)]
    for part in (256, 2):
        got = {}
        for r in chat.collapse_and_render(make(spark, rows), part).orderBy("conv_id", "part").collect():
            got[r["conv_id"]] = got.get(r["conv_id"], "") + r["text"]
        assert got == brute(rows)


def test_no_python_in_plan(spark):
    plan = chat.collapse_and_render(make(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert chat.collapse_and_render(make(spark, [])).count() == 0


def test_against_sql(spark, duck, same, data_dir):
    same(chat.op1_snapshot_collapse(spark, data_dir).toPandas(), duck.sql(chat.OP1_SQL).df())
