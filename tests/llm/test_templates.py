import pytest

from tidemark.llm import templates

ITEM = "Tom bought 5 kg of apples and 7 kg of pears from Anna on Monday. How many kg did Tom buy in all that day?"
FILLER = "Some other words that have nothing to do with any question at all. " * 3


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, "too short here", "x"), (3, None, "x"), (None, "An item without any number or name but with some words in it", "x")], "item_id long, text string, doc_id string")


CASES = [
    (1, FILLER + ITEM + " " + FILLER, {1}),
    (2, FILLER + ITEM.replace("Tom", "Bob").replace("5", "12").replace("Anna", "Jane").replace("kg", "lbs") + FILLER, {1}),
    (3, FILLER + ITEM.lower(), {1}),
    (4, FILLER, set()),
    (5, "How many kg did Tom buy " + FILLER, set()),
    (6, FILLER + "an item without any number or name but with some words in it", {None}),
    (7, None, set()),
    (8, "", set()),
    (9, "word " * 300_000 + ITEM, {1}),
]


def test_cases(docs, benchmark):
    got = {}
    for r in templates.contaminated(docs([(i, t) for i, t, _ in CASES]), benchmark).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert got == {i: want for i, _, want in CASES if want}


def test_slots_must_agree():
    b = templates.Benchmark([(1, ITEM)])
    mixed = "Tom bought 5 kg of apples and 7 lbs of pears from Tom on Tom. How many oz did Jane buy in all that day?"
    whole, part = b.find(ITEM)[0][2], b.find(mixed)
    assert whole == 1.0 and (not part or part[0][2] < whole)


def test_parts_of_long_texts(monkeypatch):
    b = templates.Benchmark([(1, ITEM)])
    text = FILLER + ITEM + " " + FILLER
    want = b.find(text)
    for n in (3, 7, 40, 100):
        monkeypatch.setattr(templates, "PART_CHARS", n)
        assert b.find(text) == want and want[0][3] == len(FILLER.split())


def test_benchmark_in_parts(docs, benchmark, monkeypatch):
    monkeypatch.setattr(templates, "BROADCAST_TOKENS", 5)
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(docs([(i, t) for i, t, _ in CASES]), benchmark).collect()}
    assert got == {(i, x) for i, _, want in CASES for x in want}


def test_rows(docs, benchmark):
    df = docs([(1, ITEM), (1, ITEM), (None, ITEM), (2, FILLER)])
    assert sorted((r["doc_id"] or 0) for r in templates.contaminated(df, benchmark).collect()) == [0, 1, 1]
    kept = templates.keep_clean(df, benchmark)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert templates.contaminated(df.limit(0), benchmark).count() == 0 and templates.contaminated(df, benchmark.limit(0)).count() == 0
    assert templates.keep_clean(df, benchmark.limit(0)).count() == 4


def test_whole_table_against_brute_force(spark):
    """Word windows compared one by one, without hashes and placeholders."""
    d = "/root/testdata/sf0.001"
    items = {r["item_id"]: r["text"].split() for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        words = r["text"].split()
        have = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for i, w in items.items():
            windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            if windows and sum(x in have for x in windows) / len(windows) >= templates.COVERAGE:
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in templates.op10_template_windows(spark, d).collect()}
    assert want <= got and len(got - want) <= 2


TITLE = "Who Wrote The Famous Novel Pride And Prejudice In The Early Nineteenth Century"
SERIES = "What comes next in 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096?"
LIST = "Sort the list 5 3 9 1 12 44 7 8 2 6 10 11 13"


@pytest.mark.parametrize("item", [TITLE, SERIES, LIST])
def test_copies_with_runs_of_placeholders(item):
    b = templates.Benchmark([(1, item)])
    assert b.find(FILLER + item + " " + FILLER)[0][2] == 1.0
    assert b.find(FILLER + item.lower() + " " + FILLER)
    assert not b.find(FILLER)


def test_other_values_in_runs_of_placeholders():
    b = templates.Benchmark([(1, LIST), (2, SERIES), (3, TITLE)])
    assert [f[0] for f in b.find(FILLER + "Sort the list 8 30 90 10 21 45 70 80 20 60 100 110 130 " + FILLER)] == [1]
    assert [f[0] for f in b.find(FILLER + "What comes next in 3, 6, 12, 24, 48, 96, 192, 384, 768, 1536, 3072, 6144? " + FILLER)] == [2]
    # one window of a title, or figures alone, are no copy
    assert not b.find(FILLER + "Who Sang The Popular Song Yellow River On The Late Television Show " + FILLER)
    assert not b.find(FILLER + "8 30 90 10 21 45 70 80 20 60 100 110 130 " + FILLER)


def test_short_items():
    b = templates.Benchmark([(1, "Name the tallest mountain"), (2, "Why?"), (3, "  "), (4, "Two 5 kg")])
    assert [f[0] for f in b.find(FILLER + "name the tallest mountain! " + FILLER)] == [1]
    assert [f[0] for f in b.find("Oh why")] == [2] and not b.find(FILLER + "Name the tallest building") and not b.find("")
    assert [f[0] for f in b.find("two 5 kg")] == [4] and not b.find("two 6 kg")


def test_repetitive_texts():
    import time

    items = [(i, f"item{i} " + "north south east west 5 kg " * 16) for i in range(100)]
    b = templates.Benchmark(items)
    for text in ("north south east west 5 kg " * 333, "north south east west 7 kg " * 333, "".join(f"north south east west {i} kg " for i in range(333))):
        began = time.time()
        found = b.find(text)
        assert time.time() - began < 3 and (text.count(" 5 kg") < 300 or len(found) == 100)


def test_many_items_of_one_template():
    """The work on a document follows its hits: items that share all windows are looked at together."""
    import time

    item = "A train leaves {} at {} miles an hour and another train follows {} hours later at {} miles an hour on the same track to {}".format
    names = ["Paris", "London", "Berlin", "Madrid", "Rome"]
    items = [(i, item(names[i % 5], 30 + i, 2 + i % 7, 90 + i, names[(i + 1 + i // 5 % 4) % 5])) for i in range(16_000)]
    b = templates.Benchmark(items)
    text = FILLER * 4 + item("Vienna", 11, 3, 12, "Prague") + " " + FILLER * 4
    b.find(text)
    took = []
    for _ in range(3):
        began = time.process_time()
        found = b.find(text)
        took.append(time.process_time() - began)
    assert {f[0] for f in found} == set(range(16_000)) and min(took) < 1.5  # some 0.3 s on an idle machine; a comparison of all hits with every item takes minutes
    # the same rows as one by one
    for i in (0, 7, 15_999):
        assert templates.Benchmark([items[i]]).find(text) == [f for f in found if f[0] == i]
    # equal values in the document where the item's differ match no more with many items than with one
    for other in (item("Vienna", 5, 5, 5, "Vienna"), item("Vienna", 11, 11, 12, "Prague")):
        few = {i: templates.Benchmark([items[i]]).find(FILLER + other) for i in (0, 3, 99)}
        many = b.find(FILLER + other)
        assert all([f for f in many if f[0] == i] == few[i] for i in few)


def test_groups_of_items_change_nothing(monkeypatch):
    items = [(i, f"Tom bought {i} kg of apples and {i + k} kg of pears from Anna on Monday, or so they say") for i in range(30) for k in (0, 3)]
    b = templates.Benchmark(items)
    text = FILLER + "Bob bought 5 kg of apples and 8 kg of pears from Jane on Friday, or so they say " + FILLER
    want = b.find(text)
    assert want
    for n in (1, 50, 333):
        monkeypatch.setattr(templates, "HITS", n)
        assert b.find(text) == want


@pytest.mark.parametrize("kind,value", [("int", 7), ("smallint", 7), ("string", "a"), ("date", "2024-02-03"), ("double", 0.5), ("decimal(9,2)", "1.50"), ("timestamp", "2024-02-03 04:05:06")])
def test_ids_of_any_type(spark, kind, value):
    """Batches with and without hits, and null ids, on both sides."""
    from pyspark.sql import functions as F

    bench = spark.createDataFrame([(str(value), ITEM), (None, ITEM)], "i string, text string").select(F.col("i").cast(kind).alias("item_id"), "text")
    docs = spark.createDataFrame([(str(value), ITEM), (str(value), FILLER), (None, FILLER), (None, ITEM)], "i string, text string").select(F.col("i").cast(kind).alias("doc_id"), "text")
    rows = templates.contaminated(docs.repartition(4), bench)
    assert rows.schema["item_id"].dataType == bench.schema["item_id"].dataType and rows.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    one = bench.first()["item_id"]
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in rows.collect()) == sorted((str(a), str(b)) for a in (one, None) for b in (one, None))
    assert templates.contaminated(docs.where("text like 'Some%'"), bench).count() == 0
    assert templates.keep_clean(docs, bench).count() == 2


def _windows_by_hand(item, text):
    """Passing windows of ``item`` in ``text``, every pair of places compared."""
    w, x = item.split(), text.split()
    (ta, pa), (tb, pb) = (tuple(c.tolist() for c in templates.canonical(y)) for y in (w, x))
    core = lambda y: [templates._TRIM.sub("", z).lower() for z in y]
    a, b = core(w), core(x)
    n = templates.WINDOW
    passed = set()
    diagonals = {}
    for q in range(len(w) - n + 1):
        for p in range(len(x) - n + 1):
            if a[q : q + n] == b[p : p + n]:
                passed.add(q)
            readings = [c[q : q + n] for c in (ta, pa)]
            if any(c[p : p + n] in readings for c in (tb, pb)) and any(ta[q + k] >= 16 and a[q + k] == b[p + k] for k in range(n)):
                diagonals.setdefault(p - q, []).append(q)
    for d, qs in diagonals.items():
        slots = sorted({k for q in qs for k in range(q, q + n)})
        kind = {k: ta[k] if ta[k] < 16 else templates.NAME if a[k] != b[k + d] else 0 for k in slots}
        there, back = {}, {}
        for k in slots:
            if kind[k]:
                there.setdefault((kind[k], a[k]), b[k + d]), back.setdefault((kind[k], b[k + d]), a[k])
        bad = {k for k in slots if kind[k] and (there[kind[k], a[k]] != b[k + d] or back[kind[k], b[k + d]] != a[k])}
        passed |= {q for q in qs if not bad & set(range(q, q + n))}
    return passed


def test_windows_against_brute_force():
    import random

    rng = random.Random(8)
    pool = ["Tom", "Anna", "buys", "sells", "apples", "5", "7", "9", "kg", "lbs", "and", "Then", "pears."]
    for _ in range(400):
        item = " ".join(rng.choice(pool) for _ in range(rng.randint(5, 14)))
        text = " ".join([*(rng.choice(pool) for _ in range(3)), *(rng.choice(pool) if rng.random() < 0.2 else w for w in item.split()), *(rng.choice(pool) for _ in range(rng.randint(0, 9)))])
        want = _windows_by_hand(item, text)
        got = templates.Benchmark([(1, item)]).find(text)
        if got:
            assert got[0][1] == len(want)
        else:
            assert len(want) < 0.5 * (len(item.split()) - 4)
