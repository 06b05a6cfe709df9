import random
import zlib

from tidemark.llm import quality


def corpus(n=400):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs(rows), lab, sample=200).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_play_no_part(spark, docs):
    rows, labels = corpus(120)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    frames = [spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (labels, turned)]
    # the share of labels is that of the rows learnt from
    a, b = ([(r["doc_id"], r["score"]) for r in quality.quality_scores(docs(rows), f).orderBy("doc_id").collect()] for f in frames)
    assert a == b


def test_odd_rows(spark, docs):
    rows, labels = corpus(80)
    odd = [(None, "abc def"), (1001, None), (1002, ""), (1003, " \n "), (1004, "word " * 200_000), (5, rows[5][1])]
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs(rows + odd), lab).collect()
    assert len(got) == 86 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1001, 1002, 1003)}) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    none = quality.quality_scores(docs(rows[:3]), lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(docs([]), lab).count() == 0


def test_keep_good(spark, docs):
    rows, labels = corpus(200)
    df = docs(rows)
    kept = quality.keep_good(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids ^ {i for i, q, _ in labels if q}) <= 4


def vote(model, text):
    """One score, all labelled vectors compared one by one."""
    import numpy as np

    counts, sizes = quality.term_counts([text])
    if not sizes[0]:
        return model.prior
    z = model.latent(counts, sizes)[0].astype(float)
    near = sorted(((sum(map(float, z * v)), y) for v, y in zip(model.vectors.astype(float), model.labels, strict=True)), reverse=True)
    least = near[min(quality.K, len(near)) - 1][0]
    w = [(max(c, 0.0) ** 4, y) for c, y in near if c >= least - quality.TIE]
    total = sum(x for x, _ in w)
    return float(np.clip(sum(x * y for x, y in w) / total, 0, 1)) if total > 1e-12 else model.prior


def test_blocked_product_is_exact():
    rows, labels = corpus(60)
    rows, labels = rows * 2, labels * 2  # every vector ties with another
    texts = [t for _, t in rows]
    counts, sizes = quality.term_counts(texts)
    m = quality.fit_counts(counts, sizes, [q for _, q, _ in labels], 0.5)
    for t, s in zip(texts, m.score(texts), strict=True):
        assert abs(s - vote(m, t)) < 1e-6


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs_, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    m = quality.fit(docs_, labels)
    got = {r["doc_id"]: r["score"] for r in quality.op7_neighbour_voting(spark, d).collect()}
    want = {r["doc_id"]: vote(m, r["text"] or "") for r in docs_.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_a_hot_doc_id_sends_one_row(spark, docs, monkeypatch):
    rows, labels = corpus(40)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hot = docs(rows).union(docs([rows[1]]).crossJoin(spark.range(20_000)).drop("id"))
    seen, own = [], type(hot).collect

    def collect(df):
        out = own(df)
        seen.append(len(out))
        return out

    monkeypatch.setattr(type(hot), "collect", collect)
    m = quality.fit(hot, lab)
    assert max(seen) <= 40 and len(m.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)


def test_parts_of_long_texts(monkeypatch):
    import numpy as np

    texts = ["One two two THREE!! four 5 $$$ " * 30, "", "x"]
    want = quality.term_counts(texts)
    for n in (1, 8, 33):
        monkeypatch.setattr(quality, "PART_CHARS", n)
        got = quality.term_counts(texts)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
