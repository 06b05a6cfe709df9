"""Whole inputs, and pairs without blocking."""

from itertools import combinations

from tidemark import catalogue
from tidemark.functions.text import normalize_name
from tidemark.operators import resolve


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_two_edits_anywhere(spark):
    names = ["", "a", "ab", "Brand#12", "brand#12", "Grand#12", "and#12", "xxBrand#12", "Brand#21", "Brnad#12", "other", "another", "BBrand", "rand"]
    got = {tuple(r) for r in resolve.within_two_edits(spark.createDataFrame([(n,) for n in names + names], "n string")).collect()}
    assert got == {(*sorted(p), levenshtein(*p)) for p in combinations(names, 2) if levenshtein(*p) <= 2}


def test_clusters(spark):
    rows = [(1, "Harbour Analytics", None, 3), (2, "Harbour Analytic", None, 1), (3, "Harbor Analytic", None, 2), (4, "Quarry Tools", "US", 1), (5, "Quarry Tools", "DE", 1), (6, "Something Else", None, 1)]
    c = spark.createDataFrame([(i, None, f"https://site{i}.com/", n, k, t) for i, n, k, t in rows], "id long, claimed string, url string, name string, country string, created_at long")
    got = {r["id"]: r["entity_id"] for r in resolve.entity_clusters(c).collect()}
    norm = {r["i"]: r["n"] for r in c.select(c.id.alias("i"), normalize_name(c.name).alias("n")).collect()}
    at = {i: (t, i) for i, _, _, t in rows}
    up = {i: {i} for i in norm}
    for (a, _, ka, _), (b, _, kb, _) in combinations(rows, 2):
        if resolve.indel_ratio(norm[a], norm[b]) >= 92 and (not ka or not kb or ka == kb):
            up[a] |= up[b]
            for i in up[a]:
                up[i] = up[a]
    assert got == {i: min(at[j] for j in up[i])[1] for i in up} and got[1] == got[3] == 2


def test_whole_documents_and_pages(spark, duck, same, data_dir):
    for name in ("secret_scrub", "site_pages"):
        assert "left(" not in catalogue.ORACLE_SQL[name]
        same(catalogue.QUERIES[name](spark, data_dir).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_registered(spark, data_dir):
    rows = catalogue.QUERIES["entity_clusters"](spark, data_dir).collect()
    assert len(rows) == len({r["id"] for r in rows}) and {r["entity_id"] for r in rows} <= {r["id"] for r in rows}


def test_domains_are_read_once(spark):
    """What follows the companies reads them and not the candidates again."""
    c = spark.createDataFrame([(1, None, "https://a.com/", "Harbour", None, 1), (2, None, "https://b.com/", "Harbour", None, 2)], "id long, claimed string, url string, name string, country string, created_at long")
    got = resolve.entity_clusters(c)
    assert "claimed" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["entity_id"] for r in got.collect()} == {1: 1, 2: 1}
