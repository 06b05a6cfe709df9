"""Decisions about calls, posts, leases, prose and plans: pure functions of facts, held against the rules in Python."""

from itertools import product

from pyspark.sql import functions as F

from tidemark.operators import cache, planning, reads
from tidemark.plans import versions
from tidemark.sources import catalog


def test_admission(spark):
    """The first refusal in order counts."""
    names = ["enabled", "cached", "in_flight", "circuit", "budget_left", "robots_allow"]
    rows = [(e, c, i, "open" if o else "closed", b, r) for e, c, i, o, b, r in product([True, False], repeat=6)]
    got = cache.admission(spark.createDataFrame(rows, "enabled boolean, cached boolean, in_flight boolean, circuit string, budget_left boolean, robots_allow boolean"))
    for r in got.collect():
        e, c, i, o, b, a = (r[n] for n in names)
        assert r["decision"] == ("disabled" if not e else "cache" if c else "collapsed" if i else "circuit_open" if o == "open" else "over_budget" if not b else "robots" if not a else "fetch")


def test_posts_and_leases(spark):
    tries = [([204], (True, 204, 1, False)), ([429, None, 200], (True, 200, 3, False)), ([503, 400, 200], (False, 400, 2, False)), ([500] * 6, (False, None, 5, True))]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(tries)], "k int, t array<int>")
    got = {r["k"]: tuple(r["x"][n] for n in ("ok", "status", "attempts", "exhausted")) for r in df.select("k", reads.post_outcome(F.col("t")).alias("x")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(tries)}
    took = spark.createDataFrame([(float(t),) for t in (0, 30, 60, 61, 899, 900, 901, 5000)], "t double").select("t", reads.lease_run(F.col("t"), 60.0, 900.0).alias("x"))
    for r in took.collect():
        assert r["x"]["outcome"] == ("cancelled" if r["t"] > 900 else "done") and r["x"]["renewals"] == max(0, -(-min(r["t"], 900) // 60) - 1)


def test_generation_and_prose(spark):
    rows = list(product([True, False], repeat=7))
    df = spark.createDataFrame(rows, "a boolean, dn boolean, b boolean, allowed boolean, configured boolean, affordable boolean, ok boolean")
    c = F.col
    tries = F.array(F.struct(c("a").alias("ok"), c("dn").alias("down")), F.struct(c("b").alias("ok"), F.lit(False).alias("down")))
    cloud = F.struct("allowed", "configured", "affordable", "ok")
    for r in df.select("*", reads.generation(tries, cloud).alias("x")).collect():
        local = 1 if r["a"] else 2 if not r["dn"] and r["b"] else None
        why = next((t for n, t in (("allowed", "not permitted"), ("configured", "not configured"), ("affordable", "budget exhausted"), ("ok", "attempt failed")) if not r[n]), None)
        assert r["x"]["local_attempt"] == local and r["x"]["escalated"] == (local is None and why is None) and r["x"]["reason"] == (why if local is None else None)
    facts = [(d, k, n, m, t, a) for d in ("a.io", None) for k in (True, False) for n in (0, 2) for m in (True, False) for t in (True, False) for a in (True, False)]
    df = spark.createDataFrame(facts, "domain string, known boolean, n int, model boolean, retry boolean, angle boolean")
    for r in df.select("*", reads.prose_decision(c("domain"), c("known"), c("n"), c("model"), c("retry"), c("angle")).alias("x")).collect():
        want = "no domain" if not r["domain"] else "not found" if not r["known"] else "no live trigger" if not r["n"] else "no model" if not r["model"] else "moot" if r["retry"] and r["angle"] else "ask"
        assert r["x"] == want


def test_sources_and_versions(spark):
    S = catalog.Source
    every = [S("stories", "A", "discovery"), S("web", "C", "discovery", True, "search"), S("off", "B", "discovery", enabled=False), S("rdap", "A", "enrichment")]
    got = {tuple(r) for r in catalog.by_role(catalog.frame(spark, every), "discovery").select("id", "legality", "costed").collect()}
    assert got == {("web", "C", True), ("stories", "A", False)}
    assert versions.schema_versions(["0010_last.sql", "0001_first.sql", "0002_more.sql"], ["0001_first"]) == [("0001_first", True), ("0002_more", False), ("0010_last", False)]


def test_plans(spark):
    rows = [("a", False, 96, ["T3_HIRING_SEC", "T4_HIRING_AI_ONLY"]), ("b", False, 92, ["T4_HIRING_AI_ONLY"]), ("c", True, 90, ["T1_AI_SHIP"])]
    rows += [("d", True, 80, ["T1_AI_SHIP"]), ("e", True, 70, ["T9_MARKETPLACE"]), ("f", False, 35, ["T2_FUNDING"])]
    t = spark.createDataFrame(rows, "template string, costed boolean, weight int, targets array<string>")
    exhausted = spark.createDataFrame([("b",)], "template string")
    plain = [tuple(r) for r in planning.plan(t, exhausted).select("template", "costed", "weight").collect()]
    assert all(name != "b" for name, *_ in plain) and sum(costed for _, costed, _ in plain) == 2
    costs = t.withColumns({"provider": F.when(F.col("template") == "d", "one").when(F.col("template") == "e", "three").otherwise("two"), "cost": F.lit(5)})
    left = spark.createDataFrame([("one", 5), ("two", 4)], "provider string, units_left int")
    assert {tuple(r) for r in planning.plan(costs, exhausted, budgets=left).select("template", "costed", "weight").collect()} == {("a", False, 96), ("f", False, 35), ("d", True, 80)}
    want = {("T3_HIRING_SEC", "a"), ("T4_HIRING_AI_ONLY", "a,b"), ("T1_AI_SHIP", "c,d"), ("T9_MARKETPLACE", "e"), ("T2_FUNDING", "f")}
    assert {tuple(r) for r in planning.coverage(t).collect()} == want
