"""Sketches by hour: exact where calls are few, within their rank error beyond, and the same however they were merged."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import latency

KIND = "stage string, at timestamp_ntz, seconds double, ok boolean, hit boolean"


def calls(spark, n, k=40):
    x = spark.range(n).select(F.concat(F.lit("s"), F.pmod("id", F.lit(2)).cast("string")).alias("stage"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % (60 * k)).cast("int"))).alias("at"))
    return x.withColumns({"seconds": F.exp(F.randn(3)), "ok": F.rand(4) > 0.1, "hit": F.rand(5) > 0.5})


def test_rank_error(spark):
    c = calls(spark, 400_000).cache()
    got = {r["stage"]: r for r in latency.over(latency.rollup(c), "stage", quantiles=(0.01, 0.5, 0.95, 0.999)).collect()}
    for stage in ("s0", "s1"):
        v = np.sort([r[0] for r in c.where(F.col("stage") == stage).select("seconds").collect()])
        for q, name in ((0.01, "p1"), (0.5, "p50"), (0.95, "p95"), (0.999, "p99_9")):
            assert abs(np.searchsorted(v, got[stage][name]) / len(v) - q) < 3 / latency.K
        assert got[stage]["n"] == len(v)


def test_few_calls_are_exact_however_merged(spark):
    c = calls(spark, 3000).cache()
    whole = latency.rollup(c)
    parts = latency.added(*[latency.rollup(c.where(F.pmod(F.hash("seconds"), F.lit(3)) == i)) for i in range(3)])
    exact = {r["stage"]: r["v"] for r in c.groupBy("stage").agg(F.sort_array(F.collect_list("seconds")).alias("v")).collect()}
    for r in (whole, parts):
        for row in latency.over(r, "stage").collect():
            v = exact[row["stage"]]
            assert row["p50"] == v[math.ceil(0.5 * len(v)) - 1] and row["p95"] == v[math.ceil(0.95 * len(v)) - 1]
    assert parts.count() == whole.count() == 80


def test_cases(spark):
    rows = [("a", "2024-01-01 00:10:00", None, None, None), ("a", "2024-01-01 00:20:00", float("nan"), True, False), ("a", None, 9.0, False, True), ("b", "2024-01-01 01:59:59", 2.0, False, True), (None, "2024-01-01 02:00:00", 4.0, True, True), ("b", "2024-01-01 03:00:00", 6.0, True, False)]
    df = spark.createDataFrame([(s, t, x, o, h) for s, t, x, o, h in rows], "stage string, t string, seconds double, ok boolean, hit boolean").withColumn("at", F.col("t").cast("timestamp_ntz"))
    got = {r["stage"]: (r["n"], r["error_rate"], r["hit_rate"], r["p50"]) for r in latency.over(latency.rollup(df), "stage").collect()}
    assert got == {"a": (2, 0.0, 0.0, None), "b": (2, 0.5, 0.5, 2.0), None: (1, 0.0, 1.0, 4.0)}
    assert latency.over(latency.rollup(df.limit(0)), "stage").count() == 0
    last = {(r["stage"], str(r["until"])): r["n"] for r in latency.trailing(latency.rollup(df.where("stage = 'b'")), 3).collect()}
    assert last == {("b", "2024-01-01 01:00:00"): 1, ("b", "2024-01-01 03:00:00"): 2}


def test_one_scan(spark, data_dir):
    from tidemark import catalogue

    plan = catalogue.QUERIES["stage_latency"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2  # once in the initial plan, once in the final one


def test_counts_are_exact_beyond_the_sketch(spark):
    c = calls(spark, 60_000, 1).cache()  # 30,000 calls an hour and stage, where a sketch keeps 4096
    found = latency.counted(c)
    for got in (latency.exactly(found, "stage"), latency.trailing_exactly(found, 6)):
        for r in got.collect():
            v = sorted(x[0] for x in c.where(F.col("stage") == r["stage"]).select("seconds").collect())
            assert (r["n"], r["p50"], r["p95"]) == (len(v), v[math.ceil(0.5 * len(v)) - 1], v[-(-95 * len(v) // 100) - 1])


def test_counts_of_odd_calls(spark):
    rows = [("a", "2024-01-01 00:10:00", None, None, None), ("a", "2024-01-01 00:20:00", float("nan"), True, False), ("a", None, 9.0, False, True), ("b", "2024-01-01 01:59:59", 2.0, False, True), (None, "2024-01-01 02:00:00", 4.0, True, True), ("b", "2024-01-01 03:00:00", 6.0, True, False)]
    df = spark.createDataFrame(rows, "stage string, t string, seconds double, ok boolean, hit boolean").withColumn("at", F.col("t").cast("timestamp_ntz"))
    got = {r["stage"]: (r["n"], r["error_rate"], r["hit_rate"], r["p50"]) for r in latency.exactly(latency.counted(df), "stage").collect()}
    assert got == {"a": (2, 0.0, 0.0, None), "b": (2, 0.5, 0.5, 2.0), None: (1, 0.0, 1.0, 4.0)}
