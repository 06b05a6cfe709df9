"""Latency, errors and cache hits by stage and hour, merged over any window: sketches where an estimate does, counts by value where it doesn't.

A call is read once. Its hour keeps its counts and a quantile sketch of bounded size (some K numbers a level, few levels), so that a window
of any length is a merge of its hours' rows, whose number doesn't follow the calls. A quantile of n calls is exact where n is below K,
and beyond that off by a rank of about 2 / K. Counts by value (``counted``) give every quantile exactly; their rows are as many as
an hour has different latencies, and a window adds them up in order, so that Spark sorts them and no task holds a group.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 4096
QUANTILES = (0.5, 0.95)


def rollup(calls: DataFrame, k: int = K, unit: str = "hour") -> DataFrame:
    """(stage, hour, n, failed, hits, seconds, sketch) of calls (stage, at, seconds, ok, hit). A call without a time belongs to no hour and is left
    out; unknown seconds count as a call without a latency, unknown ``ok`` and ``hit`` as neither."""
    return _timed(calls, unit).groupBy("stage", "hour").agg(*_counts(), F.count("took").alias("timed"), F.kll_sketch_agg_double("took", F.lit(k)).alias("sketch"))


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("hit").alias("hits")]


def _timed(calls: DataFrame, unit: str) -> DataFrame:
    took = F.col("seconds").cast("double")
    return calls.where("at IS NOT NULL").select("stage", F.date_trunc(unit, "at").alias("hour"), F.when(~F.isnan(took), took).alias("took"), "ok", "hit")


def counted(calls: DataFrame, unit: str = "hour") -> DataFrame:
    """(stage, hour, took, n, failed, hits) of ``calls`` as for ``rollup``: a row for each latency that an hour has, and one for the calls without any."""
    return _timed(calls, unit).groupBy("stage", "hour", "took").agg(*_counts())


def exactly(counts: DataFrame, *by: Column | str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``over`` of what ``counted`` gave, with exact quantiles: the least latency that a share of at least q of the timed calls doesn't exceed."""
    g = counts.groupBy(*by, "took").agg(*[F.sum(c).alias(c) for c in ("n", "failed", "hits")])
    keys = [c for c in g.columns if c not in ("took", "n", "failed", "hits")]
    every, timed = Window.partitionBy(*keys), F.when(F.col("took").isNotNull(), F.col("n")).otherwise(0)
    g = g.withColumn("upto", F.sum(timed).over(every.orderBy("took").rowsBetween(Window.unboundedPreceding, 0))).withColumn("timed", F.sum(timed).over(every))
    # shares are decimals: 0.95 of 20 calls are 19, whatever doubles make of it
    least = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("timed") * F.lit(Decimal(str(q)))), F.col("took")))
    rate = lambda c: F.sum(c) / F.sum("n")
    return g.groupBy(*keys).agg(F.sum("n").alias("n"), rate("failed").alias("error_rate"), rate("hits").alias("hit_rate"), *[least(q).alias(_named(q)) for q in quantiles])


def _named(q: float) -> str:
    return f"p{q * 100:g}".replace(".", "_")


def added(*rollups: DataFrame, k: int = K) -> DataFrame:
    """Rollups of one kind as one: hours that several hold are merged, as those of late calls."""
    every = rollups[0]
    for r in rollups[1:]:
        every = every.unionByName(r)
    return _merged(every, ["stage", "hour"], k)


def _merged(rollups: DataFrame, by: list, k: int = K) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n", "failed", "hits", "timed")]
    return rollups.groupBy(*by).agg(*sums, F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def over(rollups: DataFrame, *by: Column | str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Of each group of hours (``by``, of stage and hour): n, error_rate, hit_rate, and a column for each quantile, p50 for 0.5; null without a latency."""
    m = _merged(rollups, list(by))
    at = [F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(_named(q)) for q in quantiles]
    keys = [c for c in m.columns if c not in ("n", "failed", "hits", "timed", "sketch")]
    return m.select(*keys, "n", (F.col("failed") / F.col("n")).alias("error_rate"), (F.col("hits") / F.col("n")).alias("hit_rate"), *at)


def trailing(rollups: DataFrame, hours: int = 24, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """For each hour that a stage has, ``over`` of the ``hours`` hours up to it: each row is sent to the hours that it counts for."""
    return over(_sent(rollups, hours), "stage", "until", quantiles=quantiles)


def trailing_exactly(counts: DataFrame, hours: int = 24, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``trailing`` of what ``counted`` gave, with exact quantiles."""
    return exactly(_sent(counts, hours), "stage", "until", quantiles=quantiles)


def _sent(rows: DataFrame, hours: int) -> DataFrame:
    ends = F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))
    sent = rows.withColumn("later", ends).withColumn("until", F.col("hour") + F.make_dt_interval(hours=F.col("later")))
    there = rows.select("stage", F.col("hour").alias("until")).distinct()
    return sent.join(there, ["stage", "until"], "left_semi")
