"""Content-addressed documents and the cache of what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(documents: DataFrame, text: str, key: str) -> DataFrame:
    """Bodies once per content hash, with the first key that brought it (provenance) and how many did."""
    d = documents.withColumn("sha", F.sha2(F.col(text), 256))
    return d.groupBy("sha").agg(F.min(key).alias("first_id"), F.count("*").alias("n"), F.max(F.octet_length(text)).alias("n_bytes"))


def write_bodies(documents: DataFrame, text: str, path: str) -> None:
    """Bodies as files partitioned by the first two digits of their hash."""
    d = documents.select(F.sha2(F.col(text), 256).alias("sha"), F.col(text).alias("body")).dropDuplicates(["sha"])
    d.withColumn("prefix", F.left("sha", F.lit(2))).repartition("prefix").write.partitionBy("prefix").mode("append").parquet(path)


def fresh(requests: DataFrame, cache: DataFrame, as_of: Column, allow_stale: bool = False) -> DataFrame:
    """Requests with what the cache has for them; an expired answer only with ``allow_stale``."""
    c = cache if allow_stale else cache.where(F.col("expires_at") > as_of)
    return requests.join(c, "cache_key", "left")


def already_answered(plans: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Plans without a fresh answer."""
    return plans.join(cache.where(F.col("expires_at") > as_of).select("cache_key"), "cache_key", "left_anti")


def stats(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"), F.sum("n_bytes").alias("n_bytes"),
        F.count_if(F.col("expires_at") > as_of).alias("fresh"))


def purge(cache: DataFrame, bodies: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Expired entries, and bodies that only they name."""
    gone = cache.where(F.col("expires_at") <= as_of)
    left = cache.where(F.col("expires_at") > as_of).select("sha")
    return gone, bodies.join(left, "sha", "left_anti")


def admission(requests: DataFrame) -> DataFrame:
    """The ordered decision on each request: enabled, cached, in flight, circuit, budget, robots, fetch."""
    c = F.col
    d = F.when(~c("enabled"), "disabled").when(c("cached"), "cache").when(c("in_flight"), "collapsed").when(c("circuit") == "open", "circuit_open")
    d = d.when(~c("budget_left"), "over_budget").when(~c("robots_allow"), "robots").otherwise("fetch")
    return requests.withColumn("decision", d)
