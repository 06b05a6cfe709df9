"""The domain's relations as views over the test tables.

Every operator takes relations with these columns; a user binds them to landed data instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.score import lookup

AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
CODES = tuple(C.TRIGGERS)


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def domain_of(key: Column) -> Column:
    return F.concat(F.lit("customer"), F.lpad(key.cast("string"), 9, "0"), F.lit(".io"))


def _days_before(at: Column, days: Column) -> Column:
    return at - F.make_dt_interval(days=days.cast("int"))


def companies(spark: SparkSession, d: str) -> DataFrame:
    c, n, o = read(spark, d, "customer"), read(spark, d, "nation"), read(spark, d, "orders")
    roles = o.groupBy("o_custkey").agg(F.count("*").alias("open_roles"))
    k = F.col("c_custkey")
    band = F.try_element_at(F.array(*[F.lit(b) for b in C.BAND_TO_MAX]), (k % 6 + 1).cast("int"))
    spf = F.when(k % 3 != 1, "v=spf1")
    dmarc = F.when(k % 5 == 1, "none").when(k % 5 > 1, "reject")
    hygiene = F.to_json(F.struct((k % 4 != 0).alias("mx"), spf.alias("spf"), dmarc.alias("dmarc"), F.when(k % 7 != 0, k % 2 == 0).alias("dnssec"),
        F.when(k % 8 != 0, k % 4 == 1).alias("security_txt")))
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(roles, c["c_custkey"] == roles["o_custkey"], "left")
    return joined.select(
        k.alias("k"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit(".io")).alias("domain"), F.col("c_name").alias("display_name"),
            F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("industry"), F.when(k % 6 < 5, band).alias("band"),
            F.when(k % 9 != 0, F.concat(F.lit("tpl_"), (k % 8).cast("string"))).alias("template"),
        F.coalesce("open_roles", F.lit(0)).cast("long").alias("open_roles"), F.floor(F.col("c_acctbal") / 200).cast("long").alias("subdomains"),
        F.when(k % 3 == 0, F.array(F.lit("mcp_server"), F.lit("ai_api"))).otherwise(F.array().cast("array<string>")).alias("ai_surface"),
        F.when(k % 10 == 9, "not json").when(k % 10 != 0, hygiene).alias("dns_hygiene"),
    )


def triggers(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    at = ((F.left("o_orderpriority", F.lit(1)).cast("int") - 1) + 5 * (F.col("o_orderkey") % 3)) % len(CODES)
    code = F.element_at(F.array(*[F.lit(x) for x in CODES]), (at + 1).cast("int"))
    observed = _days_before(as_of(), F.datediff(as_of(), "o_orderdate") % 240)
    t = o.select(F.col("o_orderkey").alias("trigger_id"), F.col("o_custkey").alias("k"), code.alias("code"), observed.alias("observed_at"),
        (F.col("o_orderstatus") != "F").alias("active"))
    window = lookup({k: v[2] for k, v in C.TRIGGERS.items()}, F.col("code"), C.DEFAULT_DECAY_DAYS)
    return t.withColumn("decays_at", F.col("observed_at") + F.make_dt_interval(days=window))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    later = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    url = F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.org/"), F.col("l_partkey").cast("string"))
    return line.select(
        F.col("l_orderkey").alias("trigger_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), (F.col("l_suppkey") % 7).alias("source_id"),
            url.alias("url"),
        _days_before(as_of(), F.datediff(later, "l_shipdate") % 400).alias("observed_at"),
            F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("reachable"),
        (F.col("l_linestatus") == "O").alias("ours"),
    )


STATUS = {"purchase": "verified", "signup": "role_account", "click": "catch_all", "view": "unverified", "error": "risky"}


def _key() -> Column:
    return F.col("user_id") * 7 + F.col("event_id") % 7


def contacts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    local = F.when(F.col("event_type") == "signup", "info").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string")))
    email = F.when(F.col("event_id") % 11 != 0, F.concat(local, F.lit("@"), domain_of(_key())))
    return e.select(
        F.col("event_id").alias("contact_id"), _key().alias("k"), email.alias("email"), lookup(STATUS, F.col("event_type")).alias("status"),
        F.when(F.col("value") > 80, F.concat(F.lit("User "), F.col("user_id").cast("string"))).alias("full_name"), F.col("ts").alias("first_seen_at"),
    )


def feedback(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "labels")
    verdict = F.when(F.col("toxic") == 1, "contacted").when(F.col("quality") == 1, "good").otherwise("bad")
    at = F.lit("2001-07-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 30).cast("int"))
    return x.select(F.col("doc_id").alias("feedback_id"), F.col("doc_id").alias("k"), verdict.alias("verdict"), (F.col("doc_id") % 3).alias("actor"),
        at.alias("created_at"))


def dispatches(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("dispatch_id"), _key().alias("k"), F.when(v > 80, "A").when(v > 40, "B").otherwise("C").alias("tier"),
        F.least(F.lit(100), F.floor(v)).cast("int").alias("score"), F.col("ts").alias("dispatched_at"),
    )


JOB_STATUS = {"signup": "pending", "click": "in_flight", "view": "done", "purchase": "dead", "error": "pending"}


def jobs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("kind_"), (F.col("user_id") % 4).cast("string")).alias("kind"),
            lookup(JOB_STATUS, F.col("event_type")).alias("status"),
        (F.col("event_id") % 5).cast("int").alias("priority"), F.col("ts").alias("created_at"), (F.col("event_id") % 4).cast("int").alias("attempts"),
            (F.col("event_id") % 3).cast("int").alias("reclaims"),
        (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("lease_expires_at"),
            F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("dedupe_key"),
    )


def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("unit"), F.col("ts").alias("at"), (F.col("value") >= 10).alias("ok"), F.col("value"),
        (F.col("user_id") % 3).alias("build"))


def suppressed(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.where(F.col("c_custkey") % 50 == 0).select(F.upper(domain_of(F.col("c_custkey"))).alias("value"), F.lit("domain").alias("kind"))


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.where(F.col("c_custkey") % 37 == 0).select(domain_of(F.col("c_custkey")).alias("subject"), F.lit("lead").alias("kind"))
