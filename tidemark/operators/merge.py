"""Upserts as joins: written to a new version of the table, as the format has no update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _both(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    o = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("o"))
    n = new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("n"))
    return o.join(n, key, "full")


def upsert_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """(domain, display_name, country, industry, signals, template): the old name stays, the rest prefers what is new and not empty,
    signals are a sorted union, the first template wins."""
    full = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}"))
    none = F.array().cast("array<string>")
    return _both(old, new, "domain").select(
        "domain", F.coalesce("o.display_name", "n.display_name").alias("display_name"), full("country").alias("country"), full("industry").alias("industry"),
        F.array_sort(F.array_union(F.coalesce("o.signals", none), F.coalesce("n.signals", none))).alias("signals"),
            F.coalesce("o.template", "n.template").alias("template"),
    )


def upsert_leads(old: DataFrame, new: DataFrame) -> DataFrame:
    """(lead_id, score, angle, translation, first_seen_at): a blank angle never overwrites, the first sighting stays."""
    return _both(old, new, "lead_id").select(
        "lead_id", F.coalesce("n.score", "o.score").alias("score"), F.coalesce(F.nullif(F.col("n.angle"), F.lit("")), F.col("o.angle"), F.lit("")).alias("angle"),
        F.coalesce("n.translation", "o.translation").alias("translation"), F.coalesce("o.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
    )


def refresh_triggers(triggers: DataFrame, sightings: DataFrame, evidence: DataFrame, window) -> DataFrame:
    """Live triggers met again: the date moves only for a URL not cited yet; the decay date always moves."""
    known = evidence.select("trigger_id", "url").distinct().withColumn("known", F.lit(True))
    s = sightings.join(triggers.where("active").select("trigger_id", "k", "code", "observed_at"), ["k", "code"]).join(known, ["trigger_id", "url"], "left")
    g = s.groupBy("trigger_id").agg(F.max("observed_at").alias("old"), F.max(F.when(F.col("known").isNull(), F.col("seen_at"))).alias("moved"),
        F.max("seen_at").alias("seen"))
    return g.select("trigger_id", F.coalesce(F.greatest("old", "moved"), F.col("old")).alias("observed_at"), (F.col("seen") + window).alias("decays_at"))


def append_once(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the log hasn't, one per key: an append that can be repeated."""
    w = Window.partitionBy(key).orderBy(*[c for c in rows.columns if c != key])
    return rows.withColumn("tm_r", F.row_number().over(w)).where("tm_r = 1").drop("tm_r").join(log.select(key), key, "left_anti")


def additive(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def fill_enrichment(companies: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """COALESCE(new, old) on some columns of the companies that were looked up."""
    n = found.select("domain", *[F.col(c).alias(f"tm_{c}") for c in columns])
    out = companies.join(n, "domain", "left")
    return out.withColumns({c: F.coalesce(f"tm_{c}", c) for c in columns}).drop(*[f"tm_{c}" for c in columns])
