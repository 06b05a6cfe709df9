"""Why leads score as they do: distributions, counterfactuals, yields and near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TIERS
from ..functions import score

FLOOR = dict(TIERS)["C"]


def tier_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy("tier").agg(F.count("*").alias("n"))


def component_stats(leads: DataFrame) -> DataFrame:
    """Mean, and leads at zero, of each component."""
    long = leads.select(F.explode("components").alias("name", "value"))
    return long.groupBy("name").agg(F.avg("value").alias("mean"), F.count_if(F.col("value") <= 0).alias("at_zero"))


def penalty_stats(leads: DataFrame) -> DataFrame:
    """Leads, cost, and leads whose tier changes if the penalty is lifted, of each penalty."""
    long = leads.select("tier", "raw", F.explode("penalties").alias("name", "cost"))
    lifted = score.tier(score.final(F.col("raw") - F.col("cost")))
    return long.groupBy("name").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.count_if(lifted != F.col("tier")).alias("promoted"))


def counterfactuals(leads: DataFrame) -> DataFrame:
    """Tier distribution as it is, without penalties, and with every lead perfectly reachable."""
    perfect = F.col("weighted") + (100.0 - F.col("reachability")) * score.C.COMPONENTS["reachability"] + F.col("penalty_total")
    what = F.array(
        F.struct(F.lit("actual").alias("scenario"), F.col("tier").alias("t")),
        F.struct(F.lit("unpenalised").alias("scenario"), score.tier(score.final(F.col("weighted"))).alias("t")),
        F.struct(F.lit("with_contact").alias("scenario"), score.tier(score.final(perfect)).alias("t")),
    )
    return leads.select(F.explode(what).alias("x")).groupBy(F.col("x.scenario").alias("scenario"), F.col("x.t").alias("tier")).agg(F.count("*").alias("n"))


def near_misses(leads: DataFrame, limit: int = 10) -> DataFrame:
    """Rejected leads by their gap to the floor, with what blocks them: the worst penalty, else the weakest component. A top-k report."""
    worst = F.element_at(F.array_sort(F.transform(F.map_entries("penalties"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))), 1)
    weakest = F.element_at(F.array_sort(F.transform(F.map_entries("components"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))), 1)
    blocker = F.when(F.size("penalties") > 0, worst["k"]).otherwise(F.concat(F.lit("weak "), weakest["k"]))
    out = leads.where("tier = 'REJECT'").select("domain", "raw", (F.lit(float(FLOOR)) - F.col("raw")).alias("gap"),
        F.when(F.size("penalties") > 0, worst["k"]).alias("penalty"), blocker.alias("blocker"))
    return out.orderBy("gap", "domain").limit(limit)


def corroboration(leads: DataFrame) -> DataFrame:
    both = F.col("n_sources") >= 2
    return leads.agg(F.count_if(both).alias("corroborated"),
        F.count_if(both & F.array_contains(F.map_keys("penalties"), "single_source")).alias("penalised_but_corroborated"))


def corroboration_effect(leads: DataFrame) -> DataFrame:
    """Leads with two sources or more; those of them that are charged for a single one; and those whose tier that charge decides."""
    both, cost = F.col("n_sources") >= 2, F.try_element_at("penalties", F.lit("single_source"))
    lifted = score.tier(score.final(F.col("raw") - cost)) != F.col("tier")
    return leads.agg(F.count_if(both).alias("corroborated"), F.count_if(both & cost.isNotNull()).alias("penalised"),
        F.count_if(both & cost.isNotNull() & lifted).alias("promoted"))


def template_yield(companies: DataFrame, leads: DataFrame) -> DataFrame:
    """Per discovery template: companies, scored, sendable and mean score; an unscored company counts 0."""
    joined = companies.select("k", F.coalesce("template", F.lit("(unknown)")).alias("template")).join(leads.select("k", "score", "tier"), "k", "left")
    return joined.groupBy("template").agg(
        F.count("*").alias("companies"), F.count("score").alias("scored"), F.count_if(F.col("tier").isin("A", "B")).alias("sendable"),
            F.avg(F.coalesce("score", F.lit(0))).alias("mean_score"),
    )


def harvest_yield(metrics: DataFrame, since) -> DataFrame:
    """Per template the sums of its labels' counters since ``since``; barren ones find nothing though they drop, exhausted ones find nothing at all."""
    labels = F.from_json("labels", "template string, hits long, candidates long, dropped long")
    m = metrics.where(F.col("at") >= since).select(labels.alias("l")).select("l.*")
    out = m.groupBy("template").agg(*[F.sum(c).alias(c) for c in ("hits", "candidates", "dropped")])
    none = (F.col("hits") >= 5) & (F.col("candidates") == 0)
    return out.withColumn("exhausted", none & (F.col("dropped") == 0)).withColumn("barren", none & (F.col("dropped") > 0))


def stale_calibration(leads: DataFrame, version: str) -> DataFrame:
    """Leads whose stored stamp isn't the running calibration's."""
    return leads.where(~F.col("scoring_version").eqNullSafe(F.lit(version)))
