"""Proposals on the calibration: what fires too often, is priced too high, or finds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPONENTS, PENALTIES, TRIGGERS
from .diagnose import FLOOR, component_stats, penalty_stats, template_yield

CONSTANT, HELD_BACK, HELD_INCIDENCE, DOUBLE = 0.85, 0.10, 0.40, 0.40
LEAST_LEADS, LEAST_JUDGED, LEAST_COMPANIES = 25, 4, 8


def lead_verdicts(feedback: DataFrame) -> DataFrame:
    """Per lead: is it good? One bad verdict outweighs any good one; other verdicts don't judge."""
    f = feedback.where(F.col("verdict").isin("good", "bad")).groupBy("k")
    return f.agg((~F.bool_or(F.col("verdict") == "bad")).alias("good"))


def _weighted_codes(triggers: DataFrame) -> DataFrame:
    return triggers.where(F.col("active") & F.col("code").isin(*TRIGGERS)).select("k", "code").distinct()


def trigger_rates(leads: DataFrame, triggers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per trigger code that has a weight: judged and good leads, its rate, the corpus' rate, and lower or raise."""
    judged = lead_verdicts(feedback).join(leads.select("k"), "k")
    codes = _weighted_codes(triggers)
    rate = judged.agg(F.avg(F.col("good").cast("double")).alias("corpus"))
    out = judged.join(codes, "k").groupBy("code").agg(F.count("*").alias("judged"), F.count_if("good").alias("good")).where(F.col("judged") >= LEAST_JUDGED)
    out = out.withColumn("rate", F.col("good") / F.col("judged")).crossJoin(F.broadcast(rate))  # the one row of the corpus' rate
    verdict = F.when(F.col("rate") < 0.6 * F.col("corpus"), "lower").when((F.col("rate") > 0.8) & (F.col("rate") > 1.4 * F.col("corpus")), "raise")
    return out.withColumn("proposal", verdict)


def cited_leads(leads: DataFrame, triggers: DataFrame, feedback: DataFrame) -> DataFrame:
    """What a proposal on a trigger rests on, a row each: code, proposal, and the judged leads (k, good) that carry the code."""
    made = trigger_rates(leads, triggers, feedback).where("proposal IS NOT NULL").select("code", "proposal")  # a row a code at most
    judged = lead_verdicts(feedback).join(leads.select("k"), "k")
    return judged.join(_weighted_codes(triggers).join(F.broadcast(made), "code"), "k").select("code", "proposal", "k", "good")


def penalty_proposals(leads: DataFrame) -> DataFrame:
    """Penalties with their proposals, a row a rule that holds: constant offset; else held back, where they hold many back; and, whatever
    else holds, double charged, where they cost over 40 % of the room above the floor. A penalty without any has one row of none."""
    total = leads.agg(F.count("*").alias("total"))
    p = penalty_stats(leads).where(F.col("name").isin(*PENALTIES)).crossJoin(F.broadcast(total))
    share, lifted = F.col("n") / F.col("total"), F.col("promoted") / F.col("total")
    offset: Column = F.when(share >= CONSTANT, "constant_offset").when((lifted >= HELD_BACK) & (share >= HELD_INCIDENCE), "held_back")
    double = F.when(F.abs(F.col("cost") / F.col("n")) >= DOUBLE * (100 - FLOOR), "double_charged")
    return p.withColumn("incidence", share).withColumn("proposal", F.explode_outer(F.array_compact(F.array(offset, double))))


def template_proposals(companies: DataFrame, leads: DataFrame, weights: DataFrame) -> DataFrame:
    """Templates that find too few or many sendable leads against the corpus; a template without weight has 50."""
    y = template_yield(companies, leads).where("template <> '(unknown)'")
    corpus = y.agg((F.sum("sendable") / F.sum("companies")).alias("rate"), (F.sum(F.col("mean_score") * F.col("companies")) / F.sum("companies")).alias("mean"),
        F.count("*").alias("templates"))
    y = y.join(F.broadcast(weights), "template", "left").withColumn("weight", F.coalesce("weight", F.lit(50))).crossJoin(F.broadcast(corpus))
    own = F.col("sendable") / F.col("companies")
    poor = (own < 0.5 * F.col("rate")) & (F.col("companies") >= LEAST_COMPANIES) & (F.col("templates") >= 2) & (F.col("weight") > 30)
    rich = (own >= 2 * F.col("rate")) & (F.col("mean_score") > F.col("mean")) & (F.col("weight") < 85)
    return y.select("template", "companies", "sendable", "weight", own.alias("hit_rate"), F.when(poor, "cut").when(rich, "raise").alias("proposal"))


def dead_components(leads: DataFrame) -> DataFrame:
    """Components with a weight that are zero on every lead."""
    n = leads.agg(F.count("*").alias("n"))
    return component_stats(leads).crossJoin(F.broadcast(n)).where((F.col("at_zero") == F.col("n")) & F.col("name").isin(*[k for k,
        w in COMPONENTS.items() if w > 0])).select("name", "at_zero")


def critique(leads, triggers, feedback, companies, weights) -> DataFrame:
    """All proposals as (target, key, proposal), none under 25 leads."""
    a = penalty_proposals(leads).where("proposal IS NOT NULL").select(F.lit("scoring").alias("target"), F.concat(F.lit("penalties."), "name").alias("key"), "proposal")
    b = template_proposals(companies, leads, weights).where("proposal IS NOT NULL").select(F.lit("templates").alias("target"), F.col("template").alias("key"), "proposal")
    c = dead_components(leads).select(F.lit("scoring").alias("target"), F.concat(F.lit("components."), "name").alias("key"), F.lit("dead").alias("proposal"))
    e = trigger_rates(leads, triggers, feedback).where("proposal IS NOT NULL").select(F.lit("scoring").alias("target"), F.concat(F.lit("triggers."), "code").alias("key"),
        "proposal")
    every = a.unionByName(b).unionByName(c).unionByName(e)
    enough = leads.agg((F.count("*") >= LEAST_LEADS).alias("enough"))
    return every.crossJoin(F.broadcast(enough)).where("enough").drop("enough")
