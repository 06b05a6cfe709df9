"""Which queries to run next, and what stored rows are out of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan(templates: DataFrame, answered: DataFrame, most: int = 12, most_costed: int = 2, budgets: DataFrame | None = None) -> DataFrame:
    """Templates without a fresh answer: free ones by weight, then at most ``most_costed`` costed ones, ``most`` in all.

    ``budgets`` (provider, units_left): a costed template is planned only where its provider has its cost left; a provider without a row has none.
    """
    t = templates.join(answered.select("template"), "template", "left_anti")
    if budgets is not None:
        t = t.join(budgets, "provider", "left").where(~F.col("costed") | (F.coalesce("units_left", F.lit(0)) >= F.col("cost"))).drop("units_left")
    t = t.withColumn("r", F.row_number().over(Window.partitionBy("costed").orderBy(F.desc("weight"), "template")))
    t = t.where(~F.col("costed") | (F.col("r") <= most_costed))
    return t.orderBy("costed", F.desc("weight"), "template").limit(most).drop("r")


def coverage(templates: DataFrame) -> DataFrame:
    """Trigger code -> templates that look for it."""
    return templates.select("template", F.explode("targets").alias("code")).groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("template")),
        ",").alias("templates"))


def unextracted(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    return candidates.where("status = 'new'").join(jobs.where(F.col("status").isin("pending", "in_flight")).select("candidate_id"), "candidate_id",
        "left_anti").orderBy("created_at", "candidate_id")


def unenriched(companies: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return companies.where(F.col("enriched_at").isNull() | (F.col("enriched_at") < as_of - F.make_dt_interval(days=F.lit(days)))).orderBy(F.col("enriched_at").asc_nulls_first(), "domain")


def stale_scores(companies: DataFrame, triggers: DataFrame, leads: DataFrame, version: str) -> DataFrame:
    """Companies whose lead is behind: newer news first, then another calibration, then missing prose."""
    newest = triggers.where("active").groupBy("k").agg(F.max("observed_at").alias("newest"))
    j = companies.select("k", "domain").join(newest, "k").join(leads.select("k", "scored_at", "scoring_version", "angle"), "k", "left")
    news = F.col("scored_at").isNull() | (F.col("newest") > F.col("scored_at"))
    stamp = ~F.col("scoring_version").eqNullSafe(F.lit(version))
    why = F.when(news, "news").when(stamp, "calibration").when(F.coalesce("angle", F.lit("")) == "", "prose")
    return j.withColumn("reason", why).where("reason IS NOT NULL").select("k", "domain", "reason")


def top_up(rows: DataFrame, outstanding: int, most: int) -> DataFrame:
    """Only as many as are missing to ``most`` outstanding ones."""
    return rows.limit(max(0, most - outstanding))


def enrichment_triggers(found: DataFrame) -> DataFrame:
    """Derived triggers of a lookup: sprawl, mail gaps, hiring codes."""
    sprawl = F.when((F.col("subdomains") >= 25) & (F.col("growth") >= 8), "T7_SURFACE_SPRAWL")
    gaps = F.when(F.size("weakness") > 0, "T8_HYGIENE_GAP")
    return found.select("domain", F.explode(F.concat(F.array_compact(F.array(sprawl, gaps)), "hiring_codes")).alias("code"))


def hiring_signals(postings: DataFrame) -> DataFrame:
    """Per board: postings, security and AI roles, and the trigger codes of the set."""
    from ..config import COMPLIANCE_POSTING, STACK_POSTING
    from ..functions.text import classify_role

    role = classify_role(F.col("title"))
    g = postings.groupBy("board").agg(
        F.count("*").alias("total"), F.count_if(role == "security").alias("security"), F.count_if(role == "ai").alias("ai"),
        F.bool_or(F.col("content").rlike(COMPLIANCE_POSTING)).alias("c"), F.bool_or(F.concat_ws(" ", "title", "content").rlike(STACK_POSTING)).alias("s"),
    )
    codes = F.array_compact(F.array(
        F.when(F.col("security") > 0, "T3_HIRING_SEC"), F.when((F.col("ai") > 0) & (F.col("security") == 0), "T4_HIRING_AI_ONLY"), F.when(F.col("c"), "T5_COMPLIANCE"),
            F.when(F.col("s"), "T11_STACK_RISK"),
    ))
    return g.withColumn("codes", codes).drop("c", "s")


def suppressed_domains(suppressed: DataFrame) -> DataFrame:
    """Domains that nothing is spent on."""
    return suppressed.where("kind = 'domain'").select(F.lower("value").alias("domain")).distinct()
