"""The stage graph as DataFrame functions: harvest, extract, resolve, enrich, score, dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.url import extraction_target
from ..operators import cards, merge, reads, resolve, scoring
from ..operators.graph import cut

Model = Callable[[DataFrame], DataFrame]


def harvest(hits: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of hits whose target is a company's and new; and the yield by template.

    A target that several hits name is one candidate, of the first template by name; the yield counts as ``candidates`` what is
    new, as ``dropped`` the hits without a company's URL, so that a template that finds only what is known looks exhausted.
    """
    h = hits.withColumn("target", extraction_target(F.col("url"), F.col("homepage")))
    columns = h.columns
    first = h.where("target IS NOT NULL").groupBy("target").agg(F.min_by(F.struct(*columns), F.struct("template", "url")).alias("h")).select("h.*")
    new = first.join(seen.select(F.col("url").alias("target")), "target", "left_anti")
    found = new.groupBy("template").agg(F.count("*").alias("candidates"))
    y = h.groupBy("template").agg(F.count("*").alias("hits"), F.count_if(F.col("target").isNull()).alias("dropped"))
    return new, y.join(found, "template", "left").select("template", "hits", F.coalesce("candidates", F.lit(0)).alias("candidates"), "dropped")


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Pages to prose, injection reasons and outcome; ``model`` may add snippets, of which only those that the page holds stay."""
    p = pages.withColumn("prose", text.cut_prose(text.html_text(F.col("html")))).withColumn("reasons", text.injection_reasons(F.col("prose")))
    p = p.withColumn("outcome", F.when(F.size("reasons") > 0, "quarantine").when(F.length("prose") == 0, "skip").otherwise("store"))
    if model is None:
        return p.withColumn("snippets", F.array().cast("array<string>"))
    return model(p).withColumn("snippets", text.verified_snippets(F.col("snippets"), F.col("prose")))


def enrich(companies: DataFrame, **lookups: DataFrame) -> DataFrame:
    """Companies with each lookup's columns; a lookup that has nothing leaves nulls."""
    for found in lookups.values():
        companies = companies.join(found, "domain", "left")
    return companies


def score(companies, triggers, evidence, contacts, suppressed, as_of: Column) -> DataFrame:
    return scoring.scored(scoring.facts(companies, triggers, evidence, contacts, suppressed, as_of))


def decide(review: DataFrame, stored: DataFrame, log: DataFrame, immediate: tuple[str, ...] = ("A", "B")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What follows a verdict: the quarantine's new rows, the stored leads after the upsert, and the leads to be sent now.

    A vetoed lead is quarantined and neither stored nor sent; the others are stored; of these, those of a tier that is sent at once go out, unless their state was sent before.
    """
    passed = review.where("passed")
    new = passed.select("lead_id", "score", F.coalesce("angle", F.lit("")).alias("angle"), F.lit(None).cast("string").alias("translation"),
        F.col("as_of").alias("first_seen_at"))
    return scoring.quarantine_rows(review), merge.upsert_leads(stored, new), cards.new_dispatches(passed.where(F.col("tier").isin(*immediate)), log)


def committed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``extract`` leaves behind: each page's status, and the evidence rows of its verified snippets.

    A page whose model was not to be had (``paused``) is deferred and keeps its place; one without a verified snippet brings no
    trigger, and its codes fall away.
    """
    status = F.when(F.col("outcome") == "quarantine", "quarantined").when(F.col("paused"), "deferred").when(F.col("outcome") == "skip", "skipped").otherwise("extracted")
    # both results read what the stages made of the pages, not the pages twice; texts are not written
    p = cut(pages.select("url", status.alias("status"), "codes", "snippets", "fetched_at"), "extracted")
    stored = p.where("status = 'extracted'")
    row = reads.evidence_row(F.col("url"), F.lit("page"), F.col("snippet"), F.col("fetched_at"))
    found = stored.select("url", "fetched_at", F.explode("snippets").alias("snippet")).select(row.alias("e")).select("e.*")
    none = F.array().cast("array<string>")
    codes = F.when((F.col("status") == "extracted") & (F.size("snippets") > 0), F.col("codes")).otherwise(none)
    return p.select("url", "status", codes.alias("codes")), found


STAGES: dict[str, Callable] = {"harvest": harvest, "extract": extract, "resolve": resolve.resolve, "enrich": enrich, "score": score, "dispatch": cards.new_dispatches}
