"""Verdicts, precision, and what still awaits a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .critic import lead_verdicts

QUESTION = {"good": "worth", "bad": "worth", "contacted": "outcome", "not_interested": "outcome"}


def latest_wins(feedback: DataFrame) -> DataFrame:
    """An actor's last answer to each question about a lead."""
    from ..functions.score import lookup

    q = feedback.withColumn("question", lookup(QUESTION, F.col("verdict")))
    last = F.max_by(F.struct(*[c for c in q.columns if c not in ("k", "actor", "question")]), F.struct("created_at", "feedback_id"))
    return q.groupBy("k", "actor", "question").agg(last.alias("f")).select("k", "actor", "question", "f.*")


def latest_dispatch(dispatches: DataFrame, since: Column) -> DataFrame:
    d = dispatches.where(F.col("dispatched_at") >= since)
    last = F.max_by(F.struct("tier", "score", "dispatched_at", "dispatch_id"), F.struct("dispatched_at", "dispatch_id"))
    return d.groupBy("k").agg(last.alias("d")).select("k", "d.*")


def precision_by_tier(dispatches: DataFrame, feedback: DataFrame, since: Column) -> DataFrame:
    """Judged leads of the window by the tier of their latest dispatch: good and bad."""
    j = latest_dispatch(dispatches, since).join(lead_verdicts(feedback), "k")
    return j.groupBy("tier").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


def precision_report(dispatches: DataFrame, feedback: DataFrame, since: Column) -> DataFrame:
    """One row: dispatched, judged, good, bad, precision and coverage, null where nothing was judged or sent."""
    j = latest_dispatch(dispatches, since).join(lead_verdicts(feedback), "k", "left")
    a = j.agg(F.count("*").alias("dispatched"), F.count("good").alias("judged"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    return a.withColumn("precision", F.try_divide("good", "judged")).withColumn("coverage", F.try_divide("judged", "dispatched"))


def unjudged(dispatches: DataFrame, feedback: DataFrame, companies: DataFrame, since: Column, limit: int = 20) -> DataFrame:
    """Dispatched leads without good or bad, the best first: a top-k report."""
    d = latest_dispatch(dispatches, since).join(feedback.where(F.col("verdict").isin("good", "bad")).select("k").distinct(), "k", "left_anti")
    return d.join(companies.select("k", "domain"), "k").select("k", "domain", "tier", "score").orderBy(F.desc("score"), "k").limit(limit)


def reactions_to_verdicts(reactions: DataFrame, dispatches: DataFrame, emoji: dict[str, str]) -> DataFrame:
    """Reactions to messages as verdicts on the lead of the message's latest dispatch; works on a stream of reactions."""
    from ..functions.score import lookup

    last = dispatches.groupBy("message_id").agg(F.max_by("k", F.struct("dispatched_at", "dispatch_id")).alias("k"))
    return reactions.withColumn("verdict", lookup(emoji, F.col("emoji"))).where("verdict IS NOT NULL").join(last, "message_id").select("k", "verdict", "actor",
        "created_at")
