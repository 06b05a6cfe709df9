"""The call list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRIGGERS
from ..functions.score import lookup
from .scoring import contact_facts


def top_trigger(triggers: DataFrame, evidence: DataFrame, live_only: bool = False, as_of=None) -> DataFrame:
    """Per company the active trigger of the greatest weight (ties: the smallest id), with its smallest evidence URL, if any."""
    t = triggers.where("active")
    if live_only:
        t = t.where(F.col("decays_at") > as_of)
    weight = lookup({k: v[0] for k, v in TRIGGERS.items()}, F.col("code"), 0.0)
    t = t.groupBy("k").agg(F.max_by(F.struct("trigger_id", "code"), F.struct(weight, -F.col("trigger_id"))).alias("t")).select("k", "t.*")
    # only what the chosen triggers cite is reduced
    cited = t.join(evidence.select("trigger_id", "url"), "trigger_id", "left")
    return cited.groupBy("k", "trigger_id", "code").agg(F.min("url").alias("url"))


def candidates(leads: DataFrame, judged: DataFrame, suppressed: DataFrame, quarantined: DataFrame, tiers=("A", "B"), include_judged: bool = False) -> DataFrame:
    """Leads of these tiers that nobody judged (any verdict counts), suppressed or quarantined."""
    out = leads.where(F.col("tier").isin(*tiers))
    if not include_judged:
        out = out.join(judged.select("k").distinct(), "k", "left_anti")
    off = suppressed.where("kind = 'domain'").select(F.lower("value").alias("domain"))
    held = quarantined.where("kind = 'lead'").select(F.col("subject").alias("domain"))
    return out.join(off, "domain", "left_anti").join(held, "domain", "left_anti")


def worklist(leads, contacts, triggers, evidence, judged, suppressed, quarantined, tiers=("A", "B"), limit: int | None = 25, include_judged: bool = False) -> DataFrame:
    """Reachable leads, best first: by score, then named contacts, then domain. ``limit`` is the feature: a top-k report.

    Leads from ``scoring.facts`` hold their best contact already; for others ``contacts`` are aggregated here.
    """
    base = candidates(leads, judged, suppressed, quarantined, tiers, include_judged)
    if "contact" not in base.columns:
        base = base.join(contact_facts(contacts), "k")
    top = top_trigger(triggers, evidence).select("k", F.col("code").alias("trigger_code"), F.col("url").alias("evidence_url"))
    found = base.where("contact.email IS NOT NULL")
    out = found.select("k", "domain", "display_name", "score", "tier", "offer", "contact.email", F.col("contact.status").alias("email_status"), "contact.full_name",
        "contacts_total").join(top, "k", "left")
    ordered = out.orderBy(F.desc("score"), F.col("full_name").isNull(), "domain")
    return ordered if limit is None else ordered.limit(limit)


def reachability_counts(leads, contacts, judged, suppressed, quarantined, tiers=("A", "B")) -> DataFrame:
    base = candidates(leads, judged, suppressed, quarantined, tiers)
    if "contact" not in base.columns:
        base = base.join(contact_facts(contacts), "k", "left")
    has = F.col("contact.email").isNotNull()
    return base.agg(F.count_if(has).alias("reachable"), F.count_if(~has).alias("unreachable"))


def contacts_deduped(contacts: DataFrame) -> DataFrame:
    """One row per company and address, the first seen; rows without address stay apart."""
    names = contacts.columns
    first = F.min_by(F.struct(*names), F.struct("first_seen_at", "contact_id"))
    return contacts.groupBy("k", F.coalesce("email", F.col("contact_id").cast("string"))).agg(first.alias("c")).select("c.*")
