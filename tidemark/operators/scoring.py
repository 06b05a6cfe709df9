"""Company, trigger, evidence and contact relations to scored leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PERSONAL_EMAIL_DOMAINS, STALE_DAYS
from ..functions import dns, email, rules, score
from ..functions.dates import age_days
from ..functions.ids import lead_id


def live_triggers(triggers: DataFrame, as_of: Column) -> DataFrame:
    return triggers.where(F.col("active") & (F.col("decays_at") > as_of))


def best_contact(contacts: DataFrame) -> DataFrame:
    """One contact per company: a named one first, then by status, then by address. An aggregate, so that a company with
    very many contacts is reduced where they are read."""
    order = F.struct(F.col("full_name").isNull(), email.status_rank(F.col("status")), "email", "contact_id")
    best = F.min_by(F.struct("contact_id", "email", "status", "full_name"), order)
    return contacts.where("email IS NOT NULL").groupBy("k").agg(best.alias("c")).select("k", "c.*")


def contact_facts(contacts: DataFrame) -> DataFrame:
    """Per company, in one pass: is anyone named, the best contact as in ``best_contact``, and the number of addresses."""
    order = F.when(F.col("email").isNotNull(), F.struct(F.col("full_name").isNull(), email.status_rank(F.col("status")), "email", "contact_id"))
    return contacts.groupBy("k").agg(
        F.bool_or(F.col("full_name").isNotNull()).alias("named"), F.min_by(F.struct("email", "status", "full_name"), order).alias("contact"),
            F.count("email").alias("contacts_total"),
    )


def trigger_sums(triggers: DataFrame, as_of: Column) -> DataFrame:
    """Per company: the decayed sum (at most 100), the newest age, the codes and their number, over live triggers."""
    age = age_days(F.col("observed_at"), as_of)
    t = live_triggers(triggers, as_of).select("k", "code", "observed_at", age.alias("age"), score.trigger_weight(F.col("code"), F.col("observed_at"), as_of).alias("w"))
    return t.groupBy("k").agg(
        F.least(F.lit(100.0), F.sum("w")).alias("trigger"), F.min("age").alias("newest"), F.count("*").alias("n_triggers"), F.collect_set("code").alias("codes"),
    )


def source_breadth(triggers: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """Distinct sources behind each company's live triggers."""
    joined = live_triggers(triggers, as_of).select("k", "trigger_id").join(evidence.select("trigger_id", "source_id"), "trigger_id")
    return joined.groupBy("k").agg(F.countDistinct("source_id").alias("n_sources"))


def facts(companies: DataFrame, triggers: DataFrame, evidence: DataFrame, contacts: DataFrame, suppressed: DataFrame, as_of: Column) -> DataFrame:
    """Everything that the arithmetic needs, a row per company, and its best contact for the reports."""
    people = contact_facts(contacts).withColumn("status", F.col("contact.status"))
    off = suppressed.where("kind = 'domain'").select(F.lower("value").alias("off")).distinct()
    weak = dns.mail_weakness(dns.parse_hygiene(F.when(F.col("dns_hygiene").startswith("{"), F.col("dns_hygiene"))))
    out = companies.join(trigger_sums(triggers, as_of), "k", "left").join(source_breadth(triggers, evidence, as_of), "k", "left")
    out = out.join(people, "k", "left").join(off, F.col("domain") == F.col("off"), "left")
    zero = {"trigger": 0.0, "n_triggers": 0, "n_sources": 0, "status": "none", "named": False}
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zero.items()} | {"codes": F.coalesce("codes", F.array().cast("array<string>"))})
    return out.withColumns({"gap": F.coalesce(F.size(weak) > 0, F.lit(False)), "is_suppressed": F.col("off").isNotNull(),
        "band": F.coalesce("band", score.band_from_roles(F.col("open_roles")))}).drop("off")


def scored(given: DataFrame, anti_icp: Column | None = None, sectors: tuple[str, ...] = ()) -> DataFrame:
    """Components, penalties, score, tier and offer of each row of ``facts``."""
    c = F.col
    out = given.withColumns({
        "icp_fit": score.icp_component(c("band"), c("industry"), c("domain"), c("country"), c("codes"), sectors),
        "reachability": score.reachability_component(c("status"), c("named")),
        "surface": score.surface_component(c("ai_surface"), c("subdomains"), c("gap")),
        "freshness": score.freshness_component(c("newest")),
        "penalties": score.penalty_map(F.lit(False) if anti_icp is None else anti_icp, c("is_suppressed"), c("newest") > STALE_DAYS, c("country"), c("n_sources"),
            c("n_triggers")),
    })
    names = list(score.C.COMPONENTS)
    out = out.withColumn("components", F.create_map(*[x for n in names for x in (F.lit(n), c(n))]))
    out = out.withColumn("weighted", score.weighted(c("components"))).withColumn("penalty_total", score.map_total(c("penalties"))).withColumn("raw",
        c("weighted") + c("penalty_total"))
    out = out.withColumn("score", score.final(c("raw")))
    return out.withColumns({"tier": score.tier(c("score")), "offer": score.offer(c("codes"), c("ai_surface")), "lead_id": lead_id(c("domain"))})


def reviewed(leads: DataFrame, contacts: DataFrame, evidence_urls: DataFrame, max_employees: int = 1000) -> DataFrame:
    """Leads with the verdict of all ten rules: passed, checks, vetoes."""
    # the rule asks only for free-mail hosts, so no more than those are gathered
    host = email.host_part(F.col("email"))
    mail = contacts.where(host.isin(*PERSONAL_EMAIL_DOMAINS)).groupBy("k").agg(F.collect_set(F.concat(F.lit("x@"), host)).alias("emails"))
    joined = leads.join(mail, "k", "left").join(evidence_urls, "k", "left")
    joined = joined.withColumns({"emails": F.coalesce("emails", F.array().cast("array<string>")), "urls": F.coalesce("urls", F.array().cast("array<string>"))})
    checks = rules.rules(F.col("urls"), F.col("codes"), F.col("is_suppressed"), F.col("emails"), F.col("band"), F.col("domain"), F.col("industry"), F.col("display_name"),
        max_employees=max_employees)
    return joined.withColumn("verdict", rules.verdict(checks)).select("*", "verdict.*").drop("verdict")


def quarantine_rows(review: DataFrame) -> DataFrame:
    """What a vetoed lead appends to the quarantine."""
    detail = F.substring(F.concat_ws(",", "vetoes"), 1, 200)
    return review.where(~F.col("passed")).select("lead_id", F.lit("lead").alias("subject_kind"), F.try_element_at("vetoes", F.lit(1)).alias("reason_code"),
        detail.alias("detail"))
