"""Decay, retirement, repair of dates, suppression and retention. Each pass returns what it would change."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import REDATE_TOLERANCE_DAYS
from ..functions import dns
from ..functions.dates import age_days
from ..functions.url import canonical_domain


def _t8(company: Column) -> Column:
    """True: still justified; false: no longer; null: can't be told."""
    h = dns.parse_hygiene(F.when(company.startswith("{"), company))
    return F.when(h.isNotNull(), F.size(dns.mail_weakness(h)) > 0)


RETIREMENT: dict[str, Callable[[Column], Column]] = {"T8_HYGIENE_GAP": _t8}


def superseded(triggers: DataFrame, companies: DataFrame) -> DataFrame:
    """Active triggers that the current rule wouldn't write; only a plain false retires one."""
    verdict = F.lit(None).cast("boolean")
    for code, rule in RETIREMENT.items():
        verdict = F.when(F.col("code") == code, rule(F.col("dns_hygiene"))).otherwise(verdict)
    t = triggers.where("active").where(F.col("code").isin(*RETIREMENT)).join(companies.select("k", "domain", "dns_hygiene"), "k")
    return t.withColumn("verdict", verdict).where(F.col("verdict").eqNullSafe(False)).select("trigger_id", "code", "domain")


def platform_companies(companies: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Companies whose domain is no longer one, unless suppressed already."""
    off = suppressed.where("kind = 'domain'").select(F.lower("value").alias("d"))
    bad = companies.where(canonical_domain(F.concat(F.lit("https://"), "domain", F.lit("/"))).isNull())
    return bad.join(off, F.lower("domain") == F.col("d"), "left_anti").select("domain")


def redated(triggers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Triggers to be dated back to the first sighting of the URL that they cite last, where that is over half a day earlier."""
    newest = evidence.groupBy("trigger_id").agg(F.max_by("url", F.struct("observed_at", "evidence_id")).alias("url"))
    first = evidence.groupBy("url").agg(F.min("observed_at").alias("first"))
    t = triggers.where("active").join(newest, "trigger_id").join(first, "url")
    return t.where(age_days(F.col("first"), F.col("observed_at")) > REDATE_TOLERANCE_DAYS).select("trigger_id", "observed_at", F.col("first").alias("new_observed_at"))


def decayed(triggers: DataFrame, as_of: Column) -> DataFrame:
    return triggers.where(F.col("active") & (F.col("decays_at") <= as_of))


def expire(triggers: DataFrame, as_of: Column) -> DataFrame:
    """All triggers, those past their date inactive."""
    return triggers.withColumn("active", F.col("active") & (F.col("decays_at") > as_of))


def unevidenced(triggers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Active triggers that have evidence, of which none is reachable or unknown."""
    dead = evidence.groupBy("trigger_id").agg(F.bool_or(F.coalesce("reachable", F.lit(True))).alias("alive")).where(~F.col("alive"))
    return triggers.where("active").join(dead, "trigger_id", "left_semi")


def probe_verdict(status: Column) -> Column:
    """False for client errors but 401, 403 and 429; true for success; else null."""
    return F.when(status.between(200, 299), True).when(status.between(400, 499) & ~status.isin(401, 403, 429), False)


def resample(evidence: DataFrame, triggers: DataFrame, as_of: Column, recheck_days: int = 14, fraction: float = 0.1, most: int = 40, salt: str = "1") -> DataFrame:
    """A sample of stale evidence behind live triggers: min(most, max(1, n * fraction)) rows, the smallest salted hashes."""
    live = triggers.where(F.col("active") & (F.col("decays_at") > as_of)).select("trigger_id")
    stale = evidence.where(F.col("observed_at") < as_of - F.make_dt_interval(days=F.lit(recheck_days))).join(live, "trigger_id", "left_semi")
    pool = stale.groupBy("evidence_id").agg(F.min("url").alias("url")).withColumn("h", F.md5(F.concat_ws("|", F.lit(salt), F.col("evidence_id").cast("string"))))
    n = pool.agg(F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.count("*") * fraction))).cast("int").alias("wanted"))
    top = pool.orderBy("h").limit(most).withColumn("r", F.row_number().over(Window.orderBy("h")))
    return top.crossJoin(F.broadcast(n)).where("r <= wanted").select("evidence_id", "url", "h")


def orphan_evidence(evidence: DataFrame, triggers: DataFrame) -> DataFrame:
    return evidence.join(triggers.select("trigger_id"), "trigger_id", "left_anti")


def dead_company_contacts(contacts: DataFrame, companies: DataFrame, triggers: DataFrame, as_of: Column) -> DataFrame:
    """Contacts of companies without a live trigger."""
    live = triggers.where(F.col("active") & (F.col("decays_at") > as_of)).select("k")
    dead = companies.select("k").join(live, "k", "left_anti")
    return contacts.join(dead, "k", "left_semi")


def older_than(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) < as_of - F.make_dt_interval(days=F.lit(days)))


def erase_subject(tables: dict[str, DataFrame], key: str, subjects: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of these subjects."""
    return {n: t.join(subjects.select(key).distinct(), key, "left_anti") if key in t.columns else t for n, t in tables.items()}


#: Candidates that nothing will happen to any more.
TERMINAL = ("resolved", "unresolvable", "skipped", "quarantined")
_AT = {"raw_documents": "fetched_at", "candidates": "created_at", "dead_letter": "died_at", "metrics": "recorded_at", "jobs": "updated_at"}


def purged(tables: dict[str, DataFrame], as_of: Column, days: dict[str, int]) -> dict[str, DataFrame]:
    """Of each table named in ``days`` the rows that retention removes. Candidates and jobs go only where they are finished; contacts where
    their company has been quiet that long and has no active trigger; evidence where no trigger and no contact cites it."""
    out = {}
    for name, window in days.items():
        if name == "contacts":
            quiet = older_than(tables["companies"], "last_updated_at", as_of, window).select("k")
            dead = quiet.join(tables["triggers"].where("active").select("k"), "k", "left_anti")
            out[name] = tables[name].join(dead, "k", "left_semi")
        elif name == "evidence":
            old = older_than(tables[name], "observed_at", as_of, window).join(tables["triggers"].select("trigger_id"), "trigger_id", "left_anti")
            out[name] = old.join(tables["contacts"].where("evidence_id IS NOT NULL").select("evidence_id"), "evidence_id", "left_anti")
        else:
            old = older_than(tables[name], _AT[name], as_of, window)
            out[name] = old.where(F.col("status").isin(*TERMINAL)) if name == "candidates" else old.where("status = 'done'") if name == "jobs" else old
    return out


def counted(passes: dict[str, DataFrame], name: str = "what") -> DataFrame:
    """The number of rows of each, in one plan."""
    each = [rows.agg(F.count("*").alias("n")).select(F.lit(n).alias(name), "n") for n, rows in passes.items()]
    return reduce(DataFrame.unionByName, each)


def run(triggers, evidence, companies, suppressed, as_of, known: DataFrame | None = None) -> DataFrame:
    """Counts of all passes in their order: (pass, n). ``known``: the triggers that evidence may belong to, where these aren't all."""
    return counted({
        "superseded": superseded(triggers, companies), "platform_suppressed": platform_companies(companies, suppressed), "redated": redated(triggers, evidence),
        "decayed": decayed(triggers, as_of), "unevidenced": unevidenced(triggers, evidence),
            "orphan_evidence": orphan_evidence(evidence, triggers if known is None else known),
    }, "pass_name")


def changed(counts: DataFrame) -> DataFrame:
    """One row: did any pass change anything?"""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select("rows", (F.col("rows") > 0).alias("changed"))
