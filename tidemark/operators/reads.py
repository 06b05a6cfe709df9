"""Read models and work lists: stored leads, one lead's card, what is to be scored or extracted anew, the digest's backlog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text
from ..functions.ids import idempotency_key
from ..functions.score import lookup
from .resolve import name_pairs
from .scoring import live_triggers


def json_strings(column: Column) -> Column:
    """A JSON list of strings; anything else than a list is an empty one, and what isn't a string in it is left out."""
    found = F.from_json(column, "array<variant>")
    one = lambda v: F.try_variant_get(v, "$", "string")
    strings = F.filter(F.coalesce(found, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, one)


def split_breakdown(breakdown: Column) -> tuple[Column, Column]:
    """Components and penalties of a stored breakdown, a JSON object name -> number; what isn't a number is left out."""
    every = F.coalesce(F.from_json(breakdown, "map<string,string>"), F.create_map().cast("map<string,string>"))
    numbers = F.map_filter(F.transform_values(every, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    known = F.array(*[F.lit(n) for n in C.COMPONENTS])
    return F.map_filter(numbers, lambda k, v: F.array_contains(known, k)), F.map_filter(numbers, lambda k, v: ~F.array_contains(known, k))


def stored_leads(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Leads (domain, score, tier, breakdown, scoring_version) of known companies, their breakdown in two maps; broken JSON gives empty ones."""
    components, penalties = split_breakdown(F.col("breakdown"))
    names = companies.select("domain", F.col("display_name").alias("tm_name"))
    out = leads.drop("display_name").join(names, "domain").withColumns({"components": components, "penalties": penalties, "display_name": F.coalesce("tm_name", "domain"),
        "scoring_version": F.coalesce("scoring_version", F.lit(""))})
    return out.drop("tm_name", "breakdown")


def lead_view(leads: DataFrame, triggers: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """Each lead with its live triggers, the weightiest first (ties by id), and their evidence in that order. Triggers and the
    evidence of live ones are aggregated before they meet the leads; the lists are one company's, as a reader sees them whole."""
    weight = lookup({k: v[0] for k, v in C.TRIGGERS.items()}, F.col("code"), 0.0)
    live = live_triggers(triggers, as_of).select("k", "trigger_id", "code", "observed_at", (-weight).alias("order"))
    cited = evidence.join(live.select("trigger_id"), "trigger_id", "left_semi").groupBy("trigger_id").agg(F.array_sort(F.collect_set(F.struct("evidence_id", "source_id", "url"))).alias("cited"))
    each = live.join(cited, "trigger_id",
        "left").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("order", "trigger_id", "code", "observed_at", "cited"))).alias("x"))
    none = F.array().cast(each.select(F.col("x.cited")[0].alias("c")).schema["c"].dataType)
    seen = each.select("k", F.transform("x", lambda t: F.struct(t["trigger_id"].alias("trigger_id"), t["code"].alias("code"),
        t["observed_at"].alias("observed_at"))).alias("triggers"),
                       F.flatten(F.transform("x", lambda t: F.coalesce(t["cited"], none))).alias("evidence"))
    return leads.join(seen, "k", "left")


def rescore_jobs(domains: DataFrame, jobs: DataFrame, reason: str) -> DataFrame:
    """Score jobs for companies whose triggers changed: one per domain and reason, none whose key is queued already."""
    key = F.concat(F.lit("score:"), F.left(F.sha2(F.concat_ws("|", "domain", F.lit(reason)), 256), F.lit(16)))
    return domains.select("domain").distinct().withColumn("dedupe_key", key).join(jobs.select("dedupe_key"), "dedupe_key", "left_anti").select("domain", "dedupe_key")


def stale_extractions(candidates: DataFrame, companies: DataFrame, jobs: DataFrame, version: str, limit: int = 50) -> DataFrame:
    """Candidates to be read again: their company lacks a description or an industry, another prompt wrote them, and no live job is about them.

    The latest companies first; only as many as are missing to ``limit`` outstanding backfills, a top-up.
    """
    live = jobs.where(F.col("status").isin("pending", "in_flight"))
    gap = companies.where("description IS NULL OR industry IS NULL").select(F.col("domain").alias("resolved_domain"), "last_updated_at")
    told = F.coalesce(F.get_json_object("raw_payload", "$.prompt_version"), F.lit(""))
    c = candidates.where(F.col("status").isin("extracted", "resolved") & (told != version)).join(gap, "resolved_domain").join(live.select("candidate_id"), "candidate_id",
        "left_anti")
    c = c.withColumn("url", F.coalesce(F.get_json_object("raw_payload", "$.url"), F.lit("")))
    ranked = c.orderBy(F.desc("last_updated_at"), "candidate_id").limit(limit).withColumn("r",
        F.row_number().over(Window.orderBy(F.desc("last_updated_at"), "candidate_id")))
    room = live.agg((F.lit(limit) - F.count_if("backfill")).alias("room"))
    return ranked.crossJoin(F.broadcast(room)).where("r <= room AND url <> ''").select("candidate_id", "url")


def digest_backlog(leads: DataFrame, log: DataFrame, limit: int = 40) -> DataFrame:
    """Leads below the tiers that are sent at once, whose present state wasn't sent: by score, then domain. ``limit`` is a day's digest."""
    keyed = leads.where(~F.col("tier").isin("REJECT", "A", "B")).withColumn("idempotency_key", idempotency_key(F.col("lead_id"), F.col("codes"), F.col("score")))
    return keyed.join(log.select("idempotency_key"), "idempotency_key", "left_anti").orderBy(F.desc("score"), "domain").limit(limit)


def digest_rows(view: DataFrame) -> DataFrame:
    """A compact row for each lead of ``lead_view``: title, and the top trigger, the offer, one source and the description in ROW_CHARS."""
    top = F.coalesce(F.try_element_at("triggers", F.lit(1))["code"], F.lit("—"))
    first = F.try_element_at("evidence", F.lit(1))
    link = F.coalesce(F.concat(F.lit(" · ["), first["source_id"].cast("string"), F.lit("]("), first["url"], F.lit(")")), F.lit(""))
    body = F.concat(F.lit("`"), top, F.lit("` · "), "offer", link, F.lit("\n"), F.coalesce("description", F.lit("")))
    title = F.concat(F.col("score").cast("string"), F.lit(" · "), "display_name")
    return view.select(*[n for n in ("k",) if n in view.columns], "lead_id", text.truncate(title, C.TITLE_CHARS).alias("title"),
        F.concat(F.lit("https://"), "domain").alias("url"), text.truncate(body, C.ROW_CHARS).alias("description"))


def worklist_lines(rows: DataFrame) -> DataFrame:
    """The call list as text, a row each, in its order."""
    who = F.coalesce("full_name", "email_status")
    more = F.when(F.col("contacts_total") > 1, F.concat(F.lit("  (+"), (F.col("contacts_total") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    why = F.when(F.col("trigger_code").isNotNull(), F.concat(F.lit("\n      why: "), "trigger_code", F.lit("  "), F.coalesce("evidence_url", F.lit("")))).otherwise("")
    head = F.format_string("%3d. %3d %s  %s · %s", "n", "score", "tier", "display_name", "domain")
    w = Window.orderBy(F.desc("score"), F.col("full_name").isNull(), "domain")  # a report of some rows
    return rows.withColumn("n", F.row_number().over(w)).select("n", F.concat(head, F.lit("\n      "), "email", F.lit("  ["), who, F.lit("]"), more, why).alias("line"))


def offer_phrase(offer: Column) -> Column:
    """What an offer is called outside; an unknown one is the free one."""
    return lookup(C.OFFER_PHRASES, offer, C.DEFAULT_OFFER_PHRASE)


def missing_weights(codes: DataFrame) -> DataFrame:
    """Codes in use that have no weight, and so would count nothing unnoticed."""
    return codes.select("code").distinct().where(~F.col("code").isin(*C.TRIGGERS))


def evidence_row(url: Column, source_id: Column, snippet: Column, observed_at: Column) -> Column:
    from ..functions.ids import evidence_id

    return F.struct(evidence_id(url, F.lit("")).alias("evidence_id"), url.alias("url"), source_id.alias("source_id"), F.left(snippet, F.lit(500)).alias("snippet"),
        observed_at.alias("observed_at"))


def fetch_decision(status: Column, attempt: Column, retries: int, retry_after: Column) -> Column:
    """What an answer means: ok, retry (after the seconds that the server asked for, if it did), or fail; the last attempt never retries."""
    again = (status == 429) | status.between(500, 599) | status.isNull()
    what = F.when(status.between(200, 299), "ok").when(again & (attempt < retries - 1), "retry").otherwise("fail")
    return F.struct(what.alias("action"), F.when((what == "retry") & (status == 429), retry_after).alias("wait_s"))


def generation(attempts: Column, escalation: Column) -> Column:
    """The ladder of structured answers over ``attempts``, an array of (ok, down) of the local tries: two of them, the second only where the first
    broke the schema; then one escalated try where ``escalation`` (allowed, configured, affordable, ok) permits it."""
    first, second = F.try_element_at(attempts, F.lit(1)), F.try_element_at(attempts, F.lit(2))
    up = F.when(~escalation["allowed"], "not permitted").when(~escalation["configured"], "not configured").when(~escalation["affordable"],
        "budget exhausted").when(~escalation["ok"], "attempt failed")
    local = F.when(first["ok"], 1).when(~first["down"] & F.coalesce(second["ok"], F.lit(False)), 2)
    return F.struct(local.alias("local_attempt"), (local.isNull() & up.isNull()).alias("escalated"), F.when(local.isNull(), up).alias("reason"))


def known_engines(plans: DataFrame) -> DataFrame:
    """Plans with the source that answers them; a plan for an engine without one is left out."""
    return plans.withColumn("source", lookup(C.ENGINES, F.col("engine"))).where("source IS NOT NULL")


def plan_cache_key(plans: DataFrame) -> DataFrame:
    """The key under which each plan's answer is stored: the source, the query, and of the parameters only those that the source is asked with."""
    from ..functions.ids import cache_key

    asked = F.when(F.col("source") == "stories", F.map_filter("params", lambda k,
        v: k.isin("since_days", "tags", "max_hits"))).otherwise(F.create_map().cast("map<string,string>"))
    return known_engines(plans).withColumn("cache_key", cache_key(F.col("source"), F.col("query"), asked))


def active_tool(command: Column) -> Column:
    """The first program of a command line, or of a command inside it, that probes others' services, else the part that does; null if there is none."""
    low = F.lower(F.regexp_replace(command, r"[\"']", " "))
    names = F.transform(F.split(F.trim(low), r"\s+"), lambda t: F.element_at(F.split(t, "/"), -1))
    parts = F.array(*[F.lit(p) for p in C.ACTIVE_PROBES])
    return F.coalesce(F.try_element_at(F.filter(names, lambda n: n.isin(*C.ACTIVE_TOOLS)), F.lit(1)),
        F.trim(F.try_element_at(F.filter(parts, lambda p: F.contains(low, p)), F.lit(1))))


def breaker_snapshot(states: DataFrame) -> DataFrame:
    """Each source's present state: that of its last call (source, seq, state, admitted), with its refusals so far."""
    return states.groupBy("source").agg(F.max_by("state", "seq").alias("state"), F.count_if(~F.col("admitted")).alias("refused"))


def same_company(candidates: DataFrame, companies: DataFrame, threshold: float = 92.0) -> DataFrame:
    """Candidates (id, domain, name, country) with the company that each duplicates: rung 1, its own domain; rung 2, the most similar name with no
    country in conflict (ties: the smallest domain); no row for the others. The two sides meet by the pieces of their names, never all."""
    exact = candidates.join(companies.select("domain").distinct(), "domain", "left_semi").select("id", F.lit(1).alias("rung"), "domain", F.lit(100.0).alias("score"))
    rest = candidates.join(companies.select("domain"), "domain", "left_anti")
    form = lambda d, i: d.select(i.alias("id"), "name", "country", "domain")
    named = form(rest, F.concat(F.lit("a"), F.col("id").cast("string"))).unionByName(form(companies.withColumnRenamed("display_name", "name"),
        F.concat(F.lit("k"), "domain")))
    named = named.withColumns({"n": text.normalize_name(F.col("name")), "c": F.coalesce("country", F.lit(""))}).where("n <> ''")
    # of equal names in one country one stands for all
    first = named.groupBy("n", "c").agg(F.min("id").alias("form"))
    held = named.join(first, ["n", "c"]).select("id", "form", "domain")
    pairs = name_pairs(first.select(F.col("form").alias("id"), F.col("n").alias("name"), F.col("c").alias("country")).withColumn("country",
        F.nullif("country", F.lit(""))), threshold, normalized=True)
    both = pairs.select("a_id", "b_id", "score").unionByName(pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "score"))
    both = both.unionByName(first.select(F.col("form").alias("a_id"), F.col("form").alias("b_id"), F.lit(100.0).alias("score")))
    ours = held.where(F.startswith("id", F.lit("a"))).select("id", F.col("form").alias("a_id"))
    theirs = held.where(F.startswith("id", F.lit("k"))).groupBy(F.col("form").alias("b_id")).agg(F.min("domain").alias("domain"))
    found = ours.join(both, "a_id").join(theirs, "b_id").groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "domain")).alias("m"))
    near = found.select(F.substring("id", 2, 100).cast(candidates.schema["id"].dataType).alias("id"), F.lit(2).alias("rung"), "m.domain", (-F.col("m.s")).alias("score"))
    return exact.unionByName(near)


def gauges(companies, candidates, triggers, evidence, contacts, leads, dispatches, jobs, dead_letter, as_of: Column, now: Column, since: Column) -> DataFrame:
    """Every number of a status as (name, value). One scan a table: its numbers are one aggregate, whatever their count."""
    when = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status, tier, new = F.col("status"), F.col("tier"), F.col("dispatched_at") > since
    of = [
        (companies, {"companies_total": F.count("*"), "companies_enriched": F.count("enriched_at")}),
        (candidates, {"candidates_pending": when(status == "new")}),
        (triggers, {"triggers_live": when(F.col("active") & (F.col("decays_at") > as_of))}),
        (evidence, {"evidence_total": F.count("*"), "evidence_dead": when(~F.col("reachable"))}),
        (contacts, {"contacts_total": F.count("*")}),
        (leads, {"leads_total": F.count("*")} | {f"leads_tier_{t.lower()}": when(tier == t) for t in ("A", "B", "C", "REJECT")}),
        (dispatches, {"dispatches_total": F.count("*"), "dispatches_24h": when(new), "dispatches_ab_24h": when(new & tier.isin("A", "B"))}),
        (jobs, {"queue_ready": when((status == "pending") & (F.col("available_at") <= now)),
            "queue_deferred": when((status == "pending") & (F.col("available_at") > now)), "queue_in_flight": when(status == "in_flight"),
                "queue_failed": when(status == "failed"), "queue_dead": when(status.isin("dead", "dead_letter"))}),
        (dead_letter, {"dead_letter_total": F.count("*"), "dead_letter_recent": when(F.col("died_at") > since)}),
    ]
    each = [rows.agg(*[c.alias(n) for n, c in numbers.items()]).unpivot([], list(numbers), "name", "value") for rows, numbers in of]
    return reduce(DataFrame.unionByName, each)


def prose_decision(domain: Column, known: Column, n_triggers: Column, has_model: Column, retry: Column, has_angle: Column) -> Column:
    """What a score job does about its prose: why not, or ``ask``. A retry is moot where the lead has its angle by now."""
    why = F.when(F.coalesce(domain, F.lit("")) == "", "no domain").when(~known, "not found").when(n_triggers == 0, "no live trigger")
    return why.when(~has_model, "no model").when(retry & has_angle, "moot").otherwise("ask")


def prose_retry(reason: Column, attempt: Column, pauses: Column, most: int = 3, most_pauses: int = 12, seconds: int = 1800) -> Column:
    """After a failure: the new counts, and the seconds to the next try, 0 for none. A pause for heat doesn't count as an attempt."""
    paused = text.reason_is(reason, "thermal")
    again = text.reason_is(reason, "thermal", "timed out", "connection", "schema")
    a, p = attempt + F.when(paused, 0).otherwise(1), pauses + F.when(paused, 1).otherwise(0)
    within = F.when(paused, p < most_pauses).otherwise(a < most)
    return F.struct(a.cast("int").alias("attempt"), p.cast("int").alias("pauses"), F.when(again & within, seconds).otherwise(0).alias("retry_in"))


def post_outcome(statuses: Column, most: int = 5) -> Column:
    """How posting ends over the answers' statuses in order (null: no answer): the first that is no reason to try again decides, within ``most`` attempts."""
    tried = F.slice(statuses, 1, most)
    final = F.filter(F.transform(tried, lambda s, i: F.struct((i + 1).alias("attempt"), s.alias("status"))),
        lambda x: x["status"].isNotNull() & (x["status"] != 429) & ~x["status"].between(500, 599))
    last = F.try_element_at(final, F.lit(1))
    return F.struct(F.coalesce(last["status"] < 400, F.lit(False)).alias("ok"), last["status"].alias("status"),
        F.coalesce(last["attempt"], F.size(tried)).alias("attempts"), last.isNull().alias("exhausted"))


def lease_run(seconds: Column, interval: float, most: float) -> Column:
    """A stage of ``seconds`` under a lease that is renewed every ``interval``: the renewals, and whether it ends or is cancelled at ``most``."""
    cancelled = seconds > most
    ran = F.least(seconds, F.lit(most))
    return F.struct(F.greatest(F.lit(0), F.ceil(ran / interval) - 1).cast("int").alias("renewals"), F.when(cancelled, "cancelled").otherwise("done").alias("outcome"))


def stack_query(as_of: Column, days: int = 180) -> Column:
    """The search for public code on agent frameworks, pushed within ``days``; its answers are read with organizations only."""
    return F.concat(F.lit(" OR ".join(C.STACK_TERMS) + " pushed:>"), F.date_format(F.date_sub(as_of.cast("date"), days), "yyyy-MM-dd"))
