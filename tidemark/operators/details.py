"""Smaller stage bodies: quotes, extraction bounds, site and board lookups, leases, routing, sizes, health levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BAND_TO_MAX, COMPONENTS, PAGE_CHARS, TIERS, TRIGGERS
from ..functions import email, text
from ..functions.binding import let
from ..functions.dates import to_iso
from .graph import cut

MAX_QUOTES = 2
CARD_PROTECTED = ("📎", "⚖️")


def quotes(evidence: DataFrame, most: int = MAX_QUOTES) -> DataFrame:
    """The first ``most`` distinct quotes of each company that were found on a page; those that we wrote have no content hash."""
    key = F.regexp_replace(text.normalize_ws(F.coalesce("snippet", F.lit(""))), r"[.!?,;:]+$", "")
    e = evidence.where(F.length(F.trim(F.coalesce("content_hash", F.lit("")))) > 0).withColumn("key", key).where("key <> ''")
    first = e.groupBy("k", "key").agg(F.min(F.struct("seq", "snippet")).alias("q"))
    w = Window.partitionBy("k").orderBy("q")
    top = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.trim("q.snippet").alias("s")))),
        lambda x: F.concat(F.lit('  - "'), x["s"], F.lit('"'))), "\n").alias("quotes"))


def recipient(contacts: DataFrame) -> DataFrame:
    """First name of each company's first contact that has one, in status order."""
    named = contacts.where(F.length(F.trim(F.coalesce("full_name", F.lit("")))) > 0)
    best = named.groupBy("k").agg(F.min_by("full_name", F.struct(email.status_rank(F.col("status")), "contact_id")).alias("name"))
    return best.select("k", F.element_at(F.split(F.trim("name"), r"\s+"), 1).alias("first_name"))


EXTRACTION = (
    "display_name string, canonical_domain string, country string, description string, employee_band string, industry string, tech_signals array<string>, ai_surface array<string>, "
    "trigger_codes array<string>, evidence_snippets array<string>"
)


def extraction(body: Column) -> Column:
    """A model's JSON as a struct, null where it breaks a bound: lengths, sizes, known bands and codes."""
    x = F.from_json(text.outer_json(body), EXTRACTION)
    short = lambda c, n: c.isNull() | (F.length(c) <= n)
    few = lambda c, n, m: c.isNull() | ((F.size(c) <= n) & F.forall(c, lambda v: v.isNotNull() & (F.length(v) <= m)))
    ok = x["display_name"].isNotNull() & short(x["display_name"], 80) & short(x["canonical_domain"], 80) & short(x["country"], 2) & short(x["description"],
        160) & short(x["industry"], 40)
    ok = ok & (x["employee_band"].isNull() | x["employee_band"].isin(*BAND_TO_MAX)) & few(x["tech_signals"], 6, 24) & few(x["ai_surface"], 4,
        24) & few(x["evidence_snippets"], 2, 120)
    codes = x["trigger_codes"]
    ok = ok & (codes.isNull() | ((F.size(codes) <= 4) & F.forall(codes, lambda c: c.isin(*TRIGGERS))))
    return F.when(ok, x)


def stored_codes(codes: Column, targets: Column) -> Column:
    """The codes that were found; else those of the plan's targets that exist."""
    known = F.array(*[F.lit(c) for c in TRIGGERS])
    return F.when(F.size(codes) > 0, codes).otherwise(F.array_intersect(F.coalesce(targets, F.array().cast("array<string>")), known))


def site_pages(pages: DataFrame) -> DataFrame:
    """Of each domain's pages (domain, rank, html), in rank order: read up to the first with an address (the root page, rank 0,
    is always read), and up to the first that mirrors an earlier one. A domain's ranks are unique.

    Where a domain stops is found from digests alone, by minima with partial aggregation; the pages themselves meet one row a domain.
    """
    p = pages.withColumn("mails", email.mailto_emails(F.col("html")))
    seen = cut(p.select("domain", "rank", F.sha2("html", 256).alias("sha"), (F.size("mails") > 0).alias("has")), "seen")
    first = seen.groupBy("domain", "sha").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = lambda x, y, *names: reduce(Column.__and__, [F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) for n in names])
    again = seen.alias("s").join(first.alias("f"), same("s", "f", "domain", "sha")).where("s.rank > f.first").groupBy("s.domain").agg(F.min("s.rank").alias("again"))
    mailed = seen.where("has").groupBy("domain").agg(F.min("rank").alias("mailed"))
    stop = again.unionByName(mailed, allowMissingColumns=True).groupBy("domain").agg(F.min("again").alias("again"), F.min("mailed").alias("mailed"))
    held = p.alias("p").join(cut(stop, "stops").alias("t"), same("p", "t", "domain"), "left")
    later = lambda c: F.coalesce(c, F.lit(False))
    stopped = later(F.col("rank") >= F.col("again")) | later((F.col("rank") > F.col("mailed")) & (F.col("rank") > 0))
    return held.where(~stopped).select("p.domain", "rank", "html", "mails")


def site_findings(pages: DataFrame) -> DataFrame:
    """Text and addresses of each domain's pages. Ranks are places in a list of paths, so that a domain has few."""
    g = site_pages(pages).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("rank", text.cut_prose(text.html_text(F.col("html")), 8000).alias("t"),
        "mails"))).alias("x"))
    return g.select("domain", F.array_join(F.transform("x", lambda v: v["t"]), "\n").alias("text"),
        F.array_distinct(F.flatten(F.transform("x", lambda v: v["mails"]))).alias("emails"))


def security_txt(status: Column, body: Column) -> Column:
    """True where it parses, false where it is absent, null where that isn't known."""
    return F.when(status == 404, False).when((status == 200) & text.is_security_txt(body), True)


def first_board(boards: DataFrame) -> DataFrame:
    """Each domain's first board that has postings, by rank."""
    return boards.where("n_postings > 0").groupBy("domain").agg(F.min_by(F.struct("board", "n_postings", "url"), "rank").alias("b")).select("domain", "b.*")


def derived_triggers(triggers: DataFrame, found: DataFrame, window: Column) -> DataFrame:
    """Derived triggers (k, code, seen_at) merged into the live ones: the date always moves; new ones have no id yet and confidence 0.8."""
    live = triggers.where("active").groupBy("k", "code").agg(F.min("trigger_id").alias("trigger_id"))
    f = found.groupBy("k", "code").agg(F.max("seen_at").alias("observed_at"))
    return f.join(live, ["k", "code"], "left").select("trigger_id", "k", "code", "observed_at", (F.col("observed_at") + window).alias("decays_at"),
        F.lit(0.8).alias("confidence"))


def injection_rows(pages: DataFrame, key: str, prose: str) -> DataFrame:
    """What tripped pages append to the quarantine."""
    reasons = text.injection_reasons(F.col(prose))
    p = pages.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    return p.select(F.col(key).alias("subject_id"), F.concat_ws(",", "reasons").alias("reason_code"),
        F.substring(F.concat_ws(" | ", text.injection_excerpts(F.col(prose))), 1, 1000).alias("detail"))


def heartbeat_rows(beats: DataFrame) -> DataFrame:
    """Heartbeats as metric rows with JSON labels."""
    return beats.select(F.lit("heartbeat").alias("name"), F.lit(1.0).alias("value"), F.to_json(F.struct("unit", "ok", "build")).alias("labels"),
        to_iso(F.col("at")).alias("recorded_at"))


def payload(hits: DataFrame) -> DataFrame:
    body = F.struct(F.col("target").alias("url"), F.col("url").alias("discovered_at"), "title", "snippet", "targets", F.col("template").alias("template_id"))
    return hits.withColumn("raw_payload", F.to_json(body))


def template_of(job_template: Column, stored_payload: Column) -> Column:
    return F.coalesce(F.nullif(job_template, F.lit("")), F.get_json_object(stored_payload, "$.template_id"))


def retracted(feedback: DataFrame, retractions: DataFrame) -> DataFrame:
    """Feedback without the reactions that were taken back: only rows of the same lead, actor and verdict that came by reaction."""
    r = retractions.select("k", "actor", "verdict").withColumn("source", F.lit("reaction"))
    return feedback.join(r, ["k", "actor", "verdict", "source"], "left_anti")


def extend_leases(jobs: DataFrame, workers: DataFrame, until: Column) -> DataFrame:
    """Leases of in-flight jobs that their own worker renews."""
    own = jobs.where("status = 'in_flight'").join(workers, ["job_id", "lease_owner"], "left_semi")
    return own.withColumn("lease_expires_at", until)


def complete(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Finished jobs (job_id, lease_owner) as done, or lost where the lease is another's by now."""
    j = jobs.select("job_id", "status", F.col("lease_owner").alias("holder"))
    f = finished.join(j, "job_id", "left")
    kept = (F.col("status") == "in_flight") & F.col("holder").eqNullSafe(F.col("lease_owner"))
    return f.select("job_id", F.when(F.coalesce(kept, F.lit(False)), "done").otherwise("lease_lost").alias("outcome"))


def budget_status(used: Column, cap: Column) -> Column:
    return F.struct(used.alias("used"), F.greatest(F.lit(0.0), cap - used).alias("remaining"), F.try_divide(used, cap).alias("fraction"),
        (used >= cap).alias("exhausted"))


def backoff(attempt: Column, base: float = 1.0, cap: float = 60.0, seed: int = 0, key: Column | None = None) -> Column:
    """A random delay below the doubled base, at most the cap. With a ``key`` the delay is its own at each attempt: a task that runs again gives the same."""
    most = F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt))
    if key is None:
        return F.rand(seed) * most
    drawn = F.conv(F.left(F.sha2(F.concat_ws(":", key.cast("string"), attempt.cast("int").cast("string")), 256), F.lit(8)), 16, 10).cast("double") / (1 << 32)
    return drawn * most


def is_client_error(status: Column) -> Column:
    return status.between(400, 499) & (status != 429)


def channel(tier: Column, channels: Column) -> Column:
    """The tier's own channel, else the next in the fixed order that is set."""
    get = lambda k: F.try_element_at(channels, k)
    return F.coalesce(F.nullif(get(tier), F.lit("")), F.nullif(get(F.lit("warm")), F.lit("")), F.nullif(get(F.lit("digest")), F.lit("")))


def digest_summary(stats: Column) -> Column:
    """The run's numbers in a line; ``stats`` is a map of counts."""
    n = lambda k: F.concat(F.lit(f"{k} "), F.coalesce(F.try_element_at(stats, F.lit(k)), F.lit(0.0)).cast("long").cast("string"))
    usd = F.format_string("cloud $%.2f", F.coalesce(F.try_element_at(stats, F.lit("usd")), F.lit(0.0)))
    return F.concat_ws(" · ", *[n(k) for k in ("harvested", "candidates", "companies", "dispatched", "vetoed", "credits")], usd)


def trigger_lines(triggers: Column) -> Column:
    """Lines of code, confidence and age of an array of (code, confidence, age_days)."""
    return F.array_join(F.transform(triggers, lambda t: F.format_string("`%s` %.0f%% · %d d", t["code"], t["confidence"] * 100, F.floor(t["age_days"]))), "\n")


def fit_total(description: Column, fields: Column, limit: int | Column = PAGE_CHARS) -> Column:
    """A card within the limit: the description shrinks if that is enough, else optional fields go from the end; evidence and
    compliance fields are kept, behind the others."""
    own = lambda f: F.length(f["name"]) + F.length(f["value"])
    size = lambda fs: F.aggregate(fs, F.lit(0), lambda a, f: a + own(f))
    safe = lambda f: F.startswith(f["name"], F.lit(CARD_PROTECTED[0])) | F.startswith(f["name"], F.lit(CARD_PROTECTED[1]))
    bound = F.lit(limit) if isinstance(limit, int) else limit

    def measured(x: Column) -> Column:
        over = F.length(x["d"]) + size(x["f"]) - x["limit"]
        return F.struct(x["d"].alias("d"), x["f"].alias("f"), x["limit"].alias("limit"), over.alias("over"), (F.length(x["d"]) - over - 16).alias("room"))

    def described(x: Column) -> Column:
        head = F.left(x["d"], x["room"] - 1)
        cut_at = F.length(head) - F.instr(F.reverse(head), " ")
        shrunk = F.concat(F.when((F.instr(head, " ") > 0) & (cut_at > x["room"] * 0.6), F.left(head, cut_at)).otherwise(head), F.lit("…"))
        desc = F.when((x["over"] > 0) & (x["room"] > 0), shrunk).otherwise(x["d"])
        kept, optional = F.filter(x["f"], safe), F.filter(x["f"], lambda f: ~safe(f))
        return F.struct(desc.alias("d"), x["f"].alias("f"), ((x["over"] <= 0) | (x["room"] > 0)).alias("whole"), x["limit"].alias("limit"), kept.alias("kept"),
            optional.alias("optional"))

    def fitted(x: Column) -> Column:
        # optional fields from the first on, as long as they fit
        none = F.struct(F.slice(x["optional"], 1, 0).alias("kept"), (F.length(x["d"]) + size(x["kept"]) - x["limit"]).alias("over"), F.lit(True).alias("open"))
        fit = lambda a, f: a["open"] & (a["over"] + own(f) <= 0)
        add = lambda a, f: F.struct(F.when(fit(a, f), F.concat(a["kept"], F.array(f))).otherwise(a["kept"]).alias("kept"),
            F.when(fit(a, f), a["over"] + own(f)).otherwise(a["over"]).alias("over"), fit(a, f).alias("open"))
        left = F.aggregate(x["optional"], none, add)["kept"]
        return F.struct(x["d"].alias("description"), F.when(x["whole"], x["f"]).otherwise(F.concat(left, x["kept"])).alias("fields"))

    given = F.struct(description.alias("d"), fields.alias("f"), bound.alias("limit"))
    return let(let(let(given, measured), described), fitted)


def trigger_for_tier_a(stats: DataFrame) -> DataFrame:
    """What the trigger component must reach for tier A, the others at their mean (name, mean) and reachability perfect."""
    others = {k: w for k, w in COMPONENTS.items() if k not in ("trigger", "reachability")}
    weight = F.create_map(*[F.lit(x) for kv in others.items() for x in kv])
    total = stats.agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("name")), F.lit(0.0)) * F.col("mean")).alias("others"))
    return total.select(((dict(TIERS)["A"] - F.col("others") - 100.0 * COMPONENTS["reachability"]) / COMPONENTS["trigger"]).alias("needed"))


def disk_level(free_mb: Column) -> Column:
    return F.when(free_mb.isNull(), "degraded").when(free_mb < 512, "critical").when(free_mb < 2048, "degraded").otherwise("ok")


def thermal_level(alert: Column) -> Column:
    return F.when(alert == "none", "ok").when(alert == "critical", "critical").otherwise("degraded")


def build_level(running: Column, on_disk: Column, slack_s: float = 1.0) -> Column:
    return F.when(running.isNull() | (running == 0), "degraded").when(on_disk > running + slack_s, "degraded").otherwise("ok")


def plan_rows(templates: DataFrame) -> DataFrame:
    """Templates as plans: only the parameters that are set."""
    every = F.create_map(F.lit("tags"), F.col("tags"), F.lit("language"), F.col("language"), F.lit("title_contains"), F.col("title_contains"))
    return templates.select("template", "engine", "query", F.map_filter(every, lambda k, v: v.isNotNull()).alias("params"),
        F.greatest(F.lit(1), F.col("ttl_hours")).alias("ttl_hours"))


def expand_threads(stories: DataFrame, comments: DataFrame, title: str, most: int = 3, key: str = "story_id") -> DataFrame:
    """Threads whose title holds ``title`` become their comments, at most ``most`` threads a template, the newest first; other
    stories pass through. ``key`` is the column of both that tells whose comments they are: stories that share a key share comments, and
    only the threads that are left are joined with them."""
    is_thread = F.contains(F.lower("title"), F.lit(title.lower()))
    w = Window.partitionBy("template").orderBy(F.desc("published_at"), "story_id")
    threads = stories.where(is_thread).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("template", key)
    found = comments.join(threads, key).select("template", "title", "url")
    return stories.where(~is_thread).select("template", "title", "url").unionByName(found)
