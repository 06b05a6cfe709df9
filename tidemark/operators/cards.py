"""Cards, digests and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DESCRIPTION_CHARS, FIELD_CHARS, PAGE_CHARS, PAGE_ROWS, TITLE_CHARS
from ..functions.binding import let
from ..functions.text import publishable, truncate
from ..streaming.machines import fold
from .details import fit_total


def _field(name: str, value: Column, keep_tail: bool = False) -> Column:
    return let(value, lambda v: F.when(F.length(v) > 0, F.struct(F.lit(name).alias("name"), truncate(v, FIELD_CHARS, keep_tail).alias("value"))))


def lead_card(view: DataFrame, as_of: Column, basis: str = "legitimate_interest_b2b") -> DataFrame:
    """The full card of each lead of ``reads.lead_view``: author, title, description, fields and footer, within a message's limits.

    ``view`` may have description, angle, translation and contact (as ``scoring.facts`` gives it); angles that name internal codes are withheld. A field without
    content is left out, but for triggers, evidence and compliance.
    """
    view = view.withColumns({n: F.lit(None).cast("string") for n in ("description", "angle", "translation") if n not in view.columns})
    contact = F.col("contact.email") if "contact" in view.columns else F.lit(None).cast("string")
    ages = F.transform("triggers", lambda t: F.format_string("`%s` 0.80 · %dd ago", t["code"], F.datediff(as_of, t["observed_at"])))
    surface = F.concat(F.col("ai_surface"), F.when(F.col("subdomains") > 0,
        F.array(F.concat(F.col("subdomains").cast("string"), F.lit(" CT subdomains")))).otherwise(F.array().cast("array<string>")))
    passed = F.col("passed") if "passed" in view.columns else F.lit(True)
    fields = F.array_compact(F.array(
        _field("🔥 Triggers", F.when(F.size("triggers") > 0, F.array_join(ages, "\n")).otherwise("—")), _field("🎯 Angle", publishable(F.col("angle"))),
            _field("🇧🇩 বাংলা", publishable(F.col("translation"))),
        _field("👤 Contact", contact), _field("🛰 Publicly visible", F.array_join(surface, " · ")), _field("📎 Evidence", links(F.col("evidence")), keep_tail=True),
        _field("⚖️ Compliance", F.concat(F.when(passed, "PASS").otherwise("VETO"), F.lit(f" · basis: {basis} · passive-only ✓ · no scan performed"))),
    ))
    head = view.select(
        *[n for n in ("k",) if n in view.columns], "lead_id",
            F.concat(F.lit("TIER "), "tier", F.lit(" · "), F.col("score").cast("string"), F.lit(" · "), "offer").alias("author"),
            truncate(F.concat("display_name", F.lit(" · "), "domain"), TITLE_CHARS).alias("title"),
        F.concat(F.lit("https://"), "domain").alias("url"), truncate(F.coalesce("description", F.lit("—")), DESCRIPTION_CHARS).alias("description"),
            fields.alias("fields"), F.concat(F.lit("lead_id "), "lead_id").alias("footer"),
    )
    # what stands outside of description and fields counts as well
    other = F.length("author") + F.length("title") + F.length("footer")
    fitted = fit_total(F.col("description"), F.col("fields"), F.lit(PAGE_CHARS) - other)
    return head.withColumn("fitted", fitted).withColumns({"description": F.col("fitted.description"), "fields": F.col("fitted.fields")}).drop("fitted")


def links(evidence: Column) -> Column:
    """Sources as links, each address once, in order."""
    urls = F.transform(evidence, lambda e: e["url"])
    once = F.filter(evidence, lambda e, i: F.array_position(urls, e["url"]) == i + 1)
    said = F.array_join(F.transform(once, lambda e: F.concat(F.lit("["), e["source_id"].cast("string"), F.lit("]("), e["url"], F.lit(")"))), " · ")
    return F.when(F.size(evidence) > 0, said).otherwise("—")


def rendered_size(title: Column, description: Column, fields: Column) -> Column:
    """Characters that count against a message's limit."""
    return F.length(title) + F.length(description) + F.aggregate(fields, F.lit(0), lambda s, f: s + F.length(f["name"]) + F.length(f["value"]))


def digest_pages(rows: DataFrame, key: str, order: str, size: str, group: str | None = None, page_rows: int = PAGE_ROWS, page_chars: int = PAGE_CHARS) -> DataFrame:
    """Greedy pages of at most ``page_rows`` rows and ``page_chars`` characters, in ``order`` within ``group``.

    A fold that holds a page's counters only, so that a group may have any number of rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    g = F.lit("all") if group is None else F.col(group).cast("string")
    given = rows.select(g.alias("g"), F.col(order).alias("o"), F.col(key).alias("k"), F.col(size).cast("long").alias("s"))

    def step(state, own, k, s):
        page, n, used = state or (0, 0, 0)
        if n and (n >= page_rows or used + s > page_chars):
            page, n, used = page + 1, 0, 0
        return (page, n + 1, used + s), (own, k, page)

    return fold(given, "g", ["o", "k"], step, f"g string, k {kind}, page int", ["k", "s"]).withColumnRenamed("k", key)


def new_dispatches(leads: DataFrame, log: DataFrame) -> DataFrame:
    """Leads with an idempotency key that wasn't sent."""
    from ..functions.ids import idempotency_key

    keyed = leads.withColumn("idempotency_key", idempotency_key(F.col("lead_id"), F.col("codes"), F.col("score")))
    return keyed.join(log.select("idempotency_key"), "idempotency_key", "left_anti")


def skip_reason(leads: DataFrame, immediate=("A", "B")) -> DataFrame:
    c = F.col
    why = F.when(c("tier") == "REJECT", "rejected").when(~c("tier").isin(*immediate), "digest").when(c("already_sent"), "already_sent").when(c("channel").isNull(),
        "no_channel")
    return leads.withColumn("skip_reason", why)
