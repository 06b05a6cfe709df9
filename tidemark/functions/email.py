"""Addresses, their status and the people behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def host_part(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", -1))


def classify_email(email: Column, has_mx: Column, domain: Column) -> Column:
    """Status of an address, without contacting anything; ``has_mx`` null means that it isn't known."""
    low = F.lower(email)
    local = F.when(F.instr(low, "@") > 0, F.substring_index(low, "@", 1)).otherwise(low)
    host = F.when(F.instr(low, "@") > 0, F.substring(low, F.length(local) + 2, F.length(low))).otherwise(F.lit(""))
    own = (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))
    return (
        F.when((F.length(local) == 0) | (F.length(host) == 0) | (F.instr(host, ".") == 0), "unverified")
        .when(host.isin(*C.DISPOSABLE_DOMAINS) | host.isin(*C.PERSONAL_EMAIL_DOMAINS), "risky")
        .when(~own, "unverified")
        .when(~has_mx, "risky")
        .when(has_mx.isNull(), "unverified")
        .when(local.isin(*C.ROLE_LOCAL_PARTS), "role_account")
        .otherwise("verified")
    )


def emails_in(text: Column) -> Column:
    """Distinct lower-case addresses in prose, in their order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({C.EMAIL_PATTERN})"), F.lit(1)), F.lower))


def mailto_emails(html: Column) -> Column:
    """Distinct addresses of mailto links, in their order."""
    found = F.regexp_extract_all(html, F.lit(C.MAILTO_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"[.,;]+$", "")))


def security_contact(body: Column) -> Column:
    found = F.lower(F.regexp_extract(body, C.SECURITY_CONTACT_PATTERN, 1))
    return F.when(F.length(found) > 0, found)


def persona(title: Column) -> Column:
    low, out = F.lower(title), None
    for pattern, name in C.PERSONAS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return F.when(F.length(title) > 0, out.otherwise("generic"))


def contact_rank(email: Column) -> Column:
    """0 a person, 1 a role that people read, 2 another role."""
    local = F.substring_index(email, "@", 1)
    return F.when(~local.isin(*C.ROLE_LOCAL_PARTS), 0).when(local.isin(*C.REACHABLE_ROLES), 1).otherwise(2)


def extract_contacts(prose: Column, more: Column, has_mx: Column, domain: Column, limit: int = 3) -> Column:
    """The usable addresses of a page's prose and of ``more`` (its links, its security.txt): people first, then roles that are read, then
    others, each in order of address. ``limit`` is the rule that no more is stored than is needed. Obfuscated ones are left alone."""
    every = F.array_distinct(F.concat(F.transform(F.coalesce(more, F.array().cast("array<string>")), F.lower),
        F.coalesce(emails_in(prose), F.array().cast("array<string>"))))
    good = F.filter(every, lambda e: usable(classify_email(e, has_mx, domain)))
    ranked = F.array_sort(F.transform(good, lambda e: F.struct(contact_rank(e).alias("r"), e.alias("e"))))
    return F.slice(F.transform(ranked, lambda x: x["e"]), 1, limit)


def usable(status: Column) -> Column:
    return status.isin(*C.USABLE_STATUSES)


def status_rank(status: Column) -> Column:
    out = F.when(status == C.USABLE_STATUSES[0], 0)
    for i, s in enumerate(("role_account", "catch_all", "risky", "unverified"), 1):
        out = out.when(status == s, i)
    return out.otherwise(9)
