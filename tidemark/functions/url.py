"""Domains and platform hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GOVERNMENT_SUFFIXES, MULTI_PART_SUFFIXES, PLATFORM_HOSTS
from .binding import let


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def host_of(value: Column) -> Column:
    """Lower-case host of a URL or a bare host, without port, credentials and outer dots; null if none."""
    raw = F.lower(F.trim(value))
    # what follows the first "//", or everything; the authority ends at the first / ? or #
    rest = F.when(F.instr(raw, "//") > 0, F.regexp_replace(raw, r"^[^/]*//", "")).otherwise(raw)
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    host = F.regexp_replace(host, r"^\.+|\.+$", "")
    return F.when(F.length(host) > 0, host)


def suffixes(host: Column) -> Column:
    """The host and every parent of it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def is_platform(host: Column) -> Column:
    """Is the host, or a parent of it, on the list of platforms?"""
    return F.arrays_overlap(suffixes(host), _strings(PLATFORM_HOSTS))


def canonical_domain(value: Column) -> Column:
    """Registrable domain of a URL or host; null for addresses, single labels, platforms and odd characters."""

    def registrable(host: Column, labels: Column) -> Column:
        n = F.size(labels)
        tail = lambda k: F.array_join(F.slice(labels, -k, k), ".")
        return F.when(n >= 3, F.when(tail(2).isin(*MULTI_PART_SUFFIXES), tail(3)).otherwise(tail(2))).when(n == 2, host)

    def checked(x: Column) -> Column:
        host, domain = x["host"], x["domain"]
        good = ~host.rlike(r"[ :]") & ~host.rlike(r"^[0-9.]+$") & domain.rlike(r"^[a-z0-9.-]+$") & ~is_platform(host) & ~is_platform(domain)
        return F.when(good, domain)

    # the host and its labels are computed once
    return let(host_of(value), lambda h: let(F.struct(h.alias("host"), registrable(h, F.split(h, r"\.")).alias("domain")), checked))


def has_government_suffix(domain: Column) -> Column:
    host = F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"^\.+|\.+$", "")
    pattern = "|".join(s.replace(".", r"\.") for s in GOVERNMENT_SUFFIXES)
    return host.rlike(rf"(^|\.)({pattern})$")


def extraction_target(url: Column, homepage: Column) -> Column:
    """The hit's own URL if it names a company, else its homepage, with a scheme, else null."""
    home = F.when(F.contains(homepage, F.lit("//")), homepage).otherwise(F.concat(F.lit("https://"), homepage))
    return F.when(canonical_domain(url).isNotNull(), url).when(canonical_domain(homepage).isNotNull(), home)


def first_company_url(markup: Column) -> Column:
    """The first link that names a company, links in markup before bare ones."""
    from .text import unescape_basic

    plain = unescape_basic(markup)
    hrefs = F.regexp_extract_all(plain, F.lit(r"""(?i)href="(https?://[^"\s]+)\""""), F.lit(1))
    bare = F.regexp_extract_all(plain, F.lit(r"""(?i)(https?://[^\s<>"')]+)"""), F.lit(1))
    cleaned = F.transform(F.concat(hrefs, bare), lambda u: F.regexp_replace(u, r"[.,);]+$", ""))
    return F.try_element_at(F.filter(cleaned, lambda u: canonical_domain(u).isNotNull()), F.lit(1))
