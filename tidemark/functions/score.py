"""The score: arithmetic over columns, never a model's output."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .dates import age_days


def lookup(values: dict, key: Column, default=None) -> Column:
    """Value of a small constant map."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def decayed_weight(weight: Column, half_life: Column, age: Column) -> Column:
    """Weight halved every half-life; a half-life of 0 doesn't decay, an age below 0 counts as 0."""
    return F.when(half_life <= 0, weight).otherwise(weight * F.exp(-math.log(2) * F.greatest(F.lit(0.0), age) / half_life))


def trigger_weight(code: Column, observed_at: Column, as_of: Column) -> Column:
    w, h = ({k: v[i] for k, v in C.TRIGGERS.items()} for i in (0, 1))
    return decayed_weight(lookup(w, code), lookup(h, code), age_days(observed_at, as_of))


def band_from_roles(open_roles: Column) -> Column:
    out = None
    for least, band in C.BAND_FROM_ROLES:
        out = F.when(open_roles >= least, band) if out is None else out.when(open_roles >= least, band)
    return out


def icp_component(band: Column, industry: Column, domain: Column, country: Column, codes: Column, sectors: tuple[str, ...] = ()) -> Column:
    base = F.when(band.isNull(), F.lit(C.UNKNOWN_BAND_POINTS)).otherwise(lookup(C.BAND_POINTS, band, C.UNKNOWN_BAND_POINTS))
    sector = F.lit(False)
    for s in sectors:
        sector = sector | F.contains(F.lower(industry), F.lit(s.lower()))
    local = F.lit(False)
    for tld in C.LOCAL_TLDS:
        local = local | F.endswith(domain, F.lit(tld))
    local = local | F.coalesce(country.isin(*C.LOCAL_COUNTRIES), F.lit(False))
    alone = F.array_contains(codes, "T4_HIRING_AI_ONLY") & ~F.array_contains(codes, "T3_HIRING_SEC")
    bonus = lambda cond, points: F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0.0)
    return F.least(F.lit(100.0), base + bonus(sector, C.SECTOR_BONUS) + bonus(local, C.LOCAL_BONUS) + bonus(alone, C.NO_SECURITY_HIRE_BONUS))


def surface_component(ai_surface: Column, subdomains: Column, gap: Column) -> Column:
    points = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    return F.least(F.lit(100.0), points(F.size(ai_surface) > 0, C.AI_SURFACE_POINTS) + points(subdomains >= C.SPRAWL_SUBDOMAINS, C.SPRAWL_POINTS) + points(gap,
        C.HYGIENE_POINTS))


def reachability_component(status: Column, named: Column) -> Column:
    return F.least(F.lit(100.0), lookup(C.REACHABILITY, status, 0.0) + F.when(named, C.NAMED_CONTACT_POINTS).otherwise(0.0))


def freshness_component(newest_age: Column) -> Column:
    linear = 100.0 * (1 - F.greatest(F.lit(0.0), newest_age) / C.FRESHNESS_ZERO_DAYS)
    return F.when(newest_age.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), linear)))


def penalty_map(anti_icp: Column, suppressed: Column, stale: Column, country: Column, n_sources: Column, n_triggers: Column) -> Column:
    """Name -> points of the penalties that apply."""
    some = n_triggers > 0
    sanctioned = F.upper(country).isin(*C.SANCTIONED_COUNTRIES) if C.SANCTIONED_COUNTRIES else F.lit(False)
    cond = {"anti_icp": anti_icp, "suppressed": suppressed, "stale_evidence": some & stale, "single_source": some & (n_sources <= 1), "sanctioned_country": sanctioned}
    every = F.create_map(*[x for k, c in cond.items() for x in (F.lit(k), F.when(F.coalesce(c, F.lit(False)), C.PENALTIES[k]).otherwise(0.0))])
    return F.map_filter(every, lambda k, v: v != 0)


def weighted(components: Column) -> Column:
    """Sum of the components by their weights; a component without one counts nothing."""
    return sum((F.coalesce(F.try_element_at(components, F.lit(k)), F.lit(0.0)) * w for k, w in C.COMPONENTS.items()), F.lit(0.0))


def map_total(values: Column) -> Column:
    return F.aggregate(F.map_values(values), F.lit(0.0), lambda s, x: s + x)


def final(raw: Column) -> Column:
    """Clamped to 0 to 100 and rounded, halves to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("int")


def tier(score: Column) -> Column:
    out = None
    for name, least in C.TIERS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("REJECT")


def offer(codes: Column, ai_surface: Column) -> Column:
    has = lambda c: F.array_contains(codes, c)
    ai = F.size(ai_surface) > 0
    return F.when(has("T9_MARKETPLACE"), "gig").when((has("T1_AI_SHIP") | has("T11_STACK_RISK")) & ai,
        "ai_llm_assessment").when((has("T7_SURFACE_SPRAWL") | has("T5_COMPLIANCE")) & ~ai, "watch").otherwise("snapshot_free")


def trigger_phrases(triggers: Column, as_of: Column) -> Column:
    """Phrases of an array of (code, observed_at), the weightiest first, with an age unless derived."""
    from .dates import age_phrase

    w = {k: v[0] for k, v in C.TRIGGERS.items()}
    ranked = F.transform(triggers, lambda t: F.struct((-lookup(w, t["code"], 0.0)).alias("r"), t["code"].alias("code"), t["observed_at"].alias("at")))
    said = lambda t: F.concat(lookup(C.TRIGGER_PHRASES, t["code"]),
        F.when(t["code"].isin(*C.DERIVED_TRIGGERS), F.lit("")).otherwise(F.concat(F.lit(" "), age_phrase(t["at"], as_of))))
    return F.array_join(F.array_compact(F.transform(F.array_sort(ranked), said)), "; ")


def surface_phrases(surfaces: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(surfaces, lambda x: lookup(C.SURFACE_PHRASES, x))))


#: Raised with every change to the arithmetic of this module, which no hash of the values can see.
ARITHMETIC = 1
#: The constants that decide a score. Phrases are not among them: rewording one must not make a score stale.
CALIBRATION = (
    "TRIGGERS", "COMPONENTS", "PENALTIES", "SANCTIONED_COUNTRIES", "TIERS", "BAND_POINTS", "UNKNOWN_BAND_POINTS", "BAND_FROM_ROLES", "SECTOR_BONUS", "LOCAL_BONUS",
        "NO_SECURITY_HIRE_BONUS",
    "AI_SURFACE_POINTS", "SPRAWL_POINTS", "HYGIENE_POINTS", "SPRAWL_SUBDOMAINS", "REACHABILITY", "NAMED_CONTACT_POINTS", "FRESHNESS_ZERO_DAYS", "STALE_DAYS",
        "LOCAL_TLDS", "LOCAL_COUNTRIES",
)
#: Those that decide a verdict of the gate.
GATE = ("EXCLUDED_SECTORS", "MAX_EMPLOYEES", "BAND_TO_MAX", "GOVERNMENT_SUFFIXES", "GOVERNMENT_WORDS", "INFRASTRUCTURE_WORDS", "COMPETITOR_WORDS",
    "PERSONAL_EMAIL_DOMAINS")


def _stamp(names: tuple[str, ...], *more) -> str:
    plain = lambda v: sorted(v, key=repr) if isinstance(v, tuple) else v
    return hashlib.sha256(json.dumps([*more, {n: plain(getattr(C, n)) for n in names}], sort_keys=True).encode()).hexdigest()[:16]


def fingerprint() -> str:
    """Identity of the calibration: 16 hex digits over all values that decide a score."""
    return _stamp(CALIBRATION, ARITHMETIC)


def gate_fingerprint() -> str:
    """Identity of the compliance rules."""
    return _stamp(GATE)


def calibration_version() -> str:
    """Stamp of a score: numbers and gate together."""
    return f"{fingerprint()}:{gate_fingerprint()}"
