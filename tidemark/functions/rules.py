"""Compliance rules: each column is true where the lead is acceptable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .email import host_part
from .score import lookup
from .url import has_government_suffix


def _about(industry: Column, name: Column) -> Column:
    return F.lower(F.concat(F.coalesce(industry, F.lit("")), F.lit(" "), F.coalesce(name, F.lit(""))))


def _holds(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w.lower()))
    return out


def rules(
    evidence: Column, codes: Column, suppressed: Column, emails: Column, band: Column, domain: Column, industry: Column, name: Column,
    business: Column | None = None, sectors=C.EXCLUDED_SECTORS, max_employees: int = C.MAX_EMPLOYEES,
) -> dict[str, Column]:
    """All ten rules, none short-circuited."""
    about = _about(industry, name)
    personal = F.exists(emails, lambda e: F.contains(e, F.lit("@")) & host_part(e).isin(*C.PERSONAL_EMAIL_DOMAINS))
    return {
        "has_evidence": F.size(evidence) > 0,
        "has_trigger": F.size(codes) > 0,
        "not_suppressed": ~suppressed,
        "is_business_not_individual": F.lit(True) if business is None else business,
        "no_personal_email": ~F.coalesce(personal, F.lit(False)),
        "under_employee_ceiling": band.isNull() | (lookup(C.BAND_TO_MAX, band, 0) <= max_employees),
        "not_government_or_cni": ~has_government_suffix(domain) & ~_holds(about, C.GOVERNMENT_WORDS + C.INFRASTRUCTURE_WORDS),
        "not_a_competitor": ~_holds(about, C.COMPETITOR_WORDS),
        "not_an_excluded_sector": ~_holds(about, sectors),
        "has_canonical_domain": F.length(F.coalesce(domain, F.lit(""))) > 0,
    }


def verdict(checks: dict[str, Column]) -> Column:
    """(passed, checks, vetoes)."""
    every = F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), F.coalesce(c, F.lit(False)))])
    vetoes = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return F.struct((F.size(vetoes) == 0).alias("passed"), every.alias("checks"), vetoes.alias("vetoes"))
