"""Mail and DNS hygiene of a struct (mx, spf, dmarc, dnssec, security_txt)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HYGIENE = "mx boolean, spf string, dmarc string, dnssec boolean, security_txt boolean"


def parse_hygiene(text: Column) -> Column:
    return F.from_json(text, HYGIENE)


def mail_weakness(h: Column) -> Column:
    """Gaps that justify a trigger; none for a domain without mail, null for what isn't known."""
    found = F.array_compact(
        F.array(
            F.when(h["spf"].isNull(), "no SPF record published"),
            F.when(h["dmarc"].isNull(), "no DMARC record published").when(h["dmarc"] == "none", "DMARC p=none (monitor only)"),
        )
    )
    return F.when(h.isNull(), F.lit(None).cast("array<string>")).when(F.coalesce(h["mx"], F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def hygiene_gaps(h: Column) -> Column:
    """What is worth showing: only what was found to be absent, never what couldn't be read."""
    more = F.array_compact(F.array(F.when(~h["dnssec"], "DNSSEC not enabled"), F.when(~h["security_txt"], "no security.txt")))
    return F.concat(mail_weakness(h), more)
