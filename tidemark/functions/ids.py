"""Keys that are hashes of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lead_id(domain: Column) -> Column:
    return F.left(F.sha2(F.lower(F.trim(domain)), 256), F.lit(16))


def evidence_id(url: Column, content_hash: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", url, content_hash), 256), F.lit(16))


def idempotency_key(lead: Column, codes: Column, score: Column) -> Column:
    """Same lead, same set of codes, same tenth of the score: same key."""
    parts = F.concat_ws("|", lead, F.array_join(F.array_sort(codes), ","), F.floor(score / 10).cast("string"))
    return F.left(F.sha2(parts, 256), F.lit(32))


def cache_key(engine: Column, query: Column, params: Column) -> Column:
    """Key of a fetch; parameters count by sorted key."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))
    return F.sha2(F.concat_ws("|", engine, query, ordered), 256)


def ttl_bucket(ts: Column, hours: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / (hours * 3600)).cast("long")


def ttl_key(key: Column, ts: Column, hours: int) -> Column:
    return F.concat_ws(":", F.left(F.sha2(key, 256), F.lit(16)), ttl_bucket(ts, hours).cast("string"))
