"""Instants and ages. Time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def age_days(ts: Column, as_of: Column) -> Column:
    """Fractional days from ``ts`` to ``as_of``."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(as_of) - micros(ts)) / F.lit(86_400_000_000.0)


def age_phrase(ts: Column, as_of: Column) -> Column:
    d = F.greatest(F.lit(0), F.floor(age_days(ts, as_of)).cast("int"))
    weeks, months = F.floor(d / 7).cast("string"), F.floor(d / 30).cast("string")
    return (
        F.when(d == 0, "today").when(d == 1, "yesterday").when(d < 14, F.concat(d.cast("string"), F.lit(" days ago")))
        .when(d < 60, F.concat(weeks, F.lit(" weeks ago"))).otherwise(F.concat(months, F.lit(" months ago")))
    )


def epoch_ms(value: Column) -> Column:
    return F.timestamp_millis(value.try_cast("long"))


def throttle_flags(text: Column) -> Column:
    """Bits of a hexadecimal status word: under-voltage, capped and throttled, now and before."""
    v = F.conv(F.regexp_extract(text, r"(?i)0x([0-9a-f]+)", 1), 16, 10).try_cast("long")
    bit = lambda n: F.shiftright(v, n).bitwiseAND(F.lit(1)) == 1
    return F.struct(bit(0).alias("undervoltage"), bit(1).alias("capped"), bit(2).alias("throttled"), bit(3).alias("soft_limit"), bit(16).alias("was_undervoltage"),
        bit(17).alias("was_capped"), bit(18).alias("was_throttled"), bit(19).alias("was_soft_limit"))
