"""What held when: validity intervals of changes, and as-of joins without a join over ranges.

Rows and changes of one key are sorted together by time. A key may hold any share of the rows, so the sort is by key and day: within
a day the last change before a row is found by a window, and what a day begins with is carried from the days before in a table of
one row a key and day with a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TIERS


def latest_at_once(changes: DataFrame, order: str) -> DataFrame:
    """(k, at, value): of changes of a key at one time the last by ``order``."""
    return changes.groupBy("k", "at").agg(F.max_by("value", order).alias("value"))


def intervals(changes: DataFrame) -> DataFrame:
    """(k, value, from_at, to_at) of changes (k, at, value), one a key and time: a value holds up to the next other one; the last has no end.
    Changes to the value that holds already are no changes."""
    by = Window.partitionBy("k").orderBy("at")
    new = changes.withColumn("before", F.lag(F.struct("value")).over(by)).where(F.col("before").isNull() | ~F.col("before.value").eqNullSafe(F.col("value")))
    return new.select("k", "value", F.col("at").alias("from_at"), F.lead("at").over(by).alias("to_at"))


def as_of(rows: DataFrame, changes: DataFrame, name: str = "value") -> DataFrame:
    """``rows`` (k, at, ...) with the value that held at their time as ``name``: that of the last of ``changes`` (k, at, value; one a key
    and time) at or before it, null before the first. Rows without a key or a time get null."""
    day = F.to_date("at").alias("day")
    columns = rows.columns
    # changes come first at one time; what the day had last before a row is the row's
    every = changes.select("k", "at", day, F.struct("value").alias("_v"), F.lit(0).alias("_kind")).unionByName(rows.select("k", "at", day, F.struct(*columns).alias("_row"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    within = Window.partitionBy("k", "day").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = every.withColumn("_v", F.last("_v", ignorenulls=True).over(within)).where("_kind = 1")
    # the last value of each day with a change holds until the next such day
    last = changes.groupBy("k", day).agg(F.max_by(F.struct("value"), "at").alias("_c"))
    asked = held.where("_v IS NULL").select("k", "day").distinct()
    days = asked.select("k", "day", F.lit(None).cast(last.schema["_c"].dataType).alias("_c"), F.lit(True).alias("_asked")).unionByName(last.withColumn("_asked", F.lit(False)))
    before = Window.partitionBy("k").orderBy("day", F.desc("_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = days.withColumn("_c", F.last("_c", ignorenulls=True).over(before)).where("_asked").select(F.col("k").alias("_k"), F.col("day").alias("_day"), "_c")
    on = F.col("k").eqNullSafe(F.col("_k")) & F.col("day").eqNullSafe(F.col("_day"))
    value = F.when(F.col("k").isNotNull() & F.col("at").isNotNull(), F.coalesce("_v", "_c")["value"])
    return held.join(carried, on, "left").select(F.col("_row.*"), value.alias(name))


def _rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t, _ in TIERS], F.lit("REJECT")), tier)


def dispatched_tiers(dispatches: DataFrame, scores: DataFrame, live: DataFrame) -> DataFrame:
    """Of each dispatched lead, from dispatches (k, at), its tiers by time (k, at, value) and the leads with a live trigger (k): its first
    dispatch, the tier then and now, whether it fell since, and whether it is archived, as no trigger of it lives. A lead is never sent again for
    a lower tier: ``resend`` is true only where it rose and isn't archived."""
    first = dispatches.groupBy("k").agg(F.min("at").alias("at"))
    now = scores.groupBy("k").agg(F.max_by("value", "at").alias("now"))
    x = as_of(first, scores, "then").join(now, "k", "left").join(live.select("k").distinct().withColumn("lives", F.lit(True)), "k", "left")
    archived = F.col("lives").isNull()
    fell, rose = (F.coalesce(c, F.lit(False)) for c in (_rank(F.col("now")) > _rank(F.col("then")), _rank(F.col("now")) < _rank(F.col("then"))))
    return x.select("k", "at", "then", "now", fell.alias("demoted"), archived.alias("archived"), (rose & ~archived).alias("resend"))
