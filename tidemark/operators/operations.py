"""Heartbeats, queue, budgets and acceptance, in batch form over ordered logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HEARTBEAT_GAP_SECONDS, JOB_STATUSES, OUTAGE_MINUTES


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


_ORDER = ("at", "seq")


def _day() -> Column:
    return F.to_date("at").alias("day")


def _beside(rows: DataFrame, columns: tuple[str, ...], before: bool, name: str) -> DataFrame:
    """``rows`` with the struct ``name`` of ``columns`` of the unit's row before (or after), null at its end.

    A unit's rows are ordered day by day, and what crosses midnight is carried on by a table of one row for each unit and day, so
    that a unit with a third of all rows is many groups.
    """
    held = F.struct(*columns)
    by_day = Window.partitionBy("unit", "day").orderBy(*_ORDER)
    w = Window.partitionBy("unit").orderBy("day")
    d = rows.withColumn("day", _day())
    edge = (F.max_by if before else F.min_by)(held, F.struct(*_ORDER))
    ends = d.groupBy("unit", "day").agg(edge.alias("edge")).select("unit", "day", (F.lag if before else F.lead)("edge").over(w).alias("carried"))
    out = d.withColumn(name, (F.lag if before else F.lead)(held).over(by_day)).join(ends, ["unit", "day"])
    return out.withColumn(name, F.coalesce(name, "carried")).drop("carried", "day")


def latest_per_unit(beats: DataFrame) -> DataFrame:
    return beats.groupBy("unit").agg(F.max_by(F.struct("seq", "at", "ok", "value"), F.struct("at", "seq")).alias("b")).select("unit", "b.*")


def gaps(beats: DataFrame, seconds: float = HEARTBEAT_GAP_SECONDS) -> DataFrame:
    """Silences of a unit longer than ``seconds``, up to the beat (seq, to_at) that ends them."""
    g = _beside(beats, ("at",), True, "last").withColumn("before", F.col("last.at"))
    return g.where(_seconds(F.col("at"), F.col("before")) > seconds).select("unit", "seq", F.col("before").alias("from_at"), F.col("at").alias("to_at"),
        _seconds(F.col("at"), F.col("before")).alias("gap_s"))


def liveness(beats: DataFrame, seconds: float = HEARTBEAT_GAP_SECONDS) -> DataFrame:
    """Per unit: beats, gaps, the longest of them, distinct builds."""
    g = _beside(beats, ("at",), True, "last").withColumn("s", _seconds(F.col("at"), F.col("last.at")))
    return g.groupBy("unit").agg(F.count("*").alias("beats"), F.count_if(F.col("s") > seconds).alias("gaps"), F.max("s").alias("longest_s"),
        F.countDistinct("build").alias("builds"))


def thermal_state(value: Column) -> Column:
    return F.when(value >= 100, "hot").when(value >= 50, "warm").otherwise("nominal")


def state_minutes(samples: DataFrame, most_gap_s: float = 300.0) -> DataFrame:
    """Minutes in each state: a sample's state lasts to the next sample, unless that is further than ``most_gap_s``."""
    s = _beside(samples, ("at",), False, "next").withColumn("s", _seconds(F.col("next.at"), F.col("at"))).where(F.col("s") <= most_gap_s)
    return s.groupBy("unit", "state").agg((F.sum("s") / 60).alias("minutes"), F.count("*").alias("samples"))


def recovered(samples: DataFrame, minutes: float = OUTAGE_MINUTES) -> DataFrame:
    """Spells outside the nominal state, per unit: number, the longest, and how many ended within ``minutes``."""
    s = _beside(samples.withColumn("out", F.col("state") != "nominal"), ("out",), True, "last")
    s = _beside(s.withColumn("start", (F.col("out") & ~F.coalesce("last.out", F.lit(False))).cast("int")), ("at",), False, "next").withColumn("day", _day())
    # spells are numbered within a day, after those of the days before
    run, earlier = Window.partitionBy("unit", "day").orderBy(*_ORDER), Window.partitionBy("unit").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = s.groupBy("unit", "day").agg(F.sum("start").alias("n")).select("unit", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"))
    s = s.withColumn("spell", F.sum("start").over(run)).join(days, ["unit", "day"]).withColumns({"spell": F.col("spell") + F.col("skipped"), "next_at": F.col("next.at")})
    spells = s.where("out").groupBy("unit", "spell").agg(F.min("at").alias("a"), F.max("next_at").alias("b"), F.bool_or(F.col("next_at").isNull()).alias("open"))
    m = _seconds(F.col("b"), F.col("a")) / 60
    return spells.groupBy("unit").agg(F.count("*").alias("spells"), F.max(m).alias("longest_min"), F.count_if(~F.col("open") & (m <= minutes)).alias("recovered"))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Jobs by status, zero for those without."""
    every = jobs.sparkSession.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    return F.broadcast(every).join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def claim_order(jobs: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The next jobs: pending, available, by priority and age; a top-k claim."""
    return jobs.where((F.col("status") == "pending") & (F.col("created_at") <= as_of)).orderBy("priority", "created_at", "job_id").limit(limit)


def reclaim(jobs: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """In-flight jobs whose lease ended: pending again, or dead at the ``most``-th reclaim."""
    j = jobs.where((F.col("status") == "in_flight") & (F.col("lease_expires_at") < as_of))
    n = F.col("reclaims") + 1
    return j.select("job_id", n.alias("reclaims"), F.when(n >= most, "dead").otherwise("pending").alias("status"))


def fail(jobs: DataFrame, most: int = 3, base_s: int = 2) -> DataFrame:
    """What a failure makes of a job: one more attempt, dead at the ``most``-th, else a doubled delay."""
    n = F.col("attempts") + 1
    return jobs.select("job_id", n.alias("attempts"), F.when(n >= most, "dead").otherwise("pending").alias("status"),
        F.when(n < most, F.pow(F.lit(float(base_s)), n).cast("long")).alias("delay_s"))


def enqueue(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs whose dedupe key isn't in the queue, one per key; a null key never collides."""
    keyed = new.where("dedupe_key IS NOT NULL").dropDuplicates(["dedupe_key"]).join(jobs.select("dedupe_key"), "dedupe_key", "left_anti")
    return keyed.unionByName(new.where("dedupe_key IS NULL"))


def dead_window(jobs: DataFrame, since: Column, degraded: int = 5, critical: int = 25) -> DataFrame:
    d = jobs.where((F.col("status") == "dead") & (F.col("created_at") >= since)).agg(F.count("*").alias("dead"))
    return d.withColumn("level", F.when(F.col("dead") >= critical, "critical").when(F.col("dead") >= degraded, "degraded").otherwise("ok"))


def rolling_budget(spends: DataFrame, hours: int) -> DataFrame:
    """Units per provider and hour bucket, and the sum over the window that ends with it; the bucket at the window's start is outside."""
    b = spends.groupBy("provider", F.date_trunc("hour", "at").alias("hour")).agg(F.sum("units").alias("units"))
    h = (F.unix_timestamp(F.col("hour").cast("timestamp")) / 3600).cast("long")
    w = Window.partitionBy("provider").orderBy(h).rangeBetween(-(hours - 1), 0)
    return b.select("provider", "hour", "units", F.sum("units").over(w).alias("used"))


def politeness(fetches: DataFrame, per_day: int = 6, apart_s: float = 3.0) -> DataFrame:
    """Per host and fetch: fetches of the 24 hours before, seconds since the last, allowed or not."""
    sec = F.unix_micros(F.col("at").cast("timestamp"))
    w = Window.partitionBy("host").orderBy(sec)
    n = F.count("*").over(w.rangeBetween(-86_400_000_000, -1))
    since = (sec - F.max(sec).over(w.rangeBetween(Window.unboundedPreceding, -1))) / F.lit(1e6)
    f = fetches.withColumn("recent", n).withColumn("since_s", since)
    return f.withColumn("allowed", (F.col("recent") < per_day) & (F.col("since_s").isNull() | (F.col("since_s") >= apart_s)))


def throughput(dispatches: DataFrame, since: Column, days: float) -> DataFrame:
    d = dispatches.where(F.col("dispatched_at") >= since)
    a = d.agg(F.countDistinct("k").alias("leads"), F.countDistinct(F.when(F.col("tier").isin("A", "B"), F.col("k"))).alias("ab_leads"))
    return a.withColumn("ab_per_day", F.col("ab_leads") / days)


def acceptance(dispatches: DataFrame, jobs: DataFrame, beats: DataFrame, samples: DataFrame, since: Column, days: float) -> DataFrame:
    """One row of criteria; null where nothing was measured."""
    t = throughput(dispatches, since, days)
    dead = jobs.where((F.col("status") == "dead") & (F.col("created_at") >= since)).agg(F.count("*").alias("dead_jobs"))
    live = liveness(beats.where(F.col("at") >= since)).agg(F.sum("gaps").alias("gaps"), F.count("*").alias("units"))
    hot = recovered(samples.where(F.col("at") >= since)).agg(F.max("longest_min").alias("longest_min"))
    one = t.crossJoin(F.broadcast(dead)).crossJoin(F.broadcast(live)).crossJoin(F.broadcast(hot))  # one row each
    return one.select(
        "leads", "ab_leads", (F.col("ab_per_day") >= 15).alias("throughput_ok"), (F.col("dead_jobs") == 0).alias("jobs_ok"),
            F.when(F.col("units") > 0, F.col("gaps") == 0).alias("liveness_ok"),
        F.when(F.col("longest_min").isNotNull(), F.col("longest_min") <= OUTAGE_MINUTES).alias("thermal_ok"),
    )


def unit_health(beats: DataFrame, as_of: Column, budget_s: float, critical_s: float) -> DataFrame:
    """ok, degraded or critical by a unit's silence and its last flag."""
    b = latest_per_unit(beats)
    s = _seconds(as_of, F.col("at"))
    return b.select("unit", s.alias("silence_s"), F.when(s > critical_s, "critical").when((s > budget_s) | ~F.col("ok"), "degraded").otherwise("ok").alias("level"))


def expected_units(units: DataFrame, beats: DataFrame, as_of: Column, uptime_s: float | None = None) -> DataFrame:
    """The health of every unit that should report: rows (unit, limit_s, optional) with their last beats.

    A unit that never reported is degraded, or ok if it is optional. A silence over the limit is critical; degraded where the unit is
    optional or the host itself has not been up for that long (null: not known, no excuse). A reported failure is degraded.
    """
    s = _seconds(as_of, F.col("at"))
    booted = F.lit(False) if uptime_s is None else F.lit(uptime_s) < F.col("limit_s")
    level = F.when(F.col("at").isNull() & F.col("optional"), "ok").when(F.col("at").isNull(), "degraded").when((s > F.col("limit_s")) & (booted | F.col("optional")),
        "degraded")
    level = level.when(s > F.col("limit_s"), "critical").when(~F.col("ok"), "degraded").otherwise("ok")
    return F.broadcast(units).join(latest_per_unit(beats), "unit", "left").select("unit", s.alias("silence_s"), level.alias("level"))


def run_record(beats: DataFrame, units: DataFrame, since: Column, worker: str) -> DataFrame:
    """One row on a run: the worker's gaps, builds and clean exits, and the units that never reported in it."""
    own = beats.where((F.col("at") >= since) & (F.col("unit") == worker))
    exits = own.agg(F.count_if("exiting").alias("clean_exits"))
    heard = beats.where(F.col("at") >= since).select("unit").distinct()
    silent = units.where(~F.col("optional") & (F.col("unit") != worker)).join(heard, "unit",
        "left_anti").agg(F.array_join(F.array_sort(F.collect_list("unit")), ",").alias("silent_units"))
    return liveness(own).select("gaps", "builds").crossJoin(F.broadcast(exits)).crossJoin(F.broadcast(silent))  # one row each


def worst(levels: DataFrame) -> DataFrame:
    rank = F.when(F.col("level") == "critical", 2).when(F.col("level") == "degraded", 1).otherwise(0)
    return levels.agg(F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("critical")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("level"))


def percentiles(values: DataFrame, by: str, value: str) -> DataFrame:
    return values.groupBy(by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def prometheus(gauges: DataFrame, prefix: str = "leads_") -> DataFrame:
    """Exposition lines of (name, value), sorted."""
    return gauges.select(F.concat(F.lit(prefix), "name", F.lit(" "), F.col("value").cast("string")).alias("line")).orderBy("line")
