"""Structured Streaming forms: rolling sums, heartbeats, latest answers, keyed state, exactly-once appends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .machines import governor


def rolling_units(spends: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Units per provider and sliding window of a stream (provider, at, units); rows later than ``late`` are dropped by the watermark."""
    w = spends.withWatermark("at", late).groupBy(F.window("at", window, slide), "provider").agg(F.sum("units").alias("units"))
    return w.select("provider", F.col("window.end").alias("until"), "units")


def heartbeat_sessions(beats: DataFrame, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Uptime spells of each unit: session windows that a silence of ``gap`` ends."""
    s = beats.withWatermark("at", late).groupBy(F.session_window("at", gap), "unit").agg(F.count("*").alias("beats"))
    return s.select("unit", F.col("session_window.start").alias("from_at"), F.col("session_window.end").alias("to_at"), "beats")


def first_by_key(jobs: DataFrame, key: str = "dedupe_key", at: str = "created_at", late: str = "1 day") -> DataFrame:
    """Idempotent enqueue: the first job of a key within the watermark."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


class Governor(StatefulProcessor):
    """The thermal state machine with a value state per unit.

    Triggers are folded in the order in which they come, the rows of one trigger by time and number: where the source delivers
    in order of time the result is that of the batch form.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues):
        now = self.state.get()[0] if self.state.exists() else None
        for part in rows:
            out = []
            for r in part.sort_values(["at", "seq"]).itertuples():
                now = governor(now, r.value, bool(r.undervoltage))
                out.append((key[0], r.seq, now))
            yield pd.DataFrame(out, columns=["unit", "seq", "state"])
        if now is not None:
            self.state.update((now,))

    def close(self) -> None:
        pass


def governor_stream(samples: DataFrame) -> DataFrame:
    """unit, seq, state of a stream of samples. Needs the RocksDB state store provider."""
    return samples.groupBy("unit").transformWithStateInPandas(statefulProcessor=Governor(), outputStructType="unit string, seq long, state string", outputMode="Append",
        timeMode="None")


def append_once_sink(path: str, key: str):
    """For foreachBatch: append the rows whose key isn't in the table yet; a batch id is a folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(path)
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        earlier = [str(s.getPath()) for s in fs.listStatus(top) if s.getPath().getName() != f"batch={batch_id}"] if fs.exists(top) else []
        if earlier:
            rows = rows.join(spark.read.schema(batch.schema).parquet(*earlier).select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
