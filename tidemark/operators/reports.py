"""Text reports as rows of lines, in order: (n, line). Reports are few rows by contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Column of ``operations.acceptance`` -> what it measures.
CRITERIA = {"throughput_ok": "throughput", "jobs_ok": "no_job_lost", "liveness_ok": "no_silent_unit", "thermal_ok": "governor_recovered"}


def _mark(flag: Column) -> Column:
    return F.when(flag.isNull(), "n/a ").when(flag, "PASS").otherwise("FAIL")


def _lines(row: DataFrame, lines: list[Column]) -> DataFrame:
    return row.select(F.posexplode(F.array_compact(F.array(*lines))).alias("n", "line"))


def acceptance_lines(measured: DataFrame) -> DataFrame:
    """The row of ``operations.acceptance`` as a report: the verdict, and a line for each criterion; what wasn't measured passes nothing and fails nothing."""
    flags = [F.col(c) for c in CRITERIA]
    failed = F.exists(F.array(*flags), lambda f: F.coalesce(~f, F.lit(False)))
    detail = {"throughput_ok": F.concat(F.col("ab_leads").cast("string"), F.lit(" of "), F.col("leads").cast("string"), F.lit(" leads in tiers A and B"))}
    each = [F.concat(F.lit("| "), _mark(F.col(c)), F.lit(f" | `{name}` | "), detail.get(c, F.lit("")), F.lit(" |")) for c, name in CRITERIA.items()]
    head = [F.when(failed, "# Acceptance: NOT PASSED").otherwise("# Acceptance: PASSED"), F.lit("| | Criterion | Measured |"), F.lit("| --- | --- | --- |")]
    return _lines(measured, head + each)


def critique_lines(proposals: DataFrame, corpus: int, judged: int) -> DataFrame:
    """Proposals (target, key, proposal) as a document to be read and applied by hand: the corpus, a section for each target, a line for each proposal."""
    spark = proposals.sparkSession
    order = F.struct(F.lit(1).alias("part"), F.col("target"), F.lit(1).alias("sub"), F.col("key"))
    lines = proposals.select(order.alias("o"), F.concat(F.lit("- `"), "key", F.lit("`: "), "proposal").alias("line"))
    heads = proposals.select("target").distinct().select(F.struct(F.lit(1).alias("part"), F.col("target"), F.lit(0).alias("sub"), F.lit("").alias("key")).alias("o"),
        F.concat(F.lit("## "), "target").alias("line"))
    top = spark.range(1).select(F.struct(F.lit(0).alias("part"), F.lit("").alias("target"), F.lit(0).alias("sub"), F.lit("").alias("key")).alias("o"),
        F.lit(f"# Critic: {corpus} scored leads, {judged} judged").alias("line"))
    every = top.unionByName(heads).unionByName(lines)
    return every.withColumn("n", (F.row_number().over(Window.orderBy("o")) - 1).cast("int")).select("n", "line")
