"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, and only with a local master, a folder of our own is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and a
    lost executor costs a re-read, not the work before."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v: long), by alternating large-star and small-star rounds.

    Returns (node, component), component being the smallest node that can be reached. A node's
    neighbours are never gathered: each round takes the minimum by node (with partial aggregation)
    and joins it back, so that a hub is split like any skewed join. Each round ends in a written table;
    the number of rounds grows with the logarithm of the longest chain.
    """
    both = lambda d: d.unionByName(d.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: larger neighbours of u are linked with the least of u and its neighbours
        all_ = both(e)
        least = all_.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = all_.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours are linked with the least neighbour
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def backup(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Copies of tables under ``folder``, each as a whole: (name, n). A copy that holds another number of rows is an error."""
    found = []
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
        copied, n = rows.sparkSession.read.parquet(f"{folder}/{name}").count(), rows.count()
        if copied != n:
            raise RuntimeError(f"{name}: {copied} of {n} rows were copied")
        found.append((name, n))
    return next(iter(tables.values())).sparkSession.createDataFrame(found, "name string, n long")
