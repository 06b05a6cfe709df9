"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, cut, new_folder, shared_dir
from ..shipping import ship

__all__ = ["MEMORIES", "byte_batches", "components", "cut", "drop_folder", "new_folder", "only_memory", "pick", "qualified", "shared_dir", "table", "word_parts"]


#: What a Python worker remembers between tasks, by operator: how to forget it.
MEMORIES: dict[str, Callable[[], None]] = {}


#: Whose memory this worker holds.
_holder: list[str] = [""]
#: Rows of one Arrow batch at most, unless the session says otherwise: batches are counted in rows, and texts are long.
BATCH_ROWS = 2_500
_ROWS_KEY, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def only_memory(name: str) -> None:
    """Called as a task begins: workers outlive their tasks, so what other operators left in this one is forgotten and given back, and a
    worker holds one operator's memory however many stages it serves."""
    if _holder[0] == name:
        return
    _holder[0] = name
    for other, forget in MEMORIES.items():
        if other != name:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows in this session, if it has Spark's default."""
    if spark.conf.get(_ROWS_KEY, _ROWS_DEFAULT) == _ROWS_DEFAULT:
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark would resolve it, for code that opens files itself."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns ``names``, found by exact name; other columns, also those whose names differ
    only in case or clash with ours, play no part."""
    ship(df.sparkSession)
    short_batches(df.sparkSession)
    have = df.columns
    at = []
    for n in names:
        if n not in have:
            raise ValueError(f"column {n!r} is missing; there are {have}")
        at.append(have.index(n))
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_batches(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of these sizes in bytes, as few as ``limit`` bytes each allow and of near equal sizes; a text that is
    longer than a range stands alone."""
    total = sum(sizes)
    target = total / max(1, -(-total // limit))
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n / 2 > target:  # the cut nearest to the target
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def word_parts(text: str, limit: int) -> Iterator[list[str]]:
    """The words of ``text`` in lists from about ``limit`` characters each; a text is cut at white space only."""
    if len(text) <= limit:
        yield text.split()
        return
    start = 0
    while start < len(text):
        end = min(len(text), start + limit)
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end].split()
        start = end
